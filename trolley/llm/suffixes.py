"""Removal of repeated 100-byte strings with suffix arrays.

1. Every 100-byte window is labelled with its anchor, the smallest hash of the K-byte grams inside it. Equal
   windows have equal anchors. A run of windows with one anchor is a segment; segments whose anchor occurs
   only once in the corpus hold nothing that repeats and are left out.
   Documents whose whole text occurs earlier are repeats at once and send no segments.
2. Equal segments are merged into one row with the earliest place; all later places are repeats as a whole.
   Where all segments of an anchor are equal that settles it, and their bytes are never sent.
3. The other distinct segments are dealt to shards by anchor. A shard builds a suffix array of its segments
   (Larsson-Sadakane: only groups that are still tied are sorted again, by the rank behind them), takes
   common prefixes in text order after Kasai, and every window but the earliest of a run with a common prefix
   of 100 bytes is a repeat.
4. An anchor with too many segments for one shard is cut over several. Their sorted windows are merged by
   binary search, which finds those that start earlier in another shard.
5. The spans are merged per document, and what is left is hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from trolley.llm.words import groups_of
from trolley.sources.scratch import staged

LENGTH = 100
GRAM = 32
SHARD_BYTES = 1 << 20
PART_BYTES = 12 << 20
TEXT_AT_ONCE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Low 32 bits: what a segment is counted by, beside its bucket and 48 bits of its digest.
LOW = np.uint64(0xFFFFFFFF)


def anchors(x: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest gram hash inside every window of `length` bytes; where grams lie that are the smallest of
    some window, and their hashes."""
    n = len(x) - gram + 1
    h, base, have = x.astype(np.uint64) + np.uint64(1), BASE, 1
    # binary powers: hash of `gram` bytes from hashes of powers of two
    done, taken, factor = None, 0, np.uint64(1)
    with np.errstate(over="ignore"):
        rest = gram
        while rest:
            if rest & 1:
                part = h[taken : taken + n]
                # bytes further on come with a higher power, so that pieces just add up
                done = part.copy() if done is None else done + part * factor
                factor = factor * base
                taken += have
            rest >>= 1
            if rest:
                h = h[: len(h) - have] + h[have:] * base
                base, have = base * base, 2 * have
        done ^= done >> np.uint64(29)
        done *= np.uint64(0xBF58476D1CE4E5B9)
        done ^= done >> np.uint64(32)
    width = length - gram + 1
    low = _sliding(np.minimum, done, width)
    # a gram is some window's smallest if the largest of the smallest around it is itself
    edge = np.zeros(width - 1, np.uint64)
    where = np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, low, edge]), width) == done)
    return low, where, done[where]


def _sliding(best, values: np.ndarray, width: int) -> np.ndarray:
    """best() of every `width` neighbouring values, by doubling."""
    have = 1
    while 2 * have <= width:
        values = best(values[: len(values) - have], values[have:])
        have *= 2
    return best(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


class Segments:
    """The segments of a text (anchor, first window, number of windows) and the grams that anchor them."""

    def __init__(self, text: bytes, length: int, gram: int):
        total = len(text) - length + 1
        self._length = length
        self.anchor, self.start, self.windows = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.grams, self._at, self._width = np.empty(0, np.uint64), np.empty(0, np.int64), length - gram + 1
        if total <= 0:
            return
        found, starts, where, grams = [], [], [], []
        for at in range(0, total, TEXT_AT_ONCE):  # blocks overlap, so that no window is cut
            block = np.frombuffer(text, np.uint8, min(TEXT_AT_ONCE + length - 1, len(text) - at), at)
            low, own, hashes = anchors(block, length, gram)
            first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
            found.append(low[first])
            starts.append(first + at)
            where.append(own + at)
            grams.append(hashes)
        self.anchor, self.start = np.concatenate(found), np.concatenate(starts)
        self.windows = np.diff(np.r_[self.start, total])
        self._at, once = np.unique(np.concatenate(where), return_index=True)
        self.grams = np.concatenate(grams)[once]

    def digests(self, text: bytes) -> np.ndarray:
        """A 64-bit digest of each segment's bytes."""
        view, more = memoryview(text), self._length - 1
        own = (xxhash.xxh64_intdigest(view[s : s + n + more]) for s, n in zip(self.start.tolist(), self.windows.tolist()))
        return np.fromiter(own, np.uint64, len(self.start))

    def inner(self) -> np.ndarray:
        """True for segments that hold their anchor more than once, so that windows inside them may be equal."""
        values, code = np.unique(self.grams, return_inverse=True)
        wide = np.int64(1) << 36
        places = np.sort(code * wide + self._at)
        own = np.searchsorted(values, self.anchor) * wide + self.start
        return np.searchsorted(places, own + self.windows + self._width - 1) - np.searchsorted(places, own) > 1


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return (anchor >> np.uint64(40)).astype(np.int64) % buckets


def _keys(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """An anchor's bucket and low 32 bits; two anchors that share them are told apart later."""
    return _bucket(anchor, buckets) << 32 | (anchor & LOW).astype(np.int64)


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sa, rank) of a byte array by Larsson-Sadakane doubling from the first seven bytes on."""
    n = len(x)
    padded = np.concatenate([x.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key = key << np.uint64(9) | padded[j : j + n]
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    head = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.zeros(n + 1, np.int64)  # group number = place of the group's last member; behind the end: 0
    place = np.arange(n)
    depth = 7
    last = _group_ends(head)
    rank[sa] = last + 1
    tied = np.flatnonzero(~(head & np.r_[head[1:], True]))
    while len(tied):
        members = sa[tied]
        group = rank[members]
        behind = rank[np.minimum(members + depth, n)]
        order = np.lexsort((behind, group))
        members, group, behind = members[order], group[order], behind[order]
        sa[tied] = members
        head = np.r_[True, (group[1:] != group[:-1]) | (behind[1:] != behind[:-1])]
        ends = _group_ends(head)
        rank[members] = place[tied][ends] + 1
        tied = tied[~(head & np.r_[head[1:], True])]
        depth *= 2
    return sa, rank[:n] - 1


def _group_ends(head: np.ndarray) -> np.ndarray:
    """For every place the last place of its group, given where groups begin."""
    n = len(head)
    starts = np.flatnonzero(head)
    return np.repeat(np.r_[starts[1:], n] - 1, np.diff(np.r_[starts, n]))


def common_prefixes(x: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """lcp[i] of sa[i - 1] and sa[i], taken in text order: where a suffix and its neighbour follow the same byte,
    their common prefix is one shorter than that of the suffixes one to the left; only the others are compared."""
    n = len(x)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    chained = np.zeros(n, bool)
    chained[1:] = (before[1:] > 0) & (x[:-1] == x[np.maximum(before[1:] - 1, 0)])
    heads = np.flatnonzero(~chained & (before >= 0))
    words = np.zeros(n + 16, np.uint64)
    raw = np.concatenate([x, np.zeros(24, np.uint8)]).tobytes()
    for phase in range(8):
        part = np.frombuffer(raw, "<u8", count=(len(raw) - phase) // 8, offset=phase)
        words[phase::8] = part[: len(words[phase::8])]
    equal = np.zeros(len(heads), np.int64)
    live = np.arange(len(heads))
    while len(live):
        a, b = heads[live] + equal[live], before[heads[live]] + equal[live]
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
        differ = words[a] ^ words[b]
        same = np.where(differ == 0, 8, _low_zero_bytes(differ))
        equal[live] += same
        live = live[same == 8]
    equal = np.minimum(equal, n - np.maximum(heads, before[heads]))
    text_order = np.zeros(n, np.int64)
    text_order[heads] = equal
    source = np.maximum.accumulate(np.where(chained, 0, at))
    text_order = np.where(chained, text_order[source] - (at - source), text_order)
    return text_order[sa]


def _low_zero_bytes(v: np.ndarray) -> np.ndarray:
    low = v & (~v + np.uint64(1))  # lowest set bit
    return np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8


def repeats(rows: list[tuple], length: int, need_reps: bool) -> tuple[np.ndarray, list[tuple], np.ndarray]:
    """Windows of distinct segments that start earlier elsewhere among them.

    rows: (order key of the place, first window's offset, windows, bytes), the keys ascending with the place.
    Returns (row numbers, offsets) of repeats as an array, and, if asked, the sorted first windows of all runs.
    """
    sizes = np.array([len(r[3]) for r in rows])
    counts = np.array([r[2] for r in rows])
    x = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    owner = np.repeat(np.arange(len(rows)), sizes)
    offset = np.arange(len(x)) - np.repeat(begin, sizes)
    valid = offset < np.repeat(counts, sizes)
    sa, _ = suffix_array(x)
    run = np.cumsum(common_prefixes(x, sa) < length)
    keep = valid[sa]
    places, run = sa[keep], run[keep]
    # rows come sorted by place, and a row's windows by offset, so text order is the order of places
    # except between rows of one document whose segments interleave; starts decide those
    doc = np.array([r[0] for r in rows])[owner[places]]
    start = np.array([r[1] for r in rows])[owner[places]] + offset[places]
    order = np.lexsort((start, doc, run))
    first = np.r_[True, run[order][1:] != run[order][:-1]]
    later = places[order[~first]]
    reps = places[order[first]] if need_reps else np.empty(0, np.int64)
    return np.stack([owner[later], offset[later]]), [(owner[p], offset[p], x[p : p + length].tobytes()) for p in reps]


def _spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Ascending window starts as covered [from, to) runs."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return [(int(s[0]), int(s[-1]) + length) for s in np.split(starts, cut)]


class Removal:
    """The stages for one set of parameters."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, part_bytes: int = PART_BYTES):
        if gram > length:
            raise ValueError("the gram must fit into the length")
        self.length, self.gram, self.shard_bytes, self.part_bytes = length, gram, shard_bytes, part_bytes

    def rows(self, docs: DataFrame) -> DataFrame:
        """(doc, nth, text): ids with null last, and a number for rows that repeat an id (ordered by text)."""
        out = docs.select(
            F.col("doc_id").cast("bigint").alias("doc"),
            F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
        ).withColumn("doc", F.coalesce("doc", F.lit((1 << 63) - 1)))
        again = out.groupBy("doc").count().filter("count > 1").select("doc", F.lit(True).alias("again"))
        if not again.take(1):
            return out.withColumn("nth", F.lit(0))
        nth = F.row_number().over(Window.partitionBy("doc").orderBy("text")) - 1
        both = out.join(again, "doc", "left")
        once = both.filter("again IS NULL").withColumn("nth", F.lit(0))
        return once.union(both.filter("again").withColumn("nth", nth)).drop("again")

    def repeated_anchors(self, rows: DataFrame, parts: int) -> DataFrame:
        """(part, known): for each part of the documents the anchors in it that occur twice or more in the corpus, as
        twice their key (see `_keys`), and one more if their segments differ or hold them twice.

        Each task sends, for an anchor of a part, only the segments of the least and the greatest digest, which tells
        both; a bucket counts them over all parts. Rows grow with the segments, never with parts times buckets.
        """
        length, gram, buckets = self.length, self.gram, parts

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in groups_of(batches, "text", 4 * TEXT_AT_ONCE):
                found = []
                for text, part in zip(batch.column("text").to_pylist(), batch.column("part").to_pylist()):
                    own = Segments(text, length, gram)
                    a, d = own.anchor, own.digests(text) >> np.uint64(16)
                    twice = own.inner()  # counts as a second, different segment
                    found.append((np.r_[a, a[twice]], np.r_[d, d[twice] ^ np.uint64(1)], part))
                a, d = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                part = np.repeat([f[2] for f in found], [len(f[0]) for f in found])
                order = np.lexsort((d, a, part))
                a, d, part = a[order], d[order], part[order]
                head = np.r_[True, (a[1:] != a[:-1]) | (part[1:] != part[:-1])][: len(a)]
                ends = head | np.r_[head[1:], True][: len(a)]
                a, d, part = a[ends], d[ends], part[ends].astype(np.int64)
                columns = _bucket(a, buckets), part << 32 | (a & LOW).astype(np.int64), d.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "own", "digest"])

        def count(table: pa.Table) -> pa.Table:
            own, d = table["own"].to_numpy(), table["digest"].to_numpy()
            part, a = own >> 32, own & int(LOW)
            order = np.lexsort((d, a))
            a, d, part = a[order], d[order], part[order]
            same = a[1:] == a[:-1]
            group = np.cumsum(np.r_[True, ~same]) - 1
            often = np.bincount(group) > 1
            mixed = np.bincount(group, np.r_[False, same & (d[1:] != d[:-1])]) > 0
            keep = often[group]
            a, part, mixed = a[keep], part[keep], mixed[group][keep]
            order = np.lexsort((a, part))
            a, part, mixed = a[order], part[order], mixed[order]
            once = np.r_[True, (a[1:] != a[:-1]) | (part[1:] != part[:-1])][: len(a)]
            a, part, mixed = a[once], part[once], mixed[once]
            known = (table["bucket"][0].as_py() << 32 | a) << 1 | mixed
            return pa.table({"part": pa.array(part, pa.int64()), "known": pa.array(known, pa.int64())})

        sent = rows.select("part", "text").mapInArrow(emit, "bucket bigint, own bigint, digest bigint")
        return sent.groupBy("bucket").applyInArrow(count, "part bigint, known bigint")

    def repeated_segments(self, rows: DataFrame, shared: DataFrame, copies: DataFrame, buckets: int) -> DataFrame:
        """(anchor, digest, doc, nth, start, windows, inner, body) of segments whose anchor repeats, without those of
        the documents in `copies`. Bytes come for mixed anchors only, and once a part for equal segments."""
        length, gram = self.length, self.gram
        schema = pa.schema([
            ("anchor", pa.int64()), ("digest", pa.int64()), ("doc", pa.int64()), ("nth", pa.int32()),
            ("start", pa.int64()), ("windows", pa.int64()), ("inner", pa.bool_()), ("body", pa.binary()),
        ])

        def cut(docs: pa.Table, told: pa.Table) -> pa.Table:
            out: list[list] = [[] for _ in schema]
            whole = set(zip(told["doc"].drop_null().to_pylist(), told["nth"].drop_null().to_pylist()))
            known = np.sort(told["known"].drop_null().to_numpy())
            if not len(known):
                return pa.Table.from_pylist([], schema=schema)
            known, mixed = known >> 1, (known & 1).astype(bool)
            seen: set[tuple[int, int]] = set()
            for doc, nth, text in zip(docs["doc"].to_pylist(), docs["nth"].to_pylist(), docs["text"]):
                if (doc, nth) in whole:
                    continue
                text = text.as_py()
                own = Segments(text, length, gram)
                key = _keys(own.anchor, buckets)
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[at] == key
                if not hit.any():
                    continue
                columns = own.anchor.view(np.int64), own.start, own.windows, own.inner(), mixed[at]
                for a, s, n, inner, mix in zip(*[c[hit].tolist() for c in columns]):
                    body = text[s : s + n + length - 1]
                    d = xxhash.xxh64_intdigest(body) - (1 << 63)
                    new = mix and (a, d) not in seen
                    if new:
                        seen.add((a, d))
                    for column, value in zip(out, (a, d, doc, nth, s, n, inner, body if new else None)):
                        column.append(value)
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

        told = shared.unionByName(copies.select("part", "doc", "nth"), allowMissingColumns=True)
        by_part = rows.select("part", "doc", "nth", "text").groupBy("part").cogroup(told.groupBy("part"))
        return by_part.applyInArrow(
            cut,
            "anchor bigint, digest bigint, doc bigint, nth int, start bigint, windows bigint, "
            "inner boolean, body binary",
        )

    def whole_copies(self, rows: DataFrame) -> DataFrame:
        """(part, doc, nth, bytes) of rows whose whole text, of `length` bytes or more, occurs in an earlier row."""
        size = F.octet_length("text").alias("bytes")
        keyed = rows.select("part", "doc", "nth", size, F.unhex(F.sha2("text", 256)).alias("key"))
        keyed = staged(keyed.filter(F.col("bytes") >= self.length), "texts")
        place = F.struct("doc", "nth")
        several = keyed.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
        copies = keyed.join(several.select("key", "first"), "key").filter(place != F.col("first"))
        return staged(copies.select("part", "doc", "nth", "bytes"), "copies")

    def shard_spans(self, distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Repeats inside each shard, and the first windows of anchors that are cut over several shards."""
        length, most = self.length, self.shard_bytes
        sizes = distinct.groupBy("anchor").agg(F.sum(F.octet_length("body")).alias("_b"))
        hot = sizes.filter(F.col("_b") > most).select("anchor", F.ceil(F.col("_b") / most).cast("int").alias("cuts"))
        total = distinct.agg(F.sum(F.octet_length("body"))).first()[0] or 0
        shards = max(1, -(-total // most))
        hot = staged(hot, "hot")
        # the join is left out where no anchor is that large, which saves a shuffle of all segments
        known = distinct.join(hot, "anchor", "left") if hot.take(1) else distinct.withColumn("cuts", F.lit(None).cast("int"))
        dealt = known.withColumn(
            "shard",
            F.when(F.col("cuts").isNull(), F.pmod(F.xxhash64("anchor"), F.lit(shards)))
            .otherwise(F.xxhash64("anchor", F.pmod(F.col("digest"), F.col("cuts")))),
        )
        schema = pa.schema([
            ("doc", pa.int64()), ("nth", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()),
            ("anchor", pa.int64()), ("body", pa.binary()),
        ])

        def build(table: pa.Table) -> pa.Table:
            rows = list(zip(*[table[c].to_pylist() for c in ("anchor", "doc", "nth", "start", "windows", "body", "cuts", "inner")]))
            counts: dict[int, int] = {}
            for r in rows:
                counts[r[0]] = counts.get(r[0], 0) + 1
            # one segment alone repeats nothing, unless it holds its anchor twice
            rows = [r for r in rows if counts[r[0]] > 1 or r[7] or r[6] is not None]
            if not rows:
                return pa.Table.from_pylist([], schema=schema)
            rows.sort(key=lambda r: (r[1], r[2], r[3]))
            keys = {k: i for i, k in enumerate(sorted({(r[1], r[2]) for r in rows}))}
            split = any(r[6] is not None for r in rows)
            work = [(keys[r[1], r[2]], r[3], r[4], r[5]) for r in rows]
            (owner, offset), firsts = repeats(work, length, split)
            out = []
            order = np.lexsort((offset, owner))
            owner, offset = owner[order], offset[order]
            cut = np.flatnonzero(np.diff(owner)) + 1
            for o, offs in zip(np.split(owner, cut), np.split(offset, cut)):
                if len(o):
                    r = rows[int(o[0])]
                    out += [(r[1], r[2], r[3] + lo, r[3] + hi, None, None) for lo, hi in _spans(offs, length)]
            for o, off, body in firsts:
                r = rows[int(o)]
                if r[6] is not None:
                    out.append((r[1], r[2], r[3] + int(off), None, r[0], body))
            columns = list(zip(*out)) if out else [[] for _ in schema]
            return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

        both = dealt.groupBy("shard").applyInArrow(build, "doc bigint, nth int, lo bigint, hi bigint, anchor bigint, body binary")
        both = staged(both, "spans")
        return both.filter("hi IS NOT NULL").select("doc", "nth", "lo", "hi"), both.filter("hi IS NULL")

    def merged_spans(self, firsts: DataFrame) -> DataFrame:
        """Windows of cut anchors that start earlier in another shard, by merging sorted lists with binary search.

        A cell holds the windows of one anchor that agree in a hash of their bytes modulo the cells, so an
        anchor of any size is spread; equal windows always meet.
        """
        length = self.length
        schema = "doc bigint, nth int, lo bigint, hi bigint"
        cells = F.ceil(F.col("n") * (length + 40) / F.lit(self.shard_bytes))
        sizes = firsts.groupBy("anchor").agg(F.count("*").alias("n")).select("anchor", cells.alias("cells"))
        dealt = firsts.join(sizes, "anchor").withColumn("cell", F.pmod(F.xxhash64("body"), F.col("cells")))

        def merge(table: pa.Table) -> pa.Table:
            rows = sorted(zip(*[table[c].to_pylist() for c in ("doc", "nth", "lo", "body")]))
            held = np.empty(0, f"S{length}")
            later = []
            for at in range(0, len(rows), 4096):  # ascending places: whatever is held starts earlier
                part = rows[at : at + 4096]
                own, first = np.unique(np.array([r[3] for r in part], f"S{length}"), return_index=True)
                where = np.searchsorted(held, own)
                known = np.zeros(len(own), bool)
                inside = where < len(held)
                known[inside] = held[where[inside]] == own[inside]
                new = set(first[~known].tolist())
                later += [part[i] for i in range(len(part)) if i not in new]
                held = np.insert(held, where[~known], own[~known])
            return pa.table({
                "doc": pa.array([r[0] for r in later], pa.int64()), "nth": pa.array([r[1] for r in later], pa.int32()),
                "lo": pa.array([r[2] for r in later], pa.int64()),
                "hi": pa.array([r[2] + length for r in later], pa.int64()),
            })

        return dealt.select("anchor", "cell", "doc", "nth", "lo", "body").groupBy("anchor", "cell").applyInArrow(merge, schema)

    def spans(self, rows: DataFrame) -> DataFrame:
        """(doc, nth, lo, hi): spans whose every byte lies in a string of `length` bytes that starts earlier elsewhere."""
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(1, -(-total // self.part_bytes))
        placed = rows.withColumn("part", F.pmod(F.xxhash64("doc", "nth"), F.lit(parts)))
        whole = self.whole_copies(placed)
        found = staged(self.repeated_segments(placed, self.repeated_anchors(placed, parts), whole, parts), "segments")
        place = F.struct("doc", "nth", "start")
        distinct = found.groupBy("anchor", "digest").agg(
            F.min(place).alias("p"), F.max("windows").alias("windows"), F.max("inner").alias("inner"), F.max("body").alias("body"), F.count("*").alias("places")
        )
        distinct = distinct.filter("places > 1 OR body IS NOT NULL")
        distinct = staged(distinct.select("anchor", "digest", "p.*", "windows", "inner", "body", "places"), "distinct")
        copied = distinct.filter("places > 1").select("anchor", "digest", place.alias("first"))
        copies = found.select("anchor", "digest", "doc", "nth", "start", "windows").join(copied, ["anchor", "digest"])
        copies = copies.filter(place != F.col("first")).select(
            "doc", "nth", F.col("start").alias("lo"), (F.col("start") + F.col("windows") + self.length - 1).alias("hi")
        )
        inside, firsts = self.shard_spans(distinct.filter("body IS NOT NULL"))
        all_of = whole.select("doc", "nth", F.lit(0).cast("bigint").alias("lo"), F.col("bytes").cast("bigint").alias("hi"))
        return copies.union(inside).union(self.merged_spans(firsts)).union(all_of)


def remove_repeats(docs: DataFrame, removal: Removal | None = None, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and its remaining bytes if `texts`.

    A byte goes if a string of 100 bytes covering it also starts earlier: in a smaller doc_id, or earlier in
    the same document; rows repeating a doc_id count as further documents, in order of their texts, and rows
    without one come last. Null texts are empty; further columns are ignored.
    """
    removal = removal or Removal()
    rows = removal.rows(docs)
    listed = removal.spans(rows).groupBy("doc", "nth").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    schema = "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * texts
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of(batches, "text", 4 * TEXT_AT_ONCE):
            out = []
            for doc, text, spans in zip(*[batch.column(c).to_pylist() for c in ("doc", "text", "spans")]):
                at, removed, runs, kept = 0, 0, 0, []
                end = -1
                for s in sorted((s["lo"], s["hi"]) for s in spans or []):
                    lo, hi = max(s[0], at), s[1]
                    if s[0] > end:
                        runs += 1
                    end = max(end, hi)
                    if hi > at:
                        kept.append(text[at:lo])
                        removed += hi - lo
                        at = hi
                kept.append(text[at:])
                rest = b"".join(kept)
                out.append((doc, len(text), removed, runs, hashlib.sha256(rest).hexdigest(), rest)[: len(names)])
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], names=names)

    done = rows.join(listed, ["doc", "nth"], "left").select("doc", "text", "spans").mapInArrow(cut, schema)
    own = F.when(F.col("doc") != (1 << 63) - 1, F.col("doc")).cast(docs.schema["doc_id"].dataType)
    return done.select(own.alias("doc_id"), *names[1:])
