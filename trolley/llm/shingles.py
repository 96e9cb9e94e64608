"""Near-duplicates by the Jaccard similarity of whole shingle sets: complete candidates, each link verified.

Prefix filtering: under one order of all shingles, two sets of similarity t or more share a shingle among the
first n - ceil(t n) + 1 of each, so sets that meet under no such key need no comparison. Any order keeps this
true; shingles that are common in a sample of the texts come last, which keeps frequent passages out of the
prefixes. Texts with equal sets are one node, and stars inside the keys, around another centre each round, join a large
group before the pairs still apart are looked for, so a group of near copies is not all its pairs. These pairs are compared
where their key's nodes lie side by side (hot keys in chunks), and only near ones become rows. The first shingle that two
sets share stands at a place with enough of both sets behind it, which leaves most frequent keys without a pair.

Candidates are first compared by fingerprints. Every shingle of a set flips one bit, so two fingerprints (the longer
one folded to the length of the other) differ in no more bits than the sets differ in shingles, which for similar sets is
(1 - t) / (1 + t) of both sizes at most: this radius loses no pair. The comparison is bit-sliced: the differing bits of 64
pairs are one word a bit plane, carry-save counters add the planes up, each pair from its own start so that it overflows
beyond its own radius, and words whose 64 pairs have all overflowed are abandoned. What is left is verified on the whole
sets, which travel for these only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from trolley.llm.components import components
from trolley.llm.quality import text_hash
from trolley.llm.words import as_bytes, free, groups_of, words_of
from trolley.operators.spread import spread_by
from trolley.sources.scratch import replaced, staged

SEED = 42
#: Similarity from which two texts are near copies, as a fraction.
SIMILAR = (4, 5)
#: About so many nodes are looked at to tell common shingles; those in COMMON of them or more count as common.
SAMPLE, COMMON = 20_000, 3
#: Rounds of stars at most before the remaining pairs are compared; a round that adds less than one link in WORTH is the last.
STARS, WORTH = 5, 50
SHINGLES_AT_ONCE = 1 << 15
TEXT_AT_ONCE = 1 << 22
TABLE_BITS = 24
#: A fingerprint has PRINT_SHARE bits a shingle or more, a power of two between these; so many bits are compared at a time.
PRINT_SHARE, LEAST_BITS, MOST_BITS = 4, 256, 1 << 16
BITS_AT_ONCE = 1 << 23
#: Bits of the fingerprints that travel with the meetings, nodes of a key compared in one piece, rows taken at a time.
SHORT_BITS = 1024
MOST_IN_CELL = 2048
ROWS_AT_ONCE = 1 << 16


def shingles(text: bytes, width: int) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct runs of `width` words (of all words, if there are fewer)."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    starts, ends, digest = starts[:n].tolist(), ends[-n:].tolist(), xxhash.xxh64_intdigest
    cuts = [slice(at, at + SHINGLES_AT_ONCE) for at in range(0, n, SHINGLES_AT_ONCE)]
    hashed = [np.array([digest(line[s:e], SEED) for s, e in zip(starts[c], ends[c])], np.uint64) for c in cuts]
    return np.unique(np.concatenate(hashed))


def node_of(own: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(own.tobytes(), SEED), np.uint64).view(np.int64))


def fingerprint(own: np.ndarray, bits: int | None = None) -> bytes:
    """The parity of the shingles at each place (the first bits of the hash), packed."""
    bits = bits or max(LEAST_BITS, min(MOST_BITS, 1 << (PRINT_SHARE * len(own)).bit_length()))
    times = np.bincount((own >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits)
    return np.packbits(times.astype(np.uint8) & 1).tobytes()


def _folded(prints: list[bytes], size: int) -> np.ndarray:
    """The fingerprints at a length of `size` bytes, neighbouring bits of longer ones combined."""
    out = np.empty((len(prints), size), np.uint8)
    for i, p in enumerate(prints):
        bits = np.frombuffer(p, np.uint8)
        while len(bits) > size:
            pair = np.unpackbits(bits).reshape(-1, 2)
            bits = np.packbits(pair[:, 0] ^ pair[:, 1])
        out[i] = bits
    return out


def _radius(sizes: np.ndarray) -> np.ndarray:
    """Most shingles in which similar sets of `sizes` shingles together differ."""
    up, down = SIMILAR
    return sizes * (down - up) // (down + up)


def close(us: list[bytes], vs: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Whether two fingerprints lie within the radius that similar sets, `sizes` shingles together, can have."""
    radius = _radius(sizes)
    length = np.minimum(*(np.fromiter(map(len, p), np.int64, len(p)) for p in (us, vs)))
    out = np.zeros(len(us), bool)
    for size in np.unique(length).tolist():
        every = np.flatnonzero(length == size)
        step = max(64, BITS_AT_ONCE // (8 * size))
        for at in range(0, len(every), step):
            rows = every[at : at + step]
            a, b = (_folded([p[i] for i in rows], size) for p in (us, vs))
            out[rows] = within(a ^ b, radius[rows])
    return out


def within(differ: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Whether each row of `differ` (packed bits, one pair a row) has no more than its radius of set bits."""
    n = len(differ)
    words = -(-n // 64)

    def sliced(bits: np.ndarray) -> np.ndarray:
        """One word a plane and 64 rows."""
        flat = np.packbits(bits.T, axis=1, bitorder="little")
        out = np.zeros((len(flat), 8 * words), np.uint8)
        out[:, : flat.shape[1]] = flat
        return out.view("<u8")

    planes = sliced(np.unpackbits(differ, axis=1))
    digits = len(planes).bit_length()
    start = (1 << digits) - 1 - np.minimum(radius, len(planes)).astype(np.int64)
    count = list(sliced(start[:, None] >> np.arange(digits) & 1 == 1))
    alive, rows = np.full(words, ~np.uint64(0), "<u8"), np.arange(words)
    result = np.zeros(words, "<u8")
    for k, plane in enumerate(planes):
        carry = plane[rows]
        for d in range(digits):
            carry, count[d] = carry & count[d], carry ^ count[d]
        alive = alive & ~carry
        if k % 32 == 31:
            kept = alive != 0
            if not kept.all():
                rows, alive, count = rows[kept], alive[kept], [c[kept] for c in count]
                if not len(rows):
                    break
    result[rows] = alive
    return np.unpackbits(result.view(np.uint8), bitorder="little")[:n].astype(bool)


def prefix(own: np.ndarray, common: np.ndarray, times: np.ndarray, similar: tuple[int, int] = SIMILAR) -> np.ndarray:
    """The first n - ceil(t n) + 1 shingles: those not in `common` (ascending) first, then by `times`, then by hash."""
    n = len(own)
    size = n - -(-n * similar[0] // similar[1]) + 1 if n else 0
    if not len(common) or not n:
        return own[:size]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    rank = np.where(common[at] == own, times[at], 0)
    return own[np.argsort(rank, kind="stable")[:size]]


def _sets(docs: DataFrame, width: int, make, schema: str, *keep: str) -> DataFrame:
    """One pass over the texts: `make(batch slice, sets)` gives the columns of `schema`."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in groups_of(batches, "text", TEXT_AT_ONCE):
            yield pa.RecordBatch.from_arrays(step(batch, width), names=names)

    return as_bytes(docs.withColumn("_hash", text_hash()), "text", *keep, "_hash").mapInArrow(run, schema)


def marks(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, _hash, node, n, print, short) of every row: the node of its shingle set, the set's size, fingerprints."""

    def make():
        def step(batch: pa.RecordBatch, width: int) -> list[pa.Array]:
            own = [shingles(t, width) for t in batch.column("text").to_pylist()]
            found = [pa.array([f(s) for s in own], pa.int64()) for f in (node_of, len)]
            prints = [[fingerprint(s, bits) for s in own] for bits in (None, SHORT_BITS)]
            return [batch.column("doc_id"), batch.column("_hash"), *found, *(pa.array(p, pa.binary()) for p in prints)]

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _sets(docs, width, make, f"doc_id {kind}, _hash bigint, node bigint, n bigint, print binary, short binary", "doc_id")


def _wanted(docs: DataFrame, width: int, rows: DataFrame) -> DataFrame:
    """(node, own) at least for the texts whose _hash is in `rows`, told from others by a bit table of fixed size."""
    slot = F.shiftrightunsigned("_hash", 64 - TABLE_BITS)
    bit = F.expr("shiftleft(1L, cast(slot % 64 AS int))")
    words = rows.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
    table = np.zeros(1 << TABLE_BITS >> 6, np.int64)
    for r in words.collect():
        table[r["word"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def make():
        seen: set[int] = set()
        bits = shared.value.view(np.uint64)

        def step(batch: pa.RecordBatch, width: int) -> list[pa.Array]:
            slots = batch.column("_hash").to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - TABLE_BITS)
            hit = bits[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63)) & np.uint64(1)
            nodes, sets = [], []
            for i in np.flatnonzero(hit).tolist():
                own = shingles(batch.column("text")[i].as_py(), width)
                if (node := node_of(own)) not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(own.view(np.int64))
            ends = np.cumsum([0, *map(len, sets)])
            flat = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
            return [pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]

        return step

    return _sets(docs, width, make, "node bigint, own array<bigint>")


def common_shingles(docs: DataFrame, width: int, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, nodes that hold it), ascending, of shingles in COMMON or more of about SAMPLE nodes."""
    share = max(1, rows.select("node").distinct().count() // SAMPLE)
    chosen = rows.filter(F.pmod("node", F.lit(share)) == 0)
    own = _wanted(docs, width, chosen.select("_hash"))
    own = own.filter(F.pmod("node", F.lit(share)) == 0).dropDuplicates(["node"])
    counted = own.select(F.explode("own").alias("key")).groupBy("key").count().filter(F.col("count") >= COMMON)
    table = counted.toArrow()
    keys = table["key"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table["count"].to_numpy()[order]


def meetings(docs: DataFrame, width: int, common: np.ndarray, times: np.ndarray) -> DataFrame:
    """(key, node, n, place, centre, n_centre) of every prefix shingle that two nodes or more have in their prefixes.

    n is the node's size, place the shingle's in the order of its set, centre the smallest node of the key.
    """
    shared = docs.sparkSession.sparkContext.broadcast((common, times))  # at most SAMPLE / COMMON texts

    def make():
        seen: set[int] = set()

        def step(batch: pa.RecordBatch, width: int) -> list[pa.Array]:
            nodes, sizes, keys = [], [], []
            for text in batch.column("text").to_pylist():
                own = shingles(text, width)
                if (node := node_of(own)) not in seen:  # copies met by one task are one row
                    seen.add(node)
                    nodes.append(node)
                    sizes.append(len(own))
                    keys.append(prefix(own, *shared.value).view(np.int64))
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            times = [len(k) for k in keys]
            places = np.concatenate([np.arange(n) for n in times]) if times else flat
            repeated = [np.repeat(np.array(c, np.int64), times) for c in (nodes, sizes)]
            return [pa.array(flat), *map(pa.array, repeated), pa.array(places)]

        return step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "node", "n", "place", "centre", "n_centre"]
        last, before = np.empty((0, 4), np.int64), False  # the row held back, and whether its key came before it
        centre = np.zeros(2, np.int64)  # of the key that the row held back belongs to
        for batch in batches:
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in names[:4]]
            rows = np.concatenate([last, np.column_stack(own)])
            if not len(rows):
                continue
            rows = rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]]
            same = rows[1:, 0] == rows[:-1, 0]
            start = np.maximum.accumulate(np.where(np.r_[False, same], 0, np.arange(len(rows))))
            centres = rows[start, 1:3]
            if len(last):  # the first key may have begun in an earlier batch
                centres[start == 0] = centre
            centre = centres[-1]
            kept = np.r_[before, same] | np.r_[same, False]
            before = bool(same[-1]) if len(same) else before
            last = rows[-1:]
            kept[-1] = False
            found = np.column_stack([rows, centres])[kept]
            yield pa.RecordBatch.from_arrays([pa.array(found[:, c]) for c in range(6)], names=names)
        if before:
            found = np.column_stack([last, centre[None, :]])
            yield pa.RecordBatch.from_arrays([pa.array(found[:, c]) for c in range(6)], names=names)

    schema = "key bigint, node bigint, n bigint, place bigint"
    sent = spread_by(_sets(docs, width, make, schema), "key").sortWithinPartitions("key", "node")
    return sent.mapInArrow(run, f"{schema}, centre bigint, n_centre bigint")


def _near(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The (u, v) rows whose fingerprints lie within the radius that similar sets of their sizes can have."""
    a, b = (prints.select(F.col("node").alias(e), F.col("n").alias(f"_n{e}"), F.col("print").alias(f"_{e}")) for e in "uv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(batch.column(c).to_numpy() for c in ("_nu", "_nv"))
            kept = pa.array(close(batch.column("_u").to_pylist(), batch.column("_v").to_pylist(), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(kept) for c in "uv"], names=["u", "v"])

    return pairs.join(a, "u").join(b, "v").mapInArrow(run, "u bigint, v bigint")


def _alike(pairs: DataFrame, rows: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The (u, v) rows whose sets reach the similarity; the sets of these nodes are made from the texts again."""
    up, down = SIMILAR
    nodes = staged(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "pair-nodes")
    sets = _wanted(docs, width, rows.join(nodes, "node", "left_semi").select("_hash"))
    sets = sets.join(nodes, "node", "left_semi").dropDuplicates(["node"])
    a, b = (sets.select(F.col("node").alias(e), F.col("own").alias(f"_{e}")) for e in "uv")
    both = F.size(F.array_intersect("_u", "_v"))
    whole = F.size("_u") + F.size("_v") - both
    return pairs.join(a, "u").join(b, "v").filter(both * down >= whole * up).select("u", "v")


def _fits(a: str, b: str):
    """Whether two sets of these sizes can reach the similarity at all."""
    return F.least(a, b) * SIMILAR[1] >= F.greatest(a, b) * SIMILAR[0]


def _first_common(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether the key can be the first shingle that similar sets share; rows hold n, place and root."""
    up, down = SIMILAR
    need = up * (rows[left, 0] + rows[right, 0])
    enough = [(rows[i, 0] - rows[i, 1]) * (up + down) >= need for i in (left, right)]
    return enough[0] & enough[1] & (rows[left, 2] != rows[right, 2])


def near_in_cells(cell: np.ndarray, rows: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of one cell that may be alike; `cell` ascends, rows hold n, place and root."""
    n = len(cell)
    edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
    after = np.repeat(edge[1:], np.diff(edge)) - 1 - np.arange(n)  # rows of the cell behind each row
    found, left = [np.empty((0, 2), np.int64)], np.arange(n)
    for shift in range(1, int(after.max(initial=0)) + 1):
        left = left[after[left] >= shift]
        pair = left[_first_common(rows, left, left + shift)]
        for at in range(0, len(pair), BITS_AT_ONCE // SHORT_BITS):
            a = pair[at : at + BITS_AT_ONCE // SHORT_BITS]
            near = within(prints[a] ^ prints[a + shift], _radius(rows[a, 0] + rows[a + shift, 0]))
            found.append(np.column_stack([a[near], a[near] + shift]))
    return tuple(np.concatenate(found).T)


def _listed(met: DataFrame, prints: DataFrame) -> DataFrame:
    """(u, v) of the nodes with different roots that meet under a key and may be alike by their short fingerprints."""
    hot = met.groupBy("key").count().filter(F.col("count") > MOST_IN_CELL)
    hot = hot.select("key", F.ceil(F.col("count") / (MOST_IN_CELL // 2)).cast("int").alias("chunks"))
    rows = met.join(hot, "key", "left").join(prints.select("node", "short"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    # An uncut key is one cell; chunk c of a cut one takes part in the cells {c, any other}.
    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.xxhash64("key", F.least(x, own), F.greatest(x, own)))
    cells = F.when(F.col("chunks").isNull(), F.array("key")).otherwise(pair)
    dealt = rows.select(F.explode(cells).alias("cell"), "node", "n", "place", "root", "short")
    dealt = spread_by(dealt, "cell").sortWithinPartitions("cell")

    def pairs(table: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        a, b = near_in_cells(table[:, 0], table[:, 2:], prints)
        ends = np.sort(np.column_stack([table[a, 1], table[b, 1]]), axis=1)
        ends = np.unique(ends, axis=0)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, i]) for i in (0, 1)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cell", "node", "n", "place", "root"]
        table, shorts = np.empty((0, 5), np.int64), np.empty((0, SHORT_BITS // 8), np.uint8)
        for batch in batches:
            own = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            table = np.concatenate([table, own])
            print_rows = np.frombuffer(b"".join(batch.column("short").to_pylist()), np.uint8).reshape(-1, SHORT_BITS // 8)
            shorts = np.concatenate([shorts, print_rows])
            if len(table) >= ROWS_AT_ONCE:
                cut = int(np.searchsorted(table[:, 0], table[-1, 0]))  # the last cell may go on
                yield pairs(table[:cut], shorts[:cut])
                table, shorts = table[cut:], shorts[cut:]
        yield pairs(table, shorts)

    return dealt.mapInArrow(run, "u bigint, v bigint").distinct()


def near_copies(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, _hash, root) for every row: rows have one root where a chain of links joins them.

    Two rows are linked if the Jaccard similarity of their sets of `width`-word shingles is SIMILAR or more;
    texts without words are alike. `_hash` tells apart rows that repeat a doc_id, null ids included.
    """
    rows = staged(marks(docs, width), "marks")
    prints = staged(rows.select("node", "n", "print", "short").dropDuplicates(["node"]), "prints")
    met, path = replaced(None, meetings(docs, width, *common_shingles(docs, width, rows)), "meetings")
    links = met.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)
    # The first centre of a key, its smallest node, comes with the meetings.
    pairs = met.filter("node <> centre").filter(_fits("n", "n_centre")).select(F.col("node").alias("u"), F.col("centre").alias("v"))
    met = met.select("key", "node", "n", "place", F.col("node").alias("root"))
    for turn in range(1, STARS + 1):
        # One centre a node is enough for a round; what it leaves apart is met again.
        near = staged(_near(pairs.distinct(), prints).groupBy("u").agg(F.min("v").alias("v")), "near")
        found = staged(_alike(near, rows, docs, width), "stars")
        new = found.count()
        if not new:
            break
        links = links.union(found)
        roots = staged(components(links), "roots")
        rooted = met.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # Only keys whose nodes are still apart are looked at again.
        rooted = staged(rooted.select("key", "node", "n", "place", "root"), "rooted")
        apart = rooted.groupBy("key").agg((F.min("root") != F.max("root")).alias("apart")).filter("apart")
        met, path = replaced(path, rooted.join(apart, "key", "left_semi"), "meetings")
        if new * WORTH < links.count():
            break
        # Another centre each round, the same for all keys that two nodes share.
        drawn = F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), "node", "n")
        reps = met.groupBy("key", "root").agg(F.min(drawn).alias("own"))
        centre = reps.groupBy("key").agg(F.min(F.struct("own", "root")).alias("_c"))
        pairs = reps.join(centre, "key").filter("root <> _c.root").filter(_fits("own.n", "_c.own.n"))
        pairs = pairs.select(F.col("own.node").alias("u"), F.col("_c.own.node").alias("v"))
    near = staged(_near(_listed(met, prints), prints), "near")
    roots = components(links.union(staged(_alike(near, rows, docs, width), "links")))
    named = rows.join(roots, "node", "left")
    return named.select("doc_id", "_hash", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of `docs` for each root of near_copies: the smallest by doc_id (null last) and hash of the text.

    Of rows that repeat both, the first by the other columns is kept. Columns of any name are kept as they are.
    """
    id_, null_, hash_, n_ = free(docs, "id", "null", "hash", "n")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), "_hash")).alias("_m")
    kept = classes.groupBy("root").agg(least).select("_m.*")
    kind = docs.schema["doc_id"].dataType
    zero = F.lit(0).cast(kind)
    kept = kept.select(F.coalesce("id", zero).alias(id_), F.col("null").alias(null_), F.col("_hash").alias(hash_))
    keys = [id_, null_, hash_]
    known = docs.withColumns({id_: F.coalesce("doc_id", zero), null_: F.col("doc_id").isNull(), hash_: text_hash()})
    order = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in docs.columns if c != "doc_id"])
    first = known.join(kept, keys, "left_semi").withColumn(n_, F.row_number().over(order))
    return first.filter(F.col(n_) == 1).select(*docs.columns)
