"""SimHash near-duplicates: shingle fingerprints, linked by a bit-sliced comparison inside buckets.

Fingerprints of equal texts are merged first, so a group of a million copies is one node. Nodes meet in
buckets of chosen bits. `pigeonhole` keys lose no pair: with the bits cut into blocks, a pair within the
radius agrees on at least (blocks - radius) of them. `sampled` keys serve radii where that is too many
keys. Inside a bucket the fingerprints are bit planes: shifting a plane against itself by `o` compares 64
pairs (i, i + o) a word, a carry-save counter sums the differing planes, and words whose 64 pairs all
exceed the radius are abandoned. Pairs that are linked already are masked out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from random import Random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from trolley.llm.components import components
from trolley.llm.words import as_bytes, groups_of, words_of
from trolley.operators.spread import spread_by
from trolley.sources.scratch import staged

SEED = 42
#: Fingerprints compared in one piece; a bucket with more is cut into chunks and all pairs of chunks.
MOST_IN_BUCKET = 4096
ROWS_AT_ONCE = 1 << 16
SHINGLES_AT_ONCE = 1 << 15


def fingerprint(words: Sequence[bytes], width: int, parts: int) -> list[int]:
    """`parts` x 64 bits (part p hashes with seed SEED + p): a bit is set if over half the shingles set it."""
    if not words:
        return [0] * parts
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    digest, out = xxhash.xxh64_intdigest, []
    for p in range(parts):
        counts = np.zeros(64, np.int64)
        for at in range(0, n, SHINGLES_AT_ONCE):
            cut = slice(at, at + SHINGLES_AT_ONCE)
            h = np.array([digest(line[s:e], SEED + p) for s, e in zip(starts[cut], ends[cut])], "<u8")
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0]))
    return out


def fingerprints(docs: DataFrame, width: int = 4, parts: int = 1) -> DataFrame:
    """(doc_id, f0 ... ) of every row, repeated ones too: whole texts in lower-cased words, null or blank: zero."""
    names = [f"f{p}" for p in range(parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of(batches, "text", 1 << 22):
            rows = [fingerprint(words_of(t), width, parts) for t in batch.column("text").to_pylist()]
            own = np.array(rows, np.int64).reshape(-1, parts)
            columns = [batch.column("doc_id"), *[pa.array(own[:, p]) for p in range(parts)]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} bigint" for n in names)
    return as_bytes(docs, "text", "doc_id").mapInArrow(run, schema)


def pigeonhole(bits: int, radius: int, blocks: int) -> list[list[int]]:
    """Bit lists such that any two fingerprints within `radius` agree on all bits of one list at least."""
    if blocks <= radius:
        raise ValueError("more blocks than the radius are needed")
    cut = np.array_split(np.arange(bits), blocks)
    return [[int(b) for c in chosen for b in c] for chosen in combinations(cut, blocks - radius)]


def sampled(bits: int, keys: int, size: int, seed: int = SEED) -> list[list[int]]:
    """`keys` lists of `size` random bits: a pair differing in a share d of them meets with 1 - (1 - (1-d)^size)^keys."""
    draw = Random(seed)
    return [sorted(draw.sample(range(bits), size)) for _ in range(keys)]


def close_pairs(cell: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by cell: each row's label, equal for rows linked inside the same cell (smallest row number)."""
    n, parts = prints.shape
    label = np.arange(n)
    edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
    after = np.repeat(edge[1:], np.diff(edge)) - 1 - np.arange(n)  # rows of the cell behind each row
    most = int(after.max(initial=0))
    if not most:
        return label
    wide = -(-n // 64)
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(n, 8 * parts), axis=1, bitorder="little")
    planes = np.zeros((64 * parts, wide + most // 64 + 2), "<u8")
    flat = np.packbits(bits.T, axis=1, bitorder="little")
    planes.view(np.uint8)[:, : flat.shape[1]] = flat
    digits = radius.bit_length() + (radius & (radius + 1) == 0)
    start = (1 << digits) - 1 - radius  # one more difference than the radius overflows the counter
    rows = np.arange(n)
    for shift in range(1, most + 1):
        rows = rows[after[rows] >= shift]
        apart = rows[label[rows] != label[rows + shift]]  # what is linked already needs no comparison
        if not len(apart):
            continue
        words, first = np.unique(apart >> 6, return_index=True)
        alive = np.bitwise_or.reduceat(np.uint64(1) << (apart & 63).astype("<u8"), first)
        count = [np.full(len(words), ~np.uint64(0) if start >> d & 1 else 0, "<u8") for d in range(digits)]
        jump, low = divmod(shift, 64)
        for k, plane in enumerate(planes):
            other = plane[words + jump]
            if low:
                other = other >> np.uint64(low) | plane[words + jump + 1] << np.uint64(64 - low)
            carry = plane[words] ^ other
            for d in range(digits):
                carry, count[d] = carry & count[d], carry ^ count[d]
            alive &= ~carry
            if k % 8 == 7:
                kept = alive != 0
                if not kept.all():
                    words, alive, count = words[kept], alive[kept], [c[kept] for c in count]
                    if not len(words):
                        break
        if len(words):
            near = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            w, b = np.nonzero(near)
            left = words[w] * 64 + b
            _unite(label, left, left + shift)
    return label


def _unite(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Merge the labels of linked rows in place."""
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (down := label[label]).tobytes() != label.tobytes():
            label[:] = down


def links(nodes: DataFrame, radius: int, keys: Sequence[Sequence[int]], most: int = MOST_IN_BUCKET) -> DataFrame:
    """Links (a0.., b0..) that connect every two nodes (distinct f0..) which share a bucket and lie within the radius.

    A bucket yields a forest, not all pairs. Buckets over `most` rows are cut into chunks, and each pair of
    chunks is a cell of its own, so no task holds a whole hot bucket and no pair of it is lost.
    """
    names = [c for c in nodes.columns if c[0] == "f" and c[1:].isdigit()]
    parts = len(names)

    def key(i: int, bits: Sequence[int]):
        masks = [sum(1 << (b % 64) for b in bits if b // 64 == p) for p in range(parts)]
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        return F.xxhash64(F.lit(i), *[F.col(n).bitwiseAND(F.lit(m).cast("bigint")) for n, m in zip(names, signed)])

    rows = nodes.select(*names, F.explode(F.array(*[key(i, bits) for i, bits in enumerate(keys)])).alias("key"))
    hot = rows.groupBy("key").count().filter(F.col("count") > most)
    hot = hot.select("key", F.ceil(F.col("count") / (most // 2)).cast("int").alias("chunks"))
    rows = rows.join(hot, "key", "left")
    own = F.pmod(F.xxhash64(*names), F.col("chunks")).cast("int")
    # An uncut bucket is one cell; chunk c of a cut one takes part in the cells {c, any other}.
    pair = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.xxhash64("key", F.least(x, own), F.greatest(x, own))
    )
    cells = F.when(F.col("chunks").isNull(), F.array("key")).otherwise(pair)
    dealt = spread_by(rows.select(F.explode(cells).alias("cell"), *names), "cell").sortWithinPartitions("cell")
    ends = [f"{e}{p}" for e in "ab" for p in range(parts)]

    def forest(cell: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        label = close_pairs(cell, prints, radius)
        own = np.flatnonzero(label != np.arange(len(label)))
        columns = [pa.array(prints[rows, p].astype(np.int64)) for rows in (own, label[own]) for p in range(parts)]
        return pa.RecordBatch.from_arrays(columns, names=ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            held.append(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ["cell", *names]]))
            rows += batch.num_rows
            if rows >= ROWS_AT_ONCE:
                table = np.concatenate(held)
                cut = int(np.searchsorted(table[:, 0], table[-1, 0]))  # the last cell may go on
                if cut:
                    yield forest(table[:cut, 0], table[:cut, 1:])
                held, rows = [table[cut:]], len(table) - cut
        if rows:
            table = np.concatenate(held)
            yield forest(table[:, 0], table[:, 1:])

    return dealt.mapInArrow(run, ", ".join(f"{e} bigint" for e in ends))


def _hex(*columns: str):
    return F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in columns])


def near_duplicates(
    docs: DataFrame, width: int = 4, parts: int = 1, radius: int = 4, keys: Sequence[Sequence[int]] | None = None
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    Rows link when their fingerprints differ in at most `radius` bits; component_id is the smallest doc_id
    reachable, the row's own included. `keys` defaults to pigeonhole keys, which lose no link. Texts without
    words have fingerprint zero and link like others. Rows without a doc_id get a fingerprint and the class's
    smallest id (null if it has none); repeated rows each give a row; further columns are ignored.
    """
    keys = keys or pigeonhole(64 * parts, radius, radius + 2)
    names = [f"f{p}" for p in range(parts)]
    prints = staged(fingerprints(docs, width, parts), "prints")
    nodes = staged(prints.groupBy(*names).agg(F.min("doc_id").alias("first")), "nodes")
    found = links(nodes, radius, keys)
    a, b = ([f"{e}{p}" for p in range(parts)] for e in "ab")
    roots = components(found.select(_hex(*a).alias("u"), _hex(*b).alias("v")))
    named = nodes.select("first", _hex(*names).alias("fingerprint"))
    rooted = named.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select("fingerprint", "component_id")
    return prints.select("doc_id", _hex(*names).alias("fingerprint")).join(classes, "fingerprint").select(
        "doc_id", "fingerprint", "component_id"
    )


def keep_first(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of `docs` that stand for their class: its smallest doc_id, and one row of those repeating that id.

    Rows without a doc_id are not named by any class and stay.
    """
    from pyspark.sql import Window

    kept = classes.filter("doc_id = component_id").select("doc_id").distinct()
    others = [F.col(c) for c in docs.columns if c != "doc_id"]
    order = Window.partitionBy("doc_id").orderBy(*others)
    first = docs.join(kept, "doc_id", "left_semi").withColumn("_n", F.row_number().over(order))
    return first.filter("_n = 1").select(*docs.columns).union(docs.filter("doc_id IS NULL"))
