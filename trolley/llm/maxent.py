"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) x P(word | class). A word's class follows from its shape (ending, closing
marks), so unseen words have one too. The class softmax has three hashed features: the word before, the classes
of the last two words, and, skipping one, the word before the last. Their weights start at damped log ratios of
the counted pairs (feature, class) and are trained by gradient updates: each round's tasks sum observed minus
expected counts over one stripe of the corpus, Spark adds them up, and the step is scaled by the expected
counts; one epoch covers every training document. Tokens of a part with the same features share one softmax.
Inside a class the softmax has bias features only, whose optimum is the smoothed relative count.

Texts are cut once into parts of about PART_BYTES, stored as word numbers with the part's own word list. Word
counts are exact over the whole corpus: each part sends its words' 64-bit hashes and counts to buckets, which
add them up and answer each part in its own order. Only tables of fixed size reach the driver.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from trolley.llm.words import as_bytes, groups_of, words_of
from trolley.sources.scratch import staged

CLASSES = 64
SLOTS = 4096
FEATURES = 3
ROUNDS = 4
PART_BYTES = 8 << 20
HISTORIES_AT_ONCE = 1 << 11
SMOOTH = 0.1
END = b"\n"  # no word: words hold no white space

PARTS = (
    "part bigint, docs array<bigint>, held array<boolean>, sizes binary, hashes binary, classes binary, "
    "counts binary, ids binary"
)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def class_of(word: bytes) -> int:
    """0 for the end; else from the last two letters, the kind of marks behind them and the length."""
    if word == END:
        return 0
    stem = word.rstrip(b".,;:!?#*$%&|\"')")
    marks = 0 if len(stem) == len(word) else 1 if word[-1:] in b".!?" else 2 if word[-1:] in b",;:" else 3
    key = bytes([marks, min(len(stem), 4) // 2]) + stem[-2:]
    return 1 + zlib.crc32(key) % (CLASSES - 1)


def parts_of(docs: DataFrame) -> DataFrame:
    """Rows of PARTS: whole texts as word numbers, many documents a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for piece in groups_of(iter([batch]), "text", PART_BYTES):
                known: dict[bytes, int] = defaultdict(count().__next__)
                known[END]
                docs = piece.column("doc_id").to_pylist()
                held = [held_out(d) for d in docs]
                ids = []
                for text in piece.column("text").to_pylist():
                    words = words_of(text)
                    words.append(END)
                    ids.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
                train = [i for i, h in zip(ids, held) if not h] or [np.empty(0, np.uint32)]
                counts = np.bincount(np.concatenate(train), minlength=len(known)).astype(np.uint32)
                hashes = np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64)
                classes = np.array([class_of(w) for w in known], np.uint8)
                sizes = np.array([len(i) for i in ids], np.int32)
                blobs = [x.tobytes() for x in (sizes, hashes, classes, counts, np.concatenate(ids))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([next(number)]), pa.array([docs], pa.list_(pa.int64())), pa.array([held])]
                    + [pa.array([b], pa.binary()) for b in blobs],
                    names=["part", "docs", "held", "sizes", "hashes", "classes", "counts", "ids"],
                )

    rows = as_bytes(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), "text", "doc_id")
    return rows.mapInArrow(run, PARTS)


def global_counts(parts: DataFrame, buckets: int) -> DataFrame:
    """(part, bucket, counts, sums): for each part its words' corpus-wide training counts, bucket by bucket in the
    part's own order; sums, once a bucket, are training tokens and distinct words by class."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, classes = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["classes"], np.uint8)
                counts = np.frombuffer(row["counts"], np.uint32)
                own = (hashes % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(own, kind="stable")
                cut = np.searchsorted(own[order], np.arange(1, buckets))
                lists = [np.split(x[order], cut) for x in (hashes, classes, counts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * buckets), pa.array(range(buckets), pa.int64())]
                    + [pa.array([x.tobytes() for x in each], pa.binary()) for each in lists],
                    names=["part", "bucket", "hashes", "classes", "counts"],
                )

    def add(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(b, np.uint64) for b in table["hashes"].to_pylist()]
        counts = np.concatenate([np.frombuffer(b, np.uint32) for b in table["counts"].to_pylist()])
        classes = np.concatenate([np.frombuffer(b, np.uint8) for b in table["classes"].to_pylist()])
        words, first, back = np.unique(np.concatenate(lists), return_index=True, return_inverse=True)
        total = np.bincount(back, counts, len(words)).astype(np.int64)
        kind = classes[first]
        sums = np.concatenate([
            np.bincount(kind, total, CLASSES).astype(np.int64), np.bincount(kind[total > 0], minlength=CLASSES)
        ])
        answers = np.split(total[back], np.cumsum([len(x) for x in lists])[:-1])
        n = len(lists)
        return pa.table({
            "part": table["part"], "bucket": table["bucket"],
            "counts": pa.array([a.tobytes() for a in answers], pa.binary()),
            "sums": pa.array([sums.tolist()] + [None] * (n - 1), pa.list_(pa.int64())),
        })

    sent = parts.select("part", "hashes", "classes", "counts").mapInArrow(
        send, "part bigint, bucket bigint, hashes binary, classes binary, counts binary"
    )
    return sent.groupBy("bucket").applyInArrow(add, "part bigint, bucket bigint, counts binary, sums array<bigint>")


@dataclass
class Model:
    """Class weights: `bias` and one row of class weights for each slot of each feature; sums by class."""

    bias: np.ndarray
    weights: np.ndarray  # (FEATURES * SLOTS, CLASSES)
    tokens: np.ndarray
    types: np.ndarray

    def logits(self, slots: np.ndarray) -> np.ndarray:
        z = self.weights[slots[0]]
        for s in slots[1:]:
            z += self.weights[s]
        z += self.bias
        return z

    def shares(self, slots: np.ndarray) -> np.ndarray:
        z = self.logits(slots)
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z


def events(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each token, slots of its features (FEATURES x tokens), whether its document trains)."""
    ids = np.frombuffer(row["ids"], np.uint32)
    sizes = np.frombuffer(row["sizes"], np.int32)
    kind = np.frombuffer(row["classes"], np.uint8)[ids]
    slot = ((np.frombuffer(row["hashes"], np.uint64) >> np.uint64(40)) % np.uint64(SLOTS)).astype(np.int32)[ids]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    one, two = _behind(kind, starts, 1, 0), _behind(kind, starts, 2, 0)
    end = int(slot[ends[0] - 1])
    slots = np.stack([
        _behind(slot, starts, 1, end),
        SLOTS + one.astype(np.int32) * CLASSES + two,
        2 * SLOTS + _behind(slot, starts, 2, end),
    ])
    return kind, slots, np.repeat(~np.array(row["held"], bool), sizes)


def histories(slots: np.ndarray) -> np.ndarray:
    """One number for each token's features; tokens of the same number have the same class shares."""
    return (slots[0].astype(np.int64) * SLOTS + (slots[1] - SLOTS)) * SLOTS + (slots[2] - 2 * SLOTS)


def _slots_of(known: np.ndarray) -> np.ndarray:
    """The features of `histories` again."""
    return np.stack([known // (SLOTS * SLOTS), SLOTS + known // SLOTS % SLOTS, 2 * SLOTS + known % SLOTS])


def _behind(values: np.ndarray, starts: np.ndarray, n: int, fill: int) -> np.ndarray:
    """The value n tokens back inside the document; `fill` before its first token."""
    out = np.empty_like(values)
    out[n:], out[:n] = values[: len(values) - n], fill
    for k in range(n):
        at = starts + k
        out[at[at < len(out)]] = fill
    # a document shorter than n passes the fill on to the next one's first token, which is filled anyway
    return out


def _summed(parts: DataFrame, measure, tables: int) -> np.ndarray:
    """Sum over all tasks of `tables` arrays (FEATURES * SLOTS x CLASSES) that `measure` adds a part's counts to.

    Each task sends one block of rows at a time, so a sum is spread over as many groups as there are blocks, and
    the driver receives one row a block.
    """
    rows, block = tables * FEATURES * SLOTS, 512

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, used = np.zeros((rows, CLASSES), np.float64), False
        for batch in batches:
            for row in batch.to_pylist():
                measure(row, sums)
                used = True
        if used:
            pieces = sums.astype(np.float32).reshape(rows // block, -1)
            keep = np.flatnonzero(pieces.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keep), pa.array([pieces[k].tobytes() for k in keep], pa.binary())], names=["block", "sums"]
            )

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(block * CLASSES)
        for b in table["sums"]:
            total += np.frombuffer(b.as_buffer(), np.float32)
        return pa.table({"block": table["block"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    done = parts.mapInArrow(run, "block bigint, sums binary").groupBy("block").applyInArrow(add, "block bigint, sums binary")
    out = np.zeros((rows, CLASSES))
    for r in done.collect():
        out[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(r["sums"]).reshape(block, CLASSES)
    return out


def _observed(row: dict, sums: np.ndarray) -> None:
    kind, slots, train = events(row)
    for s in slots:
        cell = s[train] * CLASSES + kind[train]
        lowest = int(s[0]) // SLOTS * SLOTS
        n = np.bincount(cell - lowest * CLASSES, minlength=SLOTS * CLASSES)
        sums[lowest : lowest + SLOTS] += n.reshape(SLOTS, CLASSES)


def _expected(model: Model, slots: np.ndarray, sums: np.ndarray) -> None:
    known, times = np.unique(histories(slots), return_counts=True)
    for at in range(0, len(known), HISTORIES_AT_ONCE):
        own = _slots_of(known[at : at + HISTORIES_AT_ONCE])
        p = model.shares(own)
        p *= times[at : at + HISTORIES_AT_ONCE, None].astype(np.float32)
        for f, s in enumerate(own):
            q = p
            if f:  # histories ascend, and so do their first features
                order = np.argsort((s % SLOTS).astype(np.uint16), kind="stable")
                s, q = s[order], p[order]
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            sums[s[first]] += np.add.reduceat(q, first, axis=0)


def train(parts: DataFrame, tokens: np.ndarray, types: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Weights from one epoch in `rounds` synchronous gradient updates."""
    fields = parts.select("part", "held", "sizes", "hashes", "classes", "ids")
    share = (tokens + 1.0) / (tokens.sum() + CLASSES)
    seen = _summed(fields, _observed, 1)
    prior = 20.0
    start = np.log((seen + prior * share) / (seen.sum(axis=1, keepdims=True) + prior)) - np.log(share)
    model = Model(np.log(share).astype(np.float32), (start / FEATURES * 1.2).astype(np.float32), tokens, types)
    wide = FEATURES * SLOTS
    for r in range(rounds):
        shared = parts.sparkSession.sparkContext.broadcast(model)  # of fixed size

        def gradient(row: dict, sums: np.ndarray) -> None:
            _, slots, use = events(row)
            _expected(shared.value, slots[:, use], sums[wide:])
            _observed(row, sums)

        stripe = fields.filter(F.pmod(F.xxhash64("part"), F.lit(rounds)) == r)
        sums = _summed(stripe, gradient, 2)
        observed, expected = sums[:wide], sums[wide:]
        step = np.clip((observed - expected) / (expected + 5.0), -0.5, 0.5) * (1.5 / FEATURES)
        model.weights = model.weights + step.astype(np.float32)
        shared.unpersist()
    return model


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from rows whose crc32(doc_id as text) modulo 10 is not 0 (a null id counts as the empty text, whose
    checksum is 0: held out). Null and empty texts are one end token. Repeated rows count and score each time;
    without any training row counts are zero and the model is uniform over classes; further columns are ignored.
    """
    parts = staged(parts_of(docs), "parts")
    total = parts.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    buckets = max(1, -(-total // (16 << 20)))
    answers = staged(global_counts(parts, buckets), "counts")
    sums = answers.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    by_class = np.zeros(2 * CLASSES, np.int64)
    for r in sums:
        by_class[r["pos"]] = r["n"]
    tokens, types = by_class[:CLASSES], by_class[CLASSES:]
    model = train(parts, tokens, types)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n_train, n_types = int(tokens.sum()), int(types.sum())

    def run(own: pa.Table, counted: pa.Table) -> pa.Table:
        model: Model = shared.value
        (row,) = own.to_pylist()
        ids, sizes = np.frombuffer(row["ids"], np.uint32), np.frombuffer(row["sizes"], np.int32)
        hashes, classes = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["classes"], np.uint8)
        order = np.argsort((hashes % np.uint64(buckets)).astype(np.int64), kind="stable")
        blobs = [b for _, b in sorted(zip(counted["bucket"].to_pylist(), counted["counts"].to_pylist()))]
        c = np.empty(len(hashes), np.int64)
        c[order] = np.frombuffer(b"".join(blobs), np.int64)
        base = np.log10((c + SMOOTH) / (n_train + SMOOTH * (n_types + 1)))
        inside = np.log10((c + SMOOTH) / (model.tokens + SMOOTH * (model.types + 1))[classes])
        kind, slots, _ = events(row)
        chosen = np.empty(len(ids))
        number = histories(slots)
        order = np.argsort(number, kind="stable")
        new = np.flatnonzero(np.diff(number[order], prepend=-1))
        ends = np.append(new, len(ids))
        for at in range(0, len(new), HISTORIES_AT_ONCE):
            cuts = ends[at : at + HISTORIES_AT_ONCE + 1]
            tokens = order[cuts[0] : cuts[-1]]
            of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            z = model.logits(_slots_of(number[order[cuts[:-1]]]))
            top = z.max(axis=1, keepdims=True)
            norm = np.log(np.exp(z - top).sum(axis=1)) + top[:, 0]
            chosen[tokens] = z[of, kind[tokens]] - norm[of]
        first = np.cumsum(sizes) - sizes
        sums = [np.add.reduceat(v, first) for v in ((c > 0)[ids].astype(np.int64), base[ids], inside[ids] + chosen / np.log(10))]
        return pa.table({
            "doc_id": pa.array(row["docs"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()),
            "n_tokens": pa.array(sizes.astype(np.int64)), "n_known": pa.array(sums[0]),
            "train_tokens": pa.array(np.full(len(sizes), n_train)),
            "base_score": pa.array(sums[1]), "score": pa.array(sums[2]),
        })

    own = parts.select("part", "docs", "held", "sizes", "hashes", "classes", "ids").groupBy("part")
    return own.cogroup(answers.select("part", "bucket", "counts").groupBy("part")).applyInArrow(
        run,
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double",
    )
