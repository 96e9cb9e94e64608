"""Benchmark decontamination by the q-gram lemma.

From every word of a benchmark item on, and once at its end, windows of each of LENGTHS characters are cut, each
with an edit budget. So a copied run of whole words of SHORTEST characters or more begins with a window. If a
window of length m occurs in a text with at most k edits, at least m - q + 1 - k q of its q-grams occur in
order inside a stretch of m + k characters. Three steps apply this, each losing nothing:

1. all q-grams of a text are looked up in a bit table of the windows' q-grams; stretches with too few hits go,
2. hits of the rest are counted by window and diagonal band (bands overlap, so k shifts stay in one band),
3. bands that meet the bound are verified by banded alignment.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trolley.llm.quality import text_hash
from trolley.llm.words import as_bytes, free, groups_of
from trolley.sources.scratch import staged

Q = 9
#: The shortest copied passage that is found; longer windows allow their own share of edits.
SHORTEST, LENGTH = 60, 100
LENGTHS = (SHORTEST, LENGTH)
EDIT_SHARE = 0.08
#: Items whose normalised text is shorter than this are matched exactly, at word borders.
LEAST_CHARS = 40
TABLE_BITS = 22
#: Benchmark bytes handled by one pass over the documents.
BLOCK_BYTES = 2 << 20
TEXT_AT_ONCE = 1 << 20

#: For lower-cased text: A-Z to lower case; other ASCII that is neither letter nor digit becomes a space; bytes from 128 stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def normalised(text: bytes) -> bytes:
    """Letters and digits in lower case, everything between them one space."""
    return b" ".join(text.translate(FOLD).split())


def _grams(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of the Q bytes starting at each position."""
    n = len(x) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    packed = np.zeros(n, np.uint64)
    raw = x.tobytes()
    for phase in range(min(8, n)):
        part = np.frombuffer(raw, "<u8", count=(len(raw) - phase) // 8, offset=phase)
        packed[phase::8] = part[: len(packed[phase::8])]
    last = x[8 : 8 + n].astype(np.uint64)
    return (packed ^ (last * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)


class Windows:
    """The windows of a block of benchmark items and the index of their q-grams.

    A q-gram of an item lies in windows that follow each other, so the index names their range.
    """

    def __init__(self, items: list[tuple[int, bytes]]):
        self.item: list[int] = []
        self.text: list[bytes] = []
        self.short: dict[bytes, list[tuple[bytes, int]]] = {}  # by first word
        self._places: dict[int, dict[int, int]] = {}
        codes, ranges, starts = [np.empty(0, np.uint64)], [np.empty((0, 3), np.int64)], [np.empty(0, np.int64)]
        for item_id, raw in items:
            body = normalised(raw)
            if len(body) < LEAST_CHARS:
                if body:
                    self.short.setdefault(body.split(b" ", 1)[0], []).append((body, item_id))
                continue
            x = np.frombuffer(body, np.uint8)
            words = np.r_[0, np.flatnonzero(x == 32) + 1]
            grams = _grams(x)
            place = np.arange(len(grams))
            for length in sorted({min(n, len(body)) for n in LENGTHS}):
                own = np.unique(np.r_[words[words <= len(body) - length], len(body) - length])
                low = np.searchsorted(own, place - (length - Q), "left")
                high = np.searchsorted(own, place, "right")
                codes.append(grams)
                ranges.append(np.column_stack([low, high, place]) + [len(self.item), len(self.item), 0])
                starts.append(own)
                self.item += [item_id] * len(own)
                self.text += [body[at : at + length] for at in own.tolist()]
        sizes = np.array([len(t) for t in self.text], np.int64)
        self.budget = (sizes * EDIT_SHARE).astype(np.int64)
        self.bound = sizes - Q + 1 - self.budget * Q
        code, table = np.concatenate(codes), np.concatenate(ranges)
        order = np.argsort(code, kind="stable")
        self.codes = code[order]
        self.low, self.high, self.place = table[order].T
        self.start = np.concatenate(starts)  # of each window in its item
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[code >> np.uint64(64 - TABLE_BITS)] = True
        self.least = int(self.bound.min(initial=LENGTH))
        self.reach = int((sizes + self.budget).max(initial=1))

    def places(self, window: int) -> dict[int, int]:
        """Bits of the window's characters, made when first asked for."""
        if window not in self._places:
            self._places[window] = places_of(self.text[window])
        return self._places[window]


def short_in(text: bytes, windows: Windows) -> dict[int, tuple[int, int, int]]:
    """item -> (1, 0, first position) for the short items that stand in a normalised text word for word."""
    out: dict[int, tuple[int, int, int]] = {}
    at = 0
    for word in text.split(b" ") if windows.short else []:
        for body, item in windows.short.get(word, ()):
            end = at + len(body)
            if item not in out and text.startswith(body, at) and (end == len(text) or text[end] == 32):
                out[item] = (1, 0, at)
        at += len(word) + 1
    return out


def _expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, member) of every member of the ranges low .. high - 1."""
    n = high - low
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) + np.repeat(low - (np.cumsum(n) - n), n)


def places_of(pattern: bytes) -> dict[int, int]:
    """The places of every character of a pattern, as bits."""
    out: dict[int, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def edits_within(places: dict[int, int], length: int, stretch: bytes, budget: int) -> int | None:
    """Fewest edits that turn a pattern into some substring of `stretch`, None above the budget.

    Bit-parallel dynamic program: one column a character of the stretch, whose rises and falls from row to row are the
    bits of two integers.
    """
    whole, last = (1 << length) - 1, 1 << (length - 1)
    up, down, score, best = whole, 0, length, budget + 1
    for c in stretch:
        same = places.get(c, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        rise = (down | ~(across | up)) & whole
        fall = up & across
        if rise & last:
            score += 1
        elif fall & last:
            score -= 1
            if score < best:
                best = score
                if not best:
                    return 0
        rise <<= 1
        up = (fall << 1 | ~(vertical | rise)) & whole
        down = rise & vertical
    return best if best <= budget else None


def find_in(text: bytes, windows: Windows, codes: np.ndarray) -> dict[int, tuple[int, int, int]]:
    """item -> (windows found, fewest edits, first position) for one normalised text and its gram codes."""
    maybe = np.flatnonzero(windows.table[codes >> np.uint64(64 - TABLE_BITS)])
    if len(maybe) < windows.least:
        return {}
    # keep hits that have `least` hits within some stretch of `reach` positions around them
    ahead = np.searchsorted(maybe, maybe + windows.reach) - np.arange(len(maybe))
    dense = np.zeros(len(maybe) + 1, np.int64)
    starts = np.flatnonzero(ahead >= windows.least)
    np.add.at(dense, starts, 1)
    np.add.at(dense, starts + ahead[starts], -1)
    maybe = maybe[np.cumsum(dense[:-1]) > 0]
    if not len(maybe):
        return {}
    low = np.searchsorted(windows.codes, codes[maybe], "left")
    high = np.searchsorted(windows.codes, codes[maybe], "right")
    row, entry = _expanded(low, high)
    row, entry = maybe[row], entry.astype(np.int64)
    own, window = _expanded(windows.low[entry], windows.high[entry])
    # a window without enough hits in the whole text has no band with enough of them
    enough = np.bincount(window, minlength=len(windows.bound)) >= windows.bound
    kept = enough[window]
    own, window = own[kept], window[kept]
    place = windows.place[entry][own] - windows.start[window]  # of the q-gram in its window
    diagonal = row[own] - place + LENGTH
    step = windows.budget[window] + 1
    bands = np.concatenate([diagonal // step, diagonal // step - 1])  # band b covers 2 steps from b * step on
    key = np.concatenate([window, window]).astype(np.int64) << 40 | (bands + 1)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first_hit = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    hits = np.diff(np.r_[first_hit, len(key)])
    key, place = key[first_hit], np.concatenate([place, place])[order]
    out: dict[int, tuple[int, int, int]] = {}
    done: set[int] = set()
    for k in np.flatnonzero(hits >= windows.bound[key >> 40]).tolist():
        w = int(key[k] >> 40)
        # the bound counts different q-grams of the window; a repetitive text hits the same ones again
        if w in done or len(set(place[first_hit[k] : first_hit[k] + hits[k]].tolist())) < windows.bound[w]:
            continue
        budget, pattern = int(windows.budget[w]), windows.text[w]
        first = (int(key[k] & ((1 << 40) - 1)) - 1) * (budget + 1) - LENGTH
        at = max(0, first - budget)
        edits = edits_near(windows.places(w), pattern, text, at, first, budget)
        if edits is None:
            continue
        done.add(w)
        item = windows.item[w]
        was = out.get(item, (0, budget + 1, at))
        out[item] = (was[0] + 1, min(was[1], edits), min(was[2], at))
    return out


def edits_near(places: dict[int, int], pattern: bytes, text: bytes, at: int, first: int, budget: int) -> int | None:
    """Fewest edits of a window against the stretch its diagonal band allows, None above the budget."""
    stretch = text[at : max(at, first) + 2 * (budget + 1) + len(pattern) + 2 * budget]
    return 0 if pattern in stretch else edits_within(places, len(pattern), stretch, budget)


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_windows, edits, position) for every document that holds a window of a benchmark item.

    Windows are 60 and 100 characters long (the whole item if shorter) and start at every word; 8 % of their
    length may be edits. Every copied run of whole words of 60 characters or more is found, if no more than 4
    edits lie in its first 60 characters or 8 in its first 100. Items under 40 characters count as one window
    that must stand in the text as it is, at word borders. `position` is the normalised text's offset, near the first window found. The benchmark is the query
    set: it is read in blocks of `block_bytes`, one pass over the documents each, and each block's result is
    written before the next. Items without letters and digits, null texts and null items give no rows; a document or
    item that appears twice gives its rows twice or once (items are keyed by id). Rows without a doc_id are
    reported with null.
    """
    items = benchmark.filter("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    parts = []
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        windows = Windows([(r["item_id"], r["text"].lower().encode()) for r in sorted(set(rows))])
        found = _pass(docs, windows)
        parts.append(staged(found, "leaks") if blocks > 1 else found)
    return reduce(DataFrame.union, parts)


def _pass(docs: DataFrame, windows: Windows) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(windows)  # at most a block of the benchmark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Windows = shared.value
        for batch in groups_of(batches, "text", TEXT_AT_ONCE):
            texts = [normalised(t) for t in batch.column("text").to_pylist()]
            joined = np.frombuffer(b"\0".join(texts) + bytes(Q), np.uint8)
            codes = _grams(joined)
            rows, start = [], 0
            for i, t in enumerate(texts):
                found = short_in(t, index)
                if len(t) >= Q:
                    found |= find_in(t, index, codes[start : start + len(t) - Q + 1])
                rows += [(i, item, *rest) for item, rest in found.items()]
                start += len(t) + 1
            ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
            cut = [pa.array([r[c] for r in rows], pa.int64()) for c in range(1, 5)]
            yield pa.RecordBatch.from_arrays([ids, *cut], names=["doc_id", "item_id", "n_windows", "edits", "position"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return as_bytes(docs.withColumn("text", F.lower("text")), "text", "doc_id").mapInArrow(
        run, f"doc_id {kind}, item_id bigint, n_windows bigint, edits bigint, position bigint"
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak. A leak lies in the text, so rows are told apart by its hash, not by their doc_id.

    Columns of any name are kept as they are.
    """
    (hash_,) = free(docs, "hash")
    leaks = contaminated(docs.select(text_hash().alias("doc_id"), "text"), benchmark)
    leaks = leaks.select(F.col("doc_id").alias(hash_)).distinct()
    return docs.withColumn(hash_, text_hash()).join(leaks, hash_, "left_anti").select(*docs.columns)
