"""Phrases whose words go together, best first, by branch and bound over prefixes.

A node is a phrase of two words that occurs often enough; expanding it counts its continuations by one word. No
continuation of `u v` occurs more often than min(f(u v), best f(v x)), which bounds the score of every phrase that
starts with `u v`. Nodes are expanded in the order of their bounds, some thousand a language at first and then eight
times as many, until the phrases known to reach the threshold are enough: everything left is bounded below it.

Counting is one pass over the texts a round. Tasks number their words, count codes in numpy arrays that are emptied
at a fixed size, and leave out words and prefixes whose hash is not in a bitmap (of bounded size, so false hits occur;
an exact join removes them).

Cases: null and empty texts have no words; a null language is `und`; an empty table gives no rows; repeated rows count
each time; extra columns are not read; texts are cut into segments at word ends with the words before carried over, so
length is no matter.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from trolley.llm.words import as_bytes, groups_of
from trolley.operators.spread import hot_key_join
from trolley.operators.topk import top_k
from trolley.sources.scratch import staged

#: Lower case for A-Z, and one sign for all that ends a piece.
_TABLE = bytes(range(256)).lower().translate(bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"." * 10))
_GAP = re.compile(rb"[ \t.]")
# Bytes of text taken at a time, bits of a word's number in a task, codes held before they are counted, counts held.
SEGMENT = 4 << 20
WORD_BITS = 19
HELD_CODES = 1 << 22
HELD_COUNTS = 1 << 20
# A bitmap has so many bits a member, between 2^16 and 2^28 bits (32 MB) in all.
BITS_EACH = 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
SCALE = 1_000_000
GROWTH = 8


def key_of(phrase: Column, lang: Column) -> Column:
    """One text for (phrase, language); no word holds a line end."""
    return F.concat(phrase, F.lit("\n"), lang)


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """Bytes in which the bit numbered by each key's XXH64 is set; at most MOST_BITS bits reach the driver."""
    n, bits = keys.count(), LEAST_BITS
    while bits < min(MOST_BITS, BITS_EACH * n):
        bits *= 2
    place = F.xxhash64(column).bitwiseAND(F.lit(bits - 1))
    parts = keys.select(place.alias("at")).groupBy(F.expr("at div 32768").alias("part"))
    found = np.zeros((bits // 32768, 4096), np.uint8)
    for row in parts.agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits")).toLocalIterator():
        found[row.part] = np.frombuffer(row.bits, np.uint8)
    return found.reshape(-1)


def _members(bits: np.ndarray, phrases: list[bytes], lang: bytes) -> np.ndarray:
    end = b"\n" + lang
    hashes = np.fromiter((xxhash.xxh64_intdigest(p + end, 42) for p in phrases), np.uint64, len(phrases))
    at = (hashes & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7) & 1).astype(bool)


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts added up by code, codes ascending."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, int)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


class _Tally:
    """Counts of the phrases of `size` words of one language inside a task."""

    def __init__(self, lang: str, size: int, frequent: np.ndarray | None, open_prefixes: np.ndarray | None):
        self.lang, self.size, self.frequent, self.open_prefixes = lang, size, frequent, open_prefixes
        self._clear()

    def _clear(self) -> None:
        self.numbers: defaultdict = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[b"."]  # noqa: B018  the end of a piece is word 0
        self.usable = np.zeros(1, bool)
        self.codes: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.known = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, words: list[bytes], old: int) -> Iterator[pa.RecordBatch]:
        """Count the phrases that end after the first `old` words."""
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        self.total += int(np.count_nonzero(ids[old:]))
        if len(self.numbers) > len(self.usable):
            fresh = list(self.numbers)[len(self.usable) :]
            usable = np.ones(len(fresh), bool)
            if self.frequent is not None:
                usable = _members(self.frequent, fresh, self.lang.encode())
            self.usable = np.concatenate([self.usable, usable])
        good, span = self.usable[ids], len(ids) - self.size + 1
        if span > 0:
            code, whole = np.zeros(span, np.int64), np.ones(span, bool)
            for i in range(self.size):
                code = code << WORD_BITS | ids[i : i + span]
                whole &= good[i : i + span]
            whole[: max(0, old - self.size + 1)] = False
            self.codes.append(code[whole])
            self.waiting += len(self.codes[-1])
        if self.waiting > HELD_CODES:
            self._count()
        # A segment may bring as many new words as it has bytes / 2, so numbers stay below 2^WORD_BITS only if
        # the tally is emptied well before; add() is called with at most MOST_WORDS words.
        if len(self.numbers) + MOST_WORDS >= 1 << WORD_BITS or len(self.known[0]) > HELD_COUNTS:
            yield from self.flush()

    def _count(self) -> None:
        codes = np.concatenate([self.known[0], *self.codes])
        ones = np.ones(len(codes) - len(self.known[0]), np.int64)
        codes, counts = _summed(codes, np.concatenate([self.known[1], ones]))
        self.codes, self.waiting = [], 0
        if self.open_prefixes is not None and len(codes):
            prefixes, back = np.unique(codes >> WORD_BITS, return_inverse=True)
            texts = self._phrases(prefixes, self.size - 1).to_pylist()
            kept = _members(self.open_prefixes, texts, self.lang.encode())[back]
            codes, counts = codes[kept], counts[kept]
        self.known = codes, counts

    def _phrases(self, codes: np.ndarray, size: int) -> pa.Array:
        words = pa.array(list(self.numbers), pa.binary())
        mask = (1 << WORD_BITS) - 1
        parts = [words.take(pa.array(codes >> (WORD_BITS * (size - 1 - i)) & mask)) for i in range(size)]
        return parts[0] if size == 1 else pc.binary_join_element_wise(*parts, b" ")

    def flush(self) -> Iterator[pa.RecordBatch]:
        self._count()
        codes, counts = self.known
        if self.size == 1 and self.total:  # the empty phrase carries the number of words
            yield _rows(self.lang, pa.array([b""]), np.array([self.total]))
        for at in range(0, len(codes), 1 << 16):
            part = codes[at : at + (1 << 16)]
            yield _rows(self.lang, self._phrases(part, self.size), counts[at : at + (1 << 16)])
        self._clear()


MOST_WORDS = 1 << (WORD_BITS - 2)


def _rows(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    langs = pa.array([lang]).take(pa.array(np.zeros(len(counts), np.int32)))
    return pa.RecordBatch.from_arrays(
        [langs, phrases.cast(pa.string()), pa.array(counts.astype(np.int64))], names=["lang", "phrase", "a"]
    )


def _segments(text: bytes) -> Iterator[bytes]:
    """Parts of a text of about SEGMENT bytes that end at a gap (a longer word stays whole)."""
    start = 0
    while len(text) - start > SEGMENT:
        gap = _GAP.search(text, start + SEGMENT)
        if gap is None:
            break
        yield text[start : gap.end()]
        start = gap.end()
    yield text[start:]


def _slices(text: bytes, size: int) -> Iterator[tuple[list[bytes], int]]:
    """Lists of words with the number of leading words that were in the list before."""
    carried: list[bytes] = []
    for segment in _segments(text.translate(_TABLE)):
        words = segment.replace(b".", b" . ").split()
        for at in range(0, len(words), MOST_WORDS - size):
            part = carried + words[at : at + MOST_WORDS - size]
            yield part, len(carried)
            carried = part[len(part) - size + 1 :] if size > 1 else []


def count_phrases(
    docs: DataFrame, size: int, frequent: np.ndarray | None = None, prefixes: np.ndarray | None = None
) -> DataFrame:
    """(lang, phrase, a): all occurrences of phrases of `size` words inside pieces.

    With size 1 the empty phrase has the number of all words. With bitmaps, phrases whose words are not all in
    `frequent`, or whose words but the last are not in `prefixes`, are left out (up to false hits).
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((frequent, prefixes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, _Tally] = {}
        for batch in batches:
            for group in groups_of([batch], "text", SEGMENT):
                texts: dict[str, list[bytes]] = defaultdict(list)
                for lang, text in zip(group.column("lang").to_pylist(), group.column("text").to_pylist()):
                    texts[lang].append(text)
                for lang, own in texts.items():
                    tally = tallies.get(lang) or tallies.setdefault(lang, _Tally(lang, size, *shared.value))
                    for words, old in _slices(b".".join(own), size):
                        yield from tally.add(words, old)
            if len(tallies) > 64 and sum(len(t.numbers) + t.waiting + len(t.known[0]) for t in tallies.values()) > HELD_CODES:
                for tally in tallies.values():
                    yield from tally.flush()
                tallies.clear()
        for tally in tallies.values():
            yield from tally.flush()

    rows = as_bytes(docs.withColumn("lang", F.coalesce(F.col("lang"), F.lit("und"))), "text", "lang")
    counted = rows.mapInArrow(run, "lang string, phrase string, a bigint")
    return counted.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def score(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a^2 / (left * right)) in 38 digits."""
    a, left, right = (f"CAST({c} AS DECIMAL(15, 0))" for c in (a, left, right))
    return F.expr(f"CAST({SCALE} AS DECIMAL(7, 0)) * {a} * {a} div ({left} * {right})")


def _nodes(docs: DataFrame, words: DataFrame, frequent: np.ndarray, least: int) -> DataFrame:
    """Phrases of two words with their counts, their score and the bound of all that start with them."""
    split = F.split("phrase", " ")
    pairs = count_phrases(docs, 2, frequent).filter(F.col("a") >= least)
    pairs = pairs.withColumns({"first": key_of(split[0], F.col("lang")), "second": key_of(split[1], F.col("lang"))})
    pairs = staged(pairs, "pairs")
    on = pairs.groupBy(F.col("first").alias("word")).agg(F.max("a").alias("best"))
    known = staged(words.join(on, "word", "left"), "known-words")
    left = known.select(F.col("word").alias("first"), F.col("f").alias("l"))
    right = known.select(F.col("word").alias("second"), F.col("f").alias("r"), "best")
    begun = staged(hot_key_join(pairs, left, "first"), "begun")
    most = F.least("a", F.coalesce("best", F.lit(0)))
    bound = F.when(most >= least, F.expr(f"CAST({SCALE} AS DECIMAL(7, 0)) * CAST(least(a, best) AS DECIMAL(15, 0)) div l"))
    return staged(
        hot_key_join(begun, right, "second")
        .withColumn("score", score("a", "l", "r"))
        .withColumn("bound", F.coalesce(bound, F.lit(-1)))
        .select("lang", "phrase", "first", "second", "a", "l", "r", "score", "bound"),
        "nodes",
    )


def _thresholds(nodes: DataFrame, langs: DataFrame, width: int) -> DataFrame:
    """(lang, theta): the largest score that `width` nodes of the language reach by score or bound, else 0.

    A language has at most SCALE + 1 scores, so its histogram is bounded.
    """
    reach = F.greatest("score", "bound").alias("theta")
    histogram = nodes.join(langs.select("lang"), "lang").groupBy("lang", reach).agg(F.count(F.lit(1)).alias("n"))
    above = F.expr("sum(n) over (partition by lang order by theta desc)")
    reached = histogram.withColumn("above", above).filter(F.col("above") >= width)
    cut = reached.groupBy("lang").agg(F.max("theta").alias("theta"))
    return langs.select("lang").join(cut, "lang", "left").select("lang", F.coalesce("theta", F.lit(0)).alias("theta"))


def _frontier(nodes: DataFrame, thetas: DataFrame) -> DataFrame:
    """Nodes to expand: bounds from the threshold up, candidates from it up, and what may hold these on the left."""
    tagged = nodes.join(thetas, "lang")
    needs = tagged.filter("score >= theta").groupBy(F.col("first").alias("second")).agg(F.min("a").alias("need"))
    return (
        hot_key_join(staged(tagged, "tagged"), needs, "second", "left")
        .filter("bound >= 0 and (greatest(score, bound) >= theta or 2 * a >= need)")
        .select("lang", "phrase", "a", "l")
    )


def _continuations(docs: DataFrame, nodes: DataFrame, fresh: DataFrame, frequent: np.ndarray, least: int) -> DataFrame:
    """The phrases of three words that start with a fresh node, with their lowest-scoring cut."""
    keys = fresh.select(key_of(F.col("phrase"), F.col("lang")).alias("key"))
    found = count_phrases(docs, 3, frequent, bitmap(keys, "key")).filter(F.col("a") >= least)
    w = F.split("phrase", " ")
    found = found.withColumns({"prefix": F.concat_ws(" ", w[0], w[1]), "suffix": F.concat_ws(" ", w[1], w[2])})
    starts = fresh.select("lang", F.col("phrase").alias("prefix"), F.col("a").alias("l2"), F.col("l").alias("l1"))
    ends = nodes.select("lang", F.col("phrase").alias("suffix"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    cut = found.join(starts, ["lang", "prefix"]).join(ends, ["lang", "suffix"])
    cut = cut.withColumns({"s1": score("a", "l1", "r1"), "s2": score("a", "l2", "r2")})
    early = F.col("s1") <= F.col("s2")
    return cut.select(
        "lang", "phrase", "prefix", "suffix", "a",
        F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )


def collocations(docs: DataFrame, top: int = 2000, least: int = 10, width: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two and three words.

    `docs` has lang and text. A phrase occurs `least` times or more; its score is that of its lowest cut into
    parts that occur l and r times; a phrase inside a longer one that occurs half as often or more is left out.
    `width` is the number of nodes expanded first (4 * top by default); it steers the work, not the result.
    """
    docs = docs.select("lang", "text")
    counted = staged(count_phrases(docs, 1).filter(f"phrase = '' or a >= {least}"), "words")
    totals = counted.filter("phrase = ''").select("lang", F.col("a").alias("n"))
    words = counted.filter("phrase <> ''").select(key_of(F.col("phrase"), F.col("lang")).alias("word"), F.col("a").alias("f"))
    frequent = bitmap(words, "word")
    nodes = _nodes(docs, words, frequent, least)

    open_langs = nodes.select("lang").distinct()
    done, expanded, longer = [], None, None
    width = width or 4 * top
    while True:
        thetas = staged(_thresholds(nodes, open_langs, width), "thetas")
        front = staged(_frontier(nodes, thetas), "frontier")
        fresh = front if expanded is None else front.join(expanded, ["lang", "phrase"], "left_anti")
        fresh = staged(fresh, "fresh")
        more = staged(_continuations(docs, nodes, fresh, frequent, least), "continuations")
        longer = more if longer is None else longer.unionByName(more)
        expanded = front if expanded is None else expanded.unionByName(fresh).select("lang", "phrase", "a", "l")
        held = longer.select("lang", F.explode(F.array("prefix", "suffix")).alias("phrase"), F.col("a").alias("most"))
        held = held.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
        kept = ["lang", "phrase", "a", "l", "r", "score"]
        short = nodes.join(held, ["lang", "phrase"], "left").filter("most is null or 2 * most < a").select(*kept)
        best = short.unionByName(longer.select(*kept)).join(thetas, "lang").filter("score >= theta")
        best = staged(best, "survivors")
        enough = best.groupBy("lang").agg(F.count(F.lit(1)).alias("found"))
        state = thetas.join(enough, "lang", "left").withColumn("settled", F.expr("theta = 0 or coalesce(found, 0) >= " + str(top)))
        state = staged(state.select("lang", "settled"), "state")
        done.append(best.join(state.filter("settled"), "lang", "left_semi").select(*kept))
        open_langs = state.filter("not settled").select("lang")
        if open_langs.isEmpty():
            break
        width *= GROWTH
    rows = done[0]
    for part in done[1:]:
        rows = rows.unionByName(part)
    ranked = top_k(rows, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
