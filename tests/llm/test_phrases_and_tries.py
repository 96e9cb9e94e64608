"""Collocations and the conversation trie against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.test_documents import hostile
from trolley.llm import collocations, trie

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_collocations(docs, top, least):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in found.items()):
                continue
            cuts = [(10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), a, counts[p[:k]], counts[p[k:]]))
        for rank, (s, _, phrase, a, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, n[lang], -s))
    return sorted(out)


def some_docs():
    rng = random.Random(5)
    words = "a b c d e f G h ä 日 x-y no".split()
    docs = []
    for i in range(120):
        parts = [rng.choice(words) + rng.choice(["", "", "", ".", ", ", "\n", "\t"]) for _ in range(rng.randint(0, 60))]
        docs.append((rng.choice(["en", "fr", None]), " ".join(parts)))
    docs += [("en", "rare pair of words")] * 12 + [("en", None), ("fr", ""), ("de", "too few"), ("x", " .. ! \n")]
    docs += [("long", "p q r " * 3000)]
    return docs


@pytest.mark.parametrize("top, least, width", [(2000, 10, None), (3, 2, 1), (7, 3, 2)])
def test_collocations_are_those_of_all_phrases(spark, top, least, width):
    docs = some_docs()
    df = spark.createDataFrame(docs, "lang string, text string").selectExpr("*", "1 AS phrase", "2 AS rank", "3 AS a")
    got = collocations.collocations(df.repartition(5), top, least, width)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(docs, top, least)


def test_collocations_of_hostile_and_empty_tables(spark):
    rows = [(r.lang, r.text) for r in hostile(spark).collect()]
    got = collocations.collocations(hostile(spark))
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 2000, 10)
    assert collocations.collocations(hostile(spark).limit(0)).collect() == []


def test_segments_carry_words_over(monkeypatch):
    monkeypatch.setattr(collocations, "SEGMENT", 7)
    monkeypatch.setattr(collocations, "MOST_WORDS", 5)
    text = b"one two, three four five six seven. eight nine ten eleven twelve " * 3 + b"averyverylongword end"
    whole = text.translate(collocations._TABLE).replace(b".", b" . ").split()
    for size in (1, 2, 3):
        want = Counter(
            p for p in (tuple(whole[i : i + size]) for i in range(len(whole) - size + 1)) if b"." not in p
        )
        tally = collocations._Tally("en", size, None, None)
        for words, old in collocations._slices(text, size):
            list(tally.add(words, old))
        got = Counter()
        for batch in tally.flush():
            for phrase, a in zip(batch.column("phrase").to_pylist(), batch.column("a").to_pylist()):
                got[tuple(phrase.encode().split())] += a
        total = got.pop((), None)
        assert got == want and total == (sum(want.values()) if size == 1 else None)


# --- conversations


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(own)] for c, own in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    members = defaultdict(set)
    for c, own in built.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].add(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []

    def sums(p):
        mine = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below = [sums(q) for q in kids[p]]
        leaves, saved = (sum(b[0] for b in below) or 1), mine + sum(b[1] for b in below)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), up, len(members[p]), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if built:
        sums(())
    return Counter(out)


def conversations():
    rng = random.Random(11)
    rows = []
    for c in range(150):
        if c % 10 == 5 and c > 50:
            continue  # no common start
        for turn in range(rng.randint(1, 12)):
            text = rng.choice(["hello", "yes", "no", "ä" * turn, f"own {c}"]) if c % 3 else f"same {turn}"
            rows.append((c, turn, ("user", "assistant")[turn % 2], text))
    rows += [(700, t, "user", f"very long {t % 7}") for t in range(300)]  # one conversation of many turns
    rows += [(c, 0, "user", "shared by many") for c in range(1000, 1400)]  # copies
    rows += [(2000, None, None, None), (2000, None, "user", "first"), (2000, 3, "b", "tie"), (2000, 3, "a", "tie")]
    rows += [(2000, 3, "a", "tie"), (None, 1, "user", "no conversation"), (-7, 0, "user", "negative"), (-5, 0, None, "x")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("light, fan", [(trie.LIGHT, trie.FAN), (20, 4), (5, 2)])
def test_trie_is_that_of_plain_prefixes(spark, monkeypatch, light, fan):
    monkeypatch.setattr(trie, "LIGHT", light)
    monkeypatch.setattr(trie, "FAN", fan)
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS hi", "1 AS d", "2 AS n_turns", "3 AS node").repartition(6)
    turns = trie.digested(df).cache()
    got = trie.prefix_trie(*trie.rebuilt(turns)).drop("hi", "lo")
    # Python's % rounds down, SQL's towards zero: negative ids start at the next multiple above
    want_rows = [(r[0], *r[1:]) for r in rows if r[0] is None or r[0] >= 0]
    if light == trie.LIGHT:
        only = spark.createDataFrame(want_rows, SCHEMA)
        plain = trie.prefix_trie(*trie.rebuilt(trie.digested(only).cache())).drop("hi", "lo")
        assert Counter(map(tuple, plain.collect())) == plain_trie(want_rows)
        assert got.filter("depth = 0").first().conv_id == -7
    else:
        only = turns.filter("conv_id >= 0")
        assert Counter(map(tuple, trie.prefix_trie(*trie.rebuilt(only)).drop("hi", "lo").collect())) == plain_trie(want_rows)


def test_trie_of_an_empty_table(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = trie.conversation_trie(spark.createDataFrame([(3, None, None, None)], SCHEMA))
    assert [(r.depth, r.n_convs, r.n_leaves) for r in alone.orderBy("depth").collect()] == [(0, 1, 1), (1, 1, 1)]


def test_slots_are_gapless_and_checked():
    rng = np.random.default_rng(3)
    hi, lo = (rng.integers(0, 1 << 62, 5000).astype(np.uint64) for _ in range(2))
    table = trie.Slots.of(hi, lo)
    assert sorted(table.find(hi, lo)) == list(range(5000))
    assert (table.find(lo, hi) == -1).all()
    assert (trie.Slots.of(hi[:0], lo[:0]).find(hi, lo) == -1).all()
    with pytest.raises(ValueError):
        trie.Slots.of(hi[[0, 0]], lo[[0, 0]])
