"""Sharding, near-duplicates, decontamination, repeats and scores against brute force, with hostile rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from trolley.llm import decontaminate, maxent, sharding, simhash, suffixes
from trolley.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string, slot int"
#: null texts and ids, empty and blank texts, repeated rows, a repeated id with another text, clashing column names
HOSTILE = [
    (None, "one two three four five six", "en", "s", 1, "x", 1),
    (1, None, None, None, None, None, None),
    (2, "", "en", "s", 0, "x", 1),
    (3, " \t\n ", "en", "s", 4, "x", 1),
    (4, "a b c d e f g h", "fr", "s", 4, "x", 1),
    (4, "a b c d e f g h", "fr", "s", 4, "x", 1),
    (4, "another text under the same id", "fr", "s", 4, "x", 1),
    (5, "A B C D E F G H", "fr", "s", 4, "x", 1),
    (6, "É ß ▁ 日本 \x00 word", "de", "s", 4, "x", 1),
    (7, "long " * 30_000, "de", "s", 4, "x", 1),
]


def hostile(spark):
    return spark.createDataFrame(HOSTILE, SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


# --- sharding


def test_shards_follow_the_tree(spark):
    got = sharding.shard_documents(hostile(spark)).collect()
    assert len(got) == len(HOSTILE)

    def place(tree, key):
        def pick(level, children):
            def clock(c):
                h = int(hashlib.md5(f"tree{level}|{key}|{c[0]}".encode()).hexdigest()[:15], 16)
                return -math.log((h + 0.5) / 2**60) / c[1]

            return min(children, key=clock)[0]

        kids = sharding._children(tree)
        return pick("k", kids[f"k{pick('r', kids[f'r{pick('', kids[''])}'])}"])

    for r in got:
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert r.shard == place(sharding.topology(8), key)
        assert r.grown_shard == place(sharding.topology(8, added=1), key)
        assert r.law == "key"
    sizes = Counter((r.doc_id, r["size"], r.text_crc32) for r in got)
    assert sizes == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in HOSTILE
    )
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_growth_moves_rows_only_into_the_new_shard(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "string(id) AS text")
    got = sharding.shard_documents(docs).toPandas()
    moved = got[got.shard != got.grown_shard]
    assert set(moved.grown_shard) == {8}
    assert 300 < len(moved) < 600  # a ninth of 4,000 is 444
    assert got.shard.value_counts().between(400, 600).all()


def test_slots_in_many_ranges(spark):
    rows = spark.range(500).selectExpr("id * 7 % 500 AS doc_id", "int(id % 3) AS shard")
    got = sharding.slots(rows, "shard", [rows.doc_id], rows_per_range=20).collect()
    for s in range(3):
        own = sorted((r.doc_id, r.slot) for r in got if r.shard == s)
        assert [x[1] for x in own] == list(range(len(own)))


def test_weights_are_followed(spark):
    tree = [sharding.Shard(0, 0, 0, 1.0), sharding.Shard(0, 0, 1, 3.0), sharding.Shard(1, 1, 2, 4.0)]
    docs = spark.range(8000).selectExpr("string(id) AS k")
    got = docs.select(sharding.place(tree, docs.k).alias("s")).groupBy("s").count().toPandas().set_index("s")["count"]
    assert abs(got[0] - 1000) < 150 and abs(got[1] - 3000) < 200 and abs(got[2] - 4000) < 200


def test_no_documents(spark):
    none = hostile(spark).limit(0)
    assert sharding.shard_documents(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert suffixes.remove_repeats(none).count() == 0
    assert maxent.score(none).count() == 0


# --- SimHash


def fingerprint(text, width, seed=42):
    w = words(text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), seed) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(rows, radius, width):
    prints = [fingerprint(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints)))


def variants(n):
    draw = random.Random(5)
    base = [f"w{draw.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(n):
        own = list(base) if i % 3 else [f"v{draw.randrange(400)}" for _ in range(60)]
        for _ in range(draw.randrange(4)):
            own[draw.randrange(len(own))] = "changed"
        rows.append((i + 10, " ".join(own)))
    return rows


@pytest.mark.parametrize("most", [4, 4096])
def test_simhash_classes(spark, monkeypatch, most):
    rows = [(d, t) for d, t, *_ in HOSTILE] + variants(120)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes, radius, keys: whole(nodes, radius, keys, most))
    got = Counter(map(tuple, simhash.near_duplicates(docs).collect()))
    assert got == classes(rows, 4, 4)


def test_bit_planes_find_every_link():
    draw = np.random.default_rng(2)
    for parts, radius in ((1, 3), (1, 4), (2, 25)):
        centres = draw.integers(0, 2**64, (30, parts), dtype=np.uint64)
        prints = centres[draw.integers(0, 30, 700)]
        for _ in range(radius // 2 + 1):
            flip = np.uint64(1) << draw.integers(0, 64, prints.shape, dtype=np.uint64)
            prints = prints ^ np.where(draw.random(prints.shape) < 0.5, flip, np.uint64(0))
        cell = np.sort(draw.integers(0, 3, 700))
        label = simhash.close_pairs(cell, prints, radius)
        distance = np.bitwise_count(prints[:, None] ^ prints[None]).sum(-1)
        linked = (distance <= radius) & (cell[:, None] == cell[None])
        want = np.arange(700)
        while True:
            low = np.where(linked, want[None], 700).min(1)
            if (low == want).all():
                break
            want = low
        assert (label == want).all()


def test_pigeonhole_keys_lose_no_pair():
    keys = simhash.pigeonhole(64, 4, 6)
    draw = random.Random(1)
    for _ in range(500):
        flipped = set(draw.sample(range(64), 4))
        assert any(not flipped & set(k) for k in keys)


def test_components(spark):
    chain = [(f"{i:03}", f"{i + 1:03}") for i in range(0, 60)] + [("900", "901"), ("901", "901"), (None, "1")]
    star = [("500", f"{i}") for i in range(501, 540)]
    got = dict(components(spark.createDataFrame(chain + star, "u string, v string")).collect())
    assert got == {
        **{f"{i:03}": "000" for i in range(61)}, **{f"{i}": "500" for i in range(500, 540)}, "900": "900", "901": "900",
    }


def test_keep_first(spark):
    docs = hostile(spark)
    kept = simhash.keep_first(docs, simhash.near_duplicates(docs)).collect()
    ids = [r.doc_id for r in kept]
    # 1, 2 and 3 hold no words; 4 repeats itself; 5 differs from 4 in case only
    assert sorted(i for i in ids if i is not None) == [1, 4, 6, 7] and ids.count(None) == 1


# --- decontamination


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def passages(spark):
    draw = random.Random(9)

    def text(n):
        return " ".join("".join(draw.choice(["th", "er", "in", "on", "es"]) for _ in range(draw.randrange(1, 4))) for _ in range(n))

    items = [(i, text(draw.randrange(18, 60))) for i in range(8)] + [(90, "too short"), (91, None), (None, text(30))]
    docs, k = [], 0
    for i in range(21):
        body = text(40)
        if i % 3:
            item = items[draw.randrange(8)][1]
            worn = list(item)
            for _ in range(draw.choice([0, 0, 2, 5, 9, 14, 20])):
                at = draw.randrange(len(worn))
                worn[at] = draw.choice(["", "q", worn[at] + "z"])
            at = draw.randrange(len(body))
            body = body[:at] + " " + "".join(worn).upper() + " " + body[at:]
        docs.append((i, body))
    docs += [(d, t) for d, t, *_ in HOSTILE if d is not None and d > 0 and d < 1]
    return items, docs


def test_leaks_are_those_of_brute_force(spark):
    items, docs = passages(spark)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    index = decontaminate.Windows([(i, t.encode()) for i, t in items if i is not None and t])
    want = {}
    for d, t in docs:
        body = decontaminate.normalised(t.lower().encode())
        for item, window, budget in zip(index.item, index.text, index.budget):
            if (n := edits(window, body)) <= budget:
                was = want.get((d, item), (0, 99))
                want[d, item] = (was[0] + 1, min(was[1], n))
    for size in (decontaminate.BLOCK_BYTES, 300):  # one block, and several
        got = decontaminate.contaminated(table, bench, size).collect()
        assert {(r.doc_id, r.item_id): (r.n_windows, r.edits) for r in got} == want
    dropped = {d for d, _ in want}
    assert {r.doc_id for r in decontaminate.clean(table, bench).collect()} == {d for d, _ in docs} - dropped


def test_decontamination_of_hostile_rows(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None)], "item_id bigint, text string")
    assert decontaminate.contaminated(hostile(spark), bench).count() == 0
    assert decontaminate.clean(hostile(spark), bench).count() == len(HOSTILE)
    assert decontaminate.contaminated(hostile(spark), bench.limit(0)).count() == 0


# --- repeated strings


def repeats(rows, length):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    seen, out = set(), []
    for d, t in order:
        t = (t or "").encode()
        covered = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if t[p : p + length] in seen:
                covered[p : p + length] = True
            seen.add(t[p : p + length])
        runs = int((np.diff(np.r_[0, covered.astype(int)]) == 1).sum())
        rest = np.frombuffer(t, np.uint8)[~covered].tobytes()
        out.append((d, len(t), int(covered.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return Counter(out)


def mosaic():
    draw = random.Random(3)
    base = ["".join(draw.choice("abcdefgh é") for _ in range(300)) for _ in range(5)]
    rows = []
    for i in range(90):
        text = ""
        for _ in range(draw.randrange(5)):
            at = draw.randrange(250)
            text += draw.choice(base)[at : at + draw.randrange(20, 200)] if draw.random() < 0.7 else draw.choice("xyz") * draw.randrange(90)
        if i % 9 == 0:
            text += draw.choice(["a", "abc", "qwertzuiopasdfghjklyxcvbnm123456789"]) * draw.randrange(1, 50)
        rows.append((i, text))
    return rows + [(d, t[:3000] if t else t) for d, t, *_ in HOSTILE]


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 300, "part_bytes": 4000}])
def test_repeats_are_those_of_brute_force(spark, sizes):
    rows = mosaic()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for length, gram in ((40, 12), (100, 32)):
        removal = suffixes.Removal(length, gram, **sizes)
        got = Counter(map(tuple, suffixes.remove_repeats(docs, removal).collect()))
        assert got == repeats(rows, length)


def test_suffix_array_and_common_prefixes():
    draw = random.Random(4)
    for _ in range(150):
        x = np.array([draw.randrange(draw.choice([1, 2, 4]) + 1) for _ in range(draw.randrange(1, 200))], np.uint8)
        b = x.tobytes()
        sa, rank = suffixes.suffix_array(x)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        assert (rank[sa] == np.arange(len(b))).all()
        lcp = suffixes.common_prefixes(x, sa)
        for i in range(1, len(b)):
            p, q = b[sa[i - 1] :], b[sa[i] :]
            assert lcp[i] == next((k for k, (c, d) in enumerate(zip(p, q)) if c != d), min(len(p), len(q)))


# --- language-model scores


def test_base_scores_and_counts(spark):
    rows = [(d, t) for d, t, *_ in HOSTILE] + variants(60)
    got = maxent.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    counts = Counter()
    for d, t in rows:
        if not maxent.held_out(d):
            counts.update([*words(t), b"\n"])
    n, v = sum(counts.values()), len(counts)

    def expected(d, t):
        w = [*words(t), b"\n"]
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        return d, maxent.held_out(d), len(w), sum(counts[x] > 0 for x in w), n, round(base, 6)

    assert Counter((*tuple(r)[:5], round(r.base_score, 6)) for r in got) == Counter(expected(*r) for r in rows)
    assert all(r.score < 0 for r in got)


def test_class_shares_sum_to_one_and_learn():
    draw = np.random.default_rng(1)
    model = maxent.Model(
        draw.normal(size=maxent.CLASSES).astype(np.float32),
        draw.normal(size=(maxent.FEATURES * maxent.SLOTS, maxent.CLASSES)).astype(np.float32),
        np.zeros(maxent.CLASSES), np.zeros(maxent.CLASSES),
    )
    slots = np.stack([draw.integers(0, maxent.SLOTS, 50) + f * maxent.SLOTS for f in range(maxent.FEATURES)])
    assert np.allclose(model.shares(slots).sum(axis=1), 1, atol=1e-5)


def test_model_beats_counts_on_held_out_texts(spark):
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    got = maxent.score(spark.read.parquet(f"{folder}/documents.parquet")).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() + 0.1 * held.n_tokens.sum()


def test_histories_stop_at_documents():
    values = np.arange(1, 11)
    starts = np.array([0, 1, 4])
    assert maxent._behind(values, starts, 2, 0).tolist() == [0, 0, 0, 2, 0, 0, 5, 6, 7, 8]
    assert re  # keeps the import used by the fixtures of this file
