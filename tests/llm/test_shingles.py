"""Near copies by whole shingle sets against all pairs, with families near the threshold and hostile rows."""

import random

from tests.llm.test_documents import HOSTILE, hostile, words
from trolley.llm import shingles
from trolley.llm.quality import text_hash


def sets_of(rows, width):
    own = [words(t) for _, t in rows]
    return [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in own]


def groups(rows, width):
    """Row numbers by component, from all pairs."""
    sets, parent = sets_of(rows, width), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def families(n):
    """Groups of two to five texts whose similarity lies around the threshold, all with one common passage."""
    draw = random.Random(3)
    passage = [f"p{k}" for k in range(12)]
    rows = []
    for _ in range(n):
        base = [f"w{draw.randrange(10**6)}" for _ in range(draw.choice([20, 60, 120, 240]))] + passage
        for _ in range(draw.randrange(2, 6)):
            own = list(base)
            for _ in range(draw.randrange(1 + len(base) // 35)):
                own[draw.randrange(len(own))] = f"c{draw.randrange(10**6)}"
            rows.append((len(rows) + 10, " ".join(own)))
    return rows


def test_near_copies_are_those_of_all_pairs(spark):
    rows = [(d, t) for d, t, *_ in HOSTILE] + families(80)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(sorted((rows[i][0] or -1, words(rows[i][1])) for i in g) for g in groups(rows, 5))
    texts = {(r.doc_id, r.h): r.text for r in docs.withColumn("h", text_hash()).collect()}
    got = {}
    for r in shingles.near_copies(docs, 5).collect():
        got.setdefault(r.root, []).append((r.doc_id or -1, words(texts[r.doc_id, r._hash])))
    assert sorted(map(sorted, got.values())) == want


def test_prefixes_of_close_sets_meet():
    draw = random.Random(8)
    common, times = shingles.np.array([], shingles.np.uint64), shingles.np.array([], int)
    for n in range(1, 60):
        a = draw.sample(range(10**9), n)
        for k in range(n // 5 + 1):
            b = a[k:] + draw.sample(range(10**9, 2 * 10**9), draw.randrange(k + 1))
            if 5 * len(set(a) & set(b)) < 4 * len(set(a) | set(b)):
                continue
            some = shingles.np.unique(shingles.np.array(draw.sample(a, n // 2), shingles.np.uint64))
            for known, count in ((common, times), (some, shingles.np.arange(3, 3 + len(some)))):
                x, y = (shingles.prefix(shingles.np.unique(shingles.np.array(v, shingles.np.uint64)), known, count) for v in (a, b))
                assert set(x.tolist()) & set(y.tolist())


def test_one_row_of_a_class_stays(spark):
    docs = hostile(spark)
    more = spark.createDataFrame([(None, "One two three four five six", "en", "s", 1, "x", 1), (8, "ANOTHER text under the same id", "fr", "s", 4, "x", 1)], docs.schema)
    docs = docs.union(more)
    kept = shingles.keep_one(docs, shingles.near_copies(docs, 5)).collect()
    assert sorted((r.doc_id or -1, (r.text or "").lower()[:9]) for r in kept) == sorted(
        [(-1, "one two t"), (1, ""), (4, "a b c d e"), (4, "another t"), (6, "é ß ▁ 日本 "), (7, "long long")]
    )
    assert shingles.near_copies(docs.limit(0)).count() == 0


def test_stage_drops_only_verified_copies(spark):
    """The pipeline's stage on a small table against all pairs: no pair lost, none below the similarity linked."""
    import corpus_pipeline as cp

    docs = spark.createDataFrame([(d, t) for d, t in families(40)], "doc_id bigint, text string")
    rows = sorted(map(tuple, docs.collect()))
    got = sorted(r.doc_id for r in cp.one_of_each(spark, docs, "").collect())
    assert got == sorted(min(rows[i][0] for i in g) for g in groups(rows, 5))


def test_bit_sliced_radius_is_exact_and_loses_no_similar_sets():
    np = shingles.np
    rng = np.random.default_rng(5)
    for n in (1, 63, 64, 200):
        differ = np.packbits(rng.random((n, 512)) < rng.random((n, 1)), axis=1)
        radius = rng.integers(0, 700, n)
        want = np.unpackbits(differ, axis=1).sum(axis=1) <= radius
        assert (shingles.within(differ, radius) == want).all()
    for size in (1, 4, 5, 30, 400):
        base = rng.integers(0, 2**64, 2 * size, np.uint64)
        for common in range(size + 1):
            a, b = np.unique(base[:size]), np.unique(base[size - common : 2 * size - common])
            overlap = len(np.intersect1d(a, b))
            if 5 * overlap >= 4 * (len(a) + len(b) - overlap):
                assert shingles.close([shingles.fingerprint(a)], [shingles.fingerprint(b)], np.array([len(a) + len(b)])).all()
    far = [shingles.fingerprint(np.unique(rng.integers(0, 2**64, 900, np.uint64))) for _ in range(40)]
    assert not shingles.close(far[:20], far[20:], np.full(20, 1800)).any()


def test_prints_of_neighbouring_sizes_are_folded():
    np = shingles.np
    draw = np.random.default_rng(6)
    base = draw.integers(0, 2**64, 140, np.uint64)
    a, b = np.unique(base[:120]), np.unique(base[:140])
    x, y = shingles.fingerprint(a), shingles.fingerprint(b)
    assert len(x) != len(y) and shingles.close([x], [y], np.array([260])).all()


def test_cells_give_all_similar_pairs_and_hot_keys_are_cut():
    np = shingles.np
    draw = random.Random(9)
    sets, none = [], (np.array([], np.uint64), np.array([], int))
    for _ in range(30):
        base = draw.sample(range(2**60), 60)
        sets += [np.unique(np.array(base[k:] + draw.sample(range(2**60), k), np.uint64)) for k in (0, 3, 6, 9)]
    meet = sorted((int(k), i, p) for i, s in enumerate(sets) for p, k in enumerate(shingles.prefix(s, *none).tolist()))
    cell, node = np.array([m[0] for m in meet], np.uint64), np.array([m[1] for m in meet])
    rows = np.column_stack([[len(sets[i]) for i in node], [m[2] for m in meet], node])
    shorts = np.stack([np.frombuffer(shingles.fingerprint(s, shingles.SHORT_BITS), np.uint8) for s in sets])
    a, b = shingles.near_in_cells(cell, rows, shorts[node])
    got = {tuple(sorted(p)) for p in zip(node[a].tolist(), node[b].tolist())}
    want = {
        (i, j) for j in range(len(sets)) for i in range(j)
        if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))
    }
    assert want <= got and len(want) > 40


def test_one_family_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(shingles, "MOST_IN_CELL", 6)
    monkeypatch.setattr(shingles, "STARS", 1)
    rows = families(25)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {}
    for r in shingles.near_copies(docs, 5).collect():
        got.setdefault(r.root, []).append(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(sorted(rows[i][0] for i in g) for g in groups(rows, 5))
