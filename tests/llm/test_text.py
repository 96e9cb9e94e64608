"""Quality, rules, secrets, pieces and archives, with hostile rows; the pipeline against a brute-force version."""

import base64
import hashlib
import math
import os
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import regex
import sentencepiece
import zstandard
from pyspark.sql import functions as F

from tests.llm.test_documents import HOSTILE, hostile
from trolley.llm import pieces, quality, rules, secrets, warc
from trolley.sources.scratch import staged

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
LABELS = "doc_id bigint, quality int, toxic int"


def table(spark, name, folder=FOLDER):
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- quality


@needs_tables
def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = table(spark, "labels", folder)
    got = quality.rank(table(spark, "documents", folder), labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_quality_of_hostile_rows(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, None, 0), (None, 0, 0), (99, 1, 0)], LABELS)
    for known in (labels, labels.filter("quality = 1"), labels.limit(0)):
        got = quality.rank(hostile(spark), known).collect()
        assert len(got) == len(HOSTILE) and all(0 <= r.score <= 1 for r in got)
        kept = quality.keep_good(hostile(spark), known)
        assert kept.columns == hostile(spark).columns and kept.count() <= len(HOSTILE)
    assert quality.rank(hostile(spark).limit(0), labels).count() == 0


def test_held_out_labels_do_not_matter(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (1 + i % 7) + "!" * (i % 5)) for i in range(80)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 5 < 3), 0) for i in range(80)], LABELS)
    held = quality.held_out(F.col("doc_id"))
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.rank(docs, x).orderBy("doc_id").collect() for x in (labels, turned))
    assert one == two


def test_score_at_the_quantile(spark):
    draw = np.random.default_rng(3)
    labels = (draw.random(300) < 0.8).astype(int)
    rows = draw.normal(size=(300, len(quality.FEATURES))) + labels[:, None]
    model = quality.fit(rows, labels)
    assert ((model.strengths(rows) >= model.threshold) == (labels == 1)).mean() > 0.95
    columns = [F.lit(float(v)).alias(n) for v, n in zip(rows[0], quality.FEATURES)]
    got = spark.range(1).select(*columns).select(model.score()).first()[0]
    shift = model.strengths(rows[:1])[0] - model.threshold + math.log(0.7 / 0.3)
    assert got == pytest.approx(1 / (1 + math.exp(-shift)))


# --- rules


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if triples[tuple(w[i : i + 3])] > 1}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    counts = len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)
    return *counts, failed


def divergence(text, lang, known):
    """(char distance, word distance) in plain Python."""
    left, sizes = text, []
    for p in rules.CLASSES:
        rest = re.sub(p, "", left)
        sizes.append(len(left) - len(rest))
        left = rest
    sizes.append(len(left))
    w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
    common = [w.count(x) for x in rules.WORDS]
    common.append(len(w) - sum(common))

    def distance(counts, q):
        if not sum(counts):
            return 1.0
        p = np.array(counts) / sum(counts)
        q = np.array(q)
        m = (p + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = [np.where(a > 0, a * np.log2(a / m), 0).sum() for a in (p, q)]
        return math.sqrt(max(0.0, sum(terms) / 2))

    own = known.get(lang, {})
    return tuple(
        None if own.get(c) is None else distance(counts, own[c]) for c, counts in (("chars", sizes), ("common", common))
    )


@needs_tables
def test_rules_are_those_of_brute_force(spark):
    rng = random.Random(5)
    kinds = ["абвгдежзиклмнопрст", "etaoinshrdlu", "#$%&*"]  # unlisted, unlabelled and junk texts
    extra = [
        (10**6 + i, " ".join("".join(rng.choices(kinds[i % 3], k=5)) for _ in range(210)), ["ru", None, "ru"][i % 3], "s", 0)
        for i in range(30)
    ]
    docs = table(spark, "documents").union(
        spark.createDataFrame(extra + [r[:5] for r in HOSTILE], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    )
    references = rules.references(staged(rules.statistics(docs))).collect()
    known = {r.lang: {"chars": r.chars_shares, "common": r.common_shares} for r in references}
    got = rules.judge(docs).collect()
    want = []
    for r in docs.collect():
        counts = base(r.text)
        chars, common = divergence(r.text or "", r.lang, known)
        strange = (counts[1] >= rules.LEAST_CHARS and (chars or 0) > rules.MOST_CHAR_DISTANCE) or (
            counts[0] >= rules.LEAST_COMMON_WORDS and (common or 0) > rules.MOST_WORD_DISTANCE
        )
        distances = [None if d is None else round(d, 6) for d in (chars, common)]
        want.append((r.doc_id, *counts, *distances, not counts[-1] and not strange))
    assert Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
         *(None if d is None else round(d, 6) for d in (r.char_distance, r.word_distance)), r.kept) for r in got
    ) == Counter(want)


def test_languages_without_a_word_list(spark):
    rng = random.Random(6)

    def text(letters):
        return " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(200))

    rows = [(i, text("абвгдежзиклмнопрст"), "ru") for i in range(20)] + [(99, text("#$%&*<>|"), "ru"), (100, text("#$%&"), None)]
    docs = table(spark, "documents").select("doc_id", "text", "lang").filter("lang <> 'ru'")
    got = {r.doc_id: r for r in rules.judge(docs.union(spark.createDataFrame(rows, docs.schema).withColumn("doc_id", F.col("doc_id") + 10**6))).collect()}
    assert all(got[10**6 + i].kept and got[10**6 + i].word_distance is None for i in range(20))
    assert not got[10**6 + 99].kept and got[10**6 + 99].char_distance > rules.MOST_CHAR_DISTANCE
    assert got[10**6 + 100].kept and got[10**6 + 100].char_distance is None


def test_many_repeated_triples(spark):
    text = " ".join(f"w{i % 301}" for i in range(1500)) + " tail " + " ".join(f"x{i}" for i in range(40))
    got = rules.statistics(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert got.n_repeat_words == base(text)[4] == 1500


def test_rules_without_documents(spark):
    assert rules.judge(hostile(spark).limit(0)).count() == 0


# --- secrets


def test_secrets_are_found_and_masked(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [
        (1, f'start token = "{key}" end'),
        (2, f'{key[::-1]} is the commit, card number 4785380592391139 of the order'),
        (3, "plain words only"),
        (4, f'api_key: {key}\nsecret="{key[::-1]}"'),
        (5, "https://www.site.org/articles/2024/03/the-information-page"),
        (6, f'start token = "{key}" end'),
        (6, f'start token = "{key}" end'),
    ]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows] + [(None, None, None), (7, "", 0)], "doc_id bigint, text string, n_chars int")
    got = {(r.doc_id, r.n): r.secret for r in secrets.scan(docs).collect()}
    assert got[1, 0] and got[4, 0] and got[4, 1] and got[6, 0]
    assert not got[2, 0] and not got[2, 1] and not got[5, 0]
    assert {d for d, _ in got} == {1, 2, 4, 5, 6}
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.dtypes == docs.dtypes
    texts = {r.doc_id: r for r in clean.collect()}
    assert texts[1].text == 'start token = "[secret]" end' and texts[1].n_chars == len(texts[1].text)
    assert texts[4].text == 'api_key: [secret]\nsecret="[secret]"'
    assert texts[2].text == rows[1][1] and texts[3].text == rows[2][1] and texts[7].text == ""
    assert clean.filter("doc_id = 6").count() == 2 and texts[6].text == texts[1].text and texts[5].text == rows[4][1]
    assert clean.filter("doc_id IS NULL").first().text is None


def test_pieces_of_a_text_rebuild_it(spark):
    texts = ["", "a" * 15 + "1", "a" * 16 + "1", "1" * 40, f"{'a1' * 10} {'b2' * 10}", f"x{'=' * 3}{'c3' * 9}=={'d4' * 9}", "é" + "z9" * 20 + "é"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for r in docs.select("text", secrets.pieces(F.col("text")).alias("p")).collect():
        assert len(r.p.gaps) == len(r.p.found) + 1
        assert "".join(g + f for g, f in zip(r.p.gaps, [*r.p.found, ""])) == r.text
        assert r.p.found == regex.findall(secrets.CANDIDATE, r.text)


def test_secrets_of_hostile_rows(spark):
    assert secrets.scan(hostile(spark)).count() == 0
    assert secrets.redact(hostile(spark)).count() == len(HOSTILE)
    assert secrets.scan(hostile(spark).limit(0)).count() == 0


def test_labelled_findings_are_learned(spark):
    rows = [(a, b, c, float(d)) for a, b, c, d in secrets.LABELLED]
    known = spark.createDataFrame(rows, "left string, found string, right string, label double")
    vote = secrets.train(known)
    f = secrets.described(F.col("left"), F.col("found"), F.col("right"))
    got = known.withColumn("f", f).select("label", vote(F.col("f")).alias("p")).collect()
    assert sum((r.p >= 0.5) == (r.label == 1) for r in got) >= len(rows) - 1


# --- SentencePiece


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces()


ODD = [
    "", " ", "  hello   world ", "a\nb\tc\r\n", "日本語 ok 🤗", "é é ﬁ ½ ①", "\x00a", "<s> </s> <unk> <0x41>",
    " " * 100 + "x", "a" * 300, "hellohellohello   \n\n  x", " x y", "x" * 5000 + "y",
]


@needs_tables
def test_ids_of_the_library(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ODD + [r.text for r in table(spark, "documents").select("text").collect()]
    for text, ids in zip(texts, model.encode(texts)):
        assert ids.tolist() == library.encode(text)
        assert model.decode(ids.tolist()) == text


def test_round_trip_of_hostile_rows(spark, model):
    back = pieces.decode(pieces.encode(hostile(spark), model), model).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((d, t or "") for d, t, *_ in HOSTILE)
    both = pieces.encode(hostile(spark), model, decoded=True).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in both) == Counter((r.doc_id, tuple(r.ids), r.text) for r in back)
    assert pieces.decode(pieces.encode(hostile(spark).limit(0), model), model).count() == 0


def test_memory_is_linear_in_a_word(model):
    """Texts without spaces are single words; a prefix must not hold its whole path."""
    rng = random.Random(9)
    word = "".join(rng.choice("abcdefghijklmnop日本語/+") for _ in range(1_000_000))
    tracemalloc.start()
    ids = model.encode([word])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20 and model.decode(ids.tolist()) == word
    uni = pieces.Pieces(kind="unigram")
    assert uni.decode(uni.encode([word[:30_000]])[0].tolist()) == word[:30_000]


def test_best_path_of_a_unigram_model(model):
    uni = pieces.Pieces(kind="unigram")

    def best(word):
        sums = [(0.0, ())]
        for end in range(1, len(word) + 1):
            options = []
            for start in range(end):
                piece = word[start:end]
                if piece in uni.rank or end - start == 1:
                    ids = (uni.id_of[piece],) if piece in uni.id_of else uni._spelled(piece)
                    options.append((sums[start][0] + uni.rank.get(piece, uni.unknown), sums[start][1] + ids))
            sums.append(max(options, key=lambda o: o[0]))
        return sums[-1]

    words = [" the", " then", " therefore", "there", " xyzzy", " 日本", "ing"]
    got = uni.encoded(words)
    for w in words:
        assert sum(uni.rank.get(uni.bytes_of[i].decode("utf-8", "replace"), 0) for i in got[w]) == pytest.approx(
            sum(uni.rank.get(uni.bytes_of[i].decode("utf-8", "replace"), 0) for i in best(w)[1])
        )


# --- WARC


PAGES = "page_id bigint, url string, html string, payload string, first int"


def test_archives_give_pages_back(spark, tmp_path):
    rows = [
        (1, "http://a/ b", "<html>x</html>", "p", 1), (2, None, "<html>x</html>", "p", 1), (3, "http://c", None, "p", 1),
        (4, "http://d", "", "p", 1), (5, "http://e", "é" * 100_000, "p", 1), (5, "http://e", "é" * 100_000, "p", 1),
        (None, "http://f", "alone", "p", 1), (7, "http://g", "P*M\x18\x00\x00\x00\x00\n\r\n", "p", 1),
    ]
    docs = spark.createDataFrame(rows, PAGES)
    folder = str(tmp_path / "archives")
    warc.write(docs, folder)
    got = warc.read(spark, folder).collect()
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    revisit = {2: 1, 4: 3}
    want = []
    for i, (page, _, html, *_) in enumerate(rows):
        refers = 5 if i == 5 else revisit.get(page)
        kind = "response" if refers is None else "revisit"
        want.append((page, len((html or "").encode()), sha(html), kind, refers))
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter(want)
    for r in got:
        if r.record_type == "response":
            assert bytes(r.payload) in {(h or "").encode() for _, _, h, *_ in rows}
    assert warc.round_trip(docs.limit(0)).count() == 0


def archive(*records):
    dictionary = warc.trained(list(records))
    packer = zstandard.ZstdCompressor(dict_data=warc.opened(dictionary), write_checksum=True)
    skip = warc.EMPTY_FRAME.encode()
    return warc.dictionary_frame(dictionary) + skip + skip.join(packer.compress(r) for r in records)


def test_broken_archives_are_errors():
    good = warc.record(1, "http://a", b"<p>text</p>" * 20, warc.digest_of(b"<p>text</p>" * 20), None)
    whole = archive(good, good)
    assert [warc.parsed(x)[0]["warc-type"] for x in warc.frames(whole)] == ["response", "response"]
    for broken in (whole[:-3], whole[8:], whole + b"junk", whole[:-12] + bytes([whole[-12] ^ 255]) + whole[-11:]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(broken))
    for data in (good.replace(b"WARC/1.1", b"WARC/9.9"), good[:-5], good.replace(b"WARC-Date", b"Other"), good + b"x"):
        with pytest.raises(ValueError):
            warc.parsed(data)
    with pytest.raises(ValueError):
        warc._row(*warc.parsed(good.replace(b"<p>text", b"<p>tExt")))


# --- the pipeline


@needs_tables
def test_pipeline_stages(spark):
    """Each stage against a plain version on the same input."""
    import corpus_pipeline as cp
    from tests.llm.test_shingles import groups
    from trolley.llm import decontaminate

    docs = table(spark, "documents")
    columns = docs.columns
    good = cp.good_documents(spark, docs, FOLDER).cache()
    ranked = {r.doc_id: r.predicted for r in quality.rank(docs, table(spark, "labels")).collect()}
    assert {r.doc_id for r in good.collect()} == {d for d, p in ranked.items() if p} and good.columns == columns

    single = cp.one_of_each(spark, good, FOLDER).cache()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted(min(rows[i][0] for i in g) for g in groups(rows, cp.WIDTH))
    assert single.columns == columns

    clean = cp.without_benchmark(spark, single, FOLDER).cache()
    items = [decontaminate.normalised(r.text.lower().encode()) for r in table(spark, "benchmark").collect()]
    left = {r.doc_id for r in clean.collect()}
    for r in single.collect():
        body = decontaminate.normalised(r.text.lower().encode())
        if any(item in body for item in items):
            assert r.doc_id not in left
    assert clean.columns == columns and len(left) > 0.9 * single.count() - 10

    masked = cp.without_secrets(spark, clean, FOLDER).cache()
    assert masked.count() == clean.count() and masked.columns == columns
    assert not masked.filter(F.col("text").rlike('token = "[0-9a-f]{40}"')).count()

    last = cp.token_ids(spark, masked, FOLDER).collect()
    assert {(r.doc_id, r.text) for r in last} == {(r.doc_id, r.text) for r in masked.collect()}


@needs_tables
def test_pipeline_runs(spark):
    import corpus_pipeline as cp

    got = cp.run(spark, FOLDER)
    assert 0 < got.count() < table(spark, "documents").count()
