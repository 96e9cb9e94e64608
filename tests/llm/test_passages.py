"""Passages copied from inside benchmark items, and short items."""

import random

from trolley.llm import decontaminate


def test_passages_cut_at_random_offsets_are_found(spark):
    draw = random.Random(4)

    def text(n):
        return ["".join(draw.choice("aeioulnrst") for _ in range(draw.randrange(3, 9))) for _ in range(n)]

    items = [(i, text(draw.randrange(35, 70))) for i in range(12)]
    docs, want = [], set()
    for i in range(150):
        item, body = items[draw.randrange(12)]
        at = draw.randrange(len(body) - 10)
        n = 1
        while len(" ".join(body[at : at + n])) < 60 and at + n < len(body):
            n += 1
        passage = " ".join(body[at : at + n])
        if i % 3 == 0 and len(passage) > 20:  # up to four edits
            for _ in range(draw.randrange(1, 5)):
                k = draw.randrange(len(passage))
                passage = passage[:k] + "x" + passage[k + 1 :]
        docs.append((i, " ".join([*text(30), passage.upper(), *text(30)])))
        if len(passage) >= 60:
            want.add((i, item))
    bench = spark.createDataFrame([(i, " ".join(b)) for i, b in items], "item_id bigint, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()
    assert len(want) > 100 and {(r.doc_id, r.item_id) for r in got} == want


def test_short_items_are_found_at_word_borders(spark):
    bench = spark.createDataFrame([(1, "Who wrote it?"), (2, "Why"), (3, "?!")], "item_id bigint, text string")
    rows = [(1, "so: who wrote  it"), (2, "who wrote item"), (3, "awho wrote it"), (4, "why"), (5, "whys"), (6, None)]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, 0, 3), (4, 2, 1, 0, 0)]


def test_a_leak_takes_only_its_own_row(spark):
    item = "which of the following words describes the colour of the sky on a clear day"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    rows = [(1, f"so {item} then"), (1, "clean text under the same id"), (None, item.upper()), (None, "clean"), (2, None)]
    kept = decontaminate.clean(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "clean"), (1, "clean text under the same id"), (2, "")]
