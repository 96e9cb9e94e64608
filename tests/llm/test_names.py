"""The pipeline's filtering stages beside columns that have the names the operators use themselves."""

from pyspark.sql import functions as F

from tests.llm.test_documents import hostile
from trolley.llm import decontaminate, quality, shingles
from trolley.llm.words import free

CLASHING = ["_hash", "_n", "_id", "_null", "__HASH", "node", "text_hash", "root", "_draw", "centre", "item_id", "left", "_p"]


def test_free_names(spark):
    docs = hostile(spark).withColumns({c: F.lit(1) for c in CLASHING})
    assert free(docs, "hash", "n", "other") == ["___hash", "__n", "_other"]


def test_clashing_names_change_nothing(spark):
    plain = hostile(spark)
    docs = plain.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, 1, 0)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, "A B C D E F G H")], "item_id bigint, text string")
    for stage in (
        lambda d: quality.keep_good(d, labels),
        lambda d: shingles.keep_one(d, shingles.near_copies(d, 5)),
        lambda d: decontaminate.clean(d, bench),
    ):
        got = stage(docs)
        assert got.columns == docs.columns
        rows = got.collect()
        assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in rows for c in CLASHING)
        assert sorted(map(repr, (r[: len(plain.columns)] for r in rows))) == sorted(map(repr, (r[:] for r in stage(plain).collect())))
