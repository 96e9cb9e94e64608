"""The registered query of each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trolley.llm import (
    collocations, decontaminate, maxent, pieces, quality, rules, secrets, sharding, simhash, suffixes, toxicity, trie, warc,
)
from trolley.sources.scratch import staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"))


def op5_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(_table(spark, sf_dir, "documents"))


def op6_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives its text back."""
    docs = _table(spark, sf_dir, "documents")
    coded = pieces.encode(docs, decoded=True)
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", F.sha2("text", 256).alias("decoded_sha256")
    )


def op8_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = quality.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return ranked.select("doc_id", "held_out", "score", "predicted")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = staged(trie.digested(_table(spark, sf_dir, "conversations")), "turns")
    found = trie.prefix_trie(*trie.rebuilt(turns))
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_hash_tree_shards, op2_simhash, op3_decontamination, op4_suffix_arrays, op5_maxent_scores,
        op6_divergence_rules, op7_sentencepiece, op8_bradley_terry, op9_secrets, op10_warc, op11_counterfactual,
        op12_collocations, op13_prefix_trie,
    )
}

# Base32 takes 5 bits a character: each 5 hex digits of the SHA-1 give 4 characters.
_BASE32 = "concat(" + ", ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v[{g + 1}] >> {15 - 5 * c}) & 31), 1)"
    for g in range(8) for c in range(4)
) + ")"

ORACLES = {
    "op10_warc": f"""
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
        ), h AS (
            SELECT page_id, octet_length(body) AS n, sha1(body) AS s, min(page_id) OVER (PARTITION BY body) AS first FROM p
        ), d AS (
            SELECT *, [CAST(concat('0x', substr(s, CAST(1 + 5 * g AS BIGINT), 5)) AS BIGINT) for g in range(8)] AS v FROM h
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d
    """,
    "op12_collocations": """
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents
        ), w AS (
            SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
        ), f AS (
            SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM (
                SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, unnest([1, 2, 3]) AS k FROM w)
            ) GROUP BY ALL
        ), c AS (
            SELECT lang, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10
        ), halves AS (
            SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
            FROM (SELECT *, unnest(range(1, len(w))) AS k FROM c)
        ), cuts AS (
            SELECT h.lang, h.phrase, h.a, h.k, x.a AS l, y.a AS r,
                   CAST((1000000 * CAST(h.a AS HUGEINT) * h.a) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
            FROM halves h JOIN f x ON x.lang = h.lang AND x.phrase = h.head
            JOIN f y ON y.lang = h.lang AND y.phrase = h.tail
        ), low AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), longer AS (
            SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS most
            FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE len(w) = 3) GROUP BY ALL
        ), total AS (
            SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
        ), best AS (
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
                   phrase, a, l, r, score
            FROM low LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN total USING (lang) WHERE rank <= 2000
    """,
    "op13_prefix_trie": """
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS body, row_number() OVER (
                PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
            FROM conversations WHERE conv_id IS NOT NULL
        ), ids AS (
            SELECT conv_id, max(pos) AS n, conv_id - conv_id % 5 AS base, CAST(conv_id AS VARCHAR) AS s FROM t GROUP BY conv_id
        ), plan AS (
            SELECT a.conv_id, a.base, coalesce(b.n, 0) AS n_base, xor(4294967295, list_reduce(
                list_transform(range(1, length(a.s) + 1), lambda i: CAST(ascii(substr(a.s, i, 1)) AS BIGINT)),
                lambda crc, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7],
                    lambda u, v: xor(u >> 1, 3988292384 * (u & 1)), xor(crc, x)),
                4294967295)) % 9 AS h
            FROM ids a LEFT JOIN ids b ON b.conv_id = a.base
        ), turns AS (
            SELECT p.conv_id, pos AS d, role, body FROM plan p JOIN t ON t.conv_id = p.base AND pos <= h
            UNION ALL
            SELECT p.conv_id, least(h, n_base) + pos - h, role, body FROM plan p JOIN t ON t.conv_id = p.conv_id AND pos > h
        ), paths AS (
            SELECT conv_id, d, strlen(body) AS bytes, string_agg(sha256(sha256(role) || sha256(body)), '') OVER (
                PARTITION BY conv_id ORDER BY d) AS key
            FROM turns
            UNION ALL SELECT conv_id, 0, 0, '' FROM plan
        ), nodes AS (
            SELECT key, d AS depth, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs
            FROM paths GROUP BY key, d
        ), kids AS (
            SELECT left(key, 64 * (depth - 1)) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
        ), below AS (
            SELECT p.key, count(*) FILTER (k.n IS NULL) AS n_leaves, sum((m.n_convs - 1) * m.bytes) AS saved
            FROM nodes m LEFT JOIN kids k ON k.key = m.key JOIN paths p ON p.conv_id = m.conv_id AND p.d <= m.depth
            GROUP BY p.key
        ), ends AS (
            SELECT p.key, sha256(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id)) AS h
            FROM paths p JOIN (SELECT conv_id, max(d) AS d FROM paths GROUP BY conv_id) e USING (conv_id, d) GROUP BY p.key
        )
        SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.n_leaves,
               CAST(b.saved AS BIGINT) AS saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
        FROM nodes n JOIN below b USING (key) LEFT JOIN kids k USING (key) LEFT JOIN ends e USING (key)
        LEFT JOIN nodes u ON n.depth > 0 AND u.key = left(n.key, 64 * (n.depth - 1))
    """,
}
