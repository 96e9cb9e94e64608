"""Quality rules by distribution divergence, as column expressions only.

Every text is counted into two histograms, character classes and common words. Their Jensen-Shannon distance
to the reference of the text's own language, summed from the corpus itself, decides, unless the text is too short
for its histogram to mean anything. Every language of the corpus has a reference of character classes, those with a
list of common words one of words too. Plain base rules come first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trolley.functions.arrays import count_at_most, probe_steps
from trolley.llm.words import GAP
from trolley.sources.scratch import staged

#: The most frequent words of the languages that have a word reference.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "as", "with"],
    "fr": ["de", "la", "le", "et", "les", "des", "un", "que", "en", "du", "est", "pour", "qui", "dans"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "nicht", "ein"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no"],
}
WORDS = sorted({w for words in COMMON.values() for w in words})
#: Character classes taken out of a text one after the other; what is left is the last class.
CLASSES = ["[a-z]+", "[A-Z]+", r"[\x20\x09-\x0D]+", r"[.,;:?'\"()\-]+", "[0-9]+", r"[#*$%&|<>!]+", r"[\x00-\x7F]+"]
SYMBOLS = "#*$%&|<>"

LEAST_WORDS = 50
LEAST_CHARS = 200
LEAST_COMMON_WORDS = 100
MOST_CHAR_DISTANCE = 0.30
MOST_WORD_DISTANCE = 0.40
FEW_REPEATS = 64


def _let(value: Column, use) -> Column:
    """Bind a value once for an expression that uses it often."""
    return F.transform(F.array(value), use)[0]


def repeat_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur at least twice in the list, by sorted 64-bit hashes."""

    def marked(hashes: Column, double: Column) -> Column:
        """Positions whose hash occurs more than once; `double` are those hashes, ascending."""
        among = F.when(F.size(double) <= FEW_REPEATS, F.filter(
            F.transform(hashes, lambda h, i: F.when(F.array_contains(double, h), i)), lambda i: i.isNotNull()
        )).otherwise(_let(probe_steps(F.size(double)), lambda steps: F.filter(
            F.transform(hashes, lambda h, i: F.when(F.get(double, count_at_most(double, steps, h) - 1) == h, i)),
            lambda i: i.isNotNull(),
        )))
        return among

    def covered(at: Column) -> Column:
        """Words in [i, i + 2] of ascending positions i, each counted once."""
        gaps = F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

    def over(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )
        return _let(hashes, lambda h: _let(F.sort_array(h), lambda s: _let(
            F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))),
            lambda d: F.when(F.size(d) == 0, F.lit(0).cast("bigint")).otherwise(_let(marked(h, d), covered)),
        )))

    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(over(words))


def class_counts(text: Column) -> Column:
    """Code points by class: the class patterns in order, then everything else."""
    left = reduce(lambda t, p: t + [F.regexp_replace(t[-1], p, "")], CLASSES, [text])
    sizes = [F.length(t) for t in left]
    return F.array(*[a - b for a, b in zip(sizes, sizes[1:])], sizes[-1])


def word_counts(words: Column) -> Column:
    """Counts of the common words (whole words, lower-cased), then of all other words."""
    common = F.filter(F.transform(words, F.lower), lambda w: w.isin(WORDS))

    def counted(line: Column, n: Column) -> Column:
        return F.array(
            *[((F.octet_length(line) - F.octet_length(F.replace(line, F.lit(f" {w} "), F.lit("")))) / (len(w.encode()) + 2)).cast("int") for w in WORDS],
            F.size(words) - n,
        )

    return _let(common, lambda c: _let(
        F.concat(F.lit(" "), F.array_join(c, "  "), F.lit(" ")), lambda line: counted(line, F.size(c))
    ))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars, common) of whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(
        "doc_id", lang.alias("lang"), text.alias("t"), F.filter(F.split(text, GAP), lambda w: w != "").alias("w")
    )
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(
        "doc_id",
        "lang",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        class_counts(F.col("t")).alias("chars"),
        word_counts(F.col("w")).alias("common"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(stats: DataFrame) -> DataFrame:
    """(lang, chars_shares, common_shares): the summed histograms of a language's documents that pass the base rules.

    One aggregate over all documents, which should be a stored table. A language without a word list has null for
    common_shares; null is no language.
    """
    wide = {"chars": len(CLASSES) + 1, "common": len(WORDS) + 1}
    sums = [F.array(*[F.sum(F.col(c)[i]) for i in range(n)]).alias(c) for c, n in wide.items()]
    summed = stats.filter(F.col("lang").isNotNull() & ~base_failed()).groupBy("lang").agg(*sums)

    def shares(name: str) -> Column:
        total = F.greatest(F.aggregate(name, F.lit(0).cast("bigint"), lambda a, c: a + c), F.lit(1))
        return F.transform(name, lambda c: c / total)

    listed = F.when(F.col("lang").isin(list(COMMON)), shares("common"))
    return summed.select("lang", shares("chars").alias("chars_shares"), listed.alias("common_shares"))


def distance(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance, 0 to 1, of a histogram of counts to reference shares; null without a reference."""

    def terms(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    def against(total: Column) -> Column:
        parts = F.zip_with(counts, shares, lambda c, q: terms(c / total, q))
        return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))

    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, c: a + c)
    return F.when(shares.isNotNull(), F.when(total > 0, _let(total, against)).otherwise(F.lit(1.0)))


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance,
    word_distance, kept) of every row.

    Null texts count as empty and fail the base rules by their length. Texts under LEAST_CHARS characters or
    LEAST_COMMON_WORDS words are not judged by the histogram that needs more. A distance is null, and no ground to
    drop a row, where there is no reference: without a language, for words of a language without a list, and for a
    language all of whose documents fail the base rules. Repeated rows are judged alike; further columns are ignored.
    """
    stats = staged(statistics(docs), "rules")
    judged = stats.join(references(stats), "lang", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"),
        distance(F.col("chars"), F.col("chars_shares")).alias("char_distance"),
        distance(F.col("common"), F.col("common_shares")).alias("word_distance"),
    )
    strange = (F.col("word_chars") >= LEAST_CHARS) & (F.col("char_distance") > MOST_CHAR_DISTANCE)
    words = (F.col("n_words") >= LEAST_COMMON_WORDS) & (F.col("word_distance") > MOST_WORD_DISTANCE)
    strange = F.coalesce(strange, F.lit(False)) | F.coalesce(words, F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~strange)
