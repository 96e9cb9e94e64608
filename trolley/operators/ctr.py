"""Click prediction: field choice, encoding, sampling, models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import FMClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, Window, functions as F

from trolley.functions.dates import hour_parts
from trolley.functions.draws import keep
from trolley.operators import perceptron
from trolley.operators.spread import ROWS_PER_RANGE, global_running_total, hot_key_join
from trolley.sources.scratch import staged

# The size classes of columns, the sizes of calendar fields and the grid of inverse penalties.
FEW, MANY, HIGH = 20, 10_000, 100
CALENDAR_SIZES = {"day": 31, "hour_of_day": 24, "weekday": 7}
C_GRID = (0.01, 0.03, 0.1, 0.3, 1, 3, 10)


def time_features(df: DataFrame, hour: str = "hour") -> DataFrame:
    """Calendar parts of the hour text, plain and in coarse buckets."""
    parts = hour_parts(F.col(hour))
    return df.withColumns(
        {
            "year": parts["year"],
            "month_b": F.floor(parts["month"] / 4).cast("int"),
            "day_b": F.floor(parts["day"] / 11).cast("int"),
            "hour_b": F.floor(parts["hour"] / 2).cast("int"),
            "day": parts["day"],
            "hour_of_day": parts["hour"],
            "weekday": parts["weekday"],
        }
    )


def feature_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in set(exclude)]


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct values of each column, one pass, with the size rules of both trainers."""
    columns = list(columns or df.columns)
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_distinct")) for c in columns])
    n = F.col("n_distinct")
    return counts.select(F.inline(rows)).select(
        "column",
        "n_distinct",
        ((n > 1) & (n < FEW)).cast("int").alias("keep_small"),
        (n < MANY).cast("int").alias("keep_medium"),
        F.when(n > HIGH, "high").otherwise("low").alias("size_class"),
    )


def select_columns(df: DataFrame, columns: Sequence[str], above: int = 0, below: int = MANY) -> list[str]:
    """Columns with above < distinct values < below. One row a column reaches the driver."""
    profile = column_profile(df, columns).filter((F.col("n_distinct") > above) & (F.col("n_distinct") < below))
    found = {r["column"] for r in profile.select("column").collect()}
    return [c for c in columns if c in found]


def vocabulary(df: DataFrame, columns: Sequence[str], known: dict[str, int] | None = None) -> DataFrame:
    """(field, size, largest): values of each field, one pass, and the most that any counted field has.

    `known` gives sizes that do not depend on the data, such as the days of a month; these do not count for the largest.
    """
    counted = column_profile(df, columns).select(F.col("column").alias("field"), F.col("n_distinct").alias("size"))
    most = counted.agg(F.max("size").alias("n")).scalar()
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(n).cast("bigint").alias("size")) for f, n in (known or {}).items()])
    fixed = df.sparkSession.range(1).select(F.inline(rows)) if known else counted.limit(0)
    return counted.unionByName(fixed).withColumn("largest", most)


def label_codes(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """Replace values by their place among the sorted distinct values of the fitted rows.

    A value not seen in the fit gets the next free code. Code tables of fewer than MANY values are broadcast;
    those of larger columns are numbered in ranges and joined with hot values split.
    """
    seen = df if fit is None else fit
    sizes = {r["column"]: r["n_distinct"] for r in column_profile(seen, columns).collect()}
    narrow = [c for c in columns if sizes[c] < MANY]
    # One pass gives the values of all columns; numbers sort as numbers and text as text.
    texts = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    fields = [
        F.struct(
            F.lit(c).alias("column"),
            (F.lit(None) if c in texts else F.col(c)).cast("double").alias("number"),
            (F.col(c) if c in texts else F.lit(None)).cast("string").alias("text"),
        )
        for c in narrow
    ]
    if narrow:
        values = seen.select(F.inline(F.array(*fields))).filter("number is not null or text is not null").distinct()
        place = F.row_number().over(Window.partitionBy("column").orderBy("number", "text")) - 1
        codes = staged(values.withColumn("_code", place), "codes")  # read once a column
    for c in columns:
        if c not in narrow:
            coded = hot_key_join(df, _wide_codes(seen, c, c in texts), c, "left")
            df = coded.withColumn(c, F.coalesce("_code", F.lit(sizes[c])).cast("int")).select(*df.columns)
            continue
        own = codes.filter(F.col("column") == c).select(
            F.col("text" if c in texts else "number").cast(df.schema[c].dataType).alias(c), "_code"
        )
        coded = df.join(F.broadcast(own), c, "left").withColumn(c, F.coalesce("_code", F.lit(sizes[c]).cast("int")))
        df = coded.select(*df.columns)
    return df


def _wide_codes(seen: DataFrame, column: str, text: bool) -> DataFrame:
    """(value, _code) of a column with many values, numbered in ranges of a number that follows their order:
    the value itself, or the first seven bytes of a text."""
    head = F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 7)), 14, "0")
    number = F.conv(head, 16, 10).cast("bigint") if text else F.col(column).cast("double")
    values = seen.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("_number", number)
    return global_running_total(values, ["_number", column], F.lit(1), "_code").select(column, "_code")


def first_seen_codes(df: DataFrame, column: str, at: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Number values 0, 1, ... by first appearance (then by value): (column, code)."""
    first = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(at).alias("_first"))
    first = first.withColumn("_moment", F.unix_micros(F.col("_first").cast("timestamp_ltz")))
    numbered = global_running_total(first, ["_moment", column], F.lit(1), "code", rows_per_range)
    return numbered.select(column, F.col("code").cast("bigint").alias("code"))


def dummies(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """A 0/1 column for every value of the low-cardinality columns, fitted on the given rows."""
    seen = df if fit is None else fit
    wide = set(columns) - set(select_columns(seen, columns, below=FEW))
    if wide:
        raise ValueError(f"columns with {FEW} or more values: {sorted(wide)}")
    if not columns:
        return df
    values = seen.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns]).first()
    flags = [
        F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for c in columns for v in values[c]
    ]
    return df.select(*[c for c in df.columns if c not in columns], *flags)


def sampled(df: DataFrame, key: str, label: str, fraction: float = 0.7, negatives: float = 0.2, valid: float = 0.15):
    """A fixed share of the rows, all clicks and a share of the others, marked train or valid."""
    k = F.col(key)
    kept = df.filter(keep("rows", fraction, k)).filter((F.col(label) == 1) | keep("negatives", negatives, k))
    return kept.withColumn("part", F.when(keep("valid", valid, k), "valid").otherwise("train"))


def prepare(df: DataFrame, key: str, columns: Sequence[str], fraction: float = 0.05) -> DataFrame:
    """The small-sample set: a fixed share of the rows, low-cardinality columns as 0/1 columns."""
    return dummies(df.filter(keep("small", fraction, F.col(key))), columns, fit=df)


def fit_encoder(train: DataFrame, columns: Sequence[str]) -> PipelineModel:
    """One-hot features of the columns; values not met in training share a slot."""
    codes = [f"{c}_code" for c in columns]
    hot = [f"{c}_hot" for c in columns]
    return Pipeline(
        stages=[
            StringIndexer(
                inputCols=list(columns), outputCols=codes, stringOrderType="alphabetAsc", handleInvalid="keep"
            ),
            OneHotEncoder(inputCols=codes, outputCols=hot, dropLast=False),
            VectorAssembler(inputCols=hot, outputCol="features"),
        ]
    ).fit(train)


def fit_lr(
    train: DataFrame,
    label: str = "click",
    c: float = 0.3,
    grid: Sequence[float] | None = None,
    valid: DataFrame | None = None,
):
    """L1 logistic regression; with a grid of C values and both penalties, the one with the best AUC on `valid`.

    C weighs the summed loss and Spark's penalty the mean loss, so the penalty is 1 / (C * rows).
    """
    n = train.count()
    lr = LogisticRegression(
        labelCol=label, elasticNetParam=1.0, regParam=1.0 / (c * n), standardization=False, maxIter=50
    )
    if grid is None:
        return lr.fit(train)
    choices = ParamGridBuilder().addGrid(lr.elasticNetParam, [1.0, 0.0])
    choices = choices.addGrid(lr.regParam, [1.0 / (g * n) for g in grid]).build()
    judge = BinaryClassificationEvaluator(labelCol=label)
    fitted = [lr.fit(train, choice) for choice in choices]
    return max(fitted, key=lambda model: judge.evaluate(model.transform(valid)))


def weighted_scores(coded: DataFrame, fields: Sequence[str], weights: DataFrame, bias: float, *keep_columns: str) -> DataFrame:
    """The kept columns and the probability of a logistic model given as a table (field, code, weight).

    Fields have fewer than MANY codes, which bounds the tables that are broadcast; a code without a weight adds nothing.
    """
    logit = F.lit(float(bias))
    for f in fields:
        own = weights.filter(F.col("field") == f).select(F.col("code").alias(f), F.col("weight").alias(f"_w_{f}"))
        coded = coded.join(F.broadcast(own), f, "left")
        logit = logit + F.coalesce(f"_w_{f}", F.lit(0.0))
    return coded.select(*keep_columns, (1 / (1 + F.exp(-logit))).alias("score"))


def fit_fm(train: DataFrame, label: str = "click", factors: int = 8, iters: int = 20, seed: int = 0):
    """Factorisation machine: the pairwise half of the deep factorisation model."""
    return FMClassifier(labelCol=label, factorSize=factors, regParam=0.005, maxIter=iters, stepSize=0.05, seed=seed).fit(
        train
    )


def fit_mlp(train: DataFrame, label: str = "click", hidden: Sequence[int] = (128, 64), iters: int = 20, seed: int = 0):
    """Multilayer perceptron: the deep half."""
    return perceptron.fit(train, label, hidden, iters, seed)


def scores(model, df: DataFrame, *keep_columns: str) -> DataFrame:
    """The label (or the named columns) and the predicted probability."""
    kept = keep_columns or ("click",)
    return model.transform(df).select(*kept, vector_to_array("probability").getItem(1).alias("score"))


def blended(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Mean of two models' scores, joined on the row key."""
    other = second.select(key, F.col("score").alias("_other"))
    return first.join(other, key).withColumn("score", (F.col("score") + F.col("_other")) / 2).drop("_other")
