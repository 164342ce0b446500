"""Row-set rules: duplicates, missing values, labels and hold-out splits.

Every table has a stable ``doc_id``. It is not part of what makes two rows equal.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID = "doc_id"


def business_columns(df: DataFrame, id_col: str = ID) -> list[str]:
    return [c for c in df.columns if c != id_col]


def drop_duplicates(df: DataFrame, columns: Sequence[str] | None = None, id_col: str = ID) -> DataFrame:
    """One row per combination of ``columns``; the smallest id stands for the group.

    The combine step runs before the shuffle, so a much-copied row leaves each task once.
    """
    keys = list(columns or business_columns(df, id_col))
    return df.groupBy(*keys).agg(F.min(id_col).alias(id_col)).select(id_col, *keys)


def drop_missing(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of a row; each part carries its length, and a null is not an empty string."""
    parts = []
    for name in columns:
        value = F.col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat_ws("|", *parts), 256)


def quality_report(df: DataFrame, columns: Sequence[str] | None = None, id_col: str = ID) -> DataFrame:
    """Row counts of :func:`drop_duplicates` then :func:`drop_missing`, in one pass over digests."""
    keys = list(columns or business_columns(df, id_col))
    missing = F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0))
    groups = df.groupBy(row_digest(keys).alias("digest")).agg(
        F.count(F.lit(1)).alias("n"), F.max(missing).alias("missing")
    )
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("original_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates_removed"),
        F.coalesce(F.sum("missing"), F.lit(0)).cast("bigint").alias("null_rows_removed"),
        F.coalesce(F.sum(1 - F.col("missing")), F.lit(0)).cast("bigint").alias("final_rows"),
    )


def check_quality(df: DataFrame, text_col: str, id_col: str = ID) -> DataFrame:
    """Drop duplicates, then rows with a missing value, and make the text a string."""
    order = df.columns
    kept = drop_missing(drop_duplicates(df, id_col=id_col))
    return kept.withColumn(text_col, F.col(text_col).cast("string")).select(*order)


def encode_labels(df: DataFrame, label_col: str, classes: Mapping[int, str] | DataFrame, out: str | None = None):
    """Class name to id; an unknown name gives null. ``classes`` is a dict or an ``(id, name)`` table."""
    return _look_up(df, label_col, classes, "name", "id", "int", out or label_col)


def decode_labels(df: DataFrame, label_col: str, classes: Mapping[int, str] | DataFrame, out: str | None = None):
    """Class id to name."""
    return _look_up(df, label_col, classes, "id", "name", "string", out or label_col)


def _look_up(df, label_col, classes, key, value, kind, out):
    if isinstance(classes, DataFrame):
        table = classes.select(F.col(key).alias("__k"), F.col(value).cast(kind).alias("__v"))
        joined = df.join(table, F.col(label_col) == F.col("__k"), "left")
        return joined.withColumn(out, F.col("__v")).drop("__k", "__v")
    pairs = [(n, i) if key == "name" else (i, n) for i, n in classes.items()]
    if not pairs:
        return df.withColumn(out, F.lit(None).cast(kind))
    table = F.create_map(*[F.lit(part) for pair in pairs for part in pair])
    return df.withColumn(out, table[F.col(label_col)].cast(kind))


def holdout_bucket(id_col: str = ID) -> Column:
    """A number from 0 to 99 that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("bigint") % 100


def holdout_split(df: DataFrame, percent: int = 20, id_col: str = ID) -> DataFrame:
    """Add ``split``: ``test`` for about ``percent`` of the ids, else ``train``; the same on every run."""
    return df.withColumn("split", F.when(holdout_bucket(id_col) < percent, "test").otherwise("train"))


def train_test(df: DataFrame, percent: int = 20, id_col: str = ID, seed: int | None = None):
    """Two frames. With a seed the split is Spark's random one, otherwise the split by id."""
    if seed is not None:
        train, test = df.randomSplit([100.0 - percent, float(percent)], seed)
        return train, test
    bucket = holdout_bucket(id_col)
    return df.where(bucket >= percent), df.where(bucket < percent)


def assemble(df: DataFrame, text_col: str, label_col: str | None, topic_col: str = "topic", id_col: str = ID):
    """Review, label and topic of each document, from one frame."""
    columns = [F.col(id_col), F.col(text_col).alias("review")]
    if label_col:
        columns.append(F.col(label_col).alias("label"))
    return df.select(*columns, F.col(topic_col).alias("topic"))
