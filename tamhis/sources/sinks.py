"""Writers for cleaned reviews, annotations and reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANNOTATION_COLUMNS = {"train": None, "val": ("review", "label", "topic"), "test": ("review", "topic")}


def write_reviews(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Cleaned reviews as Parquet, or as CSV with a header. Give every stage a path of its own."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}; use 'parquet' or 'csv'")
    return path


def write_annotation(df: DataFrame, path: str, split: str, fmt: str = "parquet") -> str:
    """Annotated reviews of one split under ``path/split=<split>``.

    ``train`` keeps every column; ``val`` keeps review, label and topic; ``test`` keeps review and topic.
    """
    if split not in ANNOTATION_COLUMNS:
        raise ValueError(f"unknown split {split!r}; use one of {sorted(ANNOTATION_COLUMNS)}")
    kept = ANNOTATION_COLUMNS[split]
    rows = df.select(*kept) if kept else df
    return write_reviews(rows, f"{path.rstrip('/')}/split={split}", fmt)


def write_topic_report(sizes: DataFrame, path: str, name: str = "topics", when: dt.datetime | None = None) -> str:
    """Topic frequencies with the name and time of the run."""
    stamp = F.lit(when or dt.datetime.now())
    report = sizes.select(F.lit(name).alias("experiment"), stamp.alias("run_at"), "topic", "n")
    report.write.mode("overwrite").parquet(path)
    return path


def append_performance(
    metrics: DataFrame, path: str | None, task: str = "Training", when: dt.datetime | None = None
) -> str:
    """Append ``(metric, value)`` rows to a performance table."""
    if path is None:
        raise ValueError("a path for the performance table is needed")
    stamp = F.lit(when or dt.datetime.now())
    rows = metrics.select(F.lit(task).alias("task"), stamp.alias("run_at"), "metric", F.col("value").cast("double"))
    rows.write.mode("append").parquet(path)
    return path
