"""Records of runs: parameters, cleaning steps, metrics and input tables, as appended tables."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamhis.functions import fixed


def enabled_steps(flags: Mapping[str, bool]) -> list[str]:
    """Cleaning steps that are on, in the order in which they run."""
    return [s for s in ("translate_english", *fixed.CLEANING_STEPS) if flags.get(s)]


def table_digest(df: DataFrame) -> DataFrame:
    """``(rows, digest)``: row count and an order-free sum of row hashes, the first 60 bits of an MD5 of all cells.

    Each cell carries its length, and a null is not an empty string.
    """
    text = [F.col(f"`{c}`").cast("string") for c in df.columns]
    cells = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    row = F.conv(F.substring(F.md5(F.concat_ws("|", *cells)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row), F.lit(0)).cast("decimal(38,0)").alias("digest"))


class RunRecorder:
    """Appends to ``run_params``, ``run_metrics`` and ``run_inputs`` under one folder."""

    def __init__(self, spark: SparkSession, root: str, run_id: str):
        self.spark, self.root, self.run_id = spark, root.rstrip("/"), run_id

    def _append(self, df: DataFrame, table: str) -> None:
        df.select(F.lit(self.run_id).alias("run_id"), *df.columns).write.mode("append").parquet(f"{self.root}/{table}")

    def params(self, config: Mapping, flags: Mapping[str, bool] | None = None) -> None:
        rows = [(str(k), json.dumps(v, ensure_ascii=False, default=str)) for k, v in config.items()]
        if flags is not None:
            rows.append(("preprocessing_steps", json.dumps(enabled_steps(flags))))
        self._append(self.spark.createDataFrame(rows, "param string, value string"), "run_params")

    def metrics(self, metrics: DataFrame) -> None:
        self._append(metrics.select("metric", F.col("value").cast("double")), "run_metrics")

    def input(self, name: str, df: DataFrame) -> None:
        row = table_digest(df).select(
            F.lit(name).alias("name"), "rows", F.lit(df.schema.json()).alias("schema_json"), "digest"
        )
        self._append(row, "run_inputs")

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}").where(F.col("run_id") == self.run_id)
