"""Checkpoint folder, durable cuts and ordered running totals shared by the operators."""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PART = "__part"
BROADCAST_BYTES = 64 << 20
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def use_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session: the one the cluster names, else a new one in local mode only."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="tamhis-checkpoint-")
    context.setCheckpointDir(named)
    return named


def pin(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage.

    The result survives the loss of executors; nothing is kept on one machine. What was shuffled for it is deleted when it is there.
    """
    spark = df.sparkSession
    use_checkpoint_dir(spark)
    before = spark.conf.get(_FREE_SHUFFLES)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, so that no shuffle of another action on ``df`` is deleted
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its measured size is at most ``limit`` bytes, else ``df`` as it is.

    Measures by one pass, so give it pinned or stored tables. Without the hint Spark joins by shuffle and
    AQE splits hot keys.
    """
    width = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        cell = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            size = F.octet_length(cell)
        elif isinstance(field.dataType, T.ArrayType):
            size = F.size(cell) * (40 if isinstance(field.dataType.elementType, (T.StructType, T.StringType)) else 8)
        else:
            size = F.lit(8)
        width = width + F.coalesce(size.cast("bigint"), F.lit(0)) + 8
    measured = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if measured <= limit else df


def running_totals(df: DataFrame, order: Sequence[Column], totals: Mapping[str, Column]) -> DataFrame:
    """Add inclusive running totals over a global order without sorting in one task.

    Rows are range-partitioned on ``order`` and pinned; each range then adds the total of the ranges before
    it. Only that offset table, one row per range, is ever ordered in a single task. The rows must be
    unique in ``order``.
    """
    columns = df.columns
    work = df.select("*", *[value.alias(f"__v_{name}") for name, value in totals.items()])
    work = pin(work.repartitionByRange(*order).withColumn(_PART, F.spark_partition_id()))
    sums = work.groupBy(_PART).agg(*[F.sum(f"__v_{name}").alias(f"__s_{name}") for name in totals])
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        _PART, *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in totals]
    )
    inside = Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return work.join(offsets, _PART).select(
        *columns, *[(F.sum(f"__v_{n}").over(inside) + F.col(f"__o_{n}")).alias(n) for n in totals]
    )
