"""English texts routed through a translation-memory table, and the table kept between runs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamhis.functions import text as tx
from tamhis.session import pin, small

BUCKETS = 256  # parts of a kept memory; fixed, as it tells where a text lies
_KEPT = "source_text string, target_text string, bucket int"


def _memory(memory: DataFrame) -> DataFrame:
    """One target a text. Texts of the memory are known by their digest, so they are not moved; the exchange of this grouping serves the join too."""
    return memory.groupBy(_digest("source_text").alias("__source")).agg(F.min("target_text").alias("__target"))


def _digest(c: str):
    return F.unhex(F.sha2(c, 256))


def translate_english(df: DataFrame, text_col: str, memory: DataFrame) -> DataFrame:
    """Replace English texts found in ``memory (source_text, target_text)``; other rows stay.

    Only English rows enter the join; the rest pass by without a shuffle.
    """
    english = tx.detect_language(text_col) == "en"
    routed = df.where(english).join(_memory(memory), F.col("__source") == _digest(text_col), "left")
    routed = routed.withColumn(text_col, F.coalesce("__target", text_col)).select(*df.columns)
    return routed.unionByName(df.where(F.coalesce(~english, F.lit(True))))


def untranslated(df: DataFrame, text_col: str, memory: DataFrame) -> DataFrame:
    """Distinct English texts that the memory lacks: the work list for a translator."""
    english = df.where(tx.detect_language(text_col) == "en").select(F.col(text_col).alias("source_text"))
    english = english.groupBy(_digest("source_text").alias("digest")).agg(F.first("source_text").alias("source_text"))
    return english.join(_memory(memory), F.col("digest") == F.col("__source"), "left_anti").select("source_text")


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """``(source_text, target_text)`` of a kept memory; without rows as long as nothing was remembered."""
    return _kept(spark, path).drop("bucket")


def _kept(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_KEPT).parquet(path)
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _KEPT)


def remember(answers: DataFrame, path: str) -> None:
    """Put ``answers (source_text, target_text)`` into the memory kept at ``path``; a text it knows gets the new target.

    The table lies in buckets by the hash of the text, and only those that new answers fall into are read and replaced. Of several
    targets in one batch the least counts; rows without a text or a target are left out. One writer at a time; doing the
    same batch again gives the same table. A driver lost while buckets are being replaced can leave one of them missing: keep a copy.
    """
    new = answers.where("source_text IS NOT NULL AND target_text IS NOT NULL").select("source_text", "target_text")
    new = new.withColumn("bucket", F.pmod(F.xxhash64("source_text"), F.lit(BUCKETS)).cast("int"))
    old = _kept(answers.sparkSession, path)
    if old.isEmpty():
        merged = _by_bucket(new)
    else:
        new = pin(new)
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        replaced = small(pin(new.select("bucket", F.sha2("source_text", 256).alias("digest")).distinct()))
        old = old.where(F.col("bucket").isin(touched)).withColumn("digest", F.sha2("source_text", 256))
        # Pinned before the write, which replaces the files it was read from.
        merged = pin(_by_bucket(new.unionByName(old.join(replaced, ["bucket", "digest"], "left_anti").drop("digest"))))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _by_bucket(rows: DataFrame) -> DataFrame:
    """The least target of each text; one exchange by bucket serves the grouping and the write."""
    grouped = rows.repartition("bucket").groupBy("bucket", "source_text").agg(F.min("target_text").alias("target_text"))
    return grouped.select("source_text", "target_text", "bucket")
