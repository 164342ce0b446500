"""Readers for reviews, class names and emoji words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.functions import fixed
from tamhis.operators.quality import ID
from tamhis.session import running_totals
from tamhis.sources.split_csv import split_records


def review_schema(text_col: str = "Review Text", label_col: str | None = "Label") -> T.StructType:
    fields = [T.StructField(text_col, T.StringType())]
    if label_col:
        fields.append(T.StructField(label_col, T.StringType()))
    return T.StructType(fields)


def missing_to_null(name: str) -> Column:
    """Null for the cell values that mean "missing"."""
    return F.when(~F.col(f"`{name}`").isin(*fixed.NA_TOKENS), F.col(f"`{name}`")).alias(name)


def read_reviews(spark: SparkSession, path, schema: T.StructType | None = None, id_col: str = ID, multi_line: bool = True) -> DataFrame:
    """Reviews from CSV with a header; missing-like cells become null.

    The columns of ``schema`` must be there and get its types; further columns are kept as strings. With ``multi_line`` quoted
    cells may span lines; files are split either way. Rows without an id column get one: the number of the record in the order
    of file name and place, which is the same however the files are split or packed. The files must not change while they are read.
    """
    schema = schema or review_schema()
    raw = (
        spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("quote", '"')
        .option("inferSchema", False).csv(path)
    )
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"no column {missing} in {raw.columns}")
    types = {f.name: f.dataType for f in schema}
    cells = [missing_to_null(c).cast(types.get(c, T.StringType())).alias(c) for c in raw.columns]
    ids = [F.col(f"`{c}`").cast("bigint").alias(c) if c == id_col and c not in types else cell for c, cell in zip(raw.columns, cells)]
    if multi_line:
        schema_text = ", ".join("`{}` string".format(c.replace("`", "``")) for c in raw.columns)
        # Headers are nulled before they are left out, so that no cast of their cells can be moved before that.
        record = F.from_csv(F.when(F.col("place") > 0, F.col("record")), schema_text, {"multiLine": "true", "escape": '"', "quote": '"', "lineSep": "\n"}).alias("__cells")
        found = split_records(spark, path).where("place > 0").select(F.col("number").alias("__number"), record).select("__number", "__cells.*")
        return found.select(*ids) if id_col in raw.columns else found.select(F.col("__number").alias(id_col), *cells)
    if id_col in raw.columns:
        return raw.select(*ids)
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")]
    placed = raw.select(*cells, *place).withColumn("__record", F.monotonically_increasing_id())
    numbered = running_totals(placed, [F.col("__file"), F.col("__start"), F.col("__record")], {"__number": F.lit(1)})
    return numbered.select((F.col("__number") - 1).cast("bigint").alias(id_col), *[F.col(f"`{c}`") for c in raw.columns])


def _read_map(spark: SparkSession, path: str) -> DataFrame:
    cell = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return cell.select(F.explode("m"))


def read_class_mapping(spark: SparkSession, path: str) -> DataFrame:
    """``(id, name)`` from a JSON object of id to name."""
    return _read_map(spark, path).select(F.col("key").cast("int").alias("id"), F.col("value").alias("name"))


def read_stop_words(spark: SparkSession, path: str) -> list[str]:
    """Words of a list with one a line, in its order; read once and then part of the plan."""
    return list(dict.fromkeys(w for r in spark.read.text(path, wholetext=True).collect() for w in r[0].split()))


def read_emoji_map(spark: SparkSession, path: str) -> dict[str, str]:
    """Emoji to word from one JSON object; read once and then part of the plan."""
    return {r["key"]: r["value"] for r in _read_map(spark, path).collect()}
