"""CSV records with quoted line ends, read by many tasks per file.

Spark splits a file at line ends, which may lie inside quotes. Whether a line starts inside a quoted cell depends on all lines
before it, so each range of a file is worked off for both cases, a scan over the ranges (one row each) tells which case holds,
and only the lines of records that span lines are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamhis.session import pin, small

CELL = r'(?:"(?:[^"]++|"")*+"[^,]*+|(?!")[^,]*+)'
#: Lines that end outside quotes when they start outside, and when they start inside. Possessive throughout, so each costs one scan.
CLOSED = (rf"\A{CELL}(?:,{CELL})*+\z", rf'\A(?:[^"]++|"")*+"[^,]*+(?:,{CELL})*+\z')
RANGE = ["file", "start"]


def _lines(spark: SparkSession, path) -> DataFrame:
    """``(file, start, line, after0, after1, full)``: ``after`` is 1 if the line ends inside quotes, given that it starts outside (0) or inside (1)."""
    rows = spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", "line")
    quoted = F.col("line").contains('"')
    after = [F.when(quoted, (~F.col("line").rlike(CLOSED[case])).cast("int")).otherwise(case).alias(f"after{case}") for case in (0, 1)]
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    return rows.select(*place, "line", *after, (~F.col("line").isin("", "\r")).alias("full"))


def _states(ends: np.ndarray, first: int) -> np.ndarray:
    """State before each line and after the last; ``ends[case]`` is the state after a line that starts in state ``case``."""
    fixed = ends[0] == ends[1]
    swaps = np.concatenate([[0], np.cumsum(~fixed & (ends[0] == 1))])
    at = np.maximum.accumulate(np.concatenate([[0], np.where(fixed, np.arange(1, len(fixed) + 1), 0)]))
    held = np.concatenate([[first], ends[0]])[at]
    return (held + swaps - swaps[at]) % 2


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray], list[int], list[int]]]:
    """Pieces of one range each, in order: the rows with ``pos``, states for both cases, and after the piece the end states and record counts."""
    place, ends, counts, pos = None, [0, 1], [0, 0], 0
    for batch in batches:
        batch = batch.reset_index(drop=True)
        change = [(batch[c].to_numpy()[1:] != batch[c].to_numpy()[:-1]) for c in RANGE]
        cuts = [0, *(np.flatnonzero(change[0] | change[1]) + 1), len(batch)] if len(batch) else []
        for a, b in zip(cuts, cuts[1:]):
            piece = batch.iloc[a:b].reset_index(drop=True)
            here = tuple(piece.loc[0, RANGE])
            if here != place:
                place, ends, counts, pos = here, [0, 1], [0, 0], 0
            after = piece[["after0", "after1"]].to_numpy(dtype=np.int64).T
            full = piece["full"].to_numpy(dtype=bool)
            piece = piece.drop(columns=["after0", "after1"])
            piece["pos"] = np.arange(pos, pos + len(piece))
            states = [_states(after, ends[case]) for case in (0, 1)]
            for case in (0, 1):
                starts = (states[case][:-1] == 0) & full
                piece[f"record{case}"] = counts[case] + np.cumsum(starts) - 1
                piece[f"open{case}"] = states[case][:-1] == 1
                piece[f"whole{case}"] = starts & (states[case][1:] == 0)
                counts[case] += int(starts.sum())
                ends[case] = int(states[case][-1])
            pos += len(piece)
            yield piece, states, list(ends), list(counts)


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last = None
    for piece, _, ends, counts in _walk(batches):
        row = (*piece.loc[0, RANGE], *ends, *counts)
        if last is not None and last[:2] != row[:2]:
            yield pd.DataFrame([last], columns=[*RANGE, "end0", "end1", "n0", "n1"])
        last = row
    if last is not None:
        yield pd.DataFrame([last], columns=[*RANGE, "end0", "end1", "n0", "n1"])


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for piece, *_ in _walk(batches):
        # Blank lines outside quotes are no records under either case and go here.
        yield piece[piece["full"] | piece["open0"] | piece["open1"]]


def _ranges(summary: DataFrame) -> DataFrame:
    """``(file, start, case, first, inside)``: the state a range starts in, the number of its first record over all files without headers,
    and that within its file with the header."""
    own = Window.partitionBy("file").orderBy("start")
    before, everything = own.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(*RANGE).rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col("end0") > F.col("end1")).cast("int")
    rows = summary.withColumn("swaps", F.sum(swap).over(own))
    rows = rows.withColumn("held", F.last(F.when(F.col("end0") == F.col("end1"), F.struct(F.col("end0").alias("state"), "swaps")), True).over(before))
    rows = rows.withColumn("earlier", F.coalesce(F.lag("swaps").over(own), F.lit(0)))
    state = F.coalesce("held.state", F.lit(0)) + F.col("earlier") - F.coalesce("held.swaps", F.lit(0))
    rows = rows.withColumn("case", state % 2)
    rows = rows.withColumn("n", F.when(F.col("case") == 1, F.col("n1")).otherwise(F.col("n0")))
    headers = F.dense_rank().over(Window.orderBy("file"))
    total = lambda window: F.coalesce(F.sum("n").over(window), F.lit(0))
    return rows.select(*RANGE, "case", (total(everything) - headers).alias("first"), total(before).alias("inside"))


def split_records(spark: SparkSession, path) -> DataFrame:
    """``(file, number, place, record)``: every CSV record of the files, quoted line ends included, as text.

    ``number`` counts records from 0 over all files in the order of name and place, without the first record of each, the header;
    ``place`` counts all records of a file from 0. Cells are divided by commas, quoted by ``"`` and escaped by doubling it; a quote inside an unquoted cell is a
    letter like any other. Lines end with LF or CR LF; blank ones outside quotes are no records. A quote that is never closed
    makes one record of the rest of its file.
    """
    lines = _lines(spark, path)
    summary = lines.drop("line").mapInPandas(_summaries, "file string, start long, end0 int, end1 int, n0 long, n1 long")
    ranges = small(pin(_ranges(pin(summary))))
    schema = "file string, start long, line string, full boolean, pos long, " + ", ".join(f"record{c} long, open{c} boolean, whole{c} boolean" for c in (0, 1))
    met = lines.mapInPandas(_placed, schema).join(ranges.withColumnRenamed("file", "f").withColumnRenamed("start", "s"),
                                                 (F.col("file") == F.col("f")) & (F.col("start") == F.col("s")), "left")
    case = F.coalesce("case", F.raise_error(F.lit("the files or their splits changed while they were read")).cast("int"))
    pick = lambda name: F.when(F.col("__case") == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    met = met.withColumn("__case", case).select(
        *RANGE, "pos", "line", "full", pick("open").alias("open"), pick("whole").alias("whole"),
        (F.col("first") + pick("record")).alias("number"), (F.col("inside") + pick("record")).alias("place"),
    ).where("open OR full")
    whole = met.where("whole").select("file", "number", "place", "line")
    cells = F.array_sort(F.collect_list(F.struct("start", "pos", "line")))
    spanning = met.where(~F.col("whole")).groupBy("file", "number", "place").agg(F.array_join(F.transform(cells, lambda c: c["line"]), "\n").alias("line"))
    return whole.unionByName(spanning).select("file", "number", "place", F.regexp_replace("line", "\r$", "").alias("record"))
