"""Helpers shared by the training-data operators: stored cuts, row-wise Arrow passes and word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tamhis.session import use_checkpoint_dir

#: Bytes of a lower-cased UTF-8 text that part words: all ASCII but digits and small letters. Longer code points count as letters.
_PARTING = bytes(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A))
_BLANKED = bytes.maketrans(_PARTING, b" " * len(_PARTING))
WORD_PATTERN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Rows that are worked off before their results leave a task.
_ROWS = 256
#: Bytes that Spark hands to a Python worker at once. Its own limit of 64 MB is held by the task and by the worker, several times over while buffers grow.
BATCH_BYTES = 4 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read back.

    Like a checkpoint it cuts the lineage and survives lost executors; unlike one it is compressed and columnar, so
    later readers take only the columns they need.
    """
    path = f"{use_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; a file with fewer splits than cores is dealt out over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of the session hold at most ``BATCH_BYTES``, or one row if that is longer; a limit that the session names stays.

    Spark takes the limit from the session when a job runs, so it is set for the session and left.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def map_rows(
    df: DataFrame, keep: Sequence[str | Column], inputs: Sequence[str | Column], fields: Sequence[T.StructField],
    make: Callable[[], Callable[..., Sequence]], together: bool = False,
) -> DataFrame:
    """``keep`` columns and the ``fields`` that a row function makes of the ``inputs``, one row for each row.

    ``make`` is called once a task and returns the row function, so tables it needs are built once. Nothing is
    gathered: a batch (see ``bound_batches``) is worked off row by row, or with ``together`` up to ``_ROWS`` rows at once, as one list for each input.
    """
    bound_batches(df.sparkSession)
    kept = df.select(*keep)
    names = [f"__in{i}" for i in range(len(inputs))]
    source = df.select(*keep, *[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(inputs, names, strict=True)])
    schema = T.StructType([*kept.schema.fields, *fields])
    width = len(kept.columns)

    def run(batches):
        work, arrow = make(), to_arrow_schema(schema)
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            values = [batch.column(width + i).to_pylist() for i in range(len(names))]
            made = work(*values) if together else [work(*row) for row in zip(*values, strict=True)]
            columns = list(zip(*made, strict=True)) if made else [()] * len(fields)
            arrays = [batch.column(i).cast(arrow.field(i).type) for i in range(width)]
            arrays += [pa.array(list(values), type=arrow.field(width + i).type) for i, values in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return source.mapInArrow(run, schema)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8: A-Z lower-cased, runs of digits, a-z and non-ASCII characters."""
    return [] if text is None else text.encode().lower().translate(_BLANKED).split()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; unsigned numpy integers wrap around."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of all words of a text, and of its runs of ``k`` words, in whole-array steps.

    A word is read as a polynomial over the bytes; prefix sums give every word at once.
    """

    def __init__(self):
        self._powers = np.ones(1, np.uint64)
        self._inverses = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self._powers) < n:
            with np.errstate(over="ignore"):
                size = max(n, 2 * len(self._powers), 1 << 16)
                for name, base in (("_powers", _MULTIPLIER), ("_inverses", _INVERSE)):
                    table = np.full(size, base, np.uint64)
                    table[0] = 1
                    setattr(self, name, np.multiply.accumulate(table))

    def words(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint64)
        raw = np.frombuffer(text.encode().lower().translate(_BLANKED), np.uint8)
        self._reach(len(raw) + 1)
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = raw != 32
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[::2], edges[1::2]
        with np.errstate(over="ignore"):
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self._powers[: len(raw)], out=sums[1:])
            return _mixed((sums[ends] - sums[starts]) * self._inverses[starts])

    def shingles(self, text: str | None, k: int) -> np.ndarray:
        """One hash for each run of ``k`` words; a text of fewer words, but at least one, has one run of them all."""
        words = self.words(text)
        if len(words) < k:
            k = len(words)
        if k == 0:
            return words
        with np.errstate(over="ignore"):
            total = np.full(len(words) - k + 1, np.uint64(k), np.uint64)
            for i in range(k):
                total = _mixed(total * np.uint64(_MULTIPLIER) + words[i : len(words) - k + 1 + i])
        return total
