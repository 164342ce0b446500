"""Topic coherence c_v (Roeder et al. 2015) over boolean sliding windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tamhis.functions import text as tx
from tamhis.operators.quality import ID
from tamhis.session import pin, small

EPSILON = 1e-12
SPOTS, CELLS = 1 << 14, 1 << 20  # places of words that are worked off at once, and sums that are held for them


def pair_windows(
    df: DataFrame, text_col: str, words: DataFrame, window: int = 110, by: str = "topic", id_col: str = ID
) -> DataFrame:
    """``(topic, i, j, windows)``: how many windows hold both words of a topic, by their places ``i <= j`` (rank less 1); ``i = j`` is one word alone.

    Windows are not exploded. A window belongs to the first place of either word in it, so each two places less than ``window`` apart
    own one run of window starts: after the earlier places of both words, up to the nearer of the two. The lengths of these runs add up
    to the number of windows, whatever the number of words. The places of listed words are one row for each document and topic, and a task
    adds up the runs of many such rows as arrays, so that pairs of places are never rows.
    """
    tokens = tx.with_tokens(df, [id_col], tx.word_tokens(text_col)).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    spots = tokens.select(id_col, last.alias("last"), F.posexplode("w").alias("pos", "term"))
    listed = words.select(F.col(by).alias("topic"), "term", (F.col("rank") - 1).cast("int").alias("bit"))
    met = spots.join(small(listed), "term")
    # A text's places are still together here, so they are one row before the exchange.
    spot = F.shiftleft(F.col("pos").cast("bigint"), 32) + F.col("bit")
    packed = met.groupBy(id_col, "topic").agg(F.collect_list(spot).alias("spots"), F.collect_list("last").alias("last"))
    kind = listed.schema["topic"].dataType
    schema = T.StructType([T.StructField("topic", kind), *[T.StructField(x, T.IntegerType()) for x in "ij"], T.StructField("windows", T.LongType())])
    runs = packed.select("topic", "spots", "last").mapInArrow(_runs(window, to_arrow_schema(schema)), schema)
    places = [f("i", "j").alias(x) for f, x in ((F.least, "i"), (F.greatest, "j"))]
    return runs.groupBy("topic", *places).agg(F.sum("windows").alias("windows"))


def _runs(window: int, schema: pa.Schema):
    """Arrow batches of ``(topic, spots, last)``, a spot being place and bit in one number, to summed ``(topic, i, j, windows)``."""
    def work(batches):
        for batch in batches:
            if batch.num_rows:
                yield summed(batch)

    def summed(batch):
        topics = batch.column("topic").dictionary_encode(null_encoding="encode")
        sizes = batch.column("spots").value_lengths().to_numpy(zero_copy_only=False)
        spots = batch.column("spots").flatten().to_numpy(zero_copy_only=False)
        bits = int((spots & 0xFFFFFFFF).max()) + 1
        total = Sums(len(topics.dictionary) * bits * bits)
        topic = topics.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        last = batch.column("last").flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        # Whole rows of about SPOTS places at once.
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], SPOTS), "right"), len(ends)))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            at = slice(ends[low] - sizes[low], ends[high - 1])
            count(np.repeat(np.arange(low, high), sizes[low:high]), spots[at], last[at], topic, bits, total)
        codes, windows = total.found()
        columns = [topics.dictionary.take(pa.array(codes // (bits * bits))), pa.array(codes // bits % bits), pa.array(codes % bits), pa.array(windows.astype(np.int64))]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def count(owner, spots, last, topic, bits, total):
        order = np.lexsort((spots, owner))
        owner, pos, bit = owner[order], (spots >> 32)[order], (spots & 0xFFFFFFFF)[order]
        until = np.minimum(pos, last[order]) + 1
        free = np.zeros(len(pos), np.int64)
        by_bit = np.lexsort((pos, bit, owner))
        again = (owner[by_bit[1:]] == owner[by_bit[:-1]]) & (bit[by_bit[1:]] == bit[by_bit[:-1]])
        free[by_bit[1:][again]] = pos[by_bit[:-1][again]] + 1
        reach = np.maximum(free, pos - (window - 1))
        place = owner * (1 << 32) + pos  # those of two rows are never near each other
        first = (topic[owner] * bits + bit) * bits
        for step in range(len(pos)):
            one, two = slice(0, len(pos) - step), slice(step, None)
            gap = place[two] - place[one]
            near = gap < window
            if not near.any():
                break
            n = np.maximum(until[one] - np.maximum(free[one], reach[two]), 0) * near
            if step:
                n[gap == 0] *= 2  # two words at one place are each before the other
            total.add(first[one] + bit[two], n)

    return work


class Sums:
    """Sums by a code below ``size``: as one array, or sorted by code if that were longer than ``CELLS``."""

    def __init__(self, size: int):
        self._dense = np.zeros(size) if size <= CELLS else None
        self._held, self._waiting = [], 0

    def add(self, codes: np.ndarray, n: np.ndarray) -> None:
        if self._dense is not None:
            self._dense += np.bincount(codes, n, len(self._dense))
            return
        self._held.append((codes[n > 0], n[n > 0]))
        self._waiting += len(self._held[-1][0])
        if self._waiting > CELLS:
            self._merge()

    def _merge(self) -> None:
        codes, place = np.unique(np.concatenate([c for c, _ in self._held]), return_inverse=True)
        self._held, self._waiting = [(codes, np.bincount(place, np.concatenate([n for _, n in self._held])))], 0

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        if self._dense is not None:
            codes = np.flatnonzero(self._dense)
            return codes, self._dense[codes]
        if not self._held:
            return np.zeros(0, np.int64), np.zeros(0)
        self._merge()
        return self._held[0]


def coherence_by_topic(
    df: DataFrame, text_col: str, words: DataFrame, n: int = 15, window: int = 110, by: str = "topic", id_col: str = ID
) -> DataFrame:
    """``(topic, coherence)`` for ``words (topic, term, rank)`` with ranks 1 to ``n``, any number of them.

    The measure compares each word with all words of its topic, so a row per pair of them is made.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    # Both tables are used several times: a row per topic word, and a row per pair of them.
    words = pin(words.where(F.col("rank") <= n))
    size = F.size("w")
    total = tx.with_tokens(df, [], tx.word_tokens(text_col)).where(size > 0).agg(
        F.sum(F.greatest(size - (window - 1), F.lit(1))).cast("double").alias("total")
    )
    counted = pair_windows(df, text_col, words, window, by, id_col).select("topic", "i", "j", F.col("windows").cast("double").alias("c"))
    counted = pin(counted)
    pairs = counted.unionByName(counted.where("i <> j").select("topic", F.col("j").alias("i"), F.col("i").alias("j"), "c"))
    ranks = words.select(F.col(by).alias("topic"), (F.col("rank") - 1).alias("i"))
    most = ranks.groupBy("topic").agg(F.max("i").alias("m"))
    grid = ranks.join(most, "topic").select("topic", "i", F.explode(F.sequence(F.lit(0), "m")).alias("j"))
    alone = pairs.where("i = j")
    n_all = total.scalar()
    cells = (
        grid.join(pairs, ["topic", "i", "j"], "left")
        .join(alone.select("topic", "i", F.col("c").alias("ci")), ["topic", "i"], "left")
        .join(alone.select("topic", F.col("j"), F.col("c").alias("cj")), ["topic", "j"], "left")
        .withColumn("p", F.coalesce("c", F.lit(0.0)) / n_all)
        .withColumn("pp", (F.col("ci") / n_all) * (F.col("cj") / n_all))
    )
    joint = F.col("p") + EPSILON
    npmi = F.when(F.col("pp") > 0, F.log(joint / F.col("pp")) / -F.log(joint)).otherwise(0.0)
    cells = cells.select("topic", "i", "j", npmi.alias("v"))
    whole = cells.groupBy("topic", "j").agg(F.sum("v").alias("s"))
    per_word = cells.join(whole, ["topic", "j"]).groupBy("topic", "i").agg(
        F.sum(F.col("v") * F.col("s")).alias("vs"),
        F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("nv"),
        F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("ns"),
    )
    size = F.col("nv") * F.col("ns")
    cosine = F.when(size > 0, F.col("vs") / size).otherwise(0.0)
    return per_word.groupBy(F.col("topic").alias(by)).agg(F.avg(cosine).alias("coherence"))


def coherence(df: DataFrame, text_col: str, words: DataFrame, **options) -> DataFrame:
    """``(metric, value)``: mean c_v over the topics."""
    rows = coherence_by_topic(df, text_col, words, **options)
    return rows.agg(F.avg("coherence").alias("value")).select(F.lit("coherence_cv").alias("metric"), "value")
