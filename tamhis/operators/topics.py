"""Topic tables: centres, nearest-centre assignment, sizes, merging and probabilities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamhis.functions.vectors import array_of, as_array, as_vector
from tamhis.operators.clusters import NOISE
from tamhis.operators.neighbors import PLACES, nearest_exact
from tamhis.operators.quality import ID
from tamhis.session import pin, small

CENTRE_VALUES = 1 << 22  # numbers a task may hold for all centres: 32 MB
MAX_TOPICS = 4096  # topics whose pair table may be held on the driver


def centroids(df: DataFrame, topic_col: str = "topic", vec_col: str = "vec") -> DataFrame:
    """``(topic, centroid)``: mean vector per topic, summed in each task before the shuffle; noise left out."""
    rows = df.where(F.col(topic_col).cast("string") != str(NOISE))
    rows = rows.select(F.col(topic_col).alias("topic"), as_vector(array_of(df, vec_col)).alias("__v"))
    return rows.groupBy("topic").agg(as_array(Summarizer.mean(F.col("__v"))).alias("centroid"))


def _collect(centres: DataFrame):
    """Ids and matrix of the centres, or ``None`` when they are too many for one task."""
    dims = centres.select(F.size("centroid").alias("d")).first()
    if dims is None:
        raise ValueError("no centres to assign to")
    limit = max(1, CENTRE_VALUES // max(1, dims["d"]))
    rows = centres.limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    rows.sort(key=lambda r: r["topic"])
    return np.array([r["topic"] for r in rows]), np.array([r["centroid"] for r in rows], dtype=float)


def _distance_rows(vecs: pd.Series, matrix: np.ndarray) -> np.ndarray:
    x = np.stack(vecs.to_numpy()).astype(float)
    squares = (x * x).sum(1)[:, None] - 2.0 * (x @ matrix.T) + (matrix * matrix).sum(1)
    return np.sqrt(np.maximum(squares, 0.0))


def nearest_centroid(
    df: DataFrame, centres: DataFrame, vec_col: str = "vec", out: str = "topic", id_col: str = ID
) -> DataFrame:
    """Add the id of the nearest centre and the ``distance`` to it; ties go to the smaller id.

    Centres below a size bound travel with the tasks and no row moves. Beyond it the rows meet the centres
    block by block.
    """
    held = _collect(centres)
    kept = [c for c in df.columns if c not in (out, "distance")]
    if held is None:
        left = df.select(F.col(id_col).alias("id"), array_of(df, vec_col).alias("vec"))
        right = centres.select(F.col("topic").cast("bigint").alias("id"), F.col("centroid").alias("vec"))
        best = nearest_exact(left, right, 1, "euclidean").select(F.col("left_id").alias(id_col), F.col("right_id").alias("__at"))
        met = df.join(best, id_col, "left").join(right.select(F.col("id").alias("__at"), F.col("vec").alias("__c")), "__at", "left")
        squares = F.zip_with(array_of(df, vec_col), "__c", lambda a, b: (a - b) * (a - b))
        far = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))
        return met.select(*kept, F.col("__at").cast("int").alias(out), far.alias("distance"))
    ids, matrix = held
    step = max(1, 4_000_000 // len(ids))

    @F.pandas_udf("topic int, distance double")
    def nearest(vecs: pd.Series) -> pd.DataFrame:
        best, far = [], []
        for start in range(0, len(vecs), step):
            own = vecs.iloc[start : start + step]
            # Rounded for the choice alone, as in the block way, so that both break ties alike.
            place = np.round(_distance_rows(own, matrix), PLACES).argmin(axis=1)
            best.append(ids[place])
            far.append(np.sqrt(((np.stack(own.to_numpy()).astype(float) - matrix[place]) ** 2).sum(axis=1)))
        if not best:
            return pd.DataFrame({"topic": [], "distance": []})
        return pd.DataFrame({"topic": np.concatenate(best).astype("int32"), "distance": np.concatenate(far)})

    found = df.select(*kept, nearest(array_of(df, vec_col)).alias("__n"))
    return found.select(*kept, F.col("__n.topic").alias(out), F.col("__n.distance").alias("distance"))


def topic_probabilities(
    df: DataFrame, centres: DataFrame, vec_col: str = "vec", out: str = "probabilities"
) -> DataFrame:
    """Add an array of ``exp(-distance)`` shares per topic, in the order of the topic ids; it sums to 1."""
    held = _collect(centres)
    if held is None:
        raise ValueError("too many topics for one probability array per row; reduce the topics first")
    _, matrix = held

    @F.pandas_udf("array<double>")
    def shares(vecs: pd.Series) -> pd.Series:
        if not len(vecs):
            return pd.Series([], dtype=object)
        d = _distance_rows(vecs, matrix)
        weight = np.exp(d.min(axis=1, keepdims=True) - d)
        return pd.Series(list(weight / weight.sum(axis=1, keepdims=True)))

    return df.withColumn(out, shares(array_of(df, vec_col)))


def topic_sizes(df: DataFrame, topic_col: str = "topic") -> DataFrame:
    """``(topic, n)``."""
    return df.groupBy(F.col(topic_col).alias("topic")).agg(F.count(F.lit(1)).alias("n"))


def apply_min_size(df: DataFrame, min_size: int, topic_col: str = "topic") -> DataFrame:
    """Topics with fewer than ``min_size`` documents become noise (-1)."""
    big = small(pin(topic_sizes(df, topic_col).where(F.col("n") >= min_size).select(F.col("topic").alias("__big"))))
    return df.join(big, F.col(topic_col) == F.col("__big"), "left").select(
        *[
            F.coalesce("__big", F.lit(NOISE)).cast(df.schema[topic_col].dataType).alias(topic_col)
            if c == topic_col else F.col(c)
            for c in df.columns
        ]
    )


def size_order(sizes: DataFrame) -> dict[int, int]:
    """Old topic id to new: 0 for the largest; noise stays -1."""
    rows = sizes.where(F.col("topic") != NOISE).limit(MAX_TOPICS + 1).collect()
    if len(rows) > MAX_TOPICS:
        raise ValueError(f"more than {MAX_TOPICS} topics; raise the minimum size")
    ranked = sorted(rows, key=lambda r: (-r["n"], r["topic"]))
    return {NOISE: NOISE, **{r["topic"]: i for i, r in enumerate(ranked)}}


def rename_topics(df: DataFrame, names: dict[int, int], topic_col: str = "topic") -> DataFrame:
    """Map topic ids by a small table held in the plan."""
    table = F.create_map(*[F.lit(int(v)) for pair in names.items() for v in pair])
    return df.withColumn(topic_col, F.coalesce(table[F.col(topic_col)], F.lit(NOISE)).cast("int"))


def merge_tree(similarity: DataFrame, sizes: DataFrame, wanted: int | None = None) -> list[tuple[int, int, float]]:
    """``(kept, gone, similarity)`` of every merge of the topics, by falling similarity; one row fewer than topics at most.

    The similarity of two groups is the mean over their pairs of topics, weighted by size; a pair without a row counts as 0. Rounds of reciprocal
    nearest pairs: each group picks its best partner, and all pairs that pick each other merge at once. As a merged group is never more similar to a
    third than the better of its parts, these are the merges of taking the best pair each time. Equally similar pairs are ordered by a hash of their
    ids, so that a chain of them takes few rounds. Rounds end once ``wanted`` merges are better than all that are left. The table of pairs stays in
    Spark; the merges reach the driver.
    """
    weights = pin(sizes.where(F.col("topic") != NOISE).select(F.col("topic").alias("id"), F.col("n").cast("double").alias("w")))
    known = lambda side: weights.select(F.col("id").alias(side), F.col("w").alias(f"w{side}"))
    once = similarity.where("t1 <> t2").select(F.least("t1", "t2").alias("a"), F.greatest("t1", "t2").alias("b"), F.col("cosine").alias("s"))
    once = once.groupBy("a", "b").agg(F.first("s").alias("s")).join(known("a"), "a").join(known("b"), "b")
    pairs = pin(once.select("a", "b", (F.col("s") * F.col("wa") * F.col("wb")).alias("total")))
    merges: list[tuple[int, int, float]] = []
    while True:
        rated = pairs.join(known("a"), "a").join(known("b"), "b").select("a", "b", (F.col("total") / F.col("wa") / F.col("wb")).alias("s"))
        ends = rated.select("a", "b", "s", F.explode(F.array("a", "b")).alias("id"))
        best = ends.groupBy("id").agg(F.max(F.struct("s", F.xxhash64("a", "b").alias("tie"), "a", "b")).alias("x"))
        mutual = pin(best.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(F.col("x.a").alias("kept"), F.col("x.b").alias("gone"), "x.s"))
        found = [(r["kept"], r["gone"], r["s"]) for r in mutual.collect()]
        top = max((m[2] for m in found), default=None)
        if top is None or (wanted is not None and sum(m[2] > top for m in merges) >= wanted):
            return sorted(merges, key=lambda m: (-m[2], m[0], m[1]))
        merges += found
        names = mutual.select("gone", "kept")

        def renamed(df, column):
            return df.join(names, F.col(column) == F.col("gone"), "left").withColumn(column, F.coalesce("kept", column)).drop("gone", "kept")

        moved = renamed(renamed(pairs, "a"), "b").where("a <> b")
        moved = moved.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.sum("total").alias("total"))
        pairs = pin(moved.select(F.col("x").alias("a"), F.col("y").alias("b"), "total"))
        weights = pin(renamed(weights, "id").groupBy("id").agg(F.sum("w").alias("w")))


def reduce_topics(similarity: DataFrame, sizes: DataFrame, n_topics: int) -> dict[int, int]:
    """Merge list ``old -> new`` that leaves ``n_topics`` topics; noise is kept apart.

    ``similarity`` is ``(t1, t2, cosine)`` between topics, a pair once or in both directions. The best merges of ``merge_tree`` are taken; topics that
    are similar to none merge last, smallest ids first. A group has the smallest id of its topics. The driver holds one entry for each topic.
    """
    ids = sorted(r["topic"] for r in sizes.where(F.col("topic") != NOISE).select("topic").collect())
    owner = {t: t for t in ids}

    def root(t):
        while owner[t] != t:
            owner[t] = owner[owner[t]]
            t = owner[t]
        return t

    spare = len(ids) - max(n_topics, 1)
    merges = merge_tree(similarity, sizes, spare)[:spare] if spare > 0 else []
    for kept, gone, _ in merges:
        a, b = sorted((root(kept), root(gone)))
        owner[b] = a
    apart = [t for t in ids if owner[t] == t]
    for t in apart[1 : 1 + max(spare - len(merges), 0)]:
        owner[t] = apart[0]
    return {NOISE: NOISE, **{t: root(t) for t in ids}}


def majority_label(df: DataFrame, topic_col: str = "topic", label_col: str = "label") -> DataFrame:
    """``(topic, label)``: the most frequent label per topic; ties go to the smaller label, rows without one do not count."""
    known = df.where(F.col(label_col).isNotNull())
    counts = known.groupBy(F.col(topic_col).alias("topic"), F.col(label_col).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.groupBy("topic").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))

