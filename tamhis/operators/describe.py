"""Topic descriptions: keyword re-ranking, diverse keywords, names from a candidate list."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamhis.functions import text as tx
from tamhis.functions.vectors import array_of, as_array, as_vector, cosine
from tamhis.session import pin, small

CANDIDATES = 50
_HELD_VALUES = 1 << 23  # numbers in the sums of a task before they are given away: 64 MB
_OUT_ROWS = 4096


def _partial_means(batches):
    """``(term, vec, n)`` for each term of a run of documents: the mean vector of those that hold it, and how many they are."""
    arrow = pa.schema([("term", pa.string()), ("vec", pa.list_(pa.float64())), ("n", pa.int64())])

    def emit(places, sums, counts):
        means = sums[: len(places)] / counts[: len(places), None]
        offsets = np.arange(len(places) + 1, dtype=np.int32) * sums.shape[1]
        columns = [pa.array(list(places), pa.string()), pa.ListArray.from_arrays(offsets, means.ravel()), pa.array(counts[: len(places)].astype(np.int64))]
        whole = pa.RecordBatch.from_arrays(columns, schema=arrow)
        return (whole.slice(at, _OUT_ROWS) for at in range(0, whole.num_rows, _OUT_ROWS))

    places, sums, counts = {}, None, None
    for batch in batches:
        words, vecs = batch.column("terms"), batch.column("vec")
        for row in range(batch.num_rows):
            terms, vec = words[row].as_py(), vecs[row].values.to_numpy(zero_copy_only=False)
            if sums is None or sums.shape[1] != len(vec) or len(places) + len(terms) > len(sums):
                if places and (sums.shape[1] != len(vec) or len(places) + len(terms) > _HELD_VALUES // max(1, len(vec))):
                    yield from emit(places, sums, counts)
                    places, sums = {}, None
                size = max(len(places) + len(terms), min(max(2 * len(places), 1 << 10), _HELD_VALUES // max(1, len(vec))))
                grown, more = np.zeros((size, len(vec))), np.zeros(size)
                if places:
                    grown[: len(places)], more[: len(places)] = sums[: len(places)], counts[: len(places)]
                sums, counts = grown, more
            at = [places.setdefault(t, len(places)) for t in terms]  # a document's terms are distinct
            sums[at] += vec
            counts[at] += 1
    if places:
        yield from emit(places, sums, counts)


def term_vectors(df: DataFrame, text_col: str, terms: DataFrame, vec_col: str = "vec") -> DataFrame:
    """``(term, vec)``: mean vector of the documents that hold each listed term.

    Each task adds up the vectors of its documents by term, so a vector leaves it once for a term and not once for each document that
    holds the term; it holds ``_HELD_VALUES`` numbers at most before it gives them away. Only listed terms get past the join.
    """
    wanted = small(pin(terms.select("term").distinct()))
    rows = df.select(F.array_distinct(tx.word_tokens(text_col)).alias("terms"), array_of(df, vec_col).cast("array<double>").alias("vec"))
    sums = rows.where("vec IS NOT NULL AND size(terms) > 0").mapInArrow(_partial_means, "term string, vec array<double>, n bigint")
    # Dealt out first: grouped before the exchange, all rows of a task with their vectors would be sorted for nothing.
    met = sums.repartition("term").join(wanted, "term", "left_semi").select("term", as_vector("vec").alias("__v"), "n")
    return met.groupBy("term").agg(as_array(Summarizer.mean(F.col("__v"), F.col("n").cast("double"))).alias("vec"))


def _candidates(words: DataFrame, vectors: DataFrame, centres: DataFrame, by: str) -> DataFrame:
    topics = centres.select(F.col("topic").alias(by), "centroid")
    return words.join(vectors.select("term", "vec"), "term").join(topics, by)


def rerank_by_similarity(
    words: DataFrame, vectors: DataFrame, centres: DataFrame, n: int = 15, by: str = "topic"
) -> DataFrame:
    """``(topic, term, weight, rank)`` by the cosine of term vector and topic centre."""
    scored = _candidates(words, vectors, centres, by).select(
        by, "term", cosine(F.col("vec"), F.col("centroid")).alias("weight")
    )
    order = Window.partitionBy(by).orderBy(F.desc("weight"), F.asc("term"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mmr_pick(similar: np.ndarray, mutual: np.ndarray, n: int, diversity: float) -> list[int]:
    """Greedy maximal marginal relevance (Carbonell and Goldstein 1998) over a short candidate list."""
    if not len(similar):
        return []
    chosen = [int(np.argmax(similar))]
    left = [i for i in range(len(similar)) if i != chosen[0]]
    while left and len(chosen) < n:
        score = (1 - diversity) * similar[left] - diversity * mutual[np.ix_(left, chosen)].max(axis=1)
        chosen.append(left.pop(int(np.argmax(score))))
    return chosen


def diverse_terms(
    words: DataFrame, vectors: DataFrame, centres: DataFrame, n: int = 15, diversity: float = 0.3, by: str = "topic",
    candidates: int = CANDIDATES,
) -> DataFrame:
    """``(topic, term, weight, rank)``: terms near the topic yet unlike each other.

    ``words`` are ranked; the first ``candidates`` of a topic are weighed against each other, the caller's choice of
    how far down to look.
    """
    rows = _candidates(words.where(F.col("rank") <= candidates), vectors, centres, by)
    rows = rows.select(by, "term", F.col("vec").cast("array<double>"), F.col("centroid").cast("array<double>"))
    kind = rows.schema[by].dataType.simpleString()

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("term", ignore_index=True)
        v = np.stack(group["vec"].to_numpy())
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        c = np.asarray(group["centroid"].iloc[0])
        similar = v @ (c / max(np.linalg.norm(c), 1e-300))
        chosen = mmr_pick(np.round(similar, 9), np.round(v @ v.T, 9), n, diversity)
        return pd.DataFrame(
            {
                by: group[by].iloc[chosen].to_numpy(), "term": group["term"].iloc[chosen].to_numpy(),
                "weight": similar[chosen], "rank": np.arange(1, len(chosen) + 1, dtype="int32"),
            }
        )

    return rows.groupBy(by).applyInPandas(pick, f"{by} {kind}, term string, weight double, rank int")


def zero_shot_names(
    centres: DataFrame, names: DataFrame, threshold: float = 0.5, by: str = "topic"
) -> DataFrame:
    """``(topic, name, similarity)``: the nearest candidate name, or null below ``threshold``.

    ``names`` is the short candidate table ``(name, vec)``; it is folded into one array in the plan.
    """
    packed = names.agg(F.collect_list(F.struct("name", F.col("vec").cast("array<double>").alias("vec"))))
    rows = centres.select(F.col("topic").alias(by), "centroid", F.inline(packed.scalar()))
    scored = rows.select(by, "name", cosine(F.col("centroid"), F.col("vec")).alias("similarity"))
    order = Window.partitionBy(by).orderBy(F.desc("similarity"), F.asc("name"))
    best = scored.withColumn("__r", F.row_number().over(order)).where(F.col("__r") == 1)
    return best.select(by, F.when(F.col("similarity") >= threshold, F.col("name")).alias("name"), "similarity")


def describe_topics(
    words: DataFrame, vectors: DataFrame, centres: DataFrame, chain: Sequence[str], n: int = 15,
    diversity: float = 0.3, names: DataFrame | None = None, threshold: float = 0.5, by: str = "topic",
    candidates: int = CANDIDATES,
) -> DataFrame:
    """``(topic, term, weight, rank)`` after the chosen describers, in the listed order.

    ``keybert`` re-ranks, ``mmr`` spreads, ``zeroshot`` replaces the terms of a topic by a name when one is near
    enough. Names of describers are not case-sensitive.
    """
    out = words.select(by, "term", "weight", "rank")
    for step in (s.lower() for s in chain):
        if step == "keybert":
            out = rerank_by_similarity(out, vectors, centres, candidates, by)
        elif step == "mmr":
            out = diverse_terms(out, vectors, centres, n, diversity, by, candidates)
        elif step == "zeroshot":
            if names is None:
                raise ValueError("zeroshot needs a table of candidate names (name, vec)")
            named = zero_shot_names(centres, names, threshold, by).where(F.col("name").isNotNull())
            label = named.select(
                by, F.col("name").alias("term"), F.col("similarity").alias("weight"), F.lit(1).alias("rank")
            )
            out = out.join(named.select(by), by, "left_anti").select(*label.columns).unionByName(label)
        else:
            raise ValueError(f"unknown describer {step!r}; use keybert, mmr or zeroshot")
    return out.where(F.col("rank") <= n)
