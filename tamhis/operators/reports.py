"""Report tables: the data behind each figure."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tamhis.functions import text as tx
from tamhis.functions.vectors import as_array
from tamhis.operators.quality import ID
from tamhis.operators.terms import term_idf, top_terms
from tamhis.operators.topics import MAX_TOPICS
from tamhis.operators.vectors import reduction_stages
from tamhis.session import pin, small

GRAM_BLOCK = 1024
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16(), "double": pa.float64()}


def topic_products(weights: DataFrame, by: str = "topic") -> DataFrame:
    """``(t1, t2, product)``: dot products of the topics' term weights, t1 <= t2, zeros left out.

    Each task adds the outer products of its terms in topic-by-topic blocks and sends the sums on, so no pair is
    ever emitted per term. A task that meets more than ``GRAM_BLOCK`` topics works block against block.
    """
    kind = weights.schema[by].dataType.simpleString()
    cells = F.collect_list(F.struct(F.col(by).alias("t"), F.col("weight").alias("w"))).alias("cells")
    per_term = weights.groupBy("term").agg(cells).select("cells.t", "cells.w")
    parts = per_term.mapInArrow(_gram(_ARROW[kind]), f"t1 {kind}, t2 {kind}, product double")
    pairs = parts.groupBy(F.least("t1", "t2").alias("t1"), F.greatest("t1", "t2").alias("t2"))
    return pairs.agg(F.sum("product").alias("product"))


def _gram(kind: pa.DataType):
    def emit(rows, cols, block, same):
        i, j = np.nonzero(np.triu(block) if same else block)
        return pa.RecordBatch.from_arrays(
            [rows.take(pa.array(i)), cols.take(pa.array(j)), pa.array(block[i, j])], names=["t1", "t2", "product"]
        )

    def add(batches):
        held, total = pa.array([], kind), np.zeros((0, 0))
        for batch in batches:
            cells = batch.column("w")
            owner = np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy(zero_copy_only=False))
            weight = cells.flatten().to_numpy(zero_copy_only=False)
            topics = batch.column("t").flatten().cast(kind)
            new = pa.concat_arrays([held, topics.unique()]).unique()
            if len(new) <= GRAM_BLOCK:
                grown = np.zeros((len(new), len(new)))
                grown[: len(held), : len(held)] = total
                held, total = new, grown
                total += _outer(owner, topics, weight, held, held, len(cells))
                continue
            met = topics.unique()
            blocks = [met.slice(i, GRAM_BLOCK) for i in range(0, len(met), GRAM_BLOCK)]
            for a, rows in enumerate(blocks):
                for b, cols in enumerate(blocks[a:]):
                    yield emit(rows, cols, _outer(owner, topics, weight, rows, cols, len(cells)), b == 0)
        if len(held):
            yield emit(held, held, total, True)

    return add


def _outer(owner, topics, weight, rows, cols, terms: int) -> np.ndarray:
    """Sum over terms of the outer products of their topic weights, for one block of topics."""
    at_row = pc.index_in(topics, value_set=rows).fill_null(-1).to_numpy(zero_copy_only=False)
    at_col = pc.index_in(topics, value_set=cols).fill_null(-1).to_numpy(zero_copy_only=False)
    total = np.zeros((len(rows), len(cols)))
    for start in range(0, terms, 2048):
        lo, hi = np.searchsorted(owner, [start, start + 2048])
        left = _spread(owner[lo:hi] - start, at_row[lo:hi], weight[lo:hi], len(rows))
        right = _spread(owner[lo:hi] - start, at_col[lo:hi], weight[lo:hi], len(cols))
        total += left.T @ right
    return total


def _spread(term: np.ndarray, place: np.ndarray, weight: np.ndarray, width: int) -> np.ndarray:
    """Dense term-by-topic block from cells; a place of -1 is outside the block."""
    block = np.zeros((2048, width))
    held = place >= 0
    block[term[held], place[held]] = weight[held]
    return block


def topic_similarity(weights: DataFrame, by: str = "topic") -> DataFrame:
    """``(t1, t2, cosine)`` in both orders, for topics that share a term."""
    products = pin(topic_products(weights, by))
    own = products.where("t1 = t2").select("t1", F.sqrt("product").alias("size"))
    one, two = own.select("t1", F.col("size").alias("s1")), own.select(F.col("t1").alias("t2"), F.col("size").alias("s2"))
    half = products.join(one, "t1").join(two, "t2")
    half = half.select("t1", "t2", (F.col("product") / (F.col("s1") * F.col("s2"))).alias("cosine"))
    turned = half.where("t1 <> t2").select(F.col("t2").alias("t1"), F.col("t1").alias("t2"), "cosine")
    return half.unionByName(turned)


def term_decline(weights: DataFrame, by: str = "topic", n: int = 15) -> DataFrame:
    """``(topic, rank, weight)`` of the heaviest terms."""
    return top_terms(weights, by, n).select(by, "rank", "weight")


def topic_words(weights: DataFrame, by: str = "topic", n: int = 5) -> DataFrame:
    """``(topic, words)``: the heaviest terms in order, joined by commas."""
    cells = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return top_terms(weights, by, n).groupBy(by).agg(
        F.array_join(F.transform(cells, lambda c: c["term"]), ", ").alias("words")
    )


def topic_map(weights: DataFrame, sizes: DataFrame, by: str = "topic") -> DataFrame:
    """``(topic, x, y, size, words)``: topics on the two main axes of their term weights.

    The axes come from the topic-by-topic products, which have the same spectrum as the far larger term table.
    """
    rows = topic_products(weights, by).collect()
    ids = sorted({r["t1"] for r in rows} | {r["t2"] for r in rows})
    if len(ids) > MAX_TOPICS:
        raise ValueError(f"more than {MAX_TOPICS} topics on one map; reduce the topics first")
    place = {t: i for i, t in enumerate(ids)}
    gram = np.zeros((len(ids), len(ids)))
    for r in rows:
        gram[place[r["t1"]], place[r["t2"]]] = gram[place[r["t2"]], place[r["t1"]]] = r["product"]
    points = principal_axes(gram, 2)
    table = weights.sparkSession.createDataFrame(
        [(t, float(points[i, 0]), float(points[i, 1])) for t, i in place.items()],
        f"{by} {weights.schema[by].dataType.simpleString()}, x double, y double",
    )
    named = sizes.select(F.col("topic").alias(by), F.col("n").alias("size"))
    return table.join(named, by, "left").join(topic_words(weights, by), by, "left").select(by, "x", "y", "size", "words")


def principal_axes(gram: np.ndarray, dims: int) -> np.ndarray:
    """Coordinates on the main axes from a matrix of dot products; the largest entry of an axis is positive."""
    n = len(gram)
    centred = gram - gram.mean(0) - gram.mean(1)[:, None] + gram.mean() if n else gram
    values, axes = np.linalg.eigh(centred) if n else (np.zeros(0), np.zeros((0, 0)))
    points = np.zeros((n, dims))
    for d, i in enumerate(np.argsort(values)[::-1][:dims]):
        axis = axes[:, i] * np.sqrt(max(values[i], 0.0))
        points[:, d] = axis if axis[np.argmax(np.abs(axis))] >= 0 else -axis
    return points


def document_map(df: DataFrame, vec_col: str = "vec", topic_col: str = "topic", id_col: str = ID) -> DataFrame:
    """``(doc_id, x, y, topic)``: documents on the two main axes of an ML vector column."""
    model = Pipeline(stages=reduction_stages("pca", 2, vec_col, "__xy")).fit(df)
    xy = as_array("__xy")
    return model.transform(df).select(id_col, xy[0].alias("x"), xy[1].alias("y"), F.col(topic_col).alias("topic"))


def topic_distribution(
    df: DataFrame, text_col: str, weights: DataFrame, window: int = 4, by: str = "topic", id_col: str = ID
) -> DataFrame:
    """``(doc_id, topic, share)``: similarity of token windows to topics, summed and scaled to 1.

    The cosine of a window and a topic is linear in the topic's unit weights once the window's own length is
    known, and that length depends on the tokens of the row only. So each token position gets one number, the
    sum of ``1 / length`` over the windows that hold it, and a text leaves its row as one number per term:
    windows themselves are never exploded. Holds for non-negative weights and no similarity threshold.
    """
    tokens = tx.with_tokens(df, [id_col], tx.word_tokens(text_col)).where(F.size("w") > 0)
    schema = T.StructType([tokens.schema[id_col], tokens.schema["w"], T.StructField("c", T.ArrayType(T.DoubleType()))])
    spread = tokens.mapInArrow(_window_parts(window, to_arrow_schema(schema)), schema)
    cells = spread.select(id_col, F.inline(F.arrays_zip(F.col("w").alias("term"), F.col("c").alias("c"))))
    sizes = weights.groupBy(by).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("__size"))
    unit = weights.join(sizes, by).select("term", F.struct(F.col(by).alias("topic"), (F.col("weight") / F.col("__size")).alias("u")).alias("cell"))
    # While the weights fit into memory no token leaves its task; the sums per text are then combined in place.
    table = small(pin(unit.groupBy("term").agg(F.collect_list("cell").alias("cells"))))
    met = cells.join(table, "term").select(id_col, "c", F.inline("cells"))
    sums = met.groupBy(id_col, "topic").agg(F.sum(F.col("c") * F.col("u")).alias("s"))
    whole = F.sum("s").over(Window.partitionBy(id_col))
    return sums.select(id_col, F.col("topic").alias(by), F.coalesce(F.try_divide("s", whole), F.lit(0.0)).alias("share"))


def _window_parts(window: int, schema: pa.Schema):
    """Arrow batches of ``(id, tokens)`` to ``(id, terms, numbers)``: for each term the sum of ``1 / length`` over its places and the windows that hold them.

    The squared length of the count vector of a window is the number of equal ordered pairs of its tokens.
    """
    def ahead(values, by):
        return np.concatenate([values[by:], np.zeros(min(by, len(values)), values.dtype)])

    def work(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            terms, word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            starts = np.cumsum(sizes) - sizes
            place = np.arange(len(word)) - starts[owner]
            square = np.minimum(sizes, window)[owner].astype(float)
            for gap in range(1, window):
                equal = np.zeros(len(word), bool)
                equal[:-gap] = (word[gap:] == word[:-gap]) & (owner[gap:] == owner[:-gap])
                for step in range(window - gap):
                    square += 2 * ahead(equal, step)
            inverse = np.where(place < np.maximum(sizes - (window - 1), 1)[owner], 1.0 / np.sqrt(square), 0.0)
            total = inverse.copy()
            for back in range(1, window):
                total[back:] += np.where(place[back:] >= back, inverse[:-back], 0.0)
            # A term that a text repeats is one number.
            codes, at = np.unique(owner * max(1, len(terms)) + word, return_inverse=True)
            offsets = pa.array(np.searchsorted(codes, np.arange(len(sizes) + 1) * max(1, len(terms))).astype(np.int32))
            parts = [terms.take(pa.array(codes % max(1, len(terms)))), pa.array(np.bincount(at, total, len(codes)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(offsets, x) for x in parts)], names=schema.names).cast(schema)

    return work


def topics_per_class(
    df: DataFrame, text_col: str, class_col: str, topic_col: str = "topic", n: int = 5, stop_words=(),
    form: str = "bm25", damp: bool = True, id_col: str = ID,
) -> DataFrame:
    """``(class, topic, words, freq)``: documents and heaviest words of each topic inside each class.

    Term shares are taken inside (class, topic); the idf comes from all topics together.
    """
    from tamhis.operators.terms import count_terms

    keyed = df.where(F.col(class_col).isNotNull() & F.col(topic_col).isNotNull())
    keys = ["class", "topic"]
    named = keyed.select(id_col, F.col(class_col).alias("class"), F.col(topic_col).alias("topic"), F.col(text_col).alias("text"))
    counts = count_terms(named, "text", keys, stop_words)
    by_topic = counts.groupBy("topic").agg(F.sum("n").cast("double").alias("m"))
    mean = by_topic.agg(F.avg("m")).scalar()
    group_n = counts.groupBy(*keys).agg(F.sum("n").cast("double").alias("__group_n"))
    term_n = F.sum("n").over(Window.partitionBy("term")).cast("double")
    weighted = counts.withColumn("__term_n", term_n).join(group_n, keys)
    share = F.col("n").cast("double") / F.col("__group_n")
    tf = F.sqrt(share) if damp else share
    weights = weighted.select(*keys, "term", (tf * term_idf(F.col("__term_n"), mean, form)).alias("weight"))
    cells = F.array_sort(F.collect_list(F.struct("rank", "term")))
    words = top_terms(weights, keys, n).groupBy(*keys).agg(
        F.array_join(F.transform(cells, lambda c: c["term"]), ", ").alias("words")
    )
    freq = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("freq"))
    return freq.join(words, keys, "left").select("class", "topic", F.coalesce("words", F.lit("")).alias("words"), "freq")
