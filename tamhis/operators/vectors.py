"""Document vectors and their reduction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    PCA, IDF, HashingTF, Normalizer, RegexTokenizer, StandardScaler, Word2Vec, Word2VecModel,
)
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.functions import fixed
from tamhis.functions import text as tx
from tamhis.functions.vectors import as_vector
from tamhis.operators.quality import ID
from tamhis.session import small


WORD_PARTITIONS = 64  # tasks that train word vectors; Spark's own default is one task for the whole corpus


def tokenizer(text_col: str, out: str = "__tokens") -> RegexTokenizer:
    return RegexTokenizer(
        inputCol=text_col, outputCol=out, pattern=r"[\p{L}\p{N}_]{2,}", gaps=False, toLowercase=True
    )


def sentence_stages(text_col: str, method: str = "hashed", dims: int = 256, out: str = "vec", min_count: int = 5):
    """ML stages from text to a unit vector: ``hashed`` TF-IDF or the mean of ``word2vec`` vectors."""
    if method == "hashed":
        middle = [
            HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=dims),
            IDF(inputCol="__tf", outputCol="__raw"),
        ]
    elif method == "word2vec":
        middle = [
            Word2Vec(
                inputCol="__tokens", outputCol="__raw", vectorSize=dims, minCount=min_count, seed=fixed.SEED,
                numPartitions=WORD_PARTITIONS,
            )
        ]
    else:
        raise ValueError(f"unknown vector method {method!r}; use 'hashed' or 'word2vec'")
    return [tokenizer(text_col), *middle, Normalizer(inputCol="__raw", outputCol=out)]


def fit_sentence_vectors(df: DataFrame, text_col: str, **options) -> PipelineModel:
    return Pipeline(stages=sentence_stages(text_col, **options)).fit(df)


def external_vectors(
    df: DataFrame, text_col: str, make_predict_fn: Callable, batch_size: int = 64, out: str = "vec"
) -> DataFrame:
    """Vectors from a user's own model, loaded once per Python worker and fed in Arrow batches."""
    encode = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(out, encode(text_col))


def fit_word_vectors(df: DataFrame, text_col: str, dims: int = 32, min_count: int = 5) -> Word2VecModel:
    tokens = df.select(tx.word_tokens(text_col).alias("__tokens"))
    return Word2Vec(
        inputCol="__tokens", outputCol="__raw", vectorSize=dims, minCount=min_count, seed=fixed.SEED,
        numPartitions=WORD_PARTITIONS,
    ).fit(tokens)


def word_position_vectors(
    df: DataFrame, text_col: str, word_vectors: DataFrame, dims: int, max_length: int = 30, id_col: str = ID
) -> DataFrame:
    """``(doc_id, vec)``: vectors of the first ``max_length`` tokens laid end to end, zeros elsewhere.

    ``word_vectors`` is a stored or pinned table ``(word, vec array)``. Only ``max_length`` tokens of a text leave its row; the width is
    always ``max_length * dims``.
    """
    head = F.slice(tx.word_tokens(text_col), 1, max_length)
    rows = df.select(id_col, F.posexplode_outer(head).alias("pos", "word")).join(small(word_vectors), "word", "left")
    known = F.when(F.col("vec").isNotNull(), F.struct("pos", F.col("vec").cast("array<double>").alias("vec")))
    # Dealt out first: grouped before the exchange, the rows of a task would be sorted with their vectors, and no row would be saved.
    packed = rows.repartition(id_col).groupBy(id_col).agg(F.array_sort(F.collect_list(known)).alias("cells"))
    # Cells are ordered by position; missing positions are filled from a map of the few known ones.
    table = F.map_from_entries("cells")
    zeros = F.array_repeat(F.lit(0.0), dims)
    places = F.sequence(F.lit(0), F.lit(max_length - 1))
    return packed.select(id_col, table.alias("t")).select(
        id_col, F.flatten(F.transform(places, lambda i: F.coalesce(F.element_at("t", i), zeros))).alias("vec")
    )


def with_first_token(df: DataFrame, text_col: str, word_vectors: DataFrame, dims: int, out: str = "vec") -> DataFrame:
    """Add the vector of the first token as an ML vector, zeros without a known one; rows and their order of columns stay.

    ``word_vectors`` is a stored or pinned table ``(word, vec array)`` with one row a word.
    """
    table = small(word_vectors.select(F.col("word").alias("__word"), F.col("vec").cast("array<double>").alias("__word_vec")))
    met = df.join(table, F.get(tx.word_tokens(text_col), F.lit(0)) == F.col("__word"), "left")
    return met.withColumn(out, as_vector(F.coalesce("__word_vec", F.array_repeat(F.lit(0.0), dims)))).drop("__word", "__word_vec")


def first_token_vectors(position_vectors: DataFrame, dims: int, id_col: str = ID) -> DataFrame:
    """The vector of the first token, frozen: a feature column that no training changes."""
    return position_vectors.select(id_col, F.slice("vec", 1, dims).alias("vec"))


def reduction_stages(method: str | None, dims: int, vec_col: str = "vec", out: str = "reduced"):
    """Stages that reduce a vector column; ``None`` or ``none`` passes it through under ``out``."""
    if method in (None, "none"):
        from pyspark.ml.feature import VectorAssembler

        return [VectorAssembler(inputCols=[vec_col], outputCol=out)]
    if method == "pca":
        # Spark's PCA projects without centring, so the mean is taken off first.
        return [
            StandardScaler(inputCol=vec_col, outputCol="__centred", withMean=True, withStd=False),
            PCA(inputCol="__centred", outputCol=out, k=dims),
        ]
    raise ValueError(f"unknown reducer {method!r}; use 'pca' or 'none'")


def fit_reduction(df: DataFrame, dims: int, vec_col: str = "vec", out: str = "reduced") -> PipelineModel:
    return Pipeline(stages=reduction_stages("pca", dims, vec_col, out)).fit(df)
