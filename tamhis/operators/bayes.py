"""Multinomial naive Bayes over words, kept as tables: no vocabulary list, no bound on its size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamhis.functions import text as tx
from tamhis.operators.quality import ID
from tamhis.session import pin, small


class TextNaiveBayesModel:
    """Word counts by class, and the totals of each class.

    ``terms`` is ``(term, counts)`` with a map from class number to the count of the term; ``totals`` is ``(label, docs, words)``, one
    row for each class, which is all that reaches the driver.
    """

    def __init__(self, text_col: str, id_col: str, stop_words: Sequence[str], terms: DataFrame, totals: DataFrame):
        self.text_col, self.id_col, self.stop_words, self.terms, self.totals = text_col, id_col, tuple(stop_words), terms, totals
        self._classes = sorted((r["label"], r["docs"], r["words"]) for r in totals.collect())
        self._vocabulary = terms.count()

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` (class number) and ``probability`` (by class number).

        The score of a class is its log prior plus, for each word of the vocabulary, the log of its smoothed share;
        among equal scores the smallest class wins. Words outside the vocabulary count for no class. Word counts are
        made per document first and meet the vocabulary by one join.
        """
        counts = _words(df, self.text_col, [self.id_col], self.stop_words).groupBy(self.id_col, "term").agg(F.count(F.lit(1)).alias("n"))
        met = counts.join(small(self.terms), "term")
        log_of = lambda label: F.log(F.coalesce(F.element_at("counts", F.lit(label)), F.lit(0)) + 1)
        sums = met.groupBy(self.id_col).agg(
            F.sum("n").alias("__known"), *[F.sum(F.col("n") * log_of(label)).alias(f"__s{label}") for label, _, _ in self._classes])
        joined = df.join(sums, self.id_col, "left")
        all_docs, zero = sum(docs for _, docs, _ in self._classes), F.lit(0.0)

        def score(label: int, docs: int, words: int) -> Column:
            prior = F.lit(float(docs + 1)) / F.lit(float(all_docs + len(self._classes)))
            size = F.log(F.lit(float(words + self._vocabulary)))
            return F.log(prior) + F.coalesce(f"__s{label}", zero) - F.coalesce("__known", F.lit(0)) * size

        scored = joined.withColumn("__scores", F.array(*[score(*c) for c in self._classes]))
        best = F.array_max("__scores")
        labels = F.array(*[F.lit(label) for label, _, _ in self._classes])
        shares = F.transform("__scores", lambda s: F.exp(s - best))
        total = F.aggregate(shares, zero, lambda a, x: a + x)
        place = {label: i for i, (label, _, _) in enumerate(self._classes)}
        by_number = F.array(*[F.get(shares, F.lit(place[n])) / total if n in place else zero for n in range(max(place) + 1)])
        return scored.select(
            *[F.col(f"`{c}`") for c in df.columns], F.get(labels, F.array_position("__scores", best).cast("int") - 1).alias("prediction"),
            by_number.alias("probability"))

    def merged(self, other: TextNaiveBayesModel) -> TextNaiveBayesModel:
        """The model of the rows of both: word and class counts add up, so earlier rows are not read again."""
        if (self.text_col, self.id_col, self.stop_words) != (other.text_col, other.id_col, other.stop_words):
            raise ValueError("only models of the same columns and stop words can be merged")
        both = self.terms.select("term", F.explode("counts").alias("label", "n")).unionByName(other.terms.select("term", F.explode("counts").alias("label", "n")))
        counted = both.groupBy("term", "label").agg(F.sum("n").alias("n"))
        terms = pin(counted.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("counts")))
        totals = pin(self.totals.unionByName(other.totals).groupBy("label").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")))
        return TextNaiveBayesModel(self.text_col, self.id_col, self.stop_words, terms, totals)

    def save(self, path: str) -> None:
        self.terms.write.parquet(f"{path}/terms")
        self.totals.write.parquet(f"{path}/totals")
        meta = self.terms.sparkSession.createDataFrame([(self.text_col, self.id_col, list(self.stop_words))], "text_col string, id_col string, stop_words array<string>")
        meta.write.parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextNaiveBayesModel:
        meta = spark.read.parquet(f"{path}/meta").first()
        return cls(meta["text_col"], meta["id_col"], meta["stop_words"], spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/totals"))


def _words(df: DataFrame, text_col: str, keep: Sequence[str], stop_words: Sequence[str]) -> DataFrame:
    rows = df.select(*keep, F.explode(tx.word_tokens(text_col)).alias("term"))
    return rows.where(~F.col("term").isin(*stop_words)) if stop_words else rows


def fit_text_naive_bayes(df: DataFrame, text_col: str, label_col: str, stop_words: Sequence[str] = (), id_col: str = ID) -> TextNaiveBayesModel:
    """Counts of words by class number, combined in each task; add-one smoothing over the whole vocabulary."""
    stop_words = tuple(stop_words)
    rows = df.where(F.col(label_col).isNotNull()).withColumn("__class", F.col(label_col).cast("int"))
    counted = pin(_words(rows, text_col, ["__class"], stop_words).groupBy("__class", "term").agg(F.count(F.lit(1)).alias("n")))
    terms = pin(counted.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("__class", "n"))).alias("counts")))
    words = counted.groupBy("__class").agg(F.sum("n").alias("words"))
    docs = rows.groupBy("__class").agg(F.count(F.lit(1)).alias("docs"))
    totals = pin(docs.join(words, "__class", "left").select(F.col("__class").alias("label"), "docs", F.coalesce("words", F.lit(0)).alias("words")))
    return TextNaiveBayesModel(text_col, id_col, stop_words, terms, totals)
