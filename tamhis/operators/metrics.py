"""Classification metrics from one grouped count of (truth, prediction)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamhis.operators.quality import decode_labels
from tamhis.session import running_totals


def pair_counts(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``(y_true, y_pred, n)`` for the pairs that occur; rows without a truth or a prediction cannot be judged and are left out."""
    rows = df.select(F.col(truth).alias("y_true"), F.col(predicted).alias("y_pred")).where("y_true IS NOT NULL AND y_pred IS NOT NULL")
    return rows.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def unjudged(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``(metric, value)`` with the number of rows that the metrics leave out."""
    missing = F.count_if(F.col(truth).isNull() | F.col(predicted).isNull())
    return df.agg(missing.cast("double").alias("value")).select(F.lit("unjudged_rows").alias("metric"), "value")


def _per_class(counts: DataFrame) -> DataFrame:
    """``(label, hits, predicted, support)`` for every label of either side, without a join."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(
            F.col("y_true").alias("label"), hit.alias("hits"), F.lit(0).cast("bigint").alias("predicted"),
            F.col("n").alias("support"),
        ),
        F.struct(
            F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("hits"), F.col("n").alias("predicted"),
            F.lit(0).cast("bigint").alias("support"),
        ),
    )
    rows = counts.select(F.inline(sides))
    return rows.groupBy("label").agg(
        F.sum("hits").alias("hits"), F.sum("predicted").alias("predicted"), F.sum("support").alias("support")
    )


def class_report(df: DataFrame, truth: str, predicted: str, classes: Mapping[int, str] | None = None) -> DataFrame:
    """``(label[, name], precision, recall, f1, support)``; an undefined ratio counts as 1."""
    rows = _per_class(pair_counts(df, truth, predicted))

    def ratio(top, bottom):
        return F.when(bottom == 0, F.lit(1.0)).otherwise(top.cast("double") / bottom)

    hits, predicted_n, support = F.col("hits"), F.col("predicted"), F.col("support")
    report = rows.select(
        "label",
        ratio(hits, predicted_n).alias("precision"),
        ratio(hits, support).alias("recall"),
        ratio(2 * hits, predicted_n + support).alias("f1"),
        "support",
    )
    if classes is None:
        return report
    return decode_labels(report, "label", classes, "name").select("label", "name", "precision", "recall", "f1", "support")


def weighted_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``(metric, value)``: accuracy and support-weighted precision, recall and F1."""
    report = class_report(df, truth, predicted)
    weight, total = F.col("support"), F.sum("support")
    # Recall times support is the number of hits, so weighted recall and accuracy agree by definition.
    row = report.agg(
        (F.sum(F.when(weight > 0, F.col("recall") * weight).otherwise(0.0)) / total).alias("accuracy"),
        (F.sum(F.col("precision") * weight) / total).alias("precision"),
        (F.sum(F.col("recall") * weight) / total).alias("recall"),
        (F.sum(F.col("f1") * weight) / total).alias("f1_score"),
    )
    names = ("accuracy", "precision", "recall", "f1_score")
    return row.select(
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names]))
    )


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``(y_true, y_pred, n)`` for all pairs of the labels of both sides, zeros included."""
    counts = pair_counts(df, truth, predicted)
    sides = counts.agg(
        F.array_union(F.collect_set("y_true"), F.collect_set("y_pred")).alias("labels")
    )
    grid = sides.select(F.explode("labels").alias("y_true"), "labels").select("y_true", F.explode("labels").alias("y_pred"))
    return grid.join(counts, ["y_true", "y_pred"], "left").select(
        "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def confusion_wide(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row per true label, one column per predicted label."""
    return confusion(df, truth, predicted).groupBy("y_true").pivot("y_pred").agg(F.sum("n")).orderBy("y_true")


def score_counts(df: DataFrame, truth: str, probabilities: str) -> DataFrame:
    """``(score, positives, negatives)`` over all (row, class) cells: one-hot labels against probabilities."""
    cells = df.select(F.col(truth).alias("y"), F.posexplode(probabilities).alias("k", "score"))
    hit = (F.col("y") == F.col("k")).cast("bigint")
    return cells.groupBy("score").agg(F.sum(hit).alias("positives"), F.sum(1 - hit).alias("negatives"))


def roc_points(df: DataFrame, truth: str, probabilities: str) -> DataFrame:
    """``(score, fpr, tpr)`` per distinct score, micro-averaged over the classes.

    Cells are counted per score first; the cumulative counts then run over range partitions.
    """
    counts = score_counts(df, truth, probabilities)
    reached = running_totals(
        counts, [F.desc("score")], {"tp": F.col("positives"), "fp": F.col("negatives")}
    )
    totals = reached.agg(F.max("tp").alias("p"), F.max("fp").alias("n"))
    return reached.select(
        "score",
        F.try_divide(F.col("fp"), totals.select("n").scalar()).alias("fpr"),
        F.try_divide(F.col("tp"), totals.select("p").scalar()).alias("tpr"),
    )


def roc_auc_micro(df: DataFrame, truth: str, probabilities: str) -> DataFrame:
    """``(metric, value)``: micro-averaged area under the curve; tied scores count half."""
    counts = score_counts(df, truth, probabilities)
    reached = running_totals(counts, [F.desc("score")], {"tp": F.col("positives"), "fp": F.col("negatives")})
    above = F.col("tp").cast("double") - F.col("positives")
    area = F.sum(F.col("negatives") * (above + F.col("positives") / 2.0))
    return reached.agg(F.try_divide(area, F.max("tp").cast("double") * F.max("fp")).alias("value")).select(
        F.lit("roc_auc_micro").alias("metric"), "value"
    )


def topic_metrics(df: DataFrame, label_col: str = "label", topic_col: str = "topic", by_majority: bool = False):
    """Weighted metrics of topic ids against label ids; with ``by_majority`` a topic first takes its main label."""
    if not by_majority:
        return weighted_metrics(df, label_col, topic_col)
    from tamhis.operators.topics import majority_label

    names = majority_label(df, topic_col, label_col).select(F.col("topic").alias("__t"), F.col("label").alias("__l"))
    return weighted_metrics(df.join(names, F.col(topic_col) == F.col("__t"), "left"), label_col, "__l")
