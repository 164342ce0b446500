"""Review classification: train, evaluate, predict and retrain a small head on frozen vectors."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamhis.functions import fixed
from tamhis.functions.vectors import array_of
from tamhis.operators import bayes, classify, metrics, vectors
from tamhis.operators.quality import ID, encode_labels
from tamhis.plans.cleaning import CLASSIFIER_FLAGS, clean_text, learn_vocabulary, preprocess, translated
from tamhis.session import pin
from tamhis.sources import sinks


FEATURES = ("sentence", "first_token")


class ReviewClassifier:
    """Head ``mlp``, ``lr`` or ``nb`` over sentence vectors (``nb``: over token counts).

    With ``features`` set to ``first_token`` in ``model_config``, ``mlp`` and ``lr`` take the vector of a text's first token instead. Word vectors are
    learned in ``train`` and stay frozen.
    """

    def __init__(self, args: Mapping | None = None, classes: Mapping[int, str] = fixed.CLASS_NAMES, id_col: str = ID):
        args = args or {}
        self.data_args = {**CLASSIFIER_FLAGS, "text_col": "Review Text", "target_col": "Label", **args.get("data_args", {})}
        self.config = {**fixed.CLASSIFIER_DEFAULTS, "head": "mlp", "vector_dims": 256, "iterations": 100, "features": "sentence",
                       **args.get("model_config", {})}
        if self.config["features"] not in FEATURES or (self.config["features"] != "sentence" and self.config["head"] == "nb"):
            raise ValueError(f"unknown features {self.config['features']!r} for head {self.config['head']!r}; use one of {list(FEATURES)}")
        self.classes, self.id_col = dict(classes), id_col
        self.model: PipelineModel | bayes.TextNaiveBayesModel | None = None
        self.vocabulary: DataFrame | None = None
        self.words: DataFrame | None = None
        self._seen: DataFrame | None = None
        self._given: dict = {}

    @property
    def _flags(self) -> dict:
        return {s: bool(self.data_args.get(s)) for s in ("translate_english", *fixed.CLEANING_STEPS)}

    def _labelled(self, df: DataFrame, save_to: str | None = None, all_rows: bool = False) -> DataFrame:
        text, target = self.data_args["text_col"], self.data_args["target_col"]
        clean = preprocess(df, text, self._flags, vocabulary=self.vocabulary, save_to=save_to, id_col=self.id_col, **self._given)
        out = encode_labels(clean, target, self.classes, "__label")
        known = out if all_rows else out.where(F.col("__label").isNotNull())
        return known.withColumn("__label", F.col("__label").cast("double"))

    def _stages(self) -> list:
        text, c = self.data_args["text_col"], self.config
        stages = [] if self.words is not None else vectors.sentence_stages(text, dims=c["vector_dims"], out="__vec")
        if c["head"] == "lr":
            return [*stages, classify.logistic("__vec", "__label")]
        if c["head"] == "mlp":
            size = max(self.classes) + 1
            return [*stages, classify.perceptron(c["vector_dims"], size, c["n_nodes"], c["n_layers"], "__vec", "__label",
                                                 iterations=c["iterations"])]
        raise ValueError(f"unknown head {c['head']!r}; use mlp, lr or nb")

    def _fit(self) -> PipelineModel | bayes.TextNaiveBayesModel:
        if self.config["head"] == "nb":
            return bayes.fit_text_naive_bayes(self._seen, self.data_args["text_col"], "__label", id_col=self.id_col)
        return Pipeline(stages=self._stages()).fit(self._vectors(self._seen))

    def _vectors(self, df: DataFrame) -> DataFrame:
        """``df`` with the frozen first-token vectors if these are the features; sentence vectors are made by the model."""
        if self.words is None:
            return df
        return vectors.with_first_token(df, self.data_args["text_col"], self.words, self.config["vector_dims"], "__vec")

    def train(self, df: DataFrame, **tables) -> PipelineModel | bayes.TextNaiveBayesModel:
        """Clean and fit. ``tables``: ``stop_words``, ``emoji_words``, ``translations`` and ``vocabulary``, kept for all later texts."""
        text, self._given = self.data_args["text_col"], {k: v for k, v in tables.items() if k != "vocabulary" and v is not None}
        self.vocabulary = tables.get("vocabulary")
        if self._flags["check_spelling"] and self.vocabulary is None:
            self.vocabulary = pin(learn_vocabulary(df, text, self._flags, id_col=self.id_col, **self._given))
        self._seen = pin(self._labelled(df, self.data_args.get("save_data_file")))
        if self.config["features"] == "first_token":
            learned = vectors.fit_word_vectors(self._seen, text, self.config["vector_dims"]).getVectors()
            self.words = pin(learned.select("word", array_of(learned, "vector").alias("vec")))
        self.model = self._fit()
        return self.model

    def retrain(self, df: DataFrame) -> PipelineModel | bayes.TextNaiveBayesModel:
        """Take the new labelled rows into the model.

        Naive Bayes adds the counts of the new rows to those it has and reads no earlier row; the other heads are fitted
        anew on all rows seen so far.
        """
        new, known = pin(self._labelled(df)), self.model
        seen = new if self._seen is None else self._seen.unionByName(new)
        if isinstance(known, bayes.TextNaiveBayesModel):
            self._seen = new
            self.model = known.merged(self._fit())
        else:
            self._seen = seen
            self.model = self._fit()
        self._seen = seen
        return self.model

    def _decoded(self, df: DataFrame, kept: list[str]) -> DataFrame:
        table = F.create_map(*[F.lit(v) for i, n in self.classes.items() for v in (int(i), n)])
        predicted, shares = classify.outcome(self.model)
        found = self.model.transform(self._vectors(df)).withColumns({"__predicted": predicted, "__shares": shares})
        return found.select(
            *[F.col(f"`{c}`") for c in kept], F.col("__predicted").alias("predicted_id"),
            table[F.col("__predicted")].alias("predicted"), F.col("__shares").alias("probabilities"),
        )

    def _scored(self, df: DataFrame, all_rows: bool = False) -> DataFrame:
        rows = self._labelled(df, all_rows=all_rows)
        return self._decoded(rows, [*rows.columns]).withColumn("__label", F.col("__label").cast("int"))

    def evaluate(self, df: DataFrame, save_to: str | None = None, task: str = "Evaluation") -> DataFrame:
        """``(metric, value)`` on labelled rows; appended to a performance table when ``save_to`` is given."""
        result = metrics.weighted_metrics(self._scored(df), "__label", "predicted_id")
        if save_to:
            sinks.append_performance(result, save_to, task)
        return result

    def evaluation_tables(self, df: DataFrame) -> dict[str, DataFrame]:
        """All tables of an evaluation: metrics with the number of rows left out, confusion cells, report per class, ROC points and its area."""
        every = pin(self._scored(df, all_rows=True))
        scored = every.where(F.col("__label").isNotNull())
        return {
            "metrics": metrics.weighted_metrics(scored, "__label", "predicted_id").union(metrics.unjudged(every, "__label", "predicted_id")),
            "confusion": metrics.confusion(scored, "__label", "predicted_id"),
            "class_report": metrics.class_report(scored, "__label", "predicted_id", self.classes),
            "roc_points": metrics.roc_points(scored, "__label", "probabilities"),
            "roc_auc": metrics.roc_auc_micro(scored, "__label", "probabilities"),
        }

    def save(self, folder: str) -> str:
        """Write the fitted head, the cleaning tables, the word vectors and the settings into a new folder."""
        spark = self._seen.sparkSession
        meta = {"data_args": self.data_args, "model_config": self.config, "classes": {str(k): v for k, v in self.classes.items()},
                "id_col": self.id_col, "tables": sorted(self._tables()),
                "lists": {k: self._given[k] for k in ("stop_words", "emoji_words") if k in self._given}}
        spark.createDataFrame([(json.dumps(meta, ensure_ascii=False),)], "value string").write.text(f"{folder}/meta")
        self.model.save(f"{folder}/model")
        self._seen.write.parquet(f"{folder}/seen")
        for name, table in self._tables().items():
            table.write.parquet(f"{folder}/{name}")
        return folder

    def _tables(self) -> dict[str, DataFrame]:
        named = {"vocabulary": self.vocabulary, "words": self.words, "translations": self._given.get("translations")}
        return {name: table for name, table in named.items() if table is not None}

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> ReviewClassifier:
        meta = json.loads(spark.read.text(f"{folder}/meta").first()[0])
        run = cls({"data_args": meta["data_args"], "model_config": meta["model_config"]}, {int(k): v for k, v in meta["classes"].items()}, meta["id_col"])
        if run.config["head"] == "nb":
            run.model = bayes.TextNaiveBayesModel.load(spark, f"{folder}/model")
        else:
            run.model = PipelineModel.load(f"{folder}/model")
        run._seen = spark.read.parquet(f"{folder}/seen")
        tables = {name: spark.read.parquet(f"{folder}/{name}") for name in meta["tables"]}
        run.vocabulary, run.words = tables.pop("vocabulary", None), tables.pop("words", None)
        run._given = {**meta["lists"], **tables}
        return run

    def predict(self, df: DataFrame) -> DataFrame:
        """Input columns, cleaned text, predicted class and probabilities; no row is lost."""
        lists = {k: v for k, v in self._given.items() if k != "translations"}
        clean = translated(df, self.data_args["text_col"], self._flags, self._given.get("translations"))
        clean = clean_text(clean, self.data_args["text_col"], self._flags, vocabulary=self.vocabulary, id_col=self.id_col, **lists)
        clean = clean.withColumn(self.data_args["text_col"], F.coalesce(F.col(f"`{self.data_args['text_col']}`"), F.lit("")))
        return self._decoded(clean, list(df.columns))
