"""Topic modelling of reviews: fit, assign, describe, save and load."""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamhis.functions import fixed
from tamhis.functions.vectors import array_of, as_vector
from tamhis.operators import bayes, classify, clusters, describe, reports, terms, topics, vectors
from tamhis.operators.coherence import coherence_by_topic
from tamhis.operators.metrics import topic_metrics
from tamhis.operators.quality import ID, encode_labels
from tamhis.operators.reports import topic_similarity
from tamhis.plans.cleaning import TOPIC_FLAGS, learn_vocabulary, preprocess
from tamhis.session import pin
from tamhis.sources import sinks
from tamhis.sources.runs import RunRecorder

CLUSTERERS = ("kmeans", "hdbscan", "agglomerative", "spectral", "lr", "nb")
EMBEDDINGS = ("sent", "word2vec", "word", "column")
SUPERVISED = ("supervised", "cls")
VEC, REDUCED, TOPIC = "__vec", "__reduced", "topic"


def settings(config: Mapping | None = None) -> dict:
    """Defaults overlaid with ``config``; unknown techniques are refused by name.

    ``umap`` is accepted so that existing settings run, but the reduction is then the linear one.
    """
    out = {**fixed.TOPIC_DEFAULTS, "vector_dims": 256, "vec_col": "vec", "min_points": 15, "eps": None,
           "name_threshold": 0.5, **(config or {})}
    if out["dim_model_name"] == "umap":
        warnings.warn("umap is not built; reducing with pca instead", stacklevel=2)
        out["dim_model_name"] = "pca"
    for key, known in (
        ("clustering_model_name", CLUSTERERS), ("embd_technique", EMBEDDINGS), ("dim_model_name", ("pca", "none", None)),
    ):
        if out[key] not in known:
            raise ValueError(f"unknown {key} {out[key]!r}; use one of {[k for k in known if k]}")
    return out


class Embedder:
    """Document vectors by the configured technique, fitted on the training texts."""

    def __init__(self, config: Mapping, text_col: str, pipeline: PipelineModel | None = None, words: DataFrame | None = None):
        self.config, self.text_col, self.pipeline, self.words = config, text_col, pipeline, words

    @classmethod
    def fit(cls, df: DataFrame, text_col: str, config: Mapping) -> Embedder:
        kind, dims = config["embd_technique"], config["vector_dims"]
        if kind == "column":
            return cls(config, text_col)
        if kind == "word":
            model = vectors.fit_word_vectors(df, text_col, dims)
            table = model.getVectors()
            return cls(config, text_col, words=pin(table.select("word", array_of(table, "vector").alias("vec"))))
        method = "word2vec" if kind == "word2vec" else "hashed"
        return cls(config, text_col, vectors.fit_sentence_vectors(df, text_col, method=method, dims=dims, out=VEC))

    def transform(self, df: DataFrame, id_col: str = ID) -> DataFrame:
        if self.config["embd_technique"] == "column":
            return df.withColumn(VEC, as_vector(array_of(df, self.config["vec_col"])))
        if self.words is not None:
            flat = vectors.word_position_vectors(
                df, self.text_col, self.words, self.config["vector_dims"], self.config["max_length"], id_col
            )
            return df.join(flat.select(id_col, as_vector("vec").alias(VEC)), id_col)
        kept = [F.col(f"`{c}`") for c in df.columns]
        return self.pipeline.transform(df).select(*kept, VEC)


class TopicModel:
    """A fitted topic model: vectors, reducer, clusterer, topic centres, term weights and descriptions."""

    def __init__(self, config, text_col, embedder, reducer, clusterer, names, centres, weights, words, id_col=ID):
        self.config, self.text_col, self.id_col = config, text_col, id_col
        self.embedder, self.reducer, self.clusterer = embedder, reducer, clusterer
        self.names, self.centres, self.weights, self.words = names, centres, weights, words
        self.vocabulary: DataFrame | None = None

    @property
    def kind(self) -> str:
        return self.config["clustering_model_name"]

    @property
    def name(self) -> str:
        c = self.config
        return f"{c['task']}-{c['embd_technique']}-{c['n_topics']}topics-{c['n_components']}d-{c['clustering_model_name']}"

    def features(self, df: DataFrame) -> DataFrame:
        return self.reducer.transform(self.embedder.transform(df, self.id_col)).drop("__centred")

    def transform(self, df: DataFrame, probabilities: bool = False) -> DataFrame:
        """Add ``topic`` (and ``probabilities``) to new documents."""
        kept = list(df.columns)
        if self.kind == "nb":
            found = self.clusterer.transform(df)
        else:
            found = self.features(df)
            if self.kind == "lr":
                found = self.clusterer.transform(found)
        if self.kind in ("lr", "nb"):
            predicted, shares = classify.outcome(self.clusterer)
            extra = [shares.alias("probabilities")] if probabilities else []
            return found.select(*kept, predicted.alias(TOPIC), *extra)
        if self.kind == "kmeans":
            found = topics.rename_topics(self.clusterer.transform(found), self.names, "cluster").withColumnRenamed(
                "cluster", TOPIC
            )
        else:
            found = topics.nearest_centroid(found, self.centres, REDUCED, TOPIC, self.id_col)
        if probabilities:
            found = topics.topic_probabilities(found, self.centres, REDUCED)
            return found.select(*kept, TOPIC, "probabilities")
        return found.select(*kept, TOPIC)

    def save(self, folder: str) -> str:
        """Write the model under its name into ``folder``; a model that is there already is refused, as it may be in use."""
        path = f"{folder.rstrip('/')}/{self.name}"
        spark = self.weights.sparkSession
        for part, stage in (("embedder", self.embedder.pipeline), ("reducer", self.reducer), ("clusterer", self.clusterer)):
            if isinstance(stage, bayes.TextNaiveBayesModel):
                stage.save(f"{path}/{part}")
            elif stage is not None:
                stage.write().save(f"{path}/{part}")
        tables = {"centres": self.centres, "weights": self.weights, "words": self.words, "word_vectors": self.embedder.words,
                  "vocabulary": self.vocabulary}
        for part, table in tables.items():
            if table is not None:
                table.write.parquet(f"{path}/{part}")
        meta = {"config": self.config, "text_col": self.text_col, "id_col": self.id_col,
                "names": {str(k): v for k, v in self.names.items()}, "vocabulary": self.vocabulary is not None}
        spark.createDataFrame([(json.dumps(meta, ensure_ascii=False),)], "value string").write.text(f"{path}/meta")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TopicModel:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        config, kind = meta["config"], meta["config"]["clustering_model_name"]
        embedding = config["embd_technique"]
        embedder = Embedder(
            config, meta["text_col"],
            PipelineModel.load(f"{path}/embedder") if embedding in ("sent", "word2vec") and kind != "nb" else None,
            spark.read.parquet(f"{path}/word_vectors") if embedding == "word" and kind != "nb" else None,
        )
        reducer = PipelineModel.load(f"{path}/reducer") if kind != "nb" else None
        clusterer = PipelineModel.load(f"{path}/clusterer") if kind in ("kmeans", "lr") else None
        if kind == "nb":
            clusterer = bayes.TextNaiveBayesModel.load(spark, f"{path}/clusterer")
        centres = spark.read.parquet(f"{path}/centres") if kind not in ("nb",) else None
        names = {int(k): v for k, v in meta["names"].items()}
        model = cls(config, meta["text_col"], embedder, reducer, clusterer, names, centres,
                    spark.read.parquet(f"{path}/weights"), spark.read.parquet(f"{path}/words"), meta["id_col"])
        if meta.get("vocabulary"):
            model.vocabulary = spark.read.parquet(f"{path}/vocabulary")
        return model


def fit_topics(
    df: DataFrame, config: Mapping | None, text_col: str, label_col: str | None = None, stop_words=None, id_col: str = ID
) -> tuple[DataFrame, TopicModel]:
    """``(df + topic + probabilities, model)``. ``label_col`` holds class numbers, used by ``lr`` and ``nb``."""
    c = settings(config)
    kind = c["clustering_model_name"]
    if kind in ("lr", "nb") and label_col is None:
        raise ValueError(f"{kind} needs labels")
    stop_words = fixed.topic_stopwords() if stop_words is None else stop_words
    embedder = reducer = clusterer = centres = reduced = None
    names: dict[int, int] = {}
    if kind == "nb":
        embedder = Embedder(c, text_col)
        train = df.withColumn("__label", F.col(label_col).cast("double"))
        clusterer = bayes.fit_text_naive_bayes(train, text_col, "__label", stop_words, id_col)
    else:
        embedder = Embedder.fit(df, text_col, c)
        embedded = embedder.transform(df, id_col).persist(StorageLevel.MEMORY_AND_DISK)
        reducer = Pipeline(stages=vectors.reduction_stages(c["dim_model_name"], c["n_components"], VEC, REDUCED)).fit(embedded)
        labels = [F.col(label_col).cast("double").alias("__label")] if label_col else []
        reduced = reducer.transform(embedded).select(id_col, VEC, REDUCED, *labels).persist(StorageLevel.MEMORY_AND_DISK)
        if kind == "lr":
            clusterer = Pipeline(stages=[classify.logistic(REDUCED, "__label")]).fit(reduced)
        elif kind == "kmeans":
            clusterer = Pipeline(stages=[clusters.kmeans(c["n_topics"], REDUCED)]).fit(reduced)
    model = TopicModel(c, text_col, embedder, reducer, clusterer, names, centres, None, None, id_col)

    if kind in ("lr", "nb"):
        annotated = model.transform(df, probabilities=True)
        if kind == "lr":
            found = clusterer.transform(reduced).select(id_col, F.col("prediction").cast("int").alias(TOPIC), REDUCED)
            model.centres = pin(topics.centroids(found, TOPIC, REDUCED))
    else:
        grouped = _cluster(reduced, clusterer, c, id_col)
        model.names = _final_names(df, grouped, c, text_col, stop_words, id_col)
        grouped = pin(topics.rename_topics(grouped, model.names, "cluster").withColumnRenamed("cluster", TOPIC))
        placed = reduced.join(grouped, id_col)
        model.centres = pin(topics.centroids(placed, TOPIC, REDUCED))
        with_shares = topics.topic_probabilities(placed, model.centres, REDUCED)
        annotated = df.join(with_shares.select(id_col, TOPIC, "probabilities"), id_col)

    annotated = pin(annotated)  # read by counts, descriptions, metrics, digests and writers
    # Terms come from single words; n-grams are kept out of the plan unless a range above 1 is set.
    low, high = c["ngram_range"]
    counts = terms.count_terms(annotated.where(F.col(TOPIC) != clusters.NOISE), text_col, TOPIC, stop_words, (low, high))
    model.weights = pin(terms.ctfidf(counts, TOPIC, "bm25", True))
    model.words = pin(_describe(model, reduced, annotated, c, text_col, id_col))
    if kind != "nb":
        reduced.unpersist()
        embedded.unpersist()
    return annotated, model


def _cluster(reduced, clusterer, c, id_col) -> DataFrame:
    kind, k = c["clustering_model_name"], c["n_topics"]
    if kind == "kmeans":
        return pin(clusterer.transform(reduced).select(id_col, "cluster"))
    if kind == "hdbscan":
        return pin(clusters.density_clusters(reduced, REDUCED, c["min_topic_size"], c["min_points"], c["eps"], id_col=id_col))
    if kind == "agglomerative":
        return pin(clusters.ward_clusters(reduced, k, REDUCED, id_col=id_col))
    return pin(clusters.spectral_clusters(reduced, k, REDUCED, id_col=id_col))


def _final_names(df, grouped, c, text_col, stop_words, id_col) -> dict[int, int]:
    """Clusterer ids to topic ids: merged down to ``n_topics`` when there are more, then by falling size."""
    sizes = pin(topics.topic_sizes(grouped, "cluster"))
    n = sizes.where(F.col("topic") != clusters.NOISE).count()
    if min(n, c["n_topics"]) > topics.MAX_TOPICS:
        raise ValueError(f"{n} topics are more than {topics.MAX_TOPICS}; ask for fewer with n_topics")
    merged = {r["topic"]: r["topic"] for r in sizes.collect()} if n <= c["n_topics"] else {}
    if n > c["n_topics"]:
        texts = df.join(grouped.where(F.col("cluster") != clusters.NOISE), id_col)
        weights = pin(terms.ctfidf(terms.count_terms(texts, text_col, "cluster", stop_words), "cluster"))
        merged = topics.reduce_topics(topic_similarity(weights, "cluster"), sizes, c["n_topics"])
    after = topics.rename_topics(sizes, merged, "topic").groupBy("topic").agg(F.sum("n").alias("n"))
    order = topics.size_order(after)
    return {old: order.get(new, clusters.NOISE) for old, new in merged.items()}


def _describe(model, reduced, annotated, c, text_col, id_col) -> DataFrame:
    candidates = max(c.get("candidate_terms", describe.CANDIDATES), fixed.TOP_TERMS)
    words = terms.top_terms(model.weights, TOPIC, candidates)
    chain = [s for s in c["representation_model_list"] if s]
    if not chain or model.kind == "nb":
        return words.where(F.col("rank") <= fixed.TOP_TERMS)
    docs = annotated.select(id_col, text_col, TOPIC).join(reduced.select(id_col, VEC), id_col)
    centres = pin(topics.centroids(docs, TOPIC, VEC))
    words = pin(words)
    names = None
    wanted = words.select("term")
    if any(s.lower() == "zeroshot" for s in chain):
        spark = words.sparkSession
        listed = spark.createDataFrame([(n,) for n in c["candidate_topics"]], "name string")
        wanted = wanted.unionByName(listed.select(F.col("name").alias("term")))
    table = pin(describe.term_vectors(docs, text_col, wanted, VEC))
    if any(s.lower() == "zeroshot" for s in chain):
        names = listed.join(table, F.col("name") == F.col("term")).select("name", "vec")
    return describe.describe_topics(words, table, centres, chain, fixed.TOP_TERMS, c["diversity"], names, c["name_threshold"], candidates=candidates)


class TopicExperiment:
    """Clean, fit, score, report and record; ``data_args`` and ``model_config`` are plain dicts."""

    def __init__(self, args: Mapping, classes: Mapping[int, str] = fixed.CLASS_NAMES, id_col: str = ID):
        self.data_args = {**TOPIC_FLAGS, "text_col": "Review Text", "target_col": "Label", **args.get("data_args", {})}
        self.config = settings(args.get("model_config"))
        self.classes, self.id_col = classes, id_col
        self.model: TopicModel | None = None
        self._given: dict = {}

    @property
    def _flags(self) -> dict:
        return {s: bool(self.data_args.get(s)) for s in ("translate_english", *fixed.CLEANING_STEPS)}

    @property
    def _supervised(self) -> bool:
        return self.config["task"] in SUPERVISED

    def _tables(self, tables: dict) -> dict:
        """Cleaning tables of the fit and the model's own spelling vocabulary, so that a text is cleaned alike in any batch."""
        known = self.model.vocabulary if self.model else None
        return {**self._given, **({"vocabulary": known} if known is not None else {}), **tables}

    def cleaned(self, df: DataFrame, **tables) -> DataFrame:
        text = self.data_args["text_col"]
        out = preprocess(df, text, self._flags, id_col=self.id_col, **tables)
        target = self.data_args["target_col"]
        if self._supervised and target in out.columns:
            out = encode_labels(out, target, self.classes)
        return out

    def fit(self, df: DataFrame, recorder: RunRecorder | None = None, **tables) -> DataFrame:
        text, target = self.data_args["text_col"], self.data_args["target_col"]
        if self._flags["check_spelling"] and "vocabulary" not in tables:
            options = {k: v for k, v in tables.items() if k in ("stop_words", "emoji_words", "translations")}
            tables = {**tables, "vocabulary": pin(learn_vocabulary(df, text, self._flags, id_col=self.id_col, **options))}
        self._given = dict(tables)
        data = pin(self.cleaned(df, save_to=self.data_args.get("save_data_file"), **tables))
        train = data.where(F.col(target).isNotNull()) if self._supervised else data
        annotated, self.model = fit_topics(train, self.config, text, target if self._supervised else None, id_col=self.id_col)
        self.model.vocabulary = tables.get("vocabulary")
        metrics = topic_metrics(annotated, target, TOPIC) if self._supervised else None
        if recorder:
            recorder.params(self.config, self._flags)
            recorder.input("raw", df)
            recorder.input("annotated", annotated.drop("probabilities"))
            if metrics is not None:
                recorder.metrics(metrics)
        self._save(annotated.drop("probabilities"), "train")
        if self.data_args.get("checkpoints_dir"):
            self.model.save(self.data_args["checkpoints_dir"])
        if self.data_args.get("results_dir"):
            sinks.write_topic_report(topics.topic_sizes(annotated), f"{self.data_args['results_dir']}/topic_report")
        if self.data_args.get("visual_dir"):
            for name, table in self.report_tables(annotated).items():
                table.write.mode("overwrite").parquet(f"{self.data_args['visual_dir'].rstrip('/')}/{name}")
        return annotated

    def report_tables(self, annotated: DataFrame) -> dict[str, DataFrame]:
        """Tables behind the topic figures, by name; ``fit`` writes them under ``visual_dir``."""
        text, target = self.data_args["text_col"], self.data_args["target_col"]
        docs = annotated.where(F.col(TOPIC) != clusters.NOISE)
        weights, words = self.model.weights, self.model.words
        found = {
            "topic_map": reports.topic_map(weights, topics.topic_sizes(docs)),
            "topic_similarity": topic_similarity(weights),
            "term_decline": reports.term_decline(weights, TOPIC, fixed.TOP_TERMS),
            "topic_words": reports.topic_words(weights, TOPIC, 5),
            "topic_distribution": reports.topic_distribution(docs, text, weights, by=TOPIC, id_col=self.id_col),
            "coherence": coherence_by_topic(docs, text, words.select(TOPIC, "term", "rank"), by=TOPIC),
        }
        if self.model.kind != "nb":
            found["document_map"] = reports.document_map(self.model.features(docs), REDUCED, TOPIC, id_col=self.id_col)
        if target in annotated.columns:
            found["topics_per_class"] = reports.topics_per_class(docs.where(F.col(target).isNotNull()), text, target, TOPIC)
        return found

    def validation(self, df: DataFrame, recorder: RunRecorder | None = None, **tables) -> DataFrame:
        text, target = self.data_args["text_col"], self.data_args["target_col"]
        data = self.model.transform(self.cleaned(df, **self._tables(tables)))
        label = F.col(target) if target in data.columns else F.lit(None).cast("string")
        result = data.select(self.id_col, F.col(text).alias("review"), label.alias("label"), TOPIC)
        if recorder and self._supervised:
            recorder.metrics(topic_metrics(result, "label", TOPIC))
        if recorder:
            recorder.input("validation", result)
        self._save(result, "val")
        return result

    def transform(self, df: DataFrame, **tables) -> DataFrame:
        text = self.data_args["text_col"]
        data = preprocess(df, text, self._flags, id_col=self.id_col, **self._tables(tables))
        result = self.model.transform(data).select(self.id_col, F.col(text).alias("review"), TOPIC)
        self._save(result, "test")
        return result

    def _save(self, df: DataFrame, split: str) -> None:
        if self.data_args.get("save_annotation"):
            sinks.write_annotation(df, self.data_args["save_annotation"], split)
