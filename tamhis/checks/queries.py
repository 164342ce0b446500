"""One query per operator over the given tables. Computed columns carry the names used by the SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamhis.functions import fixed
from tamhis.functions import text as tx
from tamhis.functions.vectors import as_vector
from tamhis.operators import (
    bayes, classify, clusters, coherence, describe, encoding, metrics, neighbors, quality, reports, spelling, terms, topics,
    translation, vectors,
)
from tamhis.plans.cleaning import clean_column, clean_text, flags_from, preprocess
from tamhis.session import pin, use_checkpoint_dir

LATIN = "abcdefghijklmnopqrstuvwxyz"
ARABIC = "اإأآبىتثجحخةدذرزسشصؤضطگظعغ"
MARKED_FROM, MARKED_TO = "aeiouydn", "ًٌٍَُـِّ"
EMOJI_FROM, EMOJI_TO = "xvkq", "😀🚀👍🇪"
EMOJI_WORDS = {"😀": "سعيد", "👍": "جيد"}
CHAIN = flags_from(
    ("normalize", "remove_url_email", "remove_punct", "remove_repeated_chars", "remove_repeated_words",
     "remove_long_words", "remove_english", "remove_stopwords", "stem")
)
WIDE_TERMS = 200  # more words a topic than a report shows
FULL_CHAIN = flags_from(fixed.CLEANING_STEPS)
MINIMUM_SLICE = flags_from(("remove_url_email", "remove_punct", "remove_repeated_chars", "remove_repeated_words"))


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A given table. With ``spread`` a file with fewer splits than cores is dealt out over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents", spread=True)


def arabic(c: str = "text") -> Column:
    return F.translate(F.lower(c), LATIN, ARABIC)


def mixed(c: str = "text") -> Column:
    """Small letters in Arabic script, capitals left in Latin."""
    return F.translate(c, LATIN, ARABIC)


def six(c) -> Column:
    return F.round(c, 6)


def _text_rule(rule: Callable[[Column], Column], source: Callable[[], Column] | None = None):
    def run(spark, sf_dir):
        text = F.col("text") if source is None else source()
        return documents(spark, sf_dir).select("doc_id", rule(text).alias("text"))

    return run


def _labelled(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels")


def dedupe_rows(spark, sf_dir):
    return quality.drop_duplicates(documents(spark, sf_dir).select("doc_id", "lang", "source", "text"))


def _with_labels(spark, sf_dir, *columns):
    docs = table(spark, sf_dir, "documents").select("doc_id", *columns)
    return docs.join(_labelled(spark, sf_dir), "doc_id", "left")


def drop_nulls(spark, sf_dir):
    return quality.drop_missing(_with_labels(spark, sf_dir, "lang", "source", "text", "n_chars"))


def quality_report(spark, sf_dir):
    return quality.quality_report(_with_labels(spark, sf_dir, "lang", "text").drop("toxic"))


def recheck_quality(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    cleaned = docs.withColumn("text", tx.collapse_repeated_chars(tx.remove_punctuation("text")))
    return quality.check_quality(cleaned, "text")


def strip_page_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", spread=True)
    return pages.select("page_id", tx.remove_url_email(F.concat_ws(" ", "url", "html")).alias("text"))


def detect_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", tx.detect_language("text").alias("plain"), tx.detect_language(mixed()).alias("mixed"))


def clean_chain(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", clean_column(mixed(), CHAIN).alias("text"))


def clean_table(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "lang", mixed().alias("text"))
    return preprocess(docs, "text", CHAIN)


def _memory(spark, sf_dir):
    good = _labelled(spark, sf_dir).where("quality = 1").select("doc_id")
    docs = table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi")
    return docs.select(F.col("text").alias("source_text"), arabic().alias("target_text"))


def translate_routed(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return translation.translate_english(docs, "text", _memory(spark, sf_dir))


def translation_rounds(spark, sf_dir):
    """Two rounds with a kept memory: the first holds some answers, the second those to the work list; then all texts are routed."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    path = f"{use_checkpoint_dir(spark).rstrip('/')}/translations-{uuid.uuid4().hex}"
    translation.remember(_memory(spark, sf_dir), path)
    work = translation.untranslated(docs, "text", translation.read_memory(spark, path))
    translation.remember(work.select("source_text", arabic("source_text").alias("target_text")), path)
    return translation.translate_english(docs, "text", translation.read_memory(spark, path))


def untranslated_texts(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return translation.untranslated(docs, "text", _memory(spark, sf_dir))


def spelling_fix(spark, sf_dir):
    texts = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return spelling.check_spelling(texts, "text", spelling.build_word_counts(documents(spark, sf_dir), "text", 5), id_col="item_id")


def spelling_documents(spark, sf_dir):
    return spelling.check_spelling(documents(spark, sf_dir).select("doc_id", "text"), "text", stored=True)


def full_chain(spark, sf_dir):
    """All cleaning steps, spelling and segments too; some letters are emoji first."""
    smiling = F.translate("text", EMOJI_FROM, EMOJI_TO)
    docs = documents(spark, sf_dir).select("doc_id", F.translate(smiling, LATIN, ARABIC).alias("text"))
    return clean_text(docs, "text", FULL_CHAIN, emoji_words=EMOJI_WORDS)


def _counts(spark, sf_dir, by="lang", **options):
    return terms.count_terms(documents(spark, sf_dir), "text", by, **options)


def count_terms(spark, sf_dir):
    return _counts(spark, sf_dir, "doc_id", stop_words=("the", "de", "und"))


def ngrams(spark, sf_dir):
    return _counts(spark, sf_dir, stop_words=("the", "de", "und"), ngram_range=(1, 3))


def _weights(spark, sf_dir, form="bm25", damp=True):
    return terms.ctfidf(_counts(spark, sf_dir), "lang", form, damp)


def ctfidf(spark, sf_dir):
    return _weights(spark, sf_dir, "base", False).select("lang", "term", "n", six("weight").alias("weight"))


def ctfidf_bm25(spark, sf_dir):
    return _weights(spark, sf_dir).select("lang", "term", "n", six("weight").alias("weight"))


def _cleaned_weights(docs: DataFrame) -> DataFrame:
    rows = quality.check_quality(docs.select("doc_id", "lang", "text"), "text")
    cleaned = rows.withColumn("text", clean_column("text", MINIMUM_SLICE))
    return terms.ctfidf(terms.count_terms(cleaned, "text", "lang"), "lang")


def top_terms(spark, sf_dir):
    top = terms.top_terms(_cleaned_weights(documents(spark, sf_dir)), "lang", fixed.TOP_TERMS)
    return top.select("lang", "term", six("weight").alias("weight"), "rank")


def encode_fixed(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    coded = encoding.encode_fixed(docs, "text", encoding.build_vocabulary(docs, "text"), 30, "lang")
    return coded.select("doc_id", "label", F.array_join("ids", " ").alias("ids"), F.array_join("mask", " ").alias("mask"))


def encode_labels(spark, sf_dir):
    names = {0: "Negative", 1: "Positive"}
    decoded = quality.decode_labels(_labelled(spark, sf_dir), "quality", names, "name")
    word = F.when(F.col("toxic") == 1, "Toxic").otherwise(F.col("name"))
    return quality.encode_labels(decoded.withColumn("word", word), "word", names, "code").select("doc_id", "name", "word", "code")


def holdout_split(spark, sf_dir):
    return quality.holdout_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), 20)


def assemble_result(spark, sf_dir):
    rows = _with_labels(spark, sf_dir, "text", "lang")
    return quality.assemble(rows, "text", "quality", "lang")


def _embedded(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), F.col("label").alias("topic"))


def nearest_centroid(spark, sf_dir):
    rows = _embedded(spark, sf_dir)
    found = topics.nearest_centroid(rows.drop("topic"), topics.centroids(rows), "vec")
    return found.select("doc_id", "topic", six("distance").alias("distance"))


def topic_probabilities(spark, sf_dir):
    rows = _embedded(spark, sf_dir)
    found = topics.topic_probabilities(rows, topics.centroids(rows))
    return found.select("doc_id", F.posexplode("probabilities").alias("place", "share")).select(
        "doc_id", "place", six("share").alias("share")
    )


def topic_sizes(spark, sf_dir):
    return topics.topic_sizes(_embedded(spark, sf_dir))


def min_topic_size(spark, sf_dir):
    return topics.apply_min_size(_embedded(spark, sf_dir), 50).select("doc_id", "topic")


def cosine_knn(spark, sf_dir):
    found = neighbors.nearest_neighbors(_embedded(spark, sf_dir), 15, method="exact")
    return found.select("id", "neighbor", "rank", six("distance").alias("distance"))


def knn_lsh(spark, sf_dir):
    return neighbors.nearest_neighbors(_embedded(spark, sf_dir), 15, method="lsh")


def knn_descent(spark, sf_dir):
    found = neighbors.nearest_neighbors(_embedded(spark, sf_dir), 15, method="descent")
    return found.select("id", "neighbor", "rank", six("distance").alias("distance"))


def topic_similarity(spark, sf_dir):
    found = reports.topic_similarity(_weights(spark, sf_dir), "lang")
    return found.select("t1", "t2", six("cosine").alias("cosine"))


def term_decline(spark, sf_dir):
    found = reports.term_decline(_weights(spark, sf_dir), "lang", fixed.TOP_TERMS)
    return found.select("lang", "rank", six("weight").alias("weight"))


def topic_words(spark, sf_dir):
    return reports.topic_words(_weights(spark, sf_dir), "lang", 5)


def topic_map(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return reports.topic_map(_weights(spark, sf_dir), topics.topic_sizes(docs, "lang"), "lang")


def topic_distribution(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = reports.topic_distribution(docs, "text", _weights(spark, sf_dir), by="lang")
    return found.select("doc_id", "lang", six("share").alias("share"))


def topics_per_class(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text", "lang").join(_labelled(spark, sf_dir), "doc_id")
    return reports.topics_per_class(rows, "text", "quality", "lang")


def weighted_metrics(spark, sf_dir):
    found = metrics.weighted_metrics(_labelled(spark, sf_dir), "quality", "toxic")
    return found.select("metric", six("value").alias("value"))


def confusion(spark, sf_dir):
    return metrics.confusion(_labelled(spark, sf_dir), "quality", "toxic")


def confusion_wide(spark, sf_dir):
    found = metrics.confusion_wide(_labelled(spark, sf_dir), "quality", "toxic")
    return found.withColumnsRenamed({"0": "pred_0", "1": "pred_1"})


def class_report(spark, sf_dir):
    found = metrics.class_report(_labelled(spark, sf_dir), "quality", "toxic", fixed.CLASS_NAMES)
    return found.select("label", "name", *[six(c).alias(c) for c in ("precision", "recall", "f1")], "support")


def _scored(spark, sf_dir) -> DataFrame:
    k = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("bigint") % 1000
    pair = F.array((1000 - k) / 1000.0, k / 1000.0)
    return _labelled(spark, sf_dir).select("doc_id", "quality", pair.alias("probabilities"))


def roc_points(spark, sf_dir):
    found = metrics.roc_points(_scored(spark, sf_dir), "quality", "probabilities")
    return found.select("score", six("fpr").alias("fpr"), six("tpr").alias("tpr"))


def roc_micro(spark, sf_dir):
    found = metrics.roc_auc_micro(_scored(spark, sf_dir), "quality", "probabilities")
    return found.select("metric", six("value").alias("value"))


def metrics_on_topics(spark, sf_dir):
    # Rows without a label stay in the table and are left out by the metrics.
    rows = _embedded(spark, sf_dir).join(_labelled(spark, sf_dir), "doc_id", "left")
    found = metrics.topic_metrics(rows, "quality", "topic", by_majority=True)
    return found.select("metric", six("value").alias("value"))


def _lang_words(spark, sf_dir, n=fixed.TOP_TERMS):
    return terms.top_terms(_weights(spark, sf_dir), "lang", n)


def coherence_cv(spark, sf_dir):
    found = coherence.coherence_by_topic(documents(spark, sf_dir), "text", _lang_words(spark, sf_dir), by="lang")
    return found.select("lang", six("coherence").alias("coherence"))


def coherence_wide(spark, sf_dir):
    words = _lang_words(spark, sf_dir, WIDE_TERMS)
    found = coherence.coherence_by_topic(documents(spark, sf_dir), "text", words, n=WIDE_TERMS, by="lang")
    return found.select("lang", six("coherence").alias("coherence"))


def _text_vectors(spark, sf_dir) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(vecs, "doc_id")


def _described(spark, sf_dir):
    docs = _text_vectors(spark, sf_dir)
    words = _lang_words(spark, sf_dir, describe.CANDIDATES)
    centres = topics.centroids(docs, "lang", "vec")
    return words, describe.term_vectors(docs, "text", words), centres


def rerank_terms(spark, sf_dir):
    words, vecs, centres = _described(spark, sf_dir)
    found = describe.rerank_by_similarity(words, vecs, centres, fixed.TOP_TERMS, "lang")
    return found.select("lang", "term", six("weight").alias("weight"), "rank")


def mmr_terms(spark, sf_dir):
    words, vecs, centres = _described(spark, sf_dir)
    return describe.diverse_terms(words, vecs, centres, fixed.TOP_TERMS, 0.3, "lang")


def zero_shot_names(spark, sf_dir):
    words, vecs, centres = _described(spark, sf_dir)
    listed = words.where("rank <= 2").select("term").distinct()
    names = vecs.join(listed, "term", "left_semi").select(F.col("term").alias("name"), "vec")
    found = describe.zero_shot_names(centres, names, 0.2, "lang")
    return found.select("lang", "name", six("similarity").alias("similarity"))


def _features(spark, sf_dir) -> DataFrame:
    return _embedded(spark, sf_dir).select("doc_id", as_vector("vec").alias("vec"), F.col("topic").alias("label"))


def sentence_vectors(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = vectors.fit_sentence_vectors(docs, "text")
    return model.transform(docs).select("doc_id", F.col("vec").cast("string").alias("vec"))


def word_position_vectors(spark, sf_dir):
    docs = pin(_text_vectors(spark, sf_dir))
    words = terms.count_terms(docs, "text", "lang").select("term").distinct()
    vecs = pin(describe.term_vectors(docs, "text", words).select(F.col("term").alias("word"), "vec"))
    flat = vectors.word_position_vectors(docs, "text", vecs, 64, 30)
    first = vectors.first_token_vectors(flat, 64)
    return flat.join(first.withColumnRenamed("vec", "first"), "doc_id").select(
        "doc_id", F.size("vec").alias("width"), six(F.array_max("vec")).alias("largest"), six(F.array_max("first")).alias("first")
    )


def pca_vectors(spark, sf_dir):
    rows = _features(spark, sf_dir)
    return vectors.fit_reduction(rows, 5).transform(rows).select("doc_id", F.col("reduced").cast("string").alias("reduced"))


def document_map(spark, sf_dir):
    return reports.document_map(_features(spark, sf_dir), "vec", "label")


def kmeans_topics(spark, sf_dir):
    rows = _features(spark, sf_dir)
    return clusters.kmeans(5, "vec").fit(rows).transform(rows).select("doc_id", "cluster")


def mixture_topics(spark, sf_dir):
    rows = _features(spark, sf_dir)
    reduced = vectors.fit_reduction(rows, 5).transform(rows)
    return clusters.gaussian_mixture(5).fit(reduced).transform(reduced).select("doc_id", "cluster")


def _reduced(spark, sf_dir):
    rows = _features(spark, sf_dir)
    return vectors.fit_reduction(rows, 5).transform(rows).select("doc_id", "reduced")


def density_topics(spark, sf_dir):
    return clusters.density_clusters(_embedded(spark, sf_dir), "vec", min_size=2, min_points=5, eps=1.15)


def ward_topics(spark, sf_dir):
    return clusters.ward_clusters(_reduced(spark, sf_dir), 5)


def spectral_topics(spark, sf_dir):
    return clusters.spectral_clusters(_reduced(spark, sf_dir), 5)


def reduce_topics(spark, sf_dir):
    docs = documents(spark, sf_dir).join(
        _embedded(spark, sf_dir).select("doc_id", "topic"), "doc_id"
    ).select("doc_id", "text", "topic")
    weights = terms.ctfidf(terms.count_terms(docs, "text", "topic"), "topic")
    names = topics.reduce_topics(reports.topic_similarity(weights), topics.topic_sizes(docs), 5)
    return topics.rename_topics(docs, names).select("doc_id", "topic")


def _classes(spark, sf_dir):
    names = ("de", "en", "es", "fr")
    code = F.create_map(*[F.lit(v) for i, n in enumerate(names) for v in (n, float(i))])[F.col("lang")]
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", code.alias("label"))
    return quality.train_test(docs, 20)


def _predicted(model, test):
    predicted, _ = classify.outcome(model)
    return model.transform(test).select("doc_id", F.col("label").cast("int").alias("label"), predicted.alias("prediction"))


def classify_lr(spark, sf_dir):
    from pyspark.ml import Pipeline

    train, test = _classes(spark, sf_dir)
    stages = [*vectors.sentence_stages("text"), classify.logistic()]
    return _predicted(Pipeline(stages=stages).fit(train), test)


def classify_nb(spark, sf_dir):
    train, test = _classes(spark, sf_dir)
    return _predicted(bayes.fit_text_naive_bayes(train, "text", "label"), test)


def retrain_nb(spark, sf_dir):
    """One model from two batches of the training rows: the counts of the second are added to those of the first."""
    train, test = _classes(spark, sf_dir)
    first = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    parts = [bayes.fit_text_naive_bayes(train.where(own), "text", "label") for own in (first, ~first)]
    return _predicted(parts[0].merged(parts[1]), test)


def classify_mlp(spark, sf_dir):
    from pyspark.ml import Pipeline

    train, test = _classes(spark, sf_dir)
    stages = [*vectors.sentence_stages("text"), classify.perceptron(256, 4)]
    return _predicted(Pipeline(stages=stages).fit(train), test)


def table_digest(spark, sf_dir):
    from tamhis.sources.runs import table_digest as digest

    return digest(table(spark, sf_dir, "documents")).select("rows", F.col("digest").cast("string").alias("digest"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    marked = lambda: F.translate(F.lower("text"), MARKED_FROM, MARKED_TO)
    smiling = lambda: F.translate("text", EMOJI_FROM, EMOJI_TO)
    found = {
        "normalize_arabic": _text_rule(tx.normalize, arabic),
        "fold_letters": _text_rule(tx.fold_letters, arabic),
        "strip_marks": _text_rule(lambda c: tx.strip_tatweel(tx.strip_diacritics(c)), marked),
        "strip_space": _text_rule(lambda c: tx.strip_space(F.concat(F.lit(" \t "), c, F.lit(" \n ")))),
        "remove_url_email": _text_rule(tx.remove_url_email),
        "remove_punct": _text_rule(tx.remove_punctuation),
        "collapse_chars": _text_rule(tx.collapse_repeated_chars),
        "collapse_words": _text_rule(tx.collapse_repeated_words),
        "drop_long_words": _text_rule(tx.remove_long_words),
        "map_emojis": _text_rule(lambda c: tx.map_emojis(c, EMOJI_WORDS), smiling),
        "remove_emojis": _text_rule(tx.remove_emojis, smiling),
        "remove_latin": _text_rule(tx.remove_latin, mixed),
        "drop_stopwords": _text_rule(lambda c: tx.remove_stopwords(c, ("the", "of", "de", "und"))),
        "light_stem": _text_rule(tx.stem, arabic),
        "segment": _text_rule(tx.segment, arabic),
    }
    for query in (
        dedupe_rows, drop_nulls, quality_report, recheck_quality, strip_page_links, detect_language, clean_chain,
        clean_table, translate_routed, translation_rounds, untranslated_texts, spelling_fix, count_terms, ngrams, ctfidf, ctfidf_bm25,
        top_terms, encode_fixed, encode_labels, holdout_split, assemble_result, nearest_centroid, topic_probabilities,
        topic_sizes, min_topic_size, cosine_knn, knn_lsh, knn_descent, topic_similarity, term_decline, topic_words, topic_map,
        topic_distribution, topics_per_class, weighted_metrics, confusion, confusion_wide, class_report, roc_points,
        roc_micro, metrics_on_topics, coherence_cv, coherence_wide, rerank_terms, mmr_terms, zero_shot_names, sentence_vectors,
        word_position_vectors, pca_vectors, document_map, kmeans_topics, mixture_topics, density_topics, ward_topics,
        spectral_topics, reduce_topics, classify_lr, classify_nb, retrain_nb, classify_mlp, table_digest, spelling_documents, full_chain,
    ):
        found[query.__name__] = query
    return found
