"""Batch jobs from parameter files: ``python -m tamhis.plans.jobs topics|classify --params p.json ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from tamhis.functions import fixed
from tamhis.operators.quality import ID, train_test
from tamhis.operators.translation import read_memory
from tamhis.plans.classification import ReviewClassifier
from tamhis.plans.cleaning import translation_work
from tamhis.plans.topics import TopicExperiment
from tamhis.session import pin
from tamhis.sources.readers import read_class_mapping, read_emoji_map, read_reviews, read_stop_words, review_schema
from tamhis.sources.sinks import write_reviews


def read_params(spark: SparkSession, path: str) -> dict:
    """``{"data_args": {...}, "model_config": {...}}`` from one JSON file."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def class_names(spark: SparkSession, path: str | None) -> dict[int, str]:
    """Class list from a JSON file, or the built-in one."""
    return {r["id"]: r["name"] for r in read_class_mapping(spark, path).collect()} if path else fixed.CLASS_NAMES


def job_tables(spark: SparkSession, args: dict) -> dict:
    """Cleaning tables named in ``data_args``, as ``fit`` and ``train`` take them.

    ``stop_words_file``: one word a line; ``emoji_file``: JSON of emoji to word; ``vocabulary_file``: Parquet ``(word, freq)``;
    ``translation_memory``: folder of a kept memory (``operators.translation.remember``), which may not be there yet;
    it is copied, so that new answers can be put into the folder while the run goes on.
    """
    readers = {
        "stop_words": ("stop_words_file", read_stop_words), "emoji_words": ("emoji_file", read_emoji_map),
        "vocabulary": ("vocabulary_file", lambda s, path: s.read.parquet(path)), "translations": ("translation_memory", lambda s, path: pin(read_memory(s, path))),
    }
    return {name: read(spark, args[key]) for name, (key, read) in readers.items() if args.get(key)}


def write_work_list(reviews: DataFrame, args: dict, tables: dict, text: str) -> None:
    """English texts that the memory lacks, for a translator, as Parquet under ``translation_work_list`` if that is set."""
    if args.get("translate_english") and args.get("translation_work_list"):
        write_reviews(translation_work(reviews, text, tables["translations"]), args["translation_work_list"])


def topics_job(spark, params: dict, reviews_path: str, classes=fixed.CLASS_NAMES, labelled: bool = False, hold_out: int = 20):
    """Fit topics on a part of the reviews and assign them to the held-out rest: ``(experiment, train, held_out)``."""
    args = params.get("data_args", {})
    text, target = args.get("text_col", "Review Text"), args.get("target_col", "Label")
    reviews = read_reviews(spark, reviews_path, review_schema(text, target if labelled else None))
    train, held_out = train_test(reviews, hold_out)
    run, tables = TopicExperiment(params, classes), job_tables(spark, args)
    write_work_list(reviews, args, tables, text)
    annotated = run.fit(train, **tables)
    return run, annotated, run.validation(held_out)


def classification_job(
    spark, params: dict, labelled_path: str, unlabelled_path: str | None = None, classes=fixed.CLASS_NAMES, hold_out: int = 10
) -> tuple[ReviewClassifier, DataFrame, DataFrame | None]:
    """Train on labelled reviews, score the held-out part, predict the unlabelled ones.

    Metrics are appended to the table ``results_dir``; all evaluation tables (confusion, class report, ROC) go below ``visual_dir``.
    """
    args = params.get("data_args", {})
    text, target = args.get("text_col", "Review Text"), args.get("target_col", "Label")
    labelled = read_reviews(spark, labelled_path, review_schema(text, target))
    train, held_out = train_test(labelled, hold_out)
    run, tables = ReviewClassifier(params, classes), job_tables(spark, args)
    run.train(train, **tables)
    scores = run.evaluate(held_out, args.get("results_dir"))
    if args.get("visual_dir"):
        for name, found in run.evaluation_tables(held_out).items():
            found.write.mode("overwrite").parquet(f"{args['visual_dir'].rstrip('/')}/{name}")
    every, predicted = labelled.select(ID, text), None
    if unlabelled_path:
        new = read_reviews(spark, unlabelled_path, review_schema(text, None))
        every, predicted = every.unionByName(new.select(ID, text)), run.predict(new)
    write_work_list(every, args, tables, text)
    return run, scores, predicted


def main(argv=None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("task", choices=("topics", "classify"))
    parser.add_argument("--params", required=True)
    parser.add_argument("--reviews", required=True, help="reviews CSV; labelled ones for classify")
    parser.add_argument("--unlabelled", help="reviews to predict (classify)")
    parser.add_argument("--classes", help="JSON of class id to name")
    parser.add_argument("--labelled", action="store_true", help="the reviews have a label column (topics)")
    parser.add_argument("--output", help="folder for predictions (classify)")
    options = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tamhis").getOrCreate()
    params, classes = read_params(spark, options.params), class_names(spark, options.classes)
    if options.task == "topics":
        run, _, _ = topics_job(spark, params, options.reviews, classes, options.labelled)
        run.model.words.orderBy("topic", "rank").show(200, truncate=False)
        return
    _, scores, predicted = classification_job(spark, params, options.reviews, options.unlabelled, classes)
    scores.show(truncate=False)
    if predicted is not None and options.output:
        predicted.write.mode("overwrite").parquet(options.output)


if __name__ == "__main__":
    main()
