"""The batch jobs from parameter files."""

import json

import pytest
from pyspark.sql import functions as F

from tamhis.functions import fixed
from tamhis.operators.translation import remember
from tamhis.plans import jobs
from tamhis.plans.classification import ReviewClassifier
from tests.test_models import reviews


def test_jobs(spark, tmp_path):
    rows = [(r["Review Text"], r["Label"]) for r in reviews(spark, 60).collect()]
    labelled, plain, params = tmp_path / "l.csv", tmp_path / "u.csv", tmp_path / "p.json"
    labelled.write_text("Review Text,Label\n" + "\n".join(f"{t},{c}" for t, c in rows), encoding="utf-8")
    plain.write_text("Review Text\n" + "\n".join(t for t, _ in rows), encoding="utf-8")
    params.write_text(json.dumps({
        "data_args": {"check_spelling": False},
        "model_config": {"n_topics": 2, "n_components": 2, "vector_dims": 64, "head": "lr", "representation_model_list": []},
    }), encoding="utf-8")
    classes = tmp_path / "c.json"
    classes.write_text('{"1": "Positive", "3": "Issue"}', encoding="utf-8")
    settings = jobs.read_params(spark, str(params))
    names = jobs.class_names(spark, str(classes))
    assert names == {1: "Positive", 3: "Issue"}
    run, train, held_out = jobs.topics_job(spark, settings, str(plain))
    assert train.count() + held_out.count() == 60 and set(held_out.columns) == {"doc_id", "review", "label", "topic"}
    assert run.model.words.where("rank <= 3").count() > 0
    _, scores, predicted = jobs.classification_job(spark, settings, str(labelled), str(plain), names)
    assert {r["metric"]: r["value"] for r in scores.collect()}["accuracy"] == 1.0
    assert predicted.count() == 60


def test_jobs_with_their_tables(spark, tmp_path):
    rows = [(f"good service number {i % 12}" if i % 2 else f"خدمه سيئه 😀 زائد {i % 12}", "Positive" if i % 2 else "Issue") for i in range(72)]
    labelled, stop, emoji, memory, work = (str(tmp_path / n) for n in ("l.csv", "stop.txt", "emoji.json", "memory", "work"))
    (tmp_path / "l.csv").write_text("doc_id,Review Text,Label\n" + "\n".join(f"{i},{t},{c}" for i, (t, c) in enumerate(rows)), encoding="utf-8")
    (tmp_path / "stop.txt").write_text("زائد\nآخر\n", encoding="utf-8")
    (tmp_path / "emoji.json").write_text('{"😀": "سعيد"}', encoding="utf-8")
    steps = {s: False for s in fixed.CLEANING_STEPS} | {"map_emojis": True, "remove_stopwords": True, "translate_english": True}
    params = {
        "data_args": {**steps, "stop_words_file": stop, "emoji_file": emoji, "translation_memory": memory, "translation_work_list": work,
                      "visual_dir": str(tmp_path / "visual"), "results_dir": str(tmp_path / "scores")},
        "model_config": {"head": "nb"},
    }
    unknown = {f"good service number {i}" for i in range(1, 12, 2)}
    run, _, _ = jobs.classification_job(spark, params, labelled)
    texts = {r["Review Text"] for r in run._seen.collect()}
    assert any("good" in t for t in texts) and not any("زائد" in t or "😀" in t for t in texts) and any("سعيد" in t for t in texts)
    asked = spark.read.parquet(work)
    assert {r["source_text"] for r in asked.collect()} == unknown
    # Second round: the answers are found, by both jobs, and no work is left.
    remember(asked.select("source_text", F.regexp_replace("source_text", "good service number", "خدمه ممتازه رقم").alias("target_text")), memory)
    run, scores, predicted = jobs.classification_job(spark, params, labelled, labelled)
    assert not any("good" in r["Review Text"] for r in run._seen.collect())
    assert spark.read.parquet(work).count() == 0 and predicted.count() == 72
    assert {r["predicted"] for r in predicted.where("doc_id % 2 = 1").collect()} == {"Positive"}
    for name in ("metrics", "confusion", "class_report", "roc_points", "roc_auc"):
        assert spark.read.parquet(str(tmp_path / "visual" / name)).count() > 0, name
    assert {r["metric"]: r["value"] for r in scores.collect()}["accuracy"] == 1.0
    again = ReviewClassifier.load(spark, run.save(str(tmp_path / "saved")))
    one = spark.createDataFrame([(1, "good service number 3", None), (2, None, None)], "doc_id long, `Review Text` string, Label string")
    assert [r["predicted"] for r in again.predict(one).orderBy("doc_id").limit(1).collect()] == ["Positive"] and again.predict(one).count() == 2

    params["data_args"] = {k: v for k, v in params["data_args"].items() if k not in ("visual_dir", "results_dir")}
    params["model_config"] = {"n_topics": 2, "n_components": 2, "vector_dims": 64, "representation_model_list": [], "ngram_range": (1, 1)}
    topics, annotated, held_out = jobs.topics_job(spark, params, labelled)
    for found in (annotated.select("Review Text"), held_out.select("review")):
        cleaned = [r[0] for r in found.collect()]
        assert cleaned and not any("good" in t or "زائد" in t or "😀" in t for t in cleaned)
    assert spark.read.parquet(work).count() == 0


def test_first_token_features(spark, tmp_path):
    # The first word alone tells the class; the others are the same in both.
    rows = [(i, f"{'ممتاز' if i % 2 else 'سيء'} تطبيق خدمه جميل {i}", "Positive" if i % 2 else "Issue") for i in range(80)]
    df = spark.createDataFrame(rows, ["doc_id", "Review Text", "Label"])
    run = ReviewClassifier({"data_args": {s: False for s in fixed.CLEANING_STEPS},
                            "model_config": {"head": "lr", "features": "first_token", "vector_dims": 8}})
    run.train(df)
    asked = spark.createDataFrame([(1, "ممتاز", None), (2, "سيء تطبيق", None), (3, "مجهول", None), (4, None, None)], "doc_id long, `Review Text` string, Label string")
    frozen = sorted(map(tuple, run.words.collect()))
    for model in (run, ReviewClassifier.load(spark, run.save(str(tmp_path / "m")))):
        got = {r["doc_id"]: r["predicted"] for r in model.predict(asked).collect()}
        assert len(got) == 4 and (got[1], got[2]) == ("Positive", "Issue")
        # The label column plays no part, and a text without a known first word has the shares of zeros.
        assert got[3] == got[4]
    run.retrain(df.withColumn("doc_id", F.col("doc_id") + 100))
    assert sorted(map(tuple, run.words.collect())) == frozen
    for bad in ({"features": "x"}, {"head": "nb", "features": "first_token"}):
        with pytest.raises(ValueError):
            ReviewClassifier({"model_config": bad})
