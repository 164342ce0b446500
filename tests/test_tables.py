"""Set-level rules: quality, labels, spelling, translation, terms, encoding, metrics."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamhis import session
from tamhis.checks import queries
from tamhis.functions import fixed
from tamhis.operators import coherence, encoding, metrics, quality, spelling, terms, translation
from tamhis.plans import cleaning
from tamhis.plans.cleaning import flags_from, preprocess
from tamhis.session import running_totals


def test_quality(spark):
    df = spark.createDataFrame(
        [(1, "a", "x"), (2, "a", "x"), (3, None, "x"), (4, None, "x"), (5, "", "y")], "doc_id long, text string, label string"
    )
    assert {r["doc_id"] for r in quality.check_quality(df, "text").collect()} == {1, 5}
    assert quality.quality_report(df).first().asDict() == {
        "original_rows": 5, "duplicates_removed": 2, "null_rows_removed": 1, "final_rows": 2
    }
    empty = quality.quality_report(df.where("doc_id < 0")).first()
    assert tuple(empty) == (0, 0, 0, 0)


def test_digest_separates_parts(spark):
    df = spark.createDataFrame([("a", "b|c"), ("a|b", "c"), (None, ""), ("", None)], "x string, y string")
    assert df.select(quality.row_digest(["x", "y"])).distinct().count() == 4


def test_preprocess_checks_quality_again(spark, tmp_path):
    df = spark.createDataFrame([(1, "جيد!", "A"), (2, "جيد", "A"), (3, "جيد", "B"), (4, None, "A"), (5, "!", "A")],
                               "doc_id long, t string, label string")
    got = preprocess(df, "t", flags_from(("remove_punct",)), save_to=str(tmp_path / "clean"))
    assert {tuple(r) for r in got.collect()} == {(1, "جيد", "A"), (3, "جيد", "B"), (5, "", "A")}
    with pytest.raises(ValueError):
        preprocess(df, "t", {"translate_english": True})


def test_labels(spark):
    df = spark.createDataFrame([("Issue",), ("Other",), (None,)], "label string")
    assert [r[0] for r in quality.encode_labels(df, "label", fixed.CLASS_NAMES).collect()] == [3, None, None]
    table = spark.createDataFrame(list(fixed.CLASS_NAMES.items()), "id int, name string")
    joined = quality.encode_labels(df, "label", table, "code")
    assert {(r["label"], r["code"]) for r in joined.collect()} == {("Issue", 3), ("Other", None), (None, None)}
    back = quality.decode_labels(joined, "code", table, "name").where("label = 'Issue'").first()
    assert back["name"] == "Issue"


def test_split_is_stable(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    train, test = quality.train_test(df, 20)
    again = quality.train_test(df.repartition(7), 20)[1]
    assert {r[0] for r in test.collect()} == {r[0] for r in again.collect()}
    assert train.count() + test.count() == 5000 and 850 < test.count() < 1150
    one, two = quality.train_test(df, 10, seed=1)
    assert one.count() + two.count() == 5000


def test_running_totals(spark):
    rows = [(i, (i * 37) % 101) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    got = running_totals(df, [F.desc("v"), F.asc("k")], {"place": F.lit(1), "total": F.col("v")}).collect()
    place = total = 0
    want = {}
    for k, v in sorted(rows, key=lambda r: (-r[1], r[0])):
        place, total = place + 1, total + v
        want[k] = (place, total)
    assert {r["k"]: (r["place"], r["total"]) for r in got} == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_spelling_equals_brute_force(spark):
    rng = random.Random(7)
    words = {"".join(rng.choice("abcdسع") for _ in range(rng.randint(1, 7))) for _ in range(150)}
    roots = ["".join(rng.choice("abcdسع") for _ in range(n)) for n in (22, 24, 25, 26, 27, 28, 40)]

    def changed(word):
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word))
            word = word[:at] + rng.choice(["", "x", "xe"]) + word[at + rng.randint(0, 1):]
        return word

    vocabulary = {w: rng.randint(1, 9) for w in words | set(roots) | {changed(r) for r in roots for _ in range(3)}}
    tokens = sorted({"".join(rng.choice("abcdeسعé") for _ in range(rng.randint(1, 8))) for _ in range(250)} | {"z" * 30, "y" * 5000}
                    | {changed(r) for r in roots for _ in range(12)})
    got = spelling.correct_tokens(
        spark.createDataFrame([(t,) for t in tokens], "token string"),
        spark.createDataFrame(list(vocabulary.items()), "word string, freq long"),
    )
    want = {}
    for t in tokens:
        if t in vocabulary or len(t) > 100:
            continue
        near = [(-distance(t, w), f, w) for w, f in vocabulary.items() if distance(t, w) <= 2]
        if near:
            want[t] = max(near, key=lambda x: (x[0], x[1], x[2].encode()))[2]
    assert {r["token"]: r["fix"] for r in got.collect()} == want


def test_spelling_by_deletions(spark):
    rng = random.Random(11)
    word = lambda low, high: "".join(rng.choice("abسé") for _ in range(rng.randint(low, high)))
    vocabulary = {word(4, 11): rng.randint(1, 3) for _ in range(200)}
    tokens = sorted({word(4, 11) for _ in range(300)} - vocabulary.keys())
    table = spark.createDataFrame(list(vocabulary.items()), "word string, freq long")
    got = spelling.correct_tokens(spark.createDataFrame([(t,) for t in tokens], "token string"), table)
    want = {}
    for t in tokens:
        near = [(-d, f, w.encode()) for w, f in vocabulary.items() if (d := distance(t, w)) <= 2]
        want |= {t: max(near)[2].decode()} if near else {}
    assert len(want) > 50 and {r["token"]: r["fix"] for r in got.collect()} == want
    # What a long token sends over the network: itself, 12 and 66 deletions, and not four forms of each two places.
    long = spark.createDataFrame([("abcdefghijkl",)], "token string")
    keys = spelling._deletions(long, "token", 2)
    assert keys.count() == keys.select("key").distinct().count() == 79


@pytest.mark.parametrize("forms,rounds", [(1, 4)])
def test_spelling_in_rounds(spark, monkeypatch, forms, rounds):
    rng = random.Random(forms)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 8, 8, 8, 9])))
    table = spark.createDataFrame(list({word(): rng.randint(1, 3) for _ in range(60)}.items()), "word string, freq long")
    tokens = spark.createDataFrame([(word(),) for _ in range(150)], "token string")
    want = sorted(map(tuple, spelling.correct_tokens(tokens, table).collect()))
    monkeypatch.setattr(spelling, "ROUND_FORMS", forms)
    monkeypatch.setattr(spelling, "ROUNDS", rounds)
    turns = spelling._rounds(tokens, table, 2, (7, 25), False)
    assert len(turns) > 1 and all(a[1] < b[0] or (a[:2] == b[:2] and a[2] + 1 == b[2] < b[3]) for a, b in zip(turns, turns[1:]))
    assert (turns[0][0], turns[-1][1]) == (5, 25) and sorted(map(tuple, spelling.correct_tokens(tokens, table).collect())) == want
    # Every deletion of a token is in one round, once.
    long = tokens.distinct().where("length(token) >= 7")
    keys = [tuple(r) for turn in turns for r in spelling._deletions(long, "token", 2, turn).collect()]
    assert sorted(keys) == sorted(map(tuple, spelling._deletions(long, "token", 2).collect()))


def test_kept_tables_leave_no_shuffle_files(spark):
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    rows = spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count()
    assert rows.count() == 7  # an action of its own keeps what it shuffled
    first = spark.sparkContext._jsc.sc().newShuffleId()
    kept = session.pin(rows)
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    last = spark.sparkContext._jsc.sc().newShuffleId()
    deadline = time.time() + 20
    while any(manager.containsShuffle(i) for i in range(first + 1, last)) and time.time() < deadline:
        time.sleep(0.1)
    assert last > first + 1 and not any(manager.containsShuffle(i) for i in range(first + 1, last))
    assert kept.count() == 7 and rows.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before


def test_spelling_of_texts(spark):
    df = spark.createDataFrame([(1, "hello wrld teh"), (2, "helo"), (3, "helo  wordl xxxxxxx"), (4, None), (5, "")],
                               "doc_id long, t string")
    vocabulary = spark.createDataFrame([("hello", 5), ("world", 9), ("the", 7), ("help", 3)], "word string, freq long")
    got = {r[0]: r[1] for r in spelling.check_spelling(df, "t", vocabulary).collect()}
    assert got == {1: "hello world the", 2: "helo", 3: "hello  world xxxxxxx", 4: None, 5: ""}


def test_large_tables_of_fixes_stay_off_the_driver(spark, monkeypatch):
    limits = []
    monkeypatch.setattr(spelling, "small", lambda df, limit=session.BROADCAST_BYTES: limits.append(limit) or df)
    df = spark.createDataFrame([(1, "hello wrld teh"), (2, "hello world the")] * 3, "doc_id long, t string")
    spelling.check_spelling(df, "t", min_count=3).collect()
    assert limits == [spelling.FIXES_BYTES] and limits[0] <= 8 << 20


def test_full_chain_by_brute_force(spark, tmp_path):
    rng = random.Random(3)
    roots = ["".join(rng.choice("bcdefghijlmnoprstuwyz") for _ in range(rng.randint(4, 8))) for _ in range(30)]
    texts = [" ".join(r[:1] + rng.choice(["", "ea"]) + r[2:] if rng.random() < 0.1 else r for r in rng.choices(roots, k=30)) for _ in range(40)]
    texts += [texts[0]] * 5 + [None, "", "x", roots[0] + " " + "a" * 40 + " x vvk, " + roots[1] + "!!!"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["text"] for r in queries.full_chain(spark, str(tmp_path)).collect()}
    source = F.translate(F.translate("text", queries.EMOJI_FROM, queries.EMOJI_TO), queries.LATIN, queries.ARABIC)
    steps = fixed.CLEANING_STEPS
    at = steps.index("check_spelling")
    early = rows.select("doc_id", cleaning.clean_column(source, queries.FULL_CHAIN, emoji_words=queries.EMOJI_WORDS, steps=steps[:at]).alias("text"))
    split = {r["doc_id"]: r["text"].split(" ") if r["text"] is not None else None for r in early.collect()}
    seen = Counter(w for ws in split.values() for w in ws or [] if w)
    known = {w: n for w, n in seen.items() if n >= 5}
    fixes = {}
    for t in seen.keys() - known.keys():
        near = [(-distance(t, w), n, w.encode()) for w, n in known.items() if distance(t, w) <= 2]
        fixes |= {t: max(near)[2].decode()} if near else {}
    right = [(i, None if ws is None else " ".join(fixes.get(w, w) if len(ws) > 1 else w for w in ws)) for i, ws in split.items()]
    late = spark.createDataFrame(right, "doc_id long, text string")
    want = late.select("doc_id", cleaning.clean_column("text", queries.FULL_CHAIN, steps=steps[at + 1 :]).alias("text"))
    assert len(fixes) > 5 and len(got) == len(texts) and got == {r["doc_id"]: r["text"] for r in want.collect()}


def test_translation(spark):
    df = spark.createDataFrame([(1, "hello"), (2, "مرحبا"), (3, "other"), (4, None), (5, "hello")], "doc_id long, t string")
    memory = spark.createDataFrame([("hello", "ب"), ("hello", "اهلا"), ("x", "y")], "source_text string, target_text string")
    got = {r[0]: r[1] for r in translation.translate_english(df, "t", memory).collect()}
    assert got == {1: "اهلا", 2: "مرحبا", 3: "other", 4: None, 5: "اهلا"}
    assert [r[0] for r in translation.untranslated(df, "t", memory).collect()] == ["other"]


def test_terms(spark):
    df = spark.createDataFrame([("a", "Xx yy xx the"), ("b", "yy zz"), (None, "qq")], "topic string, t string")
    listed = terms.count_terms(df, "t", "topic", ("the",))
    table = terms.count_terms(df, "t", "topic", spark.createDataFrame([("the",)], "word string"))
    assert {tuple(r) for r in listed.collect()} == {tuple(r) for r in table.collect()}
    weights = terms.ctfidf(listed, "topic", "base", False).collect()
    assert {r["topic"] for r in weights} == {"a", "b"}
    top = terms.top_terms(terms.ctfidf(listed, "topic"), "topic", 1).collect()
    assert {(r["topic"], r["term"]) for r in top} == {("a", "xx"), ("b", "zz")}
    with pytest.raises(ValueError):
        terms.ctfidf(listed, "topic", "other")
    plan = terms.top_terms(terms.ctfidf(listed, "topic"), "topic", 1)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_encoding(spark):
    df = spark.createDataFrame([(1, "b a b", "L"), (2, "", "M"), (3, "a b c d e f", None), (4, "new b", "N")],
                               "doc_id long, t string, label string")
    vocabulary = encoding.build_vocabulary(df.where("doc_id < 4"), "t")
    ids = {r["term"]: r["term_id"] for r in vocabulary.collect()}
    assert (ids["b"], ids["a"], ids["c"]) == (4, 5, 6)
    got = {r["doc_id"]: r for r in encoding.encode_fixed(df, "t", vocabulary, 6, "label").collect()}
    assert got[1]["ids"] == [2, 4, 5, 4, 3, 0] and got[1]["mask"] == [1, 1, 1, 1, 1, 0]
    assert got[2]["ids"] == [2, 3, 0, 0, 0, 0] and got[2]["label"] == "M"
    assert got[3]["ids"] == [2, 5, 4, 6, 7, 3] and got[3]["label"] is None
    assert got[4]["ids"] == [2, 1, 4, 3, 0, 0]


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 2)], "y int, p int")
    got = {r["metric"]: round(r["value"], 6) for r in metrics.weighted_metrics(df, "y", "p").collect()}
    assert got == {"accuracy": 0.75, "precision": 0.833333, "recall": 0.75, "f1_score": 0.65}
    grid = {(r["y_true"], r["y_pred"]): r["n"] for r in metrics.confusion(df, "y", "p").collect()}
    assert len(grid) == 9 and grid[(1, 0)] == 1 and grid[(1, 1)] == 0
    holed = df.union(spark.createDataFrame([(None, None), (None, 1), (1, None)], "y int, p int"))
    assert {r["metric"]: round(r["value"], 6) for r in metrics.weighted_metrics(holed, "y", "p").collect()} == got
    assert metrics.unjudged(holed, "y", "p").first()["value"] == 3.0
    report = {r["name"]: r["support"] for r in metrics.class_report(df, "y", "p", fixed.CLASS_NAMES).collect()}
    assert report == {"Negative": 2, "Positive": 1, "Suggestion": 1}


def test_roc(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1), (0, 0.5)]
    # One cell per row: class 0 holds the score, so a hit is y = 0.
    df = spark.createDataFrame([(0 if y else 1, [s]) for y, s in rows], "y int, probs array<double>")
    value = metrics.roc_auc_micro(df, "y", "probs").first()["value"]
    assert round(value, 6) == 0.583333
    points = metrics.roc_points(df, "y", "probs").orderBy(F.desc("score")).collect()
    assert [(round(r["fpr"], 3), r["tpr"]) for r in points] == [(0.333, 0.5), (0.667, 0.5), (0.667, 1.0), (1.0, 1.0)]


def test_topic_metrics(spark):
    df = spark.createDataFrame([(0, 5), (0, 5), (1, 5), (1, 7)], "label int, topic int")
    raw = {r["metric"]: r["value"] for r in metrics.topic_metrics(df).collect()}
    named = {r["metric"]: r["value"] for r in metrics.topic_metrics(df, by_majority=True).collect()}
    assert raw["accuracy"] == 0.0 and named["accuracy"] == 0.75


def test_coherence_pairs(spark):
    df = spark.createDataFrame([(1, "aa bb cc dd aa"), (2, "bb"), (3, "")], "doc_id long, t string")
    words = spark.createDataFrame([("t", "aa", 1), ("t", "bb", 2)], "topic string, term string, rank int")
    got = {(r["i"], r["j"]): r["windows"] for r in coherence.pair_windows(df, "t", words, window=2).collect()}
    # Windows of document 1: (aa bb) (bb cc) (cc dd) (dd aa); document 2: (bb).
    assert got == {(0, 0): 2, (1, 1): 3, (0, 1): 1}


@pytest.mark.parametrize("window", [1, 4, 30])
def test_coherence_of_many_words_by_brute_force(spark, window):
    draw = random.Random(window)
    listed = [f"w{i:02d}" for i in range(90)]
    texts = [" ".join(draw.choice([*listed, "hot", "hot", "other"]) for _ in range(draw.randrange(70))) for _ in range(40)] + ["hot " * 50]
    lists = {"a": [*listed[:70], "hot", "never"], "b": listed[40:]}
    words = [(t, w, r + 1) for t, ws in lists.items() for r, w in enumerate(ws)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string")
    words = spark.createDataFrame(words, "topic string, term string, rank int")
    windows = [set(t.split()[i : i + window]) for t in texts if t for i in range(max(len(t.split()) - window + 1, 1))]
    wanted = {}
    for topic, ws in lists.items():
        held = np.array([[w in seen for w in ws] for seen in windows], float)
        joint = held.T @ held
        got = {(r["i"], r["j"]): r["windows"] for r in coherence.pair_windows(df, "t", words, window).where(F.col("topic") == topic).collect()}
        assert got == {(i, j): joint[i, j] for i in range(len(ws)) for j in range(i, len(ws)) if joint[i, j]}
        p = joint / len(windows)
        alone = np.outer(p.diagonal(), p.diagonal())
        with np.errstate(divide="ignore", invalid="ignore"):
            v = np.where(alone > 0, np.log((p + 1e-12) / alone) / -np.log(p + 1e-12), 0.0)
        whole = v.sum(0)
        sizes = np.sqrt((v * v).sum(1)) * np.sqrt((whole * whole).sum())
        wanted[topic] = np.mean([v[i] @ whole / sizes[i] if sizes[i] > 0 else 0.0 for i in range(len(ws))])
    found = {r["topic"]: r["coherence"] for r in coherence.coherence_by_topic(df, "t", words, n=100, window=window).collect()}
    assert found.keys() == wanted.keys() and all(abs(found[t] - wanted[t]) < 1e-9 for t in wanted)


def test_pairs_of_places_are_never_rows(spark, monkeypatch):
    df = spark.createDataFrame([(i, " ".join(["aa", "bb", "cc"][: i + 1] * 40)) for i in range(3)] + [(None, "aa aa")], "doc_id long, t string")
    words = spark.createDataFrame([("t", w, r) for r, w in enumerate(("aa", "bb", "cc"), 1)] + [(None, "aa", 1)], "topic string, term string, rank int")
    found = coherence.pair_windows(df.union(df), "t", words, 5)
    assert "Generate explode" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    wanted = {tuple(r) for r in found.collect()}
    assert {(r[0], r[1], r[2]) for r in wanted} == {("t", i, j) for i in range(3) for j in range(i, 3)} | {(None, 0, 0)}
    monkeypatch.setattr(coherence, "SPOTS", 7)
    monkeypatch.setattr(coherence, "CELLS", 2)
    assert {tuple(r) for r in coherence.pair_windows(df, "t", words, 5).collect()} == wanted


def test_a_memory_moves_no_source_texts(spark):
    df = spark.createDataFrame([(1, "hello"), (2, "other")], "doc_id long, t string")
    memory = spark.range(1).select(F.lit("hello").alias("source_text"), F.lit("x").alias("target_text"))
    memory = memory.union(spark.createDataFrame([("a", "b")], "source_text string, target_text string"))
    found = translation._memory(memory)
    assert "source_text" not in " ".join(found.columns) and found.schema["__source"].dataType.simpleString() == "binary"
    assert sorted(tuple(r) for r in translation.translate_english(df, "t", memory).collect()) == [(1, "x"), (2, "other")]
    merged = translation._by_bucket(memory.withColumn("bucket", F.lit(1)))
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_kept_memory(spark, tmp_path):
    path = str(tmp_path / "memory")
    table = lambda: {tuple(r) for r in translation.read_memory(spark, path).collect()}
    answers = lambda rows: spark.createDataFrame(rows, "source_text string, target_text string")
    assert table() == set()
    first = [(f"text {i}", f"one {i}") for i in range(300)]
    translation.remember(answers([*first, ("text 7", "least"), (None, "x"), ("gone", None)]), path)
    assert table() == {*first} - {("text 7", "one 7")} | {("text 7", "least")}
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "memory").glob("bucket=*/*.parquet")}
    new = answers([("text 9", "two 9"), ("", "empty"), ("new", "n")])
    for _ in range(2):  # the same batch again changes nothing
        translation.remember(new, path)
        assert table() == {*first} - {("text 7", "one 7"), ("text 9", "one 9")} | {("text 7", "least"), ("text 9", "two 9"), ("", "empty"), ("new", "n")}
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "memory").glob("bucket=*/*.parquet")}
    assert len(before.items() & after.items()) >= len(before) - 3  # only the buckets of new answers were replaced
