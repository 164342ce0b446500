"""Readers, writers and run records."""

import datetime as dt
import random

import pytest

from tamhis.functions import fixed
from tamhis.session import use_checkpoint_dir
from tamhis.sources import readers, runs, sinks


def test_read_reviews(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('Review Text,Label\n"a ""q"", b\nline two",Issue\n,Issue\nNA,Positive\nok,\n', encoding="utf-8")
    df = readers.read_reviews(spark, str(path))
    rows = df.orderBy("doc_id").collect()
    assert [(r["Review Text"], r["Label"]) for r in rows] == [
        ('a "q", b\nline two', "Issue"), (None, "Issue"), (None, "Positive"), ("ok", None)
    ]
    assert len({r["doc_id"] for r in rows}) == 4
    one = readers.read_reviews(spark, str(path), readers.review_schema(label_col="Label"))
    assert one.columns == ["doc_id", "Review Text", "Label"]


def test_reviews_keep_further_columns_and_ids(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for part in range(3):
        lines = [f"text {part} {i},Issue,{'' if i % 5 else 'note'}" for i in range(200)]
        (folder / f"r{part}.csv").write_text("Review Text,Label,Note\n" + "\n".join(lines) + "\n", encoding="utf-8")
    whole = sorted(map(tuple, readers.read_reviews(spark, str(folder)).collect()))
    assert [r[0] for r in whole] == list(range(600)) and [r[1] for r in whole[:2]] == ["text 0 0", "text 0 1"]
    assert {r[3] for r in whole} == {"note", None}
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        split = readers.read_reviews(spark, str(folder), multi_line=False)
        assert sorted(map(tuple, split.collect())) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    with pytest.raises(ValueError):
        readers.read_reviews(spark, str(folder), readers.review_schema("Absent", None))


def test_mappings(spark, tmp_path):
    classes = tmp_path / "c.json"
    classes.write_text('{\n "0": "Negative",\n "3": "Issue"\n}', encoding="utf-8")
    assert {tuple(r) for r in readers.read_class_mapping(spark, str(classes)).collect()} == {(0, "Negative"), (3, "Issue")}
    emojis = tmp_path / "e.json"
    emojis.write_text('{"😀": "سعيد"}', encoding="utf-8")
    assert readers.read_emoji_map(spark, str(emojis)) == {"😀": "سعيد"}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\nc', "x")], "doc_id long, t string, label string")
    path = sinks.write_reviews(df, str(tmp_path / "csv"), "csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    assert back.first()["t"] == 'a "q", b\nc'
    with pytest.raises(ValueError):
        sinks.write_reviews(df, path, "xml")
    with pytest.raises(ValueError):
        sinks.write_annotation(df, path, "other")
    scores = spark.createDataFrame([("accuracy", 0.5)], "metric string, value double")
    with pytest.raises(ValueError):
        sinks.append_performance(scores, None)
    table = str(tmp_path / "perf")
    sinks.append_performance(scores, table, "Training")
    sinks.append_performance(scores, table, "Test", dt.datetime(2024, 1, 1))
    assert {r["task"] for r in spark.read.parquet(table).collect()} == {"Training", "Test"}


def test_runs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, t string")
    same = runs.table_digest(df.repartition(2)).first()
    assert runs.table_digest(df).first() == same and same["rows"] == 2
    assert runs.table_digest(df.where("doc_id = 1")).first() != same
    assert runs.enabled_steps({"check_spelling": True, "normalize": True, "text_col": "x"}) == ["normalize", "check_spelling"]


def test_checkpoint_dir_is_kept(spark):
    assert use_checkpoint_dir(spark) == use_checkpoint_dir(spark)


def _by_one_task(spark, path):
    """Cells of each file as Spark reads it whole."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("lineSep", "\n")
    return [tuple(None if c in fixed.NA_TOKENS else c for c in r) for r in reader.csv(str(path)).collect()]


def _cell(draw):
    plain = draw.choice(["a", "NA", "", "b c", "x", "é", " y"])
    quoted = '"' + "".join(draw.choice(["a", ",", "\n", "\r\n", '""', "word ", "é", '""""']) for _ in range(draw.randrange(8))) + '"'
    return quoted if draw.random() < 0.5 else plain if draw.random() < 0.8 else plain + 'z5" w'


@pytest.mark.parametrize("seed", range(3))
def test_split_files_give_the_records_of_whole_ones(spark, tmp_path, seed):
    draw = random.Random(seed)
    folder = tmp_path / "many"
    folder.mkdir()
    for part in range(2):
        rows = [",".join(_cell(draw) for _ in range(3)) + draw.choice(["\n", "\n", "\n\n"]) for _ in range(120)]
        body = 'Review Text,Label,"No\nte"\n' + "".join(rows)
        (folder / f"r{part}.csv").write_bytes(body.encode() + (b'last,"never, closed\nto the\nend' if part and seed else b""))
    expected = [row for part in range(2) for row in _by_one_task(spark, folder / f"r{part}.csv")]
    if seed:
        expected = expected[:-1] + [("last", "never, closed\nto the\nend", None)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("97", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = readers.read_reviews(spark, str(folder))
            rows = sorted(map(tuple, found.collect()), key=lambda r: r[0])
            assert [r[0] for r in rows] == list(range(len(expected)))
            assert [r[1:] for r in rows] == expected
            assert found.columns == ["doc_id", "Review Text", "Label", "No\nte"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_file_of_long_quoted_texts_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "long.csv"
    texts = [f'"{i} ""quoted"", ' + "line\n" * (i % 400) + 'end"' for i in range(1, 300)]
    path.write_text("Review Text,Label\r\n" + "".join(f"{t},Issue\r\n" for t in texts) + ",\r\n", encoding="utf-8", newline="")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(n) for n in names]
    for name, value in zip(names, ("20000", "100")):
        spark.conf.set(name, value)
    try:
        assert spark.read.option("lineSep", "\n").text(str(path)).rdd.getNumPartitions() > 10
        rows = sorted(map(tuple, readers.read_reviews(spark, str(path)).collect()), key=lambda r: r[0])
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    assert [r[1] for r in rows[:-1]] == [t[1:-1].replace('""', '"') for t in texts]
    assert {r[2] for r in rows[:-1]} == {"Issue"} and rows[-1] == (299, None, None)


def test_header_alone_gives_no_reviews(spark, tmp_path):
    path = tmp_path / "empty.csv"
    path.write_text("Review Text,Label\n", encoding="utf-8")
    found = readers.read_reviews(spark, str(path))
    assert found.count() == 0 and found.columns == ["doc_id", "Review Text", "Label"]
