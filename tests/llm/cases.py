"""Small tables with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import duckdb
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(9_000))
LINE = "Common footer line, number 7.\n"
ROWS = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\r\n \n", None, None, 5), (None, "text of a row without an id, nine words or more here", "en", None, 3),
    (5, LONG, "en", "a", len(LONG)), (6, "Released under the MIT License.\nsame line here\nsame line here\n" * 3, "en", "a", 1),
    (7, "one two three four five one two three four five six seven eight nine ten", "en", "b", 1),
    (7, "one two three four five one two three four five six seven eight nine ten", "en", "b", 1), (9, "équipe déjà vu # $5 | <b>Zoë</b> 😀 ÄÖÜ ", "fr", "b", 1),
    (10, "x" * 3_000, "de", "b", 1), (11, "12345 !!! ###", "de", "b", 1), (12, LONG.replace("word5 ", "other5 "), "en", "a", 1), (12, "a different text under the same id", "en", "a", 1),
    *[(100 + i, LINE + f"Own words of document {chr(97 + i)} {chr(98 + i)} stand here and make it long enough to keep, {chr(99 + i)} times.\n", "en", "hot", 1) for i in range(14)],
    *[(200 + i, "Copy line one is here.\nCopy line two is there, with more words than ten in all.\n", "en", "hot", 1) for i in range(30)],
]
#: Names that operators use for results or inside.
EXTRA = ("score", "kept", "key", "h", "host", "n", "node", "label", "size", "ids", "piece", "start", "shard", "slot", "words", "file", "block", "lang_pred", "labels", "leaks", "class_id",
         "n_words", "n_base", "bytes", "n_tokens", "s", "leader", "a", "b", "row", "total", "place", "line_text", "parts", "cut", "data", "item", "item_id", "predicted", "toxic")


def documents(spark, rows=ROWS, extra=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *[F.lit("clash").alias(name) for name in EXTRA]) if extra else df


def duck(**tables):
    con = duckdb.connect()
    for name, df in tables.items():
        arrow = df.toArrow()
        con.register(f"{name}_arrow", arrow)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_arrow")
    return con


def same(df, con, sql):
    from tests.compare import duck_rows, spark_rows

    got, want = spark_rows(df), duck_rows(con, sql)
    assert got[0] == want[0]
    assert sorted(map(repr, got[1])) == sorted(map(repr, want[1]))
