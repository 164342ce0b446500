"""Golden rows of the text rules and agreement with plain restatements on odd inputs."""

import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamhis.functions import fixed
from tamhis.functions import text as tx
from tamhis.plans.cleaning import CLASSIFIER_FLAGS, TOPIC_FLAGS, clean_column, flags_from
from tamhis.streaming.cleaning import clean_stream

GOLDEN = [
    (tx.normalize, "  إنَّ الخدمةَ مـــمتازة  ", "ان الخدمه ممتازه"),
    (tx.normalize, "  گى\x1c\n", "كي"),
    (tx.strip_space, "\t a b  ", "a b"),
    (tx.remove_url_email, "راسلني على a.b@x.com أو http://x.y/z شكرا", "راسلني على  أو  شكرا"),
    (tx.remove_url_email, "xhttp://a @b c@ @d@e f g@h i", "x @b c@  f  i"),
    (tx.remove_punctuation, "السعر 100/200 ريال!!", "السعر   ريال"),
    (tx.remove_punctuation, "جيد جيد، جيد", "جيد جيد جيد"),
    (tx.remove_punctuation, "12345", ""),
    (tx.collapse_repeated_chars, "جمييييل جدااا", "جميل جدا"),
    (tx.collapse_repeated_chars, "hello", "helo"),
    (tx.collapse_repeated_chars, "a\n\nb  cc  x", "a\n\nb c x"),
    (tx.collapse_repeated_words, "جيد جيد، جيد", "جيد"),
    (tx.collapse_repeated_words, "نص نصوص نص نص", "نص نصوص نص"),
    (tx.collapse_repeated_words, "é é عربيّ عربيّ x²x² x² x²", "é عربيّ x²x² x²"),
    (tx.remove_long_words, "قصير abcdefghij abcdefghi", "قصير abcdefghi"),
    (lambda c: tx.map_emojis(c, {"😀": "سعيد"}), "a😀b🇪🇬", "aسعيد b🇪🇬"),
    (lambda c: tx.map_emojis(c, {"😀": "x", "👍": "y"}), "👍😀👍 z", "y x y  z"),
    (lambda c: tx.map_emojis(c, {}), "a😀", "a😀"),
    (tx.remove_emojis, "😀😀 ok 🇪🇬", " ok "),
    (tx.remove_latin, "التطبيق good رائع", "التطبيق  رائع"),
    (lambda c: tx.remove_stopwords(c, fixed.cleaning_stopwords(("لا",))), "لا برنامج جيد و", "لا جيد"),
    (tx.detect_language, "hello", "en"),
    (tx.detect_language, "مرحبا hello", "ar"),
    (tx.detect_language, "12345", "ar"),
    (tx.detect_language, "", "ar"),
    (tx.detect_language, "Ok🙂", "en"),
    (tx.detect_language, "[", "en"),
    (tx.stem, "مدرستها", "مدرست"),
    (tx.stem, "والكتاب  ا", "كتاب  ا"),
    (tx.segment, "مدرستها", "مدرست+ها"),
    (tx.segment, "بالمدارس و", "بال+مدارس و"),
    (lambda c: tx.fold_letters(c, (("é", "e"), ("à", "a"))), "été à", "ete a"),
]


def test_golden_rows(spark):
    for rule, given_text, want in GOLDEN:
        got = spark.createDataFrame([(given_text,)], "t string").select(rule(F.col("t"))).first()[0]
        assert got == want, (given_text, got, want)


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    for rule in (tx.normalize, tx.remove_url_email, tx.remove_punctuation, tx.collapse_repeated_chars,
                 tx.collapse_repeated_words, tx.remove_long_words, tx.map_emojis, tx.remove_emojis, tx.remove_latin,
                 tx.remove_stopwords, tx.stem, tx.segment):
        assert df.select(rule(F.col("t"))).first()[0] is None


# Restatements of the rules as plain loops over Python strings.
def _drop_links(t):
    out, i = [], 0
    while i < len(t):
        stop = i
        while stop < len(t) and not t[stop].isspace():
            stop += 1
        run = t[i:stop]
        link = run.find("http")
        if link >= 0 and len(run) == link + 4:
            link = -1  # nothing follows
        mail = next((k for k, ch in enumerate(run) if ch == "@" and 0 < k < len(run) - 1), -1)
        # An address takes the whole run, a link begins where it stands; the one that begins first counts.
        kept = "" if mail >= 0 and link != 0 else run[:link] if link >= 0 else run
        out.append(kept)
        if stop < len(t):
            out.append(t[stop])
        i = stop + 1
    return "".join(out)


def _single_chars(t):
    return "".join(ch for i, ch in enumerate(t) if i == 0 or ch == "\n" or ch != t[i - 1])


def _word(ch):
    return ch.isalnum() or ch == "_"


def _single_words(t):
    parts = ["".join(group) for _, group in itertools.groupby(t, key=_word)]
    out = []
    for part in parts:
        if _word(part[0]) and len(out) >= 2 and out[-2] == part:
            out.pop()
        else:
            out.append(part)
    return "".join(out)


PLAIN = {
    "strip": (tx.strip_space, lambda t: t.strip()),
    "url": (tx.remove_url_email, _drop_links),
    "chars": (tx.collapse_repeated_chars, _single_chars),
    "words": (tx.collapse_repeated_words, _single_words),
    "long": (tx.remove_long_words, lambda t: " ".join(w for w in t.split(" ") if len(w) < 10)),
    "tokens": (lambda c: F.array_join(tx.word_tokens(c, 2, False), "|"),
               lambda t: "|".join(w for w in ("".join(g) for k, g in itertools.groupby(t, key=_word) if k) if len(w) > 1)),
}
ALPHABET = "aab  @@.:/httpé ّ\n\t\x1c_1²جيدا😀"


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(ALPHABET, max_size=40), min_size=40, max_size=60))
def test_rules_match_plain_restatements(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", *[rule(F.col("t")).alias(k) for k, (rule, _) in PLAIN.items()]).collect()
    for row in rows:
        for name, (_, plain) in PLAIN.items():
            assert row[name] == plain(row["t"]), (name, row["t"])


def test_long_runs_are_linear(spark):
    texts = ["x " * 20000 + "x", "@" * 30000 + "a" * 30000, "a" * 60000, "-" * 60000, " " * 60000 + "a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(tx.collapse_repeated_words("t"), tx.remove_url_email("t"), tx.collapse_repeated_chars("t"),
                    tx.strip_space("t")).collect()
    assert got[0][0] == "x" and got[1][1] == "" and got[2][2] == "a" and got[4][3] == "a"


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    got = [r[0] for r in df.select(tx.word_ngrams(F.col("w"), 1, 3)).collect()]
    assert got == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]
    with pytest.raises(ValueError):
        tx.word_ngrams(F.col("w"), 2, 1)


def test_chain_order_and_flags(spark):
    df = spark.createDataFrame([("راسل a.b@x.com الان!!  جيد جيد",)], "t string")
    got = df.select(clean_column("t", flags_from(("remove_url_email", "remove_punct", "remove_repeated_words")))).first()[0]
    assert got == "راسل  الان  جيد"
    with pytest.raises(ValueError):
        clean_column("t", {"no_such_step": True})
    assert TOPIC_FLAGS["check_spelling"] and not CLASSIFIER_FLAGS["check_spelling"]
    off = df.select(clean_column("t", {}).alias("t"))
    assert "regexp" not in off._jdf.queryExecution().toString()


def test_stop_word_lists():
    assert "لا" not in fixed.cleaning_stopwords() and "لا" in fixed.base_stopwords()
    assert "لكن" in fixed.cleaning_stopwords() and "لكن" not in fixed.topic_stopwords()
    assert fixed.cleaning_stopwords() != fixed.topic_stopwords()


def test_stream(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "جيد!!"), (2, "مرحبا 12")], "doc_id long, t string").write.parquet(source)
    stream = spark.readStream.schema("doc_id long, t string").parquet(source)
    query = (
        clean_stream(stream, "t", flags_from(("remove_punct",))).writeStream.format("parquet")
        .option("path", target).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(target).collect()} == {(1, "جيد"), (2, "مرحبا ")}
    with pytest.raises(ValueError):
        clean_stream(stream, "t", {"check_spelling": True})
