"""License scan, quality rules, shards and chats against their SQL on edge cases; language and toxicity on held-out rows."""

import random
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamhis.llm import chat, language_id, licenses, oracles, quality_rules, queries, sharding, toxicity
from tests.llm import cases

SF = "/root/testdata/sf0.01"
ORACLES = oracles.all_oracles()


@pytest.mark.parametrize("rows,extra", [(cases.ROWS, False), (cases.ROWS, True), ([], True)])
def test_license_scan(spark, rows, extra):
    docs = cases.documents(spark, rows, extra)
    cases.same(licenses.scan_licenses(docs).drop("spans"), cases.duck(documents=cases.documents(spark, rows)), ORACLES["op1_license_scan"])


def test_license_markup():
    def labels(text, *templates):
        machine = licenses.Automaton([licenses.Template(str(i), t) for i, t in enumerate(templates)])
        return sorted((n, a, b) for n, a, b in machine.matches(text.encode().split()))

    assert labels("a b a b c", "a b", "a <<beginOptional>>b<<endOptional>> c", "b <<var;words=0-2>> c") == [(0, 0, 2), (0, 2, 4), (1, 2, 5), (2, 1, 5), (2, 3, 5)]
    assert labels("a x y c", "a <<var;words=1-1>> c") == []
    nested = "a <<beginOptional>>b <<beginOptional>>c<<endOptional>> d<<endOptional>> e"
    assert [bool(labels(t, nested)) for t in ("a e", "a b d e", "a b c d e", "a c e", "a b e")] == [True, True, True, False, False]
    with pytest.raises(ValueError):
        licenses.Automaton([licenses.Template("x", "<<var;words=0-1>> b")])
    with pytest.raises(ValueError):
        licenses.Automaton([licenses.Template("x", "a <<beginOptional>> b")])
    words = "under the mit license " * 3 + "under the under the mit license"
    assert len(licenses.Automaton(licenses.BASE).matches(words.encode().split())) == 4


def test_license_automaton_against_patterns():
    template = "a <<beginOptional>>b<<endOptional>> <<var;words=0-2>> c"
    machine = licenses.Automaton([licenses.Template("x", template)])
    pattern = re.compile(r"a (?:b )?(?:\w )?(?:\w )?c ")
    for letters in itertools.product("abc", repeat=6):
        text = " ".join(letters) + " "
        want = {m.start() // 2 for i in range(6) for m in [pattern.match(text, 2 * i)] if m}
        assert {start for _, start, _ in machine.matches(text.encode().split())} == want


@pytest.mark.parametrize("rows,extra", [(cases.ROWS, False), (cases.ROWS, True), ([], True)])
def test_quality_rules(spark, rows, extra):
    got = quality_rules.quality_rules(cases.documents(spark, rows, extra)).drop("row_key")
    cases.same(got, cases.duck(documents=cases.documents(spark, rows)), ORACLES["op2_quality_rules"])
    if rows:
        by_id = {r["doc_id"]: r for r in got.collect()}
        assert by_id[100]["removed_words"] == 5 and by_id[100]["kept"]
        assert by_id[200]["removed_words"] == 0 and by_id[200]["kept"]  # copies of one document do not make a line frequent


def test_frequent_passages_by_brute_force(spark):
    """Passages of several lines in otherwise different documents: a document is a text, whatever lines it shares."""
    words = ["red", "green", "blue", "grey", "black", "white", "pink", "brown"]
    name = lambda i: " ".join(words[i >> 3 * k & 7] for k in range(4))
    passage = [f"Passage line {w} stands here" for w in words[:6]]
    texts = [("a", "\n".join([f"{name(8 * i + k)} in own line" for k in range(3)] + (passage if i % 10 == 0 else []))) for i in range(150)]
    texts += [("a", texts[0][1])] * 40 + [("b", "copied line\nof one text")] * 60 + [(None, f"{name(i)} here\nshared line") for i in range(12)]
    rows = [(i, t, "en", host, 1) for i, (host, t) in enumerate(texts)]
    got = {(r["host"], r["h"]): r["n_docs"] for r in quality_rules.frequent_lines(cases.documents(spark, rows), "source", "text").collect()}
    hashes = dict(map(tuple, spark.createDataFrame([(x,) for x in {x for _, t in texts for x in t.split("\n")}], "x string").select("x", quality_rules.line_hash(F.col("x"))).collect()))
    want = {}
    for host in {h for h, _ in texts}:
        own = {t for h, t in texts if h == host}
        holding = {hashes[x]: sum(x in t.split("\n") for t in own) for t in own for x in t.split("\n")}
        want |= {(host, h): n for h, n in holding.items() if n >= 10 and n > 0.05 * len(own)}
    assert got == want and {("a", hashes[x]) for x in passage} <= set(got) and (None, hashes["shared line"]) in got


def test_passages_of_several_lines_agree_with_sql(spark):
    """Texts that share a passage of six lines and have three lines of their own: every one of them loses the passage."""
    passage = "".join(f"shared passage line {'abcdef'[i]} of six in all\n" for i in range(6))
    own = lambda i: "".join(f"line {chr(97 + k)} of {chr(97 + i % 26)}{chr(97 + i // 26)} alone with words of its own here\n" for k in range(3))
    rows = [(i, own(i) + (passage if i < 15 else ""), "en", "a" if i % 2 else None, 1) for i in range(300)]
    rows = [(i, t, x, "a", n) for i, t, x, _, n in rows[:150]] + [(i, t, x, None, n) for i, t, x, _, n in rows[150:]]
    docs = cases.documents(spark, rows)
    got = quality_rules.quality_rules(docs).drop("row_key")
    cases.same(got, cases.duck(documents=docs), oracles.OP2)
    assert {r["doc_id"]: r["removed_words"] for r in got.collect()} == {i: 48 if i < 15 else 0 for i in range(300)}


def test_quality_filters_and_edits(spark):
    rows = [*cases.ROWS, *[(300 + i, cases.LINE * 3, "en", "hot", 1) for i in range(2)]]
    docs = cases.documents(spark, rows, True)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {300, 301, 1, 2} & {r[0] for r in kept.select("doc_id").collect()} == set()
    edited = {r["doc_id"]: r["text"] for r in quality_rules.remove_frequent_lines(docs).select("doc_id", "text").collect()}
    assert "footer" not in edited[100] and "Own words" in edited[100] and edited[5] == cases.LONG and edited[1] is None


def test_repeated_words_by_brute_force(spark):
    texts = ["".join(x) for x in itertools.product(["a b c d e ", "a b ", "c d e f "], repeat=4)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").select("doc_id", quality_rules.text_counts("text").alias("c"))
    for r in rows.collect():
        w = texts[r["doc_id"]].split()
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        want = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)}
        assert r["c"]["n_repeat_words"] == len(want)


@pytest.mark.parametrize("rows,extra", [(cases.ROWS, False), (cases.ROWS, True), ([], True)])
def test_shards(spark, rows, extra):
    rows = [r for r in rows if r[0] != 7]  # equal rows have no order of their own
    got = sharding.shard_by_bytes(cases.documents(spark, rows, extra))
    cases.same(got, cases.duck(documents=cases.documents(spark, rows)), ORACLES["op5_byte_shards"].replace("range(strlen(text))", "range(0, strlen(text)::BIGINT)"))


def test_shards_with_repeated_rows(spark):
    rows = sharding.shard_by_bytes(cases.documents(spark), shards=4).collect()
    assert len(rows) == len(cases.ROWS)
    for shard in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)


CHATS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "a\\b [INST] \\[INST] <s></s> <|x|> <<SYS>>"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, "assistant", "first"), (2, 1, "tool", "x|>y<|"),
    (3, None, None, "no role"), (3, 5, "user", " [/INST] "), (3, 5, "user", " [/INST] "), (None, 0, "system", "\n"), (None, 1, "user", "  "), (4, 0, "we|>ird\\", "é😀\r\n" * 2000),
]


def test_chats_on_edge_cases(spark):
    turns = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).repartition(4)
    made = chat.format_chats(turns).select("*", chat.read_turns("formatted").alias("back"), chat.learned_text("segments").alias("learned")).collect()
    assert {r["conv_id"] for r in made} == {1, 2, 3, 4, None}
    for r in made:
        own = sorted(((c[1] is not None, c[1] or 0), c[2] or "", c[3] or "") for c in CHATS if c[0] == r["conv_id"])
        assert [tuple(t) for t in r["back"]] == [(role, text) for _, role, text in own] and r["n_turns"] == len(own)
        assert r["learned"] == "".join(text for _, role, text in own if role == "assistant")
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    assert {r["conv_id"]: (r["valid"], r["first_bad"]) for r in made} == {1: (True, None), 2: (False, 0), 3: (False, 0), 4: (False, 0), None: (False, None)}
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_chat_query(spark):
    cases.same(queries.op6_chat_format(spark, SF), cases.duck(conversations=spark.read.parquet(f"{SF}/conversations.parquet")), ORACLES["op6_chat_format"])


def test_language_held_out(spark):
    rows = queries.op4_language_profiles(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)


def test_language_edge_cases(spark):
    docs = cases.documents(spark, extra=True)
    rows = language_id.predict_languages(docs).collect()
    assert len(rows) == len(cases.ROWS)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert all(found[i] == ("und", 0.0) for i in (1, 2, 3, 11)) and found[5][0] == "en"
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in cases.ROWS} - {1, 2, 3, 11}
    assert language_id.predict_languages(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.predict_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_counts_by_brute_force():
    text = "Été à la Plage, 2 fois!"
    grams, counts = language_id.Grams().counts(text)
    plain = " été à la plage fois "
    want = {}
    for n in (1, 2, 3):
        for i in range(len(plain) - n + 1):
            gram = plain[i : i + n]
            if gram != " ":
                code = 0
                for ch in gram:
                    code = code << 21 | ord(ch)
                want[code] = want.get(code, 0) + 1
    assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == want


def test_language_predictions_by_brute_force(spark):
    """Profiles, ranks, distances and scores of a whole table from plain dictionaries of strings."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]

    def ordered(texts):
        counts = {}
        for text in texts:
            plain = " " + "".join(ch if ch.isalpha() else " " for ch in (text or "").lower()) + " "
            plain = re.sub(" +", " ", plain)
            if not plain.strip():
                continue
            for n in (1, 2, 3):
                for i in range(len(plain) - n + 1):
                    gram = plain[i : i + n]
                    if gram != " ":
                        number = 0
                        for ch in gram:
                            number = number << 21 | ord(ch)
                        counts[number] = counts.get(number, 0) + 1
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:300]

    fit = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1 and t is not None and lang is not None]
    profiles = {lang: {g: k for k, g in enumerate(ordered([t for t, x in fit if x == lang]))} for lang in {x for _, x in fit}}
    profiles = {lang: ranks for lang, ranks in profiles.items() if ranks}
    want = {}
    for i, text, _ in rows:
        doc = ordered([text])
        if not doc:
            want[i] = ("und", 0.0)
            continue
        distance, lang = min((sum(abs(ranks[g] - k) if g in ranks else 300 for k, g in enumerate(doc)), lang) for lang, ranks in profiles.items())
        want[i] = (lang, round(1 - distance / (300 * len(doc)), 9))
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in queries.op4_language_profiles(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.op8_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    good = sorted(r["score"] for r in rows if r["toxic"] == 0)
    toxic = [r["score"] for r in rows if r["toxic"] == 1]
    above = sum(sum(g < t for g in good) for t in toxic)
    # Windows of running text tell less than single words would: 0.87 and 0.55 here; the README has both.
    assert above >= 0.8 * len(good) * len(toxic)
    assert sum(s >= 0.5 for s in toxic) >= 0.5 * len(toxic) and sum(s >= 0.5 for s in good) <= 0.03 * len(good)


def test_toxicity_sees_the_order_of_words():
    """Classes that differ only in the order of six ordinary words are told apart; a shuffled text gets another score."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(600)]
    phrase = words[:6]

    def text(toxic):
        own = [r.choice(words) for _ in range(120)]
        for _ in range(3):
            at = r.randrange(100)
            own[at : at + 6] = phrase if toxic else r.sample(phrase, 6)
        return toxicity.running(" ".join(own))

    docs = [(text(i % 2), i % 2, 1.0) for i in range(800)]
    model = toxicity.fit(docs)
    distance = toxicity.Distance(model.ordinary, model.toxic)
    score = lambda t: float((distance.profile(t) - model.centre) / model.scale @ model.weights[:-1])
    toxic, good = [score(text(1)) for _ in range(100)], [score(text(0)) for _ in range(100)]
    assert sum(g < t for g in good for t in toxic) > 0.9 * 100 * 100
    mixed = text(1).split()
    r.shuffle(mixed)
    assert score(b" " + b" ".join(mixed) + b" ") < min(sorted(toxic)[10:])


def test_windows_and_lengths_by_brute_force():
    ordinary, toxic = b" the usual words of a quiet text and more of them " * 40, b" some wording that is known here alone "
    distance = toxicity.Distance(ordinary, toxic)
    for value in (None, "", "!!", "word", "Some wording, that is known HERE alone; and a quiet text " * 5, "漢字" * 300):
        text = toxicity.running(value)
        parts = toxicity.windows(text)
        covered = set()
        for k, part in enumerate(parts):
            assert part == text[16 * k : 16 * k + 32]
            covered |= set(range(16 * k, 16 * k + len(part)))
        assert covered == set(range(len(text)))
        for part, saved in zip(parts, distance.gains(parts), strict=True):
            frame = ordinary[len(ordinary) // 2 :][:12] + part + ordinary[len(ordinary) // 3 :][:12]
            sizes = [len(toxicity.compressor(d).compress(frame)) for d in (ordinary, ordinary + toxic)]
            assert saved == sizes[0] - sizes[1]
    assert max(distance.gains(toxicity.windows(toxicity.running("some wording that is known here alone")))) >= 8


def test_windows_are_compressed_together(monkeypatch):
    rng = random.Random(4)
    texts = [toxicity.running(" ".join(rng.choice("red green blue yellow black".split()) for _ in range(n))) for n in (0, 1, 50, 400)]
    distance = toxicity.Distance(texts[2] * 3, texts[3])
    parts = [w for text in texts for w in toxicity.windows(text)]
    framed = [distance._head + part + distance._tail for part in parts]
    plain = [len(distance._ordinary.compress(x)) - len(distance._toxic.compress(x)) for x in framed]
    monkeypatch.setattr(toxicity, "_MANY", 1)
    monkeypatch.setattr(toxicity, "_AT_ONCE", 7)
    assert distance.gains(parts) == plain and any(plain)
    assert (distance.profiles(texts) == np.array([distance.profile(text) for text in texts])).all()


def test_toxicity_edge_cases(spark):
    docs = cases.documents(spark, extra=True)
    labels = spark.createDataFrame([(i, 1, i and i % 2) for i in (5, 6, 9, 12, None, 100, 101, 102)] + [(103, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == len(cases.ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    for some in (labels.limit(0), labels.where("toxic = 0")):
        assert {(r["score"], r["predicted"]) for r in toxicity.score_toxicity(docs, some).collect()} == {(0.0, 0)}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
