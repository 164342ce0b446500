"""Whitening, periodic runs and packing against brute force."""

import hashlib
import itertools
import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tamhis.llm import packing, periodic_runs, queries, whitening
from tests.llm import cases

SMALL = "/root/testdata/sf0.001"


def brute_runs(words):
    """Every stretch of at least 24 words and three of its smallest periods that keeps no period when extended."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        start = None
        for i in range(q, len(words) + 1):
            same = i < len(words) and words[i] == words[i - q]
            if same and start is None:
                start = i - q
            elif not same and start is not None:
                if i - start >= max(24, 3 * q):
                    found.setdefault((start, i - start), q)
                start = None
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def told(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2 ** 12 - 1), st.integers(1, 12), st.integers(0, 70)), max_size=5))
def test_runs_of_periodic_stretches(stretches):
    words = [bits >> (i % period) & 1 for bits, period, size in stretches for i in range(size)]
    assert periodic_runs.runs_of(words) == brute_runs(words)


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_mixed_words(seed):
    r = random.Random(seed)
    words = []
    while len(words) < 400:
        base = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.randrange(1, 30))]
        words += base * r.randrange(1, 9) + base[: r.randrange(len(base))]
        words += words[r.randrange(len(words)) :][: r.choice([0, 20, 60])]
    assert periodic_runs.runs_of(words) == brute_runs(words)


def test_long_run_is_fast():
    words = ["a"] * 60_000 + ["b", "c"] * 30_000 + [f"w{i % 7_000}" for i in range(40_000)] + ["buy", "now", "here"] * 9_000
    runs = periodic_runs.runs_of(words)
    assert runs == [(0, 60_000, 1), (60_000, 60_000, 2), (120_000, 40_000, 7_000), (160_000, 27_000, 3)]


@pytest.mark.parametrize("rows,extra", [(cases.ROWS, True), ([], True)])
def test_runs_of_edge_cases(spark, rows, extra):
    got = periodic_runs.find_runs(cases.documents(spark, rows, extra), ("doc_id", "n_chars")).collect()
    assert len(got) == len(rows)
    want = []
    for r in rows:
        words = [w.decode() for w in (r[1] or "").encode().split()]
        runs = brute_runs(words) if len(words) < 1_000 else [(0, 9_000, 30_287)][:0]
        want.append((r[0], r[4], len(words), runs, told(words, runs)[-1]))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["n_chars"], r["n_words"], [tuple(x) for x in r["runs"]], digest(r["collapsed"]))) for r in got)


def test_runs_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, SMALL).collect()}
    assert set(got) == set(texts)
    some = 0
    for doc_id, text in texts.items():
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words)
        some += bool(runs)
        assert got[doc_id] == told(words, runs), doc_id
    assert some > 5


def exact_whitening(vectors, components=4):
    x = np.array(sorted(set(map(tuple, vectors))), np.int64)
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:components]
    return n, sums, values[order], axes[:, order].T, values.sum()


def held(spark, df, rows, n_components=4):
    """Compare with a dense eigenvalue problem; the sign of each component is free."""
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, sums, values, axes, total = exact_whitening([x for _, x in kept])
    got = defaultdict(list)
    for r in df.collect():
        got[r["component"]].append((r["vec_id"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]))
    assert sorted(got) == list(range(1, n_components + 1))
    for k, lines in got.items():
        assert len(lines) == len(kept)
        want = sorted(((i, sum((n * int(v) - int(s)) ** 2 for v, s in zip(x, sums, strict=True)), float((np.array(x) - sums / n) @ axes[k - 1] / math.sqrt(values[k - 1])))
                       for i, x in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        lines.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
        assert [(r[0], r[1], r[2]) for r in lines] == [(i, n, d if d < 1 << 63 else None) for i, d, _ in want]
        a, b = np.array([r[3] for r in lines]), np.array([w for _, _, w in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
        assert all(abs(r[4] - values[k - 1] / total) < 1e-9 and r[5] < 1e-9 for r in lines)


def test_whitening_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    held(spark, queries.op11_embedding_whitening(spark, SMALL), rows)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return df.select("*", *[F.lit("clash").alias(c) for c in ("component", "n", "deviation", "whitened", "explained", "x", "i", "v")])


def test_whitening_of_hard_vectors(spark):
    """Scales apart by ten million, a constant and a doubled dimension, copies, nulls and non-finite entries, more dimensions than fit in the mean's digits."""
    random.seed(3)
    rows = []
    for i in range(400):
        a = random.gauss(0, 1e5)
        rows.append((i, [a + 1e7, random.gauss(0, 300), random.gauss(0, 9), random.gauss(0, 0.2), 5.0, a + 1e7]))
    rows += rows[:150] * 2 + [(None, rows[0][1]), (900, None), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [])]
    df = whitening.whiten(vectors(spark, rows))
    held(spark, df, [r for r in rows if r[0] != 904])


@pytest.mark.parametrize("rows,n_rows", [([], 0), ([(1, None)], 0), ([(1, [])], 0), ([(1, [2.0, 3.0]), (2, [2.0, 3.0])], 0), ([(1, [2.0, 3.0]), (2, [4.0, 9.0]), (3, [1.0])], 2)])
def test_whitening_of_few_vectors(spark, rows, n_rows):
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert len(got) == n_rows
    assert all(r["component"] == 1 and abs(abs(r["whitened"]) - 1) < 1e-9 for r in got)


def test_deviations_beyond_64_bits():
    m = whitening.Moments(2, (1 << 62, 0))
    assert m.deviations(np.array([[1 << 62, 0], [1 << 61, 5]])) == [None, 100]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.TOKENIZER)


def packed(df):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in df.collect():
        by_doc[r["key"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    return by_doc, by_sequence


@pytest.mark.parametrize("length", [16, 1024])
@pytest.mark.parametrize("rows", [cases.ROWS, []])
def test_packing(spark, tokenizer, rows, length):
    named = cases.documents(spark, rows, True).withColumn("key", F.monotonically_increasing_id())
    fixed = spark.createDataFrame(named.select("key", "text").collect(), "key long, text string").repartition(4)
    pieces = packing.pack(fixed, queries.TOKENIZER, ("key",), length=length).persist()
    by_doc, by_sequence = packed(pieces)
    texts = {r["key"]: r["text"] for r in fixed.collect()}
    assert set(by_doc) == set(texts)
    for key, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[key], key=lambda r: r["start"])
        assert [r["start"] for r in own] == list(itertools.accumulate([0, *[r["length"] for r in own[:-1]]]))
        assert np.frombuffer(b"".join(bytes(r["ids"]) for r in own), "<u4").tolist() == ids
        assert all(r["doc_tokens"] == len(ids) for r in own)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    whole = {r["sequence_id"]: r for r in packing.sequences(pieces, ("key",), length, 7).collect()}
    for number, own in by_sequence.items():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == list(itertools.accumulate([0, *[r["length"] for r in own[:-1]]]))
        full = sum(r["length"] for r in own)
        assert full == length or number == len(by_sequence) - 1
        ids = np.frombuffer(whole[number]["ids"], "<u4").tolist()
        assert ids == [*np.frombuffer(b"".join(bytes(r["ids"]) for r in own), "<u4").tolist(), *[7] * (length - full)]
        assert [tuple(b) for b in whole[number]["boundaries"]] == [(r["offset"], r["length"], r["start"], r["key"]) for r in own]


def test_packing_query(spark, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    total, room = 0, defaultdict(int)
    for r in queries.op13_packing(spark, SMALL).collect():
        ids = np.array([*tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0], "<u4")
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        total, room[r["sequence_id"]] = total + r["length"], room[r["sequence_id"]] + r["length"]
    assert total == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts.values())
    assert sum(1024 - n for n in room.values()) < 1024


def test_parts_are_encoded_alike(tokenizer):
    made = packing.load_tokenizer(queries.TOKENIZER, public_tokenizers.PATTERN)
    random.seed(5)
    for _ in range(60):
        text = "".join(random.choice(["a", "'s", " ", "  ", "\n", "9", "é", ".", "'", "ll ", "<|endoftext|>", "_", "漢"]) for _ in range(300))
        parts = packing.parts_of(text, 20)
        assert "".join(parts) == text and len(parts) > 3
        ids = [i for p in parts for i in made.encode(p, allowed_special="all")]
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids
