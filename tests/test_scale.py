"""Steps that must not sort or copy whole tables: results against brute force, and where the plan groups."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamhis.functions import text as tx
from tamhis.operators import clusters, describe, terms


def below_the_last_exchange(df):
    """The part of the plan that runs before the rows are dealt out for the last grouping."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return plan[plan.index("Exchange"):]


@pytest.mark.parametrize("places", [1, 3, 1000])
def test_ngrams_are_counted_by_stretches(spark, places):
    texts = [("a", "xx yy zz xx yy"), (None, "xx yy"), ("a", None), ("b", ""), ("a", "xx yy zz"), (None, "xx yy zz xx yy zz xx"), ("b", "zz")]
    df = spark.createDataFrame([(k, t, [k]) for k, t in texts], "k string, t string, nested array<string>")
    want = Counter()
    for k, t in texts:
        w = (t or "").split()
        want.update((k, " ".join(w[i : i + n])) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    rows = df.select("k", F.split(F.coalesce("t", F.lit("")), " +").alias("w")).select("k", F.filter("w", lambda w: w != "").alias("__tokens"))
    partial = terms._partial_ngrams(rows.coalesce(1), ["k"], 1, 3, places).groupBy("k", "term").agg(F.sum("n").alias("n"))
    assert {(r[0], r[1]): r[2] for r in partial.collect()} == want
    whole = terms.count_terms(df, "t", "k", ngram_range=(1, 3))
    assert {(r[0], r[1]): r[2] for r in whole.collect()} == want
    by_array = terms.count_terms(df, "t", "nested", ngram_range=(1, 3))
    assert {(r[0][0], r[1]): r[2] for r in by_array.collect()} == want
    assert terms.count_terms(df, "t", "k", ("xx",), (2, 2)).where("term = 'yy zz'").agg(F.sum("n")).first()[0] == 4


def test_ngrams_are_dealt_out_before_they_are_grouped(spark):
    df = spark.createDataFrame([("a", "xx yy zz")], "k string, t string")
    assert "HashAggregate" not in below_the_last_exchange(terms.count_terms(df, "t", "k", ngram_range=(1, 3)))


@pytest.mark.parametrize("low,high,places,entries", [(1, 3, 5, 3), (1, 2, 1000, 1 << 20), (2, 2, 7, 1), (3, 4, 1000, 2), (2, 4, 3, 4)])
def test_ngrams_travel_as_pieces(spark, low, high, places, entries):
    rng = np.random.default_rng(low * 10 + high)
    letters = ["ab", "äß", "the", "x_1", "日本", "zz", "ab2"]
    rows = [(None if i % 5 == 0 else f"k{i % 3}", None if i % 7 == 3 else i % 2, " ".join(rng.choice(letters, rng.integers(0, 12)))) for i in range(60)]
    rows += [("k1", 1, None), ("k1", 1, ""), ("k2", 0, "ab " * 40)] + rows[:5]
    df = spark.createDataFrame(rows, "k string, m int, t string").repartition(3)
    want = Counter()
    for k, m, t in rows:
        w = [x for x in (t or "").split() if x != "the"]
        want.update((k, m, " ".join(w[i : i + n])) for n in range(low, high + 1) for i in range(len(w) - n + 1))
    tokens = df.select("k", "m", F.filter(F.split(F.coalesce("t", F.lit("")), " +"), lambda w: ~w.isin("", "the")).alias("__tokens"))
    schema = terms.T.StructType([*tokens.drop("__tokens").schema.fields, *spark.range(0).selectExpr("'' AS term", "id AS n").schema.fields])
    pieces = terms._ngram_pieces(tokens, ["k", "m"], low, high, 4, places)
    got = [tuple(r) for r in terms._grouped_pieces(pieces, schema, low, high, entries).collect()]
    assert len(got) == len(want) and {r[:3]: r[3] for r in got} == want
    whole = terms.count_terms(df, "t", ["k", "m"], ("the",), (low, high)).collect()
    assert {tuple(r)[:3]: r[3] for r in whole} == want and len(whole) == len(want)


def test_ngrams_move_less_than_their_texts(spark):
    rng = np.random.default_rng(8)
    texts = [(" ".join(f"word{i}" for i in rng.zipf(1.2, 400) % 20_000),) for _ in range(300)]
    df = spark.createDataFrame(texts, "t string").select(F.lit("a").alias("k"), tx.word_tokens("t").alias("__tokens"))
    sizes = terms._ngram_pieces(df.coalesce(1), ["k"], 1, 3, 4).selectExpr("sum(length(owners) + aggregate(parts, 0, (s, p) -> s + length(p)))")
    grams = terms._partial_ngrams(df.coalesce(1), ["k"], 1, 3).selectExpr("sum(length(term))")
    assert sizes.first()[0] < 0.25 * grams.first()[0]


def test_term_vectors_are_added_up_in_tasks(spark):
    rng = np.random.default_rng(5)
    words = [[f"w{i}" for i in rng.integers(0, 300, rng.integers(0, 60))] for _ in range(80)]
    vecs = [None if i % 9 == 4 else [float(v) for v in rng.normal(size=3)] for i in range(80)]
    df = spark.createDataFrame([(i, " ".join(w), v) for i, (w, v) in enumerate(zip(words, vecs))], "doc_id long, t string, vec array<double>")
    listed = spark.createDataFrame([(f"w{i}",) for i in range(250)], "term string")
    got = describe.term_vectors(df.repartition(5), "t", listed)
    want = {}
    for w, v in zip(words, vecs):
        for term in set(w) if v else ():
            want.setdefault(term, []).append(v)
    found = {r["term"]: r["vec"] for r in got.collect()}
    assert set(found) == {t for t in want if int(t[1:]) < 250}
    assert all(np.allclose(v, np.mean(want[t], axis=0)) for t, v in found.items())
    assert "ObjectHashAggregate" not in below_the_last_exchange(got) and "SortAggregate" not in below_the_last_exchange(got)


def test_term_sums_are_given_away_when_full(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(describe, "_HELD_VALUES", 8)
    batch = pa.record_batch({"terms": [["a", "b"], ["a", "c", "d"], ["a"], ["e", "f", "g", "h", "i"]], "vec": [[1.0, 0.0], [3.0, 0.0], [0.0, 6.0], [1.0, 1.0]]})
    total, n = {}, Counter()
    for part in describe._partial_means([batch, batch.slice(0, 0)]):
        assert part.num_rows <= 5
        for r in part.to_pylist():
            total[r["term"]] = total.get(r["term"], 0) + np.array(r["vec"]) * r["n"]
            n[r["term"]] += r["n"]
    assert n["a"] == 3 and list(total["a"]) == [4.0, 6.0] and n["i"] == 1 and list(total["d"]) == [3.0, 0.0] and len(n) == 9


def near_rows(x, limit):
    return np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9) <= limit


@pytest.mark.parametrize("shift, eps", [(0.0, 1.0), (1e4, 1.0), (0.0, 1e-7), (0.0, 50.0)])
def test_near_pairs_are_exact(shift, eps):
    rng = np.random.default_rng(31)
    x = np.concatenate([rng.normal(size=(300, 6)), [[i, j, 0, 0, 0, 0] for i in range(12) for j in range(12)], [[np.nan] * 6, [np.inf] * 6]]) + shift
    want = near_rows(x, eps + 1e-9) & np.isfinite(x).all(1)[:, None]
    got = np.zeros(want.shape, bool)
    for row, col in clusters._near_pairs(x, x, eps + 1e-9):
        got[row, col] = True
    assert (got == want).all() and got.sum() > 400


def test_blocks_of_one_cell_and_groups_apart(spark):
    """All points in one cell of many blocks: pairs of blocks meet once, and groups are linked across them."""
    rng = np.random.default_rng(32)
    x = np.concatenate([rng.normal(c, 0.3, (n, 2)) for c, n in ((0, 120), (6, 90), (12, 60))] + [rng.uniform(20, 60, (30, 2))])
    weights = rng.integers(1, 4, len(x))
    points = spark.createDataFrame([(i, [float(v) for v in p], int(w)) for i, (p, w) in enumerate(zip(x, weights))], "id long, vec array<double>, weight long")
    near = near_rows(x, 0.5)
    box = np.array([[-np.inf] * 2, [np.inf] * 2])
    starts = clusters._blocks(points, box, 25)
    assert list(starts) == [0, 12]
    counts = {r["id"]: r["n"] for r in clusters._counts(points, box, starts, 0.5).collect()}
    assert counts == dict(enumerate((near @ weights).tolist()))
    core = points.select("id", "vec")
    for block_rows in (4, 1000):
        found = {r["id"]: r["component"] for r in clusters._linked(core, box, starts, 0.5, block_rows).collect()}
        want, seen = {}, set()
        for i in range(len(x)):
            todo = [i] if i not in seen else []
            while todo:
                j = todo.pop()
                if j not in seen:
                    seen.add(j)
                    want[j] = i
                    todo += np.flatnonzero(near[j]).tolist()
        assert found == want


def test_points_near_all_cells_are_copied_less(spark):
    x = np.random.default_rng(33).normal(size=(2000, 16))
    points = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, vec array<double>")
    tree = clusters._tree(points, 100.0, 100)
    assert clusters._leaves(tree) == 5
    assert clusters._spread(points, tree, clusters._blocks(points, tree, 1000), 100.0).count() == 5 * 2000


def test_pipeline_encodes_and_decodes_in_turn(spark):
    """A task that decodes has one Python worker, not those of the encoder beside it."""
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some words"), (2, None), (3, "x" * 40_000)], "doc_id long, text string")
    found = corpus_pipeline.encode(spark, docs, "")
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert [r["doc_id"] for r in found.orderBy("doc_id").collect()] == [1, 2, 3]
