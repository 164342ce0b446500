"""Vectors, neighbours, clusters, topics, descriptions and classifiers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamhis import session
from tamhis.functions.vectors import as_vector
from tamhis.operators import bayes, clusters, components, describe, neighbors, reports, topics, vectors
from tamhis.plans.classification import ReviewClassifier
from tamhis.plans.topics import TopicExperiment, TopicModel, fit_topics, settings
from tamhis.sources.runs import RunRecorder


def frame(spark, points):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "doc_id long, vec array<double>")


def brute(points, k, metric):
    x = np.asarray(points, float)
    if metric == "cosine":
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - u @ u.T
    else:
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    d = np.round(d, 9)
    np.fill_diagonal(d, np.inf)
    return {i: sorted(range(len(x)), key=lambda j: (d[i, j], j))[:k] for i in range(len(x))}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_exact_neighbors(spark, metric):
    points = np.random.default_rng(1).normal(size=(150, 6))
    points[10:14] = points[9]
    got = neighbors.nearest_neighbors(frame(spark, points), 4, metric=metric, method="exact", block_rows=40).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["id"], r["rank"])):
        found.setdefault(r["id"], []).append(r["neighbor"])
    assert found == brute(points, 4, metric)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_lsh_recall_with_a_hot_group(spark, metric):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 3
    points = np.concatenate([centres[i % 40] + rng.normal(size=16) * 0.2 for i in range(1200)]).reshape(-1, 16)
    points[:400] = points[0]  # a third of all rows are copies
    got = neighbors.nearest_neighbors(frame(spark, points), 5, metric=metric, method="lsh", window_rows=200).collect()
    want = brute(points, 5, metric)
    hits = sum(r["neighbor"] in want[r["id"]] for r in got if r["id"] >= 400)
    assert hits / (5 * 800) > 0.9
    copies = [r for r in got if r["id"] < 400]
    assert len(copies) == 2000 and max(r["distance"] for r in copies) < 1e-6


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (5, 5)]
    nodes = spark.createDataFrame([(i,) for i in [*range(61), 100, 101, 102, 200]], "id long")
    got = components.connected_components(nodes, spark.createDataFrame(edges, "src long, dst long"))
    assert {r["id"]: r["component"] for r in got.collect()} == {
        **{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, 200: 200
    }


def test_density(spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(0, 0.1, (60, 2)), rng.normal(10, 0.1, (60, 2)),
                             [[50, 50], [-50, 50], [50, -50], [-50, -50], [100, 0]]])
    rows = clusters.density_clusters(frame(spark, points), "vec", min_size=50, min_points=5, eps=1.0).collect()
    label = {r["doc_id"]: r["cluster"] for r in rows}
    assert len(label) == 125
    assert len({label[i] for i in range(60)}) == 1 and len({label[i] for i in range(60, 120)}) == 1
    assert {label[0], label[60]} == {0, 1} and all(label[i] == -1 for i in range(120, 125))


def plain_dbscan(points, min_points, eps, min_size):
    x = np.asarray(points, float)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps + 1e-9
    core = near.sum(1) >= min_points
    label, groups = {}, []
    for i in np.flatnonzero(core):
        if i not in label:
            todo, group = [i], set()
            while todo:
                j = todo.pop()
                if j not in group:
                    group.add(j)
                    todo += list(np.flatnonzero(near[j] & core))
            groups.append(group)
            label.update({j: group for j in group})
    return {frozenset(int(i) for i in g) for g in groups if len(g) >= min_size}


def grouped(rows):
    found = {}
    for r in rows:
        found.setdefault(r["cluster"], set()).add(r["doc_id"])
    return {frozenset(v) for k, v in found.items() if k != -1}


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_density_against_the_plain_way(spark, block_rows):
    rng = np.random.default_rng(13)
    stacks = np.repeat([[0.0, 0.0], [0.5, 0.0]], 30, axis=0)  # copies fill any list of nearest rows
    chain = np.column_stack([np.arange(40) * 0.9 + 20, np.zeros(40)])
    cloud = rng.uniform(0, 8, (120, 2)) + [0, 30]
    copies = np.repeat([[100.0, 0.0]], 80, axis=0)
    points = np.concatenate([stacks, chain, cloud, copies, [[500, 500]]])
    for min_points, min_size in ((5, 50), (3, 10), (1, 1)):
        got = clusters.density_clusters(frame(spark, points), "vec", min_size=min_size, min_points=min_points, eps=1.0, block_rows=block_rows).collect()
        assert len(got) == len(points) and grouped(got) == plain_dbscan(points, min_points, 1.0, min_size)


def test_neighbours_do_not_depend_on_partitions(spark):
    x = np.random.default_rng(14).uniform(-1, 1, (2000, 8))
    df = frame(spark, x)
    rows = [sorted(map(tuple, neighbors.nearest_neighbors(d, 10, method="lsh", window_rows=256).collect())) for d in (df, df, df.repartition(13))]
    assert rows[0] == rows[1] == rows[2]
    exact = {(r["id"], r["neighbor"]) for r in neighbors.nearest_neighbors(df, 10, method="exact").collect()}
    assert len(exact & {r[:2] for r in rows[0]}) >= 0.9 * len(exact)
    with pytest.raises(ValueError):
        neighbors.nearest_neighbors(df, 3, method="auto")


def test_cells_compare_few_pairs(spark):
    points = np.random.default_rng(21).uniform(0, 100, (6000, 4))
    df = frame(spark, points).select(F.col("doc_id").alias("id"), "vec", F.lit(1).cast("bigint").alias("weight"))
    cells = clusters._cells(df, 2.0, 128)
    held = cells.groupBy("cell").agg(F.sum(F.col("own").cast("int")).alias("own"), F.count("*").alias("held")).collect()
    assert sum(r["own"] for r in held) == 6000 and len(held) == 47
    assert sum(r["own"] * r["held"] for r in held) < 6000 * 6000 / 10
    # Every pair within reach meets in the cell of either end.
    where = {}
    for r in cells.select("cell", "own", "id").collect():
        where.setdefault(r["id"], [None, set()])[1].add(r["cell"])
        if r["own"]:
            where[r["id"]][0] = r["cell"]
    for i in range(0, 6000, 10):
        near = np.flatnonzero(np.sqrt(((points - points[i]) ** 2).sum(1)) <= 2.0)
        assert all(where[i][0] in where[int(j)][1] for j in near)


def test_cells_of_points_on_cuts(spark):
    grid = np.array([[x, y] for x in range(30) for y in range(30)], float)  # every cut goes through points
    for eps, min_points in ((1.0, 3), (1.5, 9), (0.5, 1)):
        got = clusters.density_clusters(frame(spark, grid), "vec", min_size=1, min_points=min_points, eps=eps, block_rows=50).collect()
        assert grouped(got) == plain_dbscan(grid, min_points, eps, 1)
    assert clusters.density_clusters(frame(spark, grid).where("doc_id < 0"), "vec", eps=1.0).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_descent_mends_narrow_windows(spark, metric):
    x = np.random.default_rng(22).normal(size=(3000, 24))
    x[:1000] = x[0]  # a third of all rows are copies
    df = frame(spark, x)
    exact = {(r["id"], r["neighbor"]) for r in neighbors.nearest_neighbors(df, 5, metric=metric, method="exact").where("id >= 1000").collect()}
    hits = {}
    for method in ("lsh", "descent"):
        rows = neighbors.nearest_neighbors(df, 5, metric=metric, method=method, window_rows=64, tables=4).collect()
        hits[method] = len(exact & {(r["id"], r["neighbor"]) for r in rows}) / len(exact)
        assert {r["id"] for r in rows} == set(range(3000)) and all(r["id"] != r["neighbor"] for r in rows)
        assert max(r["distance"] for r in rows if r["id"] < 1000) < 1e-6
    assert hits["lsh"] < 0.6 and hits["descent"] >= 0.9


def test_descent_does_not_depend_on_partitions(spark):
    df = frame(spark, np.random.default_rng(23).normal(size=(800, 8)))
    rows = [sorted(map(tuple, neighbors.nearest_neighbors(d, 5, method="descent", window_rows=32, width=16, group_rows=g).collect()))
            for d, g in ((df, 100), (df.repartition(13), 1024))]
    assert rows[0] == rows[1]
    one = neighbors.nearest_neighbors(df.where("doc_id = 3"), 5, method="descent").collect()
    assert one == [] and neighbors.nearest_neighbors(df.where("doc_id < 0"), 5, method="descent").collect() == []


def test_descent_in_batches_is_the_same(spark, monkeypatch):
    df = frame(spark, np.random.default_rng(24).normal(size=(500, 6)))
    run = lambda: sorted(map(tuple, neighbors.nearest_neighbors(df, 4, method="descent", window_rows=32, width=12, tables=2, group_rows=170, max_rounds=1).collect()))
    whole, kept = run(), []
    monkeypatch.setattr(neighbors, "PAIRS_AT_ONCE", 1)
    monkeypatch.setattr(neighbors, "MOVED_ROWS", 1)
    monkeypatch.setattr(neighbors, "pin", lambda d: kept.append(d.columns) or session.pin(d))
    assert run() == whole
    # Two tables after each other, and three batches of pairs a round.
    assert kept.count(["left_id", "right_id", "distance", "rank"]) == 2 and kept.count(["left_id", "right_id", "distance"]) == 3


def plain_ward(points, k):
    groups = [[i] for i in range(len(points))]
    x = np.asarray(points, float)
    while len(groups) > k:
        best = None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                na, nb = len(groups[a]), len(groups[b])
                cost = na * nb / (na + nb) * ((x[groups[a]].mean(0) - x[groups[b]].mean(0)) ** 2).sum()
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, a, b)
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def test_ward(spark):
    points = np.random.default_rng(4).normal(size=(12, 3))
    rows = clusters.ward_clusters(frame(spark, points), 3, "vec", micro=12).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["cluster"], set()).add(r["doc_id"])
    assert {frozenset(g) for g in groups.values()} == plain_ward(points, 3)
    many = np.concatenate([np.random.default_rng(5).normal(c, 0.1, (40, 2)) for c in (0, 5, 10)])
    rows = clusters.ward_clusters(frame(spark, many), 3, "vec", micro=20).collect()
    label = {r["doc_id"]: r["cluster"] for r in rows}
    assert len(label) == 120 and [len({label[i] for i in range(s, s + 40)}) for s in (0, 40, 80)] == [1, 1, 1]


def test_spectral(spark):
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.normal(c, 0.05, (30, 3)) for c in ((1, 0, 0), (0, 1, 0))])
    rows = clusters.spectral_clusters(frame(spark, points), 2, "vec", neighbors=8).collect()
    label = {r["doc_id"]: r["cluster"] for r in rows}
    assert len(label) == 60 and {len({label[i] for i in range(s, s + 30)}) for s in (0, 30)} == {1} and label[0] != label[30]


def test_pca_centres_and_keeps_variance(spark):
    x = np.random.default_rng(7).normal(5, 1, (80, 4)) * [5, 2, 1, 0.1]
    df = frame(spark, x).select("doc_id", as_vector("vec").alias("vec"))
    got = vectors.fit_reduction(df, 2).transform(df).select("reduced").collect()
    points = np.array([r[0].toArray() for r in got])
    axes = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2]
    assert np.allclose(np.abs(points), np.abs((x - x.mean(0)) @ axes.T), atol=1e-6)


def test_word_positions(spark):
    df = spark.createDataFrame([(1, "aa bb cc"), (2, "zz"), (3, "zz bb")], "doc_id long, t string")
    table = spark.createDataFrame([("aa", [1.0, 2.0]), ("bb", [3.0, 4.0])], "word string, vec array<double>")
    flat = vectors.word_position_vectors(df, "t", table, 2, 3)
    assert {r[0]: r[1] for r in flat.collect()} == {
        1: [1.0, 2.0, 3.0, 4.0, 0.0, 0.0], 2: [0.0] * 6, 3: [0.0, 0.0, 3.0, 4.0, 0.0, 0.0]
    }
    assert vectors.first_token_vectors(flat, 2).where("doc_id = 1").first()["vec"] == [1.0, 2.0]


def _length_model():
    """Stands for a user's model loader: two numbers per text."""

    def predict(texts):
        return np.array([[len(t), 1.0] for t in texts], dtype="float32")

    return predict


def test_external_vectors(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "a")], "doc_id long, t string")
    got = {r["doc_id"]: r["vec"] for r in vectors.external_vectors(df, "t", _length_model).collect()}
    assert got == {1: [3.0, 1.0], 2: [1.0, 1.0]}


def test_nearest_centroid_both_ways(spark, monkeypatch):
    points = np.random.default_rng(8).normal(size=(200, 5))
    df = frame(spark, points)
    centres = spark.createDataFrame([(i, [float(v) for v in points[i]]) for i in range(30)], "topic int, centroid array<double>")
    one = {r["doc_id"]: (r["topic"], round(r["distance"], 6)) for r in topics.nearest_centroid(df, centres).collect()}
    monkeypatch.setattr(topics, "CENTRE_VALUES", 20)
    two = {r["doc_id"]: (r["topic"], round(r["distance"], 6)) for r in topics.nearest_centroid(df, centres).collect()}
    d = np.sqrt(((points[:, None] - points[None, :30]) ** 2).sum(-1))
    assert one == two and {k: v[0] for k, v in one.items()} == {i: int(d[i].argmin()) for i in range(200)}


def test_topic_tables(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([0] * 5 + [1] * 3 + [2] * 1 + [-1])], "doc_id long, topic int")
    assert {r["topic"] for r in topics.apply_min_size(df, 3).collect()} == {0, 1, -1}
    sizes = topics.topic_sizes(df)
    assert topics.size_order(sizes) == {-1: -1, 0: 0, 1: 1, 2: 2}
    similar = spark.createDataFrame([(0, 2, 0.9), (0, 1, 0.2), (1, 2, 0.1)], "t1 int, t2 int, cosine double")
    names = topics.reduce_topics(similar, sizes, 2)
    assert names[0] == names[2] != names[1] and names[-1] == -1
    shares = topics.topic_probabilities(
        frame(spark, [[0, 0], [1, 1]]), spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 3.0])], "topic int, centroid array<double>")
    ).collect()
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 and r["probabilities"][0] > 0.5 for r in shares)


def plain_merges(similarity, sizes, n):
    """The most similar pair merges first, with means weighted by size; of equal pairs the one of the smaller ids."""
    s, weight, groups = similarity.copy(), list(map(float, sizes)), [[i] for i in range(len(sizes))]
    alive = list(range(len(sizes)))
    while len(alive) > n:
        _, i, j = max((s[i, j], -i, -j) for i in alive for j in alive if i < j)
        i, j = -i, -j
        s[i] = s[:, i] = (weight[i] * s[i] + weight[j] * s[j]) / (weight[i] + weight[j])
        weight[i] += weight[j]
        groups[i] += groups[j]
        alive.remove(j)
    return {t: min(g) for k, g in enumerate(groups) if k in alive for t in g}


@pytest.mark.parametrize("zeros", [0.0, 0.7])
def test_topics_merge_as_by_the_best_pair(spark, monkeypatch, zeros):
    rng = np.random.default_rng(21)
    m = rng.random((10, 10)) * (rng.random((10, 10)) >= zeros)
    m = np.triu(m, 1) + np.triu(m, 1).T
    sizes = rng.integers(1, 40, 10)
    pairs = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(10) for j in range(i + 1, 10) if m[i, j] > 0], "t1 int, t2 int, cosine double")
    table = spark.createDataFrame([*[(i, int(n)) for i, n in enumerate(sizes)], (-1, 9)], "topic int, n long")
    tree = topics.merge_tree(pairs, table)
    monkeypatch.setattr(topics, "merge_tree", lambda *_: tree)
    for n in (1, 4, 9, 10, 30):
        assert topics.reduce_topics(pairs, table, n) == {-1: -1, **plain_merges(m, sizes, n)}


def test_thousands_of_topics_merge(spark):
    """A chain of pairs: each pair is far more similar than its neighbours."""
    rows = [(2 * i, 2 * i + 1, 0.9) for i in range(3_000)] + [(2 * i + 1, 2 * i + 2, 0.1) for i in range(2_999)]
    sizes = spark.range(6_000).select(F.col("id").cast("int").alias("topic"), F.lit(1).cast("bigint").alias("n"))
    names = topics.reduce_topics(spark.createDataFrame(rows, "t1 int, t2 int, cosine double"), sizes, 3_000)
    assert names == {-1: -1, **{t: t // 2 * 2 for t in range(6_000)}}


def test_distance_to_a_centre_is_not_rounded(spark, monkeypatch):
    """0.9943794995 would become 0.994380 if it were rounded to nine places and then to six."""
    far = 0.99437949978
    df, centres = frame(spark, [[far, 0.0]]), spark.createDataFrame([(3, [0.0, 0.0]), (4, [9.0, 9.0])], "topic int, centroid array<double>")
    for values in (1 << 22, 1):
        monkeypatch.setattr(topics, "CENTRE_VALUES", values)
        row = topics.nearest_centroid(df, centres).first()
        assert row["topic"] == 3 and row["distance"] == far and round(row["distance"], 6) == 0.994379


def test_naive_bayes_from_two_batches(spark):
    rows = [(i, f"w{i % 7} w{i % 3} x{i}", i % 3 if i % 11 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, t string, y int")
    whole = bayes.fit_text_naive_bayes(df, "t", "y")
    parts = [bayes.fit_text_naive_bayes(df.where(x), "t", "y") for x in ("doc_id < 20", "doc_id >= 20")]
    both = parts[0].merged(parts[1])
    assert sorted(map(tuple, both.totals.collect())) == sorted(map(tuple, whole.totals.collect()))
    told = lambda m: sorted((r["doc_id"], r["prediction"], tuple(np.round(r["probability"], 12))) for r in m.transform(df).collect())
    assert told(both) == told(whole)
    with pytest.raises(ValueError):
        parts[0].merged(bayes.fit_text_naive_bayes(df, "t", "y", stop_words=("w1",)))


def test_topic_products_beyond_one_block(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(int(t), f"w{w}", float(rng.random())) for t in range(12) for w in rng.choice(30, 10, replace=False)]
    weights = spark.createDataFrame(rows, "topic int, term string, weight double")
    want = {}
    for t1, w1, a in rows:
        for t2, w2, b in rows:
            if w1 == w2 and t1 <= t2:
                want[(t1, t2)] = want.get((t1, t2), 0.0) + a * b
    for block in (1024, 5):
        # The bound is read when the plan is built and travels with the function.
        monkeypatch.setattr(reports, "GRAM_BLOCK", block)
        got = {(r["t1"], r["t2"]): r["product"] for r in reports.topic_products(weights).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_topic_map(spark):
    weights = spark.createDataFrame([(0, "a", 1.0), (1, "a", 1.0), (1, "b", 1.0), (2, "c", 3.0)], "topic int, term string, weight double")
    sizes = spark.createDataFrame([(0, 5), (1, 4), (2, 3)], "topic int, n long")
    rows = {r["topic"]: r for r in reports.topic_map(weights, sizes).collect()}
    x = np.array([[1, 0, 0], [1, 1, 0], [0, 0, 3.0]])
    gaps = lambda p: np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    assert np.allclose(gaps(np.array([[rows[i]["x"], rows[i]["y"]] for i in range(3)])), gaps(x))
    assert rows[2]["size"] == 3 and rows[2]["words"] == "c"


def test_mmr_prefers_unlike_terms():
    similar = np.array([0.9, 0.89, 0.5])
    mutual = np.array([[1, 0.99, 0.0], [0.99, 1, 0.0], [0.0, 0.0, 1]])
    assert describe.mmr_pick(similar, mutual, 2, 0.5) == [0, 2]
    assert describe.mmr_pick(similar, mutual, 2, 0.0) == [0, 1]


def test_describers(spark):
    words = spark.createDataFrame([(0, "aa", 1.0, 1), (0, "bb", 0.9, 2), (1, "cc", 1.0, 1)], "topic int, term string, weight double, rank int")
    vecs = spark.createDataFrame([("aa", [0.0, 1.0]), ("bb", [1.0, 0.0]), ("cc", [0.0, 1.0])], "term string, vec array<double>")
    centres = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "topic int, centroid array<double>")
    names = spark.createDataFrame([("right", [1.0, 0.0]), ("left", [-1.0, 0.0])], "name string, vec array<double>")
    got = describe.describe_topics(words, vecs, centres, ["KeyBERT"], 1).collect()
    assert {(r["topic"], r["term"]) for r in got} == {(0, "bb"), (1, "cc")}
    got = describe.describe_topics(words, vecs, centres, ["keybert", "zeroshot"], 2, names=names, threshold=0.9).collect()
    assert {(r["topic"], r["term"]) for r in got} == {(0, "right"), (1, "cc")}
    with pytest.raises(ValueError):
        describe.describe_topics(words, vecs, centres, ["other"])


def reviews(spark, n=60):
    # Two vocabularies stand for two subjects; the words come from two fixed lists.
    good, bad = "ممتاز جميل رائع سهل مفيد شكرا".split(), "مشكله بطيء خطا فشل سيء دفع".split()
    rows = []
    for i in range(n):
        bag = good if i % 2 else bad
        rows.append((i, " ".join(bag[(i // 2 + j) % 6] for j in range(4)) + f" رقم{chr(1576 + i % 20)}", "Positive" if i % 2 else "Issue"))
    return spark.createDataFrame(rows, ["doc_id", "Review Text", "Label"])


@pytest.mark.parametrize("kind", ["kmeans", "agglomerative", "spectral", "hdbscan", "lr", "nb"])
def test_fit_topics(spark, kind, tmp_path):
    df = reviews(spark).withColumn("y", F.when(F.col("Label") == "Positive", 1).otherwise(0))
    config = {"clustering_model_name": kind, "n_topics": 2, "vector_dims": 64, "n_components": 2, "min_topic_size": 10,
              "min_points": 5, "eps": 5.0, "representation_model_list": ["keybert", "mmr"], "ngram_range": (1, 1)}
    if kind == "agglomerative":
        config["representation_model_list"] = []
    annotated, model = fit_topics(df, config, "Review Text", "y" if kind in ("lr", "nb") else None, stop_words=())
    rows = annotated.collect()
    assert len(rows) == 60 and {"topic", "probabilities"} <= set(annotated.columns)
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-6 for r in rows)
    if kind in ("kmeans", "agglomerative", "lr", "nb"):
        assert all(len({r["topic"] for r in rows if r["doc_id"] % 2 == p}) == 1 for p in (0, 1))
    assert model.words.count() > 0
    again = {r["doc_id"]: r["topic"] for r in model.transform(df).collect()}
    if kind in ("kmeans", "lr", "nb"):
        assert again == {r["doc_id"]: r["topic"] for r in rows}
    path = model.save(str(tmp_path))
    with pytest.raises(Exception, match="exists|EXISTS"):
        model.save(str(tmp_path))
    loaded = TopicModel.load(spark, path)
    assert {r["doc_id"]: r["topic"] for r in loaded.transform(df).collect()} == again


def test_unknown_techniques_are_refused():
    for bad in ({"clustering_model_name": "x"}, {"dim_model_name": "x"}, {"embd_technique": "x"}):
        with pytest.raises(ValueError):
            settings(bad)
    with pytest.warns(UserWarning):
        assert settings({"dim_model_name": "umap"})["dim_model_name"] == "pca"


def test_topic_experiment(spark, tmp_path):
    args = {
        "data_args": {"check_spelling": False, "save_annotation": str(tmp_path / "annotated"),
                      "results_dir": str(tmp_path / "results"), "checkpoints_dir": str(tmp_path / "models"),
                      "save_data_file": str(tmp_path / "cleaned"), "visual_dir": str(tmp_path / "visual")},
        "model_config": {"task": "cls", "clustering_model_name": "lr", "vector_dims": 64, "n_components": 3, "ngram_range": (1, 1)},
    }
    run = TopicExperiment(args)
    recorder = RunRecorder(spark, str(tmp_path / "runs"), "r1")
    df = reviews(spark)
    annotated = run.fit(df, recorder)
    assert annotated.count() == 60
    got = {r["metric"]: r["value"] for r in recorder.read("run_metrics").collect()}
    assert got["accuracy"] == 1.0
    steps = recorder.read("run_params").where("param = 'preprocessing_steps'").first()["value"]
    assert "normalize" in steps and "check_spelling" not in steps
    assert {r["name"] for r in recorder.read("run_inputs").collect()} == {"raw", "annotated"}
    assert run.validation(df).columns == ["doc_id", "review", "label", "topic"]
    assert run.transform(df.drop("Label")).columns == ["doc_id", "review", "topic"]
    for split, columns in (("train", {"Label", "topic"}), ("val", {"review", "label", "topic"}), ("test", {"review", "topic"})):
        assert columns <= set(spark.read.parquet(str(tmp_path / "annotated" / f"split={split}")).columns)
    assert spark.read.parquet(str(tmp_path / "results" / "topic_report")).count() > 0
    assert spark.read.parquet(str(tmp_path / "cleaned")).count() == 60
    for name in ("topic_map", "document_map", "topic_similarity", "term_decline", "topic_words", "topic_distribution", "topics_per_class", "coherence"):
        assert spark.read.parquet(str(tmp_path / "visual" / name)).count() > 0, name


def test_word_embedding_topics(spark):
    config = {"embd_technique": "word", "vector_dims": 8, "n_topics": 2, "n_components": 2, "max_length": 5,
              "representation_model_list": [], "ngram_range": (1, 1)}
    annotated, model = fit_topics(reviews(spark), config, "Review Text", stop_words=())
    assert annotated.count() == 60 and model.transform(reviews(spark)).count() == 60


@pytest.mark.parametrize("head", ["mlp", "lr", "nb"])
def test_review_classifier(spark, head, tmp_path):
    run = ReviewClassifier({"model_config": {"head": head, "vector_dims": 64}})
    run.train(reviews(spark))
    table = str(tmp_path / "performance")
    got = {r["metric"]: r["value"] for r in run.evaluate(reviews(spark), table).collect()}
    assert got["accuracy"] > 0.95
    assert spark.read.parquet(table).count() == 4
    extra = spark.createDataFrame([(900, "ممتاز جميل", None), (901, None, None)], "doc_id long, `Review Text` string, Label string")
    rows = {r["doc_id"]: r for r in run.predict(extra).collect()}
    assert len(rows) == 2 and abs(sum(rows[901]["probabilities"]) - 1) < 1e-6
    bare = spark.createDataFrame([(950, "ممتاز جميل", "No such class")], "doc_id long, `Review Text` string, Label string")
    tables = run.evaluation_tables(reviews(spark).select("doc_id", "Review Text", "Label").union(bare))
    assert {r["metric"]: r["value"] for r in tables["metrics"].collect()}["unjudged_rows"] == 1.0
    assert tables["confusion"].where("y_true <> y_pred").agg(F.sum("n")).first()[0] <= 3
    assert tables["class_report"].count() == 2 and tables["roc_points"].count() > 0 and tables["roc_auc"].first()["value"] > 0.95
    again = ReviewClassifier.load(spark, run.save(str(tmp_path / "saved")))
    predicted = lambda r: sorted((x["doc_id"], x["predicted"]) for x in r.predict(extra).collect())
    assert predicted(again) == predicted(run)
    again.retrain(reviews(spark, 20).withColumn("doc_id", F.col("doc_id") + 1000))
    assert again.predict(extra).count() == 2


def test_texts_are_cleaned_alike_alone_and_in_the_corpus(spark, tmp_path):
    words = "خدمه سريعه ممتازه تطبيق جميل"
    rows = [(i, words, "Positive" if i % 2 else "Issue") for i in range(8)]
    rows = [(i, f"{t} {chr(1576 + i)}", y) for i, t, y in rows] + [(90, "خدمه سريعهه ممتازه", "Positive")]
    df = spark.createDataFrame(rows, ["doc_id", "Review Text", "Label"])
    run = ReviewClassifier({"data_args": {"check_spelling": True, "normalize": True}, "model_config": {"head": "nb"}})
    run.train(df)
    inside = run._seen.where("doc_id = 90").first()["Review Text"]
    alone = run._labelled(df.where("doc_id = 90")).first()["Review Text"]
    assert inside == alone and alone.split()[1] == "سريعه"
    assert ReviewClassifier.load(spark, run.save(str(tmp_path / "m")))._labelled(df.where("doc_id = 90")).first()["Review Text"] == alone


def test_naive_bayes_against_plain_sums(spark):
    rows = [(0, "aa bb aa", 0), (1, "bb cc", 1), (2, "cc cc dd", 1), (3, None, 1), (4, "aa", None)]
    df = spark.createDataFrame(rows, "doc_id long, t string, y int")
    model = bayes.fit_text_naive_bayes(df, "t", "y", stop_words=("dd",))
    counts, docs, words, size = {0: {"aa": 2, "bb": 1}, 1: {"bb": 1, "cc": 3}}, {0: 1, 1: 3}, {0: 3, 1: 4}, 3
    tests = {10: "aa cc cc zz", 11: "", 12: "bb dd", 13: None}
    got = {r["doc_id"]: r for r in model.transform(spark.createDataFrame(list(tests.items()), "doc_id long, t string")).collect()}
    for i, text in tests.items():
        known = [w for w in (text or "").split() if w in ("aa", "bb", "cc")]
        scores = [np.log((docs[y] + 1) / 6) + sum(np.log((counts[y].get(w, 0) + 1) / (words[y] + size)) for w in known) for y in (0, 1)]
        assert got[i]["prediction"] == int(np.argmax(scores))
        assert np.allclose(got[i]["probability"], np.exp(scores) / np.exp(scores).sum())


def test_topic_distribution_by_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd"], n)) for n in (0, 1, 2, 3, 4, 5, 9, 40)]
    weights = [("x", "aa", 1.0), ("x", "bb", 2.0), ("y", "bb", 1.0), ("y", "cc", 0.5)]
    unit = {t: sum(w * w for a, _, w in weights if a == t) ** 0.5 for t in "xy"}
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, t string")
    wanted = {}
    for doc, text in enumerate(texts):
        words = text.split()
        parts = [words[i : i + 4] for i in range(max(len(words) - 3, 1)) if words]
        lengths = [sum(p.count(q) ** 2 for q in set(p)) ** 0.5 for p in parts]
        sums = {t: sum(w * p.count(word) / unit[t] / n for p, n in zip(parts, lengths, strict=True) for a, word, w in weights if a == t) for t in "xy"}
        wanted |= {(doc, t): round(s / sum(sums.values()), 9) for t, s in sums.items() if s}
    found = reports.topic_distribution(df, "t", spark.createDataFrame(weights, "topic string, term string, weight double"))
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()  # windows as arrays, not as nested expressions
    assert {(r["doc_id"], r["topic"]): round(r["share"], 9) for r in found.collect()} == wanted
