"""Token files, near-duplicates, test items, BPE and the pipeline against brute force."""

import hashlib
import itertools
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from tamhis.llm import bpe, decontamination, near_dedup, oracles, queries, token_counts
from tamhis.llm.common import WordHasher, map_rows, words_of
from tests.llm import cases

SMALL = "/root/testdata/sf0.001"
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def encoding():
    return bpe.load_encoding(queries.RANKS, PATTERN)


def digests(encoding, text):
    ids = np.array(encoding.encode_ordinary(text or ""), "<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


HARD = ["a" * 700 + " b", "  \n \t " * 200 + "x", "it's we'll 'ss" * 100, "x" * 40 + " " * 900 + "y" * 40, "é😀ß" * 300, "1 22 333 " * 200, " " * 1000, "don''t\n\n  a" * 90, "''" * 500, "z"]


@pytest.mark.parametrize("chunk,overlap", [(50, 20), (64, 64), (500, 30)])
def test_stitched_encoding(spark, encoding, chunk, overlap):
    random.seed(chunk)
    mixed = ["".join(random.choice(["a", "'s", " ", "  ", "\n", "9", "é", ".", "'", "ll "]) for _ in range(400)) for _ in range(40)]
    texts = HARD + mixed + HARD[:3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    encoded = bpe.encode(docs, queries.RANKS, PATTERN, chunk=chunk, overlap=overlap)
    rows = {r["doc_id"]: r for r in bpe.decode(encoded, queries.RANKS, ["doc_id", "ids", "n_tokens"]).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert np.frombuffer(rows[i]["ids"], "<u4").tolist() == encoding.encode_ordinary(text), (i, text[:40])
        assert bytes(rows[i]["decoded"]) == text.encode()


@pytest.mark.parametrize("rows,extra", [(cases.ROWS, True), ([], True)])
def test_encoding_of_edge_cases(spark, encoding, rows, extra):
    encoded = bpe.encode(cases.documents(spark, rows, extra), queries.RANKS, PATTERN)
    got = bpe.decode(encoded, queries.RANKS, ["doc_id", "n_tokens", F.sha2("ids", 256).alias("i")]).select("doc_id", "n_tokens", "i", F.sha2("decoded", 256)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((r[0], *digests(encoding, r[1]))) for r in rows)


def test_bpe_query(spark, encoding):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op10_bpe_round_trip(spark, SMALL).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {i: digests(encoding, t) for i, t in texts.items()}


def test_token_query(spark, encoding):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op3_token_counts(spark, SMALL).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == sorted((i, len(encoding.encode_ordinary(t))) for i, t in texts.items())
    assert all(r["terminated"] for r in got)


@pytest.mark.parametrize("span", [1, 3, 1 << 10])
def test_separator_scan(spark, monkeypatch, span):
    monkeypatch.setattr(token_counts, "SPAN", span)
    random.seed(7)
    files, rows = {}, []
    for f in range(5):
        tokens = np.array([random.choice([0, 1, 2, 9] if f < 3 else [1, 2]) for _ in range([0, 1, 57, 200, 40][f])], "<u2")
        files[f] = tokens.tolist()
        rows += [(f, k, tokens[8 * k : 8 * k + 8].tobytes(), "x") for k in range(-(-len(tokens) // 8))]
    rows.append((9, 0, None, "x"))
    blocks = spark.createDataFrame(rows, "file long, block long, data binary, n string").repartition(3)
    want = []
    for f, tokens in files.items():
        start, ordinal = 0, 0
        for i, t in enumerate(tokens):
            if t == 9:
                want.append((f, ordinal, start, i - start, True))
                start, ordinal = i + 1, ordinal + 1
        if start < len(tokens):
            want.append((f, ordinal, start, len(tokens) - start, False))
    assert sorted(map(tuple, token_counts.count_tokens(blocks, 9).collect())) == sorted(want)
    assert token_counts.count_tokens(blocks.limit(0), 9).count() == 0


def test_token_files_of_edge_cases(spark, encoding, tmp_path):
    docs = cases.documents(spark, extra=True)
    files = token_counts.flat_token_files(docs, queries.RANKS, PATTERN, 50256, block=100)
    files.write.parquet(str(tmp_path / "blocks"))
    files = spark.read.parquet(str(tmp_path / "blocks"))
    got = token_counts.count_tokens(files.where("block IS NOT NULL"), 50256)
    assert sorted(r["n_tokens"] for r in got.collect()) == sorted(len(encoding.encode_ordinary(r[1] or "")) for r in cases.ROWS)
    flat = tmp_path / "flat"
    flat.mkdir()
    tokens = np.array([5, 50256, 50256, 6, 7], "<u2")
    (flat / "one.bin").write_bytes(tokens.tobytes())
    blocks = token_counts.read_token_files(spark, str(flat), block_bytes=4)
    assert sorted((r["ordinal"], r["start"], r["n_tokens"], r["terminated"]) for r in token_counts.count_tokens(blocks, 50256).collect()) == [(0, 0, 1, True), (1, 2, 0, True), (2, 3, 2, False)]


def shingle_list(text, k=5):
    words = words_of(text)
    k = min(k, len(words))
    found, seen = [], defaultdict(int)
    for i in range(len(words) - k + 1 if words else 0):
        s = tuple(words[i : i + k])
        found.append((s, seen[s]))
        seen[s] += 1
    return found


def similarity(a, b):
    """Longest common subsequence by the full table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1] / (len(a) + len(b) - row[-1])


def classes(rows, threshold=0.8):
    texts = list({t for _, t in rows if words_of(t)})
    lists, parent = [shingle_list(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [set(x) for x in lists]
    for i, j in itertools.combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if common >= threshold * (len(lists[i]) + len(lists[j]) - common) and similarity(lists[i], lists[j]) >= threshold:
            parent[find(i)] = find(j)
    members = defaultdict(list)
    for doc, text in rows:
        if words_of(text):
            members[find(texts.index(text))].append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in members.items()}
    return sorted(((d, least[find(texts.index(t))], len(members[find(texts.index(t))])) if words_of(t) else (d, d, 1) for d, t in rows), key=repr)


def test_alignment_against_the_full_table():
    random.seed(3)
    hasher = WordHasher()
    for _ in range(150):
        words = [random.choice("abcdefgh") * random.randint(1, 2) for _ in range(random.randint(1, 60))]
        other = words[:]
        for _ in range(random.randint(0, 3)):
            at = random.randrange(len(other))
            other[at : at + random.randint(0, 1)] = [random.choice("abxy")] if random.random() < 0.7 or len(other) < 2 else []
        a, b = " ".join(words), " ".join(other)
        want = similarity(shingle_list(a), shingle_list(b))
        for t in (0.5, 0.8):
            got = near_dedup.aligned_similarity(near_dedup.labelled(hasher.shingles(a, 5)), near_dedup.labelled(hasher.shingles(b, 5)), t)
            assert got == pytest.approx(want) if want >= t else got == 0.0


def test_near_duplicates_by_brute_force(spark):
    random.seed(5)
    make = lambda n: [f"w{random.randrange(3000)}" for _ in range(n)]
    rows, passage = [], make(60)
    for i in range(12):
        base = make(100)
        rows += [(1000 * i + k, " ".join(base)) for k in range(3)]
        for k in range(8):
            near = base[:]
            for _ in range(k):
                near[random.randrange(100)] = "changed"
            rows.append((1000 * i + 100 + k, " ".join(near)))
    chain = make(200)
    for k in range(6):  # each link holds, the ends differ
        rows.append((50_000 + k, " ".join(chain[3 * k :] + [f"z{x}" for x in range(3 * k)])))
    rows += [(60_000 + k, " ".join(make(15) + passage + make(15))) for k in range(40)]
    rows += [(70_000 + k, "the same short one") for k in range(30)] + [(80_000, None), (80_001, ""), (80_002, ". ,"), (None, "no id at all for this row of words"), (80_003, "one"), (80_003, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, near_dedup.near_duplicate_classes(docs).drop("key").collect()), key=repr)
    assert got == classes(rows)
    left = near_dedup.keep_one_of_each(docs).collect()
    assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == sorted([d for d, c, _ in classes(rows) if d is not None and d == c])


def test_one_of_each_class_stays(spark):
    """Near-copies that have no id, or share the least one: one text of the class stays, the least (id, digest)."""
    near = lambda name: [" ".join([f"{name}{i}" for i in range(60)] + end) for end in ([], ["tail"], ["other", "tail"])]
    groups = [[(None, t) for t in near("a")], [(4, near("b")[0]), (4, near("b")[1]), (9, near("b")[2])], [(None, near("c")[0]), (7, near("c")[1])], [(None, ""), (None, "...")]]
    rows = [r for g in groups for r in g] + [groups[0][0], groups[1][0]]
    left = near_dedup.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    digest = lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).digest())
    want = [min(g, key=digest) for g in groups[:3]] + groups[3]
    assert sorted(map(repr, map(tuple, left))) == sorted(repr(r) for r in rows if r in want)


@pytest.mark.parametrize("block", [4, 512])
def test_family_links_are_whole(spark, block):
    random.seed(11)
    hasher, base, rows = WordHasher(), [f"w{i}" for i in range(80)], []
    for node in range(60):
        words = base[:]
        for _ in range(random.randint(0, 4)):
            words[random.randrange(80)] = f"x{random.randrange(9)}"
        every = near_dedup.labelled(hasher.shingles(" ".join(words), 5))
        rows.append((node % 2, node, node % 7, len(every), len(every), every.view(np.int64).tolist()))
    frame = spark.createDataFrame(rows, "family long, node long, label long, n long, c long, all array<long>")
    got = {(min(r[0], r[1]), max(r[0], r[1])) for r in near_dedup._family_links(frame, 0.8, block).collect()}
    alike = [(a[2], b[2]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and a[2] != b[2] and similarity(a[5], b[5]) >= 0.8]
    want = {(min(x), max(x)) for x in alike}
    assert got == want and want


def test_short_texts_lose_no_link(spark):
    """Texts of eight words and the same with one more: similarity 0.8 exactly."""
    r = random.Random(9)
    texts = [" ".join(f"s{r.randrange(10**6)}" for _ in range(8)) for _ in range(1_500)]
    rows = [(2 * i, t) for i, t in enumerate(texts)] + [(2 * i + 1, t + " end") for i, t in enumerate(texts)]
    got = near_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["class_id"] == r["doc_id"] // 2 * 2 and r["class_size"] == 2 for r in got) and len(got) == 3_000


def test_near_duplicate_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op7_order_minhash(spark, SMALL).collect()), key=repr) == classes(rows)


def test_near_duplicates_of_edge_cases(spark):
    docs = cases.documents(spark, extra=True)
    got = near_dedup.near_duplicate_classes(docs).drop("key").collect()
    assert sorted(map(tuple, got), key=repr) == classes([(r[0], r[1]) for r in cases.ROWS])
    assert near_dedup.keep_one_of_each(docs).columns == docs.columns
    assert near_dedup.near_duplicate_classes(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [25, 7])
def test_items_in_documents(spark, monkeypatch, bits):
    monkeypatch.setattr(decontamination, "FILTER_BITS", bits)
    docs = cases.documents(spark, extra=True)
    item = [(1, "one two three four five six seven eight nine"), (1, "one two three four five six seven eight nine"), (2, " ".join(cases.LONG.split()[4_000:4_200])), (3, "too short"), (8, "Zoë"), (9, "Footer LINE"), (10, "!"), (11, "one two three four"), (4, None), (None, ""),
            (5, "same line here same line here released under the mit license"), (6, "word1 word2 of nothing at all in here"), (2, "Copy line one is here copy")]
    items = spark.createDataFrame(item, "item_id long, text string").withColumn("item", F.lit("x"))
    con = cases.duck(documents=cases.documents(spark), benchmark=items.select("item_id", "text"))
    cases.same(decontamination.leaked_pairs(docs, items), con, oracles.OP9)
    leaking = {r[0] for r in con.execute(f"SELECT DISTINCT doc_id FROM ({oracles.OP9})").fetchall()}
    leaking.discard(12)  # one of two texts under this id
    left = decontamination.drop_leaking(docs, items)
    rest = sorted(repr(r[0]) for r in left.select("doc_id").collect() if r[0] != 12)
    assert left.columns == docs.columns and rest == sorted(repr(r[0]) for r in cases.ROWS if r[0] not in leaking | {12})
    assert decontamination.leaked_pairs(docs.limit(0), items).count() == 0 and decontamination.leaked_pairs(docs, items.limit(0)).count() == 0


def test_items_at_the_threshold(spark):
    words = [f"q{i}" for i in range(104)]  # a hundred shingles
    for lost, found in ((20, True), (21, False)):
        doc = "start " + " ".join(words[: 104 - lost]) + " end"
        docs = spark.createDataFrame([(1, doc)], "doc_id long, text string")
        items = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
        assert decontamination.leaked_pairs(docs, items).count() == int(found)


def test_many_items_take_one_pass(spark):
    """Thousands of items, many with one beginning, against documents that hold some of them: every pair, and no other."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(3_000)]
    item = [(i, " ".join((["the", "same", "five", "words", "here"] if i % 2 else []) + r.sample(words, r.randint(3, 40)))) for i in range(3_000)]
    docs = [(k, " ".join(r.sample(words, 50) + item[7 * k][1].split() + r.sample(words, 50) + item[11 * k][1].split())) for k in range(200)]
    got = decontamination.leaked_pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(item, "item_id long, text string"))
    pairs = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert {(k, j * k) for k in range(200) for j in (7, 11)} <= pairs
    for k, i in pairs:
        own, wanted = docs[k][1].split(), item[i][1].split()
        size = min(5, len(wanted))
        grams = lambda w: {tuple(w[j : j + size]) for j in range(len(w) - size + 1)}
        assert len(grams(own) & grams(wanted)) >= 0.8 * len(grams(wanted)) - 1e-9


def test_pipeline_by_brute_force(spark, encoding):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    con = cases.duck(documents=docs, benchmark=spark.read.parquet(f"{SMALL}/benchmark.parquet"))
    assert all(any(ch.isalpha() for ch in r["text"]) for r in docs.collect())  # so none is refused by the first stage
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({oracles.OP2}) WHERE kept").fetchall()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good]
    first = {d for d, c, _ in classes(rows) if d == c}
    leaks = {r[0] for r in con.execute(f"SELECT doc_id FROM ({oracles.OP9})").fetchall()}
    texts = dict(rows)
    want = {d: digests(encoding, texts[d]) for d in first - leaks}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want) < len(texts)


def test_stages_keep_columns_and_empty_tables(spark):
    docs = cases.documents(spark, extra=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
        docs = docs.limit(0)
        assert stage(spark, docs, SMALL).count() == 0
        docs = cases.documents(spark, extra=True)
    name, last = corpus_pipeline.STAGES[-1]
    assert last(spark, docs.limit(0), SMALL).count() == 0 and last(spark, docs, SMALL).count() == len(cases.ROWS)


def test_python_gets_texts_in_bounded_batches(spark):
    """24 MB of texts in one task reach Python in batches of a few MB; a limit that the session names stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    fresh = spark.newSession()
    texts = fresh.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("x"), 8192).alias("text"))
    lengths = lambda: map_rows(texts, ["id"], ["text"], [T.StructField("n", T.LongType())], lambda: lambda text: (len(text),))
    assert lengths().agg(F.sum("n")).first()[0] == 3000 * 8192

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([batch.nbytes], pa.int64())})

    assert max(r["bytes"] for r in texts.mapInArrow(sizes, "bytes long").collect()) < 8 << 20
    fresh.conf.set(key, "1m")
    lengths()
    assert fresh.conf.get(key) == "1m"
