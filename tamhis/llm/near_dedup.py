"""Near-duplicates by order MinHash, verified by banded alignment of occurrence-labelled shingles."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.llm.common import WordHasher, _mixed, map_rows, stored
from tamhis.operators.components import connected_components
from tamhis.session import small

SHINGLE = 5
THRESHOLD = 0.8
#: Sketches of a text, and the least shingles of each. At similarity 0.8 two long texts share a sketch with probability
#: 0.8 ** 4, so all 24 differ with probability 0.000003. Short ones can differ more often, so texts of fewer than SHORT shingles need no sketch in common.
SKETCHES, LEAST, SHORT = 24, 4, 40
_CELLS = 1 << 20
#: Nodes of a family that are compared with as many others at once, and how many shingles they may have.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Each shingle with the number of equal ones before it, so that all are distinct."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    starts = np.flatnonzero(first)
    nth = np.empty(len(hashes), np.uint64)
    nth[order] = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.append(starts, len(hashes))))
    with np.errstate(over="ignore"):
        return np.where(nth == 0, hashes, _mixed(hashes + nth * np.uint64(0xD6E8FEB86659FD93)))


def order_sketches(shingles: np.ndarray, sketches: int = SKETCHES, least: int = LEAST) -> np.ndarray:
    """Order MinHash: for each sketch the ``least`` shingles smallest under its hash, kept in the order of the text."""
    n = len(shingles)
    seeds = _mixed(np.arange(1, sketches + 1, dtype=np.uint64))
    out = np.empty(sketches, np.uint64)
    step = max(1, _CELLS // max(n, 1))
    with np.errstate(over="ignore"):
        for at in range(0, sketches, step):
            own = seeds[at : at + step]
            if n <= least:
                places = np.broadcast_to(np.arange(n), (len(own), n))
            else:
                values = (shingles[None, :] ^ own[:, None]) * np.uint64(0xFF51AFD7ED558CCD)
                values ^= values >> np.uint64(32)
                values *= np.uint64(0xC4CEB9FE1A85EC53)
                places = np.sort(np.argpartition(values, least - 1, axis=1)[:, :least], axis=1)
            total = own.copy()
            for column in range(places.shape[1]):
                total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + shingles[places[:, column]])
            out[at : at + step] = total
    return out


def aligned_similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Shingles in a common order over all shingles: ``m / (len(a) + len(b) - m)``; 0 if it must be below ``threshold``.

    ``a`` and ``b`` hold distinct labelled shingles, so the longest common subsequence is the longest increasing run
    of their places. Places further apart than the band cannot lie on an alignment that reaches the threshold: it
    leaves at most ``(len(a) + len(b)) (1 - t) / (1 + t)`` shingles unaligned.
    """
    total = len(a) + len(b)
    band = int(total * (1 - threshold) / (1 + threshold) + 1e-9)
    needed = threshold * total / (1 + threshold) - 1e-9
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(at_a - at_b) <= band
    at_a, at_b = at_a[near], at_b[near]
    if not len(at_a) or len(at_a) < needed:
        return 0.0
    line = at_a[np.argsort(at_b)]
    if np.all(line[1:] > line[:-1]):
        m = len(line)
    else:
        ends: list[int] = []
        for x in line.tolist():
            at = bisect_left(ends, x)
            ends[at : at + 1] = [x]
        m = len(ends)
    return m / (total - m) if m >= needed else 0.0


def _sketched(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    def make():
        hasher = WordHasher()

        def work(value):
            shingles = hasher.shingles(value, k)
            return len(shingles), order_sketches(labelled(shingles)).view(np.int64).tolist() if len(shingles) else []

        return work

    fields = [T.StructField("n", T.LongType()), T.StructField("sketches", T.ArrayType(T.LongType()))]
    return map_rows(docs, [F.col(doc_id).alias("doc_id"), F.unhex(F.md5(F.col(text))).alias("key")], [text], fields, make)


def _texts(nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """``(node, text)`` of the nodes, each text once."""
    wanted = nodes.select("key", "node")
    found = docs.select(F.unhex(F.md5(F.col(text))).alias("key"), F.col(text).alias("text")).join(small(nodes.select("key")), "key", "left_semi")
    return found.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key").select("node", "text")


def _shingled(texts: DataFrame, k: int) -> DataFrame:
    """``(node, all)``: the labelled shingles of each node in the order of its text."""
    def make():
        hasher = WordHasher()
        return lambda value: (labelled(hasher.shingles(value, k)).view(np.int64).tolist(),)

    return map_rows(texts, ["node"], ["text"], [T.StructField("all", T.ArrayType(T.LongType()))], make)


def _prefixes(texts: DataFrame, nodes: DataFrame, k: int, threshold: float) -> DataFrame:
    """``(s, node, n, c)``: the rarest shingles ``s`` of each node, as many as it may lack in a partner, and one.

    Two sets with a similarity of at least ``t`` share a shingle among the ``n - ceil(t n) + 1`` first of each, whatever the
    order, as long as all sets have the same. Rare ones come first: texts made around one passage or from one
    template then have prefixes of their own words, and do not meet. ``c`` counts the shingles of a node that another node
    has as well, which bounds what two nodes can share; a node with fewer than ``t n`` of them has no partner.
    """
    each = _shingled(texts, k).select("node", F.explode("all").alias("s"))
    common = each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = Window.partitionBy("node")
    shared = each.join(common, "s").withColumn("c", F.count(F.lit(1)).over(own)).withColumn("rank", F.row_number().over(own.orderBy("df", "s")))
    sized = shared.join(nodes.select("node", "n"), "node")
    return sized.where(F.col("rank") <= F.col("c") - F.ceil(threshold * F.col("n") - 1e-9) + 1).select("s", "node", "n", "c")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """``(src, dst, similarity)`` of the pairs ``(a, b)`` that are at least ``threshold`` similar."""
    side = lambda name: texts.select(F.col("node").alias(name), F.col("text").alias(f"{name}_text"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def make():
        hasher = WordHasher()

        def work(a, b):
            return (aligned_similarity(labelled(hasher.shingles(a, k)), labelled(hasher.shingles(b, k)), threshold),)

        return work

    scored = map_rows(both, [F.col("a").alias("src"), F.col("b").alias("dst")], ["a_text", "b_text"], [T.StructField("similarity", T.DoubleType())], make)
    return stored(scored.where(F.col("similarity") >= threshold), "links")


def _families(met: DataFrame, best: DataFrame) -> DataFrame:
    """``(node, family)``: what hangs together by common leaders.

    Every node goes with its central leader, so only leaders are left to join: those that one node has met, and a leader
    with its own central leader.
    """
    leaders = met.select(F.col("leader").alias("id")).distinct()
    side = met.join(best.select("node", "centre"), "node").where("leader <> centre").select(F.col("centre").alias("src"), F.col("leader").alias("dst")).distinct()
    own = best.join(leaders, F.col("node") == F.col("id")).select(F.col("node").alias("src"), F.col("centre").alias("dst"))
    tops = connected_components(leaders, side.union(own)).select("id", F.col("component").alias("family"))
    return best.join(tops, F.col("centre") == F.col("id")).select("node", "family").union(tops).distinct()


def _family_links(families: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``(src, dst)``: labels in one ``family`` that a linked pair of nodes joins; a pair of labels once for each task.

    ``families`` has ``family, node, label, n, c, all``. A family is dealt into blocks of about ``block`` nodes and ``BLOCK_SHINGLES`` shingles, and each pair of blocks is
    one group of two bounded sides. Overlaps are counted array by array and only joined labels leave the task, so the
    pairs of a family of near misses, which can be many, are never rows.
    """
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = families.groupBy("family").agg(blocks.alias("blocks"))
    dealt = families.join(sizes, "family").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    columns = ["family", "i", "j", "node", "label", "n", "c", "all"]
    last = F.col("blocks") - 1
    left = dealt.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence("own", last))).select(*[F.col(x).alias(x) for x in columns])
    right = dealt.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), "own"))).select(*[F.col(x).alias(x) for x in columns])

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        found: set[tuple[int, int]] = set()
        if one.num_rows and two.num_rows:
            same = one["i"][0].as_py() == one["j"][0].as_py()
            node, label, n, c = (two[x].to_numpy() for x in ("node", "label", "n", "c"))
            sets = [np.array(x, np.int64) for x in two["all"].to_pylist()]
            for a, a_label, a_n, a_c, a_all in zip(*[one[x].to_pylist() for x in ("node", "label", "n", "c", "all")], strict=True):
                able = (label != a_label) & (np.minimum(c, a_c) >= threshold / (1 + threshold) * (n + a_n) - 1e-9) & (np.minimum(n, a_n) >= threshold * np.maximum(n, a_n) - 1e-9)
                able = np.flatnonzero(able & (node > a) if same else able)
                if not len(able):
                    continue
                own = np.array(a_all, np.int64)
                ordered = np.sort(own)
                flat = np.concatenate([sets[k] for k in able])
                at = np.minimum(np.searchsorted(ordered, flat), len(ordered) - 1)
                starts = np.concatenate([[0], np.cumsum(n[able])[:-1]])
                common = np.add.reduceat((ordered[at] == flat).astype(np.int64), starts)
                for k in able[common >= threshold / (1 + threshold) * (n[able] + a_n) - 1e-9]:
                    joined = (a_label, int(label[k]))
                    if joined not in found and aligned_similarity(own, sets[k], threshold) >= threshold:
                        found.add(joined)
        return pa.table({"src": pa.array([x for x, _ in found], pa.int64()), "dst": pa.array([y for _, y in found], pa.int64())})

    return left.groupBy("family", "i", "j").cogroup(right.groupBy("family", "i", "j")).applyInArrow(compare, "src long, dst long")


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, class_size`` for every row: classes of texts linked by similarity of at least ``threshold``.

    Similarity is the share of runs of ``k`` words that two texts have in one order (see ``aligned_similarity``); words are
    compared in lower case without punctuation. ``class_id`` is the least id of the class. Equal texts are one node
    whatever their number, so copies are never paired. Nodes that share a sketch with another, and those of few shingles, are candidates; candidates that
    share one of their rarest shingles as well (``_prefixes``, which loses no pair) are one group, and groups with a node in common
    one family. First each node is compared with two leaders, nodes with few shingles of their own: the one that it
    meets most often, and the most central one. Then, where a family still holds several components, all pairs of
    different components are compared in blocks. A comparison is left out only inside a component, where it changes nothing.

    Texts that are null or without a word are classes of their own: ``class_id`` is their id, the size 1. A text of fewer than ``k``
    words is one shingle. Null ids are passed over for the least id; a class of null ids only has a null ``class_id``. Repeated rows each get
    a row. An empty table gives no rows; other columns are not read.
    """
    return _judged(docs, doc_id, text, k, threshold).drop("survivor")


def _judged(docs: DataFrame, doc_id: str, text: str, k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, key, class_id, class_size, survivor``; the last is the key of the text that stays: least (id, key), null ids last."""
    docs = docs.select(doc_id, text)
    rows = stored(_sketched(docs, doc_id, text, k), "sketched")
    # The number is given before the table is written and read from there ever after.
    nodes = rows.where("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sketches").alias("sketches"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    buckets = nodes.select("node", F.explode("sketches").alias("sketch"))
    shared = buckets.groupBy("sketch").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("sketch")
    likely = buckets.join(shared, "sketch").select("node").union(nodes.where(F.col("n") < SHORT).select("node"))
    candidates = stored(likely.distinct().join(nodes.select("node", "key", "n"), "node"), "candidates")
    texts = stored(_texts(candidates, docs, text), "texts")
    prefixes = stored(_prefixes(texts, candidates, k, threshold), "prefixes")
    central = F.struct((F.col("c") / F.col("n")).alias("central"), (-F.col("node")).alias("place"))
    groups = prefixes.groupBy("s").agg(F.max(central).alias("top"), F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = groups.select("s", F.col("top.central").alias("central"), (-F.col("top.place")).alias("leader"))
    met = prefixes.join(groups, "s").where("node <> leader").groupBy("node", "leader").agg(
        F.count(F.lit(1)).alias("times"), F.first("central").alias("central"), F.first("n").alias("n"), F.first("c").alias("c"))
    met = stored(met, "met")
    often, centre = F.max(F.struct("times", "central", "leader")), F.max(F.struct("central", "times", "leader"))
    best = stored(met.groupBy("node").agg(often["leader"].alias("often"), centre["leader"].alias("centre")), "best")
    pairs = best.select(F.explode(F.array_distinct(F.array("often", "centre"))).alias("a"), F.col("node").alias("b"))
    edges = _verified(pairs, texts, k, threshold)

    def labels(links: DataFrame) -> DataFrame:
        ends = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return connected_components(ends, links).select(F.col("id").alias("node"), F.col("component").alias("label"))

    first = labels(edges.select("src", "dst"))
    family = _families(met, best)
    sized = prefixes.select("node", "n", "c").distinct()
    current = stored(family.join(first, "node", "left").withColumn("label", F.coalesce("label", "node")).join(sized, "node"), "current")
    open_ = current.groupBy("family").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("family")
    current = stored(current.join(open_, "family"), "open")
    wanted = texts.join(small(current.select("node")), "node", "left_semi")
    more = stored(_family_links(current.join(_shingled(wanted, k), "node"), threshold).distinct(), "family-links")
    joined = labels(more).select(F.col("node").alias("label"), F.col("label").alias("joined"))
    labelled_nodes = nodes.select("key", "node", "least_id", "copies").join(first, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled_nodes = labelled_nodes.join(joined, "label", "left").withColumn("label", F.coalesce("joined", "label"))
    least = F.min(F.struct(F.col("least_id").isNull(), "least_id", "key"))["key"]
    classes = labelled_nodes.groupBy("label").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"), least.alias("survivor"))
    of_key = labelled_nodes.select("key", "label").join(classes, "label").select("key", "class_id", "class_size", "survivor")
    known = rows.where("n > 0").select("doc_id", "key").join(of_key, "key").select("doc_id", "key", "class_id", "class_size", "survivor")
    alone = rows.where("n = 0").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), F.col("key").alias("survivor"))
    return known.union(alone)


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of ``docs``, all columns as they are, less those of a class that are not its survivor: the least id, null
    ids last, and under one id the text of the least digest.

    Rows that repeat both id and text are one document and stay or go together.
    """
    judged = _judged(docs, doc_id, text, **options)
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("key").eqNullSafe(F.col("survivor"))
    gone = stored(judged.where(~stays).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct(), "gone")
    key = F.unhex(F.md5(docs[text]))
    return docs.join(small(gone), docs[doc_id].eqNullSafe(gone["__id"]) & (key == gone["__key"]), "left_anti")
