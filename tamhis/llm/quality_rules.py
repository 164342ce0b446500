"""Quality rules: line frequency across documents, and per-text counts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamhis.llm.common import stored
from tamhis.session import small

WORD = "[^\\x20\\x09-\\x0D]+"
BLANKS = "[\\x20\\x09-\\x0D]+"
WINDOW = 5


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once; an expression used twice would be copied by the optimizer."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column) -> Column:
    """Words that lie in a window of five words found twice or more.

    Windows are compared by a 64-bit hash. Most texts have none twice, so equal ones are looked for only then:
    sorted by (hash, place), a window is repeated if its neighbour has its hash, and the places covered by repeated
    windows add up from the gaps between their starts.
    """
    def covered(hashes: Column) -> Column:
        def gaps(starts: Column) -> Column:
            ahead = F.transform(starts, lambda s, i: F.coalesce(F.least(F.lit(WINDOW), F.get(starts, i + 1) - s), F.lit(WINDOW)))
            return F.aggregate(ahead, F.lit(0).cast("bigint"), lambda total, x: total + x)

        def starts(ordered: Column) -> Column:
            twice = F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False))
                             | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)))
            return _bound(F.sort_array(F.transform(twice, lambda x: x["i"])), gaps)

        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("bigint").alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(
            _bound(F.sort_array(pairs), starts))

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("bigint")).otherwise(_bound(hashes, covered))


def text_counts(text: str | Column) -> Column:
    """Struct of ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) of a whole text; null counts as empty."""
    value = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    lines = F.filter(F.split(value, "\n", -1), lambda x: x.rlike(WORD))
    counts = lambda words: F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        F.aggregate(words, F.lit(0).cast("bigint"), lambda total, w: total + F.length(w)).alias("word_chars"),
        F.length(F.regexp_replace(value, "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        _bound(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"),
        _repeated(words).alias("n_repeat_words"),
    )
    return _bound(F.regexp_extract_all(value, F.lit(WORD), F.lit(0)), counts)


def normal_line(line: Column) -> Column:
    """A line as it is compared: lower case, digits as 0, runs of blanks as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), BLANKS, " "))


def line_hash(line: Column) -> Column:
    """The first 60 bits of the MD5 of the normalised line."""
    return F.conv(F.substring(F.md5(normal_line(line)), 1, 15), 16, 10).cast("bigint")


def _lines(value: Column) -> Column:
    return F.filter(F.split(value, "\n", -1), lambda x: x.rlike(WORD))


def frequent_lines(docs: DataFrame, host: str, text: str, max_share: float = 0.05, min_docs: int = 10) -> DataFrame:
    """``(host, h, n_docs)``: normalised lines in more than ``max_share`` of a host's documents and at least ``min_docs``.

    Distinct documents are distinct texts, told apart by the MD5 of the whole text: exact copies count once, however
    many there are, and nothing else is merged. A host's documents are counted in the same way, those with a line.
    Counts are combined in each task first and dealt out by (host, line, document), so neither a hot host nor a hot
    line meets in one task.
    """
    # The optimizer must not copy the line hashes into each use, hence the one-element explode.
    hashes = F.array_distinct(F.transform(_lines(F.col(text)), line_hash))
    rows = docs.select(F.col(host).alias("host"), F.unhex(F.md5(F.col(text))).alias("doc"), F.explode(F.array(hashes)).alias("hs")).where(F.size("hs") > 0)
    # The null line stands for the document itself.
    marks = F.explode(F.concat(F.array(F.lit(None).cast("bigint")), F.col("hs"))).alias("h")
    counted = rows.select("host", "doc", marks).distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n_docs"))
    counted = stored(counted.where((F.col("n_docs") >= min_docs) | F.col("h").isNull()), "lines")
    totals = counted.where(F.col("h").isNull()).select(F.col("host").alias("of"), F.col("n_docs").alias("total"))
    return counted.where(F.col("h").isNotNull()).join(small(totals), F.col("host").eqNullSafe(F.col("of"))).where(
        F.col("n_docs") > max_share * F.col("total")).select("host", "h", "n_docs")


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_share: float = 0.05,
                  min_docs: int = 10, min_words: int = 10, min_left: float = 0.5, max_repeat_percent: int = 20) -> DataFrame:
    """One row for each row of ``docs``: id, ``row_key``, counts, ``base_failed``, ``removed_words`` and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of the words repeated. Frequent lines
    of the row's host are taken out; a document that loses words and is left with fewer than ``min_words`` words or
    less than ``min_left`` of its words is depleted. ``kept``: neither.
    A null or empty text has no words and fails. Null hosts are one host, null ids are an id like any other. Rows
    with equal id, host and text have equal verdicts, and each gets its row. Columns other than these three are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    frequent = stored(frequent_lines(rows, "host", "text", max_share, min_docs), "frequent").select(F.col("host").alias("of"), F.col("h").alias("line"))
    key = F.xxhash64("doc_id", "host", "text").alias("key")
    lines = rows.select(key, "doc_id", "host", F.posexplode(_lines(F.col("text"))).alias("place", "line_text"))
    lines = lines.select("key", "doc_id", "host", "place", line_hash(F.col("line_text")).alias("h"),
                         F.size(F.split(F.trim(F.regexp_replace("line_text", BLANKS, " ")), " ")).alias("words"))
    hit = lines.join(small(frequent), F.col("host").eqNullSafe(F.col("of")) & (F.col("h") == F.col("line")))
    # Repeated rows have equal keys: the place tells a line of the text from its copies.
    lost = hit.select("key", "doc_id", "place", "words").distinct().groupBy("key", "doc_id").agg(F.sum("words").alias("removed_words"))
    lost = lost.select(F.col("key").alias("lost_key"), F.col("doc_id").alias("lost_id"), "removed_words")
    counted = rows.select(key, "doc_id", F.explode(F.array(text_counts("text"))).alias("c")).select("key", "doc_id", "c.*")
    joined = counted.join(lost, (F.col("key") == F.col("lost_key")) & F.col("doc_id").eqNullSafe(F.col("lost_id")), "left")
    removed = F.coalesce("removed_words", F.lit(0).cast("bigint"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - removed
    depleted = (removed > 0) & ((left < min_words) | (left < min_left * F.col("n_words")))
    return joined.select(
        "doc_id", F.col("key").alias("row_key"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        removed.alias("removed_words"), (~failed & ~depleted).alias("kept"))


def remove_frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", max_share: float = 0.05, min_docs: int = 10) -> DataFrame:
    """``docs`` with the frequent lines of each host taken out of ``text``; other lines, blank ones too, stay as they are.

    The frequent lines of a host are one array next to its documents: a line is frequent only above ``max_share`` of
    the documents, so a host whose documents have ``n`` lines on average has at most ``n / max_share`` of them.
    """
    per_host = stored(frequent_lines(docs, host, text, max_share, min_docs).groupBy("host").agg(F.collect_set("h").alias("__lines")), "removed")
    per_host = per_host.withColumnRenamed("host", "__of")
    joined = docs.join(small(per_host), docs[host].eqNullSafe(per_host["__of"]), "left")
    kept = F.filter(F.split(text, "\n", -1), lambda x: ~(x.rlike(WORD) & F.array_contains("__lines", line_hash(x))))
    return joined.withColumn(text, F.when(F.col("__lines").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("__of", "__lines")


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """Rows of ``docs``, all columns as they are, that the rules keep. Texts are moved only if the refused ids are too many to broadcast."""
    verdicts = quality_rules(docs, doc_id, text, host, **limits)
    bad = stored(verdicts.where(~F.col("kept")).select(F.col("doc_id").alias("__bad"), F.col("row_key").alias("__key")).distinct(), "refused")
    key = F.xxhash64(docs[doc_id], docs[host], docs[text])
    return docs.join(small(bad), docs[doc_id].eqNullSafe(bad["__bad"]) & (key == bad["__key"]), "left_anti")
