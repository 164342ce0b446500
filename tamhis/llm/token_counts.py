"""Token counts of flat token files without an index: separators are searched in blocks and stitched by a prefix scan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.llm.bpe import load_encoding
from tamhis.llm.common import bound_batches, map_rows

#: Tokens of a block, and blocks that are scanned together before their totals are.
BLOCK = 1 << 16
SPAN = 1 << 10
_IDS = 4_096


def flat_token_files(docs: DataFrame, ranks_path: str, pattern: str, separator: int, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Flat token files, one for each partition, as blocks ``(file, block, data)``, and the order of their documents.

    ``data`` holds little-endian unsigned 16-bit ids; every document, a null or empty one too, ends with ``separator``, and
    blocks end anywhere. Rows without a block hold ``doc_ids``, the ids of documents ``first_doc`` and following of the
    file: no place of a document is written.
    """
    fields = [pa.field("file", pa.int32()), pa.field("block", pa.int64()), pa.field("data", pa.binary()), pa.field("first_doc", pa.int64()), pa.field("doc_ids", pa.list_(pa.int64()))]

    def write(batches):
        encoding, file = load_encoding(ranks_path, pattern), TaskContext.get().partitionId()
        if encoding.n_vocab > separator or separator > 0xFFFF:
            raise ValueError("the separator must be a free 16-bit id")
        row = lambda *values: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, fields, strict=True)], schema=pa.schema(fields))
        waiting, n_waiting, n_blocks, ids, n_docs = [], 0, 0, [], 0
        for batch in batches:
            for one, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                waiting.append(np.array([*encoding.encode_ordinary(value or ""), separator], "<u2"))
                n_waiting += len(waiting[-1])
                ids.append(one)
                n_docs += 1
                if len(ids) == _IDS:
                    yield row(file, None, None, n_docs - len(ids), ids)
                    ids = []
                if n_waiting >= block:
                    tokens = np.concatenate(waiting)
                    for at in range(0, n_waiting - block + 1, block):
                        yield row(file, n_blocks, tokens[at : at + block].tobytes(), None, None)
                        n_blocks += 1
                    waiting = [tokens[n_waiting - n_waiting % block :]]
                    n_waiting %= block
        if n_waiting:
            yield row(file, n_blocks, np.concatenate(waiting).tobytes(), None, None)
        if ids:
            yield row(file, None, None, n_docs - len(ids), ids)

    bound_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("bigint"), text)
    return source.mapInArrow(write, "file int, block long, data binary, first_doc long, doc_ids array<long>")


def read_token_files(spark, path: str, block_bytes: int = 2 * BLOCK) -> DataFrame:
    """Blocks ``(file, block, data)`` of real flat token files; ``file`` is the path. A file has to fit a binary cell (2 GB)."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    blocks = files.select(F.col("path").alias("file"), "content", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(length - 1) DIV {block_bytes}"))).alias("block"))
    return blocks.select("file", "block", F.substring("content", (F.col("block") * block_bytes + 1).cast("int"), F.lit(block_bytes)).alias("data"))


def count_tokens(blocks: DataFrame, separator: int, dtype: str = "<u2") -> DataFrame:
    """``file, ordinal, start, n_tokens, terminated`` for every document of every file.

    ``blocks`` has ``file, block, data``: consecutive parts of each file, numbered from 0 without a gap. A block is searched in one
    vector comparison; its token count, its separators and the last of them are all that moves on. Totals over
    spans of blocks are scanned first, then the blocks in their span, so a file with a third of all blocks is
    scanned in many tasks. ``start`` and ``n_tokens`` leave the separator out. Tokens after the last separator are a last
    document that is not terminated. Two separators side by side hold a document of no tokens. An empty block or table
    adds nothing; null data counts as an empty block; other columns are not read. A block that ends inside a token is an error.
    """
    fields = [T.StructField("n", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType()))]

    def make():
        def work(data):
            tokens = np.frombuffer(data or b"", dtype)
            return len(tokens), np.flatnonzero(tokens == separator).tolist()

        return work

    found = map_rows(blocks, ["file", "block"], ["data"], fields, make)
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    inside = earlier("file", "span", "block")
    found = found.withColumn("span", F.expr(f"block DIV {SPAN}"))
    found = found.withColumn("before", F.coalesce(F.sum("n").over(inside), none)).withColumn("docs", F.coalesce(F.sum(F.size("ends")).over(inside), none))
    found = found.withColumn("last", F.col("before") + F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1)).withColumn("open", F.max("last").over(inside))
    spans = found.groupBy("file", "span").agg(F.sum("n").alias("span_n"), F.sum(F.size("ends")).alias("span_docs"), F.max("last").alias("span_last"))
    over = earlier("file", "span")
    spans = spans.withColumn("span_before", F.coalesce(F.sum("span_n").over(over), none)).withColumn("docs_before", F.coalesce(F.sum("span_docs").over(over), none))
    spans = spans.withColumn("span_last", F.col("span_before") + F.col("span_last")).withColumn("span_open", F.max("span_last").over(over))
    placed = found.join(spans.select("file", "span", "span_before", "docs_before", "span_open"), ["file", "span"])
    offset = F.col("span_before") + F.col("before")
    opened = F.coalesce(F.col("span_before") + F.col("open"), F.col("span_open"), F.lit(-1))
    each = placed.select("file", (F.col("docs_before") + F.col("docs")).alias("first"), offset.alias("offset"), opened.alias("opened"), "ends", F.posexplode("ends").alias("i", "end"))
    begin = F.coalesce(F.col("offset") + F.get("ends", F.col("i") - 1), F.col("opened")) + 1
    closed = each.select("file", (F.col("first") + F.col("i")).alias("ordinal"), begin.alias("start"), (F.col("offset") + F.col("end") - begin).alias("n_tokens"), F.lit(True).alias("terminated"))
    files = spans.groupBy("file").agg(F.sum("span_n").alias("n"), F.sum("span_docs").alias("ordinal"), F.coalesce(F.max("span_last") + 1, none).alias("start"))
    rest = files.where("n > start").select("file", "ordinal", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return closed.union(rest)
