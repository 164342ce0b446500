"""Fixed-length token ids over a corpus vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamhis.functions import text as tx
from tamhis.operators.quality import ID
from tamhis.session import pin, running_totals, small

PAD, UNKNOWN, START, END = 0, 1, 2, 3


def build_vocabulary(df: DataFrame, text_col: str, min_count: int = 1) -> DataFrame:
    """``(term, freq, term_id)``: ids from 4, by falling frequency and then by term.

    The global order is made by range partitions with offsets, not by one sorting task.
    """
    terms = df.select(F.explode(tx.word_tokens(text_col, min_length=1)).alias("term"))
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= min_count)
    ranked = running_totals(counts, [F.desc("freq"), F.asc("term")], {"position": F.lit(1)})
    return pin(ranked.select("term", "freq", (F.col("position") + END).cast("int").alias("term_id")))


def encode_fixed(
    df: DataFrame,
    text_col: str,
    vocabulary: DataFrame,
    max_len: int = 30,
    label_col: str | None = None,
    id_col: str = ID,
) -> DataFrame:
    """``(doc_id, ids, mask[, label])``: start mark, token ids, end mark, padding up to ``max_len``.

    Only the first ``max_len - 2`` tokens of a text leave its row. A vocabulary of measured small size is
    broadcast; otherwise the join is by term, where AQE splits a hot term.
    """
    if max_len < 3:
        raise ValueError("max_len must leave room for a token between the marks")
    carried = [F.col(label_col).alias("label")] if label_col else []
    names = ["label"] if label_col else []
    head = F.slice(tx.word_tokens(text_col, min_length=1), 1, max_len - 2)
    docs = df.select(id_col, *carried, F.posexplode_outer(head).alias("pos", "term"))
    known = docs.join(small(vocabulary.select("term", "term_id")), "term", "left")
    cell = F.when(
        F.col("term").isNotNull(), F.struct("pos", F.coalesce("term_id", F.lit(UNKNOWN)).alias("term_id"))
    )
    rows = known.groupBy(id_col, *names).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    body = F.transform("cells", lambda cell: cell["term_id"])
    marked = F.concat(F.array(F.lit(START)), body, F.array(F.lit(END)))
    rows = rows.select(id_col, *names, marked.alias("ids"))
    room = F.lit(max_len) - F.size("ids")
    return rows.select(
        id_col,
        F.concat("ids", F.array_repeat(F.lit(PAD), room)).alias("ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), room)).alias("mask"),
        *names,
    )
