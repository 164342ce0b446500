"""Term counts and class-based term weights in long form."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tamhis.functions import text as tx
from tamhis.session import small

_PLACES = 1 << 18  # places of tokens whose n-grams are counted at once
_PIECE_PLACES = 1 << 20  # places of tokens whose n-grams leave a task in one set of pieces
_HELD_ENTRIES = 1 << 21  # entries of pieces that are grouped at once
_OUT_ROWS = 10_000
_PLAIN = (T.StringType(), T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DateType())


def _without(tokens: Column, words: Sequence[str]) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(*words)) if words else tokens


def explode_terms(
    df: DataFrame,
    text_col: str,
    keep: Sequence[str],
    stop_words: Iterable[str] | DataFrame | None = None,
    ngram_range: tuple[int, int] = (1, 1),
) -> DataFrame:
    """One row ``(*keep, term)`` per term occurrence.

    A list of stop words is a hash-set filter in the plan. A stop-word table ``(word)`` is anti-joined, and
    broadcast only when its measured size is small; with n-grams a table is not accepted, because n-grams
    are built after the stop words are gone and inside one row.
    """
    low, high = ngram_range
    tokens = tx.word_tokens(text_col)
    if isinstance(stop_words, DataFrame):
        if high > 1:
            raise ValueError("n-grams need the stop words as a list")
        rows = df.select(*keep, F.explode(tokens).alias("term"))
        listed = small(stop_words.select(F.col("word").alias("term")).distinct())
        return rows.join(listed, "term", "left_anti").select(*keep, "term")
    words = tuple(dict.fromkeys(stop_words or ()))
    if (low, high) == (1, 1):
        rows = df.select(*keep, F.explode(tokens).alias("term"))
        return rows.where(~F.col("term").isin(*words)) if words else rows
    rows = tx.with_tokens(df, keep, _without(tokens, words), "__tokens")
    return rows.select(*keep, F.explode(tx.word_ngrams(F.col("__tokens"), low, high)).alias("term"))


def _partial_ngrams(rows: DataFrame, by: Sequence[str], low: int, high: int, places: int = _PLACES) -> DataFrame:
    """``(*by, term, n)`` of ``(*by, __tokens)``, counted for ``places`` places of a batch at a time, so a term can come many times."""
    nested = any(isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType)) for f in rows.select(*by).schema.fields)
    schema = T.StructType([*rows.select(*by).schema.fields, T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            columns, lists = [batch.column(i) for i in range(len(by))], batch.column(len(by))
            tokens, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            # Rows with equal values of ``by`` share the first of their numbers; nested values are not compared, each row is its own.
            group = np.arange(len(sizes))
            if not nested and len(sizes):
                keys = [f"k{i}" for i in range(len(by))]
                first = pa.table([*columns, pa.array(group)], names=[*keys, "row"])
                least = first.group_by(keys, use_threads=False).aggregate([("row", "min"), ("row", "list")])
                lengths = pc.list_value_length(least["row_list"]).to_numpy()
                group[pc.list_flatten(least["row_list"]).to_numpy()] = np.repeat(least["row_min"].to_numpy(), lengths)
            for start in range(0, len(tokens), places):
                grams, groups = [], []
                for n in range(low, high + 1):
                    at = np.arange(start, min(start + places, len(tokens) - n + 1))
                    at = at[owner[at] == owner[at + n - 1]]
                    parts = [tokens.take(pa.array(at + k)) for k in range(n)]
                    grams.append(pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0])
                    groups.append(group[owner[at]])
                table = pa.table([pa.array(np.concatenate(groups)), pa.chunked_array(grams)], names=["row", "term"])
                counted = table.group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
                of = counted["row"].combine_chunks()
                made = [*(c.take(of).cast(arrow.field(i).type) for i, c in enumerate(columns)), counted["term"], counted["count_all"]]
                yield from pa.table(made, schema=arrow).to_batches(max_chunksize=10_000)

    return rows.mapInArrow(run, schema)


def _pack(values: np.ndarray) -> bytes:
    """Numbers from 0 on, in as few bytes each as the largest needs, compressed."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    raw = values.astype(kind).tobytes()
    return kind.char.encode() + len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unpack(packed: bytes) -> np.ndarray:
    size = int.from_bytes(packed[1:9], "little")
    raw = pa.decompress(packed[9:], size, codec="zstd", asbytes=True) if size else b""
    return np.frombuffer(raw, np.dtype(packed[:1].decode()))


def _sorted_runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by all columns (numbers from 0 on), and where in it each run of equal rows begins."""
    key, span = columns[-1].astype(np.int64), int(columns[-1].max(initial=0)) + 1
    for column in reversed(columns[:-1]):
        own = int(column.max(initial=0)) + 1
        if own * span >= 1 << 63:
            values, key = np.unique(key, return_inverse=True)
            span = len(values)
        key, span = column.astype(np.int64) * span + key, own * span
    order = np.argsort(key)
    key = key[order]
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))


def _row_groups(columns: list[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its group of equal rows, and one row of each group."""
    if not columns:
        return np.zeros(rows, np.int64), np.zeros(min(1, rows), np.int64)
    names = [f"k{i}" for i in range(len(columns))]
    grouped = pa.table([*columns, pa.array(np.arange(rows))], names=[*names, "row"]).group_by(names, use_threads=False)
    found = grouped.aggregate([("row", "min"), ("row", "list")])
    group, lists = np.zeros(rows, np.int64), found["row_list"].combine_chunks()
    group[lists.flatten().to_numpy()] = np.repeat(np.arange(found.num_rows), pc.list_value_length(lists).to_numpy())
    return group, found["row_min"].to_numpy()


def _mixed(columns: Sequence[np.ndarray]) -> np.ndarray:
    mixed = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _levels(low: int, high: int) -> list[tuple[int, int]]:
    """First and last length of the n-grams that travel together: single words, and those that share their first two words."""
    return [(low, low)] * (low == 1) + [(max(2, low), high)] * (high > 1)


def _ngram_pieces(rows: DataFrame, by: Sequence[str], low: int, high: int, buckets: int, places: int = _PIECE_PLACES) -> DataFrame:
    """``(bucket, level, owners, parts)``: the n-grams of a stretch of tokens that fall into a bucket, each place's longest one only.

    Shorter n-grams of a place are its beginnings, so they need not travel. A piece lists its distinct words once, in order, and its
    n-grams as sorted numbers of words, which compresses to a fifth of what rows of strings take.
    """

    def pieces(table):
        owned, lists = [c.combine_chunks() for c in table.columns[: len(by)]], table.column(len(by)).combine_chunks()
        tokens, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        if not len(tokens):
            return
        owner = np.repeat(np.arange(len(sizes)), sizes)
        coded = tokens.dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary)
        words, place = coded.dictionary.take(order), np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(1, len(order) + 1)
        code = place[coded.indices.to_numpy()]  # 0 stands for no word
        group, firsts = _row_groups(owned, len(sizes))
        word_hash = np.fromiter(map(zlib.crc32, [b"", *words.cast(pa.binary()).to_pylist()]), np.uint64)
        values = zip(*(c.take(pa.array(firsts)).to_pylist() for c in owned)) if owned else [()]
        group_hash = np.fromiter((zlib.crc32(repr(v).encode()) for v in values), np.uint64)
        for start in range(0, len(tokens), places):
            at = np.arange(start, min(start + places, len(tokens)))
            for level, (base, width) in enumerate(_levels(low, high)):
                columns = []
                for k in range(width):
                    there = np.minimum(at + k, len(tokens) - 1)
                    columns.append(np.where((at + k < len(tokens)) & (owner[there] == owner[at]), code[there], 0))
                long = columns[base - 1] > 0
                if not long.any():
                    continue
                columns = [group[owner[at]][long], *(c[long] for c in columns)]
                bucket = (_mixed([group_hash[columns[0]], *(word_hash[c] for c in columns[1 : base + 1])]) >> np.uint64(20)) % np.uint64(buckets)
                order, begins = _sorted_runs([bucket, *columns])
                counts, distinct = np.diff(begins, append=len(order)), order[begins]
                bucket, columns = bucket[distinct].astype(np.int64), [c[distinct] for c in columns]
                edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
                for begin, end in zip(edges[:-1], edges[1:]):
                    used, local = np.unique(np.stack([c[begin:end] for c in columns[1:]]), return_inverse=True)
                    local = local.reshape(width, -1) + (used[0] > 0)
                    named = words.take(pa.array(used[used > 0] - 1)).cast(pa.binary())
                    owners = columns[0][begin:end]
                    runs = np.flatnonzero(np.diff(owners, prepend=-1))
                    sink = pa.BufferOutputStream()
                    listed = pa.table([c.take(pa.array(firsts[owners[runs]])) for c in owned], names=[f"k{i}" for i in range(len(by))])
                    with pa.ipc.new_stream(sink, listed.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_table(listed)
                    step = np.diff(local[0], prepend=0)  # mostly 0 or a little more, below 0 where the next owner begins
                    parts = [np.diff(runs, append=end - begin), counts[begin:end], np.where(step < 0, -2 * step - 1, 2 * step), *local[1:]]
                    lengths = pc.binary_length(named).to_numpy()
                    letters = np.frombuffer(named.buffers()[2], np.uint8, int(lengths.sum()))
                    parts = [_pack(lengths), _pack(letters), *map(_pack, parts)]
                    yield int(bucket[begin]), level, sink.getvalue().to_pybytes(), parts

    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("owners", T.BinaryType()),
                           T.StructField("parts", T.ArrayType(T.BinaryType()))])

    def run(batches):
        arrow = to_arrow_schema(schema)

        def made(table):
            rows, size = [], 0
            for row in pieces(table):
                rows.append(row)
                size += sum(map(len, row[3]))
                if size > 4 << 20:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(len(by)).flatten())
            if size >= places:
                yield from made(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from made(pa.Table.from_batches(held))

    return rows.mapInArrow(run, schema)


def _piece_counts(held: list, arrow: pa.Schema, base: int, width: int, entries: int):
    """Batches of ``(*by, term, n)`` of all pieces of one bucket. Above ``entries`` entries it is gone through several times, a part each."""
    keys = len(arrow) - 2
    tables = [pa.ipc.open_stream(owners).read_all() for owners, _ in held]
    owned = pa.concat_tables(tables)
    owned = [owned.column(i).combine_chunks() for i in range(keys)]
    group, firsts = _row_groups(owned, sum(t.num_rows for t in tables) if keys else len(held))
    lengths = [_unpack(parts[0]) for _, parts in held]
    ends = np.cumsum(np.concatenate([[0], *lengths]), dtype=np.int64)
    letters = np.concatenate([_unpack(parts[1]) for _, parts in held])
    words = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
    names, place = words.dictionary, words.indices.to_numpy().astype(np.int64) + 1
    total = sum(int(_unpack(parts[2]).sum()) for _, parts in held)
    passes = max(1, math.ceil(total / entries))

    for turn in range(passes):
        found, row, word = [], 0, 0
        for (_, parts), own in zip(held, lengths):
            runs, counts, first, *others = map(_unpack, parts[2:])
            local = np.concatenate([[0], place[word : word + len(own)]])
            step = first.astype(np.int64)
            step = np.where(step % 2, -(step + 1) // 2, step // 2)
            columns = [np.repeat(group[row : row + len(runs)], runs), local[np.cumsum(step)], *(local[c] for c in others)]
            row, word = row + len(runs), word + len(own)
            columns.append(counts.astype(np.int64))
            if passes > 1:
                ours = _mixed(columns[: base + 1]) % np.uint64(passes) == turn
                columns = [c[ours] for c in columns]
            found.append(columns)
        *columns, counts = (np.concatenate(c) for c in zip(*found))
        del found
        order, _ = _sorted_runs(columns)
        columns, counts = [c[order] for c in columns], counts[order]
        change = np.zeros(len(order), bool)
        change[:1] = True
        for n, column in enumerate(columns):
            change[1:] |= column[1:] != column[:-1]
            if n < base or not len(order):
                continue
            begins = np.flatnonzero(change)
            sums = np.add.reduceat(counts, begins)
            whole = column[begins] > 0  # the others end before their ``n``-th word
            begins, sums = begins[whole], sums[whole]
            for at in range(0, len(begins), _OUT_ROWS):
                some = begins[at : at + _OUT_ROWS]
                parts = [names.take(pa.array(c[some] - 1)) for c in columns[1 : n + 1]]
                term = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if n > 1 else parts[0]
                owners = pa.array(firsts[columns[0][some]])
                made = [*(c.take(owners) for c in owned), term, pa.array(sums[at : at + _OUT_ROWS])]
                yield pa.record_batch([c.cast(f.type) for c, f in zip(made, arrow)], schema=arrow)


def _grouped_pieces(pieces: DataFrame, schema: T.StructType, low: int, high: int, entries: int = _HELD_ENTRIES) -> DataFrame:
    """``schema`` rows ``(*by, term, n)`` of all pieces; those of a bucket meet in one task."""

    def run(batches):
        arrow, held, now = to_arrow_schema(schema), [], None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["bucket"], row["level"]) != now:
                    if held:
                        yield from _piece_counts(held, arrow, *_levels(low, high)[now[1]], entries)
                    held, now = [], (row["bucket"], row["level"])
                held.append((row["owners"], row["parts"]))
        if held:
            yield from _piece_counts(held, arrow, *_levels(low, high)[now[1]], entries)

    return pieces.repartition("bucket", "level").sortWithinPartitions("bucket", "level").mapInArrow(run, schema)


def count_terms(df, text_col, by, stop_words=None, ngram_range=(1, 1)) -> DataFrame:
    """``(*by, term, n)``; counts are combined before the shuffle.

    Nearly every n-gram of several words is rare, so a task that grouped all of its own would only spill them. They are combined over a
    stretch of tokens, which is enough for the frequent ones, and dealt out as compressed pieces, which are grouped bucket by bucket.
    """
    by = [by] if isinstance(by, str) else list(by)
    low, high = ngram_range
    if high == 1 or isinstance(stop_words, DataFrame):
        rows = explode_terms(df, text_col, by, stop_words, ngram_range)
        return rows.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n"))
    if not 1 <= low <= high:
        raise ValueError("need 1 <= low <= high")
    rows = df.select(*by, _without(tx.word_tokens(text_col), tuple(dict.fromkeys(stop_words or ()))).alias("__tokens"))
    kept = rows.select(*by).schema.fields
    if all(f.dataType in _PLAIN for f in kept):
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        schema = T.StructType([*kept, T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])
        return _grouped_pieces(_ngram_pieces(rows, by, low, high, buckets), schema, low, high)
    partial = _partial_ngrams(rows, by, low, high)
    return partial.repartition(*by, "term").groupBy(*by, "term").agg(F.sum("n").alias("n"))


def term_idf(total_terms: Column, mean_words: Column, form: str) -> Column:
    """``bm25``: log(1 + (A - f + 0.5) / (f + 0.5)); ``base``: log(1 + A / f)."""
    if form == "bm25":
        return F.log(1.0 + (mean_words - total_terms + 0.5) / (total_terms + 0.5))
    if form == "base":
        return F.log(1.0 + mean_words / total_terms)
    raise ValueError(f"unknown idf form {form!r}; use 'bm25' or 'base'")


def ctfidf(counts: DataFrame, by: str = "topic", form: str = "bm25", damp: bool = True) -> DataFrame:
    """Class-based TF-IDF of ``(by, term, n)``: ``(by, term, n, weight)``.

    The share of a term in its class (its square root when ``damp``) times an idf from all classes. Rows
    without a class carry no weight and are left out. The counts are aggregated once: class totals and their
    mean reuse the exchange of the counts, term totals are a window over one term, a row per class.
    """
    counts = counts.where(F.col(by).isNotNull())
    totals = counts.groupBy(by).agg(F.sum("n").cast("double").alias("__class_n"))
    mean = totals.agg(F.avg("__class_n")).scalar()
    weighted = counts.withColumn("__term_n", F.sum("n").over(Window.partitionBy("term")).cast("double"))
    share = F.col("n").cast("double") / F.col("__class_n")
    tf = F.sqrt(share) if damp else share
    return weighted.join(totals, by).select(
        by, "term", "n", (tf * term_idf(F.col("__term_n"), mean, form)).alias("weight")
    )


def top_terms(weights: DataFrame, by: str | Sequence[str] = "topic", n: int = 15) -> DataFrame:
    """The ``n`` heaviest terms per class with their ``rank``; ties go to the smaller term.

    Spark keeps ``n`` rows per class in each task before the shuffle (window group limit), so a class that
    holds most of the vocabulary does not move it.
    """
    by = [by] if isinstance(by, str) else list(by)
    order = Window.partitionBy(*by).orderBy(F.desc("weight"), F.asc("term"))
    ranked = weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select(*by, "term", "weight", "rank")
