"""Ranked lexical search over document shards.

``index`` cuts the documents into shards of about ``SHARD_BYTES`` of text; a shard is one row with
its terms in order and their postings in compressed sparse rows: for each term the documents of the
shard that hold it and their impacts, the integer part of the score that doesn't depend on the query.
The whole vocabulary is indexed, so one index answers any query. ``search`` takes the queries block by
block; for each, shards report how many of their documents hold the block's terms, the sums give the
terms' weights, and every shard then adds up its documents' scores term by term in a dense array of
integers. A shard's best are found by partition, with all that equal the last of them, then ordered;
the best of all shards are merged.

An impact of a document with tf occurrences is (10**9 * tf) div (1000 * tf + 8 * m), where m is
10 + (90 * n * N) div L for n terms in the document, N documents with a term and L terms in all; a
term's weight is floor(1000 * ln((2 * N + 2) / (2 * df + 1))).

Memory: a task holds a shard at a time. In the saved index a shard is a row group, as writers and readers hold
whole groups; Arrow batches have about ``BATCH_BYTES``, so shards go to Python one by one. A text longer than
a shard is a shard of its own, counted in pieces of ``PIECE_BYTES``, so beside the text itself only its
distinct terms are held. The driver holds a block of queries, ``BLOCK_ITEMS`` items and about ``BLOCK_TERMS``
terms, and a count for each term.

Defined results: a null text has no term, and a query without terms or without a document of a score
above 0 has no rows; rows that repeat an id are documents of their own and may both be found; ties go
to the smaller id, a null id before all others; rows of queries that repeat an id are searched as one
query with the terms of all of them; an empty table of either kind gives no rows; extra columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.arrowtext import pieces, slices, texts, tidy, utf8
from lamina.session import byte_batches, cut, saved, text_batches

SHARD_BYTES, PIECE_BYTES = 8 << 20, 1 << 20
#: Queries that are searched in one pass over the index, and their terms.
BLOCK_ITEMS, BLOCK_TERMS = 2000, 200_000
BEST = 10
#: Whole numbers of the impact and of m.
SCALE, BASE, SLOPE = 1_000_000_000, 10, 90

#: Bytes of terms (lower-cased where A-Z), 0 for all that separates them.
_TERM = np.arange(256, dtype=np.uint8)
_TERM[:0x30] = _TERM[0x3A:0x41] = _TERM[0x5B:0x61] = _TERM[0x7B:0x80] = 0
_TERM[0x41:0x5B] += 0x20


def _starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes after lower-casing (0 between terms), and where terms begin; offsets are those of the texts in ``data``."""
    low = _TERM[data]
    on = low > 0
    first = on.copy()
    first[1:] &= ~on[:-1]
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begin] = on[begin]
    return low, np.flatnonzero(first)


def lengths(array: pa.Array) -> np.ndarray:
    """The number of terms of each text."""
    data, offsets = utf8(array)
    out = np.zeros(len(array), np.int64)
    for a, b, lo, hi in pieces(data, offsets, PIECE_BYTES, _TERM == 0):
        at = np.clip(offsets[a : b + 1], lo, hi) - lo
        out[a:b] += np.diff(np.searchsorted(_starts(data[lo:hi], at)[1], at))
    return out


def counted(array: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of all texts, and (term, text, occurrences) by term and text."""
    data, offsets = utf8(array)
    known, parts = None, []
    for a, b, lo, hi in pieces(data, offsets, PIECE_BYTES, _TERM == 0):
        at = np.clip(offsets[a : b + 1], lo, hi) - lo
        low, start = _starts(data[lo:hi], at)
        if not len(start):
            continue
        before = np.concatenate(([0], np.cumsum(low > 0)))
        ends = np.append(before[start], before[-1])
        text = np.searchsorted(at, start, "right") - 1 + a
        flat = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(low[low > 0])])
        d = flat.dictionary_encode()
        codes = np.asarray(d.indices, np.int64)
        key, n = np.unique(codes * len(array) + text, return_counts=True)
        parts.append((d.dictionary, key // len(array), key % len(array), n))
    if not parts:
        return pa.array([], pa.large_string()), *(np.zeros(0, np.int64),) * 3
    known = pa.chunked_array([p[0] for p in parts]).unique()
    known = known.take(pc.sort_indices(known))
    term = np.concatenate([np.asarray(pc.index_in(p[0], known), np.int64)[p[1]] for p in parts])
    text = np.concatenate([p[2] for p in parts])
    n = np.concatenate([p[3] for p in parts])
    key, where = np.unique(term * len(array) + text, return_inverse=True)
    return known, key // len(array), key % len(array), np.bincount(where, n, len(key)).astype(np.int64)


def totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents with a term, and terms of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, array in slices(batch, "t"):
                n = lengths(array)
                yield pa.RecordBatch.from_pydict({"n": pa.array([int((n > 0).sum())], pa.int64()), "l": pa.array([int(n.sum())], pa.int64())})

    text_batches(docs.sparkSession)
    byte_batches(docs.sparkSession)
    got = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    return got["n"] or 0, got["l"] or 0


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The saved shards (ids, terms, at, doc, impact) and the number of documents with a term; ``at`` has a place more than ``terms``."""
    many, every = totals(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, array in slices(batch, "t", SHARD_BYTES):
                names, term, doc, tf = counted(array)
                n = np.bincount(doc, tf, len(array)).astype(np.int64)
                m = np.array([BASE + SLOPE * x * many // max(1, every) for x in n.tolist()], np.int64)  # in Python's integers: they may pass 64 bits on the way
                impact = SCALE * tf // (1000 * tf + 8 * m[doc])
                one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
                yield pa.RecordBatch.from_pydict(
                    {
                        "ids": pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), rows.column("id")),
                        "terms": pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names.cast(pa.string())),
                        "at": one(np.searchsorted(term, np.arange(len(names) + 1)), pa.int32()),
                        "doc": one(doc, pa.int32()),
                        "impact": one(impact, pa.int32()),
                    }
                )
        tidy()

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return saved(kept.mapInArrow(run, "ids array<long>, terms array<string>, at array<int>, doc array<int>, impact array<int>"), group_rows=1), many


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item`` and its distinct ``terms``, for the items with a term."""

    @F.arrow_udf("array<string>")
    def terms(column: pa.Array) -> pa.Array:
        array = texts(column)
        names, term, text, _ = counted(array)
        order = np.lexsort((term, text))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[order], np.arange(len(array) + 1)), pa.int32()), names.cast(pa.string()).take(pa.array(term[order])))

    rows = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("item"), F.explode(terms(F.col(text_col))).alias("t")).distinct()
    return rows.groupBy("item").agg(F.array_sort(F.collect_list("t")).alias("terms")).orderBy("item")


def _blocks(items: DataFrame) -> Iterator[list]:
    """The queries in blocks that the driver and the tasks can hold."""
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and (len(block) == BLOCK_ITEMS or size + len(row["terms"]) > BLOCK_TERMS):
            yield block
            block, size = [], 0
        block.append((row["item"], row["terms"]))
        size += len(row["terms"])
    if block:
        yield block


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, ...]]:
    """The arrays of each shard."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(batch.column(c)[k].values for c in batch.schema.names)


def best_of(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores above 0, highest first, equal ones by id: all that equal the last one that a partition finds are ordered."""
    at = np.flatnonzero(score > 0)
    if len(at) > most:
        last = score[at[np.argpartition(-score[at], most - 1)[:most]]].min()
        at = at[score[at] >= last]
    return at[np.lexsort((ids[at], -score[at]))][:most]


def _search_block(shards: DataFrame, block: list, many: int, most: int) -> DataFrame:
    """(item number in the block, doc_id, score): the best of each shard."""
    names = pa.array(sorted({t for _, ts in block for t in ts}), pa.string())
    number = {t: k for k, t in enumerate(names.to_pylist())}

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(names), np.int64)
        for terms, at in _views(batches):
            place = pc.index_in(names, terms).fill_null(-1).to_numpy(zero_copy_only=False)
            df += np.where(place >= 0, np.diff(np.asarray(at))[place] if len(terms) else 0, 0)
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"k": pa.array(hit, pa.int32()), "df": pa.array(df[hit], pa.int64())})

    counts = shards.select("terms", "at").mapInArrow(frequency, "k int, df long").groupBy("k").agg(F.sum("df").alias("df")).collect()  # a row for each term of the block
    weight = np.zeros(len(names), np.int64)
    for k, df in counts:
        weight[k] = math.floor(1000 * math.log((2 * many + 2) / (2 * df + 1)))
    wanted = [np.array([number[t] for t in ts], np.int64) for _, ts in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, terms, at, doc, impact in _views(batches):
            place = pc.index_in(names, terms).fill_null(-1).to_numpy(zero_copy_only=False)
            order = np.asarray(ids.fill_null(np.iinfo(np.int64).min))
            at, doc, impact = np.asarray(at), np.asarray(doc), np.asarray(impact).astype(np.int64)
            out: list[tuple[int, np.ndarray, np.ndarray]] = []
            for item, ts in enumerate(wanted):
                score = np.zeros(len(order), np.int64)
                for t in ts[place[ts] >= 0].tolist():
                    a, b = at[place[t]], at[place[t] + 1]
                    score[doc[a:b]] += weight[t] * impact[a:b]
                found = best_of(score, order, most)
                out.append((item, found, score[found]))
            size = [len(f) for _, f, _ in out]
            found = np.concatenate([f for _, f, _ in out])
            yield pa.RecordBatch.from_pydict({"item": pa.array(np.repeat([i for i, _, _ in out], size), pa.int32()), "doc_id": ids.take(pa.array(found, pa.int64())), "score": pa.array(np.concatenate([s for _, _, s in out]), pa.int64())})

    return shards.mapInArrow(run, "item int, doc_id long, score long")


def search(shards: DataFrame, many: int, items: DataFrame, most: int = BEST, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Of each query its ``most`` best documents: the id, ``rank`` from 1, ``doc_id`` and ``score``."""
    spark = shards.sparkSession
    byte_batches(spark)
    kind = items.select(id_col).schema
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    out = spark.createDataFrame([], f"`{id_col}` {kind[0].dataType.simpleString()}, rank int, doc_id long, score long")
    for block in _blocks(cut(query_terms(items, id_col, text_col))):
        ranked = _search_block(shards, block, many, most).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)  # each task's best go through the shuffle only
        known = F.array(*(F.lit(i).cast(kind[0].dataType) for i, _ in block))
        out = out.union(ranked.select(F.element_at(known, F.col("item") + 1).alias(id_col), "rank", "doc_id", "score"))
    return out
