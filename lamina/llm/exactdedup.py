"""Exact duplicates by composable polynomial fingerprints.

A text's bytes are hashed chunk by chunk, all chunks of a batch at once, as polynomials over two
prime fields; the hashes of neighbouring chunks combine by shifting the left one by the length of
the right one, so the chunks of a huge document can be hashed anywhere and in any order. Documents
of equal fingerprint and length are then compared with the one that stays, byte by byte: their
texts are dealt out as chunks of ``COMPARED`` bytes, and each chunk meets the same chunk of the one
that stays, so no row holds two texts and a huge text is compared by many tasks. Should two different texts ever share a fingerprint, everything is done anew with other
bases, so the classes are exact.

Defined results: null counts as an empty text, and all empty texts are copies of each other; the
largest id stays (nulls sort below every id); rows that repeat the staying id and text are the same
document and are all kept; an empty table gives no rows; of extra columns, those with the names of
added columns are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.arrowtext import slices, utf8
from lamina.session import cut, saved, text_batches

PRIMES = (2147483647, 2147483629)
CHUNK = 4096
#: Bytes of a chunk in comparison.
COMPARED = 1 << 20


def bases(attempt: int) -> tuple[int, int]:
    """Two bases for each attempt."""
    rng = np.random.default_rng(9001 + attempt)
    return tuple(int(x) for x in rng.integers(1 << 20, 1 << 30, 2))


def powers(base: int, prime: int, exponents: np.ndarray) -> np.ndarray:
    """base to the exponents, modulo prime."""
    out, square, e = np.ones(len(exponents), np.uint64), np.uint64(base), exponents.astype(np.uint64)
    while e.any():
        out = np.where(e & np.uint64(1), out * square % np.uint64(prime), out)
        square = np.uint64(int(square) ** 2 % prime)
        e >>= np.uint64(1)
    return out


def combine(left: np.ndarray, right: np.ndarray, right_length: np.ndarray, base: int, prime: int) -> np.ndarray:
    """Hashes of joined byte strings from the hashes of their parts."""
    return (left * powers(base, prime, right_length) + right) % np.uint64(prime)


def chunk_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, prime: int) -> np.ndarray:
    """The polynomial hash of each chunk (of at most ``CHUNK`` bytes; chunks lie one after another and cover ``data``)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    table = powers(base, prime, np.arange(CHUNK))
    weight = table[np.repeat(ends, ends - starts) - 1 - np.arange(len(data))]
    weight *= data.astype(np.uint64) + np.uint64(1)
    return np.add.reduceat(weight, starts) % np.uint64(prime)


def fingerprints(array: pa.Array, attempt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A 62-bit fingerprint and the byte length of each text."""
    data, offsets = utf8(array)
    sizes = np.diff(offsets)
    n = -(-sizes // CHUNK)
    text = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    starts = offsets[text] + k * CHUNK
    ends = np.minimum(starts + CHUNK, offsets[text + 1])
    whole = np.zeros(len(sizes), np.uint64)
    for base, prime in zip(bases(attempt), PRIMES, strict=True):
        h = np.zeros(len(sizes), np.uint64)
        if len(text):
            shifted = combine(chunk_hashes(data, starts, ends, base, prime), np.zeros(len(text), np.uint64), offsets[text + 1] - ends, base, prime)
            full = sizes > 0
            h[full] = np.add.reduceat(shifted, (np.cumsum(n) - n)[full]) % np.uint64(prime)
        whole = (whole << np.uint64(31)) | h
    return whole.astype(np.int64), sizes


def fingerprint(text: Column, attempt: int = 0) -> Column:
    """Struct of ``h`` and ``n`` for a text column."""

    @F.arrow_udf("struct<h: long, n: long>")
    def run(column: pa.Array) -> pa.Array:
        got = [fingerprints(a, attempt) for _, a in slices(pa.RecordBatch.from_arrays([column], ["t"]), "t")] or [(np.zeros(0, np.int64),) * 2]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([g[k] for g in got])) for k in (0, 1)], ["h", "n"])

    return run(F.coalesce(text, F.lit("")))


def _chunks(text: Column) -> Column:
    """A text's bytes in chunks of ``COMPARED``; an empty text has one empty chunk."""
    data = text.cast("binary")
    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.octet_length(text) - 1) / COMPARED).cast("int")), lambda k: F.substring(data, k * COMPARED + 1, F.lit(COMPARED)))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """(``_h``, ``_n``, ``id`` and ``sha`` of every row, cut; ``_h``, ``_n``, ``keep_id``, ``group_size`` of every group of two or more;
    the attempt whose fingerprints these are), proven by comparison of the texts."""
    text_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    for attempt in range(100):
        marked = docs.select(F.col(id_col).alias("id"), text.alias("t")).withColumn("_f", fingerprint(F.col("t"), attempt)).select("id", "t", F.col("_f.h").alias("_h"), F.col("_f.n").alias("_n"))
        small = cut(marked.select("id", "_h", "_n", F.sha2(F.col("t").cast("binary"), 256).alias("sha")))
        many = cut(small.groupBy("_h", "_n").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"))  # a join right after the aggregation could not be split by key
        members = marked.join(many.drop("group_size"), ["_h", "_n"]).select("_h", "_n", F.col("id").eqNullSafe(F.col("keep_id")).alias("stays"), F.posexplode(_chunks(F.col("t"))).alias("_k", "a"))
        members = saved(members)
        chunk = ["_h", "_n", "_k"]
        stays = saved(members.where("stays").groupBy(*chunk).agg(F.first("a").alias("b")))
        if members.join(stays, chunk).where("a != b").isEmpty():
            return small, many, attempt
    raise RuntimeError("texts collide under a hundred fingerprints")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    small, many, _ = groups(docs, id_col, text_col)
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    joined = small.join(many, ["_h", "_n"], "left")
    return joined.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", once: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; ``once``: of rows that repeat id and text too only the largest."""
    small, many, attempt = groups(docs, id_col, text_col)
    kept = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(F.struct(*kept).alias("_row"), F.col(id_col).alias("_id"), fingerprint(F.col(text_col), attempt).alias("_f"))
    marked = marked.select("_row", "_id", F.col("_f.h").alias("_h"), F.col("_f.n").alias("_n"))
    stays = marked.join(many, ["_h", "_n"], "left").where(F.col("group_size").isNull() | F.col("_id").eqNullSafe(F.col("keep_id")))
    if once:
        keys = ["_h", "_n"]
        kept_rows = small.join(many, keys).where(F.col("id").eqNullSafe(F.col("keep_id")))
        again = cut(kept_rows.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1").select(*keys))
        if not again.isEmpty():
            one = stays.join(again, keys, "left_semi").groupBy(*keys).agg(F.max("_row").alias("_row"))  # combined before the shuffle
            return stays.join(again, keys, "left_anti").select("_row.*").union(one.select("_row.*"))
    return stays.select("_row.*")
