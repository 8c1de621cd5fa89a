"""Audit of how document filters interact, over all orders they can be applied in.

The orders form a trie; what survives a prefix depends only on which filters are in it, not on their
order, so all prefixes of the same filters share one state. ``audit`` walks the trie depth first:
a state's survivors are its parent's, filtered once more and persisted; a state that was met before is
taken from memory. At each state the removals of all filters that may follow are counted by part, one
row a part. So ``2 ** k`` states of narrow rows (a part and a few booleans) answer ``k!`` orders.
Each state is counted by a job of its own, which adds a row a part to one table, and is let go when all
that follows it has been counted: one plan of all states would hold every state's plan many times in the
driver. What an executor loses is computed again from the saved rows.

Filters of the query (``verdicts``): A fewer than 200 words, B under half of the words distinct, C over
2 % capitals A-Z, D any of ``#$%&*|``, E the same text as a smaller id's, anywhere in the table.

Memory: texts are measured in pieces of ``PIECE_BYTES``; of a long text only its distinct words are held
besides. Equal texts are found by SHA-256 and length.

Defined results: a null text is an empty one; a null part is the empty string; a null id is smaller than
no id and has no label; of labels that repeat an id any row that says 1 counts; rows that repeat id and
text are all counted and none is a copy of the other; a filter whose verdict is null doesn't fail; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.arrowtext import pieces, slices, tidy, utf8
from lamina.session import cut, room, saved, text_batches

LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 2, "#$%&*|"
PIECE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(MARKS.encode())] = True


def _words(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts in ``data`` (whose offsets are ``at``), and the text of each."""
    on = ~_SPACE[data]
    first = on.copy()
    first[1:] &= ~on[:-1]
    begin = at[:-1][at[:-1] < at[1:]]
    first[begin] = on[begin]
    start = np.flatnonzero(first)
    ends = np.append(np.concatenate(([0], np.cumsum(on)))[start], on.sum())
    flat = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[on])])
    return flat, np.searchsorted(at, start, "right") - 1


def measured(array: pa.Array) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, code points and marks of each text."""
    data, offsets = utf8(array)
    n = len(array)
    out = {k: np.zeros(n, np.int64) for k in ("words", "different", "capitals", "points", "marks")}
    seen: dict[int, list[pa.Array]] = {}
    for a, b, lo, hi in pieces(data, offsets, PIECE_BYTES, _SPACE):
        part, at = data[lo:hi], np.clip(offsets[a : b + 1], lo, hi) - lo
        for k, on in (("capitals", (part >= 0x41) & (part <= 0x5A)), ("points", (part & 0xC0) != 0x80), ("marks", _MARK[part])):
            out[k][a:b] += np.diff(np.concatenate(([0], np.cumsum(on)))[at])
        flat, owner = _words(part, at)
        out["words"][a:b] += np.bincount(owner, minlength=b - a)
        d = flat.dictionary_encode()
        if b == a + 1:  # maybe one piece of several
            seen[a] = [pa.chunked_array([*seen.get(a, []), d.dictionary]).unique()]
        else:
            key = np.unique(owner * max(1, len(d.dictionary)) + np.asarray(d.indices, np.int64))
            out["different"][a:b] = np.bincount(key // max(1, len(d.dictionary)), minlength=b - a)
    for k, (words,) in seen.items():
        out["different"][k] = len(words)
    return out


def measures(text: Column) -> Column:
    """Struct of a text's figures."""

    @F.arrow_udf("struct<words: long, different: long, capitals: long, points: long, marks: long>")
    def run(column: pa.Array) -> pa.Array:
        names = ("words", "different", "capitals", "points", "marks")
        got = [measured(a) for _, a in slices(pa.RecordBatch.from_arrays([column], ["t"]), "t")]
        tidy()
        return pa.StructArray.from_arrays([pa.array(np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64)) for k in names], list(names))

    return run(F.coalesce(text, F.lit("")))


def verdicts() -> dict[str, Column]:
    """Failure conditions by letter, of the columns ``m`` (measures), ``id`` and ``first`` (the least id of the same text)."""
    m = lambda k: F.col(f"m.{k}")
    return {
        "A": m("words") < LEAST_WORDS,
        "B": 100 * m("different") < LEAST_DISTINCT * m("words"),
        "C": 100 * m("capitals") > MOST_CAPITALS * m("points"),
        "D": m("marks") > 0,
        "E": F.coalesce(F.col("id") > F.col("first"), F.lit(False)),
    }


def judged_rows(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every document: ``part``, ``good``, ``toxic`` and whether it fails each filter, saved."""
    text_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = saved(rows.select("id", "part", F.sha2(F.col("t").cast("binary"), 256).alias("sha"), F.octet_length("t").alias("size"), measures(F.col("t")).alias("m")))
    same = ["sha", "size"]
    copies = cut(rows.groupBy(*same).agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last"))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = cut(labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("lid")).agg(says("quality").alias("good"), says("toxic").alias("toxic")))
    whole = rows.join(copies, same, "left").join(marks, F.col("id") == F.col("lid"), "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return saved(whole.select("part", flag(F.col("good")).alias("good"), flag(F.col("toxic")).alias("toxic"), *(flag(v).alias(k) for k, v in verdicts().items())))


def audit(rows: DataFrame, letters: str) -> DataFrame:
    """The audit of filters, one boolean column a letter (true: fails), over rows with ``part``, ``good`` and ``toxic``: a row a part, order and step."""
    letters = "".join(sorted(letters))
    spark, path, met = rows.sparkSession, room(rows.sparkSession), set()

    def visit(state: str, left: DataFrame) -> None:
        met.add(state)
        after = [f for f in letters if f not in state]
        left = left.persist(StorageLevel.MEMORY_AND_DISK)
        edge = ", ".join(f"struct('{f}' AS f, count_if(`{f}`) AS removed, count_if(`{f}` AND good) AS good_lost, count_if(`{f}` AND toxic) AS toxic_lost)" for f in after)
        left.groupBy("part").agg(F.expr(f"'{state}' AS state"), F.expr("count(*) AS n"), F.expr(f"array({edge}) AS edges")).write.mode("append").parquet(path)
        for f in after:
            child = "".join(sorted(state + f))
            if child not in met and len(child) < len(letters):
                visit(child, left.where(~F.col(f)))
        left.unpersist()

    start = rows.select("part", "good", "toxic", *letters)
    visit("", start)
    alone = ", ".join(f"struct('{f}' AS f, count_if(`{f}` AND NOT ({' OR '.join(f'`{g}`' for g in letters if g != f) or 'false'})) AS alone, count_if(`{f}`) AS fails)" for f in letters)
    of_filter = cut(start.groupBy("part").agg(F.expr(f"array({alone}) AS a")).select("part", F.inline("a")))
    edges = "array<struct<f: string, removed: long, good_lost: long, toxic_lost: long>>"
    counted = spark.read.schema(f"part string, state string, n long, edges {edges}").parquet(path).select("part", "state", "n", F.inline("edges"))

    weight = [factorial(k) * factorial(len(letters) - 1 - k) for k in range(len(letters))]  # orders that lead through an edge, by the size of its state
    share = F.element_at(F.array(*(F.lit(w).cast("long") for w in weight)), F.length("state") + 1)
    shapley = counted.groupBy("part", "f").agg(F.sum(share * F.col("removed")).alias("shapley"))
    of_filter = of_filter.join(shapley, ["part", "f"])
    steps = spark.createDataFrame([("".join(p), k + 1, "".join(sorted(p[:k])), p[k]) for p in permutations(letters) for k in range(len(letters))], "filter_order string, step int, state string, f string")
    every = of_filter.join(F.broadcast(steps), "f")  # k! * k steps, whatever the rows
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    removed = zero(F.col("removed"))
    return every.join(counted, ["part", "state", "f"], "left").select(
        "part",
        "filter_order",
        "step",
        (zero(F.col("n")) - removed).alias("kept"),
        removed.alias("removed"),
        (F.col("fails") - removed).alias("redundant"),
        F.col("alone").alias("unique_fails"),
        zero(F.col("good_lost")).alias("good_lost"),
        zero(F.col("toxic_lost")).alias("toxic_lost"),
        "shapley",
    )
