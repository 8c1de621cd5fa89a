"""Packing of tokenised documents into sequences of fixed capacity, by linear grouping and best fit.

The plan is made from the histogram of piece lengths alone, so its size depends on the capacity and
not on the number of documents: large lengths are rounded up within groups of equal cardinality,
the few sizes left are packed optimally by configurations (a linear programme with column
generation), the actual lengths take the places of the rounded ones, and what remains, large
leftovers first and then the small lengths, goes by best fit into the gaps. A run of the plan
stands for many sequences of one layout. Pieces find their place from their rank among the pieces
of equal length, counted without bringing any length's pieces together.

Defined results: null text counts as empty; an empty document is its end id alone; only documents
longer than the capacity are cut; repeated rows are packed once each; ties of equal length are
placed in the order of id and piece; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm import bpe
from lamina.session import cut, text_batches

#: Shares of the capacity above which lengths are large; the plan with fewest sequences is taken.
LARGE = (1 / 3, 1 / 4.5, 1 / 2)
#: Groups that large lengths are rounded in.
GROUPS = 64
#: Rows that a bucket of pieces has about; ranks are counted bucket by bucket.
BUCKET_ROWS = 100_000


@dataclass
class Plan:
    """For places sorted by (length, first rank): the first sequence, and the offset in it."""

    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int
    runs: list = field(default_factory=list)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, by length and rank among equals."""
        k = (length.astype(np.int64) << 44) + rank
        at = np.searchsorted(self.key, k, "right") - 1
        return self.sequence[at] + k - self.key[at], self.offset[at]


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """Numbers of each size, fitting the capacity, of greatest total value."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fit = sizes <= c
        gain = np.where(fit, best[np.where(fit, c - sizes, 0)] + values, -1.0)
        k = int(gain.argmax())
        best[c], pick[c] = (gain[k], k) if gain[k] > best[c - 1] else (best[c - 1], -1)
    out, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
            continue
        out[pick[c]] += 1
        c -= int(sizes[pick[c]])
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[int, np.ndarray]]:
    """(whole number of sequences, pieces of each size in one) that cover about the demand with fewest sequences."""
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column = _knapsack(sizes, price, capacity).astype(float)
        if price @ column <= 1 + 1e-7:
            break
        x, d = np.linalg.solve(basis, np.stack((demand, column), 1)).T
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.solve(basis, demand.astype(float))
    return [(int(n), basis[:, k].round().astype(np.int64)) for k, v in enumerate(x) if (n := np.floor(v + 1e-6)) >= 1]


def best_plan(histogram: dict[int, int], capacity: int, larges: tuple[float, ...] = LARGE, groups: int = GROUPS) -> Plan:
    """The plan of fewest sequences among those for the given bounds of large lengths; the first that needs no more than any must is taken at once."""
    best, least = None, -(-sum(x * n for x, n in histogram.items()) // capacity)
    for large in larges:
        plan = make_plan(histogram, capacity, large, groups)
        if best is None or plan.n_sequences < best.n_sequences:
            best = plan
        if best.n_sequences <= least:
            break
    return best


def make_plan(histogram: dict[int, int], capacity: int, large: float, groups: int = GROUPS) -> Plan:
    """The plan for so many pieces of each length (1 to ``capacity``)."""
    runs: list[tuple[int, tuple[tuple[int, int], ...], int]] = []  # sequences, (length, copies) in order, room left
    left = {length: n for length, n in histogram.items() if n > 0}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError("a length is outside 1 to the capacity")
    big = sorted((x for x in left if x > large * capacity), reverse=True)
    total = sum(left[x] for x in big)
    if total:
        queues: list[list[list[int]]] = []
        per, filled = -(-total // groups), 0
        for x in big:  # a group's rounded size is its first length
            n = left.pop(x)
            while n:
                if filled % per == 0:
                    queues.append([])
                take = min(n, per - filled % per)
                queues[-1].append([x, take])
                n, filled = n - take, filled + take
        by_size: dict[int, list[list[int]]] = {}
        for q in queues:
            by_size.setdefault(q[0][0], []).extend(q)
        sizes = np.array(sorted(by_size, reverse=True))
        demand = np.array([sum(n for _, n in by_size[s]) for s in sizes.tolist()])
        for count, counts in configurations(sizes, demand, capacity):
            runs += _substitute(count, [(by_size[int(s)], int(n)) for s, n in zip(sizes, counts, strict=True) if n], capacity)
        for q in by_size.values():
            for x, n in q:
                if n:
                    left[x] = left.get(x, 0) + n
    room: dict[int, list[int]] = {}
    rooms: list[int] = []

    def opened(k: int) -> None:
        r = runs[k][2]
        if r > 0:
            if r not in room:
                room[r] = []
                bisect.insort(rooms, r)
            room[r].append(k)

    for k in range(len(runs)):
        opened(k)
    for x in sorted(left, reverse=True):
        n = left[x]
        while n:
            at = bisect.bisect_left(rooms, x)
            if at < len(rooms):
                r = rooms[at]
                k = room[r].pop()
                if not room[r]:
                    del room[r], rooms[at]
                count, parts, _ = runs[k]
            else:
                k, count, parts, r = -1, n, (), capacity
            q = r // x
            used, copies = (min(count, n // q), q) if n >= q else (1, n)
            n -= used * copies
            runs.append((used, (*parts, (x, copies)), r - copies * x))
            opened(len(runs) - 1)
            if k >= 0:
                runs[k] = (count - used, parts, r)
                if count > used:
                    opened(k)
    runs = [r for r in runs if r[0]]
    key, sequence, offset, first, given = [], [], [], 0, dict.fromkeys(histogram, 0)
    for count, parts, _ in runs:
        o = 0
        for x, copies in parts:
            for _ in range(copies):
                key.append((x << 44) + given[x])
                sequence.append(first)
                offset.append(o)
                given[x] += count
                o += x
        first += count
    order = np.argsort(np.array(key, np.int64), kind="stable") if key else np.zeros(0, np.int64)
    key, sequence, offset = (np.array(a, np.int64)[order] for a in (key, sequence, offset))
    return Plan(key, sequence, offset, first, runs)


def _substitute(count: int, slots: list[tuple[list[list[int]], int]], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...], int]]:
    """``count`` sequences of one configuration with actual lengths from the groups' queues; each slot is a queue and a number of places."""
    out = []
    while count:
        times, parts = count, []
        for queue, n in slots:
            while queue and not queue[0][1]:
                queue.pop(0)
            if queue and queue[0][1] >= n:
                parts.append([queue[0], n])
                times = min(times, queue[0][1] // n)
            else:
                for entry in queue:
                    if n and entry[1]:
                        take = min(n, entry[1])
                        parts.append([entry, take])
                        times, n = 1, n - take
        if not parts:
            break
        for entry, n in parts:
            entry[1] -= n * times
        out.append((times, tuple((entry[0], n) for entry, n in parts), capacity - sum(entry[0] * n for entry, n in parts)))
        count -= times
    return out


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Documents as token pieces: ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``."""
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, offsets in bpe.encoded(batches, path, id_col, text_col):
            ids = np.insert(ids, offsets[1:], end_id)
            ends = offsets[1:] + np.arange(1, len(offsets))
            sizes = np.diff(np.concatenate(([0], ends)))
            n = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, sizes[doc] - start)
            at = ((ends - sizes)[doc] + start).tolist()
            cols = {
                id_col: keys.take(pa.array(doc)),
                "piece": pa.array(piece.astype(np.int32)),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array([bpe.crc32_le(ids[a : a + k]) for a, k in zip(at, length.tolist(), strict=True)], pa.int64()),
            }
            if with_ids:
                cols["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_pydict(cols)

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(items: DataFrame, capacity: int, order: list[str], length_col: str = "length") -> DataFrame:
    """Rows with ``sequence_id`` and ``offset`` added. ``items`` is read three times: pass a table or a cut frame."""
    counted = items.agg(F.count("*").alias("n")).first()["n"]
    buckets = max(64, -(-counted // BUCKET_ROWS))
    items = items.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = items.groupBy("_b", F.col(length_col).alias("_l")).agg(F.count("*").alias("_n"))
    histogram = {r["_l"]: r["n"] for r in sizes.groupBy("_l").agg(F.sum("_n").alias("n")).collect()}  # a row for each length at most
    plan = best_plan(histogram, capacity)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_l").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select("_b", "_l", before.alias("_first"))
    rank = F.row_number().over(Window.partitionBy("_b", length_col).orderBy(*order))
    ranked = items.withColumn("_r", rank)
    ranked = ranked.join(first, (ranked["_b"] == first["_b"]) & (ranked[length_col] == first["_l"])).select(*[ranked[c] for c in items.columns if c != "_b"], (F.col("_first") + F.col("_r") - 1).alias("_rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank") + ", sequence_id long, `offset` long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.place(np.asarray(batch.column(length_col)), np.asarray(batch.column("_rank")))
            kept = {n: batch.column(n) for n in batch.schema.names if n != "_rank"}
            yield pa.RecordBatch.from_pydict(kept | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """All documents as pieces with their place in sequences of ``capacity`` tokens."""
    return pack(cut(pieces(docs, path, capacity, end_id, id_col, text_col, with_ids)), capacity, [id_col, "piece", "start", "ids_crc32"])
