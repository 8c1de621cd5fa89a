"""Nearest neighbours by a hierarchical k-means tree, searched best bin first.

The measure is the inner product. To search by distance, a vector x gets one more place, the root of
M**2 - |x|**2 for the largest norm M, and a query a 0 there: the nearest are then those of the largest
inner product. The tree is fit by k-means, node by node, on about ``SAMPLE`` different vectors chosen by
a hash; every vector is put into the leaf that it reaches on its way down. A query goes through the tree
with a priority queue of nodes by the distance of their centres: the nearest node is opened next, and a
leaf taken out is visited. How many leaves are visited is widened until, on about ``TRIED`` queries chosen
by a hash and searched by brute force over all rows, ``RECALL`` of the true neighbours lie in visited
leaves; each query goes on until its leaves hold enough vectors.

Leaves that follow one another in the tree make cells of about ``CELL_ROWS`` vectors; a leaf of more has
several parts, and so have a cell's queries, ``CELL_QUERIES`` each. Vectors and queries meet by (cell, part
of vectors, part of queries): each such tile is one sorted run of rows, the vectors first, so a task
holds the vectors of one tile and a batch of queries. Copies don't make a cell grow: equal vectors are
one class that carries as many of its smallest ids as a query may need, and equal queries are searched once.

Scores are sums of products of the original vectors in double precision, each pair's computed in the same
order. Bounds that don't grow with the rows: the sample, the tree (a centre a node, one leaf for
``LEAF`` sampled vectors), the tried queries, a count for each leaf and cell. Beyond ``SAMPLE / LEAF`` leaves
the leaves grow with the rows, and are dealt over more tiles.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
rows with a null id, nor vectors of another length than the most frequent one (of equally frequent lengths the
smallest); of rows that repeat an id the least vector counts; ties go to the smaller id; a query with fewer
candidates gets all; a table with no vectors, or one, gives no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.arrowtext import tidy
from lamina.session import cut, saved

NEAREST, RECALL = 20, 0.97
SAMPLE, TRIED, LEAF, BRANCH = 65_536, 256, 48, 12
CELL_ROWS, CELL_QUERIES = 4096, 4096
#: So many times what is expected may be sampled; more is an error.
MOST = 4


def valid_vectors(table: DataFrame, query: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id``, ``v`` (doubles) and ``q`` (whether it is a query) of the rows that take part, one for each id; saved."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    rows = saved(rows.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == common["d"]) if common else rows


def classes_of(rows: DataFrame, most: int) -> DataFrame:
    """The different vectors ``v``, each with the ``most`` smallest of its ids, in order, and ``c``, the smallest; saved."""
    order = Window.partitionBy("v").orderBy("id")
    few = rows.select("id", "v").withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)  # cut down before the shuffle too
    return saved(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("v", "ids", F.col("ids")[0].alias("c")))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    flat = column.flatten()
    return np.asarray(flat, np.float64).reshape(len(column), -1) if len(flat) else np.zeros((0, 0))


class Tree:
    """Centres by node; a node's children follow one another, and leaves are numbered from left to right."""

    def __init__(self, radius: float, dim: int) -> None:
        self.radius, self.centres, self.first, self.many, self.leaf = radius, [np.zeros(dim + 1)], [0], [0], [-1]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """The vectors with their place more."""
        return np.column_stack((x, np.sqrt(np.maximum(0.0, self.radius**2 - (x * x).sum(1)))))

    def fit(self, x: np.ndarray, seed: int = 7) -> Tree:
        """Splits from the root down until nodes have at most ``LEAF`` vectors, or none that differ."""
        rng, queue = np.random.default_rng(seed), [(0, self.lifted(x))]
        while queue:
            node, part = queue.pop()
            groups = self.split(part, rng) if len(part) > LEAF else []
            if len(groups) < 2:
                continue
            self.first[node], self.many[node] = len(self.centres), len(groups)
            for members in groups:
                queue.append((len(self.centres), part[members]))
                self.centres.append(part[members].mean(0))
                self.first.append(0)
                self.many.append(0)
                self.leaf.append(-1)
        self.centres, self.first, self.many = np.array(self.centres), np.array(self.first), np.array(self.many)
        self.leaf, stack, self.leaves = np.full(len(self.first), -1), [0], 0
        while stack:
            node = stack.pop()
            if self.many[node]:
                stack.extend(range(int(self.first[node] + self.many[node]) - 1, int(self.first[node]) - 1, -1))
            else:
                self.leaf[node], self.leaves = self.leaves, self.leaves + 1
        return self

    @staticmethod
    def split(x: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
        """Members of the groups that k-means makes."""
        centres = x[rng.choice(len(x), min(BRANCH, len(x)), replace=False)]
        for _ in range(10):
            own = (((centres * centres).sum(1))[None] - 2 * x @ centres.T).argmin(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            count = np.bincount(own, minlength=len(centres))
            centres = sums[count > 0] / count[count > 0][:, None]
        own = ((centres * centres).sum(1)[None] - 2 * x @ centres.T).argmin(1)
        return [m for k in range(len(centres)) if len(m := np.flatnonzero(own == k))]

    def put(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        x, node = self.lifted(x), np.zeros(len(x), np.int64)
        going = np.flatnonzero(self.many[node])
        while len(going):
            for n in np.unique(node[going]).tolist():
                here = going[node[going] == n]
                c = self.centres[self.first[n] : self.first[n] + self.many[n]]
                node[here] = self.first[n] + ((c * c).sum(1)[None] - 2 * x[here] @ c.T).argmin(1)
            going = going[self.many[node[going]] > 0]
        return self.leaf[node]

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in the order in which the priority queue gives them."""
        q, heap = np.append(q, 0.0), [(0.0, 0)]
        while heap:
            _, n = heapq.heappop(heap)
            if not self.many[n]:
                yield int(self.leaf[n])
                continue
            a = int(self.first[n])
            d = self.centres[a : a + self.many[n]] - q
            for k, far in enumerate((d * d).sum(1).tolist()):
                heapq.heappush(heap, (far, a + k))


def best_pairs(q: np.ndarray, x: np.ndarray, ids: list[np.ndarray], most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each query the ``most`` (id, score) of the highest score among the classes, ties by id."""
    if not len(x):
        return [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
    rough, out = q @ x.T, []
    for k, row in enumerate(rough):
        at = np.arange(len(x))
        if len(at) > most:  # a class has one id at least; what rounding may have put behind the last is kept
            last = row[np.argpartition(-row, most - 1)[:most]].min()
            at = np.flatnonzero(row >= last - 1e-9 * (1.0 + abs(last)))
        score = np.repeat(np.einsum("j,ij->i", q[k], x[at]), [len(ids[a]) for a in at])
        own = np.concatenate([ids[a] for a in at])
        order = np.lexsort((own, -score))[:most]
        out.append((own[order], score[order]))
    return out


def _brute(classes: DataFrame, tried: list[tuple[int, np.ndarray]], most: int) -> dict[int, list[int]]:
    """The leaves of the ``most`` nearest of each tried query, over all classes."""
    q = np.array([v for _, v in tried])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids, leaf = matrix(batch.column("v")), batch.column("ids").to_pylist(), np.asarray(batch.column("leaf"))
            own = dict(zip([i for c in ids for i in c], np.repeat(leaf, [len(c) for c in ids]).tolist(), strict=True))
            found = best_pairs(q, x, [np.array(c) for c in ids], most)
            size = [len(i) for i, _ in found]
            flat = np.concatenate([i for i, _ in found]) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.repeat(np.arange(len(q)), size), pa.int32()), "id": pa.array(flat, pa.int64()), "score": pa.array(np.concatenate([s for _, s in found])), "leaf": pa.array([own[i] for i in flat.tolist()], pa.int32())})

    order = Window.partitionBy("k").orderBy(F.desc("score"), "id")
    near = classes.select("v", "ids", "leaf").mapInArrow(run, "k int, id long, score double, leaf int")
    out: dict[int, list[int]] = {k: [] for k in range(len(tried))}
    for r in near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("k", "leaf").collect():  # ``most`` for each tried query
        out[r["k"]].append(r["leaf"])
    return out


def widened(tree: Tree, tried: list[tuple[int, np.ndarray]], truth: dict[int, list[int]], recall: float) -> int:
    """The fewest leaves a query must visit so that this share of the true neighbours is in them: visits are doubled until it is reached, then narrowed."""
    place = np.zeros(tree.leaves, np.int64)
    at: list[int] = []
    for k, (_, v) in enumerate(tried):
        for n, leaf in enumerate(tree.visits(v)):
            place[leaf] = n + 1
        at += place[truth[k]].tolist()
    need, reached, wide = np.array(at), lambda n: (need <= n).mean() >= recall, 1
    while wide < tree.leaves and not reached(wide):
        wide *= 2
    low, high = wide // 2, min(wide, tree.leaves)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if reached(middle) else (middle, high)
    return high


def nearest(table: DataFrame, query: Column, most: int = NEAREST, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Of each row that ``query`` holds for its ``most`` nearest others: ``query_id``, ``rank`` from 1, the id and ``score``."""
    spark, some = table.sparkSession, most + 1  # a query's own id may be among them
    rows = valid_vectors(table, query, id_col, vector_col)
    classes = classes_of(rows, some)
    asked = rows.where("q").select(F.col("id").alias("query_id"), "v")
    askers = saved(asked.groupBy("v").agg(F.min("query_id").alias("c")))  # the different queries
    empty = spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    size = classes.agg(F.count("*").alias("n"), F.max(F.sqrt(norm)).alias("m"), F.max(F.size("v")).alias("d")).first()
    queries = askers.count()
    if not size["n"] or not queries:
        return empty
    chosen = lambda df, many, total, salt: df.where(F.pmod(F.xxhash64("c", F.lit(salt)), F.lit(1 << 30)) < min(1.0, many / total) * (1 << 30))

    def drawn(df: DataFrame, many: int, total: int, salt: int) -> list[tuple[int, np.ndarray]]:
        got = chosen(df.select("c", "v"), many, total, salt).toArrow()
        if len(got) > MOST * many:
            raise RuntimeError(f"{len(got)} vectors were sampled where about {many} were expected")
        one = got.combine_chunks()
        order = np.argsort(np.asarray(one.column("c")))
        return list(zip(np.asarray(one.column("c"))[order].tolist(), matrix(one.column("v").combine_chunks())[order], strict=True)) if len(got) else []

    sample = drawn(classes, SAMPLE, size["n"], 1)
    tree = Tree(size["m"], size["d"]).fit(np.array([v for _, v in sample]).reshape(-1, size["d"]))

    @F.arrow_udf("int")
    def leaf_of(v: pa.Array) -> pa.Array:
        return pa.array(tree.put(matrix(v)), pa.int32())

    classes = saved(classes.withColumn("leaf", leaf_of("v")))
    sizes = {r["leaf"]: r for r in classes.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect()}  # a row for each leaf
    tried = drawn(askers, TRIED, queries, 2) or drawn(askers, queries, queries, 2)
    least = widened(tree, tried, _brute(classes, tried, some), recall)
    held = np.array([sizes[k]["ids"] if k in sizes else 0 for k in range(tree.leaves)])

    cell, parts, room, number = np.zeros(tree.leaves, np.int64), [1], 0, 0
    for k in range(tree.leaves):
        n = sizes[k]["n"] if k in sizes else 0
        if room and room + n > CELL_ROWS:
            number, room = number + 1, 0
            parts.append(1)
        cell[k], room = number, room + n
        parts[number] = -(-room // CELL_ROWS) if room else 1

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, list[int]]] = []
            for k, q in enumerate(matrix(batch.column("v"))):
                enough, seen, mine = 0, 0, {}
                for leaf in tree.visits(q):
                    if held[leaf]:
                        mine.setdefault(int(cell[leaf]), []).append(leaf)
                    enough, seen = enough + int(held[leaf]), seen + 1
                    if seen >= least and enough >= some:
                        break
                out += [(k, c, leaves) for c, leaves in mine.items()]
            take = pa.array([k for k, _, _ in out], pa.int64())
            yield pa.RecordBatch.from_pydict({"c": batch.column("c").take(take), "v": batch.column("v").take(take), "cell": pa.array([c for _, c, _ in out], pa.int32()), "leaves": pa.array([x for _, _, x in out], pa.list_(pa.int32()))})

    visits = saved(askers.select("c", "v").mapInArrow(visiting, "c long, v array<double>, cell int, leaves array<int>"))
    shares = {r["cell"]: -(-r["count"] // CELL_QUERIES) for r in visits.groupBy("cell").count().collect()}  # a row for each cell
    cells = spark.createDataFrame([(k, parts[k], shares.get(k, 0)) for k in range(len(parts))], "cell int, parts int, shares int")
    leaf_cells = spark.createDataFrame([(k, int(c)) for k, c in enumerate(cell)], "leaf int, cell int")
    place = lambda n: F.pmod(F.xxhash64("c", F.lit(3)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held_in = classes.join(F.broadcast(leaf_cells), "leaf").join(F.broadcast(cells.where("shares > 0")), "cell")
    held_in = held_in.select("cell", place(F.col("parts")).alias("p"), every(F.col("shares")).alias("s"), F.lit(0).alias("kind"), "c", "v", "ids", F.array("leaf").alias("leaves"))
    asking = visits.join(F.broadcast(cells), "cell")
    asking = asking.select("cell", every(F.col("parts")).alias("p"), place(F.col("shares")).alias("s"), F.lit(1).alias("kind"), "c", "v", F.array().cast("array<long>").alias("ids"), "leaves")
    tile = ["cell", "p", "s"]
    met = held_in.union(asking).repartition(*tile).sortWithinPartitions(*tile, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, x, leaf, ids = None, [], [], []
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)) for c in (*tile, "kind")], 1)
            bounds = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if a == b:
                    continue
                part, here = batch.slice(a, b - a), tuple(keys[a][:3].tolist())
                if here != key:
                    key, x, leaf, ids = here, [], [], []
                if keys[a][3] == 0:
                    x.append(matrix(part.column("v")))
                    leaf.append(np.asarray(part.column("leaves").flatten()))
                    ids += [np.array(i) for i in part.column("ids").to_pylist()]
                elif x:
                    x, leaf = [np.concatenate(x)], [np.concatenate(leaf)]
                    yield from answers(part, x[0], leaf[0], ids)

    def answers(asks: pa.RecordBatch, x: np.ndarray, leaf: np.ndarray, ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        q, c, wanted = matrix(asks.column("v")), np.asarray(asks.column("c")), asks.column("leaves").to_pylist()
        order = np.argsort(leaf, kind="stable")
        ordered = leaf[order]
        out = []
        for k, leaves in enumerate(wanted):
            lo, hi = np.searchsorted(ordered, leaves), np.searchsorted(ordered, leaves, "right")
            mine = np.concatenate([order[a:b] for a, b in zip(lo, hi, strict=True)])
            out.append(best_pairs(q[k : k + 1], x[mine], [ids[m] for m in mine], some)[0])
        size = [len(i) for i, _ in out]
        yield pa.RecordBatch.from_pydict({"c": pa.array(np.repeat(c, size), pa.int64()), "id": pa.array(np.concatenate([i for i, _ in out]), pa.int64()), "score": pa.array(np.concatenate([s for _, s in out]), pa.float64())})
        tidy()

    order = Window.partitionBy("c").orderBy(F.desc("score"), "id")
    found = met.mapInArrow(run, "c long, id long, score double").withColumn("r", F.row_number().over(order)).where(F.col("r") <= some)
    found = cut(found.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("near")))
    named = asked.join(askers, "v").select("query_id", "c")
    near = named.join(found, "c").select("query_id", F.posexplode(F.slice(F.filter("near", lambda n: n["id"] != F.col("query_id")), 1, most)).alias("k", "n"))
    return near.select("query_id", (F.col("k") + 1).cast("int").alias("rank"), F.col("n.id").alias(id_col), F.col("n.score").alias("score"))
