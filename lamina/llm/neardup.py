"""Near duplicates by SuperMinHash, banding, verification and union-find.

Every text's set of word shingles gets a SuperMinHash signature. Texts of equal sets are one class
from the start, known by the least id. Signatures are cut into bands; texts of different sets that
agree in a whole band share a bucket. In each bucket every member is compared with the least one;
confirmed links make components. Buckets whose members then lie in one component are done; in the
others members of different components are compared by signature, bucket by bucket: those outside
the bucket's largest component meet each other and that component's, in pairs of blocks, so a bucket
of any size takes the same way. Members of promising pairs come together once more, in the first
bucket that a pair shares, with their full sets: pairs are confirmed in the order of promise, links
join components at once, and pairs that are joined by then need no confirmation. So a large group
costs few confirmations where it holds together, and no pair leaves its task but as a link. With 40
bands of 6 a link of similarity 0.8 is overlooked with a probability of about 5e-6, and signatures
of 240 places that agree in fewer than 68 of 100 places with one of about 2e-6.

Defined results: a text that is null or has no word has an empty set and is linked with nothing; a
text with fewer words than a shingle has one shingle of all its words; rows that repeat an id are
one node of the graph and keep their own set sizes; a null id is linked with nothing, its component
is null and it is kept; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.arrowtext import mix, slices, texts, tidy
from lamina.llm.shingles import shingle_sets, superminhash
from lamina.operators.graph import least_of_component as components
from lamina.session import cut, saved, text_batches

BANDS, ROWS = 40, 6
#: Share of equal signature places under which a pair can't reach the similarity asked for.
SLACK = 0.12
#: Members of a bucket that one task compares with one another.
BLOCK_MEMBERS = 256
#: Pairs confirmed before components are looked at again.
CONFIRMED_AT_ONCE = 256


def sketches(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row: ``id``, ``n`` shingles, two 64-bit sums that stand for the set, and the signature's low bytes, ``sig``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, array in slices(batch, "t", 2 << 20):
                items, offsets = shingle_sets(array, shingle)
                n = np.diff(offsets)
                full = n > 0
                sums = np.zeros((2, len(n)), np.uint64)
                if len(items):
                    for k, seed in enumerate((0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)):
                        sums[k][full] = np.add.reduceat(mix(items ^ np.uint64(seed)), offsets[:-1][full])
                signature = superminhash(items, offsets, BANDS * ROWS)
                low = mix(signature).astype(np.uint8)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": rows.column("id").cast(pa.int64()),
                        "n": pa.array(n),
                        "s1": pa.array(sums[0].astype(np.int64)),
                        "s2": pa.array(sums[1].astype(np.int64)),
                        "sig": pa.array([r.tobytes() for r in low], pa.binary()),
                    }
                )

    text_batches(docs.sparkSession)
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return kept.mapInArrow(run, "id long, n long, s1 long, s2 long, sig binary")


def _agreement(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Equal bytes of binary values of BANDS * ROWS bytes each."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in (a, b))
    return (x == y).sum(1)


def promising(pairs: DataFrame, sigs: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose signatures don't rule the similarity out."""
    least = int((similarity - SLACK) * BANDS * ROWS)

    @F.arrow_udf("int")
    def agree(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(_agreement(a, b).astype(np.int32))

    one = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na"))
    two = sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb"))
    both = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-6)
    return both.where(agree("sa", "sb") >= least).select("a", "b").distinct()


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a``, ``b`` and ``linked``: whether 100 times the shared shingles reach ``percent`` times all of the pair's."""
    text = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    need = cut(pairs.select("a").union(pairs.select("b")).distinct())
    text = saved(text.join(need, text["i"] == need["a"], "left_semi").where("i is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, array in slices(batch, "ta", 1 << 20):
                x, ox = shingle_sets(array, shingle)
                out = np.zeros(rows.num_rows, bool)
                done = 0
                for part, other in slices(rows, "tb", 4 << 20):
                    y, oy = shingle_sets(other, shingle)
                    for k in range(part.num_rows):
                        p, q = x[ox[done + k] : ox[done + k + 1]], y[oy[k] : oy[k + 1]]
                        at = np.searchsorted(q, p)
                        shared = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) and len(p) else 0
                        out[done + k] = shared > 0 and 100 * shared >= percent * (len(p) + len(q) - shared)
                    done += part.num_rows
                yield pa.RecordBatch.from_pydict({"a": rows.column("a"), "b": rows.column("b"), "linked": pa.array(out)})

    both = pairs.join(text.select(F.col("i").alias("a"), F.col("t").alias("ta")), "a").join(text.select(F.col("i").alias("b"), F.col("t").alias("tb")), "b")
    return both.mapInArrow(run, "a long, b long, linked boolean")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole groups, and where each group starts and ends, from batches sorted by the keys."""
    rest = None
    change = lambda c: np.concatenate(([True], np.any([x[1:] != x[:-1] for x in c], axis=0)))
    for batch in batches:
        t = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, t]) if rest is not None else t
        last = int(np.flatnonzero(change([np.asarray(rest.column(k)) for k in keys]))[-1]) if len(rest) else 0
        if last:
            whole, rest = rest.slice(0, last).combine_chunks(), rest.slice(last)
            start = np.flatnonzero(change([np.asarray(whole.column(k)) for k in keys]))
            yield whole, start, np.append(start[1:], len(whole))
    if rest is not None and len(rest):
        yield rest.combine_chunks(), np.zeros(1, np.int64), np.array([len(rest)])


def _promising(t: pa.Table, start: np.ndarray, end: np.ndarray, similarity: float) -> Iterator[np.ndarray]:
    """Rows (first, second, agreement) of promising pairs of different components inside the groups, each in the first bucket that the pair shares."""
    least = int((similarity - SLACK) * BANDS * ROWS)
    band, i, j, own, ids, comp, n = (np.asarray(t.column(c)) for c in ("b", "i", "j", "block", "id", "comp", "n"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
    group_end = np.repeat(end, end - start)
    at = np.arange(len(ids))
    for d in range(1, int((end - start).max()) if len(start) else 0):
        at = at[at + d < group_end[at]]
        x, y = at, at + d
        on = (comp[x] != comp[y]) & (ids[x] != ids[y]) & (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-6) & ((own[x] != own[y]) | (i[x] == j[x]))
        x, y = x[on], y[on]
        for a in range(0, len(x), 20_000):
            u, v = x[a : a + 20_000], y[a : a + 20_000]
            same = sig[u] == sig[v]
            agree = same.sum(1)
            good = agree >= least
            u, v, agree = u[good], v[good], agree[good]
            mine = same[good].reshape(-1, BANDS, ROWS).all(2).argmax(1) == band[u]
            yield np.stack((u[mine], v[mine], agree[mine]))


def _unsettled(members: DataFrame, similarity: float) -> DataFrame:
    """Of the members (k, b, i, j, block, id, comp, n, sig) of groups (k, i, j) those in a promising pair of different components that meets here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start, end in _groups(batches, ["k", "i", "j"]):
            hit = np.zeros(len(t), bool)
            for u, v, _ in _promising(t, start, end, similarity):
                hit[u] = hit[v] = True
            yield from t.select(["k", "b", "i", "j", "block", "id", "comp"]).filter(pa.array(hit)).to_batches()
        tidy()

    members = members.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    return members.mapInArrow(run, "k long, b int, i int, j int, block int, id long, comp long")


def _confirmed(t: pa.Table, pairs: np.ndarray, shingle: int, percent: int) -> list[tuple[int, int]]:
    """Links among the pairs of one group that join components, on the full sets."""
    ids, comp = np.asarray(t.column("id")), np.unique(np.asarray(t.column("comp")), return_inverse=True)[1]
    sets = []
    for _, array in slices(pa.RecordBatch.from_arrays([texts(t.column("t"))], ["t"]), "t"):
        items, at = shingle_sets(array, shingle)
        sets += [items[a:b] for a, b in zip(at, at[1:], strict=False)]
    order = np.argsort(-pairs[2], kind="stable")
    u, v, out = pairs[0][order], pairs[1][order], []
    while len(u):
        for x, y in zip(u[:CONFIRMED_AT_ONCE].tolist(), v[:CONFIRMED_AT_ONCE].tolist(), strict=True):
            if comp[x] != comp[y]:
                p, q = sets[x], sets[y]
                at = np.searchsorted(q, p)
                shared = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                if 100 * shared >= percent * (len(p) + len(q) - shared):
                    out.append((int(ids[x]), int(ids[y])))
                    comp[comp == comp[y]] = comp[x]
        u, v = u[CONFIRMED_AT_ONCE:], v[CONFIRMED_AT_ONCE:]
        apart = comp[u] != comp[v]
        u, v = u[apart], v[apart]
    return out


def _links_across(members: DataFrame, similarity: float, shingle: int, percent: int) -> DataFrame:
    """Links (u, v) between different components among members (k, b, i, j, block, id, comp, n, sig, t) of the groups (k, i, j); ``t`` is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start, end in _groups(batches, ["k", "i", "j"]):
            for a, b in zip(start.tolist(), end.tolist(), strict=True):
                part = t.slice(a, b - a)
                found = list(_promising(part, np.zeros(1, np.int64), np.array([b - a]), similarity))
                links = _confirmed(part, np.concatenate(found, 1), shingle, percent) if found else []
                if links:
                    yield pa.RecordBatch.from_pydict({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})

    members = members.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    return members.mapInArrow(run, "u long, v long")


def _dealt(placed: DataFrame) -> DataFrame:
    """Members (k, b, id, comp) of the buckets with more than one component, once for each pair of blocks (i, j) that their own ``block`` is in.

    A bucket's largest component has blocks with the numbers from ``minor`` on, all others those
    below; pairs of two blocks of the largest component aren't made, as they have no pair to find.
    """
    sizes = placed.groupBy("k", "comp").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("k").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("c"), F.count("*").alias("m")).where("m > 1")
    in_blocks = lambda n: F.ceil(n / BLOCK_MEMBERS).cast("int")
    sizes = cut(sizes.select("k", F.col("top.comp").alias("top"), in_blocks(F.col("c") - F.col("top.n")).alias("minor"), in_blocks(F.col("top.n")).alias("major")))
    rows = placed.join(sizes, "k")
    block = F.when(F.col("comp") == F.col("top"), F.col("minor") + F.pmod(F.xxhash64("id"), F.col("major"))).otherwise(F.pmod(F.xxhash64("id"), F.col("minor"))).cast("int")
    last = F.when(F.col("comp") == F.col("top"), F.col("minor")).otherwise(F.col("minor") + F.col("major"))
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last - 1)))
    return rows.select("k", "b", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "comp")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row: its id, ``n_shingles``, ``component_id`` (the least id its links reach) and ``kept`` (whether that is its own)."""
    similarity = percent / 100
    every = cut(sketches(docs, shingle, id_col, text_col))
    sets = ["s1", "s2", "n"]
    classes = cut(every.where("n > 0 and id is not null").groupBy(*sets).agg(F.min("id").alias("rep")))
    chosen = cut(every.join(classes, sets).where("id = rep").select("id", "n", "sig"))
    if chosen.count() > classes.count():  # rows that repeat id and set; they are combined before they are shuffled
        chosen = cut(chosen.groupBy("id").agg(F.first("n").alias("n"), F.first("sig").alias("sig")))
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * ROWS + 1, F.lit(ROWS))))
    buckets = chosen.select("id", F.posexplode(band).alias("b", "k"))
    shared = cut(buckets.groupBy("k").agg(F.min("id").alias("p"), F.max("id").alias("q")).where("p < q").drop("q"))
    members = cut(buckets.join(shared, "k").select("k", "b", "id", "p"))

    star = members.where("id != p").select(F.col("p").alias("a"), F.col("id").alias("b")).distinct()
    checked = cut(verified(cut(promising(star, chosen, similarity)), docs, shingle, percent, id_col, text_col))
    edges = lambda pairs: pairs.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = components(edges(checked))

    placed = cut(members.join(labels.withColumnRenamed("u", "id"), "id", "left").select("k", "b", "id", F.coalesce("v", "id").alias("comp")))
    unsettled = cut(_unsettled(_dealt(placed).join(chosen, "id"), similarity))
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id is not null")
    text = saved(text.join(cut(unsettled.select("id").distinct()), "id", "left_semi"))
    labels = components(_links_across(unsettled.join(text, "id").join(chosen, "id"), similarity, shingle, percent).union(labels))

    named = every.join(classes, sets, "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"))
    label = F.coalesce("v", "rep")
    out = named.join(labels.withColumnRenamed("u", "rep"), "rep", "left").select(F.col("id"), "n", label.alias("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
