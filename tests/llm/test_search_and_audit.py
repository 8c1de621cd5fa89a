"""The searches and the audit against brute force, and their defined results."""

import math
import random
import re
from collections import Counter
from itertools import permutations
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lamina import session
from lamina.llm import annsearch, filteraudit, lexsearch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, most):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    many, every = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item in sorted({i for i, _ in items}):
        wanted = {t for i, text in items if i == item for t in terms(text)}
        found = []
        for d, b in bags:
            m = 10 + 90 * sum(b.values()) * many // every if every else 0
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in wanted if b[t])
            if score > 0:
                found.append((-score, d is not None, d, score))
        out += [(item, k + 1, d, s) for k, (_, _, d, s) in enumerate(sorted(found, key=lambda x: x[:2] + (x[2] or 0,))[:most])]
    return out


def test_lexical_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexsearch, "PIECE_BYTES", 64)
    rng = random.Random(3)
    words = ["Äpfel", "naïve", "a", "b2", "the", "x_y", "中文", "Zed", "q"] + [f"w{k}" for k in range(60)]
    text = lambda n: rng.choice([" ", ", ", "-", "\x00"]).join(rng.choice(words) for _ in range(n))
    docs = [(k, text(rng.choice([1, 5, 40, 400]))) for k in range(300)] + [(1000, None), (1001, ""), (1002, "!?"), (None, text(9)), (7, "zed q"), (7, "zed q")]
    docs += [(2000 + k, "zed the tie") for k in range(30)]
    items = [(1, "Zed, the tie!"), (2, "中文 Äpfel ÄPFEL"), (3, None), (4, "nowhere"), (5, " ".join(words)), (5, "q"), (6, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit(0)).withColumn("ids", F.lit("x")).repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(0))
    for block in (2000, 2):
        monkeypatch.setattr(lexsearch, "BLOCK_ITEMS", block)
        got = lexsearch.search(*lexsearch.index(d), q)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == ranked(docs, items, 10)


def test_a_long_text_is_counted_whole(spark):
    text = "alpha " * 900_000 + "x" * 3_000_000 + " omega"
    d = spark.createDataFrame([(1, text), (2, "omega"), (3, "alpha"), (4, "none")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "omega alpha " + "x" * 3_000_000)], "item_id long, text string")
    assert list(map(tuple, lexsearch.search(*lexsearch.index(d), q).collect())) == ranked([(1, text), (2, "omega"), (3, "alpha"), (4, "none")], [(1, "omega alpha " + "x" * 3_000_000)], 10)


def test_a_shard_is_a_row_group_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(lexsearch, "SHARD_BYTES", 200)
    docs = [(k, f"the w{k % 7} w{k % 11} " * (k % 9 + 1)) for k in range(300)]
    items = [(1, "w3 the"), (2, "w5 w10 w6")]
    shards, many = lexsearch.index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    files = [pq.read_metadata(urlparse(f).path) for f in shards.inputFiles()]
    rows = [f.row_group(k).num_rows for f in files for k in range(f.num_row_groups)]
    assert len(rows) == shards.count() > 50 and set(rows) == {1}
    got = lexsearch.search(shards, many, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == ranked(docs, items, 10)


def test_shards_go_to_python_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(lexsearch, "SHARD_BYTES", 2000)
    monkeypatch.setattr(session, "BATCH_BYTES", 1000, raising=False)
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k, k + 90))) for k in range(100)], "doc_id long, text string").coalesce(1)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in batches)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        shards, _ = lexsearch.index(docs)
        rows = [r["n"] for r in shards.mapInArrow(sizes, "n long").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert len(rows) > 20 and max(rows) == 1


def test_lexical_search_of_empty_tables(spark):
    d, q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexsearch.search(*lexsearch.index(d), q).count() == 0
    assert lexsearch.search(*lexsearch.index(q.select(F.col("item_id").alias("doc_id"), "text")), q.limit(0)).count() == 0


def test_ties_at_the_end_of_a_selection_are_kept():
    score, ids = np.array([5, 5, 5, 0, 9, 5], np.int64), np.array([9, 3, 7, 1, 8, 2])
    assert lexsearch.best_of(score, ids, 3).tolist() == [4, 5, 1]


def test_measures_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aB é\t中$|\n ") for _ in range(n)) for n in (0, 1, 7, 50, 3000, 0, 200, 9000)] + ["x" * 500, " " * 300]
    for size in (1 << 20, 100, 17):
        monkeypatch.setattr(filteraudit, "PIECE_BYTES", size)
        got = filteraudit.measured(pa.array(texts, pa.large_string()))
        words = [SPACE.findall(t) for t in texts]
        assert got["words"].tolist() == [len(w) for w in words]
        assert got["different"].tolist() == [len(set(w)) for w in words]
        assert got["capitals"].tolist() == [sum("A" <= c <= "Z" for c in t) for t in texts]
        assert got["points"].tolist() == [len(t) for t in texts]
        assert [x > 0 for x in got["marks"].tolist()] == [any(c in "#$%&*|" for c in t) for t in texts]


def test_audit_equals_each_order_applied_in_turn(spark):
    rng = random.Random(8)
    docs = [(rng.randrange(60), rng.choice(["a b c", "A B", "# x", "w " * 250, " ".join(f"v{j}" for j in range(210)), None, ""]), rng.choice(["s", "t", None])) for _ in range(120)] + [(None, "a b c", "n")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("part", F.lit(1)).withColumn("A", F.lit(2))
    got = filteraudit.audit(filteraudit.judged_rows(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), "ABCDE")
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    says = lambda i, c: i is not None and any(r[0] == i and r[c] == 1 for r in labels)

    def failing(i, t):
        t = t or ""
        w = SPACE.findall(t)
        yield from (x for x, on in (("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)), ("D", any(c in "#$%&*|" for c in t)), ("E", i is not None and least[t] < i)) if on)

    rows = [(p or "", set(failing(i, t)), says(i, 1), says(i, 2)) for i, t, p in docs]
    want, removals = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                fails = [r for r in rows if r[0] == part and f in r[1]]
                want[part, "".join(order), k + 1] = [len(left), len(gone), len(fails) - len(gone), sum(r[1] == {f} for r in fails), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                removals[part, f] += len(gone)
    found = got.collect()
    assert len(found) == len(want) == 600 * len({r[0] for r in rows})
    for r in found:
        assert [*r[3:9]] == want[r["part"], r["filter_order"], r["step"]]
        assert r["shapley"] == removals[r["part"], r["filter_order"][r["step"] - 1]]


def test_audit_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filteraudit.audit(filteraudit.judged_rows(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")), "ABCDE").count() == 0


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return (centres[rng.integers(0, 12, n)] + 0.6 * rng.normal(size=(n, dim))) * rng.uniform(0.5, 1.5, (n, 1))


def brute(rows, queries, most):
    out = {}
    for i, v in rows:
        if i in queries:
            out[i] = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in rows if j != i))[:most]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_nearest_of_copies_ties_and_invalid_vectors(spark, monkeypatch, small):
    if small:  # more tiles than one
        for name, value in (("LEAF", 4), ("BRANCH", 3), ("CELL_ROWS", 16), ("CELL_QUERIES", 8), ("SAMPLE", 100)):
            monkeypatch.setattr(annsearch, name, value)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors(150, 6, 1))]
    rows += [(k, rows[3][1]) for k in range(200, 300)] + [(k, [-x for x in rows[3][1]]) for k in range(300, 305)]
    bad = [(900, None), (920, [0.0] * 6), (940, [float("nan")] + [1.0] * 5), (960, [None] + [1.0] * 5), (980, [float("inf")] + [1.0] * 5), (1000, [1.0] * 5), (1020, []), (None, [1.0] * 6), (200, rows[3][1])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("leaf", F.lit("x"))
    got = annsearch.nearest(table, F.col("vec_id") % 20 == 0, 5, recall=1.0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    truth = brute(rows, {i for i, _ in rows if i % 20 == 0}, 5)
    found = {}
    for r in sorted(got.collect()):
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert found.keys() == truth.keys()
    hits = 0
    for q, near in found.items():
        assert [x[0] for x in near] == list(range(1, 6)) and [(-s, i) for _, i, s in near] == sorted((-s, i) for _, i, s in near)
        if q in range(200, 300):
            hits += len({i for _, i, _ in near} & {j for _, j in truth[q]})
        for _, i, s in near:
            assert math.isclose(s, sum(a * b for a, b in zip(dict(rows)[q], dict(rows)[i], strict=True)), rel_tol=1e-12)
    assert hits == 25  # copies are found by their smallest ids


def test_recall_of_the_tree(spark):
    rows = [(k, v.tolist()) for k, v in enumerate(vectors(3000, 16, 2))]
    got = annsearch.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)
    x = np.array([v for _, v in rows])
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    found = got.toPandas().groupby("query_id")["vec_id"].apply(set)
    assert len(found) == 150 and got.count() == 3000
    assert sum(len(set(np.argsort(-score[q])[:20].tolist()) & s) for q, s in found.items()) / 3000 >= 0.93


def test_few_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    near = lambda rows: sorted(map(tuple, annsearch.nearest(spark.createDataFrame(rows, kind), F.col("vec_id") % 20 == 0).collect()))
    assert near([]) == [] == near([(20, [1.0, 2.0])]) == near([(21, [1.0]), (22, [2.0])])
    assert near([(20, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])]) == [(20, 1, 1, 1.0), (20, 2, 2, 1.0)]


def test_audit_holds_no_plan_of_all_its_states(spark):
    rows = spark.createDataFrame([("p", True, False, k % 2 == 0, k % 3 == 0, k % 5 == 0) for k in range(30)], "part string, good boolean, toxic boolean, A boolean, B boolean, C boolean")
    got = filteraudit.audit(rows, "ABC")
    assert got._jdf.queryExecution().executedPlan().toString().count("InMemoryTableScan") == 0
    want = {("ABC", 1): 15, ("ABC", 2): 5, ("ABC", 3): 2, ("CBA", 1): 6, ("CBA", 2): 8, ("CBA", 3): 8}
    assert {(r["filter_order"], r["step"]): r["removed"] for r in got.collect() if r["filter_order"] in ("ABC", "CBA")} == want
    assert not spark.sparkContext._jsc.getPersistentRDDs()
