"""Texts with very many identifiers, and how many identifiers of known contexts are found."""

import math
import random
from collections import Counter
import time

from pyspark.sql import functions as F

from lamina.llm import pii
from tests.llm.test_pii import checked


def test_a_text_of_fifty_thousand_addresses(spark):
    text = " ".join(f"u{k}@corp{k % 7}.org" if k % 2 else f"10.{k % 200}.{k % 90}.{k % 250}, (555) 010-{1000 + k % 9000}" for k in range(50_000))
    began = time.time()
    checked(spark, [(1, text), (2, "a@b.c " * 300)])
    assert time.time() - began < 90
    began = time.time()
    clean = pii.redact(spark.createDataFrame([(1, "a@b.cd and 10.0.0.1; " * 20_000)], "doc_id long, text string")).first()["text"]
    assert clean == "[email] and [ip]; " * 20_000
    assert time.time() - began < 60


def test_sums_along_arrays_of_all_sizes(spark):
    xs = F.sequence(F.lit(1), F.col("n").cast("int"))
    df = spark.createDataFrame([(n,) for n in (1, 2, 255, 256, 257, 512, 700)], "n long").select("n", xs.alias("xs"))
    got = df.select("n", pii.scanned(F.col("xs"), lambda x: x, lambda a, b: a + b, F.lit(0), "int").alias("s")).collect()
    for r in got:
        assert r["s"] == [k * (k + 1) // 2 for k in range(r["n"])]


def test_overlaps_with_base_spans(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        spans = lambda n: sorted((a, a + rng.randint(1, 9)) for a in rng.sample(range(200), n))
        rows.append((k, [(a, 0, b, "v", "c") for a, b in spans(rng.randint(0, 12))], [(a, b, "v", "c") for a, b in spans(rng.randint(1, 40))]))
    df = spark.createDataFrame(rows, "k int, base array<struct<start:int,kind:int,end:int,value:string,context:string>>, spots array<struct<start:int,end:int,value:string,context:string>>")
    for r in df.select("k", pii.apart(F.col("spots"), F.col("base")).alias("free")).collect():
        _, base, spots = rows[r["k"]]
        assert [(s["start"], s["end"]) for s in r["free"]] == [s[:2] for s in spots if not any(b[0] < s[1] and s[0] < b[2] for b in base)]


def test_spans_inside_others_of_their_kind(spark):
    rng = random.Random(4)
    rows = [(k, sorted({(a := rng.randint(0, 30), rng.randint(0, 1), a + rng.randint(1, 12)) for _ in range(rng.randint(1, 25))})) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, s array<struct<start:int,kind:int,end:int>>")
    for r in df.select("k", pii.outermost(F.col("s")).alias("s")).collect():
        spans = rows[r["k"]][1]
        inside = lambda x: any(y != x and y[1] == x[1] and y[0] <= x[0] and x[2] <= y[2] for y in spans)
        assert sorted(map(tuple, r["s"])) == [x for x in spans if not inside(x)]


def test_columns_with_the_names_of_the_spans_survive(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd now", 7, "x", [1]), (2, "none", 8, "y", None)], "doc_id long, text string, _i long, _h string, _s array<int>")
    got = pii.redact(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(1, "mail [email] now", 7, "x", [1]), (2, "none", 8, "y", None)]


def test_unseen_identifiers_of_planted_contexts(spark):
    """Contexts with seeds are planted in the documents of the smallest table; of identifiers that no exact pattern finds, those after the contexts are found, those after other words are left alone."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rng = random.Random(8)
    number = lambda: f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    seeds = [(10_000 + k, f"{rng.choice(docs)[1] or ''}\nreach desk +1 {number()} daily") for k in range(60)]
    unseen = [(20_000 + k, f"{rng.choice(docs)[1] or ''}\nreach desk {number()} daily") for k in range(60)]
    others = [(30_000 + k, f"{rng.choice(docs)[1] or ''}\nserial {rng.choice('abcdef')} {number()} daily") for k in range(60)]
    df = spark.createDataFrame(docs + seeds + unseen + others, "doc_id long, text string")
    got = {r["id"]: r["added"] for r in pii.personal_data(df).where("id >= 10000").collect()}
    last = lambda k, text: any(text[s["start"] :].endswith(" daily") and s["end"] == len(text) - 6 for s in got[k])
    assert sum(last(k, t) for k, t in unseen) / len(unseen) >= 0.95
    assert not any(last(k, t) for k, t in others)


def test_more_seeds_elsewhere_hide_no_pattern(spark):
    """60 identifiers after a planted context are found beside 40,000 seeds that have nothing to do with it, and those of 250 rare contexts with 40 seeds each as well."""
    rng = random.Random(9)
    number = lambda: f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    docs = [(k, f"reach desk +1 {number()} daily") for k in range(60)] + [(1000 + k, f"reach desk {number()} daily") for k in range(60)]
    docs += [(10_000 + k, f"w{k % 7001} x{k} +1 {number()}.") for k in range(40_000)]
    docs += [(100_000 + 50 * c + k, f"ring{c} bell{c} {'+1 ' if k < 40 else ''}{number()} now") for c in range(250) for k in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["id"] for r in pii.personal_data(df).where("size(added) > 0").select("id").collect()}
    assert got == set(range(1000, 1060)) | {100_000 + 50 * c + k for c in range(250) for k in range(40, 50)}


def test_patterns_equal_a_plain_bootstrap(spark):
    """Trusted patterns of small documents against the definition, in plain Python."""
    rng = random.Random(10)
    number = lambda: f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    docs = []
    for k in range(400):
        words = [rng.choice("ab") + rng.choice("cd") + rng.choice("ef") for _ in range(8)]
        if rng.random() < 0.6:
            before = rng.choice([["call", "now"], ["see", "list"], [rng.choice("uvw"), "or"]])
            words += before + rng.choice([["+1", number()], [number()], ["x"]][: 2 + (before[0] != "call")])
        docs.append((k, " ".join(words)))
    times = Counter(p for _, t in docs for p in zip(t.lower().split(), t.lower().split()[1:], strict=False))
    edges = Counter()
    for _, t in docs:
        w = t.lower().split()
        for k in range(2, len(w)):
            if w[k - 1 :][:1] == ["+1"] and k >= 3:
                edges[(w[k - 3], w[k - 2]), "+1 " + w[k], True] += 1
            elif w[k][0].isdigit() and w[k - 1] != "+1":
                edges[(w[k - 2], w[k - 1]), w[k], False] += 1
    seeds = Counter(c for c, _, s in edges if s)
    graph = {e: n for e, n in edges.items() if seeds[e[0]] >= pii.LEAST_SEEDS}
    score = {v: float(s) for _, v, s in graph}
    for _ in range(pii.ROUNDS):
        mass = Counter()
        for (c, v, _), n in graph.items():
            mass[c] += score[v] * n
        conf = {c: m / max(m, times[c]) for c, m in mass.items()}
        for v in score:
            if not any(s for _, x, s in graph if x == v):
                score[v] = 1 - math.prod(max(1 - conf[c], 1e-9) for c, x, _ in graph if x == v)
    lower = lambda p, n: (p + 1 / (2 * n) - math.sqrt(p * (1 - p) / n + 1 / (4 * n * n))) / (1 + 1 / n)
    want = {" ".join(c) for c, p in conf.items() if lower(p, max(mass[c], times[c])) >= pii.LEAST_CONFIDENCE}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = pii.found(df).cache()
    assert {r["context"] for r in pii.trusted_patterns(rows, df).where("kind = 3").collect()} == want and want
