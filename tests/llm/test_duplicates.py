import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lamina.llm import exactdedup, neardup
from lamina.llm.arrowtext import words
from lamina.llm.shingles import shingle_sets, superminhash
from lamina.operators.graph import least_of_component as components
from tests.llm.conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def largest(ids):
    return max((i for i in ids if i is not None), default=None)


def test_fingerprints_compose():
    rng = np.random.default_rng(3)
    for n in (0, 1, 4095, 4096, 4097, 50_000):
        text = bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
        h, size = exactdedup.fingerprints(pa.array([text, "other", text], pa.large_string()))
        assert h[0] == h[2] and size.tolist() == [n, 5, n]
        want = 0
        for base, prime in zip(exactdedup.bases(0), exactdedup.PRIMES, strict=True):
            p = 0
            for b in text.encode():
                p = (p * base + b + 1) % prime
            want = want << 31 | p
        assert int(h[0]) == want


def test_exact_duplicates(odd, empty):
    got = exactdedup.exact_duplicates(odd).collect()
    by = defaultdict(list)
    for r in rows():
        by[r[1] or ""].append(r[0])
    want = Counter()
    for text, ids in by.items():
        for i in ids:
            want[(i, largest(ids), len(ids), i == largest(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want
    kept = exactdedup.deduplicated(odd)
    assert kept.columns == odd.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter((r[0], r[1]) for r in rows() if r[0] == largest(by[r[1] or ""]))
    assert exactdedup.exact_duplicates(empty).count() == 0 and exactdedup.deduplicated(empty).count() == 0


def test_a_collision_leads_to_other_bases(spark, monkeypatch):
    real = exactdedup.fingerprints
    monkeypatch.setattr(exactdedup, "fingerprint", lambda text, attempt=0: _weak(text, attempt, real))
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa")], "doc_id long, text string")
    got = {r["doc_id"]: r["keep_id"] for r in exactdedup.exact_duplicates(df).collect()}
    assert got == {1: 3, 2: 2, 3: 3}


def _weak(text, attempt, real):
    from pyspark.sql import functions as F

    if attempt:
        return F.struct(F.xxhash64(text).alias("h"), F.octet_length(text).cast("long").alias("n"))
    return F.struct(F.lit(1).cast("long").alias("h"), F.octet_length(text).cast("long").alias("n"))


def test_words_split_at_ascii_white_space_only():
    t = ["a\x0bb\x0cc\x1cd E\r\nÉ  ", "", "   ", "Q"]
    flat, at = words(pa.array(t, pa.large_string()))
    assert [flat.slice(a, b - a).to_pylist() for a, b in zip(at, at[1:], strict=False)] == [["a", "b", "c\x1cd e", "É"], [], [], ["q"]]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for shared in (0.5, 0.8, 0.95):
        n = 300
        k = round(2 * n * shared / (1 + shared))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate((a[:k], rng.integers(0, 2**63, n - k).astype(np.uint64)))
        s = superminhash(np.concatenate((np.sort(a), np.sort(b))), np.array([0, n, 2 * n]), 240)
        assert abs((s[0] == s[1]).mean() - shared) < 0.12


def test_signature_of_a_set_is_the_least_of_its_parts():
    rng = np.random.default_rng(1)
    a = np.sort(rng.integers(0, 2**63, 500).astype(np.uint64))
    parts = superminhash(a, np.array([0, 100, 500]), 64)
    assert (superminhash(a, np.array([0, 500]), 64)[0] == parts.min(0)).all()
    assert len({tuple(superminhash(x[None], np.array([0, 1]), 64)[0] >> np.uint64(32)) for x in a[:50]}) == 50


def brute(documents, k, percent):
    sets = []
    for i, t in documents:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append((i, {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return Counter((i, len(x), find(i), find(i) == i) for i, x in sets)


def test_odd_documents(odd, empty):
    for k in (2, 5):
        got = neardup.near_duplicates(odd, k).collect()
        assert Counter(tuple(r) for r in got) == brute([(r[0], r[1]) for r in rows()], k, 80)
    assert neardup.near_duplicates(empty).count() == 0


def groups(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    out = []
    for _ in range(4):
        base = rng.choices(vocabulary, k=100)
        for _ in range(40):
            d = list(base)
            for _ in range(rng.choice([0, 2, 4, 6, 7, 8, 9, 10])):
                d[rng.randrange(len(d))] = rng.choice(vocabulary)
            out.append((len(out), " ".join(d)))
    return out


@pytest.mark.parametrize("members", [1000, 40, 8])
def test_the_size_of_groups_changes_no_link(spark, monkeypatch, members):
    documents = groups(5)
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", members)
    df = spark.createDataFrame(documents, "doc_id long, text string")
    assert Counter(tuple(r) for r in neardup.near_duplicates(df, 2).collect()) == brute(documents, 2, 80)


def test_members_are_dealt_so_that_components_meet(spark, monkeypatch):
    """Every pair of different components meets in one pair of blocks, and a bucket's largest component isn't dealt against itself."""
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 5)
    placed = [(1, i, 0 if i < 40 else i) for i in range(52)] + [(2, i, 0) for i in range(30)] + [(3, 1, 1), (3, 2, 2)]
    got = neardup._dealt(spark.createDataFrame([(k, 0, i, c) for k, i, c in placed], "k long, b int, id long, comp long").repartition(3)).collect()
    at = {}
    for r in got:
        at.setdefault((r["k"], r["i"], r["j"]), []).append(r)
    met = Counter()
    for (k, i, j), rows_ in at.items():
        for x in rows_:
            for y in rows_:
                if x["id"] < y["id"] and x["comp"] != y["comp"] and (i == j or x["block"] != y["block"]):
                    met[k, x["id"], y["id"]] += 1
    want = {(k, i, j) for k, i, c in placed for k2, j, d in placed if k == k2 and i < j and c != d}
    assert set(met) == want and set(met.values()) == {1}
    assert len(got) < 52 * 6


def test_components_of_random_links(spark):
    rng = random.Random(6)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(links, "u long, v long").repartition(7))
    assert {r["u"]: r["v"] for r in got.collect()} == {x: find(x) for x in range(400) if find(x) != x}
    assert got.count() == got.select("u").distinct().count()


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 3), (5, 5)]
    random.Random(1).shuffle(links)
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(links, "u long, v long").repartition(5)).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {100 + k: 100 for k in range(1, 50)}


def test_shingles_of_short_texts():
    sets, at = shingle_sets(pa.array(["a b c", "a b", "A  B", "", "a", "b a"], pa.large_string()), 3)
    got = [frozenset(sets[a:b].tolist()) for a, b in zip(at, at[1:], strict=False)]
    assert [len(s) for s in got] == [1, 1, 1, 0, 1, 1]
    assert got[1] == got[2] and len({got[0], got[1], got[4], got[5]}) == 4
