import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lamina.llm import bpe, packing
from tests.llm.conftest import VOCABULARY, rows


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(VOCABULARY)


def test_random_texts_encode_and_decode_as_the_library_does(library, encoder):
    rng = random.Random(3)
    chars = "abcdeéÉßſΣσς İI 'sret lvmd''  \n\t\x0b\x1c\x85\xa0 12٣½Ⅷ.,;!?_-ññé 中文日本🙂👍🏽‍​﻿ǅ"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["<|startoftext|>Hello<|endoftext|> x's", "<|endoftext|>" * 3, "ab" * 3000, "a" * 500 + "<|endoftext|>", "'" * 99]
    want = library.encode_batch(texts, add_special_tokens=False)
    ids, at = encoder.encode(texts)
    for k, w in enumerate(want):
        assert w.ids == ids[at[k] : at[k + 1]].tolist(), texts[k]
    assert [library.decode(w.ids, skip_special_tokens=False) for w in want] == encoder.decode(ids, at).to_pylist()


def test_memory_of_words_may_be_forgotten_at_any_time(encoder, monkeypatch):
    texts = ["alpha beta gamma", "delta beta", "alpha"]
    want = [x.tolist() for x in encoder.encode(texts)]
    monkeypatch.setattr(bpe, "CACHED_WORDS", 1)
    assert [x.tolist() for x in encoder.encode(texts)] == want
    assert [x.tolist() for x in encoder.encode(texts)] == want


def test_compatibility_is_what_merging_two_tokens_gives(encoder):
    rng = np.random.default_rng(1)
    a = rng.integers(512, 49406, 3000)
    b = rng.integers(512, 49406, 3000)
    a = a[[not str(encoder.names[int(i)]).endswith("</w>") for i in a]]
    b = b[: len(a)]

    def base(i):
        return [int(i)] if encoder.first[i] == i else base(encoder.first[i]) + base(encoder.second[i])

    a_ok = np.array([encoder._merged(base(i)) == [i] for i in a])
    b_ok = np.array([encoder._merged(base(i)) == [i] for i in b])
    a, b = a[a_ok & b_ok], b[a_ok & b_ok]
    got = encoder.compatible(a, b)
    for x, y, ok in zip(a.tolist(), b.tolist(), got.tolist(), strict=True):
        assert (encoder._merged(base(x) + base(y)) == [x, y]) == ok


def test_documents(odd, empty, library):
    got = bpe.encode_documents(odd, VOCABULARY).collect()
    assert len(got) == len(rows())
    want = Counter()
    for r in rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[(r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert all(len(r["ids"]) == r["n_tokens"] for r in got)
    assert bpe.encode_documents(empty, VOCABULARY).count() == 0


def test_packing_of_odd_documents(odd, empty, library):
    capacity = 64
    got = packing.pack_documents(odd, VOCABULARY, capacity=capacity).collect()
    want, place = Counter(), defaultdict(list)
    for r in rows():
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for p, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want[(r[0], p, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    for r in got:
        place[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in place.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= capacity
    assert packing.pack_documents(empty, VOCABULARY).count() == 0


@pytest.mark.parametrize("name", ["skewed", "uniform", "large", "equal", "one", "none"])
def test_plan_is_valid_and_close_to_the_bound(name):
    rng = np.random.default_rng(4)
    lengths = {
        "skewed": np.minimum(4096, np.exp(rng.normal(6, 1.2, 20_000)).astype(int) + 1),
        "uniform": rng.integers(1, 4097, 5000),
        "large": rng.integers(1400, 2200, 4000),
        "equal": np.full(999, 1366),
        "one": np.array([7]),
        "none": np.zeros(0, int),
    }[name]
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.best_plan(dict(zip(values.tolist(), counts.tolist(), strict=True)), 4096)
    order = np.argsort(lengths, kind="stable")
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths)) - np.repeat(np.cumsum(counts) - counts, counts)
    sequence, offset = plan.place(lengths, rank) if len(lengths) else (np.zeros(0, int), np.zeros(0, int))
    k = np.lexsort((offset, sequence))
    s, o, n = sequence[k], offset[k], lengths[k]
    first = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    assert (o[first] == 0).all() and (o + n <= 4096).all()
    assert ((o + n)[:-1][~first[1:]] == o[1:][~first[1:]]).all()
    bound = max(-(-int(lengths.sum()) // 4096), -(-int((lengths > 1365).sum()) // 2), int((lengths > 2048).sum()))
    assert plan.n_sequences == first.sum() <= bound * 1.03 + 2


def test_rank_buckets_do_not_change_the_number_of_sequences(spark, monkeypatch):
    items = spark.range(3000).selectExpr("id as doc_id", "cast(1 + id * 7919 % 900 as long) as length")
    monkeypatch.setattr(packing, "BUCKET_ROWS", 10)
    got = packing.pack(items, 1000, ["doc_id"]).groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in got) <= 1000 and sum(r[1] for r in got) == items.agg({"length": "sum"}).first()[0]
