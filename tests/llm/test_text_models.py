import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.llm import langid, latticelm, linerules, qualitycnn
from lamina.llm.bytecnn import Net, letter_classes, padded, shape_classes, windows
from tests.llm.conftest import PIECES, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


@pytest.fixture(scope="module")
def lattice():
    return latticelm.Lattice(PIECES)


def brute(word, weights, number):
    """Probability of a word as the sum over all cuts, by recursion over prefixes in plain numbers."""
    b = b" " + word.encode()
    a = [1.0] + [0.0] * len(b)
    for i in range(1, len(b) + 1):
        for j in range(i):
            if (k := number.get(b[j:i])) is not None:
                a[i] += a[j] * math.exp(weights[int(i == len(b)), k])
    return math.log(a[-1])


def test_lattice_sums_over_all_cuts(lattice):
    number = {p: k for k, (p, _) in enumerate(latticelm.vocabulary(PIECES))}
    words = ["the", "hello", "éèaux", "x", "$$$", "thnttionwh", "日本", "a" * 60]
    got = lattice.forward(pa.array(words), lattice.start)
    assert np.allclose(got, [brute(w, lattice.start, number) for w in words], atol=1e-9)


def test_expected_uses_cover_every_byte(lattice):
    words, counts = ["the", "hello", "日本"], np.array([2.0, 1.0, 3.0])
    sizes = np.array([len(p) for p, _ in latticelm.vocabulary(PIECES)])
    e = lattice.expected(pa.array(words), counts, lattice.start)
    assert abs((e.sum(0) * sizes).sum() - sum(c * (1 + len(w.encode())) for w, c in zip(words, counts, strict=True))) < 1e-6
    assert abs(e[1].sum() - counts.sum()) < 1e-9


def test_piece_weights_are_a_distribution(lattice):
    w = lattice.weights(np.random.default_rng(0).random(lattice.n) + 0.1, np.full(lattice.n, 0.05))
    assert np.exp(lattice.start).sum(0)[[k for k, (p, _) in enumerate(latticelm.vocabulary(PIECES)) if p in (b" the", b" a")]].min() > 1e-4  # early pieces weigh much from the start
    p = np.exp(w).sum(0)
    assert abs(p[lattice.front].sum() - 1) < 1e-9 and abs(p[~lattice.front].sum() - 1) < 1e-9


def test_language_model_base_and_score(odd, empty, monkeypatch):
    monkeypatch.setattr(latticelm, "CHUNK_BYTES", 1000)
    got = latticelm.score_documents(odd, PIECES, langid.held_out("doc_id", 10, 0)).collect()
    assert len(got) == len(rows())
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter()
    for r in rows():
        if not held(r[0]):
            c.update(WORD.findall(lower(r[1])))
            c[None] += 1
    total, distinct = sum(c.values()), len(c)
    want = []
    for r in rows():
        w = [*WORD.findall(lower(r[1])), None]
        want.append((str(r[0]), held(r[0]), len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10((c[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w), 6)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert latticelm.score_documents(empty, PIECES, langid.held_out("doc_id", 10, 0)).count() == 0


def test_language_model_without_training_texts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in latticelm.score_documents(df, PIECES, F.lit(True)).collect()}
    assert got[1]["n_known"] == 0 and got[2]["n_tokens"] == 1 and got[1]["score"] < got[2]["score"] < 0


def test_language_model_knows_its_training_words(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice(["ba", "lo", "mi", "ter", "shun"]) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    df = spark.createDataFrame([(k, " ".join(rng.choices(words, k=80))) for k in range(200)] + [(1000, "zq xv jk qqz wvx " * 16)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in latticelm.score_documents(df, PIECES, F.col("doc_id") % 10 == 0).collect()}
    assert got[10] > got[1000] + 2


def test_windows_cover_every_byte():
    for sizes in ([0, 1, 255, 256, 257, 5000], [0], [700]):
        at = np.concatenate(([0], np.cumsum(sizes)))
        text, start, end = windows(at, 256, 253)
        for k, n in enumerate(sizes):
            own = np.flatnonzero(text == k)
            seen = np.zeros(n, bool)
            for w in own:
                seen[start[w] - at[k] : min(end[w], start[w] + 256) - at[k]] = True
            assert len(own) and seen.all()


def test_tables_give_what_the_filters_give():
    net = Net(letter_classes(), 3, length=32, seed=2)
    raw = [b"hello w\xc3\xb6rld", b"", b"abc" * 10, b"x"]
    data = np.frombuffer(b"".join(raw), np.uint8)
    at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    best, _ = net._pooled(net.classes[padded(raw, 32)])
    want = np.maximum(best + net.bias, 0) @ net.dense + net.out
    assert np.allclose(net.logits(data, at[:-1], at[1:]), want, atol=1e-4)


def spoken(rng, lang, n):
    return " ".join(rng.choice({"en": ["the", "and", "with", "house", "thing"], "fr": ["été", "les", "où", "maison", "quête"], "de": ["über", "der", "schön", "und", "groß"]}[lang]) for _ in range(n))


def test_language_identification(spark, odd, empty):
    rng = random.Random(5)
    df = spark.createDataFrame([(k, spoken(rng, lang, rng.randint(3, 200)), lang) for k, lang in enumerate(["en", "fr", "de"] * 120)], "doc_id long, text string, lang string")
    model = langid.learn(df.where("doc_id % 4 != 2"))
    test = langid.identify(df.where("doc_id % 4 = 2"), model)
    assert test.where("lang = lang_pred").count() >= 0.95 * test.count()
    assert test.where("score < 0 or score > 1").count() == 0
    out = langid.identify(odd, model).collect()
    assert len(out) == len(rows())
    for r in out:
        assert (r["lang_pred"] == "und") == (not any(ch.isalpha() for ch in r["text"] or "")), r["text"]
        assert r["id"] == (None if r["doc_id"] is None else -r["doc_id"])
    assert langid.identify(empty, model).count() == 0
    nothing = langid.learn(empty)
    assert {r["lang_pred"] for r in langid.identify(odd, nothing).collect()} == {"und"}
    single = langid.identify(odd, langid.learn(odd.where("lang = 'en'")))
    assert {r["lang_pred"] for r in single.collect()} == {"und", "en"}


def test_quality_network(spark, odd, empty):
    rng = random.Random(6)
    good = [(k, " ".join(rng.choice(["plain", "words", "in", "lines."]) for _ in range(rng.randint(20, 300))), 1) for k in range(200)]
    bad = [(1000 + k, "A clean start. " + " ".join(rng.choice(["buy$$$", "now!!", "WIN***", "%%%"]) for _ in range(rng.randint(20, 300))), 0) for k in range(200)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = qualitycnn.learn(df.select("doc_id", "text"), df.where("doc_id % 4 != 2").select("doc_id", "quality"))
    test = qualitycnn.score(df.where("doc_id % 4 = 2"), model).collect()
    assert sum((r["score"] >= 0.7) == bool(r["quality"]) for r in test) >= 0.95 * len(test)
    out = qualitycnn.score(odd, model).collect()
    assert len(out) == len(rows()) and all(0 <= r["score"] <= 1 for r in out)
    assert qualitycnn.score(empty, model).count() == 0
    none = qualitycnn.learn(odd, empty.selectExpr("doc_id", "cast(n as int) as quality"))
    assert {r["score"] for r in qualitycnn.score(odd, none).collect()} == {0.5}
    ones = qualitycnn.learn(odd, odd.selectExpr("doc_id", "1 as quality"))
    assert {r["score"] for r in qualitycnn.score(odd, ones).collect()} == {1.0}


def rules(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    at = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {k + d for k in range(len(words) - 2) if at[tuple(words[k : k + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_line_rules(odd, empty):
    got = linerules.apply_rules(odd).collect()
    want = sorted(str((r[0], *rules(r[1]))) for r in rows())
    assert sorted(str((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert linerules.apply_rules(empty).count() == 0


def test_line_rules_remove_lines_and_reject_documents(spark):
    rng = random.Random(9)
    sentence = lambda: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 9) for _ in range(12)) + "."
    clean = [sentence() for _ in range(10)]
    junk = ["Home | News | Sport | Contact", "All rights reserved.", "CLICK!! NOW!! BUY!! THIS!!", "one$$$ two*** three%%% four&&&", "Menu"]
    df = spark.createDataFrame([(1, "\n".join(clean)), (2, "\n".join(clean + junk)), (3, "\n".join(clean[:5] + junk * 8))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in linerules.apply_rules(df).collect()}
    assert [got[k]["kept"] for k in (1, 2, 3)] == [True, True, False]
    assert got[2]["clean_text"] == "\n".join(clean) == got[1]["clean_text"]


def test_a_row_that_repeats_very_often_is_sampled_once(spark):
    rng = random.Random(11)
    df = spark.createDataFrame([(k, spoken(rng, lang, 40), lang) for k, lang in enumerate(["en", "fr"] * 60)], "doc_id long, text string, lang string")
    hot = spark.range(300_000).selectExpr("cast(7 as long) as doc_id", "'the and with house' as text", "'en' as lang")
    nulls = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "concat('the thing ', id) as text", "'en' as lang")
    picked = langid.sampled_texts(df.union(hot).union(nulls), "lang", "text", "doc_id", 50)
    assert picked.where("label = 'en'").count() <= 4 * 50


def test_copies_of_a_row_do_not_crowd_its_label_out(spark):
    rng = random.Random(12)
    kind = "doc_id long, text string, lang string"
    df = spark.createDataFrame([(k, spoken(rng, "en", 40) + str(k), lang) for k, lang in enumerate(["xx", "yy"] * 300)], kind)
    hot = spark.range(20_000).selectExpr("cast(9999 as long) as doc_id", "'the and with house' as text", "'xx' as lang")
    got = {r["label"]: r["count"] for r in langid.sampled_texts(df.union(hot), "lang", "text", "doc_id", 100).groupBy("label").count().collect()}
    assert 60 <= got["xx"] <= 150 and 60 <= got["yy"] <= 150


def test_documents_that_repeat_an_id_do_not_crowd_labels_out(spark):
    rng = random.Random(13)
    df = spark.createDataFrame([(k, spoken(rng, "en" if k % 2 else "fr", 60)) for k in range(200)], "doc_id long, text string")
    hot = spark.range(20_000).selectExpr("cast(1 as long) as doc_id", "'the and with house' as text")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    model = qualitycnn.learn(df.union(hot), labels, per_label=50)
    got = qualitycnn.score(df, model).toPandas()
    assert ((got["score"] >= 0.5) == (got["doc_id"] % 2 == 1)).mean() > 0.9


def forward(net, windows):
    """Outputs for windows of bytes, one window, filter and place at a time."""
    out = []
    for w in windows:
        x = [int(net.classes[b]) for b in w] + [int(net.classes[256])] * (net.length - len(w))
        best = []
        for weights in net.conv:
            size, _, filters = weights.shape
            best += [max(sum(float(weights[j][x[p + j]][f]) for j in range(size)) for p in range(len(x) - size + 1)) for f in range(filters)]
        hidden = [max(0.0, b + float(c)) for b, c in zip(best, net.bias, strict=True)]
        out.append([sum(h * float(net.dense[i][o]) for i, h in enumerate(hidden)) + float(net.out[o]) for o in range(net.outputs)])
    return np.array(out)


def test_whole_queries_of_the_networks_equal_a_plain_forward_pass(spark):
    rng = random.Random(14)
    texts = ["", "q", spoken(rng, "en", 30), spoken(rng, "fr", 200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = lambda t, length, stride: [t.encode()[a : a + length] for a in range(0, max(1, 1 + -(-(max(0, len(t.encode()) - length)) // stride)) * stride, stride)]
    net = Net(letter_classes(), 2, length=langid.LENGTH)
    got = {r["doc_id"]: r for r in langid.identify(df, (["a", "b"], net)).collect()}
    for k, t in list(enumerate(texts))[1:]:
        parts = cut(t, langid.LENGTH, langid.LENGTH - 3)
        z = forward(net, parts)
        p = np.exp(z - z.max(1, keepdims=True))
        p = p / p.sum(1, keepdims=True) * np.array([[len(w)] for w in parts])
        p = p.sum(0) / p.sum()
        assert got[k]["lang_pred"] == "ab"[int(p.argmax())] and abs(got[k]["score"] - p.max()) < 1e-4
    model = qualitycnn.Quality(Net(shape_classes(), 1, length=qualitycnn.LENGTH, seed=5))
    model.weights = np.array([0.3, -0.2, 0.5, 0.1])
    got = {r["doc_id"]: r["score"] for r in qualitycnn.score(df, model).collect()}
    for k, t in enumerate(texts):
        z = np.clip(forward(model.net, cut(t, qualitycnn.LENGTH, qualitycnn.STRIDE))[:, 0], -12, 12)
        assert abs(got[k] - 1 / (1 + math.exp(-(0.3 * z.mean() - 0.2 * z.min() + 0.5 * z.max() + 0.1)))) < 1e-4


def test_windows_are_sampled_from_whole_texts(spark):
    """All windows of a text can be chosen, also the last ones of a long text, and about as many as asked for are."""
    text = "".join(chr(97 + k // 400 % 26) for k in range(400 * 520))
    picked = spark.createDataFrame([("a", "1", text), ("b", "2", "short")], "label string, i string, t string")
    got = langid.sample_windows(picked, 256, 253, 200)
    assert 140 < sum(r["label"] == "a" for r in got) < 260 and sum(r["label"] == "b" for r in got) == 1
    every = langid.sample_windows(picked, 256, 253, 10_000)
    assert len(every) == 1 + 1 + -(-(len(text) - 256) // 253)


def test_columns_with_the_names_of_the_results_survive(spark):
    df = spark.createDataFrame([(1, "the house", 3.5, "mine", 9)], "doc_id long, text string, score double, _p string, _row int")
    for names in ([], ["en"], ["de", "en"]):
        net = Net(letter_classes(), 2) if len(names) == 2 else None
        got = langid.judged(df, (names, net)).select("_row.*", "lang_pred").first()
        assert (got["_p"], got["score"], got["_row"]) == ("mine", 3.5, 9) and got["lang_pred"] in (names or ["und"])
        assert langid.identify(df, (names, net)).columns == ["doc_id", "text", "_p", "_row", "lang_pred", "score"]


def test_the_score_is_that_of_all_segmentations(spark):
    """The whole query against a plain version: counts, expectation and maximisation over all cuts, scores."""
    rng = random.Random(3)
    words = ["the", "banana", "x9", "été", "wordless", "zzz"]
    docs = [(k, " ".join(rng.choices(words, [5, 3, 1, 2, 1, 1], k=rng.randint(0, 9)))) for k in range(30)]
    got = {r["doc_id"]: r["score"] for r in latticelm.score_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), PIECES, F.col("doc_id") % 5 == 0, rounds=2).collect()}
    train = [t for k, t in docs if k % 5]
    count = Counter(w for t in train for w in t.split())
    lat = latticelm.Lattice(PIECES)
    number = {p: k for k, (p, _) in enumerate(latticelm.vocabulary(PIECES))}
    logp = lat.start
    for _ in range(2):
        uses, last = np.zeros(lat.n), np.zeros(lat.n)
        for w, c in count.items():
            b = b" " + w.encode()
            cuts = [[]]
            done = []
            while cuts:  # every way through
                way = cuts.pop()
                at = sum(len(p) for p in way)
                if at == len(b):
                    done.append(way)
                else:
                    cuts += [[*way, b[at:e]] for e in range(at + 1, len(b) + 1) if b[at:e] in number]
            weight = [math.exp(sum(logp[int(k == len(way) - 1), number[p]] for k, p in enumerate(way))) for way in done]
            for way, x in zip(done, weight, strict=True):
                for k, p in enumerate(way):
                    uses[number[p]] += c * x / sum(weight)
                    last[number[p]] += c * x / sum(weight) * (k == len(way) - 1)
        logp = lat.weights(uses, last)
    ends = len(train) / (sum(count.values()) + len(train))
    for k, t in docs:
        want = sum(brute(w, logp, number) / math.log(10) + math.log10(1 - ends) for w in t.split()) + math.log10(ends)
        assert abs(got[k] - want) < 1e-6


def test_lines_that_many_texts_share_are_boilerplate(spark, empty):
    rng = random.Random(12)
    line = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eta"]) + str(rng.randint(0, 99)) for _ in range(12)) + "."
    docs = [(k, "\n".join([*(line() for _ in range(6)), "Our shop sells many good things to all people."])) for k in range(40)] + [(100 + k, "\n".join(["One text that is found again and again in the table.", *["x y z." * 20] * 3])) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    common = linerules.common_lines(df)
    assert len(common) == 1
    got = {r["doc_id"]: r for r in linerules.apply_rules(df, common).collect()}
    assert got[3]["clean_text"] == docs[3][1].rsplit("\n", 1)[0] and got[3]["kept"]
    assert got[100]["clean_text"] == docs[40][1] and got[100]["lost_chars"] == 0
    assert got[3]["clean_chars"] == len(got[3]["clean_text"]) and len(linerules.common_lines(empty)) == 0
