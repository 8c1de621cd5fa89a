import hashlib
import random
import re
import time
from collections import Counter

from lamina.llm import pii
from tests.llm.conftest import rows

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    return kind == "email" or kind == "ip" and all(int(p) <= 255 for p in v.split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15


def base(text):
    return sorted((m.start(), n, k, m.end()) for n, k in enumerate(BASE) for m in re.finditer(BASE[k], text or "") if valid(k, m.group()))


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def checked(spark, documents):
    df = spark.createDataFrame(documents, "doc_id long, text string")
    got = pii.summary(pii.personal_data(df)).collect()
    want = Counter()
    for i, t in documents:
        s = base(t)
        want[(i, *(sum(x[2] == k for x in s) for k in BASE), hashlib.sha256(written(s).encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    return {r["doc_id"]: r["spans"] for r in got}


def test_base_spans_of_random_texts(spark):
    rng = random.Random(4)
    parts = ["a@b.c", "_d@e.f", "1.2.3.4", ".5.6.7", "256.1.1.1", "001.02.3.255", "0000000000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (663) 555-6869", "+49.30.1234567", " ", "\n", "é", "🙂", "@", ".", "-", "x", "9", "99999999999999", "+", "(", ")", "a@b..c", "a@-.x"]
    checked(spark, [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for k in range(2000)])


def test_no_text_is_slow(spark):
    began = time.time()
    checked(spark, [(1, "9" * 30_000), (2, "a" * 30_000 + "@"), (3, "1 " * 20_000), (4, "a." * 20_000 + "@b.c" + ".d" * 20_000), (5, "a@b.c " * 3000), (6, "+1" * 10_000), (7, "1.2.3." * 5000)])
    assert time.time() - began < 60


def test_odd_documents(odd, empty):
    got = pii.summary(pii.personal_data(odd)).collect()
    assert len(got) == len(rows())
    assert Counter((r["doc_id"], r["spans"]) for r in got) == Counter((r[0], written(base(r[1]))) for r in rows())
    assert pii.summary(pii.personal_data(empty)).count() == 0 and pii.redact(empty).count() == 0
    clean = pii.redact(odd)
    assert clean.columns == odd.columns and clean.count() == len(rows())
    assert [r["text"] for r in clean.where("doc_id = 12").collect()] == ["mail [email] or [phone], [ip], [card]"]


def letters(k):
    return chr(97 + k // 26) + chr(97 + k % 26)


def test_patterns_find_unseen_identifiers(spark):
    known = [(k, f"Please dial number +1 202 555 0{100 + k} soon {letters(k)}") for k in range(12)]
    known += [(20 + k, f"some words, then e-mail address {letters(k)}x@corp.example.com for more") for k in range(12)]
    unseen = [(100, "Please dial number 202-555-0199. It rings"), (101, "our e-mail address joe(at)corp"), (102, "the code 202-555-0188 means nothing"), (103, "and address joe(at)corp")]
    spans = checked(spark, known + unseen)
    assert spans[100] == "phone:19:31" and spans[101] == "email:19:30"
    assert spans[102] == "" and spans[103] == ""
    df = spark.createDataFrame(known + unseen, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[100] == "Please dial number [phone]. It rings" and clean[102] == unseen[2][1]


def test_words_used_for_all_kinds_of_things_are_no_pattern(spark):
    documents = [(k, f"one of the 1.2.3.{k} and one of the many {letters(k)} one of the few one of the") for k in range(10)]
    documents.append((50, "one of the 999.2.3.4 here"))
    assert checked(spark, documents)[50] == ""
