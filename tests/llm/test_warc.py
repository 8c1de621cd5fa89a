import base64
import gzip
import hashlib
import heapq
import random
from collections import Counter

import pytest

from lamina.llm import warc

SCHEMA = "page_id long, url string, html string, size long, digest string, id long, body string"


def pages():
    rng = random.Random(2)
    out = [(k, f"HTTPS://www.Example{k % 7}.com:443/P?q={k % 3}#f", rng.choice(["<p>same</p>", f"<p>{k}</p>", "", "a\r\n\r\nWARC/1.1\r\n", "é🙂" * (k % 5)])) for k in range(60)]
    out += [(100, None, None), (101, "not a url\r\nX: y", "x" * 70_000), (102, "", "<p>same</p>"), (3, out[3][1], out[3][2]), (None, "http://n.org/", "<p>same</p>"), (None, None, "only null")]
    return [(*r, 5, "clash", 6, "clash") for r in out]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(pages(), SCHEMA).repartition(4)


def expected():
    best = {}
    for i, _, html, *_ in pages():
        p = html or ""
        best[p] = max((x for x in (best.get(p), i) if x is not None), default=None)
    out = Counter()
    for i, _, html, *_ in pages():
        p = (html or "").encode()
        again = best[html or ""] is not None and i != best[html or ""]
        out[(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", best[html or ""] if again else None)] += 1
    return out


def test_archive_and_index(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 20)
    path = f"file://{tmp_path}/warc"
    index = warc.archive_and_index(table, path)
    got = index.collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == expected()
    got.sort(key=lambda r: (r["shard"], r["position"]))
    order = [(r["url_key"], r["ts"], -1 if r["page_id"] is None else r["page_id"]) for r in got]
    assert order == sorted(order)
    for r in got:
        data = gzip.open(r["run"].removeprefix("file://").removeprefix("file:")).read()[r["offset"] : r["offset"] + r["length"]]
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")


def test_small_archives_make_the_same_index(spark, table, tmp_path):
    warc.write_archives(table, f"file://{tmp_path}/w", archive_bytes=3000)
    runs = warc.captures(spark, f"file://{tmp_path}/w").cache()
    assert runs.select("run").distinct().count() > 5
    got = warc.merged_index(runs, 10)
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect()) == expected()


def test_payloads_under_the_least_size_are_all_responses(spark, table):
    short = warc.records(table, least=100).where("value like '%WARC-Type: revisit%'").count()
    assert short == 0


def test_a_damaged_payload_is_found(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([(1, "http://a.b/", "payload")], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    for f in (tmp_path / "w").glob("part-*"):
        f.write_bytes(gzip.compress(gzip.decompress(f.read_bytes()).replace(b"\r\n\r\npayload", b"\r\n\r\nPayload")))
    for f in (tmp_path / "w").glob(".*.crc"):
        f.unlink()
    with pytest.raises(Exception, match="isn't the one"):
        warc.captures(spark, f"file://{tmp_path}/w").count()


def test_empty_table(spark):
    assert warc.archive_and_index(spark.createDataFrame([], SCHEMA)).count() == 0


def test_url_keys():
    assert warc.url_key("http://www.Example.com/A?b=C#d") == "com,example)/a?b=c"
    assert warc.url_key("https://m.x.org:443") == "org,x,m)/"
    assert warc.url_key("http://x.org:8080/") == "org,x:8080)/"
    assert warc.url_key("") == ""


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16, 33])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted(rng.randint(0, 50) for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(k)]
    assert list(warc.LoserTree(runs, lambda x: x)) == list(heapq.merge(*runs))


def test_a_payload_shared_by_most_pages_is_decided_apart_from_bodies(spark):
    """A third of the pages share a payload and a third have no id; bodies only meet the decision under their ids."""
    pages = [(k, f"http://h.org/{k}", "shared" if k % 3 == 0 else f"own {k}") for k in range(300)] + [(None, "http://h.org/", "shared")] * 150
    made = warc.records(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = made.selectExpr("id", "value like '%WARC-Type: revisit%' as again").groupBy("again").count().collect()
    assert {r["again"]: r["count"] for r in got} == {True: 99 + 150, False: 201}


def test_pieces_are_cut_where_the_order_falls(spark, table, tmp_path):
    warc.write_archives(table, f"file://{tmp_path}/w")
    rows = [tuple(r) for r in warc.captures(spark, f"file://{tmp_path}/w").collect()]
    random.Random(4).shuffle(rows)
    batch = warc.pa.RecordBatch.from_arrays([warc.pa.array(c, t) for c, t in zip(zip(*rows, strict=True), warc._TYPES, strict=True)], warc.NAMES)
    pieces = warc.sorted_pieces(iter([batch.slice(0, 20), batch.slice(20)]))
    assert sum(p.num_rows for p in pieces) == len(rows) and len(pieces) > 10
    assert list(warc.LoserTree(map(warc._rows, pieces), warc._order)) == sorted(rows, key=warc._order)
