"""WARC archives of pages, and a globally ordered index of their captures.

Writing: a page is a response record, or a revisit of the response with the same payload (the one
with the largest page id). Which pages are revisits is decided on ids and digests alone; bodies are
shuffled once, to meet that decision under their id, and go from there into the archives, so a
payload that millions of pages share is no key of any body. Records are UTF-8 text and end with two
line breaks, so Spark's text writer makes the archives, gzipped, on any file system; a record's
offset and length are those in the unpacked archive. Reading: archives are parsed by their content
lengths; digests of stored payloads are verified. Index: an archive's captures, sorted by URL key,
timestamp and page id, are a run, and the runs are a saved table; they are dealt to ranges of keys
and what reaches a range of each run is merged k ways with a loser tree, which reads the runs in
blocks. A range boundary may fall inside one URL's captures, so no URL is too frequent.

Defined results: a null page counts as an empty payload; records with payloads under ``least`` bytes
are all responses; a null page id sorts below all others, and where all ids of a payload are null
or equal, the records are all responses; a null URL has the empty key; spaces and control
characters in URLs are written as %20; repeated rows are records each; an empty table gives no
archives and no rows; extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.session import cut, saved, shared_dir

#: Bytes of records in an archive before it is packed, about.
ARCHIVE_BYTES = 16 << 20
#: Captures in a range of the index, about.
RANGE_ROWS = 200_000
#: Captures of a run that are Python objects at once while it is merged.
BLOCK_ROWS = 64
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: five hex digits make four characters."""
    digest = F.sha1(payload)
    part = lambda k: F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
    letter = lambda v, s: F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*(letter(part(k), s) for k in range(8) for s in (15, 10, 5, 0)))


def revisits(page: DataFrame, least: int = 0) -> DataFrame:
    """``id``, ``digest``, ``size`` and ``original`` of the pages (id, digest, size) that revisit another, each once; cut."""
    narrow = saved(page.select("id", "digest", "size"))
    largest = narrow.groupBy("digest", "size").agg(F.max("id").alias("original"), F.count("*").alias("n"))
    largest = cut(largest.where("n > 1").drop("n"))  # a join right after the aggregation could not be split by key
    again = (F.col("size") >= least) & F.col("original").isNotNull() & ~F.col("id").eqNullSafe(F.col("original"))
    return cut(narrow.join(largest, ["digest", "size"]).where(again).select("id", "digest", "size", "original").distinct())


def records(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The text of each page's record, ``value``, without the record's end; and ``id`` and ``size``, the payload's bytes."""
    body = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    page = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    page = page.select("id", "url", "body", F.octet_length("body").cast("long").alias("size"), base32_sha1(F.col("body").cast("binary")).alias("digest"))
    again = revisits(page, least).select(F.coalesce("id", F.lit(-1)).alias("_id"), F.col("id").isNull().alias("_no_id"), F.col("digest").alias("_digest"), F.col("size").alias("_size"), "original")
    same = (F.coalesce("id", F.lit(-1)) == F.col("_id")) & (F.col("id").isNull() == F.col("_no_id")) & (F.col("digest") == F.col("_digest")) & (F.col("size") == F.col("_size"))
    page = page.join(again, same, "left")
    revisit = F.col("original").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("size")), F.lit("\r\n"))
    block = F.concat(http, F.when(F.col("revisit"), "").otherwise(F.col("body")))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce("id", F.lit(0)), F.lit(315360000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")), F.lit("")),
        line("WARC-Date", stamp),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("original").cast("string"), F.lit(">"))))).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", F.octet_length("block")),
        F.lit("\r\n"),
    )
    return page.withColumn("revisit", revisit).withColumn("block", block).select("id", "size", F.concat(head, F.col("block")).alias("value"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, **names) -> None:
    """Writes the pages' records as archives in the folder ``path``; Spark deals the records, and a task begins a new archive when one has its share."""
    html = F.octet_length(names.get("html_col", "html"))
    found = pages.agg(F.coalesce(F.sum(F.coalesce(html, F.lit(0)).cast("long") + 512), F.lit(0)).alias("size"), F.count("*").alias("n")).first()
    share = max(1, archive_bytes * found["n"] // max(1, found["size"]))
    records(pages, **names).select("value").write.option("lineSep", END).option("maxRecordsPerFile", share).option("compression", "gzip").text(path)


def url_key(url: str) -> str:
    """The URL with its host's labels reversed, without scheme, www and fragment, in lower case: com,example)/path?query."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^#]*)", url)
    host = re.sub(r"^www[0-9]*\.", "", m[1].lower())
    port = "" if m[2] in (None, ":80", ":443") else m[2]
    return f"{','.join(reversed(host.split('.')))}{port}){m[3].lower() or '/'}" if url else ""


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record of an archive."""
    at, end = 0, END.encode()
    while at < len(content):
        body = content.index(end, at) + 4
        first, *rest = content[at:body].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in rest if x)
        stop = body + int(head["Content-Length"])
        if content[stop : stop + 4] != end:
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield at, stop + 4 - at, head, content[body:stop]
        at = stop + 4


CAPTURE = "run string, offset long, length long, page_id long, url string, url_key string, ts string, record_type string, payload_digest string, payload_bytes long, refers_to long"


def captures(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives in ``path``; those of one archive (``run``) lie together, sorted by URL key, timestamp and page id."""

    def number(urn: str | None) -> int | None:
        found = urn and urn[len("<urn:page:") : -1]
        return int(found) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for offset, length, head, block in parse(gzip.decompress(content.as_buffer())):
                    http, payload = block.split(END.encode(), 1)
                    size = int(re.search(rb"Content-Length: ([0-9]+)", http)[1])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"the payload at byte {offset} of {name} isn't the one its digest was made of")
                    url = head.get("WARC-Target-URI", "")
                    rows.append((name, offset, length, number(head["WARC-Record-ID"]), url, url_key(url), re.sub(r"\D", "", head["WARC-Date"]), head["WARC-Type"], digest, size, number(head.get("WARC-Refers-To"))))
                rows.sort(key=_order)
                yield pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for k, c in enumerate(zip(*rows, strict=True) if rows else [[]] * len(_TYPES))], NAMES)

    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content").mapInArrow(run, CAPTURE)


NAMES = [c.split()[0] for c in CAPTURE.split(", ")]
_TYPES = [pa.int64() if c.endswith(" long") else pa.string() for c in CAPTURE.split(", ")]


def _order(row: tuple) -> tuple:
    return row[5], row[6], -1 if row[3] is None else row[3], row[0], row[1]


class LoserTree:
    """Merges sorted runs, any iterables: each inner node keeps the loser of the match below it, so the next item needs one match a level."""

    def __init__(self, runs: Iterable[Iterable], key: Callable) -> None:
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = len(self.runs)
        self.item = [next(r, None) for r in self.runs]
        self.head = [None if x is None else key(x) for x in self.item]
        self.tree = [-1] * max(1, self.k)
        for run in range(self.k):
            self._replay(run)

    def _beats(self, a: int, b: int) -> bool:
        if self.head[a] is None or self.head[b] is None:
            return self.head[b] is None and (self.head[a] is not None or a < b)
        return (self.head[a], a) < (self.head[b], b)

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self.tree[node] < 0:  # first round: wait here for the other side
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and self.head[w := self.tree[0]] is not None:
            yield self.item[w]
            self.item[w] = next(self.runs[w], None)
            self.head[w] = None if self.item[w] is None else self.key(self.item[w])
            self._replay(w)


def sorted_pieces(batches: Iterator[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """The batches cut wherever the order falls: what arrives of the runs, each piece sorted. They stay Arrow data."""
    out = []
    for batch in batches:
        keys = [_order(r) for r in zip(*(batch.column(n).to_pylist() for n in NAMES), strict=True)]
        cuts = [0, *(k for k in range(1, len(keys)) if keys[k] < keys[k - 1]), len(keys)]
        out += [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    return out


def _rows(piece: pa.RecordBatch) -> Iterator[tuple]:
    for a in range(0, piece.num_rows, BLOCK_ROWS):
        yield from zip(*(piece.column(n).slice(a, BLOCK_ROWS).to_pylist() for n in NAMES), strict=True)


def merged_index(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures with ``shard`` and ``position``: in the order of these two, captures are ordered by URL key, timestamp and page id.

    ``runs`` is read more than once: pass a saved frame.
    """
    ranges = max(1, -(-runs.count() // range_rows))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, done, rows = TaskContext.get().partitionId(), 0, []

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
            more = [pa.array(np.full(len(rows), shard, np.int32)), pa.array(np.arange(done, done + len(rows)))]
            return pa.RecordBatch.from_arrays(columns + more, [*NAMES, "shard", "position"])

        for row in LoserTree(map(_rows, sorted_pieces(batches)), _order):
            rows.append(row)
            if len(rows) == 10_000:
                yield out()
                done, rows = done + len(rows), []
        if rows:
            yield out()

    dealt = runs.repartitionByRange(ranges, "url_key", "ts", F.coalesce("page_id", F.lit(-1)), "run", "offset")
    return dealt.mapInArrow(merge, CAPTURE + ", shard int, position long")


def archive_and_index(pages: DataFrame, path: str | None = None, **names) -> DataFrame:
    """Writes the pages as archives (to ``path``, or a new folder of the shared one), reads them back and returns the merged index."""
    spark = pages.sparkSession
    if path is None:
        path = f"{shared_dir(spark)}/saved/warc-{uuid.uuid4().hex}"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    write_archives(pages, path, **names)
    return merged_index(saved(captures(spark, path)))
