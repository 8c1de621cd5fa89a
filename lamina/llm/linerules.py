"""Line-first quality rules: bad lines are removed, then documents that lost too much are rejected.

A line fails if any of three rules says so (each is a pattern or a comparison of counts, see
``failing``): punctuation (shouting marks, symbols in place of words, or no sentence mark at all in
a long line; marks of all scripts count), navigation (menus of parts between bars or arrows, or a
bare label), and boilerplate (fixed phrases of notices, licences and web pages, and lines that one
in ``COMMON_SHARE`` of all different texts has, ``LEAST_COMMON`` texts at least; a text that many
documents share counts once). A document whose failing lines hold more than ``MOST_LOST`` percent of
the characters of its lines is rejected.

A text with m lines has at most m of the common lines, so there are no more of them than
``COMMON_SHARE`` times the mean number of lines of a text: a few hundred, whatever the corpus.

Defined results: a null text has no words and no lines; documents of under ``LEAST_WORDS`` words,
and those more than half of whose words are in repeated three-word windows, fail before the line
rules; lines without a word are kept as they are and count for nothing; repeated rows get equal
results; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.arrowtext import coded, hashes, slices, words
from lamina.session import saved, text_batches

LEAST_WORDS, MOST_REPEATED, MOST_LOST = 50, 50, 30
SYMBOLS = "[#*$%&|<>]"
SHOUT = "[!?][!?]"
#: Sentence marks: Latin, Greek, Armenian, Arabic, Devanagari, Ethiopic, Myanmar, Khmer, Tibetan, Chinese and Japanese ones.
SENTENCE = "[.!?…;՞։؟۔।॥።፧၊။។៕།。．！？｡]"
#: A line is boilerplate that one in so many texts has, if that many have it.
COMMON_SHARE, LEAST_COMMON = 50, 20
BARS = "[|›»→·]"
WORD = r"[^\x20\x09-\x0D]"
BOILERPLATE = (
    r"(?i)all rights reserved|copyright (©|\(c\)|[0-9])|licensed under|released under the|terms of (use|service)|privacy policy|cookie policy|"
    r"(accept|uses?) cookies|enable javascript|click here|sign (in|up)|log in|subscribe (to|now)|read more|lorem ipsum"
)


def common_lines(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of the lines with a word that at least one in ``COMMON_SHARE`` of the different texts with lines has, counted over all documents."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, array in slices(batch, "t"):
                ends, lines = _lines(array)
                codes, distinct = coded(lines)
                full = np.asarray(pc.match_substring_regex(distinct, WORD))[codes]
                text = hashes(array)[np.repeat(np.arange(len(array)), np.diff(ends))]
                yield pa.RecordBatch.from_pydict({"text": pa.array(text[full].view(np.int64)), "line": pa.array(hashes(distinct)[codes][full].view(np.int64))})

    pairs = saved(docs.select(F.col(text_col).alias("t")).where("t is not null").mapInArrow(run, "text long, line long").distinct())
    texts = pairs.select("text").distinct().count()
    least = max(LEAST_COMMON, -(-texts // COMMON_SHARE))
    got = pairs.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("line").collect()
    return np.sort(np.array([r["line"] for r in got], np.int64).view(np.uint64))


def _lines(array: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's lines, and all lines."""
    parts = pc.split_pattern(array, "\n")
    ends = np.asarray(parts.offsets, np.int64)
    return ends - ends[0], parts.values.slice(ends[0], ends[-1] - ends[0])


def failing(lines: pa.Array, common: np.ndarray) -> np.ndarray:
    """Whether each line fails a rule; ``common``: see ``common_lines``."""
    count = lambda p: np.asarray(pc.count_substring_regex(lines, p), np.int64)
    n = count(WORD + "+")
    shout, symbol, bar, mark = count(SHOUT), count(SYMBOLS), count(BARS), count(SENTENCE)
    punctuation = ((shout >= 2) & (4 * shout >= n)) | ((symbol >= 3) & (2 * symbol >= n)) | ((n >= 20) & (mark == 0))
    navigation = ((bar >= 2) & (6 * bar >= n)) | ((n <= 2) & (mark == 0))
    return punctuation | navigation | np.asarray(pc.match_substring_regex(lines, BOILERPLATE)) | np.isin(hashes(lines), common)


def _repeats(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of words of each text in three-word windows found twice or more in it."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    if len(codes) < 3:
        return np.zeros(n, np.int64)
    inside = np.flatnonzero(doc[2:] == doc[:-2])
    _, pair = np.unique(codes[:-1] << 32 | codes[1:], return_inverse=True)
    window = pair[inside] << 32 | codes[inside + 2]
    order = np.lexsort((window, doc[inside]))
    w, d = window[order], doc[inside][order]
    same = (w[1:] == w[:-1]) & (d[1:] == d[:-1])
    again = np.zeros(len(w), bool)
    again[1:] |= same
    again[:-1] |= same
    at = inside[order[again]]
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[at + k] = True
    return np.bincount(doc[covered], minlength=n)


def measured(array: pa.Array, common: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, pa.Array]:
    """Counts of each text; whether each line is removed, the lines' offsets and the lines."""
    flat, offsets = words(array, lower=False)
    n = len(array)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    codes, _ = coded(flat)
    ends, lines = _lines(array)
    line_codes, distinct = coded(lines)
    has_word = np.asarray(pc.match_substring_regex(distinct, WORD))
    bad = np.asarray(failing(distinct, common)) & has_word
    size = np.asarray(pc.utf8_length(distinct), np.int64)
    line_doc = np.repeat(np.arange(n), np.diff(ends))
    real = has_word[line_codes]
    first = np.unique(line_doc[real] * max(1, len(distinct)) + line_codes[real]) // max(1, len(distinct))
    tally = lambda which, weight=None: np.bincount(line_doc[which], None if weight is None else weight[which], minlength=n).astype(np.int64)
    counts = {
        "n_words": np.diff(offsets),
        "word_chars": np.bincount(doc, np.asarray(pc.utf8_length(flat), np.int64), minlength=n).astype(np.int64),
        "n_symbols": np.asarray(pc.count_substring_regex(array, SYMBOLS), np.int64),
        "n_dup_lines": tally(real) - np.bincount(first, minlength=n),
        "n_repeat_words": _repeats(codes, offsets),
        "lost_chars": tally(bad[line_codes], size[line_codes]),
        "line_chars": tally(real, size[line_codes]),
    }
    return counts, bad[line_codes], ends, lines


def apply_rules(docs: DataFrame, common: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Of every row: its id, the counts, ``base_failed``, ``kept``, the characters of failing and of all lines, and of the text that is left
    its length, its SHA-256 and, if ``with_text``, itself (``clean_text``). ``common``: as ``common_lines`` of the corpus gives them."""
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    common = np.zeros(0, np.uint64) if common is None else common
    names, more = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], ["lost_chars", "line_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, array in slices(batch, "t"):
                counts, bad, ends, lines = measured(array, common)
                cols = {id_col: rows.column("id")} | {k: pa.array(counts[k]) for k in names}
                failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])
                cols["base_failed"] = pa.array(failed)
                cols["kept"] = pa.array(~failed & (100 * counts["lost_chars"] <= MOST_LOST * counts["line_chars"]))
                cols |= {k: pa.array(counts[k]) for k in more}
                left = np.concatenate(([0], np.cumsum(~bad)))[ends]
                kept = lines.filter(pa.array(~bad)).cast(pa.string())
                clean = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), kept), "\n")
                cols["clean_chars"] = pc.utf8_length(clean).cast(pa.int64())
                cols["clean_sha256"] = pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in clean.cast(pa.binary())])
                if with_text:
                    cols["clean_text"] = clean
                yield pa.RecordBatch.from_pydict(cols)

    schema = f"{id_col} {kind}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, " + ", ".join(f"{n} long" for n in more) + ", clean_chars long, clean_sha256 string" + ", clean_text string" * with_text
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, schema)
