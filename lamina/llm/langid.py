"""Language identification by a byte convolutional network.

The network learns from a bounded sample of labelled rows: about ``SAMPLE_DOCS`` different texts of
each language, chosen by a hash of id and text, and of all windows of these whole texts about
``SAMPLE_WINDOWS`` a language, chosen by a hash too. Every text is scored whole: windows overlap by
the widest filter less one byte, so no byte sequence that a filter can see is missed; a text's
probabilities are the means of its windows' softmax outputs, weighted by the bytes in the window.

Defined results: a null text, or one without any letter, is ``und`` with score 0, and so is every
text if there is nothing to learn from; ties go to the language that sorts first; with one language
to learn, every text with a letter gets it with score 1; repeated rows get equal results; labels
that are null are not learned; rows that repeat id, text and label are learned from once; extra columns
are not read by the model; an empty table gives no rows. A text is held whole by the task that scores it,
and scored some ``SLICE_BYTES`` of its windows at a time with others. More than ``MOST_LABELS`` labels, or a
sample of over ``MOST`` times the texts that are expected of a label, are errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.arrowtext import hashes, mix, slices, utf8
from lamina.llm.bytecnn import Net, letter_classes, padded, windows
from lamina.session import saved, text_batches

LENGTH = 256
#: Documents of each language to learn from, and windows of them, about.
SAMPLE_DOCS, SAMPLE_WINDOWS = 1000, 4000
#: So many times what is expected may be sampled; more is an error.
MOST = 4
#: Labels that can be learned; more are an error.
MOST_LABELS = 512
UNKNOWN = "und"


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder`` (a null id counts as the text '')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def sampled(rows: DataFrame, label_col: str, per_label: int, *key: Column) -> DataFrame | None:
    """Of each label the rows of about ``per_label`` different keys, chosen by a hash of the key; None where no row has a label.

    Rows that repeat a key are one draw, so they count once: copies of a row, however many, don't crowd others out.
    """
    draw = F.xxhash64(*key, F.lit(17))
    different = rows.where(F.col(label_col).isNotNull()).select(F.col(label_col).alias("label"), draw.alias("d")).distinct()
    counts = {r[0]: r[1] for r in different.groupBy("label").count().limit(MOST_LABELS + 1).collect()}
    if not counts:
        return None
    if len(counts) > MOST_LABELS:
        raise RuntimeError(f"more than {MOST_LABELS} labels")
    share = F.lit(None)
    for label, n in counts.items():
        share = F.when(F.col(label_col) == F.lit(label), F.lit(min(1.0, per_label / n))).otherwise(share)
    return rows.where(F.pmod(draw, F.lit(1 << 20)) < share * (1 << 20))


def sampled_texts(rows: DataFrame, label_col: str, text_col: str, id_col: str, per_label: int) -> DataFrame | None:
    """About ``per_label`` rows (label, i, t) of each label, saved; rows that repeat label, id and text are one."""
    rows = rows.select(F.col(label_col).cast("string").alias("label"), F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    picked = sampled(rows, "label", per_label, F.col("i"), F.col("t"))
    if picked is None:
        return None
    picked = saved(picked.groupBy("label", "i", F.xxhash64("t", F.char_length("t")).alias("h")).agg(F.first("t").alias("t")).drop("h"))
    most = picked.groupBy("label").count().agg(F.max("count").alias("n")).first()["n"] or 0
    if most > MOST * per_label:
        raise RuntimeError(f"{most} texts of a label were sampled where about {per_label} were expected")
    return picked


def sample_windows(picked: DataFrame | None, length: int, stride: int, per_label: int) -> list:
    """Rows (label, w) of windows, collected: of each label about ``per_label`` of all windows of the whole texts, chosen by a hash."""
    if picked is None:
        return []
    count = F.lit(1) + F.greatest(F.lit(0), F.ceil((F.octet_length("t") - length) / stride))
    share = {r["label"]: min(1.0, per_label / r["n"]) for r in picked.groupBy("label").agg(F.sum(count).alias("n")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, array in slices(batch, "t"):
                data, offsets = utf8(array)
                text, start, end = windows(offsets, length, stride)
                labels = rows.column("label").to_pylist()
                raw, part = memoryview(np.ascontiguousarray(data)), np.array([share[x] for x in labels])
                draw = mix(mix(hashes(array)[text]) + (start - offsets[text]).astype(np.uint64)) >> np.uint64(11)
                hit = np.flatnonzero(draw < part[text] * float(1 << 53)).tolist()
                cut = [bytes(raw[start[k] : min(end[k], start[k] + length)]) for k in hit]
                yield pa.RecordBatch.from_pydict({"label": pa.array([labels[text[k]] for k in hit], pa.string()), "w": pa.array(cut, pa.binary())})

    got = picked.mapInArrow(run, "label string, w binary").collect()
    return sorted(got, key=lambda r: (r["label"], bytes(r["w"])))


def learn(docs: DataFrame, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_label: int = SAMPLE_DOCS) -> tuple[list[str], Net | None]:
    """Languages and the network, from rows with a label; every row given may be learned from."""
    rows = sample_windows(sampled_texts(docs, label_col, text_col, id_col, per_label), LENGTH, LENGTH - 3, SAMPLE_WINDOWS)
    names = sorted({r["label"] for r in rows})
    if len(names) < 2:
        return names, None
    number = {n: k for k, n in enumerate(names)}
    x = padded([bytes(r["w"]) for r in rows], LENGTH)
    y = np.array([number[r["label"]] for r in rows])
    weight = (len(y) / len(names) / np.bincount(y, minlength=len(names)))[y]
    return names, Net(letter_classes(), len(names), length=LENGTH).fit(x, y, weight)


def identify(docs: DataFrame, model: tuple[list[str], Net | None], text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` added (replaced, where there are such)."""
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return judged(docs, model, text_col).select(*(F.col("_row")[c].alias(c) for c in columns), "lang_pred", "score")


def judged(docs: DataFrame, model: tuple[list[str], Net | None], text_col: str = "text") -> DataFrame:
    """``_row``, the row of ``docs`` as it is, ``lang_pred`` and ``score``: whatever the table's columns are called, they don't clash with these."""
    text_batches(docs.sparkSession)
    names, net = model

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        lang, score = [], []
        for _, array in slices(pa.RecordBatch.from_arrays([texts], ["t"]), "t"):
            data, offsets = utf8(array)
            text, start, end = windows(offsets, LENGTH, LENGTH - 3)
            logit = net.logits(data, start, end).astype(float)
            p = np.exp(logit - logit.max(1, keepdims=True))
            p *= (np.minimum(LENGTH, end - start) / p.sum(1))[:, None]
            total = np.add.reduceat(p, np.searchsorted(text, np.arange(len(array))), axis=0)
            total /= np.maximum(total.sum(1, keepdims=True), 1e-300)
            k = total.argmax(1)
            lang += [names[i] for i in k]
            score += total[np.arange(len(k)), k].tolist()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    text = F.col("_row")[text_col]
    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    if net is None:
        lang, score = F.when(letter, names[0] if names else UNKNOWN).otherwise(UNKNOWN), F.when(letter, float(bool(names))).otherwise(0.0)
    else:
        whole = whole.select("_row", predict(F.coalesce(text, F.lit(""))).alias("_p"))
        lang, score = F.when(letter, F.col("_p.lang_pred")).otherwise(UNKNOWN), F.when(letter, F.col("_p.score")).otherwise(0.0)
    return whole.select("_row", lang.alias("lang_pred"), score.alias("score"))
