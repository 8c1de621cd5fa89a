"""Quality classification by a byte-level convolutional network.

Filters look at overlapping chunks that cover the whole document; each chunk's largest responses
give a chunk logit, and a logistic layer combines the mean, the least and the largest chunk logit
of a document into one probability of label 1. Both are learned from a bounded sample of labelled
rows, about ``SAMPLE_DOCS`` of each label: the filters from about ``SAMPLE_CHUNKS`` of each label's
chunks, chosen by a hash among all of them, the layer from all chunks of all sampled documents.

Defined results: a null text is scored as an empty one; without labels to learn from every score is
0.5, with labels of one kind only it is that label's 0 or 1; repeated rows get equal results; null
labels are not learned; extra columns are not read by the model; an empty table gives no rows; of
documents that repeat an id all different texts may be learned from. A sample of over ``MOST`` times the
labels or texts that are expected is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.arrowtext import slices, utf8
from lamina.llm.bytecnn import Net, padded, shape_classes, windows
from lamina.llm.langid import MOST, sample_windows, sampled, sampled_texts
from lamina.session import text_batches

LENGTH, STRIDE = 384, 320
SAMPLE_DOCS, SAMPLE_CHUNKS = 1500, 6000


class Quality:
    """The network and the layer over a document's chunk logits; or a constant."""

    def __init__(self, net: Net | None = None, constant: float = 0.5) -> None:
        self.net, self.constant, self.weights = net, constant, np.zeros(4)

    @staticmethod
    def features(logit: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """Mean, least and largest chunk logit of each text, and 1."""
        first = np.searchsorted(text, np.arange(n))
        count = np.bincount(text, minlength=n)
        logit = np.clip(logit, -12, 12)
        return np.stack((np.add.reduceat(logit, first) / count, np.minimum.reduceat(logit, first), np.maximum.reduceat(logit, first), np.ones(n)), 1)

    def combine(self, f: np.ndarray, y: np.ndarray) -> None:
        """Newton steps for the weights of the features."""
        for _ in range(25):
            p = 1 / (1 + np.exp(-f @ self.weights))
            h = (f * (p * (1 - p))[:, None]).T @ f + 1e-2 * len(y) * np.diag([1e-2, 1e-2, 1e-2, 1e-4])
            self.weights = self.weights + np.linalg.solve(h, f.T @ (y - p) - 1e-2 * len(y) * np.array([1e-2, 1e-2, 1e-2, 1e-4]) * self.weights)

    def figures(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The features of texts, from all of their chunks."""
        text, start, end = windows(offsets, LENGTH, STRIDE)
        return self.features(self.net.logits(data, start, end)[:, 0].astype(float), text, len(offsets) - 1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.net is None:
            return np.full(len(offsets) - 1, self.constant)
        return 1 / (1 + np.exp(-self.figures(data, offsets) @ self.weights))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id", per_label: int = SAMPLE_DOCS) -> Quality:
    """A model from the documents that ``labels`` has a label 0 or 1 for; every label given may be learned from.

    Only the sampled labels, whose number is checked, meet the documents; the layer gets three
    numbers of each sampled document.
    """
    labels = labels.select(id_col, F.col(label_col).alias("label")).where(F.col("label").isin(0, 1)).distinct()
    picked = sampled(labels, "label", per_label, F.col(id_col))
    few = picked.select(id_col, "label").collect() if picked is not None else []
    if len(few) > 2 * MOST * per_label:
        raise RuntimeError(f"{len(few)} labels were sampled where about {2 * per_label} were expected")
    if not few:
        return Quality()
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in few], picked.schema).withColumnRenamed(id_col, "_id")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "_id")
    texts = sampled_texts(rows, "label", "t", "_id", per_label)
    windowed = sample_windows(texts, LENGTH, STRIDE, SAMPLE_CHUNKS)
    y = np.array([int(r["label"]) for r in windowed])
    if len(set(y.tolist())) < 2:
        return Quality(None, float(y[0]) if len(y) else 0.5)
    weight = (len(y) / 2 / np.bincount(y, minlength=2))[y]
    model = Quality(Net(shape_classes(), 1, length=LENGTH, seed=5).fit(padded([bytes(r["w"]) for r in windowed], LENGTH), y, weight, steps=700, batch=64))

    @F.arrow_udf("array<double>")
    def chunk_figures(column: pa.Array) -> pa.Array:
        found = [model.figures(*utf8(array))[:, :3] for _, array in slices(pa.RecordBatch.from_arrays([column], ["t"]), "t")]
        flat = np.concatenate(found) if found else np.zeros((0, 3))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * 3, pa.int32()), pa.array(flat.ravel()))

    got = sorted(texts.select("label", chunk_figures("t").alias("f")).collect(), key=lambda r: (r["label"], r["f"]))
    f = np.array([r["f"] for r in got])
    model.combine(np.column_stack((f, np.ones(len(f)))), np.array([float(r["label"]) for r in got]))
    return model


def score(docs: DataFrame, model: Quality, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score`` added (replaced, where there is one)."""
    text_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        out = [model.score(*utf8(array)) for _, array in slices(pa.RecordBatch.from_arrays([texts], ["t"]), "t")]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn("score", probability(F.coalesce(F.col(text_col), F.lit(""))))
