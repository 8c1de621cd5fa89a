"""A subword language model that sums over all segmentations.

A text is its words, in lower case, and an end. The lattice of a word, with a mark at its front,
has an arc for every piece of an existing vocabulary that fits; a word's probability is the sum
over every way through, found by a forward recursion in log space. Pieces are drawn independently:
one with the mark begins a word, then pieces without follow until the word is over, which each
piece has a probability for. No arc reaches over a word's front, so a text's log probability is
the sum of its words' and the end's, and all texts' probabilities sum to one. The vocabulary's
scores weigh the pieces: a file of log probabilities as they are, a file of ranks by one over the
rank. From there the weights are re-estimated by expectation and maximisation over the lattices of
all training words, each with its count, where the scores' weights stay as ``PRIOR`` uses. Single
bytes are pieces too, so that every text has a probability.

Words are counted over all training texts. To look counts and lattices up without shuffling every
token, texts are held in chunks: a chunk has a dictionary of its distinct words, and its texts are
lists of places in it; counts and word probabilities meet the dictionaries, not the tokens.

Defined results: a null text counts as empty and is the end alone; with nothing to train on,
counts are 0 and the model keeps its starting probabilities, with an end after every thousandth word; repeated rows are scored each, and
each counts in training; extra columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.arrowtext import coded, slices, tidy, utf8, words
from lamina.llm.bpe import Lookup
from lamina.session import saved, text_batches

#: Bytes of text in a chunk, about.
CHUNK_BYTES = 12 << 20
#: Distinct words whose lattices are built at once.
BLOCK_WORDS = 6_000
#: Tokens scored at once.
BLOCK_TOKENS = 200_000
ROUNDS = 3
#: Uses that the vocabulary's own weights count for beside those in training texts.
PRIOR = 1000
_MARK = 0x20


def vocabulary(path: str) -> list[tuple[bytes, float]]:
    """Pieces of a sentencepiece file as bytes, with a space for the word mark, and their scores; pieces with a mark inside are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {bytes([b]): -math.inf for b in range(256)}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        piece = sp.id_to_piece(i).replace("▁", " ").encode()
        if piece and b" " not in piece[1:]:
            out[piece] = max(out.get(piece, -math.inf), sp.get_score(i))
    return list(out.items())


class Lattice:
    """The pieces as a trie, for lattices of many words at once."""

    def __init__(self, path: str) -> None:
        pieces = vocabulary(path)
        self.n = len(pieces)
        scores = np.array([s for _, s in pieces])
        rank = np.empty(self.n)
        rank[np.argsort(-scores, kind="stable")] = np.arange(self.n)
        ranks = np.isfinite(scores).any() and (scores[np.isfinite(scores)] == np.round(scores[np.isfinite(scores)])).all()
        use = 1 / (rank + 10) if ranks else np.where(np.isfinite(scores), np.exp(np.maximum(scores, -30)), 1e-9)
        self.front = np.array([p[0] == _MARK for p, _ in pieces])
        self.prior = PRIOR * use / use.sum()
        self.start = self.weights(np.zeros(self.n), np.zeros(self.n))
        edges: dict[int, int] = {}
        at = [-1]
        for k, (piece, _) in enumerate(pieces):
            node = 0
            for b in piece:
                key = node << 8 | b
                if key not in edges:
                    edges[key] = len(at)
                    at.append(-1)
                node = edges[key]
            at[node] = k
        self.edges = Lookup(np.fromiter(edges.keys(), np.int64), np.fromiter(edges.values(), np.int64))
        self.piece = np.array(at, np.int32)

    def weights(self, uses: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Log weights of a piece inside a word and at its end, (2, pieces), from numbers of uses and of uses at a word's end."""
        uses, last = uses + self.prior, last + self.prior / 2
        p = np.log(uses / np.where(self.front, uses[self.front].sum(), uses[~self.front].sum()))
        return np.stack((p + np.log1p(-last / uses), p + np.log(last / uses)))

    def arcs(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes' offsets for each word (one more node than bytes), and of all arcs: from, to, piece. The mark is put before each word."""
        data, offsets = utf8(distinct.cast(pa.large_string()))
        n = len(offsets) - 1
        lengths = np.diff(offsets) + 1
        begin = np.concatenate(([0], np.cumsum(lengths)))
        text = np.full(begin[-1], _MARK, np.int64)
        body = np.ones(len(text), bool)
        body[begin[:-1]] = False
        text[body] = data
        end = np.repeat(begin[1:], lengths)
        shift = np.repeat(np.arange(n), lengths)  # each word has one node more than bytes
        at, node, step = np.arange(len(text)), np.zeros(len(text), np.int64), 0
        source, target, piece = [], [], []
        while len(at):
            node = self.edges(node << 8 | text[at + step]).astype(np.int64)
            on = node >= 0
            at, node = at[on], node[on]
            found = self.piece[node]
            hit = found >= 0
            source.append(at[hit] + shift[at[hit]])
            target.append(at[hit] + shift[at[hit]] + step + 1)
            piece.append(found[hit])
            step += 1
            on = at + step < end[at]
            at, node = at[on], node[on]
        return begin + np.arange(n + 1), *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (source, target, piece))

    @staticmethod
    def _sweep(value: np.ndarray, near: np.ndarray, far: np.ndarray, weight: np.ndarray, level: np.ndarray) -> None:
        """value[near] becomes the log of the sum of exp(value[far] + weight), level by level."""
        order = np.lexsort((near, level))
        near, far, weight, level = near[order], far[order], weight[order], level[order]
        cut = np.flatnonzero(np.concatenate(([True], level[1:] != level[:-1]))).tolist() + [len(level)] if len(level) else [0]
        first = np.concatenate(([True], near[1:] != near[:-1])) if len(near) else np.zeros(0, bool)
        for a, b in zip(cut, cut[1:], strict=False):
            v = value[far[a:b]] + weight[a:b]
            s = np.flatnonzero(first[a:b])
            top = np.maximum.reduceat(v, s)
            sizes = np.diff(np.append(s, b - a))
            value[near[a:b][s]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, sizes)), s))

    def forward(self, distinct: pa.Array, logp: np.ndarray) -> np.ndarray:
        """Natural log probability of each word, under weights (2, pieces)."""
        out = []
        for a in range(0, len(distinct), BLOCK_WORDS):
            begin, source, target, piece = self.arcs(distinct.slice(a, BLOCK_WORDS))
            alpha = np.zeros(begin[-1])
            head = np.repeat(begin[:-1], np.diff(begin))
            final = target == np.repeat(begin[1:] - 1, np.diff(begin))[source]
            self._sweep(alpha, target, source, logp[final.astype(np.int8), piece], target - head[target])
            out.append(alpha[begin[1:] - 1])
        return np.concatenate(out) if out else np.zeros(0)

    def expected(self, distinct: pa.Array, counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, inside words and at their ends, (2, pieces); each word is taken ``counts`` times."""
        total = np.zeros(2 * self.n)
        for a in range(0, len(distinct), BLOCK_WORDS):
            begin, source, target, piece = self.arcs(distinct.slice(a, BLOCK_WORDS))
            spans = np.diff(begin)
            head = np.repeat(begin[:-1], spans)
            tail = np.repeat(begin[1:] - 1, spans)
            final = (target == tail[source]).astype(np.int64)
            alpha, beta, weight = np.zeros(begin[-1]), np.zeros(begin[-1]), logp[final, piece]
            self._sweep(alpha, target, source, weight, target - head[target])
            self._sweep(beta, source, target, weight, tail[source] - source)
            times = np.repeat(counts[a : a + BLOCK_WORDS], spans)
            whole = np.repeat(alpha[begin[1:] - 1], spans)
            total += np.bincount(piece + self.n * final, np.exp(alpha[source] + weight + beta[target] - whole[source]) * times[source], 2 * self.n)
        return total.reshape(2, -1)


@functools.cache
def lattice(path: str) -> Lattice:
    """The lattice builder of a vocabulary, one for each process."""
    return Lattice(path)


def chunked(docs: DataFrame, id_col: str, text_col: str, held: Column) -> DataFrame:
    """Texts in chunks: rows with ``words`` and ``counts`` are a chunk's dictionary (counts in training texts), rows without are texts, as ``codes`` of its words."""
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), held.alias("held"))

    def flush(chunk: int, parts: list) -> Iterator[pa.RecordBatch]:
        every, distinct = coded(pa.concat_arrays([p[3].cast(pa.string()) for p in parts]))
        starts = np.cumsum([0] + [len(p[3]) for p in parts])
        counts = np.zeros(len(distinct), np.int64)
        for (ids, held, codes, own, offsets), s in zip(parts, starts[:-1], strict=True):
            codes = every[s : s + len(own)][codes]
            train = np.repeat(~np.asarray(held), np.diff(offsets))
            counts += np.bincount(codes[train], minlength=len(counts))
            n = len(ids)
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array(np.full(n, chunk)),
                    "id": ids,
                    "held": held,
                    "codes": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(codes.astype(np.int32))),
                    "words": pa.nulls(n, pa.list_(pa.string())),
                    "counts": pa.nulls(n, pa.list_(pa.int64())),
                }
            )
        one = pa.array([0, len(distinct)], pa.int32())
        yield pa.RecordBatch.from_pydict(
            {
                "chunk": pa.array([chunk], pa.int64()),
                "id": pa.nulls(1, parts[0][0].type),
                "held": pa.nulls(1, pa.bool_()),
                "codes": pa.nulls(1, pa.list_(pa.int32())),
                "words": pa.ListArray.from_arrays(one, distinct.cast(pa.string())),
                "counts": pa.ListArray.from_arrays(one, pa.array(counts)),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for rows, array in slices(batch, "t"):
                flat, offsets = words(array)
                codes, distinct = coded(flat)
                parts.append((rows.column("id"), rows.column("held"), codes.astype(np.int32), distinct, offsets))
                size += int(np.asarray(pc.sum(pc.binary_length(array)).as_py() or 0)) + 16 * len(rows)
                if size >= CHUNK_BYTES:
                    yield from flush(chunk, parts)
                    chunk, parts, size = chunk + 1, [], 0
        if parts:
            yield from flush(chunk, parts)

    return kept.mapInArrow(run, f"chunk long, id {kind}, held boolean, codes array<int>, words array<string>, counts array<long>")


def train(counted: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Natural log weights (2, pieces) from the distinct words of ``counted(word, c)`` with a count.

    Each round gathers the expected count of every piece over all words and their counts: two numbers for each piece
    of the vocabulary are what reaches the driver.
    """
    lat = lattice(path)
    logp = lat.start
    for _ in range(rounds):
        sent = logp

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine, total = lattice(path), np.zeros(0)
            for batch in batches:
                found = mine.expected(batch.column("word"), np.asarray(batch.column("c"), float), sent).ravel()
                total = total + found if len(total) else found
            k = np.flatnonzero(total)
            tidy()
            yield pa.RecordBatch.from_pydict({"piece": pa.array(k.astype(np.int32)), "e": pa.array(total[k])})

        got = counted.where("c > 0").select("word", "c").mapInArrow(run, "piece int, e double").groupBy("piece").agg(F.sum("e").alias("e")).collect()
        expected = np.zeros(2 * lat.n)
        for r in got:
            expected[r["piece"]] += r["e"]
        logp = lat.weights(expected.reshape(2, -1).sum(0), expected[lat.n :])
    return logp


def score_documents(docs: DataFrame, path: str, held: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Of every row: its id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Rows where ``held`` is false are trained on. ``base_score`` is that of a unigram model of words
    with 0.1 added to each count.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    chunks = saved(chunked(docs, id_col, text_col, held))
    texts = chunks.where("words is null").select("chunk", "id", "held", "codes")
    local = chunks.where("words is not null").select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    counted = saved(local.groupBy("word").agg(F.sum("c").alias("c")))
    seen = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n_texts = texts.where("not held").count()
    total, distinct = seen["n"] + n_texts, seen["v"] + (n_texts > 0)
    logp = train(counted, path, rounds)
    ends = n_texts / total if n_texts else 0.001
    end, more = math.log10(ends), math.log10(max(1 - ends, 1e-9))
    floor = 0.1 / (total + 0.1 * (distinct + 1))
    scale = floor / 0.1
    end_base = math.log10((n_texts + 0.1) * scale)

    def word_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = lattice(path)
        for batch in batches:
            lp = mine.forward(batch.column("word"), logp) / math.log(10) + more
            yield pa.RecordBatch.from_pydict({"word": batch.column("word"), "c": batch.column("c"), "lp": pa.array(lp)})
            tidy()

    scored = counted.mapInArrow(word_scores, "word string, c long, lp double")

    def score(own: pa.Table, dictionary: pa.Table) -> pa.Table:
        codes = own.column("codes").combine_chunks()
        offsets, flat = np.asarray(codes.offsets, np.int64), np.asarray(codes.values)
        place = np.asarray(dictionary.column("place"))
        size = int(place.max()) + 1 if len(place) else 0
        c, lp = np.zeros(size, np.int64), np.zeros(size)
        c[place], lp[place] = np.asarray(dictionary.column("c")), np.asarray(dictionary.column("lp"))
        n = len(offsets) - 1
        known, base, total_lp = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        one = np.log10((c + 0.1) * scale)
        start = 0
        while start < n:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BLOCK_TOKENS, "right")) - 1)
            at = flat[offsets[start] : offsets[stop]]
            text = np.repeat(np.arange(stop - start), np.diff(offsets[start : stop + 1]))
            known[start:stop] = np.bincount(text, c[at] > 0, stop - start).astype(np.int64)
            base[start:stop] = np.bincount(text, one[at], stop - start)
            total_lp[start:stop] = np.bincount(text, lp[at], stop - start)
            start = stop
        tidy()
        return pa.table(
            {
                id_col: own.column("id"),
                "held_out": own.column("held"),
                "n_tokens": pa.array(np.diff(offsets) + 1),
                "n_known": pa.array(known + int(n_texts > 0)),
                "train_tokens": pa.array(np.full(n, total, np.int64)),
                "base_score": pa.array(base + end_base),
                "score": pa.array(total_lp + end),
            }
        )

    placed = chunks.where("words is not null").select("chunk", F.posexplode("words").alias("place", "word")).join(scored, "word").select(F.col("chunk").alias("of"), "place", "c", "lp")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunks.where("words is not null").count())
    texts, placed = texts.repartition(parts, "chunk"), placed.repartition(parts, "of")  # tasks grow in number with the input, not in size
    schema = f"{id_col} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("chunk").cogroup(placed.groupBy("of")).applyInArrow(score, schema)
