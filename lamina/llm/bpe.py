"""BPE encoding by speculation, and decoding.

Speculate: every word is cut by greedy longest match against the vocabulary. Verify: a sequence of
tokens is the merge result exactly if each two neighbours, put together, would be merged back into
the same two; this is tested for all neighbours of all words at once by undoing merges at the
boundary. Only words with a failing pair are merged exactly. Ids equal those of the ``tokenizers``
library for files of this kind (NFC, lower case, split pattern, byte level, ``</w>``).

Defined results: null text counts as empty (no ids, empty decoded text); texts are taken whole;
rows are independent, so repeated rows get equal results; extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from lamina.llm.arrowtext import slices
from lamina.session import text_batches

_SYMBOL, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
#: Words kept from slice to slice in a worker; beyond this many the memory starts afresh.
CACHED_WORDS = 100_000
#: Bytes of text encoded at once; the arrays made of it take some thirty times as much.
ENCODED_BYTES = 2 << 20


class Lookup:
    """Non-negative integer keys to int32 values by an open-addressing table, for arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int32)
        slot, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], values[placed]
            rest = np.ones(len(keys), bool)
            rest[placed] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where there is none."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out


def _byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(odd)) for b in range(256)]


class Encoder:
    """Encoder of one vocabulary file; ``encode`` takes many texts at once."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        size = max(max(vocab.values()), *self.special.values(), 0) + 1
        names = [""] * size
        for name, i in [*vocab.items(), *self.special.items()]:
            names[i] = name
        self.names = pa.array(names)
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + "</w>"] for c in chars], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        if not (np.diff(made) > 0).all():
            raise ValueError("the file's merges are not in the order of their ids")
        self.pair = Lookup(left * size + right, made)
        self.merge = dict(zip((left * size + right).tolist(), made.tolist(), strict=True))
        self.size = size
        self.first, self.second = np.arange(size), np.arange(size)
        self.first[made], self.second[made] = left, right
        symbol = {c: b for b, c in enumerate(chars)}
        self._trie(vocab, symbol)
        self.classes = _classes()
        self.forget()

    def forget(self) -> None:
        """Drops the words kept so far."""
        self.known: dict[bytes, int] = {}
        self.flat, self.offsets = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64)

    def _trie(self, vocab: dict[str, int], symbol: dict[str, int]) -> None:
        """Edges of a trie over base symbols (byte, or byte + 256 at a word's end) of the tokens that their own merges reach."""
        order = sorted(vocab.items(), key=lambda x: x[1])
        sequences = []
        for name, i in order:
            end = name.endswith("</w>") and len(name) > 4
            s = [symbol[c] for c in (name[:-4] if end else name)]
            if end:
                s[-1] += 256
            sequences.append((i, s))
        edges: dict[int, int] = {}
        token = [-1]
        for i, s in sequences:
            base = [int(self.inner[x]) if x < 256 else int(self.last[x - 256]) for x in s]
            if self._merged(base) != [i]:
                continue
            node = 0
            for x in s:
                key = node * 512 + x
                if key not in edges:
                    edges[key] = len(token)
                    token.append(-1)
                node = edges[key]
            token[node] = i
        self.edges = Lookup(np.fromiter(edges.keys(), np.int64), np.fromiter(edges.values(), np.int64))
        self.token = np.array(token, np.int32)

    def _merged(self, ids: list[int]) -> list[int]:
        """Exact merging: again and again the pair of lowest id, the leftmost of equals."""
        merge, size = self.merge, self.size
        if len(ids) <= 24:
            ids = list(ids)
            while len(ids) > 1:
                best, at = min((merge.get(a * size + b, sys.maxsize), k) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False)))
                if best == sys.maxsize:
                    break
                ids[at : at + 2] = [best]
            return ids
        ids, after, before = list(ids), [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(m, k) for k in range(len(ids) - 1) if (m := merge.get(ids[k] * size + ids[k + 1]))]
        heapq.heapify(heap)
        while heap:
            m, k = heapq.heappop(heap)
            n = after[k]
            if ids[k] < 0 or n < 0 or merge.get(ids[k] * size + ids[n]) != m:
                continue
            ids[k], ids[n], after[k] = m, -1, after[n]
            if after[k] >= 0:
                before[after[k]] = k
                if x := merge.get(m * size + ids[after[k]]):
                    heapq.heappush(heap, (x, k))
            if before[k] >= 0 and (x := merge.get(ids[before[k]] * size + m)):
                heapq.heappush(heap, (x, before[k]))
        return [i for i in ids if i >= 0]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For arrays of neighbours: whether merging their joined symbols would keep them apart."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), self.size + 1, np.int64)
        good, at = np.ones(len(a), bool), np.arange(len(a))
        while len(at):
            made = self.pair(a * self.size + b)
            bad = (made >= 0) & (made < limit)
            good[at[bad]] = False
            a_inner, b_inner = self.second[a], self.first[b]
            undo_a = np.where(a > b, a_inner != a, b_inner == b)  # the later-made token, if it was made at all
            limit = np.where(undo_a, a, b + 1)
            over = (a_inner == a) & (b_inner == b)
            a, b = np.where(undo_a, a_inner, a), np.where(undo_a, b, b_inner)
            on = ~bad & ~over
            a, b, limit, at = a[on], b[on], limit[on], at[on]
        return good

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words (bytes and offsets, no empty word), flat, and each word's offsets."""
        lengths, n = np.diff(offsets), len(data)
        symbols = data.astype(np.int64)
        ends = np.repeat(offsets[1:], lengths)
        symbols[offsets[1:] - 1] += 256
        best, length = np.full(n, -1, np.int32), np.ones(n, np.int32)
        at, node, step = np.arange(n), np.zeros(n, np.int64), 0
        while len(at):
            node = self.edges(node * 512 + symbols[at + step]).astype(np.int64)
            on = node >= 0
            at, node = at[on], node[on]
            found = self.token[node]
            hit = found >= 0
            best[at[hit]], length[at[hit]] = found[hit], step + 1
            step += 1
            on = at + step < ends[at]
            at, node = at[on], node[on]
        chosen, place = np.zeros(n, bool), offsets[:-1].copy()
        short = lengths <= 256
        for w in np.flatnonzero(~short):
            p, end, jump = int(offsets[w]), int(offsets[w + 1]), length[offsets[w] : offsets[w + 1]].tolist()
            start = p
            while p < end:
                chosen[p] = True
                p += jump[p - start]
        place, stop = place[short], offsets[1:][short]
        while len(place):
            chosen[place] = True
            place = place + length[place]
            on = place < stop
            place, stop = place[on], stop[on]
        pos = np.flatnonzero(chosen)
        ids = best[pos]
        word = np.searchsorted(offsets, pos, "right") - 1
        same = np.flatnonzero(word[:-1] == word[1:])
        good = np.ones(len(lengths), bool)
        if len(same):
            codes, back = np.unique(ids[same].astype(np.int64) * self.size + ids[same + 1], return_inverse=True)
            fits = self.compatible(codes // self.size, codes % self.size)[back]
            good[word[same[~fits]]] = False
        counts = np.bincount(word, minlength=len(lengths))
        if good.all():
            return ids, np.concatenate(([0], np.cumsum(counts)))
        starts = np.concatenate(([0], np.cumsum(counts)))
        base = np.where(symbols < 256, self.inner[symbols & 255], self.last[symbols & 255])
        bad = np.flatnonzero(~good)
        lone = bad[lengths[bad] > 64]
        many = bad[lengths[bad] <= 64]
        redone = [(lone, [self._merged(base[offsets[w] : offsets[w + 1]].tolist()) for w in lone.tolist()])]
        flat, sizes = self._merged_together(base, offsets[many], lengths[many])
        sizes = np.concatenate((sizes, [len(x) for x in redone[0][1]])).astype(np.int64)
        flat = np.concatenate((flat, *(np.array(x, np.int64) for x in redone[0][1])))
        bad = np.concatenate((many, lone))
        counts[bad] = sizes
        out = np.empty(int(counts.sum()), np.int32)
        ends = np.concatenate(([0], np.cumsum(counts)))
        keep = np.repeat(good, np.diff(starts))
        out[np.repeat(good, counts)] = ids[keep]
        out[np.repeat(ends[bad] - np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes) + np.arange(len(flat))] = flat
        return out, ends

    def _merged_together(self, base: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many short words, one merge of each word a round; ids and their number for each word."""
        total = np.concatenate(([0], np.cumsum(lengths)))
        ids = base[np.repeat(starts - total[:-1], lengths) + np.arange(total[-1])].astype(np.int64)
        word = np.repeat(np.arange(len(lengths)), lengths)
        done_ids, done_word = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        none = np.iinfo(np.int32).max
        while len(ids):
            made = np.full(len(ids), none, np.int32)
            both = np.flatnonzero(word[:-1] == word[1:])
            found = self.pair(ids[both] * self.size + ids[both + 1])
            made[both] = np.where(found >= 0, found, none)
            begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            spans = np.diff(np.concatenate((begin, [len(ids)])))
            least = np.minimum.reduceat(made, begin)
            on = np.repeat(least < none, spans)
            done_ids.append(ids[~on])
            done_word.append(word[~on])
            at = np.flatnonzero((made == np.repeat(least, spans)) & on)
            at = at[np.concatenate(([True], word[at][1:] != word[at][:-1]))] if len(at) else at
            ids[at] = made[at]
            on[at + 1] = False
            ids, word = ids[on], word[on]
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(lengths))

    def _kept(self, distinct: list[bytes]) -> np.ndarray:
        """Numbers of the words in the memory; new ones are encoded first."""
        if len(self.known) > CACHED_WORDS:
            self.forget()
        known = self.known
        new = [w for w in distinct if w not in known]
        if new:
            ids, offsets = self.words(np.frombuffer(b"".join(new), np.uint8), np.concatenate(([0], np.cumsum([len(w) for w in new]))))
            n = len(known)
            start = int(self.offsets[n])
            while start + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            while n + len(new) + 1 > len(self.offsets):
                self.offsets = np.concatenate((self.offsets, np.zeros_like(self.offsets)))
            self.flat[start : start + len(ids)] = ids
            self.offsets[n + 1 : n + len(new) + 1] = start + offsets[1:]
            known.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one int32 array, and the offsets of each text's ids."""
        units, owner, fixed = [], [], []
        for k, text in enumerate(texts):
            if self._special and "<|" in text and self._special.search(text):
                last = 0
                for m in self._special.finditer(text):
                    units += [text[last : m.start()], ""]
                    fixed += [-1, self.special[m.group()]]
                    owner += [k, k]
                    last = m.end()
                text = text[last:]
            units.append(text)
            fixed.append(-1)
            owner.append(k)
        units = [_normal(u) for u in units]
        joined = "\n".join(units)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ids, counts = self._encode_points(points, np.cumsum([len(u) + 1 for u in units]))
        fixed_at = [k for k, f in enumerate(fixed) if f >= 0]
        if fixed_at:
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends[fixed_at], [fixed[k] for k in fixed_at])
            counts[fixed_at] = 1
        per = np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64) if texts else np.zeros(0, np.int64)
        return ids, np.concatenate(([0], np.cumsum(per)))

    def _encode_points(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of code points of joined units, and the number of ids of each unit (unit k ends before ends[k])."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        kind = self.classes[points]
        start = np.empty(n, bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == _NUMBER
        quote = np.flatnonzero((points == 0x27) & start)
        if len(quote):
            after = np.concatenate((points, np.zeros(3, np.uint32)))
            one, two = after[quote + 1], after[quote + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for hit, size in ((short, 2), (long & ~short, 3)):
                at = quote[hit]
                start[at + 1] = False
                start[(at + size)[at + size < n]] = True
        at = np.flatnonzero(start)
        kinds = kind[at]
        size = np.ones(n, np.int64)
        if (points >= 0x80).any():
            size += (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            place = np.concatenate(([0], np.cumsum(size)))
            offsets = np.concatenate((place[at], place[-1:]))
            data = points.tobytes().decode("utf-32-le").encode()
        else:
            offsets = np.concatenate((at, [n]))
            data = points.astype(np.uint8).tobytes()
        flat = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        d = flat.dictionary_encode()
        codes = np.asarray(d.indices)
        space = kinds == _SPACE
        number = self._kept(d.dictionary.to_pylist()) if len(d.dictionary) else np.zeros(0, np.int64)
        word = number[codes[~space]]
        unit = np.searchsorted(ends, at[~space], "right")
        lengths = self.offsets[word + 1] - self.offsets[word]
        total = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.flat[np.repeat(self.offsets[word] - total[:-1], lengths) + np.arange(total[-1])]
        return ids, np.bincount(unit, weights=lengths, minlength=len(ends)).astype(np.int64)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of the ids between the offsets, as the library decodes files without a decoder: names with a space between."""
        names = self.names.take(pa.array(ids))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names), " ")


def _normal(text: str) -> str:
    """NFC and lower case, one character at a time (a final sigma is no special case)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        for m in regex.finditer(pattern, every):
            gap = [x + 0x800 if x >= 0xD800 else x for x in (m.start(), m.end() - 1)]
            out[gap[0] : gap[1] + 1] = kind
    return out


@functools.cache
def encoder(path: str) -> Encoder:
    """The encoder of a file, one for each worker process."""
    return Encoder(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str, id_col: str, text_col: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Of each run of rows: its id column, all ids, and the offsets of each row's ids."""
    enc = encoder(path)
    for batch in batches:
        for rows, array in slices(batch, text_col, ENCODED_BYTES):
            yield rows.column(id_col), *enc.encode(array.to_pylist())


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_tokens``, ``ids_sha256``, ``decoded``'s ``decoded_sha256``,
    and, if ``with_ids``, ``ids`` and ``decoded`` themselves.

    ``path`` names the vocabulary file; it must be there on every machine.
    """
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for key, ids, offsets in encoded(batches, path, id_col, text_col):
            raw = memoryview(ids.astype("<u4").tobytes())
            text = enc.decode(ids, offsets)
            cut = offsets.tolist()
            cols = {
                id_col: key,
                "n_tokens": pa.array(np.diff(offsets)),
                "ids_sha256": pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(cut, cut[1:], strict=False)]),
                "decoded_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in text.cast(pa.binary()).to_pylist()]),
            }
            if with_ids:
                cols |= {"ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)), "decoded": text}
            yield pa.RecordBatch.from_pydict(cols)

    more = ", ids array<int>, decoded string" if with_ids else ""
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def crc32_le(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
