"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text is cut where no piece can cross: before a run of spaces, around line breaks, and between two characters that
stand side by side in no piece, so that texts without spaces fall into short parts too. Distinct parts of the same
length advance together through the lattice; substrings are found by hash in the sorted keys of the pieces, and a
vectorised maximum keeps for each end the best score and the piece that reaches it. Where few parts have a length, the
substrings of each are still found together, and only the maxima are taken one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm import textbatch as tb

MARK = 0x2581
#: Fixed value of the library: a character without a piece scores this much less than the worst piece.
UNKNOWN_PENALTY = 10.0
CHUNK = 1 << 20
_B = 0x9E3779B97F4A7C15 | 1
_UP = np.array([pow(_B, i, 2**64) for i in range(512)], np.uint64)
_DOWN = np.array([pow(pow(_B, -1, 2**64), i, 2**64) for i in range(512)], np.uint64)
_FILTER = 20
#: Up to so many parts of one length are searched one by one.
FEW = 32


def _points(chars: np.ndarray) -> np.ndarray:
    return tb.mix(chars.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(0x63))


def _key(h: np.ndarray, size: int) -> np.ndarray:
    return tb.mix(h + np.uint64(size * 0xA0761D6478BD642F % 2**64))


@dataclass
class PieceModel:
    """Pieces and scores of a model file, as what tasks need: sorted keys, ids, scores and the bytes of each id."""

    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray  # by position in keys
    longest: int
    unknown: float
    byte_ids: np.ndarray | None
    unk_id: int
    surface: list[bytes]
    seen: np.ndarray = field(repr=False, default=None)
    pairs: np.ndarray = field(repr=False, default=None)  # neighbours in pieces, sorted: first << 21 | second
    single: np.ndarray = field(repr=False, default=None)  # characters that are pieces, sorted
    lengths: np.ndarray = field(repr=False, default=None)  # characters of each id's piece

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with identity normalisation and a dummy prefix are supported")
        return cls.build([(p.piece, p.score, p.type) for p in proto.pieces], bool(proto.trainer_spec.byte_fallback))

    @classmethod
    def build(cls, pieces: list[tuple[str, float, int]], byte_fallback: bool = True) -> PieceModel:
        """pieces: (text, score, type) by id; types as in model files: 1 normal, 2 unknown, 3 control, 4 user defined, 6 byte."""
        normal = [(i, p, s) for i, (p, s, t) in enumerate(pieces) if t in (1, 4) and p]
        if any(chr(MARK) in p.lstrip(chr(MARK)) or ("\n" in p and len(p) > 1) for _, p, _ in normal):
            raise ValueError("a piece crosses a word's border")
        keys = np.zeros(len(normal), np.uint64)
        for k, (_, p, _) in enumerate(normal):
            c = np.frombuffer(p.encode("utf-32-le"), np.uint32)
            keys[k] = _key(np.array([(_points(c) * _UP[: len(c)]).sum(dtype=np.uint64)]), len(c))[0]
        order = np.argsort(keys)
        keys = keys[order]
        if (keys[1:] == keys[:-1]).any():
            raise ValueError("two pieces have one key")
        seen = np.zeros(1 << _FILTER, bool)
        seen[(keys >> np.uint64(64 - _FILTER)).astype(np.int64)] = True
        at = {p: i for i, (p, _, t) in enumerate(pieces) if t == 6}
        surface = [bytes([int(p[3:5], 16)]) if t == 6 else b"" if t == 3 else " ⁇ ".encode() if t == 2 else p.replace(chr(MARK), " ").encode() for p, _, t in pieces]
        scores = np.array([s for _, _, s in normal], np.float64)
        chars = [np.frombuffer(p.encode("utf-32-le"), np.uint32).astype(np.int64) for _, p, _ in normal]
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(c[:-1] << 21 | c[1:] for c in chars if len(c) > 1)]))
        single = np.unique(np.array([c[0] for c in chars if len(c) == 1], np.int64))
        lengths = np.array([len(p) for p, _, _ in pieces], np.int64)
        return cls(keys, np.array([i for i, _, _ in normal], np.int32)[order], scores[order], max((len(p) for _, p, _ in normal), default=1), float(scores.min() if len(scores) else 0) - UNKNOWN_PENALTY, np.array([at[f"<0x{b:02X}>"] for b in range(256)], np.int32) if byte_fallback else None, next((i for i, (_, _, t) in enumerate(pieces) if t == 2), 0), surface, seen, pairs, single, lengths)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Position in ``keys``, or -1."""
        out = np.full(len(key), -1, np.int64)
        maybe = np.flatnonzero(self.seen[(key >> np.uint64(64 - _FILTER)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == key[maybe], at, -1)
        return out

    def search(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """chars: (words, length) code points. Ids right-aligned in (words, length), -1 for unknown characters, and their counts.

        Of equal scores the path whose last piece starts first is kept.
        """
        n, size = chars.shape
        if n <= FEW and size > 8:
            return self._search_few(chars)
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        piece, length = np.full((size + 1, n), -1, np.int64), np.ones((size + 1, n), np.int32)
        points = _points(chars.T)
        for i in range(size):
            h = np.zeros(n, np.uint64)
            for m in range(1, min(self.longest, size - i) + 1):
                h += points[i + m - 1] * _UP[m - 1]
                at = self.find(_key(h, m))
                if m == 1:
                    rows = slice(None)
                    score = best[i] + np.where(at >= 0, self.scores[at], self.unknown)
                    better = np.flatnonzero(score > best[i + 1])
                    best[i + 1, better], piece[i + 1, better], length[i + 1, better] = score[better], at[better], 1
                    continue
                rows = np.flatnonzero(at >= 0)
                if not len(rows):
                    continue
                score = best[i, rows] + self.scores[at[rows]]
                up = score > best[i + m, rows]
                rows = rows[up]
                best[i + m, rows], piece[i + m, rows], length[i + m, rows] = score[up], at[rows], m
        out, count = np.zeros((n, size), np.int32), np.zeros(n, np.int64)
        pos, rows = np.full(n, size), np.arange(n)
        while len(rows):
            at = piece[pos[rows], rows]
            count[rows] += 1
            out[rows, size - count[rows]] = np.where(at >= 0, self.ids[at], -1)
            pos[rows] -= length[pos[rows], rows]
            rows = rows[pos[rows] > 0]
        return out, count

    def _search_few(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, word by word: linear in the pieces that occur."""
        n, size = chars.shape
        out, count = np.zeros((n, size), np.int32), np.zeros(n, np.int64)
        for r in range(n):
            points, h = _points(chars[r]), np.zeros(size, np.uint64)
            starts, ends, at = [], [], []
            for m in range(1, min(self.longest, size) + 1):
                h = h[: size - m + 1] + points[m - 1 :] * _UP[m - 1]
                got = self.find(_key(h, m))
                hit = np.arange(size) if m == 1 else np.flatnonzero(got >= 0)
                starts.append(hit)
                ends.append(hit + m)
                at.append(got[hit])
            starts, ends, at = (np.concatenate(x) for x in (starts, ends, at))
            order = np.lexsort((ends, starts))
            score = np.where(at >= 0, self.scores[at], self.unknown)
            best, via = [0.0] + [-np.inf] * size, [0] * (size + 1)
            for k, i, j, s in zip(order.tolist(), starts[order].tolist(), ends[order].tolist(), score[order].tolist(), strict=True):
                if best[i] + s > best[j]:
                    best[j], via[j] = best[i] + s, k
            j, path = size, []
            while j:
                path.append(via[j])
                j = int(starts[via[j]])
            count[r] = len(path)
            ids = at[path[::-1]]
            out[r, size - len(path) :] = np.where(ids >= 0, self.ids[ids], -1)
        return out, count

    def _parts(self, chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bounds of words and of their parts: a cut lies between characters that are neighbours in no piece."""
        if len(chars) < 2:
            return bounds
        c = chars.astype(np.int64)
        inside = lambda table, x: table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x if len(table) else np.zeros(len(x), bool)
        cut = ~inside(self.pairs, c[:-1] << 21 | c[1:])
        if self.byte_ids is None:  # a run of unknown characters is one token and stays whole
            known = inside(self.single, c)
            cut &= known[:-1] | known[1:]
        return np.union1d(bounds, np.flatnonzero(cut) + 1)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words data[start:end] (UTF-8, spaces as marks), one run after another, and how many each has."""
        n_bytes = ends - starts
        raw = data[tb.gather(starts, n_bytes)]
        chars = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        chars = np.where(chars == 32, np.uint32(MARK), chars)
        lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        bounds = lead[np.concatenate([[0], np.cumsum(n_bytes)])]
        words, bounds = bounds, self._parts(chars, bounds)
        sizes, counts = np.diff(bounds), np.zeros(len(bounds) - 1, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            for low in range(0, len(rows), max(1, (1 << 20) // int(size))):
                part = rows[low : low + max(1, (1 << 20) // int(size))]
                ids, count = self.search(chars[bounds[part][:, None] + np.arange(size)])
                keep = np.arange(size) >= (size - count)[:, None]
                flat, owner = ids[keep], np.repeat(part, count)
                if (flat < 0).any():
                    flat, owner, count = self._spell(flat, owner, count, chars, bounds, part)
                counts[part] = count
                found.append((owner, flat))
        owner, flat = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        return flat[np.argsort(owner, kind="stable")], np.add.reduceat(counts, np.searchsorted(bounds, words[:-1])) if len(starts) else counts

    def _spell(self, flat, owner, count, chars, bounds, part):
        """Unknown characters (-1) as their bytes, or, without byte pieces, runs of them as the unknown id."""
        first = np.cumsum(count) - count
        if self.byte_ids is None:
            again = (flat[1:] < 0) & (flat[:-1] < 0) & (owner[1:] == owner[:-1])
            keep = np.concatenate([[True], ~again])
            return np.where(flat < 0, np.int32(self.unk_id), flat)[keep], owner[keep], np.add.reduceat(keep.astype(np.int64), first)
        length = np.where(flat < 0, 1, self.lengths[flat])
        at = np.cumsum(length) - length
        c = chars[bounds[owner] + at - np.repeat(at[first], count)].astype(np.int64)
        n = np.where(flat < 0, 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000), 1)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        c, of, flat, owner = (np.repeat(x, n) for x in (c, n, flat, owner))
        low = c >> (6 * (of - 1 - k))
        byte = np.where(of == 1, c, np.where(k == 0, np.array([0, 0, 0xC0, 0xE0, 0xF0])[of] | low, 0x80 | (low & 0x3F)))
        return np.where(flat < 0, self.byte_ids[byte & 255], flat), owner, np.add.reduceat(n, first)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, one run after another, how many each text has, and whether its ids spell it again."""
        n = len(offsets) - 1
        filled = np.diff(offsets) > 0
        shift = np.concatenate([[0], np.cumsum(filled)])
        text = np.full(len(data) + int(shift[-1]), 32, np.uint8)
        text[np.arange(len(data)) + np.repeat(shift[1:], np.diff(offsets))] = data
        off = offsets + shift
        space, line = text == 32, text == 10
        cut = line.copy()
        cut[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        cut[off[:-1][filled]] = True
        starts = np.flatnonzero(cut)
        ends = np.concatenate([starts[1:], [len(text)]]) if len(starts) else starts
        s, e, which = tb.distinct_spans(text, starts, ends)
        ids, counts = self.words(text, s, e)
        at = np.cumsum(counts) - counts
        # a distinct word's pieces must spell its bytes
        sizes = np.array([len(x) for x in self.surface])
        spelt = np.add.reduceat(sizes[ids], at) == e - s if len(s) else np.zeros(0, bool)
        if len(s):
            same = b"".join([self.surface[x] for x in ids])
            if same != text[tb.gather(s, e - s)].tobytes():
                for w in range(len(s)):
                    spelt[w] = b"".join(self.surface[x] for x in ids[at[w] : at[w] + counts[w]]) == text[s[w] : e[w]].tobytes()
        owner = np.searchsorted(off, starts, "right") - 1
        flat = ids[tb.gather(at[which], counts[which])]
        per = np.bincount(owner, counts[which], minlength=n).astype(np.int64)
        wrong = np.bincount(owner, ~spelt[which], minlength=n) > 0
        return flat, per, ~wrong

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Text of ids: pieces joined, marks as spaces, without the first one; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(self.surface[i] for i in ids).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _encoded(model: PieceModel, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.text_bytes(batch.column("text"))
            for i, j in tb.chunks(offsets, CHUNK):
                ids, per, back = model.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = np.concatenate([[0], np.cumsum(per)])
                little = ids.astype("<i4")
                sums = [md5(little[at[r] : at[r + 1]].tobytes()).hexdigest() for r in range(j - i)]
                cols = [batch.column("doc_id").slice(i, j - i), pa.array(per), pa.array(sums), pa.array(back)]
                if keep:
                    cols.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))
                yield pa.record_batch(cols, ["doc_id", "n_tokens", "ids_md5", "round_trip", *(["ids"] if keep else [])])

    return run


def encode(docs: DataFrame, model: PieceModel, keep: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_md5, round_trip and, with ``keep``, ids array<int>) for each row of ``docs`` (doc_id, text).

    ids is the segmentation with the highest sum of the model's scores, of equal sums the one whose last pieces start
    first; characters without a piece are spelt in byte pieces. ids_md5 is over little-endian 32-bit ids; round_trip
    tells that the ids' pieces spell the text (false for a text with a literal U+2581, which decodes as a space).

    * null or empty text: no ids, round_trip true; only spaces: their marks; repeated rows and null ids are kept;
    * long texts are read whole; other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encoded(model, keep), f"doc_id {kind}, n_tokens bigint, ids_md5 string, round_trip boolean" + ", ids array<int>" * keep)


def decode(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text, none an empty one; ids out of range raise."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [None if x is None else model.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
