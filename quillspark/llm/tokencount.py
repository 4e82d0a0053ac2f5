"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

The trie's nodes have failure links and the count of pieces popped on the way there, so that greedy longest-match
lengths come from one pass over a word's bytes, without going back and without building a piece.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm import textbatch as tb

CHUNK = 4 << 20
#: Up to so many words of one length are read one by one: a step of numpy costs as much as so many bytes.
FEW = 8


def load_ranks(path: str) -> list[bytes]:
    """Pieces of a tiktoken file; a leading space marks the start of a word."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class LongestMatch:
    """Automaton of a vocabulary of byte strings; ``start`` precedes every word."""

    def __init__(self, vocabulary: list[bytes], start: bytes = b" "):
        edges: list[dict[int, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            v = 0
            for c in piece:
                if c not in edges[v]:
                    edges[v][c] = len(edges)
                    edges.append({})
                    final.append(False)
                v = edges[v][c]
            final[v] = final[v] or v > 0
        n = len(edges)
        self.start = np.frombuffer(start, np.uint8)
        self.fail, self.pops, self.rest = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.dead = np.zeros(n, bool)  # nothing more can be popped from here: the word has no segmentation
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in edges[u].items():
                queue.append(v)
                if final[v]:
                    self.fail[v], self.pops[v] = 0, 1
                else:
                    z, popped = self.fail[u], self.pops[u]
                    while z >= 0 and c not in edges[z]:
                        popped, z = popped + self.pops[z], self.fail[z]
                    self.fail[v], self.pops[v] = (edges[z][c], popped) if z >= 0 else (-1, 0)
                # parents in the failure tree are shallower, hence done
                f = self.fail[v]
                self.dead[v] = f < 0 or (f > 0 and self.dead[f])
                self.rest[v] = self.pops[v] + (self.rest[f] if f > 0 else 0)
        inner = [v for v in range(n) if edges[v]]
        self.row = np.zeros(n, np.int32)
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.next = np.full((len(inner) + 1, 256), -1, np.int32)
        for v in inner:
            self.next[self.row[v], list(edges[v])] = list(edges[v].values())

    def counts(self, words: np.ndarray) -> np.ndarray:
        """Pieces of each word of (words, bytes); a word without a segmentation counts as one unknown token."""
        n = len(words)
        if n <= FEW:
            return np.array([self._count(w.tobytes()) for w in words], np.int64)
        state, count, lost = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
        for c in [*(np.full(n, x, np.uint8) for x in self.start), *words.T]:
            to = self.next[self.row[state], c]
            left = np.flatnonzero((to < 0) & ~lost)
            while len(left):
                count[left] += self.pops[state[left]]
                back = self.fail[state[left]]
                lost[left[back < 0]] = True
                state[left] = np.maximum(back, 0)
                left = left[back >= 0]
                to[left] = self.next[self.row[state[left]], c[left]]
                left = left[to[left] < 0]
            state = np.maximum(to, 0)
        lost |= (state > 0) & self.dead[state]
        return np.where(lost, 1, count + self.rest[state])

    def _count(self, word: bytes) -> int:
        """The same for one word, byte by byte: for lengths that few words have, such as texts without spaces."""
        step, row, fail, pops, state, count = self.next, self.row, self.fail, self.pops, 0, 0
        for c in bytes(self.start) + word:
            while (to := step[row[state], c]) < 0:
                count += pops[state]
                state = fail[state]
                if state < 0:
                    return 1
            state = to
        return 1 if state > 0 and self.dead[state] else int(count + self.rest[state])

    def count_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each text; distinct words of one length advance together."""
        starts, ends, owner = tb.spans(~tb.SPACE[data], offsets)
        s, e, which = tb.distinct_spans(data, starts, ends)
        sizes, tokens = e - s, np.zeros(len(s), np.int64)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            for part in np.array_split(rows, -(-len(rows) * int(size) // (4 << 20))):
                tokens[part] = self.counts(data[s[part][:, None] + np.arange(size)])
        n = len(offsets) - 1
        return np.bincount(owner, minlength=n), np.bincount(owner, tokens[which], minlength=n).astype(np.int64)


_built: dict[tuple[int, bytes], LongestMatch] = {}


def _automaton(vocabulary: list[bytes], start: bytes) -> LongestMatch:
    """One for each worker process, however many tasks it runs."""
    key = (hash(tuple(vocabulary)), start)
    if key not in _built:
        _built.clear()
        _built[key] = LongestMatch(vocabulary, start)
    return _built[key]


def _counted(vocabulary: list[bytes], start: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _automaton(vocabulary, start)
        for batch in batches:
            data, offsets = tb.text_bytes(batch.column("text"))
            for i, j in tb.chunks(offsets, CHUNK):
                words, tokens = match.count_texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), pa.array(words.astype(np.int64)), pa.array(tokens)], ["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: list[bytes], start: bytes = b" ") -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row of ``docs`` (doc_id, text).

    Words are runs of bytes other than ASCII white space. Each is read as ``start`` and its bytes, and cut greedily
    into the longest pieces of ``vocabulary`` from the left; where no piece fits, the whole word is one unknown token.

    * null or empty text, or white space only: 0 and 0; repeated rows and null ids are kept, each by itself;
    * long texts and words are read whole; other columns are ignored; an empty table gives no rows;
    * repeated pieces count once and empty ones are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_counted(vocabulary, start), f"doc_id {kind}, n_words bigint, n_tokens bigint")
