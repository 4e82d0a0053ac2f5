"""Line dedup by pairwise alignment: documents that share the hash of a run of lines are aligned with patience diff, and
aligned common blocks are deleted from the later document.

Candidate pairs grow with the lines, not with the square of a line's holders: a document is paired with the first
holder (smallest doc_id) of each of its shared runs of lines of 8 words, however many documents hold them. As every
deletion has an earlier holder of the line, the first holder of a line keeps it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textbatch as tb
from quillspark.llm.scratch import Scratch

#: Odd base of the polynomial over line hashes that names a run, and its inverse mod 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Words that a common block has at least; shorter ones are left as chance.
BLOCK_WORDS = 8


def _numbered(lines: list[int]) -> Iterator[tuple[int, int]]:
    """Each line with the number of its occurrence."""
    seen: Counter = Counter()
    for x in lines:
        seen[x] += 1
        yield x, seen[x]


def patience(left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two sequences: lines unique on both sides anchor, between anchors the parts are aligned again.

    A part without such a line is anchored by the k-th occurrences of its common lines. Equal lines at both ends of a part are taken first. Linear in memory; recursion is replaced by a stack.
    """
    out, stack = [], [(0, len(left), 0, len(right))]
    while stack:
        i, m, j, n = stack.pop()
        while i < m and j < n and left[i] == right[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and left[m - 1] == right[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i >= m or j >= n:
            continue
        a, b = Counter(left[i:m]), Counter(right[j:n])
        at = {x: k for k, x in enumerate(right[j:n], j) if b[x] == 1}
        anchors = [(k, at[x]) for k, x in enumerate(left[i:m], i) if a[x] == 1 and x in at]
        if not anchors and not a.keys().isdisjoint(b):
            nth = {y: k for k, y in enumerate(_numbered(right[j:n]), j)}
            anchors = [(k, nth[x]) for k, x in enumerate(_numbered(left[i:m]), i) if x in nth]
        # longest run of anchors that rises on both sides
        tops: list[int] = []
        piles: list[int] = []
        back = [-1] * len(anchors)
        for k, (_, y) in enumerate(anchors):
            p = bisect_left(tops, y)
            back[k] = piles[p - 1] if p else -1
            tops[p : p + 1], piles[p : p + 1] = [y], [k]
        k, chain = piles[-1] if piles else -1, []
        while k >= 0:
            chain.append(anchors[k])
            k = back[k]
        if not chain:
            continue
        x, y = i, j
        for u, v in [*reversed(chain), (m, n)]:
            stack.append((x, u, y, v))
            x, y = u, v
            if u < m:
                out.append((u, v))
                x, y = u + 1, v + 1
    return sorted(out)


def _shortest(lines: list[int], size: dict[int, int], least: int) -> Iterator[tuple[int, int]]:
    """[start, stop) of the shortest run of lines of ``size`` up to each line that has ``least`` words."""
    low = n = 0
    for k, x in enumerate(lines):
        if x not in size:
            low, n = k + 1, 0
            continue
        n += size[x]
        while n - size[lines[low]] >= least:
            n -= size[lines[low]]
            low += 1
        if n >= least and size[x]:
            yield low, k + 1


def _covered(left: list[int], right: list[int], words: list[int], least: int) -> set[int]:
    """Positions of ``left`` in runs of lines with ``least`` words that ``right`` has anywhere.

    Each line with words of such a run is in a shortest one that begins or ends inside it. Linear in the lines.
    """
    theirs, out = set(right), set()
    size = {x: n for x, n in zip(left, words, strict=True) if x in theirs}
    both = lambda x: {*_shortest(x, size, least), *((len(x) - j, len(x) - i) for i, j in _shortest(x[::-1], size, least))}
    held, end, block = {tuple(right[i:j]) for i, j in both(right)}, 0, []
    for i, j in [*sorted(x for x in both(left) if tuple(left[x[0] : x[1]]) in held), (len(left) + 1, 0)]:
        if i > end and block:
            out |= set(block)
            block = []
        block += range(max(i, end), j) if block else range(i, j)
        end = max(end, j)
    return out


def common_blocks(left: list[int], right: list[int], words: list[int], least: int) -> list[int]:
    """Positions of ``left`` in runs aligned with runs of ``right`` that have ``least`` words.

    Found lines are taken out and the rest is aligned again until nothing is found, so blocks in another order count;
    what the alignment splits or crosses is found by runs.
    """
    rest, found, theirs = list(left), [], set(right)
    while True:
        new, run = [], []
        for pair in [*patience(rest, right), (-9, -9)]:
            if run and pair != (run[-1][0] + 1, run[-1][1] + 1):
                if sum(words[i] for i, _ in run) >= least:
                    new += [i for i, _ in run]
                run = []
            run.append(pair)
        found += new
        for i in new:
            rest[i] = (i,)  # equal to no line
        if not any(w and x in theirs for x, w in zip(rest, words, strict=True)):
            return sorted(found)
        if not new:
            return sorted({*found, *_covered(left, right, words, least)})


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return out.cumprod(dtype=np.uint64)


def _runs(hashes: np.ndarray, words: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """Names of the shortest runs of lines from each line on and up to each line that have ``least`` words, two for each line.

    0 stands where the document has no such run, or the run up to a line is one from a line on. ``begins`` and ``ends``
    hold the begin and end of each line's document as line numbers. Each line of a block that two documents share is in
    such a run inside the block, so the first holders of these runs are all the partners that are needed.
    """
    n = len(hashes)
    total = np.concatenate([[0], np.cumsum(words.astype(np.int64))])
    power, inverse = _powers(BASE, n), _powers(BASE_INVERSE, n)
    prefix = np.concatenate([np.zeros(1, np.uint64), (hashes * power).cumsum(dtype=np.uint64)])
    name = lambda start, stop: (prefix[stop] - prefix[start]) * inverse[start]
    stop = np.searchsorted(total, total[:-1] + least)
    down = np.where((words > 0) & (stop <= ends), name(np.arange(n), np.minimum(stop, n)), np.uint64(0))
    start = np.searchsorted(total, total[1:] - least, "right") - 1
    known = stop[np.maximum(start, 0)] == np.arange(1, n + 1)
    up = np.where((words > 0) & (start >= begins) & ~known, name(np.maximum(start, 0), np.arange(1, n + 1)), np.uint64(0))
    return np.stack([down, up], axis=1).ravel()


def _lined(least: int):
    return lambda batches: _lines(batches, least)


def _lines(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tb.text_bytes(batch.column("text"))
        for i, j in tb.chunks(offsets):
            d, part = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            # a text of n line breaks has n + 1 lines; ends of lines are the breaks and the texts' ends
            breaks = np.flatnonzero(d == 10)
            ends = np.sort(np.concatenate([breaks, part[1:]]), kind="stable")
            counts = np.bincount(np.searchsorted(part, breaks, "right") - 1, minlength=j - i) + 1
            last = np.cumsum(counts) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            starts[last[:-1] + 1] = part[1:-1]
            # where a text ends with a break, its last line is empty; sorting keeps that order
            h = tb.span_hashes(d, starts, np.maximum(starts, ends))
            w = tb.spans(~tb.SPACE[d], part)[0]
            n_words = np.searchsorted(w, ends) - np.searchsorted(w, starts)
            h = np.where(n_words > 0, h, np.uint64(0))
            runs = _runs(h, n_words, np.repeat(last + 1 - counts, counts), np.repeat(last + 1, counts), least).view(np.int64)
            h = h.view(np.int64)
            at, kept = np.concatenate([[0], last + 1]), runs != 0
            of_run = pa.array(np.concatenate([[0], np.cumsum(kept)])[2 * at].astype(np.int32))
            at, runs = pa.array(at.astype(np.int32)), runs[kept]
            yield pa.record_batch([batch.column("doc_id").slice(i, j - i), batch.column("v").slice(i, j - i), pa.ListArray.from_arrays(at, pa.array(h)), pa.ListArray.from_arrays(at, pa.array(n_words.astype(np.int32))), pa.ListArray.from_arrays(of_run, pa.array(runs))], ["doc_id", "v", "lines", "words", "runs"])


def _align(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            gone = [common_blocks(x.tolist(), y.tolist(), w.tolist(), least) for x, y, w in zip(pdf["lines"], pdf["other"], pdf["words"], strict=True)]
            yield pdf[["later", "later_v", "earlier"]].assign(gone=gone)

    return run


def dedup_lines(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with blocks deleted from ``text``, plus n_lines, n_deleted, deleted (line numbers from 0) and partners.

    Lines end at U+000A and are compared byte for byte by a 64-bit hash; blank lines equal each other but seed nothing.
    Deleted is a block of consecutive lines that an earlier document has in the same order, if it has ``block_words``
    words, however many documents hold it and however short its lines are.

    * null text: null, no line; empty text: one empty line, nothing deleted; a text whose lines all go becomes empty;
    * null doc_id: the row stays as it is and is no partner; repeated doc_id: each row is aligned by its own text, and
      rows of one id are not compared with each other;
    * ties: doc_id decides who is earlier; extra columns pass through, those named like added ones are replaced.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    kind = docs.schema["doc_id"].dataType.simpleString()
    # v tells rows of one doc_id with different texts apart
    own = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("v"), "text")
    lined = scratch.keep(own.mapInArrow(_lined(block_words), f"doc_id {kind}, v bigint, lines array<bigint>, words array<int>, runs array<bigint>"), "lined")
    one = lined.select("doc_id", "v", F.explode(F.array_distinct("runs")).alias("key"))
    held = one.groupBy("key").agg(F.min(F.struct("doc_id", "v")).alias("first"), F.max("doc_id").alias("last"))
    held = scratch.keep(held.where(F.col("first.doc_id") < F.col("last")).select("key", F.col("first.doc_id").alias("earlier"), F.col("first.v").alias("earlier_v")), "held")
    pairs = one.join(held, "key").where("doc_id > earlier").select(F.col("doc_id").alias("later"), F.col("v").alias("later_v"), "earlier", "earlier_v").distinct()
    pairs = scratch.keep(pairs, "pairs")
    wanted = pairs.select(F.col("later").alias("doc_id"), F.col("later_v").alias("v")).union(pairs.select("earlier", "earlier_v")).distinct()
    few = lined.select("doc_id", "v", "lines", "words").join(wanted.hint("shuffle_hash"), ["doc_id", "v"], "left_semi")
    few = scratch.keep(few.dropDuplicates(["doc_id", "v"]), "few")
    half = scratch.keep(pairs.join(few.withColumnsRenamed({"doc_id": "later", "v": "later_v"}), ["later", "later_v"]), "half")
    other = few.select(F.col("doc_id").alias("earlier"), F.col("v").alias("earlier_v"), F.col("lines").alias("other"))
    both = half.join(other, ["earlier", "earlier_v"]).select("later", "later_v", "earlier", "lines", "words", "other")
    gone = both.mapInPandas(_align(block_words), f"later {kind}, later_v bigint, earlier {kind}, gone array<int>").where(F.size("gone") > 0)
    gone = gone.groupBy(F.col("later").alias("__id"), F.col("later_v").alias("__v")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("__gone"), F.array_sort(F.collect_set("earlier")).alias("__with"))
    gone = scratch.keep(gone, "gone")
    scratch.keep_only("gone")
    out = docs.select([c for c in docs.columns if c not in ("n_lines", "n_deleted", "deleted", "partners")])
    out = out.join(gone.hint("shuffle_hash"), (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__v")), "left")
    lines = F.split("text", "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__gone", i)), "\n")
    out = out.withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines))).withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left))
    none = F.array().cast("array<int>")
    return out.withColumns({"deleted": F.coalesce("__gone", none), "n_deleted": F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")), "partners": F.coalesce("__with", F.array().cast(f"array<{kind}>"))}).drop("__id", "__v", "__gone", "__with")
