"""MinHash near-dedup with b-bit signatures.

Each text's distinct word shingles get ``bands * rows`` minima. Band keys find candidates; of every minimum only the
low ``bits`` are kept, packed in longs, and the similarity of a candidate pair is estimated from the equal fields,
corrected for fields that are equal by chance. What the estimate leaves is confirmed on the full shingle sets.

Skew: equal sets collapse to one node before banding; in a bucket each node is paired with the bucket's smallest node
only. What then still lies in different components of a bucket is compared block by block: packed signatures first,
and full sets of the nodes only that the estimate leaves in a block. Joins on hot keys read written tables on both
sides, so that adaptive execution splits them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.llm import textbatch as tb
from quillspark.llm.components import components
from quillspark.llm.scratch import Scratch

BANDS, BITS = 32, 4
#: A pair just at the threshold shares no band with this probability at most.
MISS = 1e-5
#: An estimate this far below the threshold is more than four standard deviations away at 128 minima.
SLACK = 0.15
#: Nodes in a block, and shingles in it, on average; blocks are made by hash, so a single larger set stands in one.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Nodes of a pair of blocks that are compared with all others at once.
ROWS = 128
_RNG = np.random.default_rng(7919)
_MUL = _RNG.integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1, 2**63, 1024, dtype=np.uint64)


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of runs of a batch's texts: first and last row, distinct shingle hashes, and their row within the run."""
    data, offsets = tb.text_bytes(batch.column("text"))
    for i, j in tb.chunks(offsets):
        part = offsets[i : j + 1] - offsets[i]
        words, owner = tb.word_hashes(data[offsets[i] : offsets[j]], part)
        yield (i, j, *tb.shingles(words, owner, j - i, size))


def _minima(h: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """k minima of each run of h; runs start at ``first`` and are not empty."""
    out = np.empty((k, len(first)), np.uint64)
    for i in range(k):
        out[i] = np.minimum.reduceat((h * _MUL[i] + _ADD[i]) >> np.uint64(16), first)
    return tb.mix(out)


def _signed(size: int, bands: int, rows: int, bits: int):
    k, per = bands * rows, 64 // bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, owner in _sets(batch, size):
                n = np.bincount(owner, minlength=j - i)
                full = np.flatnonzero(n)
                first = (np.cumsum(n) - n)[full]
                d1, d2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                sig = np.zeros((j - i, -(-k // per)), np.uint64)
                keys = np.zeros((j - i, bands), np.uint64)
                if len(full):
                    d1[full] = np.add.reduceat(tb.mix(h ^ np.uint64(0x5851F42D4C957F2D)), first)
                    d2[full] = np.add.reduceat(tb.mix(h + np.uint64(0x14057B7EF767814F)), first)
                    m = _minima(h, first, k)
                    low = m & np.uint64(2**bits - 1)
                    for x in range(k):
                        sig[full, x // per] |= low[x] << np.uint64(bits * (x % per))
                    for b in range(bands):
                        key = np.full(len(full), b + 1, np.uint64)
                        for r in range(rows):
                            key = tb.mix(key * np.uint64(0x2545F4914F6CDD1D) + m[b * rows + r])
                        keys[full, b] = key
                lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.reshape(-1).view(np.int64)))
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists(sig), lists(keys)], ["doc_id", "n_shingles", "d1", "d2", "sig", "keys"])

    return run


def _full(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, owner in _sets(batch, size):
                at = np.searchsorted(owner, np.arange(j - i + 1))
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), pa.array([h[at[x] : at[x + 1]].tobytes() for x in range(j - i)], pa.binary())], ["doc_id", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(bool(shared) and 100 * shared >= percent * (len(both) - shared))
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _fields(bits: int) -> np.uint64:
    return np.uint64(sum(1 << (bits * i) for i in range(64 // bits)))


def _similar(percent: int, k: int, bits: int, schema: pa.Schema):
    """Nodes of a pair of blocks whose packed signatures leave them a partner in another component."""
    floor, fields = percent / 100 - SLACK, _fields(bits)

    def run(unit: pa.Table) -> pa.Table:
        sig = unit.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(unit), -1)
        n, own, part = (unit.column(c).to_numpy() for c in ("n_shingles", "own", "component"))
        several, found = len(np.unique(own)) > 1, np.zeros(len(unit), bool)
        for low in range(0, len(unit), ROWS):
            at = slice(low, low + ROWS)
            differ = np.zeros((len(n[at]), len(unit)), np.int32)
            for w in range(sig.shape[1]):
                x = sig[at, None, w] ^ sig[None, :, w]
                for s in (1 << i for i in range(bits.bit_length() - 1)):
                    x |= x >> np.uint64(s)
                differ += np.bitwise_count(x & fields)
            equal = ((k - differ) / k - 2.0**-bits) / (1 - 2.0**-bits)
            near = (equal >= floor) & (part[at, None] != part[None, :]) & (100 * np.minimum(n[at, None], n[None, :]) >= percent * np.maximum(n[at, None], n[None, :]))
            if several:
                near &= own[at, None] != own[None, :]
            found[at] = near.any(axis=1)
        return unit.filter(pa.array(found)).select(schema.names).cast(schema)

    return run


def _forest(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Positions of the edges (p, q) that join two trees, taken in order."""
    up: dict = {}

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    keep = []
    for i, (x, y) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
        if (x := root(x)) != (y := root(y)):
            up[x] = y
            keep.append(i)
    return np.array(keep, np.int64)


def _blocks(percent: int, schema: pa.Schema, columns: int = 1024):
    def run(unit: pa.Table) -> pa.Table:
        """Links between nodes of different components in a pair of blocks, as many as join these components."""
        nodes = unit.column("node")
        own, part = unit.column("own").to_numpy(), unit.column("component").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in unit.column("shingles")]
        n = np.array([len(x) for x in sets], np.int64)
        values, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), n)
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        shared = np.zeros((len(sets), len(sets)), np.int64)
        for low in range(0, len(values), columns):
            i, j = np.searchsorted(at, [low, low + columns])
            has = np.zeros((len(sets), min(columns, len(values) - low)), np.float32)
            has[owner[i:j], at[i:j] - low] = 1
            shared += (has @ has.T).astype(np.int64)
        a, b = np.nonzero((100 * shared >= percent * (n[:, None] + n[None, :] - shared)) & (shared > 0) & (part[:, None] > part[None, :]))
        if len(np.unique(own)) > 1:
            a, b = a[own[a] != own[b]], b[own[a] != own[b]]
        few = _forest(part[a], part[b])
        return pa.table([nodes.take(pa.array(a[few])), nodes.take(pa.array(b[few]))], ["a", "b"]).cast(schema)

    return run


def _rest(docs: DataFrame, member: DataFrame, sigs: DataFrame, scratch: Scratch, kind: str, size: int, percent: int, k: int, bits: int) -> DataFrame:
    """Links across components among the nodes (head, node, component) of buckets, block against block.

    Buckets with the same head are one group. A group's nodes are dealt into blocks of about ``BLOCK`` nodes and
    ``BLOCK_SHINGLES`` shingles; each pair of blocks is one task-sized unit that compares packed signatures. Full sets
    go only to units, and only of nodes, where the estimate leaves a pair; no pair becomes a row.
    """
    member = scratch.keep(member.distinct().join(sigs, "node"), "rest-member")
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n_shingles") / F.lit(BLOCK_SHINGLES)))
    groups = scratch.keep(member.groupBy("head").agg(blocks.alias("blocks")), "rest-groups")
    dealt = member.join(groups, "head").withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("head", F.least("own", "j").alias("i"), F.greatest("own", "j").alias("j"), "own", "node", "component", "n_shingles", "sig")
    names = {"head": kind, "i": "bigint", "j": "bigint", "own": "bigint", "node": kind, "component": kind}
    arrow = {c: to_arrow_type(dealt.schema[c].dataType) for c in names}
    near = dealt.groupBy("head", "i", "j").applyInArrow(_similar(percent, k, bits, pa.schema(list(arrow.items()))), ", ".join(f"{c} {t}" for c, t in names.items()))
    near = scratch.keep(near, "rest-near")
    texts = docs.join(near.select(F.col("node").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    sets = scratch.keep(texts.mapInArrow(_full(size), f"doc_id {kind}, shingles binary"), "rest-sets")
    near = near.join(sets, near.node == sets.doc_id).drop("doc_id")
    links = near.groupBy("head", "i", "j").applyInArrow(_blocks(percent, pa.schema([("a", arrow["node"]), ("b", arrow["node"])])), f"a {kind}, b {kind}")
    links = scratch.keep(links, "rest-links")
    scratch.drop("rest-member", "rest-groups", "rest-near", "rest-sets")
    return links


def estimate(a: Column, b: Column, k: int, bits: int) -> Column:
    """Similarity of two packed signatures: equal fields by bit counts, less the share that is equal by chance."""
    per = 64 // bits
    fields = int(_fields(bits).astype(np.int64))
    differ = F.lit(0)
    for w in range(-(-k // per)):
        x = F.element_at(a, w + 1).bitwiseXOR(F.element_at(b, w + 1))
        for s in (1 << i for i in range(bits.bit_length() - 1)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, s))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(fields)))
    equal = (F.lit(k) - differ) / F.lit(k)
    return (equal - 2.0**-bits) / (1 - 2.0**-bits)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, bits: int = BITS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as (doc_id, n_shingles, component_id, kept).

    Texts are linked when 100 * |A and B| >= ``percent`` * |A or B| over their sets of distinct ``size``-word shingles
    (A-Z lower-cased, words split at white space of ASCII). component_id is the smallest doc_id reachable over links,
    kept tells whether it is the row's own. A pair at the threshold shares no band with a probability under ``MISS``:
    the rows of a band are as many as that allows (6 at 0.85, 5 at 0.8).

    * null or empty text, or no word: n_shingles 0, linked with nothing, component_id its own doc_id, kept;
    * fewer words than ``size``: the whole sequence is the one shingle;
    * null doc_id: component_id and kept are null, and the row links nothing;
    * repeated doc_id: its rows are one document of several texts, linked with whatever any of them is linked with (a row
      without words stays by itself); n_shingles is each row's own; equal rows get equal values;
    * very long text: read whole, in a run of its own; empty table: no rows; other columns are ignored.
    """
    if bits not in (1, 2, 4, 8):
        raise ValueError("bits must be 1, 2, 4 or 8")
    rows = max([1, *(r for r in range(1, 17) if (1 - (percent / 100) ** r) ** bands <= MISS)])
    scratch, k = Scratch(docs.sparkSession, "minhash"), bands * rows
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = scratch.keep(docs.mapInArrow(_signed(size, bands, rows, bits), f"doc_id {kind}, n_shingles bigint, d1 bigint, d2 bigint, sig array<bigint>, keys array<bigint>"), "signed")
    nodes = scratch.keep(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "n_shingles", "sig", "keys")).alias("x")).select("d1", "d2", F.col("x.doc_id").alias("node"), "x.n_shingles", "x.sig", "x.keys"),
        "nodes",
    )
    rows_of = nodes.select("node", F.explode("keys").alias("key"))
    heads = scratch.keep(rows_of.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head"), "heads")
    # rows of shared buckets only: what the later steps read
    member = scratch.keep(rows_of.join(heads, "key"), "member")
    sigs = nodes.select("node", "sig", "n_shingles")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Links among candidate pairs (a > b)."""
        pairs = scratch.keep(pairs.distinct(), f"{name}-pairs")
        a, b = (sigs.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}")) for x in "ab")
        near = pairs.join(a, "a").join(b, "b")
        # a link needs sets of about equal sizes, and most of its minima
        near = near.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        near = near.where(estimate(F.col("sig_a"), F.col("sig_b"), k, bits) >= percent / 100 - SLACK).select("a", "b")
        near = scratch.keep(near, f"{name}-near")
        wanted = near.select(F.col("a").alias("doc_id")).union(near.select(F.col("b").alias("doc_id"))).distinct()
        texts = docs.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        sets = scratch.keep(texts.mapInArrow(_full(size), f"doc_id {kind}, shingles binary"), f"{name}-sets")
        half = near.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a")
        half = scratch.keep(half, f"{name}-half")
        both = half.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
        links = scratch.keep(both.mapInArrow(_confirm(percent), f"a {kind}, b {kind}"), f"{name}-links")
        scratch.drop(*(f"{name}-{x}" for x in ("pairs", "near", "sets", "half")))
        return links

    links = confirmed(member.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")), "star")
    # rows of one id with different texts are one document
    several = signed.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).where("low < high").select("doc_id")
    several = scratch.keep(several, "several")
    if not several.isEmpty():
        theirs = signed.join(several, "doc_id", "left_semi").select("doc_id", "d1", "d2").distinct().join(nodes.select("d1", "d2", "node"), ["d1", "d2"])
        links = scratch.keep(links.union(theirs.where("doc_id <> node").select("doc_id", "node")), "links")
    part = components(links, scratch, "star-cc")
    # buckets that still hold several components: their nodes are compared across components
    label = member.join(part, "node", "left").select("key", "node", "head", F.coalesce("component", "node").alias("component"))
    label = scratch.keep(label, "label")
    mixed = label.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    mixed = scratch.keep(mixed, "mixed")
    if not mixed.isEmpty():
        rest = scratch.keep(label.join(mixed, "key").select("head", "node", "component"), "rest")
        part = components(links.union(_rest(docs, rest, sigs, scratch, kind, size, percent, k, bits)), scratch, "cc")
    of = scratch.keep(nodes.select("d1", "d2", "node").join(part, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component")), "of")
    scratch.keep_only("signed", "of")
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(of, ["d1", "d2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), (own == F.col("doc_id")).alias("kept"))
