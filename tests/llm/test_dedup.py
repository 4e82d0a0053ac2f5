import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import brute_components
from pyspark.sql import functions as F

from quillspark.llm import linededup, minhash, scratch, textbatch
from quillspark.llm.components import components
from quillspark.llm.scratch import Scratch


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(docs, size, percent):
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    want, sets = brute_components(texts, size, percent)
    for r in minhash.near_duplicates(docs, size, percent).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_large_group_of_near_copies(spark):
    """Many nodes in one bucket, of which some link with each other only, not with the group's head."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(150):
        t = list(base)
        for k in rng.choice(120, int(rng.integers(1, 9)), replace=False):
            t[k] = f"x{rng.integers(0, 40)}"
        texts[i] = " ".join(t)
    texts[200] = texts[149] + " tail"
    want, _ = brute_components(texts, 3, 85)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, 85).collect()}
    assert got == want


def test_near_duplicates_odd_rows(odd):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(odd, 3, 85).collect()}
    assert got[1, 0] == (1, True) and got[2, 0] == (2, True) and got[3, 0] == (3, True)
    assert got[4, 1] == (4, True) and got[5, 1] == (4, False) and got[9, 1] == (9, True)
    assert got[None, 2] == (None, None) and got[10, 2] == (10, True)
    assert minhash.near_duplicates(odd.where("false")).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (4, 10), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(edges, Scratch(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 1, 9: 8, 8: 8}


def test_estimate(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 16, (2, 192))
    b[:150] = a[:150]
    pack = lambda m: [int(np.uint64(sum(int(x) << (4 * k) for k, x in enumerate(m[i : i + 16]))).astype(np.int64)) for i in range(0, 192, 16)]
    df = spark.createDataFrame([(pack(a), pack(b))], "a array<long>, b array<long>")
    got = df.select(minhash.estimate(F.col("a"), F.col("b"), 192, 4)).first()[0]
    assert got == pytest.approx(((a == b).mean() - 1 / 16) / (15 / 16))


def brute_lines(texts):
    """Positions deleted from each text and what is left: alignment with every earlier text that has a common line."""
    lines = {i: t.split("\n") for i, t in texts.items() if t is not None}
    held, gone = {}, {i: set() for i in texts}
    for i in sorted(lines):
        words = [len(x.split()) for x in lines[i]]
        for e in {e for x in lines[i] if x.strip() for e in held.get(x, ())}:
            gone[i] |= set(linededup.common_blocks(lines[i], lines[e], words, linededup.BLOCK_WORDS))
        for x in set(lines[i]):
            held.setdefault(x, []).append(i)
    return gone, {i: None if t is None else "\n".join(x for k, x in enumerate(lines[i]) if k not in gone[i]) for i, t in texts.items()}


def test_lines_equal_brute_force(docs):
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    gone, left = brute_lines(texts)
    got = linededup.dedup_lines(docs).collect()
    assert any(gone.values())
    for r in got:
        assert (sorted(gone[r.doc_id]), left[r.doc_id]) == (r.deleted, r.text)


def test_common_passage_of_short_lines(spark):
    """A passage of short lines that very many documents hold goes from all but the first; other order, repeats."""
    p = [f"common line number {k} of this long passage with twelve words {k}" for k in range(5)]
    own = lambda i, n: [f"only document {i} has its own line {k} here" for k in range(n)]
    texts = {i: "\n".join([*own(i, 2 + i % 3), *p, *own(i + 1000, 1)]) for i in range(140)}
    q = [f"second block line {k} with some more words in it, for length {k}" for k in range(5)]
    texts[500], texts[501] = "\n".join([*p, *own(500, 1), *q]), "\n".join([*q, *own(501, 1), *p])
    texts[502] = "\n".join([*p, *own(502, 1), *p, *own(503, 1)])
    got = {r.doc_id: (r.n_deleted, r.text) for r in linededup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[0] == (0, texts[0]) and all(got[i][0] == 5 and p[0] not in got[i][1] for i in range(1, 140))
    assert (got[500][0], got[501], got[502][0]) == (5, (10, own(501, 1)[0]), 10)
    gone, _ = brute_lines(texts)
    assert all(len(gone[i]) == got[i][0] for i in texts)


def test_common_block_of_few_words(spark):
    """A block of 9 words goes from all but its first holder, however many hold it, so a larger corpus gives the same."""
    x = "one line of nine words that many documents hold"
    for n in (3, 100, 140):
        texts = {i: f"own text {i} a\n{x}\nown text {i} b" for i in range(n)}
        got = {r.doc_id: r.deleted for r in linededup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
        assert got == {i: [1] if i else [] for i in texts}


def blocks_of_all_earlier(texts):
    """Lines with words in a block of BLOCK_WORDS words of any earlier document, by extending every pair of equal lines."""
    lines, held, out = {i: t.split("\n") for i, t in texts.items()}, {}, {}
    for i in sorted(lines):
        a, out[i] = lines[i], set()
        n = [len(x.split()) for x in a]
        for p in range(len(a)):
            for e, q in held.get(a[p], []) if n[p] else []:
                r = 0
                while p + r < len(a) and q + r < len(lines[e]) and a[p + r] == lines[e][q + r]:
                    r += 1
                if sum(n[p : p + r]) >= linededup.BLOCK_WORDS:
                    out[i] |= {k for k in range(p, p + r) if n[k]}
        for q, x in enumerate(a):
            held.setdefault(x, []).append((i, q))
    return out


def compare_with_all_earlier(spark, texts):
    want = blocks_of_all_earlier(texts)
    for r in linededup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        assert [k for k in r.deleted if texts[r.doc_id].split("\n")[k].split()] == sorted(want[r.doc_id]), r.doc_id
    return want


def test_lines_equal_all_earlier_documents(spark, docs):
    assert any(compare_with_all_earlier(spark, {r.doc_id: r.text for r in docs.collect() if r.text is not None}).values())
    rng = np.random.default_rng(4)
    kinds = ["", *(" ".join(f"w{k}x{m}" for m in range(k % 7 + 1)) for k in range(24))]
    compare_with_all_earlier(spark, {i: "\n".join(rng.choice(kinds, rng.integers(1, 12))) for i in range(600)})


def test_block_whose_lines_stood_alone_before(spark):
    """Block [x, r] of documents 3 and 4, of which x is first in 1 and r in 2, also with a first line of 8 words."""
    x, r, y = "five words are in x", "four words of r", "this line alone has eight words in it"
    texts = {1: f"a 1\n{x}\nb 1", 2: f"a 2\n{r}\nb 2", 3: f"a 3\n{x}\n{r}\nb 3\n{y}\n{r}\nc 3", 4: f"{x}\n{r}", 5: f"{y}\na 5", 6: f"{y}\n{r}\na 6"}
    assert compare_with_all_earlier(spark, texts) == {1: set(), 2: set(), 3: set(), 4: {0, 1}, 5: {0}, 6: {0, 1}}


def test_block_of_very_short_lines(spark):
    """20 lines of 2 words that just two documents share go from the later one; four such lines are 8 words, three stay."""
    rows = [f"row c{k}" for k in range(20)]
    texts = {1: "\n".join(["first own line", *rows]), 2: "\n".join([*rows, "second own line"]), 3: "\n".join([*rows[4:8], "third", *rows[9:12]])}
    assert compare_with_all_earlier(spark, texts) == {1: set(), 2: set(range(20)), 3: set(range(4))}


def test_blocks_in_another_order_and_repeats():
    words = [10] * 4
    assert linededup.common_blocks([1, 2, 3, 4], [3, 4, 1, 2], words, 8) == [0, 1, 2, 3]
    assert linededup.common_blocks([9, 1, 2, 8], [1, 2, 7, 1, 2, 6], words, 8) == [1, 2]
    assert linededup.common_blocks([1, 2, 3, 4], [5, 6], words, 8) == []


def test_repeated_id_with_other_texts(spark):
    """Rows of one id are aligned, linked and judged by their own texts."""
    block = "\n".join(f"line {k} of a block with some words" for k in range(3))
    own = "\n".join(f"own line {k} of the other row and nothing else" for k in range(12))
    df = spark.createDataFrame([(1, block), (2, own), (2, f"{block}\nlast"), (2, own)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_deleted) for r in linededup.dedup_lines(df).collect())
    assert got == sorted([(1, block, 0), (2, own, 0), (2, own, 0), (2, "last", 3)])
    w = lambda c: " ".join(f"{c}{k}" for k in range(60))
    rows = [(5, w("a")), (5, w("b")), (6, w("a") + " x"), (7, w("b") + " x"), (3, w("b")), (8, w("c")), (8, None)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect())
    assert got == [(3, 58, 3, True), (5, 58, 3, False), (5, 58, 3, False), (6, 59, 3, False), (7, 59, 3, False), (8, 0, 8, True), (8, 58, 8, True)]


def test_mixed_bucket_of_many_components(spark):
    """Pairs under the threshold share buckets with the head; of blocks of 8 nodes, links inside and across are found."""
    rng = np.random.default_rng(5)
    base, texts = [f"w{i}" for i in range(200)], {}
    for g in range(12):
        t = list(base)
        for k in rng.choice(200, 12, replace=False):
            t[k] = f"g{g}x{k}"
        for m in range(4):
            u = list(t)
            u[int(rng.integers(0, 200))] = f"m{g}y{m}"
            texts[int(rng.integers(0, 10**6))] = " ".join(u)
    want, _ = brute_components(texts, 3, 85)
    assert len(set(want.values())) > 5
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in (8, 512):
        old, minhash.BLOCK = minhash.BLOCK, block
        try:
            assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 3, 85).collect()} == want
        finally:
            minhash.BLOCK = old


def test_scratch_is_released(spark):
    import os

    since = scratch.mark()
    df = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e f")], "doc_id long, text string")
    minhash.near_duplicates(df).collect()
    linededup.dedup_lines(df).collect()
    roots = [x.root for x in scratch._live[since:]]
    assert len(roots) == 2 and all(len(os.listdir(x)) <= 2 for x in roots)
    scratch.release(since)
    assert not any(os.path.exists(x) for x in roots)


def test_patience():
    assert linededup.patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert linededup.patience([5, 1, 2, 5], [7, 1, 2, 7]) == [(1, 1), (2, 2)]
    assert linededup.patience([], [1]) == [] and linededup.patience([1, 1], [2, 2]) == []
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 8, rng.integers(0, 12)).tolist(), rng.integers(0, 8, rng.integers(0, 12)).tolist()
        p = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in p) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:], strict=False))


def test_lines_odd_rows(odd):
    out = linededup.dedup_lines(odd)
    assert out.columns[:2] == ["doc_id", "text"] and "lang_pred" in out.columns
    got = {r.doc_id: r for r in out.collect()}
    assert (got[1].text, got[1].n_lines, got[1].n_deleted) == (None, 0, 0)
    assert (got[2].text, got[2].n_lines) == ("", 1) and got[11].text == "\n\nx\n"
    assert got[7].n_deleted == 0 and got[8].deleted == [0, 1] and got[8].partners == [7] and got[8].text == ""
    assert out.count() == odd.count() and linededup.dedup_lines(odd.where("false")).count() == 0


def test_span_hashes_follow_content():
    data, offsets = textbatch.text_bytes(pa.array(["ab cd", "cd ab", None, "x ab"]))
    h, owner = textbatch.word_hashes(data, offsets)
    assert h[0] == h[3] == h[5] and h[1] == h[2] and len(set(h.tolist())) == 3 and owner.tolist() == [0, 0, 1, 1, 3, 3]
