import os
import re

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, extra columns with names that operators use."""
    long = " ".join(f"w{i % 977}x" for i in range(40_000)) + "\n" + "z" * 70_000
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (None, "a b c d"), (6, "ü ñ\n日本 🙂"), (7, long), (8, long), (9, "12345"), (9, "12345"), (10, "a b c d"), (11, "\n\nx\n")]
    return spark.createDataFrame([(i, t, 1, "k", "c", 0.5) for i, t in rows], "doc_id long, text string, n_lines int, lang_pred string, component_id string, score double")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, size):
    w = words(text)
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute_components(texts, size, percent):
    """component of each key of texts {id: text} by comparing all pairs that share a shingle."""
    sets, up, held = {i: shingle_set(t, size) for i, t in texts.items()}, {i: i for i in texts}, {}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sorted(sets):
        shared = {}
        for s in sets[i]:
            for j in held.setdefault(s, []):
                shared[j] = shared.get(j, 0) + 1
            held[s].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}, sets
