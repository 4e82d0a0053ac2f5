"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Texts become counts of hashed byte n-grams (1 to 3 bytes, A-Z lower-cased), square-rooted and scaled to length 1.
The models are fitted on the driver from a bounded sample of labelled documents; prediction is one pass over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textbatch as tb

DIMS = 4096
#: Families of related languages; a language that is not listed is a family of its own.
FAMILIES = {"germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"), "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"), "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"), "uralic": ("fi", "et", "hu")}
#: Labelled documents that the models are fitted on: for each language, and in all, at 16 KB of features each (256 MB);
#: with more than 40 languages each gets an equal share of these. Weights are 16 KB for each family and pair of a family.
SAMPLE, SAMPLE_ALL = 400, 16_384
#: Texts whose features are held at once: 4 MB of counts.
ROWS = 256
UNKNOWN = "und"
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``DIMS`` features for each text; every byte of it counts."""
    n = len(offsets) - 1
    out = np.zeros(n * DIMS, np.float32)
    x = tb.LOWER[data].astype(np.uint32)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    h = np.zeros(len(x), np.uint32)
    for size in (1, 2, 3):
        m = len(x) - size + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + x[size - 1 :] + np.uint32(size)
        at = (h * np.uint32(2654435761)) >> np.uint32(20)
        whole = owner[:m] == owner[size - 1 :]
        out += np.bincount((owner[:m] * DIMS + at)[whole], minlength=n * DIMS).astype(np.float32)
    out = np.sqrt(out.reshape(n, DIMS))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "ignore"))
    return out


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights (bias last) of a linear SVM with squared hinge loss for y in -1, 1; accelerated gradient, no randomness.

    Each side weighs the same, whatever its number of examples.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = np.zeros(x.shape[1])
    v, rate = w.copy(), 1 / (2 * 2.0 + penalty)
    for k in range(steps):
        gap = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (penalty * v - 2 * (x.T @ (weight * y * gap)))
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


@dataclass
class LanguageModel:
    families: list[tuple[str, list[str]]]  # with the languages learned of each
    family_w: np.ndarray  # (families, DIMS + 1)
    pair_w: dict[int, tuple[list[tuple[int, int]], np.ndarray]]  # by family: pairs of its languages, weights

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row of features."""
        n = len(x)
        x = np.hstack([x, np.ones((n, 1), x.dtype)])
        lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
        if not self.families or not n:
            return lang, score
        margins = x @ self.family_w.T
        family = margins.argmax(axis=1)
        sure = 1 / (1 + np.exp(-4 * margins.max(axis=1))) if len(self.families) > 1 else np.ones(n)
        for f, (_, langs) in enumerate(self.families):
            at = np.flatnonzero(family == f)
            pairs, w = self.pair_w.get(f, ([], None))
            votes = np.zeros((len(at), len(langs)))
            if pairs:
                m = x[at] @ w.T
                for k, (a, b) in enumerate(pairs):  # a vote each, and less than a vote for the margin
                    lean = np.tanh(m[:, k]) / (4 * len(langs))
                    votes[:, a] += (m[:, k] >= 0) + lean
                    votes[:, b] += (m[:, k] < 0) - lean
                best = votes.argmax(axis=1)
                won = np.array([[(m[r, k] if a == best[r] else -m[r, k]) for k, (a, b) in enumerate(pairs) if best[r] in (a, b)] for r in range(len(at))]).min(axis=1) if len(at) else np.zeros(0)
                sure[at] *= 1 / (1 + np.exp(-4 * won))
            else:
                best = np.zeros(len(at), int)
            lang[at] = np.array(langs, object)[best]
        score[:] = np.clip(sure, 0, 1)
        return lang, score


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tb.text_bytes(batch.column("text"))
        for i, j in tb.chunks(offsets, rows=ROWS):
            x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.record_batch([batch.column("lang").slice(i, j - i), batch.column("h").slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "h", "x"])


def fit(labelled: DataFrame, sample: int = SAMPLE, families: dict[str, tuple[str, ...]] = FAMILIES) -> LanguageModel:
    """Models from (doc_id, text, lang); rows with a null are left out. No rows: a model that says ``und``.

    Of each language the ``sample`` rows (fewer beyond ``SAMPLE_ALL`` in all) with the smallest hash of doc_id are taken,
    whole texts: first the counts, then a filter on the hash that a little more than enough rows pass, so no sort of the
    table is needed.
    """
    rows = labelled.where("doc_id is not null and text is not null and text <> '' and lang is not null").select("lang", "text", F.abs(F.xxhash64(F.col("doc_id").cast("string")) % 1_000_003).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    sample = max(1, min(sample, SAMPLE_ALL // max(1, len(counts))))
    few = F.lit(False)
    for lang, n in counts.items():
        few = few | ((F.col("lang") == lang) & (F.col("h") < int(1_000_003 * min(1.0, (1.2 * sample + 50) / n)) + 1))
    got = rows.where(few).mapInArrow(_vectors, "lang string, h bigint, x binary").collect() if counts else []
    by: dict[str, list[np.ndarray]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["h"], bytes(r["x"]))):
        if len(mine := by.setdefault(r["lang"], [])) < sample:
            mine.append(np.frombuffer(r["x"], np.float32))
    x = {k: np.array(v) for k, v in by.items()}
    of = {lang: next((f for f, known in families.items() if lang in known), f"own:{lang}") for lang in x}
    kinds = [(f, sorted(k for k in x if of[k] == f)) for f in sorted(set(of.values()))]
    every = np.vstack([x[k] for _, langs in kinds for k in langs]) if x else np.zeros((0, DIMS), np.float32)
    which = np.repeat(np.arange(len(kinds)), [sum(len(x[k]) for k in langs) for _, langs in kinds]) if x else np.zeros(0, int)
    family_w = np.array([svm(every, np.where(which == f, 1.0, -1.0)) if len(kinds) > 1 else np.zeros(DIMS + 1) for f in range(len(kinds))], np.float32).reshape(len(kinds), DIMS + 1)
    pair_w = {}
    for f, (_, langs) in enumerate(kinds):
        if pairs := list(combinations(range(len(langs)), 2)):
            pair_w[f] = (pairs, np.array([svm(np.vstack([x[langs[a]], x[langs[b]]]), np.repeat([1.0, -1.0], [len(x[langs[a]]), len(x[langs[b]])])) for a, b in pairs], np.float32))
    return LanguageModel(kinds, family_w, pair_w)


def _predict(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.text_bytes(batch.column("text"))
            for i, j in tb.chunks(offsets, rows=ROWS):
                d, part = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                lang, score = model.predict(features(d, part))
                none = ~letters(d, part)
                lang[none], score[none] = UNKNOWN, 0.0
                cols = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns)]
                yield pa.record_batch([*cols, pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) from ``text`` alone; columns of these names are replaced.

    Null or empty text, or one without a letter of any script: ``und`` with score 0. Long texts are read whole; equal
    texts get equal predictions; nulls in other columns pass through; an empty table stays empty.
    """
    docs = docs.drop("lang_pred", "score")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string", "score double"])
    return docs.mapInArrow(_predict(model), schema)


def held_out(doc_id: Column) -> Column:
    """Documents that no model may learn from: a third of the ids, by checksum."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
