"""Readings of scanned pages: results of several engines as one table, words as lines, regions of a layout model."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.geom import rect
from quillspark.operators.folds import fold_groups, runs_of

READING = "x0 double, y0 double, x1 double, y1 double, text string, score double"


def in_points(readings: DataFrame, dpi: int, width: Column, height: Column) -> DataFrame:
    """Readings (…, x0, y0, x1, y1, score) in pixels as points, cut at the page's edges, scores cut to 0 to 1."""
    at = lambda c, high: F.greatest(F.lit(0.0), F.least(F.col(c) * 72 / dpi, high))
    box = rect(at("x0", width), at("y0", height), at("x1", width), at("y1", height))
    return readings.withColumn("bbox", box).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score"))).drop("x0", "y0", "x1", "y1")


def _joined(keys: list[str]):
    """Runs of words of one line in a batch as one row: the words with blanks between them, their lengths and left edges, box, sum and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = runs_of(batch, keys)
            offsets = pa.array(np.append(starts, len(batch)).astype(np.int32))
            of = lambda a: pa.ListArray.from_arrays(offsets, a)
            number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            least = lambda f, c: pa.array(f.reduceat(number(c), starts) if len(starts) else np.zeros(0), from_pandas=True)
            word, left = batch.column("text"), pc.fill_null(batch.column("left"), -np.inf)
            out = {c: batch.column(c).take(pa.array(starts)) for c in keys}
            out |= {"text": pc.binary_join(of(word), " "), "lens": of(pc.utf8_length(word)), "lefts": of(left)}
            out |= {"x0": least(np.fmin, "x0"), "y0": least(np.fmin, "y0"), "x1": least(np.fmax, "x1"), "y1": least(np.fmax, "y1"), "conf": least(np.add, "conf"), "n": pa.array(np.diff(np.append(starts, len(batch))))}
            yield pa.record_batch(list(out.values()), list(out))

    return run


def _line(n: int):
    def run(runs: list) -> list[tuple]:
        text, lefts = runs[0].text, runs[0].lefts
        if len(runs) > 1 or any(a >= b for a, b in pairwise(lefts)):
            words = []
            for r in runs:
                at = [0, *accumulate(k + 1 for k in r.lens)]
                words += zip(r.lefts, (r.text[i : i + k] for i, k in zip(at, r.lens, strict=False)), strict=True)
            text = " ".join(w for _, w in sorted(words))
        box = (f((x for r in runs if (x := r[i]) == x), default=None) for f, i in ((min, n + 3), (min, n + 4), (max, n + 5), (max, n + 6)))
        return [(*runs[0][:n], text, *box, sum(r.conf for r in runs) / sum(r.n for r in runs) / 100)]

    return run


def words_to_lines(words: DataFrame, page: list[str]) -> DataFrame:
    """Words (page, block, par, line, left, top, width, height, text, conf) as lines; blank and unsure (negative) ones go.

    A line's text goes by the words' left edges, its score is the mean confidence in hundredths. Words of a line that come
    one after another are joined before they are dealt by line; a line's parts are put in order then.
    """
    good, keys = words.where((F.length(F.trim("text")) > 0) & (F.col("conf") >= 0)), [*page, "block", "par", "line"]
    box = rect(F.col("left"), F.col("top"), F.col("left") + F.col("width"), F.col("top") + F.col("height"))
    flat = good.select(*keys, F.col("left").cast("double").alias("left"), F.trim("text").alias("text"), F.col("conf").cast("double").alias("conf"), box.alias("b")).select(*keys, "left", "text", "conf", "b.*")
    kinds = ", ".join(f"{c} {words.schema[c].dataType.simpleString()}" for c in keys)
    corners = "x0 double, y0 double, x1 double, y1 double"
    runs = flat.mapInArrow(_joined(keys), f"{kinds}, text string, lens array<int>, lefts array<double>, {corners}, conf double, n bigint")
    out = fold_groups(runs, keys, [], _line(len(keys)), f"{kinds}, text string, {corners}, score double")
    return out.select(*keys, "text", rect(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("bbox"), "score")


def _corners(points) -> tuple[float, float, float, float]:
    flat = [float(v) for p in points for v in (p if isinstance(p, list) else [p])]
    xs, ys = flat[0::2], flat[1::2]
    return min(xs), min(ys), max(xs), max(ys)


def read_result(result: object) -> Iterator[tuple]:
    """Readings of an engine's result of either shape, however deep it lies: a table of texts with boxes, or pairs (box, (text, score))."""
    if isinstance(result, dict):
        texts = result.get("rec_texts")
        if not texts:
            for v in result.values():
                yield from read_result(v)
            return
        boxes = result.get("rec_boxes") or result.get("rec_polys") or []
        scores = result.get("rec_scores") or []
        for text, box, score in zip(texts, boxes, [*scores, *[1.0] * len(texts)], strict=False):
            if text and sum(len(p) if isinstance(p, list) else 1 for p in box) >= 8:
                yield (*_corners(box), str(text), float(score))
    elif isinstance(result, list):
        match result:
            case [box, [str(text), score]]:
                try:
                    yield (*_corners(box), text, float(score))
                except (TypeError, ValueError, IndexError):
                    return
            case _:
                for v in result:
                    yield from read_result(v)


def normalised(results: DataFrame, key: str) -> DataFrame:
    """(key, i, x0, y0, x1, y1, text, score) of JSON results (key, result); what is no JSON or has another shape gives no rows."""
    kind = results.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, raw in zip(pdf[key], pdf["result"], strict=True):
                try:
                    got = json.loads(raw) if raw else None
                except ValueError:
                    continue
                rows += [(k, i, *r) for i, r in enumerate(read_result(got))]
            yield pd.DataFrame(rows, columns=[key, "i", "x0", "y0", "x1", "y1", "text", "score"])

    return results.select(key, "result").mapInPandas(run, f"{key} {kind}, i int, {READING}")


#: Kinds of regions by a part of the name that a layout model gives them, the first that fits.
KINDS = (("header", "header"), ("footer", "footer"), ("caption", "caption"), ("table", "table"), ("picture", "figure"), ("figure", "figure"), ("formula", "formula"), ("list", "list"), ("title", "title"))


def region_kind(name: Column) -> Column:
    """Kind of a region from a model's name of it; text for any other."""
    out = F.lit("text")
    for part, kind in reversed(KINDS):
        out = F.when(F.contains(F.lower(name), F.lit(part)), kind).otherwise(out)
    return out


def missing_glyphs(texts: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """Characters of each key's texts (key, text) that a table of covered ones (char) has not, white space apart: (key, char, n)."""
    chars = texts.select(key, F.explode(F.regexp_extract_all("text", F.lit(r"(?U)\S"), F.lit(0))).alias("char"))
    counts = chars.groupBy(key, "char").agg(F.count("*").alias("n"))
    return counts.join(covered.select("char"), "char", "left_anti").select(key, "char", "n")
