"""Tables on pages: three-line rules, column anchors of cells, and tables that run on to the next page."""

from __future__ import annotations

from collections import Counter
from decimal import ROUND_HALF_UP, Decimal
from itertools import groupby
from math import isfinite
from operator import attrgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import geom
from quillspark.operators.folds import fold_groups
from quillspark.operators.layout import PAGE
from quillspark.operators.wrapping import alike as alike_texts

TABLE = [*PAGE, "tbl"]
NUMERIC = r"^[0-9.,%]+$"


def rule_tables(rules: DataFrame, bands: DataFrame) -> DataFrame:
    """Tables between three or more long rules: (doc_id, pno, tbl, x0, y0, x1, y1).

    ``rules`` are (doc_id, pno, x0, y0, x1, y1), ``bands`` the text columns (doc_id, pno, band, lo, hi). Of the rules that
    start at the left of a band and cover 70 % of it, those within 4 points of the most frequent ends count (of equal
    counts the one highest up); a run whose steps are 8 to 80 points is a table. A table that meets an earlier one goes.
    """
    width, band = F.col("hi") - F.col("lo"), [*PAGE, "band"]
    wide = rules.where("y1 - y0 <= 2.5 and x1 - x0 >= 40").join(bands, PAGE).where(F.col("x0").between(F.col("lo") - 10, F.col("lo") + 0.15 * width) & (F.col("x1") - F.col("x0") >= 0.7 * width))
    ends = wide.groupBy(*band, F.bround("x0").alias("mx0"), F.bround("x1").alias("mx1")).agg(F.count("*").alias("n"), F.min("y0").alias("y"))
    mode = ends.groupBy(*band).agg(F.min(F.struct((-F.col("n")).alias("n"), "y", "mx0", "mx1")).alias("m"))
    near = wide.join(mode, band).where("abs(x0 - m.mx0) < 4 and abs(x1 - m.mx1) < 4")
    w = Window.partitionBy(*band).orderBy("y0", "x0")
    step = F.col("y0") - F.lag("y0").over(w)
    runs = near.withColumn("new", F.coalesce((~step.between(8, 80)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    found = runs.groupBy(*band, "run", "lo", "hi").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max_by("y1", "y0").alias("y1")).where("n >= 3")
    boxes = found.select(*PAGE, F.struct(F.greatest(F.col("x0") - 6, "lo").alias("x0"), (F.col("y0") - 2).alias("y0"), F.least(F.col("x1") + 6, "hi").alias("x1"), (F.col("y1") + 2).alias("y1")).alias("r"), "band", "run")
    def keep(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda k: geom.shared_area(k, x.r) > 0), kept).otherwise(F.concat(kept, F.array(x.r)))

    # A page holds few tables: the fold is over one page's finds.
    all_boxes = F.array_sort(F.collect_list(F.struct("band", "run", "r")))
    empty = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    return boxes.groupBy(*PAGE).agg(all_boxes.alias("s")).select(*PAGE, F.posexplode(F.aggregate("s", empty, keep)).alias("tbl", "r")).select(*TABLE, "r.*")


def _rounded(x: float) -> float:
    """To tenths as Spark's round does: half up by the shortest decimal form."""
    return float(Decimal(repr(x)).quantize(Decimal("0.1"), ROUND_HALF_UP)) if isfinite(x) else x


def _anchors(bands: list[list[float]]) -> list[tuple[float, int]]:
    """Cluster means (steps of 2 at most) of each band's positions with the number of bands that have them, in order."""
    means: list[float] = []
    for xs in bands:
        xs, start = sorted(xs), 0
        for k in range(1, len(xs) + 1):
            if k == len(xs) or xs[k] - xs[k - 1] > 2:
                means.append(_rounded(sum(xs[start:k]) / (k - start)))
                start = k
    return sorted(Counter(means).items())


def _cells(rows: list) -> list[tuple]:
    """Cells of one table from its items, sorted by band, x0, x1 and text."""
    bands = [list(g) for _, g in groupby(rows, key=attrgetter("band"))]
    need = max(2, int(len(bands) * 0.3))
    left = [x for x, n in _anchors([[r.x0 for r in g] for g in bands]) if n >= need]
    right = [x for x, n in _anchors([[r.x1 for r in g] for g in bands]) if n >= need and all(abs(x - y) > 4 for y in left)]

    def slot(r) -> int | None:
        found = next((k for k, x in enumerate(left) if abs(r.x0 - x) <= 3), None)
        return next((k + 1000 for k, x in enumerate(right) if abs(r.x1 - x) <= 3), None) if found is None else found

    slots = [[slot(r) for r in g] for g in bands]
    sets = [tuple(sorted({x for x in s if x is not None})) for s in slots]
    counts = Counter(s for s in sets if s)
    top, modal = max(counts.values(), default=0), ()
    if top:
        modal = next(s for s in sets if counts[s] == top)
    out = []
    for g, own, mine in zip(bands, slots, sets, strict=True):
        conf = 0.4 if len(left) < 2 or not mine or top < 2 else 0.9 if mine == modal else 0.7
        gaps, n, end = [], 0, None
        for r in g:
            n += end is None or r.x0 - end > 12 or bool(r.number and r.x0 >= end - 2)
            gaps.append(n)
            end = r.x1
        for k in range(len(g) - 2, -1, -1):  # equal items stand together
            if (g[k].x0, g[k].x1, g[k].text) == (g[k + 1].x0, g[k + 1].x1, g[k + 1].text):
                gaps[k] = gaps[k + 1]
        cells: dict[int, list[str]] = {}
        for k, r in enumerate(g):
            key = gaps[k] if conf == 0.4 else own[k] if own[k] is not None else k + 10_001
            cells.setdefault(key, []).extend([r.text] if r.text is not None else [])
        out += [(r.doc_id, r.pno, r.tbl, r.band, k, " ".join(cells[key]), conf) for k, key in enumerate(sorted(cells))]
    return out


def anchor_split(items: DataFrame) -> DataFrame:
    """Cells of a table's rows: (doc_id, pno, tbl, band, cell, text, conf) from items (doc_id, pno, tbl, band, x0, x1, text).

    Positions that 30 % of the rows (two at least) share are anchors: left edges, and right edges further than 4 points
    from those. Items within 3 points of an anchor share its cell, others stand alone behind. Rows with the most frequent
    set of anchors have confidence 0.9, others 0.7. Where there are fewer than two left anchors or no set occurs twice,
    and in rows without any anchor, items are cut at gaps over 12 points and before numbers, with confidence 0.4. Items
    with a null key are left out. A fold over one table's items.
    """
    edges = (F.col(c).cast("double").alias(c) for c in ("x0", "x1"))
    rows = items.dropna(subset=[*TABLE, "band"]).select(*TABLE, "band", *edges, "text", F.col("text").rlike(NUMERIC).alias("number"))
    kinds = ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in (*TABLE, "band"))
    return fold_groups(rows, TABLE, ["band", "x0", "x1", "text"], _cells, f"{kinds}, cell int, text string, conf double")


def crosspage_tables(tables: DataFrame, height: float) -> DataFrame:
    """Tables that go on on the next page: (doc_id, pno, tbl, from_pno, from_tbl, gid).

    ``tables`` are (doc_id, pno, tbl, y0, y1, head, anchors array<double>). The lowest table of a page, if it starts below
    55 % of the page, and the highest one of the next, if it ends above 45 %, are linked where over 0.8 of both first rows is
    in matching blocks, or 70 % of the left edges agree within 2 points. ``gid`` is the number of the page on which the chain
    of links starts. Only pairs at a page break are compared in Python.
    """
    @F.pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        return alike_texts(a, b)


    pick = tables.withColumn("t", F.struct("tbl", "y0", "y1", "head", "anchors")).groupBy(*PAGE)
    ends = pick.agg(F.max_by("t", F.struct("y0", -F.col("tbl"))).alias("low"), F.min_by("t", F.struct("y0", "tbl")).alias("top"))
    nxt = ends.select("doc_id", (F.col("pno") - 1).alias("pno"), F.col("top").alias("next"))
    low, top = F.col("low"), F.col("next")
    hits = F.size(F.filter(low["anchors"], lambda a: F.exists(top["anchors"], lambda b: F.abs(a - b) <= 2)))
    edges = (F.size(low["anchors"]) > 0) & (hits >= 0.7 * F.size(low["anchors"]))
    pairs = ends.join(nxt, PAGE).where((low["y0"] >= 0.55 * height) & (top["y1"] <= 0.45 * height))
    alike = (F.length(low["head"]) > 0) & (F.length(top["head"]) > 0) & (F.col("like") > 0.8)
    links = pairs.withColumn("like", likeness(low["head"], top["head"])).where(F.coalesce(alike | edges, F.lit(False)))
    links = links.select("doc_id", (F.col("pno") + 1).alias("pno"), top["tbl"].alias("tbl"), F.col("pno").alias("from_pno"), low["tbl"].alias("from_tbl"))
    # A chain goes on where the table that ends a page is the one that was carried over to it.
    w = Window.partitionBy("doc_id").orderBy("pno")
    chained = (F.lag("pno").over(w) == F.col("from_pno")) & (F.lag("tbl").over(w) == F.col("from_tbl"))
    start = F.when(~F.coalesce(chained, F.lit(False)), F.col("from_pno"))
    return links.withColumn("gid", F.last(start, True).over(w))
