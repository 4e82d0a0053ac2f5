"""Boxes on a page: algorithms between rules, formulas grown from their fonts, pseudo-code clusters, trimmed figures, tables as HTML."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby
from operator import attrgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import geom
from quillspark.operators.folds import fold_groups
from quillspark.operators.layout import PAGE
from quillspark.operators.reflow import escape

# Fonts of formulas, signs and words of pseudo-code.
MATH_FONTS = ("CMMI", "CMSY", "CMEX", "MSBM", "EUFM", "CambriaMath", "MTSY", "MTMI", "MTEX", "RMTMI")
CODE_SIGNS = "{}⟨⟩←∼~⌊⌋"
CODE_WORDS = ("for", "while", "if", "else", "end", "return", "break", "sample", "Input", "Output", "Require", "Ensure", "Initialize")


def algorithm_boxes(rules: DataFrame, words: DataFrame, bands: DataFrame) -> DataFrame:
    """Boxes of algorithms, (page, band, top, bbox): from a long rule with the word Algorithm at most 25 points under it to the
    next one that is lower than that word and at most 300 points below.

    ``rules`` and ``words`` are (page, bbox[, word]), ``bands`` the text columns (page, band, lo, hi). Long are rules that
    start at the left of a band and cover 70 % of it.
    """
    b, width, band = F.col("bbox"), F.col("hi") - F.col("lo"), [*PAGE, "band"]
    wide = rules.where((b.y1 - b.y0 <= 2.5) & (b.x1 - b.x0 >= 40)).join(bands, PAGE)
    wide = wide.where(b.x0.between(F.col("lo") - 10, F.col("lo") + 0.15 * width) & (b.x1 - b.x0 >= 0.7 * width)).select(*band, "lo", "hi", "bbox")
    named = words.where("word = 'Algorithm'").select(*PAGE, F.col("bbox").alias("w"))
    under = (F.col("w").y0 >= b.y1 - 2) & (F.col("w").y0 <= b.y1 + 25) & F.col("w").x0.between(F.col("lo") - 5, F.col("hi"))
    tops = wide.join(named, PAGE).where(under).groupBy(*band, "lo", "hi", "bbox").agg(F.max(F.col("w").y1).alias("low"))
    nexts = wide.select(*band, F.col("bbox").alias("nxt"))
    n = F.col("nxt")
    found = tops.join(nexts, band).where((n.y0 > b.y0) & (n.y0 > F.col("low") + 3) & (n.y0 - b.y0 <= 300))
    best = found.groupBy(*band, "lo", "hi", b.y0.alias("top")).agg(F.min(F.struct(n.y0, n.y1.alias("y1"))).alias("n"))
    return best.select(*band, "top", geom.rect(F.col("lo"), F.col("top") - 2, F.col("hi"), F.col("n.y1") + 2).alias("bbox"))


def inside_share(blocks: DataFrame, boxes: DataFrame, key: str, share: float = 0.6) -> DataFrame:
    """Blocks of which a box (page, rect) holds all or ``share`` of the area."""
    b, r = F.col("bbox"), F.col("rect")
    hit = blocks.join(boxes.select(*PAGE, "rect"), PAGE).where(geom.shared_area(b, r) >= share * geom.area(b)).select(*PAGE, key).distinct()
    return blocks.join(hit, [*PAGE, key], "left_semi")


def translatable_cells(cells: DataFrame) -> DataFrame:
    """Cells that were found surely enough: a confidence of 0.5, or none."""
    return cells.where(F.coalesce("conf", F.lit(1.0)) >= 0.5)


def cell_specs(cells: DataFrame) -> DataFrame:
    """Specs of cells (…, t, bbox): those of 8 by 5 points and more, with their table's class; narrow ones do not wrap."""
    b = F.col("bbox")
    big = cells.where((b.x1 - b.x0 >= 8) & (b.y1 - b.y0 >= 5))
    return big.withColumn("cls", F.concat(F.lit("table"), F.coalesce(F.col("t").cast("string"), F.lit("")))).withColumn("nowrap", b.x1 - b.x0 < 20)


def starts(values: Column, gap: Column) -> Column:
    """Of sorted values those that are further than a gap from the last one that was taken."""
    kind = "array<double>"
    return F.aggregate(values, F.array().cast(kind), lambda a, x: F.when((F.size(a) == 0) | (x - F.element_at(a, -1) > gap), F.array_append(a, x)).otherwise(a).cast(kind))


def nearest(at: Column, x: Column) -> Column:
    """Number (from 0) of the nearest of several positions, of equally near ones the first."""
    return F.array_min(F.transform(at, lambda a, i: F.struct(F.abs(a - x).alias("d"), i.alias("i")))).i


def table_html(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, html) of cells (keys, i, bbox, text): rows by their tops, columns by left edges over 4 points apart, spans by right edges.

    A cell belongs to the row whose first top is at most 0.6 upper median heights above. A cell over a column that one to its
    left covers is left out; fewer than two columns make no table (null). A fold over the cells of one table.
    """
    b = F.col("bbox")
    heights, edges = F.sort_array(F.collect_list(b.y1 - b.y0)), F.sort_array(F.collect_list(b.x0))
    tops = F.sort_array(F.collect_list(b.y0))
    shape = cells.groupBy(*keys).agg(heights.alias("hs"), edges.alias("xs"), tops.alias("ys"))
    middle = F.element_at("hs", (F.floor(F.size("hs") / 2) + 1).cast("int"))
    shape = shape.select(*keys, starts(F.col("xs"), F.lit(4.0)).alias("at"), starts(F.col("ys"), 0.6 * middle).alias("rows"))
    placed = cells.join(shape, keys)
    row = F.size(F.filter("rows", lambda y: y <= b.y0))
    first, last, n = nearest(F.col("at"), b.x0), nearest(F.col("at"), b.x1), F.size("at")
    placed = placed.select(*keys, "at", row.alias("row"), b.x0.alias("x0"), "i", first.alias("c"), F.greatest(F.lit(1), F.least(n - first, last - first)).alias("span"), "text")
    rows = placed.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("x0", "i", "c", "span", "text"))).alias("xs"), F.first(F.size("at")).alias("n"))
    kind = "struct<next:int,out:string>"
    td = lambda x: F.concat(F.lit("<td"), F.when(x.span > 1, F.concat(F.lit(" colspan="), x.span.cast("string"))).otherwise(""), F.lit(">"), F.when(F.length(x.text) > 0, escape(x.text)).otherwise("&#160;"), F.lit("</td>"))
    step = lambda a, x: F.when(x.c < a.next, a).otherwise(F.struct((x.c + x.span).alias("next"), F.concat(a.out, td(x)).alias("out"))).cast(kind)
    cells_html = F.aggregate("xs", F.struct(F.lit(0).alias("next"), F.lit("").alias("out")).cast(kind), step, lambda a: a.out)
    lines = rows.select(*keys, "row", "n", F.concat(F.lit("<tr>"), cells_html, F.lit("</tr>")).alias("tr")).groupBy(*keys)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "tr"))), lambda x: x.tr), "")
    out = lines.agg(body.alias("body"), F.max("n").alias("n"))
    return out.select(*keys, F.when(F.col("n") >= 2, F.concat(F.lit("<table>"), "body", F.lit("</table>"))).alias("html"))


def is_math(font: Column) -> Column:
    low = F.lower(font)
    found = F.lit(False)
    for part in MATH_FONTS:
        found = found | F.contains(low, F.lit(part.lower()))
    return found


def _chains(rows: list) -> list[list]:
    """Chains of a column's spans, sorted by y0, x0 and i, as [y0, x0, math, math_chars, chars, box]."""
    bands: list[list] = []
    far = None
    for r in rows:
        if far is None or r.y0 >= far:
            bands.append([])
        far = r.y1 if far is None else max(far, r.y1)
        bands[-1].append(r)
    out: list[list] = []
    for band in bands:
        end = None
        for r in sorted(band, key=lambda r: (r.x0, r.i)):
            if end is None or r.x0 - end > 24:
                out.append([0.0, 0.0, 0, 0, 0, (r.x0, r.y0, r.x1, r.y1)])
            c = out[-1]
            c[2], c[3], c[4], c[5] = c[2] + r.m, c[3] + r.m * r.n, c[4] + r.n, _union(c[5], (r.x0, r.y0, r.x1, r.y1))
            end = r.x1 if end is None else max(end, r.x1)
    for c in out:
        c[0], c[1] = c[5][1], c[5][0]
    return sorted(out)


def _union(a: tuple, b: tuple) -> tuple:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def _shared(a: tuple, b: tuple) -> float:
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def _formulas(rows: list) -> list[tuple]:
    """Formulas of a page from its spans, sorted by col, y0, x0 and i."""
    if not any(r.m for r in rows):
        return []
    kept: list[tuple] = []
    for col, own in groupby(rows, key=attrgetter("col")):
        own, runs = list(own), []
        for _, _, math, math_chars, chars, box in _chains([r for r in own if r.shown]):
            if runs:
                p = runs[-1]
                shared, step = min(p[3][2], box[2]) - max(p[3][0], box[0]), box[1] - p[3][3]
                narrow = min(p[3][2] - p[3][0], box[2] - box[0])
                if shared > 0.35 * narrow and -12 <= step <= 8 and p[1] + math_chars >= 0.5 * (p[2] + chars):
                    runs[-1] = (p[0] + math, p[1] + math_chars, p[2] + chars, _union(p[3], box))
                    continue
            runs.append((math, math_chars, chars, box))
        numbers = [r for r in own if r.number and col is not None]
        for math, math_chars, chars, (x0, y0, x1, y1) in runs:
            low, ratio = y1 - y0 < 13, math_chars / chars
            if not (math >= 3 and ratio >= 0.5 if low else math >= 2 and ratio >= 0.22):
                continue
            x0, y0, x1, y1 = x0 - 2, y0 - 2, x1 + 2, y1 + 2
            beside = [r.x1 + 2 for r in numbers if x1 - 4 <= r.x0 <= x1 + 110 and min(y1, r.y1) > max(y0, r.y0)]
            box = (x0, y0, max([x1, *beside]), y1)
            if not any(_shared(k[2], box) > 0.3 * ((box[2] - x0) * (y1 - y0)) for k in kept):
                kept.append((col, not low, box))
    return [(rows[0].doc_id, rows[0].pno, col, k, display, *box) for k, (col, display, box) in enumerate(kept)]


def display_formulas(spans: DataFrame) -> DataFrame:
    """Formulas of each column, (page, col, formula, display, bbox), from spans (page, col, i, text, font, bbox).

    Spans of one height band that are at most 24 points apart are a chain. Chains under each other go together if they share
    35 % of the narrower width, are 12 points over to 8 under each other, and half of their characters are in math fonts.
    Low ones (under 13 points) count with three such spans and half of the characters, others with two and 0.22; only those
    are displayed by themselves. A number "(n)" at most 110 points to the right at the same height belongs to its formula. A
    formula that an earlier one covers by 30 % goes. A page without math fonts has none; a null font is
    none of them. A fold over one page.
    """
    edges = (F.col("bbox")[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))
    text, math = F.trim("text"), F.coalesce(is_math(F.col("font")).cast("int"), F.lit(0))
    flat = spans.select(*PAGE, "col", "i", *edges, (F.length(text) > 0).alias("shown"), text.rlike(r"^\(\d+\)$").alias("number"), math.alias("m"), F.length("text").alias("n"))
    kinds = ", ".join(f"{c} {spans.schema[c].dataType.simpleString()}" for c in (*PAGE, "col"))
    out = fold_groups(flat, PAGE, ["col", "y0", "x0", "i"], _formulas, f"{kinds}, formula int, display boolean, x0 double, y0 double, x1 double, y1 double")
    return out.select(*PAGE, "col", "formula", "display", geom.rect(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("bbox"))


def looks_like_code(text: Column) -> Column:
    signs = "|".join("\\" + c if c.isascii() else c for c in CODE_SIGNS)
    return text.rlike(signs) | text.rlike(r"\b(?:" + "|".join(CODE_WORDS) + r")\b")


def pseudo_clusters(paragraphs: DataFrame) -> DataFrame:
    """Pieces of pseudo-code that belong together, (page, cluster, n, x0, y0, x1, y1), from paragraphs (page, i, seed, code, bbox).

    A seed takes in what touches the box of the cluster and is code, again and again until nothing more does; a piece of an
    earlier cluster is no seed of another. A fold over one page.
    """
    def touch(u: list[float], r) -> bool:
        return u[0] < r.x1 and r.x0 < u[2] and u[1] < r.y1 and r.y0 < u[3]

    def run(pieces: list) -> list[tuple]:
        used, out = set(), []
        for k, seed in enumerate(pieces):
            if not seed.seed or k in used:
                continue
            box, mine, grew = [seed.x0, seed.y0, seed.x1, seed.y1], {k}, True
            while grew:
                near = [j for j, r in enumerate(pieces) if j not in mine and r.code and touch(box, r)]
                grew = bool(near)
                for j in near:
                    r = pieces[j]
                    box = [min(box[0], r.x0), min(box[1], r.y0), max(box[2], r.x1), max(box[3], r.y1)]
                mine.update(near)
            used |= mine
            out.append((seed.doc_id, seed.pno, len(out), len(mine), *box))
        return out

    flat = paragraphs.select(*PAGE, "i", "seed", "code", *(F.col("bbox")[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    return fold_groups(flat, PAGE, ["i"], run, "doc_id long, pno int, cluster int, n int, x0 double, y0 double, x1 double, y1 double")


def trimmed(regions: DataFrame, texts: str, paragraphs: str, caption: Column, caption_below: Column) -> DataFrame:
    """Figure regions (…, rect) without the text they took in: arrays ``texts`` (bbox, text) and ``paragraphs`` (bbox) of their page.

    Texts of 30 characters or several lines that reach an upper or lower edge (4 points) and are lower than 0.6 of the region
    are cut off; so is the bound caption; paragraphs of which at most 0.4 lie inside push the side they come from. A region
    that would end narrower than 10 or lower than 8 points stays as it was.
    """
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    moved: Callable = lambda r, **to: F.struct(*(to.get(c, r[c]).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))).cast(box)

    def cut(r: Column, t: Column) -> Column:
        b = t.bbox
        text = (F.length(F.trim(t.text)) >= 30) | F.contains(F.trim(t.text), F.lit("\n"))
        flat = (b.y1 - b.y0 < 0.6 * (r.y1 - r.y0)) & text & (geom.shared_area(b, r) > 0)
        return F.when(flat & (b.y0 <= r.y0 + 4), moved(r, y0=F.greatest(r.y0, b.y1 + 1))).when(flat & (b.y1 >= r.y1 - 4), moved(r, y1=F.least(r.y1, b.y0 - 1))).otherwise(r).cast(box)

    def push(r: Column, p: Column) -> Column:
        b, half = p.bbox, 0.5 * (r.x1 - r.x0)
        out = (geom.shared_area(b, r) > 0) & (geom.shared_area(b, r) <= 0.4 * geom.area(b))
        return F.when(out & (b.x1 <= r.x0 + half) & (b.x1 > r.x0), moved(r, x0=F.greatest(r.x0, b.x1 + 1))).when(out & (b.x0 >= r.x1 - half) & (b.x0 < r.x1), moved(r, x1=F.least(r.x1, b.x0 - 1))).otherwise(r).cast(box)

    old = F.col("rect").cast(box)
    rows = regions.withColumn("__r", F.aggregate(texts, old, cut)).withColumn("__c", caption)
    r, c = F.col("__r"), F.col("__c")
    rows = rows.withColumn("__r", F.when(c.isNull(), r).when(caption_below, moved(r, y1=F.least(r.y1, c.y0 - 1))).otherwise(moved(r, y0=F.greatest(r.y0, c.y1 + 1))))
    rows = rows.withColumn("__r", F.aggregate(paragraphs, F.col("__r").cast(box), push))
    whole = (F.col("__r").x1 - F.col("__r").x0 >= 10) & (F.col("__r").y1 - F.col("__r").y0 >= 8)
    return rows.withColumn("rect", F.when(whole, F.col("__r")).otherwise(old)).drop("__r", "__c")
