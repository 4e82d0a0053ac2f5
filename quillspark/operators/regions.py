"""Reading order in bands, list groups, outline levels and link owners; page folds for paragraphs, columns and figures."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import geom
from quillspark.functions import text as T
from quillspark.operators.folds import fold_groups, line_blocks
from quillspark.operators.layout import PAGE, column_mode

_CAPTION, _REF = re.compile(r"(?i)^(fig(ure)?\.?\s|table\s)"), re.compile(r"(?i)^\[\d+\]|references[\s.:]*$")


def reflow_order(lines: DataFrame, divider: Column) -> DataFrame:
    """Position of each line: on two-column pages the left, then the right column above each divider, then the divider.

    In a column lines go by half their y0, rounded half to even, and x0; pages of one column go by y0 and x0.
    """
    b, two = F.col("bbox"), F.col("mode") == "two"
    rows = lines.join(column_mode(lines).select(*PAGE, "mode"), PAGE).withColumn("cut", (two & divider).cast("int")).withColumn("y", b.y0)
    above = Window.partitionBy(*PAGE).orderBy("y").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("band", F.sum("cut").over(above) - F.col("cut"))
    kind = F.when(F.col("cut") == 1, 2).when(two, F.col("col")).otherwise(0)
    q = F.when(two, F.bround(b.y0 / 2, 0)).otherwise(b.y0)
    order = Window.partitionBy(*PAGE).orderBy("band", kind, q, b.x0, "pi")
    return rows.withColumn("ord", F.row_number().over(order) - 1).drop("cut", "y", "mode")


def list_groups(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Runs of list items of one kind in rows (key, i, text): (key, first, tag, n, items), markers stripped."""
    t = F.col("text")
    item = t.rlike(T.LIST_ITEM) & ~t.rlike(T.CAPTION) & ~t.rlike(T.REFERENCE)
    tag = F.when(item & t.rlike(rf"^\s*[{T.BULLETS}]"), "ul").when(item, "ol").otherwise("")
    w = Window.partitionBy(key).orderBy("i")
    runs = blocks.withColumn("tag", F.coalesce(tag, F.lit(""))).withColumn("new", (F.coalesce(F.lag("tag").over(w), F.lit("?")) != F.col("tag")).cast("int")).withColumn("run", F.sum("new").over(w))
    items = F.array_sort(F.collect_list(F.struct("i", F.regexp_replace("text", T.LIST_LABEL, "").alias("x"))))
    out = runs.where("tag <> ''").groupBy(key, "run", "tag").agg(F.min("i").alias("first"), F.count("*").alias("n"), items.alias("s"))
    return out.select(key, "first", "tag", "n", F.transform("s", lambda s: s.x).alias("items"))


def toc_levels(headings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Outline levels of rows (key, i, level): the first is 1, each other is at most one deeper than the one before.

    The recurrence min(level, previous + 1) is a running minimum of level - position.
    """
    w = Window.partitionBy(key).orderBy("i")
    n = F.row_number().over(w)
    given = headings.withColumn("n", n).withColumn("given", F.when(F.col("n") == 1, 1).otherwise(F.col("level")))
    return given.withColumn("toc", (F.min(F.col("given") - F.col("n")).over(w) + F.col("n")).cast("int")).drop("n", "given")


def link_owners(links: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Paragraph with which each link (doc_id, pno, link, rect) shares the largest area; of equal areas the first."""
    p = paragraphs.select(*PAGE, "para", "bbox")
    hits = links.join(p, PAGE).withColumn("area", geom.shared_area(F.col("rect"), F.col("bbox"))).where("area > 0")
    best = hits.groupBy(*PAGE, "link").agg(F.min(F.struct((-F.col("area")).alias("a"), "para")).alias("x"))
    return links.select(*PAGE, "link").join(best, [*PAGE, "link"], "left").select(*PAGE, "link", F.col("x.para").alias("owner"))


@dataclass
class _Para:
    """A paragraph as it grows: its text, its lines, the characters of each size in the order of their appearance."""

    col: int
    text: str
    caption: bool
    ref: bool
    weights: dict[float, int]
    box: tuple[float, float, float, float]
    n: int = 1

    def take(self, line: _Para, text: str) -> None:
        for size, n in line.weights.items():
            self.weights[size] = self.weights.get(size, 0) + n
        pairs = zip(self.box, line.box, (min, min, max, max), strict=True)
        self.text, self.n, self.box = text, self.n + 1, tuple(pick(a, b) for a, b, pick in pairs)


class _Measures:
    """What the rules ask of a paragraph and the line after it."""

    def __init__(self, p: _Para, b: _Para):
        (px0, py0, px1, py1), (bx0, by0, bx1, by1) = p.box, b.box
        wide, high = max(0.0, min(px1, bx1) - max(px0, bx0)), max(0.0, min(py1, by1) - max(py0, by0))
        self.size = max(p.weights, key=p.weights.get)
        self.size_step = abs(self.size - next(iter(b.weights)))
        self.gap, self.overlap = by0 - py1, wide / max(1.0, min(px1 - px0, bx1 - bx0))
        self.of_para, self.of_line = (wide * high / max((c - a) * (d - e), 1e-9) for a, e, c, d in (p.box, b.box))
        self.para, self.line, self.both = len(p.text), len(b.text), len(p.text) + len(b.text) + 1
        self.text = not (p.caption or b.caption) and p.col == b.col
        self.plain, self.after_ref = self.text and not (p.ref or b.ref), self.text and p.ref and not b.ref
        self.left = bx0 <= px0 + 2


#: Ways in which a line joins the paragraph before it, the first that fits, with the text of both.
SHORT, CAP, REF_CAP = 120, 500, 800
JOINS = (
    (lambda m: m.plain and m.line <= SHORT and m.of_line >= 0.85 and m.size_step <= 1.5 and m.left, "{1} {0}"),
    (lambda m: m.plain and m.line <= SHORT and m.of_line >= 0.85 and m.size_step <= 1.5, "{0} {1}"),
    (lambda m: m.plain and m.para <= SHORT < m.line and m.of_para >= 0.85 and m.size_step <= 1.5, "{0} {1}"),
    (lambda m: m.after_ref and 0 <= m.gap < 2 * m.size and m.overlap > 0.5 and m.both <= REF_CAP, "{0}\n{1}"),
    (lambda m: m.plain and 0 <= m.gap < 1.5 * m.size and m.overlap > 0.6 and m.both <= CAP and (min(m.para, m.line) > SHORT or m.size_step <= 0.25), "{0}\n{1}"),
)


def _paragraphs(rows: list) -> list[tuple]:
    done: list[_Para] = []
    for r in rows:
        line = _Para(r.col, r.text, bool(_CAPTION.match(r.text)), bool(_REF.search(r.text)), {r.size: len(r.text)}, (r.x0, r.y0, r.x1, r.y1))
        seen = _Measures(done[-1], line) if done else None
        joined = next((form for fits, form in JOINS if seen and fits(seen)), None)
        if joined is None:
            done.append(line)
        else:
            done[-1].take(line, joined.format(done[-1].text, line.text))
    return [(rows[0].doc_id, rows[0].pno, k, p.col, p.n, p.text, p.caption, p.ref, *p.box) for k, p in enumerate(done)]


def paragraph_merge(lines: DataFrame) -> DataFrame:
    """Paragraphs of each page from lines (doc_id, pno, pi, col, text, size, x0, y0, x1, y1): contained pieces, reference
    continuations and normal continuations join the paragraph before them; captions stay alone. ``is_verbatim`` tells that
    what a paragraph became is a formula fragment or a line of an algorithm, which is not translated."""
    lines = lines.select(*PAGE, "pi", "col", "text", *(F.col(c).cast("double").alias(c) for c in ("size", "x0", "y0", "x1", "y1")))
    out = fold_groups(lines, PAGE, ["col", "y0", "x0", "pi"], _paragraphs, "doc_id long, pno int, para int, col int, n_lines int, text string, is_caption boolean, is_ref boolean, x0 double, y0 double, x1 double, y1 double")
    spans = F.array().cast("array<struct<text:string,font:string,flags:int>>")
    verbatim = T.math_fragment(F.col("text")) | T.algorithm_rest(F.col("text"), spans)
    return out.withColumn("is_verbatim", ~F.col("is_caption") & ~F.col("is_ref") & verbatim)


def region_split(lines: DataFrame, width: float | Column) -> DataFrame:
    """Blocks of OCR lines column by column, (page, col, block, x0, y0, x1, y1, n_lines).

    Columns are cut in the middle of stripes that no line covers: at least 6 points and 6 % of the page wide, between 8 and
    92 % of it, with a line to their right. Stripes are the steps between a line and what reaches furthest before it.
    """
    width = F.lit(width) if isinstance(width, float) else width
    low, high = F.greatest(F.lit(0), F.floor("x0")), F.floor("x1")
    w = Window.partitionBy(*PAGE).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.greatest(F.coalesce(F.max(high).over(w), F.lit(-1)) + 1, F.floor(0.08 * width))
    stripe = (low - begin >= F.greatest(F.lit(6.0), 0.06 * width)) & (low <= F.floor(0.92 * width))
    cut = lines.withColumn("cut", F.when(stripe, (begin + low) / 2))
    cut = cut.withColumn("cuts", F.collect_list("cut").over(Window.partitionBy(*PAGE)))
    column = F.size(F.filter("cuts", lambda c: (F.col("x0") + F.col("x1")) / 2 >= c)).cast("int")
    return line_blocks(cut.withColumn("col", column), [*PAGE, "col"])


def _figures(width: float, height: float):
    def run(rows: list) -> list[tuple]:
        boxes = [[r.x0, r.y0, r.x1, r.y1, 10 if r.image else 1] for r in rows if not (r.x1 - r.x0 >= 0.98 * width and r.y1 - r.y0 >= 0.98 * height)]
        while True:
            found: list[list] = []
            for b in boxes:
                hit = next((c for c in found if b[0] - 12 < c[2] and b[2] + 12 > c[0] and b[1] - 12 < c[3] and b[3] + 12 > c[1]), None)
                if hit is None:
                    found.append(list(b))
                else:
                    hit[:] = [min(hit[0], b[0]), min(hit[1], b[1]), max(hit[2], b[2]), max(hit[3], b[3]), hit[4] + b[4]]
            if len(found) == len(boxes):
                break
            boxes = found
        clamped = [(max(0.0, a), max(0.0, b), min(width, c), min(height, d)) for a, b, c, d, n in found if n >= 10 and c - a > 40 and d - b > 40]
        keep = [c for c in clamped if (c[2] - c[0]) * (c[3] - c[1]) <= 0.35 * width * height]
        return [(rows[0].doc_id, rows[0].pno, k, *c) for k, c in enumerate(keep)]

    return run


def figure_regions(marks: DataFrame, width: float, height: float) -> DataFrame:
    """Clusters of images and drawings (doc_id, pno, i, image, x0, y0, x1, y1) within 12 points; an image or ten drawings make one."""
    marks = marks.select(*PAGE, "i", "image", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    return fold_groups(marks, PAGE, ["i"], _figures(width, height), "doc_id long, pno int, region int, x0 double, y0 double, x1 double, y1 double")


def caption_binding(captions: DataFrame, areas: DataFrame, gap: float = 34.0) -> DataFrame:
    """Caption of each figure and table: (doc_id, pno, kind, region, caption), the first of those that chose it.

    ``captions`` are (doc_id, pno, caption, bbox), ``areas`` (doc_id, pno, kind, region, rect) with kind figure or table. A
    caption chooses the first figure that it stands under or in the lower part of, else the first table that it stands over
    or in the upper part of; half of the narrower width must be shared.
    """
    c, r = F.col("bbox"), F.col("rect")
    tall = r.y1 - r.y0
    figure = ((c.y0 >= r.y1 - 6) & (c.y0 - r.y1 <= gap)) | ((c.y0 >= r.y0 + 0.55 * tall) & (c.y1 <= r.y1 + 10))
    tabular = ((c.y1 <= r.y0 + 6) & (r.y0 - c.y1 <= gap)) | ((c.y0 >= r.y0 - 10) & (c.y1 <= r.y0 + 0.45 * tall))
    fits = F.when(F.col("kind") == "figure", figure).otherwise(tabular) & (geom.x_overlap(c, r) >= 0.5)
    chosen = captions.join(areas, PAGE).where(fits).groupBy(*PAGE, "caption").agg(F.min(F.struct("kind", "region")).alias("x"))
    return chosen.groupBy(*PAGE, F.col("x.kind").alias("kind"), F.col("x.region").alias("region")).agg(F.min("caption").alias("caption"))
