"""Queries over algorithm boxes, formulas, tables as HTML, clusters and trimmed regions, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.geom import rect
from quillspark.operators import boxes, layout
from quillspark.plans.layout_queries import BOX, lines_of
from quillspark.plans.registry import query
from quillspark.sources.adapters import LINES_SQL

PAGE = layout.PAGE


@query("algorithm_boxes", LINES_SQL + """, r AS (SELECT doc_id, pno, y0 - 3 AS ry0, y0 - 2 AS ry1 FROM v WHERE col = 0 AND pi % 4 <> 3), w AS (SELECT doc_id, pno, y0 + 2 AS wy0, y1 AS wy1 FROM v WHERE col = 0 AND pi % 5 = 1),
t AS (SELECT r.doc_id, r.pno, ry0, ry1, max(wy1) AS low FROM r JOIN w ON r.doc_id = w.doc_id AND r.pno = w.pno AND wy0 >= ry1 - 2 AND wy0 <= ry1 + 25 GROUP BY 1, 2, 3, 4)
SELECT t.doc_id, t.pno, t.ry0 AS top, 50.0::DOUBLE AS x0, t.ry0 - 2 AS y0, 560.0::DOUBLE AS x1, min(n.ry0) + 1 + 2 AS y1 FROM t JOIN r n ON n.doc_id = t.doc_id AND n.pno = t.pno AND n.ry0 > t.ry0 AND n.ry0 > low + 3 AND n.ry0 - t.ry0 <= 300 GROUP BY 1, 2, 3""")
def algorithm_boxes(spark, d):
    lines, b = lines_of(spark, d).where("col = 0"), F.col("bbox")
    rules = lines.where("pi % 4 <> 3").select(*PAGE, rect(F.lit(54), b.y0 - 3, F.lit(500), b.y0 - 2).alias("bbox"))
    words = lines.where("pi % 5 = 1").select(*PAGE, F.lit("Algorithm").alias("word"), rect(b.x0, b.y0 + 2, b.x1, b.y1).alias("bbox"))
    bands = lines.select(*PAGE).distinct().select(*PAGE, F.lit(0).alias("band"), F.lit(50.0).alias("lo"), F.lit(560.0).alias("hi"))
    return boxes.algorithm_boxes(rules, words, bands).select(*PAGE, "top", *BOX)


@query("algorithm_members", LINES_SQL + "SELECT doc_id, pno, pi FROM v WHERE greatest(0, least(x1, 250) - greatest(x0, 50)) * greatest(0, least(y1, 400) - greatest(y0, 100)) >= 0.6::DOUBLE * (x1 - x0) * (y1 - y0)")
def algorithm_members(spark, d):
    lines = lines_of(spark, d)
    box = lines.select(*PAGE).distinct().withColumn("rect", rect(*map(F.lit, (50, 100, 250, 400))))
    return boxes.inside_share(lines, box, "pi").select(*PAGE, "pi")


@query("cell_specs", LINES_SQL + """, c AS (SELECT *, CASE WHEN pi % 3 > 0 THEN (pi % 4) / 4 END AS conf, CASE WHEN pi % 2 = 0 THEN pno END AS t FROM v)
SELECT doc_id, pno, pi, 'table' || coalesce(t::VARCHAR, '') AS cls, x1 - x0 < 20 AS nowrap FROM c WHERE coalesce(conf, 1) >= 0.5 AND x1 - x0 >= 8 AND y1 - y0 >= 5""")
def cell_specs(spark, d):
    p = F.col("pi")
    cells = lines_of(spark, d).withColumn("conf", F.when(p % 3 > 0, (p % 4) / 4)).withColumn("t", F.when(p % 2 == 0, F.col("pno")))
    return boxes.cell_specs(boxes.translatable_cells(cells)).select(*PAGE, "pi", "cls", "nowrap")


_ESC = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("table_html", LINES_SQL + f""", r AS (SELECT doc_id, pno, y0, string_agg('<td>' || CASE WHEN pi % 7 = 2 THEN '&#160;' ELSE {_ESC} END || '</td>', '' ORDER BY x0) AS tds FROM v GROUP BY 1, 2, 3),
n AS (SELECT doc_id, pno, count(DISTINCT x0) AS n FROM v GROUP BY 1, 2)
SELECT doc_id, pno, CASE WHEN n >= 2 THEN md5('<table>' || string_agg('<tr>' || tds || '</tr>', '' ORDER BY y0) || '</table>') END AS html FROM r JOIN n USING (doc_id, pno) GROUP BY doc_id, pno, n""")
def table_html(spark, d):
    cells = lines_of(spark, d).select(*PAGE, F.col("pi").alias("i"), "bbox", F.when(F.col("pi") % 7 == 2, "").otherwise(F.col("text")).alias("text"))
    return boxes.table_html(cells, PAGE).withColumn("html", F.md5("html"))


#: On every page: a formula of two lines with its number, a low one of three spans, a line of prose with two math letters.
FORMULA_SPANS = [(0, "x+y", "CMMI10", 100, 100, 130, 112), (1, "=ab", "CMSY10", 140, 100, 170, 112), (2, "z2", "CMMI7", 110, 114, 160, 124), (3, "(3)", "Times", 250, 99, 265, 111), (4, "abc", "CMMI10", 100, 200, 130, 209), (5, "def", "CMMI10", 132, 200, 160, 209), (6, "gh", "CMSY8", 162, 200, 180, 209), (7, "a long line of plain prose words", "Times", 60, 300, 280, 312), (8, "x", "CMMI10", 282, 300, 288, 312), (9, "y", "CMMI10", 290, 300, 296, 312)]


@query("display_formulas", LINES_SQL + "SELECT doc_id, pno, col, f AS formula, display, x0, y0, x1, y1 FROM (SELECT DISTINCT doc_id, pno FROM v), (VALUES (0, 0, true, 98.0::DOUBLE, 98.0::DOUBLE, 267.0::DOUBLE, 126.0::DOUBLE), (0, 1, false, 98.0, 198.0, 182.0, 211.0)) f(col, f, display, x0, y0, x1, y1)")
def display_formulas(spark, d):
    span = lambda i, t, f, *b: F.struct(F.lit(i).alias("i"), F.lit(t).alias("text"), F.lit(f).alias("font"), rect(*map(F.lit, b)).alias("bbox"))
    pages = lines_of(spark, d).select(*PAGE).distinct()
    spans = pages.select(*PAGE, F.lit(0).alias("col"), F.inline(F.array(*(span(*x) for x in FORMULA_SPANS))))
    return boxes.display_formulas(spans).select(*PAGE, "col", "formula", "display", *BOX)


@query("pseudo_clusters", LINES_SQL + """, p AS (SELECT doc_id, pno, pi, pi % 12 = 4 AS seed, pi % 12 IN (5, 6) AND col = 0 AS code, y0, y1, x0, x1 FROM v WHERE NOT two)
SELECT doc_id, pno, CAST(row_number() OVER (PARTITION BY doc_id, pno ORDER BY s.pi) - 1 AS INTEGER) AS cluster, 1 + (SELECT count(*) FROM p c WHERE c.doc_id = s.doc_id AND c.pno = s.pno AND c.code AND c.pi IN (s.pi + 1, s.pi + 2)) AS n FROM p s WHERE seed""")
def pseudo_clusters(spark, d):
    """Every twelfth line of one-column pages is a seed; the two lines under it are made to touch it and to be code."""
    b, p = F.col("bbox"), F.col("pi") % 12
    pieces = lines_of(spark, d).where("not two").select(*PAGE, F.col("pi").alias("i"), (p == 4).alias("seed"), boxes.looks_like_code(F.when(p.isin(5, 6), "k ← k + 1").otherwise("plain words")).alias("code"), rect(F.lit(50), b.y0 - 40, F.lit(300), b.y1).alias("bbox"))
    return boxes.pseudo_clusters(pieces).select(*PAGE, "cluster", F.col("n").cast("long").alias("n"))


@query("trimmed_regions", LINES_SQL + """SELECT doc_id, pno, CASE WHEN pno % 3 = 2 THEN 100.0 ELSE 121.0 END::DOUBLE AS x0, CASE WHEN pno % 3 = 0 THEN 131.0 ELSE 100.0 END::DOUBLE AS y0, 400.0::DOUBLE AS x1, CASE WHEN pno % 3 = 1 THEN 279.0 WHEN pno % 3 = 2 THEN 300.0 ELSE 289.0 END::DOUBLE AS y1 FROM (SELECT DISTINCT doc_id, pno FROM v)""")
def trimmed_regions(spark, d):
    """A region with a band of text at its top (pages 0, 3, …) or bottom (1, 4, …), a caption under it and a paragraph that reaches in from the left."""
    k = F.col("pno") % 3
    text = lambda t, *b: F.struct(rect(*map(F.lit, b)).alias("bbox"), F.lit(t).alias("text"))
    long = "a band of text that is longer than a label"
    none = F.slice(F.array(text(long, 0, 0, 1, 1)), 1, 0)
    texts = F.when(k == 0, F.array(text(long, 90, 90, 380, 130), text("label", 200, 285, 230, 299))).when(k == 1, F.array(text("two\nlines", 110, 280, 380, 310))).otherwise(none)
    paragraphs = F.when(k == 2, none).otherwise(F.array(text("", 20, 140, 120, 200), text("", 150, 150, 200, 180)))
    regions = lines_of(spark, d).select(*PAGE).distinct().withColumn("rect", rect(*map(F.lit, (100, 100, 400, 300)))).withColumn("texts", texts).withColumn("paragraphs", paragraphs)
    caption = F.when(k == 0, rect(*map(F.lit, (100, 290, 400, 310))))
    return boxes.trimmed(regions, "texts", "paragraphs", caption, F.lit(True)).select(*PAGE, "rect.*")
