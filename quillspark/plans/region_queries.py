"""Queries over reading order, lists, outline, links, paragraphs, columns and figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.geom import rect
from quillspark.operators import layout, regions
from quillspark.plans.layout_queries import _MODE, lines_of
from quillspark.plans.registry import query
from quillspark.sources.adapters import LINES_SQL

MARKS = [(False, 0.0, 0.0, 612.0, 842.0), (True, 100.0, 100.0, 200.0, 200.0), (False, 205.0, 120.0, 260.0, 180.0), (False, 400.0, 600.0, 500.0, 700.0), (True, 400.0, 400.0, 430.0, 430.0)]


@query("reflow_order", _MODE + """, d AS (SELECT v.*, mode, mode = 'two' AND size > 13 AS cut FROM v JOIN pm USING (doc_id, pno)),
b AS (SELECT *, (SELECT count(*) FROM d c WHERE c.doc_id = d.doc_id AND c.pno = d.pno AND c.cut AND c.y0 <= d.y0) - CASE WHEN cut THEN 1 ELSE 0 END AS band FROM d)
SELECT doc_id, pno, pi, CAST(row_number() OVER (PARTITION BY doc_id, pno ORDER BY band, CASE WHEN cut THEN 2 WHEN mode = 'two' THEN col ELSE 0 END, CASE WHEN mode = 'two' THEN round_even(y0 / 2, 0) ELSE y0 END, x0, pi) - 1 AS INTEGER) AS ord FROM b""")
def reflow_order(spark, d):
    return regions.reflow_order(lines_of(spark, d), F.col("size") > 13).select("doc_id", "pno", "pi", "ord")


_ITEM = "CASE i % 7 WHEN 1 THEN '1. ' || text WHEN 2 THEN '12) ' || text WHEN 3 THEN '• ' || text WHEN 4 THEN '•' || ' other ' || text WHEN 6 THEN '(a) ' || text ELSE text END"


@query("list_groups", LINES_SQL + f""", t AS (SELECT doc_id, i, text AS raw, {_ITEM} AS text FROM (SELECT doc_id, pno * 24 + pi AS i, text FROM v)),
k AS (SELECT *, CASE WHEN regexp_matches(text, '{T.LIST_ITEM}') AND NOT regexp_matches(text, '^(?i:fig(ure)?\\.?\\s|table\\s)') AND NOT regexp_matches(text, '^\\[\\d+\\]') THEN CASE WHEN regexp_matches(text, '^\\s*[{T.BULLETS}]') THEN 'ul' ELSE 'ol' END ELSE '' END AS tag FROM t),
r AS (SELECT *, sum(CASE WHEN tag = p THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, coalesce(lag(tag) OVER (PARTITION BY doc_id ORDER BY i), '?') AS p FROM k))
SELECT doc_id, min(i) AS first, tag, count(*) AS n, md5(string_agg(regexp_replace(text, '{T.LIST_LABEL}', ''), '|' ORDER BY i)) AS items FROM r WHERE tag <> '' GROUP BY doc_id, run, tag""")
def list_groups(spark, d):
    lines = lines_of(spark, d).select("doc_id", (F.col("pno") * 24 + F.col("pi")).alias("i"), "text")
    mark = lambda m: F.concat(F.lit(m), "text")
    k = F.col("i") % 7
    text = F.when(k == 1, mark("1. ")).when(k == 2, mark("12) ")).when(k == 3, mark("• ")).when(k == 4, mark("• other ")).when(k == 6, mark("(a) ")).otherwise(F.col("text"))
    return regions.list_groups(lines.withColumn("text", text)).withColumn("items", F.md5(F.array_join("items", "|")))


@query("toc_levels", LINES_SQL + """, h AS (SELECT doc_id, pno * 24 + pi AS i, length(text) % 4 + 1 AS level, row_number() OVER (PARTITION BY doc_id ORDER BY pno, pi) AS s FROM v WHERE size <> 10),
w AS (WITH RECURSIVE g AS (SELECT doc_id, i, s, 1 AS toc FROM h WHERE s = 1 UNION ALL
SELECT h.doc_id, h.i, h.s, CAST(least(h.level, g.toc + 1) AS INTEGER) FROM g JOIN h ON h.doc_id = g.doc_id AND h.s = g.s + 1) SELECT * FROM g)
SELECT doc_id, i, toc FROM w""")
def toc_levels(spark, d):
    h = lines_of(spark, d).where("size <> 10").select("doc_id", (F.col("pno") * 24 + F.col("pi")).alias("i"), (F.length("text") % 4 + 1).alias("level"))
    return regions.toc_levels(h).select("doc_id", "i", "toc")


@query("link_ownership", LINES_SQL + """, k AS (SELECT doc_id, pno, pi AS link, x0 + 5 AS a, y0 + 6 AS b, x0 + 95 AS c, y0 + 46 AS e FROM v),
x AS (SELECT k.doc_id, k.pno, link, pi, greatest(0, least(c, x1) - greatest(a, x0)) * greatest(0, least(e, y1) - greatest(b, y0)) AS area FROM k JOIN v ON k.doc_id = v.doc_id AND k.pno = v.pno),
r AS (SELECT doc_id, pno, link, pi, row_number() OVER (PARTITION BY doc_id, pno, link ORDER BY area DESC, pi) AS n FROM x WHERE area > 0)
SELECT k.doc_id, k.pno, k.link, r.pi AS owner FROM k LEFT JOIN r ON r.doc_id = k.doc_id AND r.pno = k.pno AND r.link = k.link AND n = 1""")
def link_ownership(spark, d):
    lines, b = lines_of(spark, d), F.col("bbox")
    links = lines.select(*layout.PAGE, F.col("pi").alias("link"), rect(b.x0 + 5, b.y0 + 6, b.x0 + 95, b.y0 + 46).alias("rect"))
    return regions.link_owners(links, lines.withColumnRenamed("pi", "para"))


_PARAS = LINES_SQL + r""", n AS (SELECT *, regexp_matches(text, '^(?i:fig(ure)?\.?\s|table\s)') AS cap, regexp_matches(text, '^\[\d+\]') OR regexp_matches(text, '(?i)references[\s.:]*$') AS ref, row_number() OVER (PARTITION BY doc_id, pno ORDER BY col, y0, x0, pi) AS s FROM v),
w AS (WITH RECURSIVE g AS (
  SELECT doc_id, pno, s, 0 AS para, col, 1 AS k, text, cap, ref, [{'z': size, 'c': length(text)}] AS zs, x0, y0, x1, y1 FROM n WHERE s = 1
  UNION ALL
  SELECT doc_id, pno, s, CASE WHEN how = '' THEN para + 1 ELSE para END, col, CASE WHEN how = '' THEN 1 ELSE k + 1 END,
    CASE how WHEN '' THEN text WHEN 'before' THEN text || ' ' || pt WHEN 'after' THEN pt || ' ' || text ELSE pt || chr(10) || text END,
    CASE WHEN how = '' THEN cap ELSE pcap END, CASE WHEN how = '' THEN ref ELSE pref END,
    CASE WHEN how = '' THEN [{'z': size, 'c': length(text)}] WHEN len(list_filter(zs, lambda e: e.z = size)) > 0 THEN list_transform(zs, lambda e: {'z': e.z, 'c': e.c + CASE WHEN e.z = size THEN length(text) ELSE 0 END}) ELSE list_append(zs, {'z': size, 'c': length(text)}) END,
    CASE WHEN how = '' THEN x0 ELSE least(x0, px0) END, CASE WHEN how = '' THEN y0 ELSE least(y0, py0) END, CASE WHEN how = '' THEN x1 ELSE greatest(x1, px1) END, CASE WHEN how = '' THEN y1 ELSE greatest(y1, py1) END
  FROM (SELECT *, CASE WHEN col <> pcol OR cap OR pcap THEN ''
      WHEN NOT ref AND NOT pref AND length(text) <= 120 AND both_ / greatest((x1 - x0) * (y1 - y0), 1e-9) >= 0.85::DOUBLE AND abs(z - size) <= 1.5 THEN CASE WHEN x0 <= px0 + 2 THEN 'before' ELSE 'after' END
      WHEN NOT ref AND NOT pref AND length(pt) <= 120 AND length(text) > 120 AND both_ / greatest((px1 - px0) * (py1 - py0), 1e-9) >= 0.85::DOUBLE AND abs(z - size) <= 1.5 THEN 'after'
      WHEN pref AND NOT ref AND y0 - py1 >= 0 AND y0 - py1 < 2 * z AND over_ > 0.5 AND length(pt) + length(text) + 1 <= 800 THEN 'line'
      WHEN NOT ref AND NOT pref AND y0 - py1 >= 0 AND y0 - py1 < 1.5 * z AND over_ > 0.6::DOUBLE AND length(pt) + length(text) + 1 <= 500 AND (least(length(pt), length(text)) > 120 OR abs(z - size) <= 0.25) THEN 'line' ELSE '' END AS how
    FROM (SELECT n.*, g.para, g.k, g.text AS pt, g.cap AS pcap, g.ref AS pref, g.col AS pcol, g.zs, g.x0 AS px0, g.y0 AS py0, g.x1 AS px1, g.y1 AS py1,
      list_sort(list_transform(g.zs, lambda e, i: {'c': -e.c, 'i': i, 'z': e.z}))[1].z AS z,
      greatest(0, least(n.x1, g.x1) - greatest(n.x0, g.x0)) * greatest(0, least(n.y1, g.y1) - greatest(n.y0, g.y0)) AS both_,
      greatest(0, least(n.x1, g.x1) - greatest(n.x0, g.x0)) / greatest(1.0, least(n.x1 - n.x0, g.x1 - g.x0)) AS over_
      FROM g JOIN n ON n.doc_id = g.doc_id AND n.pno = g.pno AND n.s = g.s + 1))
) SELECT * FROM g),
p AS (SELECT doc_id, pno, para, arg_max(w, s) AS l FROM w GROUP BY 1, 2, 3)
SELECT doc_id, pno, CAST(para AS INTEGER) AS para, l.col AS col, CAST(l.k AS INTEGER) AS n_lines, l.text AS text, l.cap AS is_caption, l.ref AS is_ref, l.x0 AS x0, l.y0 AS y0, l.x1 AS x1, l.y1 AS y1,
NOT l.cap AND NOT l.ref AND (length(l.text) <= 8 AND regexp_matches(l.text, '[=<>]') AND NOT regexp_matches(l.text, '[A-Za-z]{4}') OR length(trim(l.text, ' ')) <= 200 AND (regexp_matches(trim(l.text, ' '), '^(Break out of|End for|End while|End if|(for|if|while|return)\s|(else|Sample|Initialise)([^A-Za-z0-9_]|$))') OR length(trim(l.text, ' ')) <= 8 AND regexp_matches(trim(l.text, ' '), '[=<>]') AND NOT regexp_matches(trim(l.text, ' '), '[A-Za-z]{4}') OR regexp_matches(trim(l.text, ' '), '^\d+\s*[%\s]|^%\s'))) AS is_verbatim FROM p"""


@query("paragraph_merge", _PARAS)
def paragraph_merge(spark, d):
    return regions.paragraph_merge(lines_of(spark, d).select(*layout.PAGE, "pi", "col", "text", "size", "bbox.*"))


def _blocks_sql(rows: str, keys: str) -> str:
    """The fold of lines into blocks over rows (keys, pi, x0, y0, x1, y1) of lines that are 12 points high."""
    on = " AND ".join(f"n.{k} = g.{k}" for k in keys.split(", "))
    ks = ", ".join(f"g.{k}" for k in keys.split(", "))
    return f""", n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY y0, x0, pi) AS s FROM {rows}),
w AS (WITH RECURSIVE g AS (
  SELECT {keys}, s, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'n': 1}}] AS bs FROM n WHERE s = 1
  UNION ALL
  SELECT {keys}, s, CASE WHEN p > 0 THEN list_transform(range(1, len(bs) + 1), lambda k: CASE WHEN k = p THEN {{'x0': least(bs[k].x0, x0), 'y0': least(bs[k].y0, y0), 'x1': greatest(bs[k].x1, x1), 'y1': greatest(bs[k].y1, y1), 'n': bs[k].n + 1}} ELSE bs[k] END)
    ELSE list_append(bs, {{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'n': 1}}) END
  FROM (SELECT {ks}, n.s, n.x0, n.y0, n.x1, n.y1, g.bs, coalesce(list_position(list_transform(g.bs, lambda b: greatest(0, least(n.x1, b.x1) - greatest(n.x0, b.x0)) / greatest(1.0, least(n.x1 - n.x0, b.x1 - b.x0)) > 0.35::DOUBLE AND n.y0 - b.y1 >= -12 AND n.y0 - b.y1 < 1.8::DOUBLE * 12), true), 0) AS p
    FROM g JOIN n ON {on} AND n.s = g.s + 1)
) SELECT * FROM g)
SELECT {keys}, CAST(k - 1 AS INTEGER) AS block, bs[k].x0 AS x0, bs[k].y0 AS y0, bs[k].x1 AS x1, bs[k].y1 AS y1, CAST(bs[k].n AS INTEGER) AS n_lines
FROM (SELECT w.*, unnest(range(1, len(bs) + 1)) AS k FROM w JOIN (SELECT {keys}, max(s) AS s FROM n GROUP BY ALL) USING ({keys}, s))"""


_CUT = LINES_SQL + """, r AS (SELECT doc_id, pno, pi, CASE WHEN pi % 3 = 2 THEN x0 + 150 ELSE x0 END AS x0, y0, CASE WHEN pi % 3 = 2 THEN x0 + 180 ELSE least(x1, x0 + 90) END AS x1, y1 FROM v),
q AS (SELECT *, floor(x0) AS a, greatest(coalesce(max(floor(x1)) OVER (PARTITION BY doc_id, pno ORDER BY floor(x0), floor(x1) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1, floor(0.08::DOUBLE * 612)) AS b FROM r),
c AS (SELECT doc_id, pno, list((a + b) / 2) FILTER (a - b >= greatest(6.0, 0.06::DOUBLE * 612) AND a <= floor(0.92::DOUBLE * 612)) AS cuts FROM q GROUP BY 1, 2),
k AS (SELECT r.*, CAST(coalesce(len(list_filter(cuts, lambda x: (x0 + x1) / 2 >= x)), 0) AS INTEGER) AS col FROM r JOIN c USING (doc_id, pno))
"""


@query("region_split", _CUT + _blocks_sql("k", "doc_id, pno, col"))
def region_split(spark, d):
    """Lines cut to 90 points, of which every third stands further right."""
    b, right = F.col("bbox"), F.col("pi") % 3 == 2
    x0, x1 = F.when(right, b.x0 + 150).otherwise(b.x0), F.when(right, b.x0 + 180).otherwise(F.least(b.x1, b.x0 + 90))
    return regions.region_split(lines_of(spark, d).select(*layout.PAGE, "pi", x0.alias("x0"), b.y0.alias("y0"), x1.alias("x1"), b.y1.alias("y1")), 612.0)


@query("figure_regions", LINES_SQL + "SELECT doc_id, pno, 0 AS region, 100.0::DOUBLE + doc_id % 5 AS x0, 100.0::DOUBLE AS y0, 260.0::DOUBLE + doc_id % 5 AS x1, 200.0::DOUBLE AS y1 FROM (SELECT DISTINCT doc_id, pno FROM v)")
def figure_regions(spark, d):
    """A page-wide drawing, an image with a drawing beside it, a lone drawing and a small image on every page, moved by the document's remainder."""
    k = F.col("doc_id") % 5
    mark = lambda i, m: F.struct(F.lit(i).alias("i"), F.lit(m[0]).alias("image"), *((F.lit(v) + (0 if i == 0 else k)).cast("double").alias(n) if n[0] == "x" else F.lit(v).alias(n) for v, n in zip(m[1:], ("x0", "y0", "x1", "y1"), strict=True)))
    pages = lines_of(spark, d).select(*layout.PAGE).distinct()
    return regions.figure_regions(pages.select(*layout.PAGE, F.inline(F.array(*(mark(i, m) for i, m in enumerate(MARKS))))), 612.0, 842.0)


AREAS = [("figure", 0, (60, 80, 300, 180)), ("figure", 1, (54, 320, 560, 420)), ("table", 0, (54, 480, 560, 560)), ("table", 1, (320, 600, 560, 780))]
_AREAS = ", ".join(f"('{k}', {n}, {a}.0::DOUBLE, {b}.0::DOUBLE, {c}.0::DOUBLE, {e}.0::DOUBLE)" for k, n, (a, b, c, e) in AREAS)


@query("caption_binding", LINES_SQL + f""", a(kind, region, rx0, ry0, rx1, ry1) AS (VALUES {_AREAS}),
f AS (SELECT doc_id, pno, pi, kind, region FROM v, a WHERE greatest(0, least(x1, rx1) - greatest(x0, rx0)) / greatest(1, least(x1 - x0, rx1 - rx0)) >= 0.5
AND CASE WHEN kind = 'figure' THEN (y0 >= ry1 - 6 AND y0 - ry1 <= 34) OR (y0 >= ry0 + 0.55::DOUBLE * (ry1 - ry0) AND y1 <= ry1 + 10) ELSE (y1 <= ry0 + 6 AND ry0 - y1 <= 34) OR (y0 >= ry0 - 10 AND y1 <= ry0 + 0.45::DOUBLE * (ry1 - ry0)) END),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pno, pi ORDER BY kind, region) AS n FROM f)
SELECT doc_id, pno, kind, region, min(pi) AS caption FROM g WHERE n = 1 GROUP BY 1, 2, 3, 4""")
def caption_binding(spark, d):
    lines = lines_of(spark, d)
    both = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("region"), rect(*map(F.lit, r)).alias("rect")) for k, n, r in AREAS))
    areas = lines.select(*layout.PAGE).distinct().select(*layout.PAGE, F.inline(both))
    return regions.caption_binding(lines.select(*layout.PAGE, F.col("pi").alias("caption"), "bbox"), areas)
