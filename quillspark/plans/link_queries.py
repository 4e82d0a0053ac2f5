"""Queries over links, references, crossing blocks, cells and bands, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.geom import rect
from quillspark.operators import layout, links, splits
from quillspark.plans.layout_queries import BOX, lines_of
from quillspark.plans.registry import query
from quillspark.sources.adapters import LINES_SQL, page_links, table

PAGE = layout.PAGE
_LINKS = r"""(SELECT page_id, unnest(range(0, len(hs))) AS ord, unnest(hs) AS href FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<a href="([^"]*)"', 1) AS hs FROM pages))"""
_WORDS = LINES_SQL + """, w0 AS (SELECT doc_id, pno, pi, y0, y1, x0 AS lx, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM v),
w1 AS (SELECT doc_id, pno, pi, y0, y1, lx, unnest(range(0, len(ws))) AS wi, unnest(ws) AS word FROM w0),
w AS (SELECT doc_id, pno, pi, wi, word, lx + 5 * coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, pno, pi ORDER BY wi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS x0, y0, y1 FROM w1),
word AS (SELECT *, x0 + 5 * length(word) AS x1 FROM w)
"""


def words_of(spark, d):
    return splits.page_words(lines_of(spark, d))


@query("link_records", f"SELECT page_id, ord, CASE WHEN h[1] = '#' THEN 'goto' ELSE 'uri' END AS href_kind, CASE WHEN h[1] <> '#' THEN h END AS uri, CASE WHEN h[1] = '#' THEN h[2:] END AS target FROM (SELECT page_id, ord::INTEGER AS ord, trim(CASE WHEN page_id % 3 = 0 THEN '#p' || href WHEN page_id % 3 = 1 AND ord = 0 THEN ' ' ELSE href END, ' ') AS h FROM {_LINKS}) WHERE length(h) > 0")
def link_records(spark, d):
    href = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("#p"), "href")).when((F.col("page_id") % 3 == 1) & (F.col("ord") == 0), " ").otherwise(F.col("href"))
    return links.link_records(page_links(table(spark, d, "pages")).withColumn("href", href)).select("page_id", "ord", "href_kind", "uri", "target")


@query("links_escaped", f"""SELECT page_id, ord::INTEGER AS ord, replace(replace(replace(replace(href || '&"<', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS attr FROM {_LINKS}""")
def links_escaped(spark, d):
    return page_links(table(spark, d, "pages")).select("page_id", "ord", links.escape_attribute(F.concat("href", F.lit('&"<'))).alias("attr"))


_WS = r"'[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]'"
_FLAT = f"translate(regexp_replace(%s, {_WS}, '', 'g'), '（）［］｛｝', '()[]{{}}')"
_FIND = f"""WITH t AS (SELECT doc_id, text AS x, replace(substr(text, 40, 18), ' ', '  ') AS pat, CASE WHEN doc_id % 3 = 0 THEN length(text) // 2 ELSE 20 END AS st FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, {_FLAT % 'x'} AS f, {_FLAT % 'pat'} AS w, length(regexp_replace(substr(x, 1, st), {_WS}, '', 'g')) AS k, list_filter(range(1, length(x) + 1), lambda i: NOT regexp_matches(x[i], {_WS})) AS places FROM t),
p AS (SELECT doc_id, places, length(w) AS n, CASE WHEN strpos(substr(f, k + 1), w) > 0 THEN strpos(substr(f, k + 1), w) + k ELSE strpos(f, w) END AS p FROM f)
SELECT doc_id, CASE WHEN n > 0 AND p > 0 THEN places[p] - 1 END AS s, CASE WHEN n > 0 AND p > 0 THEN places[p + n - 1] END AS e FROM p"""


def _found(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    pattern = F.replace(F.substr("text", F.lit(40), F.lit(18)), F.lit(" "), F.lit("  "))
    start = F.when(F.col("doc_id") % 3 == 0, F.floor(F.length("text") / 2).cast("int")).otherwise(20)
    return docs.withColumn("x", links.find_loose(F.col("text"), pattern, start))


@query("loose_find", _FIND)
def loose_find(spark, d):
    return _found(spark, d).select("doc_id", F.col("x.s").cast("long").alias("s"), F.col("x.e").cast("long").alias("e"))


_E = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("links_wrapped", f"""SELECT doc_id, md5({_E.format('substr(text, 1, 9)')} || '<a href="u&amp;1">' || {_E.format('substr(text, 10, 6)')} || '</a>' || {_E.format('substr(text, 16, 14)')} || '<a href="v&quot;">' || {_E.format('substr(text, 30, 10)')} || '</a>' || {_E.format('substr(text, 40)')}) AS html FROM documents WHERE length(text) > 60""")
def links_wrapped(spark, d):
    """Two spans, one that begins inside the first, and one that was not found."""
    span = lambda s, e, href: F.struct(F.lit(s).cast("int").alias("s"), F.lit(e).cast("int").alias("e"), F.lit(href).alias("href"))
    spans = F.array(span(29, 39, 'v"'), span(12, 20, "inside"), span(None, None, "nowhere"), span(9, 15, "u&1"))
    return table(spark, d, "documents").where("length(text) > 60").select("doc_id", F.md5(links.wrap_links(F.col("text"), spans)).alias("html"))


_PIECES = ", p0 AS (SELECT doc_id, pno, pi * 2 + k AS i, 'h' || (pi // 3) AS href, CASE WHEN k = 0 THEN x0 ELSE x0 + 30 + 5 * (pi % 4) END AS x0, y0, CASE WHEN k = 0 THEN x0 + 25 ELSE x0 + 60 + 5 * (pi % 4) END AS x1, y1 FROM v, (VALUES (0), (1)) ks(k))"


def _union_sql(rows: str, order: str, columns: list[str], on: str, by: str, text: str = "") -> str:
    """Runs of rows (doc_id, pno, order, columns, box) with the union of each run as what the next row is held against."""
    cols = ", ".join(columns)
    return f""", n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pno ORDER BY {order}) AS s FROM {rows}),
r AS (WITH RECURSIVE g AS (
  SELECT doc_id, pno, s, 1 AS run, {cols}, x0, y0, x1, y1 FROM n WHERE s = 1
  UNION ALL
  SELECT doc_id, pno, s, CASE WHEN on_ THEN run ELSE run + 1 END, {cols}, CASE WHEN on_ THEN least(gx0, x0) ELSE x0 END, CASE WHEN on_ THEN least(gy0, y0) ELSE y0 END, CASE WHEN on_ THEN greatest(gx1, x1) ELSE x1 END, CASE WHEN on_ THEN greatest(gy1, y1) ELSE y1 END
  FROM (SELECT n.*, g.run, g.x0 AS gx0, g.y0 AS gy0, g.x1 AS gx1, g.y1 AS gy1, {on} AS on_ FROM g JOIN n ON n.doc_id = g.doc_id AND n.pno = g.pno AND n.s = g.s + 1)
) SELECT doc_id, pno, s, run FROM g)
SELECT doc_id, pno, {by}, CAST(run AS INTEGER) AS run, count(*) AS n{text}, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM n JOIN r USING (doc_id, pno, s) GROUP BY ALL"""


@query("link_fragments", LINES_SQL + _PIECES + _union_sql("p0", "i", ["href"], "n.href = g.href AND least(g.y1, n.y1) - greatest(g.y0, n.y0) > 0.5 * least(g.y1 - g.y0, n.y1 - n.y0, 1.0) AND n.x0 - g.x1 BETWEEN -2 AND 12", "href"))
def link_fragments(spark, d):
    b, p = F.col("bbox"), F.col("pi")
    half = lambda k, low, high: F.struct(F.lit(k).alias("k"), rect(low, b.y0, high, b.y1).alias("bbox"))
    both = F.array(half(0, b.x0, b.x0 + 25), half(1, b.x0 + 30 + 5 * (p % 4), b.x0 + 60 + 5 * (p % 4)))
    pieces = lines_of(spark, d).select(*PAGE, "pi", F.inline(both)).select(*PAGE, (p * 2 + F.col("k")).alias("i"), F.concat(F.lit("h"), F.floor(p / 3).cast("string")).alias("href"), "bbox")
    return links.merge_fragments(pieces, ["i"]).select(*PAGE, "href", "run", "n", *BOX)


@query("goto_targets", LINES_SQL + """, d AS (SELECT doc_id, pno, pi AS dest, (pi * 37 % 600)::DOUBLE AS x, (pi * 91 % 830)::DOUBLE AS y FROM v),
c AS (SELECT d.*, v.pi AS region, x >= x0 - 2 AND x <= x1 + 2 AND y >= y0 - 2 AND y <= y1 + 2 AS inside, (x1 - x0) * (y1 - y0) AS area, y0 - y AS dy, abs((x0 + x1) / 2 - x) AS dx FROM d JOIN v ON d.doc_id = v.doc_id AND d.pno = v.pno),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pno, dest ORDER BY CASE WHEN inside THEN 0 ELSE 1 END, CASE WHEN inside THEN area ELSE dy END, CASE WHEN inside THEN 0 ELSE dx END, region) AS n FROM c WHERE inside OR dy >= -2)
SELECT d.doc_id, d.pno, d.dest, k.region, CASE WHEN inside THEN 0 WHEN region IS NOT NULL THEN 1 END::INTEGER AS tier FROM d LEFT JOIN k ON k.doc_id = d.doc_id AND k.pno = d.pno AND k.dest = d.dest AND n = 1""")
def goto_targets(spark, d):
    lines = lines_of(spark, d)
    dests = lines.select(*PAGE, F.col("pi").alias("dest"), (F.col("pi") * 37 % 600).cast("double").alias("x"), (F.col("pi") * 91 % 830).cast("double").alias("y"))
    return links.goto_targets(dests, lines.select(*PAGE, F.col("pi").alias("region"), "bbox"))


@query("lost_links", LINES_SQL + """, k AS (SELECT doc_id, pno, pi, 'uri' AS kind, length(text) AS uri, round_even(x0 + 0.04, 1) AS a, round_even(y0, 1) AS b FROM v), a AS (SELECT doc_id, pno, kind, uri, round_even(x0, 1) AS a, round_even(y0 + CASE WHEN pi % 5 = 1 THEN 0.3 ELSE 0.04 END, 1) AS b FROM k JOIN v USING (doc_id, pno, pi) WHERE pi % 3 <> 0)
SELECT doc_id, pno, pi FROM k WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = k.doc_id AND a.pno = k.pno AND a.kind = k.kind AND a.uri = k.uri AND a.a = k.a AND a.b = k.b)""")
def lost_links(spark, d):
    b = F.col("bbox")
    rows = lines_of(spark, d).select(*PAGE, "pi", F.lit("uri").alias("kind"), F.length("text").alias("uri"), "bbox")
    before = rows.withColumn("rect", rect(b.x0 + 0.04, b.y0, b.x1, b.y1))
    after = rows.where("pi % 3 <> 0").withColumn("rect", rect(b.x0, b.y0 + F.when(F.col("pi") % 5 == 1, 0.3).otherwise(0.04), b.x1, b.y1))
    return links.lost_links(before, after, "kind", "uri").select(*PAGE, "pi")


@query("outside_regions", LINES_SQL + "SELECT doc_id, pno, pi FROM v WHERE NOT (x0 < 300 AND x1 > 100 AND y0 < 350 AND y1 > 150)")
def outside_regions(spark, d):
    lines = lines_of(spark, d)
    regions = lines.select(*PAGE).distinct().withColumn("rect", rect(*map(F.lit, (100, 150, 300, 350))))
    return links.outside(lines, regions, "pi").select(*PAGE, "pi")


@query("clipped_words", _WORDS + "SELECT doc_id, pno, count(*) AS n, min(word) AS first, max(x1) AS x1 FROM word WHERE x0 < 250 AND x1 > 90 AND y0 < 500 AND y1 > 100 GROUP BY 1, 2")
def clipped_words(spark, d):
    return splits.clipped(words_of(spark, d), (90, 100, 250, 500)).groupBy(*PAGE).agg(F.count("*").alias("n"), F.min("word").alias("first"), F.max(F.col("bbox").x1).alias("x1"))


_BLOCK = LINES_SQL + """, e AS (SELECT *, pi % 4 <> 2 AS numbered, CASE WHEN pi % 4 <> 2 THEN '[' || pi || '] ' || text ELSE text END AS t FROM v),
b AS (SELECT doc_id, pno, string_agg(t, chr(10) ORDER BY pi) AS text, min(y0) AS by0, max(y1) AS by1 FROM e GROUP BY 1, 2),
p AS (SELECT doc_id, pno, by0, by1, unnest(range(0, len(ps))) AS part, unnest(ps) AS text FROM (SELECT *, string_split(regexp_replace(text, '\\n(\\[\\d+\\]\\s)', chr(1) || '\\1', 'g'), chr(1)) AS ps FROM b)),
q AS (SELECT p.*, TRY_CAST(nullif(regexp_extract(trim(p.text, ' '), '^\\[(\\d+)\\]', 1), '') AS INTEGER) AS n FROM p),
k AS (SELECT doc_id, pno, pi AS n, min(y0) AS y FROM e WHERE numbered AND pi % 7 <> 3 GROUP BY 1, 2, 3),
r AS (SELECT q.*, CASE WHEN part = 0 AND y IS NULL THEN by0 ELSE y END AS top FROM q LEFT JOIN k USING (doc_id, pno, n)),
s AS (SELECT *, coalesce(first_value(top IGNORE NULLS) OVER (PARTITION BY doc_id, pno ORDER BY part ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), by1) AS below FROM r)
"""


@query("reference_entries", _BLOCK + "SELECT doc_id, pno, CAST(part AS INTEGER) AS part, md5(text) AS text, coalesce(top, by0) AS y0, CASE WHEN top IS NULL THEN by1 WHEN below <= top THEN least(by1, top + 12) ELSE below END AS y1 FROM s")
def reference_entries(spark, d):
    """Pages as reference blocks: three of four lines begin an entry, the words of some entries are not found."""
    p = F.col("pi")
    lines = lines_of(spark, d).withColumn("t", F.when(p % 4 != 2, F.concat(F.lit("["), p.cast("string"), F.lit("] "), "text")).otherwise(F.col("text")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pi", "t"))), lambda x: x.t), "\n")
    b = F.col("bbox")
    box = F.struct(F.min(b.y0).alias("y0"), F.max(b.y1).alias("y1"))
    blocks = lines.groupBy(*PAGE).agg(text.alias("text"), box.alias("bbox")).withColumn("block", F.lit(0))
    tokens = lines.where("pi % 4 <> 2 and pi % 7 <> 3").select(*PAGE, F.lit(0).alias("block"), p.alias("n"), b.y0.alias("y"))
    return splits.reference_entries(blocks, tokens).select(*PAGE, "part", F.md5("text").alias("text"), "y0", "y1")


@query("equation_numbers", LINES_SQL + """, e AS (SELECT doc_id, pno, col, pi, CASE WHEN pi % 5 = 2 OR (pno = 1 AND col = 1) THEN ' (' || pi || ') ' ELSE text END AS t, x0, y0, x1, y1 FROM v),
f AS (SELECT *, regexp_full_match(trim(t, ' '), '\\(\\d+\\)') AS num FROM e), g AS (SELECT *, count(*) FILTER (NOT num) OVER (PARTITION BY doc_id, pno, col) AS lft FROM f)
SELECT doc_id, pno, col, md5(string_agg(t, chr(10) ORDER BY pi)) AS text, count(*) AS n_lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM g WHERE NOT num OR lft = 0 GROUP BY 1, 2, 3""")
def equation_numbers(spark, d):
    p = F.col("pi")
    number = (p % 5 == 2) | ((F.col("pno") == 1) & (F.col("col") == 1))
    lines = lines_of(spark, d).withColumn("text", F.when(number, F.concat(F.lit(" ("), p.cast("string"), F.lit(") "))).otherwise(F.col("text")))
    return splits.without_equation_numbers(lines, [*PAGE, "col"], "pi").select(*PAGE, "col", F.md5("text").alias("text"), "n_lines", *BOX)


@query("crossing_blocks", _WORDS + """, h AS (SELECT *, CASE WHEN (x0 + x1) / 2 <= 306 THEN 0 ELSE 1 END AS half FROM word),
c AS (SELECT doc_id, pno, half, count(DISTINCT round_even(y0, 1)) AS k, min(x0) AS a, max(x1) AS b FROM h GROUP BY 1, 2, 3),
t AS (SELECT doc_id, pno, count(*) = 2 AND min(k) >= 2 AND min(a) < 306 AND max(b) > 306 AND max(b) - min(a) > 0.6 * 612 AS two FROM c GROUP BY 1, 2)
SELECT doc_id, pno, CASE WHEN two THEN half END::INTEGER AS side, count(*) AS n_words, count(DISTINCT round_even(y0, 1)) AS n_lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM h JOIN t USING (doc_id, pno) GROUP BY 1, 2, 3""")
def crossing_blocks(spark, d):
    return splits.split_crossing(words_of(spark, d), F.lit(612.0), F.lit(306.0)).select(*PAGE, "side", "n_words", "n_lines", *BOX)


@query("cell_groups", _WORDS + """, g AS (SELECT *, x0 + CASE WHEN wi % 4 = 3 THEN 10 ELSE 0 END AS a FROM word), k AS (SELECT *, lag(a + 5 * length(word)) OVER (PARTITION BY doc_id, pno, pi ORDER BY a, wi) AS e FROM g),
c AS (SELECT *, sum(CASE WHEN e IS NULL OR a - e > 12 OR (regexp_full_match(word, '[0-9.,%]+') AND a >= e - 2) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, pno, pi ORDER BY a, wi) - 1 AS cell FROM k)
SELECT doc_id, pno, pi, CAST(cell AS BIGINT) AS cell, count(*) AS n, string_agg(word, ' ' ORDER BY wi) AS text, min(a) AS x0, max(a + 5 * length(word)) AS x1 FROM c GROUP BY 1, 2, 3, 4""")
def cell_groups(spark, d):
    b, shift = F.col("bbox"), F.when(F.col("wi") % 4 == 3, 10).otherwise(0)
    words = words_of(spark, d).withColumn("bbox", rect(b.x0 + shift, b.y0, b.x1 + shift, b.y1))
    return splits.cell_groups(words).select(*PAGE, "pi", "cell", "n", "text", F.col("bbox.x0").alias("x0"), F.col("bbox.x1").alias("x1"))


@query("segment_numbers", LINES_SQL + """, h AS (SELECT doc_id, pno * 24 + pi AS i, size > 13 OR pi % 5 = 3 AS h, row_number() OVER (PARTITION BY doc_id ORDER BY pno, pi) AS s FROM v),
w AS (WITH RECURSIVE g AS (SELECT doc_id, i, s, 0 AS seg, CASE WHEN 1 >= 4 AND h THEN 0 ELSE 1 END AS n, CASE WHEN 1 >= 4 AND h THEN 1 ELSE 0 END AS nxt FROM h WHERE s = 1 UNION ALL
SELECT h.doc_id, h.i, h.s, g.nxt, CASE WHEN g.n + 1 >= 4 AND h.h THEN 0 ELSE g.n + 1 END, CASE WHEN g.n + 1 >= 4 AND h.h THEN g.nxt + 1 ELSE g.nxt END FROM g JOIN h ON h.doc_id = g.doc_id AND h.s = g.s + 1) SELECT * FROM g)
SELECT doc_id, i, CAST(seg AS INTEGER) AS segment FROM w""")
def segment_numbers(spark, d):
    lines = lines_of(spark, d).withColumn("i", F.col("pno") * 24 + F.col("pi"))
    return splits.segments(lines, "doc_id", "i", (F.col("size") > 13) | (F.col("pi") % 5 == 3), 4)


@query("region_lines", LINES_SQL + """, r(region, rx0, ry0, rx1, ry1) AS (VALUES (0, 40.0, 30.0, 330.0, 300.0), (1, 40.0, 200.0, 600.0, 600.0)),
h AS (SELECT doc_id, pno, pi, min(region) AS region FROM v JOIN r ON (x0 + x1) / 2 >= rx0 AND (x0 + x1) / 2 < rx1 AND (y0 + y1) / 2 >= ry0 AND (y0 + y1) / 2 < ry1 GROUP BY 1, 2, 3)
SELECT doc_id, pno, CAST(region AS INTEGER) AS region, CASE WHEN region IS NULL THEN pi ELSE -1 END::INTEGER AS own, md5(string_agg(text, chr(10) ORDER BY y0, x0, pi)) AS text, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM v LEFT JOIN h USING (doc_id, pno, pi) GROUP BY 1, 2, 3, 4""")
def region_lines(spark, d):
    lines = lines_of(spark, d)
    boxes = F.array(*(F.struct(F.lit(k).alias("region"), rect(*map(F.lit, r)).alias("rect")) for k, r in enumerate(((40, 30, 330, 300), (40, 200, 600, 600)))))
    regions = lines.select(*PAGE).distinct().select(*PAGE, F.inline(boxes))
    return splits.region_lines(lines, regions).select(*PAGE, "region", "own", F.md5("text").alias("text"), "n", *BOX)


@query("cell_tables", LINES_SQL + """, r(t, rx0, ry0, rx1, ry1) AS (VALUES (0, 50.0, 100.0, 320.0, 400.0), (1, 50.0, 30.0, 600.0, 500.0))
SELECT doc_id, pno, pi, CAST(min(t) AS INTEGER) AS t FROM v LEFT JOIN r ON x0 >= rx0 AND y0 >= ry0 AND x1 <= rx1 AND y1 <= ry1 GROUP BY 1, 2, 3""")
def cell_tables(spark, d):
    lines = lines_of(spark, d)
    boxes = F.array(*(F.struct(F.lit(k).alias("t"), rect(*map(F.lit, r)).alias("rect")) for k, r in enumerate(((50, 100, 320, 400), (50, 30, 600, 500)))))
    return splits.first_container(lines, lines.select(*PAGE).distinct().select(*PAGE, F.inline(boxes)), "pi").select(*PAGE, "pi", "t")


@query("merged_bands", LINES_SQL + ", p0 AS (SELECT doc_id, pno, col AS hint, pi AS i, text, x0, y0, x1, y1 FROM v)" + _union_sql("p0", "hint, x0, y0, i", ["hint"], "n.hint = g.hint AND n.y0 - g.y1 BETWEEN -0.3::DOUBLE * greatest(g.y1 - g.y0, n.y1 - n.y0, 1.0) AND 1.2::DOUBLE * greatest(g.y1 - g.y0, n.y1 - n.y0, 1.0) AND greatest(0, least(g.x1, n.x1) - greatest(g.x0, n.x0)) / greatest(1.0, least(g.x1 - g.x0, n.x1 - n.x0)) >= 0.25", "hint", ", md5(string_agg(text, ' ' ORDER BY x0, y0, i)) AS text"))
def merged_bands(spark, d):
    bands = lines_of(spark, d).select(*PAGE, F.col("col").alias("hint"), F.col("pi").alias("i"), "text", "bbox")
    return splits.merge_bands(bands).select(*PAGE, "hint", "run", "n", F.md5("text").alias("text"), *BOX)
