"""Queries over page lines, texts and pages, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import prompts
from quillspark.functions import text as T
from quillspark.operators import layout, units
from quillspark.plans.registry import query
from quillspark.sources.adapters import LINES_SQL, page_lines, page_links, table, without_boilerplate

GLOSSARY = [("the", "DEF"), ("and", "CONJ"), ("tion", "SUF"), ("de", "PREP")]
BOX = ["bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1"]
_S = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def lines_of(spark, d):
    return page_lines(table(spark, d, "documents"))


@query(
    "unit_batches",
    LINES_SQL
    + """, u0 AS (SELECT doc_id, pno * 24 + pi AS i, length(text) AS n, md5('x|m|en|zh|' || text) AS k FROM v),
u1 AS (SELECT doc_id, min(i) AS i, any_value(n) AS n FROM u0 GROUP BY doc_id, k),
u AS (SELECT doc_id, i, n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS s FROM u1),
f(doc_id, s, chars, cnt, items) AS MATERIALIZED (SELECT doc_id, s, [n], [1], [CAST(i AS VARCHAR)] FROM u WHERE s = 1),
w AS (WITH RECURSIVE g AS (
  SELECT doc_id, s, chars, cnt, items FROM f
  UNION ALL
  SELECT doc_id, s, CASE WHEN p > 0 THEN list_transform(range(1, len(chars) + 1), lambda x: chars[x] + (CASE WHEN x = p THEN n ELSE 0 END)) ELSE list_append(chars, n) END,
    CASE WHEN p > 0 THEN list_transform(range(1, len(chars) + 1), lambda x: cnt[x] + (CASE WHEN x = p THEN 1 ELSE 0 END)) ELSE list_append(cnt, 1) END,
    CASE WHEN p > 0 THEN list_transform(range(1, len(chars) + 1), lambda x: items[x] || (CASE WHEN x = p THEN ',' || i ELSE '' END)) ELSE list_append(items, CAST(i AS VARCHAR)) END
  FROM (SELECT g.doc_id, u.s, u.n, u.i, g.chars, g.cnt, g.items, coalesce(list_position(list_transform(range(1, len(g.chars) + 1), lambda x: g.cnt[x] < 6 AND g.chars[x] + u.n <= 3000), true), 0) AS p FROM g JOIN u ON u.doc_id = g.doc_id AND u.s = g.s + 1)
) SELECT * FROM g)
SELECT doc_id, CAST(b - 1 AS INTEGER) AS batch_no, CAST(chars[b] AS BIGINT) AS chars, CAST(cnt[b] AS INTEGER) AS units, items[b] AS items
FROM (SELECT w.*, unnest(range(1, len(chars) + 1)) AS b FROM w JOIN (SELECT doc_id, max(s) AS s FROM u GROUP BY 1) USING (doc_id, s))""",
)
def unit_batches(spark, d):
    lines = lines_of(spark, d).select("doc_id", (F.col("pno") * 24 + F.col("pi")).alias("i"), F.length("text").alias("n"), T.cache_key("x", "m", "en", "zh", F.col("text")).alias("k"))
    first = lines.groupBy("doc_id", "k").agg(F.min("i").alias("i"), F.min("n").alias("n"))
    return units.first_fit(first, ["doc_id"], "i", "n", 3000, 6)


@query("text_layer_pages", LINES_SQL + "SELECT doc_id, pno, sum(length(text))::BIGINT AS chars, sum(length(text)) >= 50 AS has_text FROM v GROUP BY 1, 2")
def text_layer_pages(spark, d):
    n = F.sum(F.length("text"))
    return lines_of(spark, d).groupBy("doc_id", "pno").agg(n.alias("chars"), (n >= 50).alias("has_text"))


@query("lines_geometry", LINES_SQL + "SELECT doc_id, pno, pi, col, size, x0, y0, x1, y1, CAST(row_number() OVER (PARTITION BY doc_id, pno ORDER BY col, y0, x0, pi) - 1 AS INTEGER) AS ord FROM v")
def lines_geometry(spark, d):
    return layout.reading_order(lines_of(spark, d)).select("doc_id", "pno", "pi", "col", "size", *BOX, "ord")


@query("header_footer_split", LINES_SQL + "SELECT doc_id, pno, count(*) FILTER (y1 < 0.08 * 842 OR y0 > 0.94 * 842) AS n_edge, count(*) FILTER (x1 < 45 AND regexp_full_match(text, '[0-9\\s]+')) AS n_numbers, count(*) AS n FROM v GROUP BY 1, 2")
def header_footer_split(spark, d):
    b = F.col("bbox")
    return lines_of(spark, d).groupBy("doc_id", "pno").agg(F.count_if(layout.header_footer(b)).alias("n_edge"), F.count_if(layout.line_number_block(b, F.col("text"))).alias("n_numbers"), F.count("*").alias("n"))


_MODE = LINES_SQL + """, m AS (SELECT doc_id, pno, count(*) AS n_body, count(*) FILTER (x0 < 306 - 12.24 AND x1 > 306 + 12.24) AS c, count(*) FILTER (x1 <= 306) AS l, count(*) FILTER (x0 >= 306) AS r FROM v WHERE NOT (y1 < 0.08 * 842 OR y0 > 0.94 * 842) GROUP BY 1, 2),
pm AS (SELECT doc_id, pno, coalesce(n_body, 0) AS n_body, CASE WHEN coalesce(n_body, 0) < 4 OR c / n_body >= 0.35 OR l < 2 OR r < 2 THEN 'one' ELSE 'two' END AS mode FROM (SELECT DISTINCT doc_id, pno FROM v) LEFT JOIN m USING (doc_id, pno))
"""


@query("column_mode", _MODE + "SELECT * FROM pm")
def column_mode(spark, d):
    return layout.column_mode(lines_of(spark, d))


@query("column_mode_by_size", LINES_SQL + """, z AS (SELECT *, 612 + 100 * (doc_id % 3) AS w, 842 - 90 * (doc_id % 2) AS h FROM v),
m AS (SELECT doc_id, pno, count(*) FILTER (e) AS n_body, count(*) FILTER (e AND x0 < w / 2 - 0.02::DOUBLE * w AND x1 > w / 2 + 0.02::DOUBLE * w) AS c, count(*) FILTER (e AND x1 <= w / 2) AS l, count(*) FILTER (e AND x0 >= w / 2) AS r FROM (SELECT *, NOT (y1 < 0.08::DOUBLE * h OR y0 > 0.94::DOUBLE * h) AS e FROM z) GROUP BY 1, 2)
SELECT doc_id, pno, n_body, CASE WHEN n_body < 4 OR c / n_body >= 0.35 OR l < 2 OR r < 2 THEN 'one' ELSE 'two' END AS mode FROM m""")
def column_mode_by_size(spark, d):
    """Pages of three widths and two heights."""
    i = F.col("doc_id")
    return layout.column_mode(lines_of(spark, d).withColumn("page_w", (612 + 100 * (i % 3)).cast("double")).withColumn("page_h", (842 - 90 * (i % 2)).cast("double")))


@query("doc_column_majority", _MODE + "SELECT doc_id, mode, n FROM (SELECT doc_id, mode, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pno)) AS k FROM pm GROUP BY 1, 2) WHERE k = 1")
def doc_column_majority(spark, d):
    n = layout.column_mode(lines_of(spark, d)).groupBy("doc_id", "mode").agg(F.count("*").alias("n"), F.min("pno").alias("p"))
    best = n.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "p", "mode", "n")).alias("x"))
    return best.select("doc_id", "x.mode", "x.n")


_BODY = LINES_SQL + """, s AS (SELECT doc_id, pno, round_even(size, 1) AS size, sum(greatest(length(text), 1)) AS w, min(pi) AS f FROM v GROUP BY 1, 2, 3),
bs AS (SELECT doc_id, pno, size AS body_size, CAST(w AS BIGINT) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pno ORDER BY w DESC, f) AS k FROM s) WHERE k = 1)
"""


@query("body_size_mode", _BODY + "SELECT * FROM bs")
def body_size_mode(spark, d):
    return layout.weighted_mode(lines_of(spark, d), layout.PAGE, ["pi"])


@query("heading_flags", _BODY + "SELECT doc_id, pno, pi, size > 1.15 * body_size AS is_heading FROM v JOIN bs USING (doc_id, pno)")
def heading_flags(spark, d):
    return layout.headings(lines_of(spark, d)).select("doc_id", "pno", "pi", "is_heading")


@query("style_class_counts", _BODY + """SELECT CASE WHEN h AND size > 1.3 * body_size THEN 'title' WHEN h THEN 'head_plain' WHEN regexp_matches(text, '^(?i:abstract|index terms)') THEN 'abstract' ELSE 'body' END AS cls, count(*) AS n, sum(length(text))::BIGINT AS chars
FROM (SELECT *, size > 1.15 * body_size AS h FROM v JOIN bs USING (doc_id, pno)) GROUP BY 1""")
def style_class_counts(spark, d):
    h = layout.headings(lines_of(spark, d))
    cls = F.when(F.col("is_heading") & (F.col("size") > 1.3 * F.col("body_size")), "title").when(F.col("is_heading"), "head_plain").when(F.col("text").rlike("^(?i:abstract|index terms)"), "abstract").otherwise("body")
    return h.groupBy(cls.alias("cls")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


_Q = ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {c}_q{int(q * 100):02d}" for c in ("x0", "y0", "x1", "y1") for q in (0.06, 0.94))


@query("page_template_quantiles", LINES_SQL + f"SELECT two, col, {_Q}, count(*) AS n FROM v GROUP BY 1, 2")
def page_template_quantiles(spark, d):
    return layout.template_quantiles(lines_of(spark, d), ["two", "col"], (0.06, 0.94))


@query("median_height_upper", LINES_SQL + "SELECT doc_id, pno, list_sort(list(x1 - x0))[len(list(x1)) // 2 + 1] AS mid_width FROM v GROUP BY 1, 2")
def median_height_upper(spark, d):
    return lines_of(spark, d).groupBy("doc_id", "pno").agg(layout.upper_median(F.col("bbox").x1 - F.col("bbox").x0).alias("mid_width"))


@query("next_below", LINES_SQL + """SELECT a.doc_id, a.pno, a.pi, min(b.y0) AS below_y FROM v a LEFT JOIN v b ON a.doc_id = b.doc_id AND a.pno = b.pno AND a.col = b.col AND a.pi <> b.pi AND b.y0 > a.y1 - 1
AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / greatest(1, least(a.x1 - a.x0, b.x1 - b.x0)) >= 0.2 GROUP BY 1, 2, 3""")
def next_below(spark, d):
    return layout.next_below(lines_of(spark, d)).select("doc_id", "pno", "pi", "below_y")


@query("paragraph_islands", LINES_SQL + """, g AS (SELECT *, y0 - lag(y1) OVER w AS gap, lag(size) OVER w AS ps FROM v WINDOW w AS (PARTITION BY doc_id, pno, col ORDER BY pi)),
p AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 1.5 * size OR size <> ps THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, pno, col ORDER BY pi) AS para FROM g)
SELECT doc_id, pno, col, CAST(para AS BIGINT) AS para, count(*) AS n_lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, sum(length(text))::BIGINT AS chars FROM p GROUP BY doc_id, pno, col, para""")
def paragraph_islands(spark, d):
    return layout.paragraph_islands(lines_of(spark, d)).select("doc_id", "pno", "col", "para", "n_lines", *BOX, "chars")


@query("jitter_stats", LINES_SQL + """, g AS (SELECT two, col, y0 - lag(y1) OVER w AS gap, y0 - lag(y0) OVER w AS pitch FROM v WINDOW w AS (PARTITION BY doc_id, pno, col ORDER BY pi))
SELECT two, col, count(gap) AS n, round(median(gap), 6) AS mid, round(avg(gap), 6) AS mean, round(stddev_pop(gap), 6) AS dev, round(var_pop(pitch), 6) AS var, max(gap) - min(gap) AS width FROM g GROUP BY 1, 2""")
def jitter_stats(spark, d):
    g = layout.line_gaps(lines_of(spark, d)).select("two", "col", "gap", "pitch")
    r = lambda c: F.round(c, 6)
    out = g.groupBy("two", "col").agg(F.count("gap").alias("n"), r(F.avg("gap")).alias("mean"), r(F.stddev_pop("gap")).alias("dev"), r(F.var_pop("pitch")).alias("var"), (F.max("gap") - F.min("gap")).alias("width"))
    mid = layout.counted_percentiles(g, ["two", "col"], {"mid": ("gap", 0.5)})
    return out.join(mid, ["two", "col"], "left")


_REG = "(SELECT doc_id, pno, unnest([0, 1]) AS region, unnest([100.0, 300.0]) AS rx0, unnest([150.0, 400.0]) AS ry0, unnest([300.0, 500.0]) AS rx1, unnest([350.0, 700.0]) AS ry1 FROM (SELECT DISTINCT doc_id, pno FROM v))"


@query("protected_blocks", LINES_SQL + f"SELECT v.doc_id, v.pno, v.pi, CAST(min(region) AS INTEGER) AS region FROM v LEFT JOIN {_REG} r ON v.doc_id = r.doc_id AND v.pno = r.pno AND (x0 + x1) / 2 >= rx0 AND (x0 + x1) / 2 < rx1 AND (y0 + y1) / 2 >= ry0 AND (y0 + y1) / 2 < ry1 GROUP BY 1, 2, 3")
def protected_blocks(spark, d):
    from quillspark.functions.geom import rect

    lines = lines_of(spark, d)
    both = F.array(*(F.struct(F.lit(i).alias("region"), rect(*map(F.lit, r)).alias("rect")) for i, r in enumerate([(100, 150, 300, 350), (300, 400, 500, 700)])))
    regions = lines.select("doc_id", "pno").distinct().select("doc_id", "pno", F.inline(both))
    return layout.protected(lines, regions).select("doc_id", "pno", "pi", "region")


_OPEN = r"CASE doc_id % 4 WHEN 0 THEN regexp_replace(text, '[.]$', '') WHEN 1 THEN regexp_replace(text, '[.]$', '-') ELSE text END"


@query("crosspage_groups", LINES_SQL + rf""", e AS (SELECT doc_id, pno, arg_max(CASE WHEN pi = f AND doc_id % 3 > 0 THEN lower(text) ELSE {_OPEN} END, pi) AS a, arg_min(CASE WHEN doc_id % 3 > 0 THEN lower(text) ELSE {_OPEN} END, pi) AS h FROM (SELECT *, min(pi) OVER (PARTITION BY doc_id, pno) AS f FROM v) GROUP BY 1, 2)
SELECT e.doc_id, e.pno, CASE WHEN regexp_matches(e.a, '[A-Za-z]-$') AND regexp_matches(n.h, '^\p{{Ll}}') THEN e.a[:-2] || n.h ELSE e.a || chr(10) || n.h END AS joined
FROM e JOIN e n ON n.doc_id = e.doc_id AND n.pno = e.pno + 1
WHERE regexp_matches(e.a, '\S') AND NOT regexp_matches(e.a, '[.:;!?。：；？！")\]''”’]\s*$') AND regexp_matches(n.h, '^\s*[\p{{Ll}}\p{{Nd}}(\[{{]') AND NOT regexp_matches(n.h, '^(?i)(fig(ure)?\.?\s|table\s)') AND NOT regexp_matches(n.h, '^\[\d+\]') AND NOT regexp_matches(e.a, '^\[\d+\]') AND length(e.a) + length(n.h) <= 1200""")
def crosspage_groups(spark, d):
    """Lines of half of the documents without their last full stop, or with a hyphen there; two thirds of them in lower case where a page begins."""
    t, i = F.col("text"), F.col("doc_id")
    ended = F.when(i % 4 == 0, F.regexp_replace(t, "[.]$", "")).when(i % 4 == 1, F.regexp_replace(t, "[.]$", "-")).otherwise(t)
    lines = lines_of(spark, d)
    first = lines.groupBy(*layout.PAGE).agg(F.min("pi").alias("first"))
    lines = lines.join(first, layout.PAGE).withColumn("text", F.when((F.col("pi") == F.col("first")) & (i % 3 > 0), F.lower(t)).otherwise(ended))
    return layout.crosspage_groups(lines)


@query("math_fragment_flags", LINES_SQL + "SELECT doc_id, pno, pi, length(text) <= 8 AND regexp_matches(text, '[=<>]') AND NOT regexp_matches(text, '[A-Za-z]{4}') AS is_math FROM v")
def math_fragment_flags(spark, d):
    return lines_of(spark, d).select("doc_id", "pno", "pi", T.math_fragment(F.col("text")).alias("is_math"))


FLAGS = ["Fig. 1 Setup of the test", "Table 2 shows rates", "[12] A. Author, Title", "in the list of REFERENCES", "(a) first item", "1. Second item", "• bullet", "Plain text of a body", "figure it out"]
_VALUES = ", ".join(f"({i}, '{t}')" for i, t in enumerate(FLAGS))


@query("caption_ref_list_flags", f"""SELECT i, regexp_matches(t, '^(?i)(fig(ure)?\\.?\\s|table\\s)') AS is_caption, regexp_matches(t, '^\\[\\d+\\]') OR regexp_matches(t, '(?i)references[\\s.:]*$') AS is_ref,
regexp_matches(t, '^\\s*(?:[(\\[（【]?(?:\\d{{1,2}}|[ivxIVX]{{1,4}}|[a-hA-H])[)\\]）】][\\s.、：]|[①-⑫]|[•·◦‣▪●▸‧]\\s|\\d{{1,2}}[.)]\\s+\\S)') AND NOT regexp_matches(t, '^(?i)(fig(ure)?\\.?\\s|table\\s)') AND NOT (regexp_matches(t, '^\\[\\d+\\]') OR regexp_matches(t, '(?i)references[\\s.:]*$')) AS is_list FROM (VALUES {_VALUES}) v(i, t)""")
def caption_ref_list_flags(spark, d):
    df, t = spark.createDataFrame(list(enumerate(FLAGS)), "i int, t string"), F.col("t")
    cap, ref = t.rlike(T.CAPTION), t.rlike(T.REFERENCE) | t.rlike(T.REFERENCES_END)
    return df.select("i", cap.alias("is_caption"), ref.alias("is_ref"), (t.rlike(T.LIST_ITEM) & ~cap & ~ref).alias("is_list"))


@query("sentence_segments", r"""SELECT conv_id, turn, len(s) AS n, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM (
SELECT conv_id, turn, list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x, ' ')) > 0) AS s FROM conversations)""")
def sentence_segments(spark, d):
    s = T.sentences(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(s).cast("long").alias("n"), F.coalesce(F.array_max(F.transform(s, F.length)), F.lit(0)).cast("long").alias("longest"))


@query("token_counts", r"""SELECT doc_id, len(t)::BIGINT AS n, len(list_filter(t, lambda x: regexp_full_match(x, '\s+')))::BIGINT AS spaces, len(list_distinct(t))::BIGINT AS kinds FROM (
SELECT doc_id, list_transform(regexp_extract_all(text, '[一-鿿㐀-䶿぀-ヿ가-힯]|[\p{L}\p{M}\p{Nd}_''’\-]+|\s+|.'), lambda x: CASE WHEN regexp_full_match(x, '\s+') THEN ' ' ELSE x END) AS t FROM documents)""")
def token_counts(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.filter("t", lambda x: x == " ")).cast("long").alias("spaces"), F.size(F.array_distinct("t")).cast("long").alias("kinds"))


@query("glossary_violations", "SELECT conv_id, turn, array_to_string(list_filter(['the', 'and', 'tion', 'de'], lambda k: contains(text, k) AND NOT contains(text, CASE k WHEN 'the' THEN 'DEF' WHEN 'and' THEN 'CONJ' WHEN 'tion' THEN 'SUF' ELSE 'PREP' END)), ',') AS missed FROM conversations WHERE role = 'assistant'")
def glossary_violations(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.array_join(T.glossary_misses(F.col("text"), GLOSSARY), ",").alias("missed"))


def _fix_sql(t: str) -> str:
    for k, v in GLOSSARY:
        t = f"(SELECT CASE WHEN strpos(z, '{k}') > 0 AND NOT contains(z, '{v}') THEN substr(z, 1, strpos(z, '{k}') - 1) || '{v}' || substr(z, strpos(z, '{k}') + {len(k)}) ELSE z END FROM (SELECT {t} AS z))"
    return t


@query("glossary_fix", f"SELECT conv_id, turn, md5({_fix_sql('text')}) AS fixed FROM conversations WHERE role = 'assistant'")
def glossary_fix(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.md5(T.glossary_fix(F.col("text"), GLOSSARY)).alias("fixed"))


@query("proportional_split", """SELECT conv_id, turn, CAST(CASE WHEN n < 2 THEN n ELSE (SELECT i FROM (SELECT unnest(range(1, n)) AS i) ORDER BY abs(i - n * 0.4::DOUBLE) + CASE WHEN contains(' ，。；：、）】', substr(text, i, 1)) THEN 0 WHEN contains('且和或与并而但及又以', substr(text, i + 1, 1)) THEN 2 ELSE 6 END, i LIMIT 1) END AS INTEGER) AS cut FROM (SELECT *, length(text) AS n FROM conversations WHERE role = 'user')""")
def proportional_split(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.split_at(F.col("text"), F.lit(0.4)).cast("int").alias("cut"))


MARKS = [("a [FORMULA_1] b [FORMULA_10]", "[FORMULA_10] c [FORMULA_1]"), ("x [FORMULA_2]", "x [FORMULA_3]"), ("none", "none"), ("[FORMULA_1][FORMULA_1]", "[FORMULA_1]")]


@query("placeholder_conservation", "SELECT i, list_sort(regexp_extract_all(a, '\\[FORMULA_(\\d+)\\]', 1)) = list_sort(regexp_extract_all(b, '\\[FORMULA_(\\d+)\\]', 1)) AS kept FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(MARKS)) + ") v(i, a, b)")
def placeholder_conservation(spark, d):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(MARKS)], "i int, a string, b string")
    return df.select("i", (T.placeholders(F.col("a")) == T.placeholders(F.col("b"))).alias("kept"))


@query("link_counts", r"""SELECT page_id, href, count(*) AS n, min(ord)::INTEGER AS first FROM (SELECT page_id, unnest(l) AS href, unnest(range(0, len(l))) AS ord FROM (
SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<a href="([^"]*)"', 1) AS l FROM pages)) GROUP BY 1, 2""")
def link_counts(spark, d):
    return page_links(table(spark, d, "pages")).groupBy("page_id", "href").agg(F.count("*").alias("n"), F.min("ord").alias("first"))


@query("watermark_hits", r"""SELECT page_id, NOT (contains(t, 'arxiv:') OR contains(t, 'arxiv.org') OR contains(t, 'doi:')) AND (regexp_matches(t, 'accepted manuscript|author submitted manuscript|author manuscript|unpublished manuscript|manuscript version') OR regexp_matches(t, '(^|[^a-z0-9])(preprint|do not distribute|for review only)([^a-z0-9]|$)')) AS hit FROM (SELECT page_id, lower(html) AS t FROM pages)""")
def watermark_hits(spark, d):
    return table(spark, d, "pages").select("page_id", prompts.watermark(F.lower("html")).alias("hit"))


@query("boilerplate_removed", r"""SELECT page_id, length(b)::BIGINT AS kept, md5(b) AS digest FROM (SELECT page_id, regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<nav.*?</nav>|<footer.*?</footer>|<div class="ad">.*?</div>', '', 'g') AS b FROM pages)""")
def boilerplate_removed(spark, d):
    b = without_boilerplate(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(b).cast("long").alias("kept"), F.md5(b).alias("digest"))


@query("page_subset", LINES_SQL + "SELECT doc_id, pno, count(*) AS n FROM v WHERE pno IN (0, 1, 4) GROUP BY 1, 2")
def page_subset(spark, d):
    from quillspark.functions.config import parse_pages

    return lines_of(spark, d).where(F.col("pno").isin(parse_pages("1-2,5", 10**6))).groupBy("doc_id", "pno").agg(F.count("*").alias("n"))


@query("char_budgets", LINES_SQL + "SELECT doc_id, pno, pi, CASE WHEN x1 - x0 < 5 OR y1 - y0 < 5 THEN 0 ELSE CAST(floor((x1 - x0) / size * ((y1 - y0) / (size * 1.35::DOUBLE)) * 0.92::DOUBLE) AS BIGINT) END AS budget FROM v")
def char_budgets(spark, d):
    b = F.col("bbox")
    w, h = b.x1 - b.x0, b.y1 - b.y0
    n = F.floor(w / F.col("size") * (h / (F.col("size") * 1.35)) * 0.92)
    return lines_of(spark, d).select("doc_id", "pno", "pi", F.when((w < 5) | (h < 5), F.lit(0)).otherwise(n).cast("long").alias("budget"))
