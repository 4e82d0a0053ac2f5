"""Queries over styles, budgets, prompts, readings of scans and glossaries, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import prompts, styles
from quillspark.functions.geom import rect
from quillspark.operators import glossaries, layout
from quillspark.plans.layout_queries import _BODY, BOX, lines_of
from quillspark.plans.registry import query
from quillspark.sources import readings
from quillspark.sources.adapters import LINES_SQL, table

PAGE = layout.PAGE
_TITLED = "CASE WHEN pi % 6 = 1 THEN 'IV. ' || upper(substr(text, 1, 40)) WHEN pi % 6 = 2 THEN 'B. ' || text WHEN pi % 6 = 4 THEN 'Abstract: ' || text ELSE text END"


def _titled():
    t, p = F.col("text"), F.col("pi") % 6
    return F.when(p == 1, F.concat(F.lit("IV. "), F.upper(F.substr(t, F.lit(1), F.lit(40))))).when(p == 2, F.concat(F.lit("B. "), t)).when(p == 4, F.concat(F.lit("Abstract: "), t)).otherwise(t)


_SEC = r"(length(t) <= 64 AND regexp_matches(t, '^[IVX]+[.)]?\s+\S') AND length(regexp_replace(t, '[^\p{L}]', '', 'g')) > 0 AND length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) >= 0.8 * length(regexp_replace(t, '[^\p{L}]', '', 'g')))"
_CLASS = _BODY + f""", h AS (SELECT v.*, {_TITLED} AS raw, size > 1.15 * body_size AS h, body_size FROM v JOIN bs USING (doc_id, pno)), t AS (SELECT *, trim(raw, ' ') AS t FROM h),
c AS (SELECT *, CASE WHEN h AND size > 1.3 * body_size THEN 'title' WHEN (h OR {_SEC}) AND regexp_matches(t, '^[IVX]+[.)]?\\s+\\S') THEN 'sec_title' WHEN h AND regexp_matches(t, '^[A-D][.)]\\s+\\S') THEN 'subsec_title'
  WHEN regexp_matches(t, '^(?i:abstract|index terms)') THEN 'abstract' WHEN h THEN 'head_plain' WHEN pi % 11 = 5 THEN 'caption' WHEN pi % 13 = 6 THEN 'ref_entry' ELSE 'body' END AS cls FROM t),
k AS (SELECT *, CASE WHEN cls IN ('title', 'sec_title', 'ref_entry') THEN 1.22::DOUBLE WHEN cls IN ('subsec_title', 'head_plain') THEN 1.28::DOUBLE ELSE 1.35::DOUBLE END AS lh FROM c)
"""


def classified(spark, d):
    lines = layout.headings(lines_of(spark, d)).withColumn("raw", _titled())
    p = F.col("pi")
    cls = styles.style_class(F.col("raw"), F.col("size"), F.col("body_size"), F.col("is_heading"), p % 11 == 5, p % 13 == 6)
    return lines.withColumn("cls", cls).withColumn("lh", styles.line_height(F.col("cls")))


@query("style_classes", _CLASS + "SELECT doc_id, pno, pi, cls, lh FROM k")
def style_classes(spark, d):
    return classified(spark, d).select(*PAGE, "pi", "cls", "lh")


@query("section_titles", LINES_SQL + f"SELECT doc_id, pno, pi, {_SEC} AS is_title FROM (SELECT *, {_TITLED} AS t FROM v)")
def section_titles(spark, d):
    return lines_of(spark, d).select(*PAGE, "pi", styles.section_title(_titled()).alias("is_title"))


@query("largest_spans", LINES_SQL + "SELECT doc_id, pno, col, max(size) AS size FROM v GROUP BY 1, 2, 3")
def largest_spans(spark, d):
    spans = lines_of(spark, d).groupBy(*PAGE, "col").agg(F.collect_list(F.struct("size")).alias("spans"))
    return spans.select(*PAGE, "col", styles.largest_span(F.col("spans")).alias("size"))


_BUDGET = "CAST(floor((x1 - x0) / (greatest(size, 6.5) * 0.5::DOUBLE) * ((y1 - y0) / (greatest(size, 6.5) * greatest(lh, 0.8::DOUBLE))) * 0.92::DOUBLE) AS INTEGER)"


@query("unit_budgets", _CLASS + f"SELECT doc_id, pno // 2 AS unit, CASE WHEN (pno // 2) % 5 = 4 OR sum(b) = 0 THEN NULL ELSE CAST(sum(b) AS BIGINT) END AS budget, count(*) AS n FROM (SELECT doc_id, pno, {_BUDGET} AS b FROM k) GROUP BY 1, 2")
def unit_budgets(spark, d):
    """Budgets of units that span two pages are sums over their lines; every fifth one counts as a reading of a scan, without any."""
    size = F.greatest("size", F.lit(6.5))
    lines = classified(spark, d).withColumn("b", styles.char_budget(F.col("bbox"), size, F.col("lh"), False)).withColumn("unit", F.floor(F.col("pno") / 2).cast("int"))
    total = F.sum("b")
    return lines.groupBy("doc_id", "unit").agg(F.when((F.col("unit") % 5 != 4) & (total > 0), total).alias("budget"), F.count("*").alias("n"))


@query("room_below", LINES_SQL + """, b AS (SELECT a.doc_id, a.pno, a.pi, min(b.y0) AS below FROM v a LEFT JOIN v b ON a.doc_id = b.doc_id AND a.pno = b.pno AND a.col = b.col AND a.pi <> b.pi AND b.y0 > a.y1 - 1
AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / greatest(1, least(a.x1 - a.x0, b.x1 - b.x0)) >= 0.2 GROUP BY 1, 2, 3)
SELECT doc_id, pno, pi, greatest(y1, least(coalesce(below, 842) - 2, 842 - 2)) AS y1 FROM v JOIN b USING (doc_id, pno, pi)""")
def room_below(spark, d):
    lines = layout.next_below(lines_of(spark, d))
    return lines.select(*PAGE, "pi", styles.room_below(F.col("bbox"), F.col("below_y"), F.lit(842.0)).y1.alias("y1"))


@query("covered_blocks", LINES_SQL + "SELECT doc_id, pno, pi, greatest(0, least(x1, 200) - greatest(x0, 100)) * greatest(0, least(y1, 300) - greatest(y0, 50)) > 0.3::DOUBLE * (x1 - x0) * (y1 - y0) OR greatest(0, least(x1, 560) - greatest(x0, 330)) * greatest(0, least(y1, 700) - greatest(y0, 400)) > 0.3::DOUBLE * (x1 - x0) * (y1 - y0) AS skipped FROM v")
def covered_blocks(spark, d):
    graphics = F.array(rect(*map(F.lit, (100, 50, 200, 300))), rect(*map(F.lit, (330, 400, 560, 700))))
    return lines_of(spark, d).select(*PAGE, "pi", styles.mostly_covered(F.col("bbox"), graphics).alias("skipped"))


_F = "CASE cls WHEN 'title' THEN 0.9::DOUBLE WHEN 'body' THEN 0.85::DOUBLE END"


@query("style_rules", _CLASS + f""", f AS (SELECT *, coalesce(CASE WHEN pi % 9 = 4 THEN 0.8::DOUBLE END, CASE WHEN pi % 4 > 0 THEN {_F} END, 1.0) AS fac, coalesce(CASE WHEN pi % 9 = 4 THEN 1.0::DOUBLE END, CASE WHEN cls IN ('title', 'body') THEN 0.96::DOUBLE END, 1.0) AS lead, coalesce(CASE WHEN pi % 9 = 4 THEN 0.98::DOUBLE END, CASE WHEN cls IN ('title', 'body') THEN 1.0::DOUBLE END, 1.0) AS trk FROM k)
SELECT doc_id, pno, pi, 'p{{font-family:' || CASE WHEN cls = 'title' THEN 'head' ELSE 'text' END || ';font-size:' || printf('%.2f', size * fac) || 'pt;line-height:' || printf('%.3f', lh * lead) || ';text-align:' || CASE WHEN cls = 'title' THEN 'center' ELSE 'justify' END || ';text-indent:' || printf('%.2f', CASE WHEN cls = 'body' THEN 2.0 ELSE 0.0 END * (size * fac)) || 'pt;margin:0;' || CASE WHEN trk < 1 THEN 'letter-spacing:' || printf('%.3f', (trk - 1) * (size * fac)) || 'pt;' ELSE '' END || '}}' AS css FROM f""".replace("{{", "{").replace("}}", "}"))
def style_rules(spark, d):
    """Rules of all lines: factors of two classes, of which a quarter may not shrink, and own ones of every ninth line."""
    p, cls = F.col("pi"), F.col("cls")
    parts = lambda f, lead, t, keep: F.when(keep, F.struct(F.lit(f).cast("double").alias("factor"), F.lit(lead).cast("double").alias("lead"), F.lit(t).cast("double").alias("tracking")))
    of_class = F.coalesce(parts(0.9, 0.96, 1.0, cls == "title"), parts(0.85, 0.96, 1.0, cls == "body"))
    x = classified(spark, d).withColumn("f", styles.factors_of(parts(0.8, 1.0, 0.98, p % 9 == 4), of_class, p % 4 > 0))
    title = cls == "title"
    css = styles.paragraph_css(F.when(title, "head").otherwise("text"), F.col("size"), F.col("lh"), F.when(title, "center").otherwise("justify"), F.when(cls == "body", 2.0).otherwise(0.0), F.col("f.factor"), F.col("f.lead"), F.col("f.tracking"))
    return x.select(*PAGE, "pi", css.alias("css"))


@query("script_flags", "SELECT doc_id, regexp_matches(text, '[一-鿿぀-ヿ가-힯]') AS cjk, regexp_matches(text, '[一-鿿]') AS han, regexp_matches(text, '[A-Za-zÀ-ɏͰ-ϿЀ-ӿḀ-῿]') AS letters FROM documents UNION ALL SELECT -1 - doc_id, true, doc_id % 2 = 0, false FROM documents")
def script_flags(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = docs.union(docs.select(-1 - F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, "汉").otherwise("か")))
    t = F.col("text")
    return rows.select("doc_id", prompts.has_cjk(t).alias("cjk"), prompts.has_cjk(t, False).alias("han"), prompts.has_letters(t).alias("letters"))


@query("masked_keys", "SELECT doc_id, CASE WHEN k = '' THEN '' WHEN length(k) > 12 THEN k[1:6] || '***' || k[-4:] ELSE '***' END AS masked FROM (SELECT doc_id, substr(md5(text), 1, doc_id % 20) AS k FROM documents)")
def masked_keys(spark, d):
    key = F.substr(F.md5("text"), F.lit(1), (F.col("doc_id") % 20).cast("int"))
    return table(spark, d, "documents").select("doc_id", prompts.masked(key).alias("masked"))


@query("output_names", "SELECT doc_id, source || doc_id || CASE WHEN doc_id % 2 = 0 THEN '-bilingual' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '-p1-2' ELSE '' END || '-' || upper(lang[1]) || lang[2:] || '.pdf' AS name FROM documents")
def output_names(spark, d):
    i = F.col("doc_id")
    name = prompts.output_name(F.concat("source", i.cast("string")), F.initcap("lang"), i % 2 == 0, F.when(i % 3 == 0, "-p1-2"))
    return table(spark, d, "documents").select("doc_id", name.alias("name"))


@query("page_lists", LINES_SQL + ", p AS (SELECT doc_id, list_sort(list(DISTINCT pno)) AS ps FROM v GROUP BY 1) SELECT doc_id, array_to_string(list_transform(ps[1:8], lambda p: p + 1), ', ') || CASE WHEN len(ps) > 8 THEN ' …' ELSE '' END AS pages FROM p")
def page_lists(spark, d):
    return lines_of(spark, d).groupBy("doc_id").agg(prompts.page_list(F.array_sort(F.collect_set("pno"))).alias("pages"))


RULES = ["You translate.", "Keep placeholders."]


@query("system_prompts", """WITH b AS (SELECT conv_id, list(CASE WHEN role = 'user' THEN length(text) END ORDER BY turn) AS bs FROM conversations GROUP BY 1),
p AS (SELECT conv_id, list_filter(list_transform(range(1, len(bs) + 1), lambda i: CASE WHEN bs[i] > 0 THEN 'id ' || i || ' <= ' || bs[i] END), lambda x: x IS NOT NULL) AS ps FROM b)
SELECT conv_id, 'You translate.' || chr(10) || 'Keep placeholders.' || CASE WHEN len(ps) > 0 THEN chr(10) || 'Length limits in characters: ' || array_to_string(ps, ', ') || '.' ELSE '' END
|| CASE WHEN conv_id % 2 = 0 THEN chr(10) || 'Glossary (translate these terms EXACTLY as specified):' || chr(10) || '- a => b' || chr(10) || '- c => d' ELSE '' END AS prompt FROM p""")
def system_prompts(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("role") == "user", F.length("text")).alias("n"))))
    budgets = F.transform(turns, lambda x: x.n)
    term = lambda k, v: F.struct(F.lit(k).alias("k"), F.lit(v).alias("v"))
    terms = F.when(F.col("conv_id") % 2 == 0, F.array(term("a", "b"), term("c", "d"))).otherwise(F.slice(F.array(term("a", "b")), 1, 0))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(budgets.alias("budgets"))
    return rows.select("conv_id", prompts.system_prompt(RULES, prompts.budget_rule(F.col("budgets")), prompts.glossary_block(terms)).alias("prompt"))


@query("content_fingerprints", "SELECT page_id, md5(html) AS fp, count(*) OVER (PARTITION BY md5(html)) AS copies FROM pages")
def content_fingerprints(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.md5("html").alias("fp"))
    return pages.join(pages.groupBy("fp").agg(F.count("*").alias("copies")), "fp").select("page_id", "fp", "copies")


_STREAM = "'q BT 1 0 0 1 5 5 Tm (' || w || ') Tj ET ' || 'BT 0.7 ' || s || ' -' || s || ' 0.7 9 9 Tm (' || w || ') Tj ET Q'"
WORDS = "draft|preprint"


@query("skewed_watermarks", f"SELECT doc_id, CASE WHEN s <> '0' AND w <> 'text' THEN 'q BT 1 0 0 1 5 5 Tm (' || w || ') Tj ET  Q' ELSE {_STREAM} END AS stream FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Draft' WHEN 1 THEN 'preprint' ELSE 'text' END AS w, CASE WHEN doc_id % 2 = 0 THEN '0.7' ELSE '0' END AS s FROM documents)")
def skewed_watermarks(spark, d):
    i = F.col("doc_id")
    w, s = F.when(i % 3 == 0, "Draft").when(i % 3 == 1, "preprint").otherwise("text"), F.when(i % 2 == 0, "0.7").otherwise("0")
    stream = F.concat(F.lit("q BT 1 0 0 1 5 5 Tm ("), w, F.lit(") Tj ET BT 0.7 "), s, F.lit(" -"), s, F.lit(" 0.7 9 9 Tm ("), w, F.lit(") Tj ET Q"))
    return table(spark, d, "documents").select("doc_id", prompts.without_skewed(stream, WORDS).alias("stream"))


@query("stream_removals", """SELECT doc_id AS id, CASE WHEN low AND (length(s) < 60 OR doc_id % 5 = 0) THEN 'removed' WHEN skew AND low THEN 'cleaned' ELSE 'kept' END AS action FROM (SELECT doc_id, w <> 'text' AS low, doc_id % 2 = 0 AS skew, 'q BT 1 0 0 1 5 5 Tm (' || w || ') Tj ET ' || CASE WHEN doc_id % 4 < 2 THEN 'BT 0.7 ' || CASE WHEN doc_id % 2 = 0 THEN '0.7' ELSE '0' END || ' 0 0.7 9 9 Tm (' || w || ') Tj ET' ELSE '' END AS s
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Draft' WHEN 1 THEN 'preprint' ELSE 'text' END AS w FROM documents))""")
def stream_removals(spark, d):
    i = F.col("doc_id")
    w = F.when(i % 3 == 0, "Draft").when(i % 3 == 1, "preprint").otherwise("text")
    turned = F.concat(F.lit("BT 0.7 "), F.when(i % 2 == 0, "0.7").otherwise("0"), F.lit(" 0 0.7 9 9 Tm ("), w, F.lit(") Tj ET"))
    stream = F.concat(F.lit("q BT 1 0 0 1 5 5 Tm ("), w, F.lit(") Tj ET "), F.when(i % 4 < 2, turned).otherwise(""))
    rows = table(spark, d, "documents").select(i.alias("id"), stream.alias("stream"), (i % 5 == 0).alias("is_annotation"))
    return prompts.stream_removals(rows, WORDS, 60).select("id", "action")


@query("decoded_views", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lower(t) || chr(10) || lower(t) ELSE lower(t) END = v AS same, true AS shown FROM (SELECT doc_id, 'Draft' || doc_id AS t, CASE WHEN doc_id % 2 = 0 THEN 'draft' || doc_id || chr(10) || 'draft' || doc_id ELSE 'draft' || doc_id END AS v FROM documents)")
def decoded_views(spark, d):
    """Texts in two-byte codes (even documents) show up behind the bytes with their zeros."""
    t = F.concat(F.lit("Draft"), F.col("doc_id").cast("string"))
    wide = F.col("doc_id") % 2 == 0
    view = prompts.two_views(F.when(wide, F.encode(t, "UTF-16BE")).otherwise(t.cast("binary")))
    last = F.element_at(F.split(view, "\n"), -1)
    return table(spark, d, "documents").select("doc_id", ((last == F.lower(t)) & (F.size(F.split(view, "\n")) == F.when(wide, 2).otherwise(1))).alias("same"), F.contains(view, F.lower(t)).alias("shown"))


@query("readings_in_points", LINES_SQL + "SELECT doc_id, pno, pi, greatest(0, least((x0 * 3 - 400) * 72 / 200, 612)) AS x0, greatest(0, least(y0 * 3 * 72 / 200, 842)) AS y0, greatest(0, least(x1 * 3 * 72 / 200, 612)) AS x1, greatest(0, least(y1 * 3 * 72 / 200, 842)) AS y1, greatest(0, least(1, (pi - 2) / 10)) AS score FROM v")
def readings_in_points(spark, d):
    b = F.col("bbox")
    px = lines_of(spark, d).select(*PAGE, "pi", (b.x0 * 3 - 400).alias("x0"), (b.y0 * 3).alias("y0"), (b.x1 * 3).alias("x1"), (b.y1 * 3).alias("y1"), ((F.col("pi") - 2) / 10).alias("score"))
    return readings.in_points(px, 200, F.lit(612.0), F.lit(842.0)).select(*PAGE, "pi", *BOX, "score")


@query("words_to_lines", LINES_SQL + """, w AS (SELECT doc_id, pno, pi, col, unnest(range(0, len(ws))) AS k, unnest(ws) AS word, x0, y0 FROM (SELECT *, string_split(text, ' ') AS ws FROM v)),
g AS (SELECT *, x0 + 40 * k AS l, CASE WHEN k % 7 = 3 THEN -1 ELSE (k * 13 + pi) % 101 END AS conf FROM w)
SELECT doc_id, pno, col AS block, pi // 6 AS par, pi AS line, string_agg(word, ' ' ORDER BY l) AS text, min(l) AS x0, max(l + 5 * length(word)) AS x1, round(avg(conf) / 100, 9) AS score FROM g WHERE length(trim(word, ' ')) > 0 AND conf >= 0 GROUP BY 1, 2, 3, 4, 5""")
def words_to_lines(spark, d):
    b, k, p = F.col("bbox"), F.col("k"), F.col("pi")
    ws = lines_of(spark, d).select(*PAGE, "pi", "col", "bbox", F.posexplode(F.split("text", " ")).alias("k", "text"))
    ws = ws.select(*PAGE, F.col("col").alias("block"), F.floor(p / 6).cast("int").alias("par"), p.alias("line"), (b.x0 + 40 * k).alias("left"), b.y0.alias("top"), (5 * F.length("text")).alias("width"), F.lit(12).alias("height"), "text", F.when(k % 7 == 3, -1).otherwise((k * 13 + p) % 101).alias("conf"))
    out = readings.words_to_lines(ws, PAGE)
    return out.select(*PAGE, "block", "par", "line", "text", F.col("bbox.x0").alias("x0"), F.col("bbox.x1").alias("x1"), F.round("score", 9).alias("score"))


@query("normalised_readings", """WITH r AS (SELECT doc_id, doc_id % 4 AS k, (doc_id % 50)::DOUBLE AS x FROM documents)
SELECT doc_id, 0::INTEGER AS i, x AS x0, 5.0::DOUBLE AS y0, x + 30 AS x1, 15.0::DOUBLE AS y1, 'first' AS text, 0.9::DOUBLE AS score FROM r WHERE k IN (0, 1) UNION ALL SELECT doc_id, 1, x, 20, x + 30, 30, 'second', CASE WHEN k = 0 THEN 1.0 ELSE 0.8::DOUBLE END FROM r WHERE k IN (0, 1)""")
def normalised_readings(spark, d):
    """Results of either shape, a broken one and one without readings, by remainder of the document."""
    x = (F.col("doc_id") % 50).cast("string")
    x2 = (F.col("doc_id") % 50 + 30).cast("string")
    box = lambda a, b: F.concat(F.lit("[["), x, F.lit(f",{a}],["), x2, F.lit(f",{a}],["), x2, F.lit(f",{b}],["), x, F.lit(f",{b}]]"))
    new = F.concat(F.lit('[{"res": {"rec_texts": ["first", "second"], "rec_scores": [0.9], "rec_polys": ['), box(5, 15), F.lit(","), box(20, 30), F.lit("]}}]"))
    old = F.concat(F.lit("[["), F.lit("["), box(5, 15), F.lit(',["first",0.9]],['), box(20, 30), F.lit(',["second",0.8]]]]'))
    result = F.when(F.col("doc_id") % 4 == 0, new).when(F.col("doc_id") % 4 == 1, old).when(F.col("doc_id") % 4 == 2, "[[broken").otherwise("{}")
    return readings.normalised(table(spark, d, "documents").select("doc_id", result.alias("result")), "doc_id")


@query("region_kinds", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'header' WHEN 1 THEN 'header' WHEN 2 THEN 'figure' WHEN 3 THEN 'text' WHEN 4 THEN 'list' ELSE 'caption' END AS kind FROM documents")
def region_kinds(spark, d):
    names = F.array(*map(F.lit, ("Section-Header", "page-header", "Picture", "paragraph", "List-item", "table caption")))
    return table(spark, d, "documents").select("doc_id", readings.region_kind(F.element_at(names, (F.col("doc_id") % 6 + 1).cast("int"))).alias("kind"))


@query("missing_glyphs", r"SELECT lang, c AS char, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, '[^\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')) AS c FROM documents) WHERE NOT (unicode(c) BETWEEN 33 AND 126) GROUP BY 1, 2")
def missing_glyphs(spark, d):
    covered = spark.range(33, 127).select(F.char(F.col("id")).alias("char"))
    return readings.missing_glyphs(table(spark, d, "documents").select("lang", "text"), covered, "lang")


_TERMS = "(SELECT 'f' || (item_id % 3) AS file, item_id AS line, 't' || (item_id % 17) AS term, CASE WHEN item_id % 10 = 3 THEN ' ' ELSE 'd' || item_id END AS dst FROM benchmark)"


def _terms(spark, d):
    i = F.col("item_id")
    text = lambda a, n: F.concat(F.lit(a), n.cast("string"))
    return table(spark, d, "benchmark").select(text("f", i % 3).alias("file"), i.alias("line"), text("t", i % 17).alias("term"), F.when(i % 10 == 3, " ").otherwise(text("d", i)).alias("dst"))


@query("merged_terms", f"SELECT term, arg_max(dst, (file, line)) AS dst, arg_max(file, (file, line)) AS file, count(*) AS n, min(file) AS first_file, arg_min(line, (file, line)) AS first_line FROM {_TERMS} GROUP BY 1")
def merged_terms(spark, d):
    return glossaries.merged_terms(_terms(spark, d)).select("term", "dst", "file", "n", F.col("pos.file").alias("first_file"), F.col("pos.line").alias("first_line"))


@query("term_issues", f"""SELECT file, line, term, issue FROM (SELECT *, CASE WHEN trim(dst, ' ') = '' THEN 'empty' WHEN row_number() OVER (PARTITION BY term, file ORDER BY line) > 1 THEN 'repeated'
WHEN min(file) OVER (PARTITION BY term ORDER BY file, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < file THEN 'overrides' END AS issue FROM {_TERMS}) WHERE issue IS NOT NULL""")
def term_issues(spark, d):
    return glossaries.term_issues(_terms(spark, d))


PRESETS = [("base", 10, 3000), ("fast", 60, 6000), ("slow", 4, None)]


@query("filled_settings", "SELECT job, provider, coalesce(rpm, p_rpm) AS rpm, coalesce(chars, p_chars) AS chars FROM (SELECT DISTINCT user_id AS job, [' Base', 'fast', 'other', 'slow '][user_id % 4 + 1] AS provider, CASE WHEN user_id % 3 = 0 THEN 7 END AS rpm, CASE WHEN user_id % 5 = 0 THEN 99 END AS chars FROM events) LEFT JOIN (VALUES ('base', 10, 3000), ('fast', 60, 6000), ('slow', 4, NULL)) p(key, p_rpm, p_chars) ON lower(trim(provider, ' ')) = key")
def filled_settings(spark, d):
    i = F.col("job")
    jobs = table(spark, d, "events").select(F.col("user_id").alias("job")).distinct()
    rows = jobs.select("job", F.element_at(F.array(*map(F.lit, (" Base", "fast", "other", "slow "))), (i % 4 + 1).cast("int")).alias("provider"), F.when(i % 3 == 0, 7).alias("rpm"), F.when(i % 5 == 0, 99).alias("chars"))
    return glossaries.filled(rows, spark.createDataFrame(PRESETS, "provider string, rpm int, chars int"), "provider", ["rpm", "chars"])
