"""Queries over tables, cleaned text, style factors and HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import reflow, tables
from quillspark.plans.registry import query
from quillspark.sources.adapters import LINES_SQL, page_lines, table

_T = r"' ' || chr(9) || chr(160)"
_U = r"' ' || chr(9) || chr(10) || chr(12) || chr(13) || chr(160)"
_JOIN = f"([{T.KANA_HAN_HANGUL}{T.char_class(T.NO_START)}])\\n([{T.KANA_HAN_HANGUL}{T.char_class(T.NO_END)}])"
_GAP = f"([{T.WIDE}])[ \\t\\x{{a0}}]+([{T.WIDE}])"
_CLEAN = f"""replace(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(ltrim(trim(x, {_T}), '{T.BULLETS}'), {_U})), lambda x: x <> ''), chr(10)), '{_JOIN}', '\\1\\2', 'g'), '{_JOIN}', '\\1\\2', 'g'), chr(10), ' ')"""
_CLEAN = f"regexp_replace(regexp_replace({_CLEAN}, '{_GAP}', '\\1\\2', 'g'), '{_GAP}', '\\1\\2', 'g')"


@query("clean_text", f"SELECT 'doc' AS kind, doc_id AS id, {_CLEAN} AS clean FROM documents UNION ALL SELECT 'turn', conv_id * 1000 + turn, {_CLEAN} FROM conversations")
def clean_text(spark, d):
    docs = table(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text")
    turns = table(spark, d, "conversations").select(F.lit("turn"), F.col("conv_id") * 1000 + F.col("turn"), "text")
    return docs.union(turns).select("kind", "id", T.clean_text(F.col("text")).alias("clean"))


@query("rule_tables", LINES_SQL + "SELECT doc_id, pno, 0 AS tbl, 54.0::DOUBLE + doc_id % 3 AS x0, 98.0::DOUBLE AS y0, 546.0::DOUBLE AS x1, 193.0::DOUBLE AS y1 FROM (SELECT DISTINCT doc_id, pno FROM v) WHERE pno % 2 = 0")
def rule_tables(spark, d):
    """Four rules on every page, three of them close to each other on even pages; on odd ones the second is short."""
    left, odd = 60 + F.col("doc_id") % 3, F.col("pno") % 2 == 1
    pages = page_lines(table(spark, d, "documents")).select("doc_id", "pno").distinct()
    rule = lambda y, x1: F.struct(left.cast("double").alias("x0"), F.lit(y).alias("y0"), x1.alias("x1"), F.lit(y + 1).alias("y1"))
    end = F.lit(540.0)
    rules = pages.select("doc_id", "pno", F.inline(F.array(rule(100.0, end), rule(120.0, F.when(odd, 200.0).otherwise(end)), rule(190.0, end), rule(400.0, end))))
    bands = pages.select("doc_id", "pno", F.lit(0).alias("band"), F.lit(0.0).alias("lo"), F.lit(612.0).alias("hi"))
    return tables.rule_tables(rules, bands)


# A heading of two cells over three rows of three; four rows of a label and a number set flush right.
CELLS = [(1, 0, 0, 0, float(x), x + 40.0, f"h{x}") for x in (100, 420)] + [(1, 0, 0, b, float(x), x + 40.0, f"c{b}{x}") for b in (1, 2, 3) for x in (100, 260, 420)]
CELLS += [(1, 0, 1, b, float(x), e, t) for b, n in enumerate(("1.23", "12.345", "7.8", "105.2")) for x, e, t in ((100, 140.0, f"r{b}"), (260, 300.0, f"s{b}"), (460 - 6 * len(n), 460.0, n))]
_CELLS = ", ".join(f"(1, 0, {c[2]}, {c[3]}, '{c[6]}', {0.7 if c[2] == 0 and c[3] == 0 else 0.9}::DOUBLE, {c[4]})" for c in CELLS)


@query("table_anchor_split", LINES_SQL + f"SELECT p.doc_id, p.pno, tbl, band, CAST(row_number() OVER (PARTITION BY p.doc_id, p.pno, tbl, band ORDER BY x) - 1 AS INTEGER) AS cell, text, conf FROM (SELECT DISTINCT doc_id, pno FROM v) p, (VALUES {_CELLS}) c(a, b, tbl, band, text, conf, x)")
def table_anchor_split(spark, d):
    """Both tables on every page, moved to the right by the document's remainder."""
    cell = lambda c: F.struct(F.lit(c[2]).alias("tbl"), F.lit(c[3]).alias("band"), (F.lit(c[4]) + F.col("doc_id") % 7).alias("x0"), (F.lit(c[5]) + F.col("doc_id") % 7).alias("x1"), F.lit(c[6]).alias("text"))
    pages = page_lines(table(spark, d, "documents")).select("doc_id", "pno").distinct()
    return tables.anchor_split(pages.select("doc_id", "pno", F.inline(F.array(*map(cell, CELLS)))))


SPANNING = [(0, 0, 600.0, 780.0, "Method Value", [85.0, 300.0]), (1, 0, 60.0, 200.0, "Method Values", [85.0, 250.0]), (1, 1, 600.0, 780.0, "a b", [85.0, 300.0]), (2, 0, 60.0, 90.0, "other words", [84.0, 301.0]), (3, 0, 60.0, 90.0, "x", [10.0])]


@query("crosspage_tables", "SELECT doc_id, pno, tbl, from_pno, from_tbl, gid FROM documents, (VALUES (1, 0, 0, 0, 0), (2, 0, 1, 1, 1)) v(pno, tbl, from_pno, from_tbl, gid)")
def crosspage_tables(spark, d):
    """Tables on four pages of every document, of which two go on on the next one."""
    spec = lambda x: F.struct(*(F.lit(v).alias(n) for v, n in zip(x[:5], ("pno", "tbl", "y0", "y1", "head"), strict=True)), F.array(*map(F.lit, x[5])).alias("anchors"))
    return tables.crosspage_tables(table(spark, d, "documents").select("doc_id", F.inline(F.array(*map(spec, SPANNING)))), 842.0)


_CLS = "CASE WHEN size = 16 THEN 'title' WHEN size = 8 THEN 'ref_entry' ELSE 'body' END"
_LEVELS = [(f"(CASE WHEN cls = 'title' THEN {h[0] * h[1]!r} ELSE {p[0] * p[1]!r} END)::DOUBLE") for h, p in zip([(1.0, 1.0), (0.96, 1.0), (0.92, 1.0), (0.88, 1.0), (0.85, 1.0), (0.85, 0.98)], [(1.0, 1.0), (0.96, 1.0), (0.92, 1.0), (0.92, 0.98), (0.92, 0.98), (0.92, 0.98)], strict=True)]
_FITS = ", ".join(f"least(1::DOUBLE, sqrt(ratio / {x})) AS f{i}" for i, x in enumerate(_LEVELS))
_BEST = ", ".join("CASE " + " ".join(f"WHEN f{j} >= 0.996::DOUBLE THEN f{j}" for j in range(i)) + f" ELSE f{i} END AS v{i}" if i else "f0 AS v0" for i in range(6))


@query("style_factors", LINES_SQL + f""", s AS (SELECT doc_id, {_CLS} AS cls, (x1 - x0) * 12 / (length(text) * 5.0::DOUBLE * 12 * 1.1::DOUBLE) AS ratio FROM v),
f AS (SELECT *, {_FITS} FROM s), b AS (SELECT *, {_BEST} FROM f),
c AS (SELECT doc_id, cls, count(*) AS n, count(*) FILTER (v0 < 0.996::DOUBLE) AS n_tight, {", ".join(f"min(v{i}) AS m{i}" for i in range(6))} FROM b GROUP BY 1, 2),
l AS (SELECT *, CASE WHEN n_tight < 0.3 * n THEN 0 {" ".join(f"WHEN m{i} >= 0.996::DOUBLE THEN {i}" for i in range(1, 5))} ELSE 5 END AS lv FROM c),
m AS (SELECT *, [m0, m1, m2, m3, m4, m5][lv + 1] AS low FROM l)
SELECT doc_id, cls, n, n_tight, round(CASE WHEN lv = 0 OR cls = 'title' OR low >= 1 THEN 1::DOUBLE WHEN low < 0.78::DOUBLE THEN 0.78::DOUBLE ELSE low * 0.998::DOUBLE END, 6) AS factor,
(CASE WHEN cls = 'title' THEN [1.0, 0.96, 0.92, 0.88, 0.85, 0.85] ELSE [1.0, 0.96, 0.92, 0.92, 0.92, 0.92] END)[lv + 1]::DOUBLE AS lead,
(CASE WHEN cls = 'title' THEN [1.0, 1.0, 1.0, 1.0, 1.0, 0.98] ELSE [1.0, 1.0, 1.0, 0.98, 0.98, 0.98] END)[lv + 1]::DOUBLE AS tracking FROM m""")
def style_factors(spark, d):
    b = F.col("bbox")
    cls = F.when(F.col("size") == 16, "title").when(F.col("size") == 8, "ref_entry").otherwise("body")
    specs = page_lines(table(spark, d, "documents")).select("doc_id", cls.alias("cls"), ((b.x1 - b.x0) * 12 / (F.length("text") * F.lit(5.0) * 12 * 1.1)).alias("ratio"))
    return reflow.style_factors(specs, ["doc_id"], [0.96, 0.92], 0.98)


_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("html_blocks", LINES_SQL + f"""SELECT doc_id, string_agg(CASE WHEN size = 16 THEN '<h1>' || {_ESC.format("text")} || '</h1>' WHEN pi = 5 THEN '<div class=fig><p class=fc><img src="p' || pno || '.png" style="width:228.0pt"></p><p class=caption>' || {_ESC.format("text")} || '</p></div>'
WHEN size = 8 THEN '<p class=ref>' || {_ESC.format("text")} || '</p>' ELSE '<p>' || {_ESC.format("text")} || '</p>' END, '' ORDER BY pno, pi) AS html FROM v GROUP BY 1""")
def html_blocks(spark, d):
    cls = F.when(F.col("size") == 16, "title").when(F.col("size") == 8, "ref_entry").otherwise("body")
    picture = (F.col("pi") == 5) & (F.col("size") != 16)
    blocks = page_lines(table(spark, d, "documents")).select("doc_id", (F.col("pno") * 24 + F.col("pi")).alias("i"), F.when(picture, "figure").otherwise("para").alias("kind"), cls.alias("cls"), "text", F.concat(F.lit("p"), F.col("pno").cast("string"), F.lit(".png")).alias("img"), F.col("text").alias("caption"), F.lit("").alias("extra"), F.lit(300.0).alias("width"))
    return reflow.html_documents(blocks, "doc_id", 228.0)


_SPOKEN = "CASE pi % 8 WHEN 0 THEN 'Algorithm 1: ' || text WHEN 1 THEN 'Algorithm 2 : Q' || chr(10) || 'Input: n' || chr(10) || 'for i do' WHEN 2 THEN 'for ' || text WHEN 3 THEN 'End if' WHEN 4 THEN 'l=i' WHEN 5 THEN '7 % note' WHEN 6 THEN text ELSE 'if so' END"


@query("verbatim_flags", LINES_SQL + rf""", f AS (SELECT doc_id, pno, pi, {_SPOKEN} AS t, pi % 3 = 1 AS mono, pi % 3 = 2 OR pi % 5 = 0 AS bold FROM v), s AS (SELECT *, regexp_replace(t, '^\s+|\s+$', '', 'g') AS s FROM f)
SELECT doc_id, pno, pi, regexp_matches(t, '^\s*Algorithm\s+\d+\s*:') AND contains(s, chr(10)) AND (mono OR contains(lower(t)[1:80], 'input') AND contains(lower(t), 'for') AND contains(lower(t), 'do')) AS body,
length(s) <= 200 AND (regexp_matches(s, '^(Break out of|End for|End while|End if|(for|if|while|return)\s|(else|Sample|Initialise)([^A-Za-z0-9_]|$))') AND NOT bold OR length(s) <= 8 AND regexp_matches(s, '[=<>]') AND NOT regexp_matches(s, '[A-Za-z]{{4}}') OR mono OR regexp_matches(s, '^\d+\s*[%\s]|^%\s')) AS rest FROM s""")
def verbatim_flags(spark, d):
    """Lines as parts of algorithms by their number, in three fonts, some of them marked as bold."""
    p, t = F.col("pi"), F.col("text")
    forms = (F.concat(F.lit("Algorithm 1: "), t), F.lit("Algorithm 2 : Q\nInput: n\nfor i do"), F.concat(F.lit("for "), t), F.lit("End if"), F.lit("l=i"), F.lit("7 % note"), t, F.lit("if so"))
    text = F.element_at(F.array(*forms), p % 8 + 1)
    font = F.element_at(F.array(*map(F.lit, ("Times", "NimbusMono", "Times-Bold"))), p % 3 + 1)
    lines = page_lines(table(spark, d, "documents")).select("doc_id", "pno", "pi", text.alias("text"), font.alias("font"), F.when(p % 5 == 0, 16).otherwise(0).alias("flags"))
    lines = lines.withColumn("spans", F.array(F.struct("text", "font", "flags")))
    return lines.select("doc_id", "pno", "pi", T.algorithm_body(F.col("text"), F.col("spans")).alias("body"), T.algorithm_rest(F.col("text"), F.col("spans")).alias("rest"))
