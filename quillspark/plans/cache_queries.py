"""Queries over caches: key tiers, stored sentences, layouts, renders and migrations, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import caching, units
from quillspark.plans.layout_queries import lines_of
from quillspark.plans.registry import query
from quillspark.sources.adapters import LINES_SQL, table

PREFIX = ["x", "m", "en", "zh"]
_KEY = "md5('x|m|en|zh|' || text)"


@query("cache_tiers", f"""WITH u AS (SELECT doc_id, {_KEY} AS k, {_KEY} || '|#b' || (n_chars // 2) AS kb, md5('x|m|en|zh|' || '|seg|' || text) AS ks, n_chars // 2 > 0 AS has FROM documents)
SELECT doc_id, CASE WHEN ks IN (SELECT ks FROM u WHERE doc_id % 7 = 0) THEN 0 WHEN has AND kb IN (SELECT kb FROM u WHERE doc_id % 5 = 0 AND has) THEN 1 WHEN k IN (SELECT k FROM u WHERE doc_id % 3 = 0) THEN 2 END::INTEGER AS tier FROM u""")
def cache_tiers(spark, d):
    docs = table(spark, d, "documents")
    k, budget = T.cache_key(*PREFIX, F.col("text")), F.floor(F.col("n_chars") / 2).cast("long")
    rows = docs.select("doc_id", k.alias("k"), caching.budget_key(k, budget).alias("kb"), caching.sentence_key(PREFIX, F.col("text")).alias("ks"))
    stored = lambda c, m: rows.where((F.col("doc_id") % m == 0) & F.col(c).isNotNull()).select(F.col(c).alias("k")).distinct().withColumn("dst", F.col("k"))
    return units.cache_hits(rows, [("ks", stored("ks", 7)), ("kb", stored("kb", 5)), ("k", stored("k", 3))]).select("doc_id", "tier")


_SENT = r"list_transform(list_filter(string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x, ' ')) > 0), lambda x: trim(x, ' '))"


@query("sentence_puts", f"""WITH p AS (SELECT a.conv_id, a.turn, {_SENT.format('u.text')} AS s, {_SENT.format('a.text')} AS t FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1),
x AS (SELECT conv_id, turn, unnest(range(0, len(s))) AS i, unnest(s) AS src, unnest(t) AS dst FROM p WHERE len(s) = len(t) AND len(s) >= 2)
SELECT md5('x|m|en|zh|' || '|seg|' || src) AS k, arg_max(src, (conv_id, turn, i)) AS src, arg_max(dst, (conv_id, turn, i)) AS dst FROM x GROUP BY 1""")
def sentence_puts(spark, d):
    c = table(spark, d, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("src"))
    pairs = c.select("conv_id", "turn", F.col("text").alias("dst")).join(before, ["conv_id", "turn"])
    return caching.sentence_puts(pairs, PREFIX, ["conv_id", "turn"])


@query("cache_put_many", f"SELECT k, arg_max(src, n) AS src, arg_max(dst, n) AS dst FROM (SELECT {_KEY} AS k, lang AS src, source AS dst, doc_id AS n FROM documents) GROUP BY 1")
def cache_put_many(spark, d):
    rows = table(spark, d, "documents").select(T.cache_key(*PREFIX, F.col("text")).alias("k"), F.col("lang").alias("src"), F.col("source").alias("dst"), F.col("doc_id").alias("n"))
    return caching.put_many(rows.where("n % 2 = 1"), rows.where("n % 2 = 0"), ["n"])


@query("legacy_merge", f"SELECT k, arg_min(dst, (o, dst)) AS dst FROM (SELECT {_KEY} AS k, 'item' AS dst, 0 AS o FROM benchmark UNION ALL SELECT {_KEY}, source, 1 FROM documents) GROUP BY 1")
def legacy_merge(spark, d):
    k = T.cache_key(*PREFIX, F.col("text")).alias("k")
    items, docs = table(spark, d, "benchmark").select(k, F.lit("item").alias("dst")), table(spark, d, "documents").select(k, F.col("source").alias("dst"))
    return caching.merge_legacy(docs.where("false"), [items, docs])


@query("schema_migrate", "SELECT event_id, event_type, NULL::VARCHAR AS note, 0 AS tries FROM events")
def schema_migrate(spark, d):
    return caching.with_columns(table(spark, d, "events").select("event_id", "event_type"), {"event_type": ("string", ""), "note": ("string", None), "tries": ("int", 0)})


@query("layout_keys", LINES_SQL + """, g AS (SELECT doc_id, max(pno) + 1 AS total, list_sort(list(DISTINCT pno) FILTER (pno % 2 = 0)) AS sel FROM v GROUP BY 1)
SELECT doc_id, CASE WHEN len(sel) = total THEN md5(text) ELSE md5(text) || '|sel' || array_to_string(sel, ',') END AS doc_key, md5(text) || '|heuristic|v3' AS layout FROM g JOIN documents USING (doc_id)""")
def layout_keys(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("fp"))
    pages = lines_of(spark, d).groupBy("doc_id").agg((F.max("pno") + 1).alias("total"), F.collect_set(F.when(F.col("pno") % 2 == 0, F.col("pno"))).alias("sel"))
    return docs.join(pages, "doc_id").select("doc_id", caching.subset_key(F.col("fp"), F.col("sel"), F.col("total")).alias("doc_key"), caching.layout_key(F.col("fp"), "heuristic", 3).alias("layout"))


@query("render_keys", LINES_SQL + """, p AS (SELECT doc_id, md5(array_to_string(list_sort(list(printf('%.2f,%.2f,%.2f,%.2f', x0, y0, x1, y1) || ':' || text)), '|')) AS payload FROM v GROUP BY 1)
SELECT doc_id, payload, md5(md5(text) || '|' || md5(text) || '|heuristic|v3' || '|' || 'bilingual=False|size=10.5' || '|' || payload) AS render FROM p JOIN documents USING (doc_id)""")
def render_keys(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("fp"))
    payload = lines_of(spark, d).groupBy("doc_id").agg(caching.payload_hash(F.col("bbox"), F.col("text")).alias("payload"))
    key = caching.render_key(F.col("fp"), caching.layout_key(F.col("fp"), "heuristic", 3), {"size": 10.5, "bilingual": False}, F.col("payload"))
    return docs.join(payload, "doc_id").select("doc_id", "payload", key.alias("render"))


@query("rect_codec", LINES_SQL + """SELECT doc_id, pno, pi, '{"__rect__":[' || x0 || ',' || y0 || ',' || x1 || ',' || y1 || ']}' AS encoded, x1 AS back_x1, y1 AS back_y1, false AS other FROM v""")
def rect_codec(spark, d):
    back = caching.decode_rect(F.col("encoded"))
    other = caching.decode_rect(F.concat(F.lit('{"x":1,'), F.expr("substr(encoded, 2)"))).isNotNull()
    lines = lines_of(spark, d).withColumn("encoded", caching.encode_rect(F.col("bbox")))
    return lines.select("doc_id", "pno", "pi", "encoded", back.x1.alias("back_x1"), back.y1.alias("back_y1"), other.alias("other"))


@query("layout_cache_hits", f"SELECT doc_id, CASE WHEN doc_id % 3 <> 1 AND doc_id % 2 = 0 THEN source END AS data FROM documents")
def layout_cache_hits(spark, d):
    docs = table(spark, d, "documents").withColumn("k", caching.layout_key(F.concat_ws(":", F.col("doc_id").cast("string"), F.md5("text")), "heuristic", 3))
    layouts = docs.where("doc_id % 2 = 0").select("k", F.col("source").alias("data"), F.when(F.col("doc_id") % 3 == 1, 9).otherwise(1).alias("pages"))
    return caching.layout_hits(docs.select("doc_id", "k", F.lit(1).alias("pages")), layouts).select("doc_id", "data")


@query("render_blobs", "SELECT page_id, 4 + CAST(strlen(html) AS BIGINT) AS n FROM pages WHERE page_id % 2 = 1")
def render_blobs(spark, d):
    data = F.concat(F.when(F.col("page_id") % 2 == 1, F.lit("%PDF")).otherwise(F.lit("PDF%")), "html").cast("binary")
    return caching.whole_renders(table(spark, d, "pages").select("page_id", data.alias("data"))).select("page_id", F.octet_length("data").cast("long").alias("n"))


@query("forced_groups", LINES_SQL + "SELECT doc_id, pno, pno // 2 AS g, bool_or(pno IN (1, 4)) OVER (PARTITION BY doc_id, pno // 2) AS forced FROM (SELECT DISTINCT doc_id, pno FROM v)")
def forced_groups(spark, d):
    pages = lines_of(spark, d).select("doc_id", "pno").distinct().withColumn("g", F.floor(F.col("pno") / 2).cast("int"))
    return caching.forced_groups(pages, ["doc_id", "g"], F.col("pno").isin(1, 4)).select("doc_id", "pno", "g", "forced")


@query("unit_kinds", LINES_SQL + "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN length(text) % 2 = 1 THEN CASE WHEN regexp_matches(text, '^\\[[0-9]+\\]') THEN 'ref' WHEN length(text) < 30 THEN 'caption' END END AS kind FROM v) GROUP BY 1")
def unit_kinds(spark, d):
    t = F.col("text")
    return lines_of(spark, d).groupBy(caching.unit_kind(t.rlike(T.REFERENCE), F.length(t) < 30, F.length(t) % 2).alias("kind")).agg(F.count("*").alias("n"))


@query("result_offsets", LINES_SQL + "SELECT doc_id, pno, n, CAST(coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY pno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT doc_id, pno, count(*) AS n FROM v GROUP BY 1, 2)")
def result_offsets(spark, d):
    return caching.offsets(lines_of(spark, d).groupBy("doc_id", "pno").agg(F.count("*").alias("n")), ["doc_id"], ["pno"], "n")
