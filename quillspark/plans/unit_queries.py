"""Queries over caches, unit queues and job events, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import calls, jobs, units
from quillspark.plans.registry import query
from quillspark.sources.adapters import job_events, table

_JOBS = "(SELECT event_id, ts, user_id AS job, event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS msg, value FROM events)"


@query("cache_keys_hits", """WITH c AS (SELECT DISTINCT md5('x|m|en|zh|' || text) AS k FROM benchmark),
u AS (SELECT doc_id, md5('x|m|en|zh|' || text) AS k FROM documents UNION ALL SELECT -1 - item_id, md5('x|m|en|zh|' || text) FROM benchmark)
SELECT u.doc_id, u.k, c.k IS NOT NULL AS hit FROM u LEFT JOIN c ON u.k = c.k""")
def cache_keys_hits(spark, d):
    key = T.cache_key("x", "m", "en", "zh", F.col("text"))
    bench = table(spark, d, "benchmark")
    cache = bench.select(key.alias("k")).distinct().withColumn("dst", F.col("k"))
    rows = table(spark, d, "documents").select("doc_id", key.alias("k")).union(bench.select(-1 - F.col("item_id"), key))
    return units.cache_hits(rows, [("k", cache)]).select("doc_id", "k", F.col("tier").isNotNull().alias("hit"))


@query("duplicate_blocks", "SELECT md5(text) AS k, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_blocks(spark, d):
    rows = table(spark, d, "documents").select(F.md5("text").alias("k"), "doc_id")
    return units.unique_units(rows, "k", ["doc_id"]).where("n > 1").select("k", F.col("first.doc_id").alias("first"), "n")


@query("sentence_cache_full_hit", r"""WITH s AS (SELECT conv_id, turn, unnest(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x, ' ')) > 0)) AS seg FROM conversations),
c AS (SELECT DISTINCT md5('seg|' || seg) AS k FROM s WHERE turn % 2 = 0)
SELECT conv_id, turn, count(*) AS n, count(c.k) AS hits, count(*) = count(c.k) AND count(*) >= 2 AS full_hit FROM s LEFT JOIN c ON md5('seg|' || seg) = c.k GROUP BY 1, 2""")
def sentence_cache_full_hit(spark, d):
    s = table(spark, d, "conversations").select("conv_id", "turn", F.explode(T.sentences(F.col("text"))).alias("seg")).withColumn("k", T.cache_key("seg", F.col("seg")))
    cache = s.where("turn % 2 = 0").select("k").distinct().withColumn("hit", F.lit(True))
    n, hits = F.count("*"), F.count("hit")
    return s.join(cache, "k", "left").groupBy("conv_id", "turn").agg(n.alias("n"), hits.alias("hits"), ((n == hits) & (n >= 2)).alias("full_hit"))


@query("cache_retention_count", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 100")
def cache_retention_count(spark, d):
    return units.keep_newest(table(spark, d, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.desc("doc_id")], 100)


@query("cache_retention_bytes", """SELECT page_id, h, n FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY h ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY h) - 20000 AS over
FROM (SELECT page_id, page_id % 16 AS h, CAST(strlen(html) AS BIGINT) AS n FROM pages)) WHERE before < over""")
def cache_retention_bytes(spark, d):
    rows = table(spark, d, "pages").select("page_id", (F.col("page_id") % 16).alias("h"), F.octet_length("html").cast("long").alias("n"))
    return units.over_bytes(rows, ["h"], F.col("n"), ["page_id"], 20_000)


@query("upsert_latest", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def upsert_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return units.upsert_latest(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], ["event_id"])


@query("unit_queue_union", """SELECT kind, count(*) AS n, sum(length(text))::BIGINT AS chars, count(DISTINCT md5(text)) AS keys FROM (SELECT 'para' AS kind, text FROM documents UNION ALL SELECT 'turn', text FROM conversations UNION ALL SELECT 'item', text FROM benchmark) GROUP BY 1""")
def unit_queue_union(spark, d):
    parts = [table(spark, d, t).select(F.lit(k).alias("kind"), "text") for k, t in (("para", "documents"), ("turn", "conversations"), ("item", "benchmark"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count_distinct(F.md5("text")).alias("keys"))


@query("over_budget_candidates", """WITH p AS (SELECT a.conv_id, a.turn, length(u.text) AS src, length(a.text) AS dst FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user' WHERE a.role = 'assistant')
SELECT conv_id, turn, src, dst, 400 AS budget FROM p WHERE dst > 1.15 * 400 AND src <= 1.15 * 400""")
def over_budget_candidates(spark, d):
    c = table(spark, d, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.length("text").cast("long").alias("dst"))
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.length("text").cast("long").alias("src"))
    return a.join(u, ["conv_id", "turn"]).withColumn("budget", F.lit(400)).where(units.over_budget(F.col("src"), F.col("dst"), F.col("budget"))).select("conv_id", "turn", "src", "dst", "budget")


@query("job_snapshot", f"""SELECT job, arg_max(kind, event_id) AS status, count(*) AS n_events, coalesce(array_to_string(list_reverse(list_slice(list(msg ORDER BY event_id DESC) FILTER (kind = 'error'), 1, 40)), ','), '') AS warnings FROM {_JOBS} GROUP BY 1""")
def job_snapshot(spark, d):
    return jobs.snapshot(job_events(table(spark, d, "events")))


@query("event_replay", f"SELECT job, eid, event_id, kind FROM (SELECT *, CAST(row_number() OVER (PARTITION BY job ORDER BY event_id) AS INTEGER) AS eid, count(*) OVER (PARTITION BY job) AS n FROM {_JOBS}) WHERE eid > 10 AND eid > n - 1000")
def event_replay(spark, d):
    return jobs.replay(job_events(table(spark, d, "events")), 10).select("job", "eid", "event_id", "kind")


@query("warning_dedup", f"SELECT job, msg, min(event_id) AS event_id, count(*) AS n FROM {_JOBS} WHERE kind = 'error' GROUP BY 1, 2")
def warning_dedup(spark, d):
    return jobs.first_warnings(job_events(table(spark, d, "events")))


@query("progress_throttle", f"""WITH e AS (SELECT job, event_id, kind, epoch_us(ts) AS t, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS s FROM {_JOBS}),
w AS (WITH RECURSIVE g AS (
  SELECT job, s, event_id, t AS last, true AS kept FROM e WHERE s = 1
  UNION ALL
  SELECT e.job, e.s, e.event_id, CASE WHEN e.kind <> 'view' OR e.t - g.last >= 7200000000 THEN e.t ELSE g.last END, e.kind <> 'view' OR e.t - g.last >= 7200000000 FROM g JOIN e ON e.job = g.job AND e.s = g.s + 1
) SELECT * FROM g) SELECT event_id, job FROM w WHERE kept""")
def progress_throttle(spark, d):
    return jobs.throttle(job_events(table(spark, d, "events")))


@query("job_control", f"""SELECT job, event_id, CASE WHEN bool_or(kind = 'error' AND msg >= 95) OVER w THEN 'cancelled' ELSE coalesce(last_value(CASE kind WHEN 'click' THEN 'paused' WHEN 'signup' THEN 'running' END IGNORE NULLS) OVER w, 'running') END AS state
FROM {_JOBS} WINDOW w AS (PARTITION BY job ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def job_control(spark, d):
    cmd = F.when((F.col("kind") == "error") & (F.col("msg") >= 95), "cancel").when(F.col("kind") == "click", "pause").when(F.col("kind") == "signup", "resume")
    return jobs.control_states(job_events(table(spark, d, "events")).withColumn("cmd", cmd)).select("job", "event_id", "state")


@query("unit_results", """SELECT doc_id, CASE WHEN t IS NULL OR doc_id % 5 = 4 THEN text ELSE '【译】' || t END AS dst, CASE WHEN t IS NOT NULL AND doc_id % 5 < 4 THEN greatest(doc_id % 5, 1)::INTEGER END AS attempt
FROM (SELECT doc_id, text, substr(text, 1, 20) || (SELECT coalesce(string_agg('[FORMULA_' || x || ']', ''), '') FROM (SELECT unnest(regexp_extract_all(text, '\\[FORMULA_(\\d+)\\]', 1)) AS x)) AS t FROM documents)""")
def unit_results(spark, d):
    """A scripted external call: ids with remainder 2 and 3 answer late, 4 never, and early replies to 2 lose a mark."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")

    def ask(units, attempt):
        marks = F.array_join(F.transform(T.placeholders(F.col("text")), lambda x: F.concat(F.lit("[FORMULA_"), x, F.lit("]"))), "")
        reply = F.concat(F.lit("【译】"), F.substr("text", F.lit(1), F.lit(20)), marks)
        wrong = (F.col("id") % 5 == 2) & (F.lit(attempt) < 2)
        return units.where((F.col("id") % 5 <= attempt) | wrong).select("id", F.when(wrong, F.concat(reply, F.lit("[FORMULA_0]"))).otherwise(reply).alias("dst"))

    return calls.ask_until_valid(docs, ask).withColumnRenamed("id", "doc_id")


@query("contiguous_prefix", f"SELECT job, count(*) FILTER (r = msg) AS done, count(*) AS n FROM (SELECT job, msg, row_number() OVER (PARTITION BY job ORDER BY msg) - 1 AS r FROM (SELECT DISTINCT job, msg FROM {_JOBS})) GROUP BY 1")
def contiguous_prefix(spark, d):
    return jobs.contiguous_prefix(job_events(table(spark, d, "events")))


@query("job_history_topk", "SELECT user_id, max(ts) AS updated, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def job_history_topk(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("updated"), F.count("*").alias("n")).orderBy(F.desc("updated"), "user_id").limit(20)


LANGS = [("zh", "cjk", False), ("en", "latin", False), ("ja", "cjk", False), ("ko", "cjk", False), ("fr", "latin", False), ("de", "latin", False), ("es", "latin", False), ("ru", "cyrillic", False), ("ar", "arabic", True), ("he", "hebrew", True)]


@query("lang_registry_join", "SELECT doc_id, coalesce(script, 'cjk') AS script, coalesce(rtl, false) AS rtl, upper(lang[1]) || lang[2:] AS tag FROM documents LEFT JOIN (VALUES " + ", ".join(f"('{c}', '{s}', {str(r).lower()})" for c, s, r in LANGS) + ") l(code, script, rtl) ON lang = code")
def lang_registry_join(spark, d):
    return units.with_language(table(spark, d, "documents").select("doc_id", "lang"), spark.createDataFrame(LANGS, "code string, script string, rtl boolean")).drop("lang")


@query("backoff_schedule", "SELECT CAST(a AS BIGINT) AS attempt, least(2 * pow(2, a - 1), 60)::DOUBLE AS delay FROM range(1, 9) t(a)")
def backoff_schedule(spark, d):
    return spark.range(1, 9).select(F.col("id").alias("attempt"), F.least(2 * F.pow(F.lit(2.0), F.col("id") - 1), F.lit(60.0)).alias("delay"))


@query("cache_saved_calls", "SELECT source, CAST(count(*) - count(DISTINCT md5(text)) AS BIGINT) AS hits, CAST(ceil((count(*) - count(DISTINCT md5(text))) / 6.0) AS BIGINT) AS saved FROM documents GROUP BY 1")
def cache_saved_calls(spark, d):
    return units.saved_calls(table(spark, d, "documents").withColumn("k", F.md5("text")), ["source"], "k", 6)


@query("events_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    g = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("events_session", """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN g IS NULL OR g >= 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS g FROM events)) GROUP BY user_id, s""")
def events_session(spark, d):
    g = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")
