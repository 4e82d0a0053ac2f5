"""Queries over call control and the job queue, with events as the calls and commands; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import control
from quillspark.plans.registry import query
from quillspark.plans.unit_queries import _JOBS
from quillspark.sources.adapters import job_events, table

MODELS = "fast,  , fast, large, large, last"
#: Error texts by remainder of the event's number.
ERRORS = ("429 RESOURCE_EXHAUSTED quotaId PerDay", "429 too many, please retry in 12.5s", "{'code': '1302'}", "connection reset", "RESOURCE_EXHAUSTED: limit per day, Retry in 90 s", "429 quotaId PerMinute, retry in 7.25 s")
_ERROR = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{e.replace(chr(39), chr(39) * 2)}'" for i, e in enumerate(ERRORS)) + " END"
_DAILY = "((contains(e, '429') OR contains(e, 'RESOURCE_EXHAUSTED')) AND (contains(e, 'PerDay') OR contains(lower(e), 'per day')))"


def _errors(spark, d):
    return job_events(table(spark, d, "events")).withColumn("e", F.element_at(F.array(*map(F.lit, ERRORS)), (F.col("event_id") % 6 + 1).cast("int")))


@query("error_classes", f"""SELECT event_id, contains(e, '429') OR contains(e, '''code'': ''1302''') OR contains(e, '''code'': ''1305''') AS rate_limited, {_DAILY} AS daily_quota,
CASE WHEN regexp_extract(e, '[Rr]etry in\\s+([\\d.]+)\\s*s', 1) <> '' THEN least(TRY_CAST(regexp_extract(e, '[Rr]etry in\\s+([\\d.]+)\\s*s', 1) AS DOUBLE) + 1, 60) END AS delay FROM (SELECT event_id, {_ERROR} AS e FROM {_JOBS} WHERE kind = 'error')""")
def error_classes(spark, d):
    e = F.col("e")
    return _errors(spark, d).where("kind = 'error'").select("event_id", control.rate_limited(e).alias("rate_limited"), control.daily_quota(e).alias("daily_quota"), control.retry_delay(e, 60.0).alias("delay"))


@query("call_cap", f"""SELECT job, event_id, coalesce(sum(CASE WHEN kind <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 2 < 10 AS started FROM {_JOBS}""")
def call_cap(spark, d):
    return control.capped_calls(job_events(table(spark, d, "events")), ["job"], ["event_id"], F.col("kind") != "error", 10, 2).select("job", "event_id", "started")


@query("fallback_models", f"""SELECT job, event_id, ['base', 'fast', 'large', 'last'][CAST(least(coalesce(sum(CASE WHEN kind = 'error' AND {_DAILY} THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) + 1 AS BIGINT)] AS model
FROM (SELECT *, {_ERROR} AS e FROM {_JOBS})""")
def fallback_models(spark, d):
    failed = (F.col("kind") == "error") & control.daily_quota(F.col("e"))
    return control.fallback_models(_errors(spark, d), ["job"], ["event_id"], failed, control.fallback_chain("base", MODELS)).select("job", "event_id", "model")


@query("budget_reask", """WITH p AS (SELECT a.conv_id, a.turn, u.text AS src, a.text AS dst, 150 AS budget FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user' WHERE a.role = 'assistant'),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM p WHERE length(dst) > budget * 1.15 AND length(src) <= budget * 1.15),
r AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN dst || 'x' WHEN conv_id % 3 = 1 THEN substr(dst, 1, 100) || '[FORMULA_9]' ELSE substr(dst, 1, 150) END AS reply FROM c WHERE n <= 2)
SELECT conv_id, turn, md5(CASE WHEN length(reply) < length(dst) AND list_sort(regexp_extract_all(reply, '\\[FORMULA_(\\d+)\\]', 1)) = list_sort(regexp_extract_all(src, '\\[FORMULA_(\\d+)\\]', 1)) THEN reply ELSE dst END) AS dst_md5, reply IS NOT NULL AS reasked
FROM p LEFT JOIN r USING (conv_id, turn)""")
def budget_reask(spark, d):
    """A scripted second reply: longer, with a foreign mark, or cut, by remainder of the conversation."""
    c = table(spark, d, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("dst"))
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("src"))
    pairs = a.join(u, ["conv_id", "turn"]).withColumn("budget", F.lit(150))
    cut = lambda n: F.substr("dst", F.lit(1), F.lit(n))
    reply = F.when(F.col("conv_id") % 3 == 0, F.concat("dst", F.lit("x"))).when(F.col("conv_id") % 3 == 1, F.concat(cut(100), F.lit("[FORMULA_9]"))).otherwise(cut(150))
    out = control.reask_over_budget(pairs, ["conv_id"], "turn", lambda x: x.withColumn("reply", reply), 20)
    return out.select("conv_id", "turn", F.md5("dst").alias("dst_md5"), "reasked")


_CMD = "CASE WHEN kind = 'purchase' THEN 'finish' WHEN kind = 'error' THEN 'cancel' WHEN kind IN ('view', 'click') THEN 'submit' ELSE 'other' END"


@query("job_queue", f"""WITH e AS (SELECT job, event_id, {_CMD} AS cmd, row_number() OVER (PARTITION BY job ORDER BY event_id) AS s FROM {_JOBS}),
w AS (WITH RECURSIVE g AS (
  SELECT job, s, event_id, cmd, cmd = 'submit' AS running, 0 AS waiting, CASE WHEN cmd = 'submit' THEN 'started' ELSE 'ignored' END AS outcome FROM e WHERE s = 1
  UNION ALL
  SELECT e.job, e.s, e.event_id, e.cmd,
    CASE WHEN e.cmd = 'submit' THEN true WHEN e.cmd = 'finish' AND g.running THEN g.waiting > 0 ELSE g.running END,
    CASE WHEN e.cmd = 'submit' AND g.running AND g.waiting < 5 THEN g.waiting + 1 WHEN (e.cmd = 'finish' AND g.running) OR e.cmd = 'cancel' THEN greatest(0, g.waiting - 1) ELSE g.waiting END,
    CASE WHEN e.cmd = 'submit' THEN CASE WHEN NOT g.running THEN 'started' WHEN g.waiting < 5 THEN 'queued' ELSE 'rejected' END WHEN e.cmd = 'finish' AND g.running THEN CASE WHEN g.waiting > 0 THEN 'next' ELSE 'idle' END WHEN e.cmd = 'cancel' AND g.waiting > 0 THEN 'cancelled' ELSE 'ignored' END
  FROM g JOIN e ON e.job = g.job AND e.s = g.s + 1
) SELECT * FROM g) SELECT job, event_id, cmd, outcome, CAST(waiting AS INTEGER) AS waiting FROM w""")
def job_queue(spark, d):
    k = F.col("kind")
    cmd = F.when(k == "purchase", "finish").when(k == "error", "cancel").when(k.isin("view", "click"), "submit").otherwise("other")
    return control.waiting_jobs(job_events(table(spark, d, "events")).withColumn("cmd", cmd), "job", ["event_id"])


@query("unfinished_jobs", "SELECT job, seq, created FROM (SELECT user_id AS job, CASE WHEN user_id % 3 > 0 THEN user_id % 7 END AS seq, min(ts) AS created FROM events GROUP BY 1, 2) ORDER BY seq IS NULL, seq, created, job LIMIT 50")
def unfinished_jobs(spark, d):
    jobs = table(spark, d, "events").groupBy(F.col("user_id").alias("job")).agg(F.min("ts").alias("created")).withColumn("seq", F.when(F.col("job") % 3 > 0, F.col("job") % 7))
    return jobs.orderBy(*control.restored_order(jobs)).limit(50).select("job", "seq", "created")


@query("heartbeats", f"SELECT job, event_id, CAST(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY job ORDER BY ts, event_id))) // 15000000, 0) AS BIGINT) AS beats FROM {_JOBS}")
def heartbeats(spark, d):
    return control.heartbeats(job_events(table(spark, d, "events"))).select("job", "event_id", "beats")


_SUBS = f"(SELECT job, unnest([0, 1]) AS subscriber, unnest([min(event_id), min(event_id) + 5000]) AS since, unnest([min(event_id) + 2000, NULL]) AS until FROM {_JOBS} GROUP BY job)"


@query("fan_out", f"SELECT job, subscriber, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM {_JOBS} JOIN {_SUBS} USING (job) WHERE event_id >= since AND event_id <= coalesce(until, event_id) GROUP BY 1, 2")
def fan_out(spark, d):
    e = job_events(table(spark, d, "events"))
    low = e.groupBy("job").agg(F.min("event_id").alias("m"))
    none = F.lit(None).cast("long")
    subs = low.select("job", F.inline(F.array(F.struct(F.lit(0).alias("subscriber"), F.col("m").alias("since"), (F.col("m") + 2000).alias("until")), F.struct(F.lit(1).alias("subscriber"), (F.col("m") + 5000).alias("since"), none.alias("until")))))
    return control.fan_out(e, subs).groupBy("job", "subscriber").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("command_drain", f"""SELECT job, event_id, cmd, applied_at, cmd IN ('pause', 'resume', 'cancel') AS known FROM (SELECT *, CASE kind WHEN 'click' THEN 'pause' WHEN 'signup' THEN 'resume' WHEN 'error' THEN 'shout' END AS cmd,
min(CASE WHEN kind = 'view' THEN event_id END) OVER (PARTITION BY job ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS applied_at FROM {_JOBS}) WHERE cmd IS NOT NULL""")
def command_drain(spark, d):
    k = F.col("kind")
    cmd = F.when(k == "click", "pause").when(k == "signup", "resume").when(k == "error", "shout")
    return control.drained_at(job_events(table(spark, d, "events")), cmd, k == "view", ["pause", "resume", "cancel"]).select("job", "event_id", "cmd", "applied_at", "known")


@query("carried_stage", f"SELECT job, event_id, last_value(CASE WHEN kind IN ('signup', 'purchase') THEN kind END IGNORE NULLS) OVER (PARTITION BY job ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS stage FROM {_JOBS}")
def carried_stage(spark, d):
    k = F.col("kind")
    return control.carried_stage(job_events(table(spark, d, "events")), F.when(k.isin("signup", "purchase"), k)).select("job", "event_id", "stage")


@query("stage_profile", "SELECT event_type AS stage, round(sum(value), 4) AS seconds, count(*) AS calls, round(sum(value) * 1000 / count(*), 3) AS ms_per_call FROM events GROUP BY 1")
def stage_profile(spark, d):
    return control.stage_profile(table(spark, d, "events").withColumnRenamed("event_type", "stage"), "stage", "value")


@query("call_counters", f"SELECT job, count(*) FILTER (k <> 'hit') AS calls_used, count(*) FILTER (k = 'ok') AS api_ok_calls, count(*) FILTER (k = 'hit') AS cache_hits, count(*) FILTER (k = 'failed') AS failed FROM (SELECT job, CASE kind WHEN 'error' THEN 'failed' WHEN 'view' THEN 'hit' ELSE 'ok' END AS k FROM {_JOBS}) GROUP BY 1")
def call_counters(spark, d):
    k = F.when(F.col("kind") == "error", "failed").when(F.col("kind") == "view", "hit").otherwise("ok")
    return control.call_counters(job_events(table(spark, d, "events")).withColumn("kind", k), ["job"])


@query("action_gate", f"SELECT kind, count(*) FILTER (kind IN ('click', 'signup', 'error')) AS allowed, count(*) AS n FROM {_JOBS} GROUP BY 1")
def action_gate(spark, d):
    return control.allowed_actions(job_events(table(spark, d, "events")), "kind", ("click", "signup", "error"))


@query("replies_complete", "SELECT conv_id, turn, list_has_all(['1', '3', '2'][1:conv_id % 4], ['1', '2', '3'][1:turn % 3 + 1]) AS complete FROM conversations")
def replies_complete(spark, d):
    ids = lambda *x: F.array(*map(F.lit, x))
    got, wanted = F.slice(ids("1", "3", "2"), F.lit(1), (F.col("conv_id") % 4).cast("int")), F.slice(ids("1", "2", "3"), F.lit(1), (F.col("turn") % 3 + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", control.complete(got, wanted).alias("complete"))


@query("unit_pages", "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'to ' || length(text) ELSE md5(text) END AS dst FROM conversations")
def unit_pages(spark, d):
    places = table(spark, d, "conversations").select(F.col("conv_id").alias("pno"), F.col("turn").alias("i"), F.md5("text").alias("text"), F.length("text").alias("n"))
    results = places.where("(pno + i) % 3 = 0").select("pno", "i", F.concat(F.lit("to "), F.col("n").cast("string")).alias("dst"))
    return control.unit_pages(results, places).select(F.col("pno").alias("conv_id"), F.col("i").alias("turn"), "dst")


@query("event_times", f"SELECT job, event_id, round(epoch_us(ts) / 1000000, 3) AS seconds, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY job)) / 1000000, 1) AS elapsed FROM {_JOBS}")
def event_times(spark, d):
    return control.event_times(job_events(table(spark, d, "events"))).select("job", "event_id", "seconds", "elapsed")
