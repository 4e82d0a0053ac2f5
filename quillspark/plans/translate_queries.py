"""The course of a translation over documents, with a scripted reply, and its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.plans.layout_queries import lines_of
from quillspark.plans.registry import query
from quillspark.sources.adapters import LINES_SQL
from quillspark.sources.files import Settings
from quillspark.translate import translate_units

SETTINGS = Settings(provider="m", batch_size=1, batch_chars=0, max_calls=30)
_COURSE = LINES_SQL + """, u AS (SELECT doc_id AS doc, pno * 24 + pi AS i, text, md5('x|m|en|zh|' || text) AS k FROM v), c AS (SELECT DISTINCT k FROM u WHERE doc % 3 = 0 AND i % 2 = 0),
o AS (SELECT doc, k, min(i) AS f FROM u WHERE k NOT IN (SELECT k FROM c) GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY f) - 1 AS batch FROM o),
r AS (SELECT u.*, c.k IS NOT NULL AS hit, batch < 30 AND length(text) % 5 < 4 AS valid FROM u LEFT JOIN c USING (k) LEFT JOIN b USING (doc, k)),
a AS (SELECT *, CASE WHEN hit THEN 'cache' WHEN valid THEN 'call' ELSE 'source' END AS origin, CASE WHEN hit THEN 'c' || k WHEN valid THEN 'to ' || text ELSE text END AS dst FROM r)
"""


def _course(spark, d):
    """A cache of lines of every third document; replies to texts whose length has remainder 4 lose a mark each time, and the rest come at the second attempt or the first."""
    rows = lines_of(spark, d).select(F.col("doc_id").alias("doc"), (F.col("pno") * 24 + F.col("pi")).alias("i"), "text")
    k = T.cache_key("x", "m", "en", "zh", F.col("text"))
    cache = rows.where("doc % 3 = 0 and i % 2 = 0").select(k.alias("k")).distinct().withColumn("dst", F.concat(F.lit("c"), "k"))

    def ask(pending, attempt):
        r = F.length("text") % 5
        reply = F.concat(F.lit("to "), "text")
        return pending.where((r != 1) | (F.lit(attempt) > 1)).select("id", F.when(r == 4, F.concat(reply, F.lit("[FORMULA_1]"))).otherwise(reply).alias("dst"))

    return translate_units(rows, cache, ask, SETTINGS)


@query("translated_units", _COURSE + "SELECT doc, i, md5(dst) AS dst, origin FROM a")
def translated_units(spark, d):
    return _course(spark, d).results.select("doc", "i", F.md5("dst").alias("dst"), "origin")


@query("translation_counters", _COURSE + ", s AS (SELECT doc, count(*) AS asked, count(*) AS batches FROM b WHERE batch < 30 GROUP BY 1) SELECT doc, count(*) AS units, count(*) FILTER (origin = 'cache') AS cache_hits, count(*) FILTER (origin = 'source') AS kept, coalesce(any_value(asked), 0) AS asked, coalesce(any_value(batches), 0) AS batches FROM a LEFT JOIN s USING (doc) GROUP BY 1")
def translation_counters(spark, d):
    return _course(spark, d).counters


@query("translation_cache_rows", _COURSE + "SELECT k, arg_max(md5(text), doc) AS src, arg_max(md5(dst), doc) AS dst FROM a WHERE origin = 'call' GROUP BY 1")
def translation_cache_rows(spark, d):
    return _course(spark, d).cache.select("k", F.md5("src").alias("src"), F.md5("dst").alias("dst"))
