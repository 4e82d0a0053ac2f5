"""Sources: documents as page lines with geometry, HTML pages as blocks and links, events as job events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.geom import rect

PAGE_W, PAGE_H, LINES = 612.0, 842.0, 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_lines(docs: DataFrame) -> DataFrame:
    """Lines of text on pages of 24, (doc_id, pno, pi, text, col, two, size, bbox); blank lines are left out."""
    lines = docs.select("doc_id", F.posexplode(F.filter(F.split("text", "\n", -1), lambda x: F.length(F.trim(x)) > 0)).alias("i", "text"))
    i, two = F.col("i"), F.pmod("doc_id", F.lit(2)) == 0
    r = i % LINES
    col, q = F.when(two, F.floor(r / 12)).otherwise(0), F.when(two, r % 12).otherwise(r)
    y0 = F.when(two, 40 + 69 * q - F.when(q % 3 == 1, 50).otherwise(0)).otherwise(40 + 33 * q - F.when(q % 3 == 1, 12).otherwise(0))
    x0 = 54 + 264 * col
    x1 = x0 + F.least(5 * F.length("text"), F.when(two, 228).otherwise(504))
    size = F.when(i == 0, 16.0).when(i % 7 == 3, 8.0).otherwise(10.0)
    return lines.select("doc_id", F.floor(i / LINES).cast("int").alias("pno"), r.cast("int").alias("pi"), "text", col.cast("int").alias("col"), two.alias("two"), size.alias("size"), rect(x0, y0, x1, y0 + 12).alias("bbox"))


#: The same lines in DuckDB, as WITH clauses.
LINES_SQL = """
WITH sp AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ')) > 0) AS ls FROM documents),
l0 AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS text, doc_id % 2 = 0 AS two FROM sp),
l1 AS (SELECT *, i % 24 AS r, CASE WHEN two THEN (i % 24) // 12 ELSE 0 END AS col, CASE WHEN two THEN (i % 24) % 12 ELSE i % 24 END AS q FROM l0),
l2 AS (SELECT *, CASE WHEN two THEN 40 + 69 * q - (CASE WHEN q % 3 = 1 THEN 50 ELSE 0 END) ELSE 40 + 33 * q - (CASE WHEN q % 3 = 1 THEN 12 ELSE 0 END) END AS y, 54 + 264 * col AS x FROM l1),
v AS (SELECT doc_id, CAST(i // 24 AS INTEGER) AS pno, CAST(r AS INTEGER) AS pi, text, CAST(col AS INTEGER) AS col, two,
  CASE WHEN i = 0 THEN 16.0::DOUBLE WHEN i % 7 = 3 THEN 8.0::DOUBLE ELSE 10.0::DOUBLE END AS size,
  x::DOUBLE AS x0, y::DOUBLE AS y0, (x + least(5 * length(text), CASE WHEN two THEN 228 ELSE 504 END))::DOUBLE AS x1, (y + 12)::DOUBLE AS y1 FROM l2)
"""


def without_boilerplate(html: Column) -> Column:
    """HTML without scripts, styles, comments, navigation, footers and advertisements."""
    return F.regexp_replace(html, r'(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<nav.*?</nav>|<footer.*?</footer>|<div class="ad">.*?</div>', "")


def page_links(pages: DataFrame) -> DataFrame:
    """Links of raw HTML in order: (page_id, ord, href); scripts, styles and comments are left out first."""
    html = F.regexp_replace("html", r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    return pages.select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("ord", "href"))


def job_events(events: DataFrame) -> DataFrame:
    """The events table as a job's event stream: (event_id, ts, job, kind, msg)."""
    return events.select("event_id", "ts", F.col("user_id").alias("job"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("bigint").alias("msg"), "value")
