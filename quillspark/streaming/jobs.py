"""Streaming forms of the job operators; each takes and returns a streaming (or batch) DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def warnings_once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first warning of each job and message; state is dropped behind the watermark."""
    return events.where("kind = 'error'").withWatermark("ts", late).dropDuplicatesWithinWatermark(["job", "msg"])


def windowed(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and values of each kind in tumbling windows."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "kind", "n", "total")


def parse_jsonl(lines: DataFrame, schema: str = "t double, kind string, stage string, msg string") -> DataFrame:
    """Events of a text stream of JSON lines; lines that don't parse are left out."""
    return lines.select(F.from_json("value", schema).alias("e")).where("e.kind is not null").select("e.*")
