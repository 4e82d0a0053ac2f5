"""Job events: snapshots, replay, warnings and progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot(events: DataFrame, keep: int = 40) -> DataFrame:
    """State of each job: last kind, events, and its latest ``keep`` warnings, oldest first.

    The latest warnings are a limit by group, which each task applies before the exchange; a hot job sends few rows.
    """
    state = events.groupBy("job").agg(F.max_by("kind", "event_id").alias("status"), F.count("*").alias("n_events"))
    w = Window.partitionBy("job").orderBy(F.desc("event_id"))
    last = events.where("kind = 'error'").select("job", "event_id", "msg", F.row_number().over(w).alias("n")).where(F.col("n") <= keep)
    told = last.groupBy("job").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "msg"))), lambda x: x.msg.cast("string")), ",").alias("warnings"))
    return state.join(told, "job", "left").withColumn("warnings", F.coalesce("warnings", F.lit("")))


def replay(events: DataFrame, last: int, ring: int = 1000) -> DataFrame:
    """Events of each job's ring of the newest ``ring``, numbered from 1, after number ``last``.

    Numbers count down from the job's total, so that a limit by group keeps a hot job's exchange at its ring.
    """
    w = Window.partitionBy("job").orderBy(F.desc("event_id"))
    newest = events.withColumn("back", F.row_number().over(w)).where(F.col("back") <= ring)
    total = events.groupBy("job").agg(F.count("*").alias("total"))
    return newest.join(total, "job").withColumn("eid", (F.col("total") - F.col("back") + 1).cast("int")).where(F.col("eid") > last).drop("total", "back")


def first_warnings(events: DataFrame) -> DataFrame:
    return events.where("kind = 'error'").groupBy("job", "msg").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))


def contiguous_prefix(events: DataFrame) -> DataFrame:
    """How far each job's numbers 0, 1, 2, ... are complete."""
    w = Window.partitionBy("job").orderBy("msg")
    x = events.select("job", "msg").distinct().withColumn("rank", F.row_number().over(w) - 1)
    return x.groupBy("job").agg(F.count_if(F.col("rank") == F.col("msg")).alias("done"), F.count("*").alias("n"))


def throttle(events: DataFrame, seconds: int = 7200, slow: tuple[str, ...] = ("view",)) -> DataFrame:
    """Events at which a job's state is persisted: all but the ``slow`` kinds at once, those when ``seconds`` have passed since
    the job was last persisted (at once if it never was).

    The state is one time for each job, carried along the sorted partition: a hot job needs no more memory than a cold one.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select("job", at.alias("at"), "event_id", "kind").repartition("job").sortWithinPartitions("job", "at", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, last = None, None
        for pdf in batches:
            keep = []
            for j, t, kind in zip(pdf["job"], pdf["at"], pdf["kind"], strict=True):
                if j != job:
                    job, last = j, None
                keep.append(kind not in slow or last is None or t - last >= seconds * 1_000_000)
                last = t if keep[-1] else last
            yield pdf.loc[keep, ["event_id", "job"]]

    return rows.mapInPandas(run, "event_id long, job long")


def control_states(commands: DataFrame) -> DataFrame:
    """State of each job after each command (job, event_id, cmd): running, paused, or cancelled for good; others change nothing."""
    w = Window.partitionBy("job").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    cancelled = F.coalesce(F.max(F.col("cmd") == "cancel").over(w), F.lit(False))
    moved = F.last(F.when(F.col("cmd") == "pause", "paused").when(F.col("cmd") == "resume", "running"), True).over(w)
    return commands.withColumn("state", F.when(cancelled, "cancelled").otherwise(F.coalesce(moved, F.lit("running"))))
