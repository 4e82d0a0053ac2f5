"""Control of external calls and of the job queue: error classes, caps, fallback models, re-asking, waiting jobs, heartbeats."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.units import over_budget
from quillspark.session import stored

#: What a provider's error text holds where calls come too fast.
RATE_CODES = ("429", "'code': '1302'", "'code': '1305'")


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(text, F.lit(p))
    return found


def rate_limited(error: Column) -> Column:
    return any_of(error, RATE_CODES)


def daily_quota(error: Column) -> Column:
    """The day's quota is used up: another model may go on, waiting does not help."""
    return any_of(error, ("429", "RESOURCE_EXHAUSTED")) & (F.contains(error, F.lit("PerDay")) | F.contains(F.lower(error), F.lit("per day")))


def retry_delay(error: Column, cap: float) -> Column:
    """Seconds to wait that the error asks for, and one more, at most ``cap``; null where it asks for none."""
    asked = F.regexp_extract(error, r"[Rr]etry in\s+([\d.]+)\s*s", 1)
    return F.least(F.nullif(asked, F.lit("")).try_cast("double") + 1.0, F.when(asked != "", F.lit(cap)))


def capped_calls(calls: DataFrame, keys: list[str], order: list[str], ok: Column, cap: int, in_flight: int = 0) -> DataFrame:
    """``calls`` with ``started``: whether fewer than ``cap`` calls before it succeeded, ``in_flight`` of them held back for those under way.

    Failed calls do not count. A window over each key's own calls.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(ok, 1).otherwise(0)).over(w), F.lit(0))
    return calls.withColumn("started", before + in_flight < cap)


def fallback_chain(first: str, chain: str) -> list[str]:
    """Models in the order in which they are used: blanks and the model that is in use at the time are skipped."""
    models = [first]
    for name in map(str.strip, chain.split(",")):
        if name and name != models[-1]:
            models.append(name)
    return models


def fallback_models(calls: DataFrame, keys: list[str], order: list[str], failed: Column, models: list[str]) -> DataFrame:
    """``calls`` with ``model``: each call whose error is a used-up daily quota moves the later ones on, until the last model."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    moves = F.coalesce(F.sum(F.when(failed, 1).otherwise(0)).over(w), F.lit(0)).cast("int")
    return calls.withColumn("model", F.element_at(F.array(*map(F.lit, models)), F.least(moves, F.lit(len(models) - 1)) + 1))


def reask_over_budget(units: DataFrame, keys: list[str], order: str, ask: Callable[[DataFrame], DataFrame], max_calls: int) -> DataFrame:
    """``units`` (keys, order, src, dst, budget) with ``dst`` shortened where a second reply is, and ``reasked``.

    Asked again are the first max(1, max_calls div 10) units of each key whose result is over 1.15 budgets although the
    source is not. ``ask`` takes them and returns (keys, order, reply); a reply counts if it is shorter and keeps the
    [FORMULA_n] marks. Replies are stored once, so a lost executor repeats no call.
    """
    over = (F.col("budget") > 0) & F.col("dst").isNotNull() & over_budget(F.length("src"), F.length("dst"), F.col("budget"))
    first = Window.partitionBy(*keys).orderBy(order)
    chosen = units.where(over).withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= max(1, max_calls // 10)).drop("__n")
    replies = stored(ask(chosen).select(*keys, order, "reply"))
    out = units.join(replies.withColumn("reasked", F.lit(True)), [*keys, order], "left")
    better = (F.length("reply") < F.length("dst")) & (T.placeholders(F.col("reply")) == T.placeholders(F.col("src")))
    return out.withColumn("dst", F.when(better, F.col("reply")).otherwise(F.col("dst"))).withColumn("reasked", F.coalesce("reasked", F.lit(False))).drop("reply")


def waiting_jobs(commands: DataFrame, manager: str, order: list[str], room: int = 5) -> DataFrame:
    """What each command (submit, finish, cancel) of a manager's queue does: (manager, order, cmd, outcome, waiting).

    One job runs and ``room`` wait, first in first out. submit: started, queued or rejected; finish: the next one starts
    (next) or none is left (idle); cancel takes the oldest waiting job out (cancelled). Anything else, and what has no job
    to work on, is ignored. The state is two numbers a manager, carried along the sorted partition.
    """
    rows = commands.select(manager, *order, "cmd").repartition(manager).sortWithinPartitions(manager, *order)
    kinds = ", ".join(f"{c} {commands.schema[c].dataType.simpleString()}" for c in (manager, *order))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        present, running, waiting = None, False, 0
        for pdf in batches:
            outcomes, left = [], []
            for name, cmd in zip(pdf[manager], pdf["cmd"], strict=True):
                if name != present:
                    present, running, waiting = name, False, 0
                said = "ignored"
                if cmd == "submit":
                    said = "queued" if running and waiting < room else "rejected" if running else "started"
                    waiting, running = waiting + (said == "queued"), True
                elif cmd == "finish" and running:
                    said = "next" if waiting else "idle"
                    running, waiting = waiting > 0, max(0, waiting - 1)
                elif cmd == "cancel" and waiting:
                    said, waiting = "cancelled", waiting - 1
                outcomes.append(said)
                left.append(waiting)
            yield pdf.assign(outcome=outcomes, waiting=left)

    return rows.mapInPandas(run, f"{kinds}, cmd string, outcome string, waiting int")


def restored_order(jobs: DataFrame) -> list[Column]:
    """Order in which unfinished jobs (seq, created, job) are taken up again: queued ones by number, then the others by age."""
    return [F.asc_nulls_last("seq"), F.asc("created"), F.asc("job")]


def heartbeats(events: DataFrame, seconds: int = 15) -> DataFrame:
    """Signs of life sent while each event was waited for, one every ``seconds`` since the job's last event."""
    w = Window.partitionBy("job").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at - F.lag(at).over(w)
    return events.withColumn("beats", F.coalesce(F.floor(gap / (seconds * 1_000_000)), F.lit(0)).cast("long"))


def fan_out(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """A row for each event and subscriber (job, subscriber, since, until) of its job; after ``until`` a subscriber is gone."""
    return events.join(subscribers, "job").where((F.col("event_id") >= F.col("since")) & (F.col("event_id") <= F.coalesce("until", F.col("event_id"))))


def drained_at(events: DataFrame, command: Column, checkpoint: Column, known: list[str]) -> DataFrame:
    """Commands of the events with the checkpoint that applies them (the job's next one; null: none yet) and whether they are known."""
    w = Window.partitionBy("job").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    out = events.withColumn("cmd", command).withColumn("applied_at", F.first(F.when(checkpoint, F.col("event_id")), True).over(w))
    return out.where("cmd is not null").withColumn("known", F.col("cmd").isin(*known))


def carried_stage(events: DataFrame, stage: Column) -> DataFrame:
    """Events with the label of the job's latest stage event, their own included."""
    w = Window.partitionBy("job").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("stage", F.last(stage, True).over(w))


def stage_profile(events: DataFrame, stage: str, seconds: str) -> DataFrame:
    """(stage, seconds, calls, ms a call) of timed calls."""
    total = F.sum(seconds)
    return events.groupBy(stage).agg(F.round(total, 4).alias("seconds"), F.count("*").alias("calls"), F.round(total * 1000 / F.count("*"), 3).alias("ms_per_call"))


def call_counters(calls: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    """Calls used, answered, from the cache and failed of each key, in one partial aggregation."""
    is_kind = lambda k: F.count_if(F.col(kind) == k)
    return calls.groupBy(*keys).agg(F.count_if(F.col(kind) != "hit").alias("calls_used"), is_kind("ok").alias("api_ok_calls"), is_kind("hit").alias("cache_hits"), is_kind("failed").alias("failed"))


def allowed_actions(events: DataFrame, kind: str, allowed: tuple[str, ...]) -> DataFrame:
    """Of each kind how many rows the list of allowed ones lets pass."""
    return events.groupBy(kind).agg(F.count_if(F.col(kind).isin(*allowed)).alias("allowed"), F.count("*").alias("n"))


def event_times(events: DataFrame) -> DataFrame:
    """Events with epoch ``seconds`` of three decimals and ``elapsed`` seconds of one since the job's first event."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first = events.groupBy("job").agg(F.min(at).alias("__first"))
    return events.join(first, "job").withColumn("seconds", F.round(at / 1_000_000, 3)).withColumn("elapsed", F.round((at - F.col("__first")) / 1_000_000, 1)).drop("__first")


def complete(got: Column, wanted: Column) -> Column:
    """Whether a reply has every id that was asked for; more of them do not matter."""
    return F.size(F.array_except(wanted, got)) == 0


def unit_pages(results: DataFrame, places: DataFrame) -> DataFrame:
    """Results (pno, i, dst) at their places (pno, i, …): looked up by both numbers, the place's own text where there is none."""
    return places.join(results, ["pno", "i"], "left").withColumn("dst", F.coalesce("dst", "text"))
