"""The retry loop around an external call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.session import stored


def ask_until_valid(units: DataFrame, ask: Callable[[DataFrame, int], DataFrame], retries: int = 3) -> DataFrame:
    """Replies to units (id, text): (id, dst, attempt), with the source and no attempt where none was valid.

    ``ask`` takes the pending units and the attempt and returns (id, dst). A reply counts if it keeps the multiset of
    [FORMULA_n] marks; the first attempt with one wins (of several replies to an id the smallest). Replies of an
    attempt are stored before the next one asks, so a lost executor never repeats calls whose replies were taken.
    """
    pending, done = units.select("id", "text"), None
    for attempt in range(1, retries + 1):
        replies = ask(pending, attempt).groupBy("id").agg(F.min("dst").alias("dst"))
        marks = pending.select("id", T.placeholders(F.col("text")).alias("marks"))  # of a text its marks only meet the reply
        valid = marks.join(replies, "id").where(F.col("marks") == T.placeholders(F.col("dst")))
        taken = stored(valid.select("id", "dst", F.lit(attempt).alias("attempt")))
        done = taken if done is None else done.union(taken)
        pending = pending.join(taken.select("id").distinct(), "id", "left_anti")
        if attempt < retries and pending.isEmpty():
            break
    return done.union(pending.select("id", "text", F.lit(None).cast("int")))
