"""Hooks for users of the library: SQL functions and table functions, and subscribers of streaming progress."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from quillspark.operators.folds import parse_pairs
from quillspark.operators.wrapping import alike


class ReplyPairs:
    """Table function: pairs (key, text) of a reply, of the ids that are wanted."""

    def eval(self, raw: str, wanted: list[str]):
        yield from (parse_pairs(raw, set(wanted or ())) or {}).items()


class UpperMedian:
    """Aggregate over whole groups: element n div 2 of the sorted values."""

    @staticmethod
    def of(values: pd.Series) -> float:
        known = values.dropna().sort_values().reset_index(drop=True)
        return float(known[len(known) // 2]) if len(known) else 10.0


def register_functions(spark: SparkSession) -> None:
    """``text_alike(a, b)``, ``upper_median(x)`` and the table function ``reply_pairs(raw, wanted)`` for SQL."""

    @F.pandas_udf("double")
    def text_alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return alike(a, b)

    @F.pandas_udf("double")
    def upper_median(values: pd.Series) -> float:
        return UpperMedian.of(values)

    spark.udf.register("text_alike", text_alike)
    spark.udf.register("upper_median", upper_median)
    spark.udtf.register("reply_pairs", F.udtf(ReplyPairs, returnType="key string, text string"))


class Subscribers(StreamingQueryListener):
    """Tells each batch of a stream to functions; one that raises is dead and is told nothing more."""

    def __init__(self):
        self._told: list[Callable[[dict], None]] = []

    def subscribe(self, fn: Callable[[dict], None]) -> Callable[[], None]:
        """Adds a function and gives one that takes it out again."""
        self._told.append(fn)
        return lambda: self._told.remove(fn) if fn in self._told else None

    def tell(self, event: dict) -> None:
        for fn in list(self._told):
            try:
                fn(event)
            except Exception:  # noqa: BLE001 - whatever a subscriber raises, the others go on
                self._told.remove(fn)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.tell({"kind": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.tell({"kind": "progress", "id": str(event.progress.id), "rows": event.progress.numInputRows})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.tell({"kind": "heartbeat", "id": str(event.id)})

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.tell({"kind": "exit", "id": str(event.id), "error": event.exception})
