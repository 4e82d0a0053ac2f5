"""The whole course of a translation as one plan: cache, batches, calls, second replies, and the source where nothing came back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import calls, control, units
from quillspark.session import stored
from quillspark.sources.files import Settings


@dataclass
class Translated:
    """results (doc, i, text, dst, origin), new cache rows (k, src, dst), and counters (doc, units, cache_hits, asked, batches, kept)."""

    results: DataFrame
    cache: DataFrame
    counters: DataFrame


def translate_units(source: DataFrame, cache: DataFrame, ask: Callable[[DataFrame, int], DataFrame], settings: Settings, retries: int = 2, shorter: Callable[[DataFrame], DataFrame] | None = None) -> Translated:
    """Results of the units (doc, i, text[, budget]) of documents.

    A unit in the cache (k, dst) is not asked for; equal texts of a document are asked for once. The others are packed
    first-fit into batches, of which the first ``max_calls`` of a document are sent. ``ask`` takes (id, text) and the attempt
    and gives (id, dst). ``shorter``, if given, is asked again for results over their budget. Units without a valid reply, or
    beyond the cap, keep their source.

    origin tells where a result is from: cache, call, second or source. Null texts keep null; empty tables give empty results.
    """
    key = T.cache_key("x", settings.provider, settings.source, settings.target, F.col("text"))
    rows = source.withColumn("k", key)
    if "budget" not in rows.columns:
        rows = rows.withColumn("budget", F.lit(None).cast("int"))
    # keys go through the cache and the batches; a text is dealt once for what is sent and once for the results
    keys = rows.groupBy("doc", "k").agg(F.min(F.when(F.col("text").isNotNull(), F.col("i"))).alias("i"), F.min(F.length("text")).alias("n"))
    found = stored(units.cache_hits(keys, [("k", cache.select("k", "dst"))]).withColumnRenamed("tier", "hit"))
    once = found.where("hit is null and n is not null").select("doc", "k", "i", "n")
    packed = units.first_fit(once, ["doc"], "i", "n", settings.batch_chars, settings.batch_size)
    chosen = packed.where(F.col("batch_no") < settings.max_calls).select("doc", "batch_no", F.explode(F.split("items", ",").cast("array<int>")).alias("i"))
    chosen = once.select("doc", "k", "i").join(chosen, ["doc", "i"])
    sent = rows.select("doc", "i", "k", "text").join(chosen, ["doc", "i", "k"]).dropDuplicates(["doc", "i", "k"])
    sent = stored(sent.select(F.concat_ws(":", F.col("doc").cast("string"), "k").alias("id"), "doc", "k", "text", "batch_no"))
    replies = calls.ask_until_valid(sent.select("id", "text"), ask, retries).where("attempt is not null")
    got = stored(sent.select("id", "doc", "k").join(replies.select("id", "dst"), "id").select("doc", "k", F.col("dst").alias("__reply")))
    origin = F.when(F.col("hit").isNotNull(), "cache").when(F.col("__reply").isNotNull(), "call").otherwise("source")
    answers = found.join(got, ["doc", "k"], "left").select(F.col("doc").alias("__doc"), F.col("k").alias("__k"), F.coalesce("dst", "__reply").alias("dst"), origin.alias("origin"))
    out = rows.join(answers, F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("k") == F.col("__k"))).drop("__doc", "__k")
    if shorter is not None:
        again = control.reask_over_budget(out.withColumnRenamed("text", "src"), ["doc"], "i", shorter, settings.max_calls).withColumnRenamed("src", "text")
        out = again.withColumn("origin", F.when(F.col("reasked"), "second").otherwise(F.col("origin"))).drop("reasked")
    results = out.select("doc", "i", "text", F.coalesce("dst", "text").alias("dst"), "origin")
    # of equal texts the last document's reply is kept: told by keys first, so that texts are dealt once
    last = got.groupBy("k").agg(F.max("doc").alias("doc"))
    stored_rows = last.join(got, ["doc", "k"]).join(sent.select("doc", "k", F.col("text").alias("src")), ["doc", "k"]).select("k", "src", F.col("__reply").alias("dst"))
    by = results.groupBy("doc").agg(F.count("*").alias("units"), F.count_if(F.col("origin") == "cache").alias("cache_hits"), F.count_if(F.col("origin") == "source").alias("kept"))
    asked = sent.groupBy("doc").agg(F.count("*").alias("asked"), F.count_distinct("batch_no").alias("batches"))
    counters = by.join(asked, "doc", "left").na.fill(0, ["asked", "batches"])
    return Translated(results, stored_rows, counters)


def progress(results: DataFrame) -> DataFrame:
    """Share of each document's units that have a result of their own, (doc, done, total): what a user interface shows."""
    w = Window.partitionBy("doc")
    return results.select("doc", F.count_if(F.col("origin") != "source").over(w).alias("done"), F.count("*").over(w).alias("total")).distinct()
