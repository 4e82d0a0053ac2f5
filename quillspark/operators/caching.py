"""Caches as tables: keys and their tiers, what is stored, rectangles and payloads as text, merging and migration."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T


def budget_key(key: Column, budget: Column) -> Column:
    """Key of a result that was asked for with a budget of characters; null without one."""
    return F.when(budget > 0, F.concat(key, F.lit("|#b"), budget.cast("string")))


def sentence_key(prefix: list[str], sentence: Column) -> Column:
    return T.cache_key(*prefix, F.concat(F.lit("|seg|"), sentence))


def sentence_puts(pairs: DataFrame, prefix: list[str], order: list[str]) -> DataFrame:
    """Sentences to store, (k, src, dst), of results (src, dst) with as many sentences as their source, two at least.

    Of equal keys the last in ``order`` counts, as later writes replace earlier ones.
    """
    trimmed = lambda c: F.transform(T.sentences(F.col(c)), F.trim)
    rows = pairs.withColumn("__s", trimmed("src")).withColumn("__d", trimmed("dst")).where("size(__s) = size(__d) and size(__s) >= 2")
    rows = rows.select(*order, F.posexplode(F.arrays_zip("__s", "__d")).alias("__i", "__x")).select(*order, "__i", sentence_key(prefix, F.col("__x.__s")).alias("k"), F.col("__x.__s").alias("src"), F.col("__x.__d").alias("dst"))
    return put_many(rows.limit(0), rows, [*order, "__i"])


def put_many(cache: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """Cache (k, src, dst, order) after all ``rows`` are written, later ones over earlier ones: one aggregation, no row by row."""
    latest = F.max_by(F.struct("src", "dst"), F.struct(*order))
    return cache.unionByName(rows).groupBy("k").agg(latest.alias("x")).select("k", "x.src", "x.dst")


def merge_legacy(cache: DataFrame, legacies: list[DataFrame], key: str = "k") -> DataFrame:
    """The cache, or, if it is empty, the rows of the older caches: of equal keys that of the first one in the list."""
    if not cache.isEmpty() or not legacies:
        return cache
    both = None
    for i, old in enumerate(legacies):
        old = old.select(*cache.columns).withColumn("__from", F.lit(i))
        both = old if both is None else both.unionByName(old)
    cols = [c for c in cache.columns if c != key]
    best = both.groupBy(key).agg(F.min(F.struct("__from", *cols)).alias("x"))
    return best.select(key, *(F.col(f"x.{c}").alias(c) for c in cols)).select(*cache.columns)


def with_columns(rows: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Adds the columns (type, default) that a table of an older version lacks."""
    missing = {c: F.lit(default).cast(kind) for c, (kind, default) in columns.items() if c not in rows.columns}
    return rows.withColumns(missing) if missing else rows


def subset_key(fingerprint: Column, pages: Column, total: Column) -> Column:
    """Fingerprint of a document, with its page numbers where they are not all of it."""
    chosen = F.array_sort(F.array_distinct(pages))
    return F.when(F.size(chosen) == total, fingerprint).otherwise(F.concat(fingerprint, F.lit("|sel"), F.array_join(F.transform(chosen, lambda p: p.cast("string")), ",")))


def layout_key(fingerprint: Column, engine: str, version: int) -> Column:
    return F.concat_ws("|", fingerprint, F.lit(engine), F.lit(f"v{version}"))


def render_key(fingerprint: Column, layout: Column, settings: dict[str, object], payload: Column) -> Column:
    """One md5 over everything that a rendered document depends on; settings in the order of their names."""
    said = "|".join(f"{k}={settings[k]}" for k in sorted(settings))
    return F.md5(F.concat_ws("|", fingerprint, layout, F.lit(said), payload))


def rect_text(rect: Column) -> Column:
    """Corners with two decimals."""
    return F.format_string("%.2f,%.2f,%.2f,%.2f", rect.x0, rect.y0, rect.x1, rect.y1)


def payload_hash(rects: Column, texts: Column) -> Column:
    """md5 over sorted lines "rectangle:text" of a group's rows: the same for any order of rows."""
    return F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", rect_text(rects), texts))), "|"))


def encode_rect(rect: Column) -> Column:
    return F.to_json(F.struct(F.array(rect.x0, rect.y0, rect.x1, rect.y1).alias("__rect__")))


def decode_rect(text: Column) -> Column:
    """Rectangle of an encoded one; null for any other text or object, or where there are not four numbers."""
    got = F.from_json(text, "map<string,array<double>>")
    corners = F.element_at(got, "__rect__")
    whole = (F.size(F.map_keys(got)) == 1) & (F.size(corners) == 4)
    return F.when(whole, F.struct(*(F.element_at(corners, i + 1).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1")))))


def layout_hits(wanted: DataFrame, layouts: DataFrame) -> DataFrame:
    """Wanted (k, pages) with the stored ``data``; a layout of another number of pages is a miss."""
    stored = layouts.select("k", "data", F.col("pages").alias("__pages"))
    return wanted.join(stored, "k", "left").withColumn("data", F.when(F.col("pages") == F.col("__pages"), F.col("data"))).drop("__pages")


def whole_renders(blobs: DataFrame, data: str = "data") -> DataFrame:
    """Stored documents that begin as a PDF does; anything else is a miss."""
    return blobs.where(F.substr(F.col(data), F.lit(1), F.lit(4)) == F.lit(b"%PDF"))


def forced_groups(members: DataFrame, group: list[str], named: Column) -> DataFrame:
    """``members`` with ``forced``: a whole group is asked again if any of its members is on a named page."""
    return members.join(members.groupBy(*group).agg(F.bool_or(named).alias("forced")), group)


def cache_root(explicit: str, source: str, out_dir: str) -> Path:
    """Where caches go: the explicit folder, else beside the source if that can be written to, else the output folder."""
    if explicit:
        return Path(explicit)
    beside = Path(source).parent
    return beside if beside.is_dir() and os.access(beside, os.W_OK) else Path(out_dir)


def unit_kind(is_ref: Column, is_caption: Column, members: Column) -> Column:
    """ref or caption for units of one paragraph, whose sentences are cached; null for others."""
    return F.when(members == 1, F.when(is_ref, "ref").when(is_caption, "caption"))


def offsets(counts: DataFrame, by: list[str], order: list[str], n: str) -> DataFrame:
    """Position at which each row's ``n`` results begin among those of its group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum(n).over(w), F.lit(0)))
