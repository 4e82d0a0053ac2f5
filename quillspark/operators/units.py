"""Work units: first-fit batches, cache tiers, retention, upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class _Bins:
    """Bins in the order in which they were opened; the first with room is found in a tree of the greatest rooms."""

    def __init__(self, budget: int, size: int):
        self.budget, self.size, self.leaves, self.room = budget, size, 1, [-1, -1]
        self.bins: list[tuple[int, list[int]]] = []

    def _set(self, k: int, room: int) -> None:
        k += self.leaves
        self.room[k] = room
        while k := k // 2:
            self.room[k] = max(self.room[2 * k], self.room[2 * k + 1])

    def place(self, i: int, n: int) -> None:
        need, k = n if self.budget > 0 else 0, 1
        if self.room[1] < need:
            if len(self.bins) == self.leaves:
                old = self.room[self.leaves :]
                self.leaves *= 2
                self.room = [-1] * self.leaves + old + [-1] * len(old)
                for j in range(self.leaves - 1, 0, -1):
                    self.room[j] = max(self.room[2 * j], self.room[2 * j + 1])
            self.bins.append((0, []))
            k = len(self.bins) - 1
        else:
            while k < self.leaves:
                k = 2 * k if self.room[2 * k] >= need else 2 * k + 1
            k -= self.leaves
        chars, items = self.bins[k]
        items.append(i)
        self.bins[k] = (chars + n, items)
        self._set(k, -1 if len(items) >= self.size else max(-1, self.budget - chars - n) if self.budget > 0 else 0)


def first_fit(units: DataFrame, keys: list[str], order: str, length: str, budget: int, size: int) -> DataFrame:
    """Units of each key into batches: (keys, batch_no, chars, units, items).

    In order, a unit goes into the first batch with fewer than ``size`` units and room for its characters, else into a
    new one; a unit over the budget is alone; budget 0 only counts units. The batches of one key are carried along the
    sorted partition; a unit takes time with the logarithm of their number.
    """
    rows = units.select(*keys, F.col(order).cast("int").alias("i"), F.col(length).cast("bigint").alias("n")).repartition(*keys).sortWithinPartitions(*keys, "i")
    kinds = ", ".join(f"{k} {units.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        present, bins, out = None, None, []

        def close() -> None:
            if bins is not None:
                out.extend((*present, b, chars, len(items), ",".join(map(str, items))) for b, (chars, items) in enumerate(bins.bins))

        for pdf in batches:
            for *key, i, n in pdf.itertuples(index=False, name=None):
                if key != present:
                    close()
                    present, bins = key, _Bins(budget, size)
                bins.place(i, n)
            yield pd.DataFrame(out, columns=[*keys, "batch_no", "chars", "units", "items"])
            out = []
        close()
        yield pd.DataFrame(out, columns=[*keys, "batch_no", "chars", "units", "items"])

    return rows.mapInPandas(run, f"{kinds}, batch_no int, chars bigint, units int, items string")


def unique_units(units: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row of each key: what is asked only once."""
    return units.groupBy(key).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n"))


def cache_misses(units: DataFrame, cache: DataFrame, key: str = "k") -> DataFrame:
    return units.join(cache.select(key), key, "left_anti")


def cache_hits(units: DataFrame, tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """Looks units up in tiers (key column of the unit, table (k, dst)) in order; tells the first tier that has them."""
    dst, tier = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (col, cache) in enumerate(tiers):
        units = units.join(cache.select(F.col("k").alias(col), F.col("dst").alias(f"__d{i}")), col, "left")
        tier = F.coalesce(tier, F.when(F.col(f"__d{i}").isNotNull(), i))
        dst = F.coalesce(dst, F.col(f"__d{i}"))
    return units.withColumn("dst", dst).withColumn("tier", tier).drop(*(f"__d{i}" for i in range(len(tiers))))


def keep_newest(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The newest n rows, as a distributed top-n."""
    return rows.orderBy(*order).limit(n)


def over_bytes(rows: DataFrame, by: list[str], size: Column, order: list[str], limit: int, pieces: int = 1024) -> DataFrame:
    """Rows that retention deletes in each group: oldest first, while the group is over ``limit`` bytes.

    ``order`` begins with a number. Its range in a group is cut into ``pieces`` of equal width; sums of the pieces come from
    a partial aggregation, and each row's place in its piece from a window over the piece: a group is never in one task.
    """
    sized = rows.withColumn("__n", size)
    ends = sized.groupBy(*by).agg(F.min(order[0]).alias("__low"), F.max(order[0]).alias("__high"), F.sum("__n").alias("__all"))
    at = F.floor((F.col(order[0]) - F.col("__low")) * pieces / (F.col("__high") - F.col("__low") + 1))
    cut = sized.join(ends, by).withColumn("__piece", at)
    sums = cut.groupBy(*by, "__piece").agg(F.sum("__n").alias("__sum"))
    lead = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "__piece", F.coalesce(F.sum("__sum").over(lead), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*by, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.where(F.col("__all") > limit).join(sums, [*by, "__piece"]).withColumn("__before", F.col("__base") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    return out.where(F.col("__before") < F.col("__all") - limit).select(*rows.columns)


def upsert_latest(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Latest row of each key over both tables."""
    cols = [c for c in old.columns if c not in key]
    both = old.unionByName(new)
    best = both.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("x"))
    return best.select(*key, *(F.col(f"x.{c}").alias(c) for c in cols))


def over_budget(src: Column, dst: Column, budget: Column) -> Column:
    """A result 15 % over its budget of characters although the source is not; in hundredths, as 1.15 * 400 is under 460 in doubles."""
    limit, part = F.lit(115).cast("long") * budget, F.lit(100).cast("long")
    return (part * dst > limit) & (part * src <= limit)


def saved_calls(rows: DataFrame, by: list[str], key: str, batch: int) -> DataFrame:
    """Rows of each group that another one with their key answers, and the calls of ``batch`` units that they save."""
    one = rows.groupBy(*by, key).agg(F.count("*").alias("n"))
    hits = F.sum(F.col("n") - 1)
    return one.groupBy(*by).agg(hits.alias("hits"), F.ceil(hits / batch).alias("saved"))


def with_language(rows: DataFrame, registry: DataFrame, fallback: str = "cjk") -> DataFrame:
    """Rows (…, lang) with script, direction and tag of a registry (code, script, rtl) of all known languages, a few hundred at most."""
    known = rows.join(F.broadcast(registry), F.col("lang") == F.col("code"), "left")
    return known.withColumn("script", F.coalesce("script", F.lit(fallback))).withColumn("rtl", F.coalesce("rtl", F.lit(False))).withColumn("tag", F.initcap("lang")).drop("code")
