"""URL filter by a sort-merge range join.

A rule's host with its labels reversed ("com.example.") is a prefix of the reversed hosts it covers, so it is the
interval [key, key + U+10FFFF). Pages and rules are dealt to ranges of the key order: a page to the one its key is in,
a rule to each that its interval meets. In a range both are swept in key order while a stack keeps the rules whose
intervals enclose the present key; they are nested, so leaving one is popping the top.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that are drawn for each range to find the ranges' borders; only the balance of tasks depends on them.
DRAWN = 50
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = chr(0x10FFFF)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"(?s)^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def host_key(host: Column) -> Column:
    """Labels reversed, each ended by a dot: ``www.example.com`` is ``com.example.www.``."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_table(spark, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) of a list, of which the last of equal hosts and paths counts."""
    last = {(h, p): v for v, h, p in rules}
    return spark.createDataFrame([(v, h, p) for (h, p), v in last.items()], "verdict string, host string, path string")


class _Active:
    """Rules of one key: those whose path a page's path starts with are found by the lengths that occur."""

    def __init__(self, key: str):
        self.key, self.of, self.sizes = key, {}, []

    def add(self, path: str, verdict: str, name: str) -> None:
        if path not in self.of and len(path) not in self.sizes:
            self.sizes = sorted([*self.sizes, len(path)], reverse=True)
        self.of[path] = (name, verdict)

    def fit(self, path: str) -> tuple[str, str] | None:
        return next((self.of[path[:n]] for n in self.sizes if path[:n] in self.of), None)


def _sweep(default: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[_Active] = []
        present = None
        for pdf in batches:
            at, names, verdicts = [], [], []
            for k, (part, key, is_page, path, host, verdict) in enumerate(zip(pdf["__part"], pdf["__key"], pdf["__page"], pdf["path"], pdf["host"], pdf["verdict"], strict=True)):
                if part != present:
                    stack, present = [], part
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if not is_page:
                    if not stack or stack[-1].key != key:
                        stack.append(_Active(key))
                    stack[-1].add(path, verdict, f"{host}{path}")
                    continue
                hit = next((r for x in reversed(stack) if (r := x.fit(path))), (None, default))
                at.append(k)
                names.append(hit[0])
                verdicts.append(hit[1])
            yield pdf[["page_id", "host", "path"]].iloc[at].assign(rule=pd.Series(names, dtype=object, index=pdf.index[at]), verdict=verdicts)

    return run


def judge_urls(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url).

    ``rules`` is a table (verdict, host, path prefix) of any size, or a list of such rows. A rule fits its host and all
    subdomains if the path starts with its path; of the fitting rules the one with the longest host wins, then the
    longest path; of equal rules of a list the last one, of a table the one with the greatest verdict. Where none fits,
    rule is null and verdict is ``default``. A task holds the rules on one host's way to the top-level domain.

    * null url or none with ``://``: host and path empty, no rule; no rules: every row gets ``default``; rules with a
      null are ignored;
    * repeated rows are judged one by one, a null page_id stays null, other columns are ignored, an empty table gives no rows;
    * a host that holds a third of the rows is split over tasks: the sort key goes on with path and a hash of page_id.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = rule_table(spark, rules)
    host, path = split_url(F.col("url"))
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("__key", host_key(F.col("host")))
    place = F.concat_ws("\x01", F.col("__key"), F.col("path"), F.hex(F.xxhash64("page_id")))
    rows = rows.withColumn("__place", place)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, DRAWN * parts / max(1, rows.count()))
    drawn = sorted(r[0] for r in rows.sample(share, seed=1).select("__place").collect())
    borders = sorted({drawn[k * len(drawn) // parts] for k in range(1, parts)}) if drawn else []

    @F.pandas_udf("int")
    def range_of(place: pd.Series) -> pd.Series:
        return place.map(lambda x: bisect_right(borders, x)).astype("int32")

    rows = rows.select(range_of("__place").alias("__part"), "__key", F.lit(True).alias("__page"), "path", "page_id", "host", F.lit(None).cast("string").alias("verdict"))
    known = rules.where("verdict is not null and host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("__key", host_key(F.col("host")))
    low, high = range_of("__key"), range_of(F.concat("__key", F.lit(_LAST)))
    known = known.select(F.explode(F.sequence(low, high)).alias("__part"), "__key", F.lit(False).alias("__page"), "path", F.lit(None).cast(kind).alias("page_id"), "host", "verdict")
    order = ["__part", "__key", "__page", "path", "page_id"]
    both = rows.union(known).repartitionById(parts, "__part").sortWithinPartitions(*order)
    return both.mapInPandas(_sweep(default), f"page_id {kind}, host string, path string, rule string, verdict string")


#: The contract's rules.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
_FITS = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
_LONGEST = sorted(RULES, key=lambda r: (-r[1].count("."), -len(r[1]), -len(r[2])))
ORACLE = f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
u AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_FITS(h, p)} THEN '{h}{p}'" for _, h, p in _LONGEST)} END AS rule,
  CASE {" ".join(f"WHEN {_FITS(h, p)} THEN '{v}'" for v, h, p in _LONGEST)} ELSE 'allow' END AS verdict
FROM u
"""
