"""Links: records, where their text stands in another text, wrapping, pieces of one link, targets, and links that were lost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import geom
from quillspark.operators.layout import PAGE
from quillspark.operators.splits import running_unions

#: Full-width brackets and what they count as.
WIDE_BRACKETS, BRACKETS = "（）［］｛｝", "()[]{}"


def link_records(links: DataFrame) -> DataFrame:
    """Links (…, href) as records: href_kind uri or goto, uri, target; empty ones go, each by itself."""
    href = F.trim("href")
    rows = links.withColumn("href", href).where(F.length("href") > 0)
    goto = F.startswith(F.col("href"), F.lit("#"))
    return rows.withColumn("href_kind", F.when(goto, "goto").otherwise("uri")).withColumn("uri", F.when(~goto, F.col("href"))).withColumn("target", F.when(goto, F.substr("href", F.lit(2))))


#: The characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def places(text: Column, first: Column, last: Column) -> Column:
    """Span (s, e) from 0 of a text's characters ``first`` to ``last`` (from 1) other than white space.

    A fold over runs of white space and of others, so there is a step for each word and none for each character.
    """
    kind = "struct<at:int,n:int,s:int,e:int>"

    def step(a: Column, run: Column) -> Column:
        size, solid = F.length(run), F.instr(F.lit(WHITE), F.substr(run, F.lit(1), F.lit(1))) == 0
        hit = lambda k: solid & (a.n < k) & (a.n + size >= k)
        s, e = F.when(hit(first), a["at"] + first - a.n - 1).otherwise(a.s), F.when(hit(last), a["at"] + last - a.n).otherwise(a.e)
        return F.struct((a["at"] + size).alias("at"), (a.n + F.when(solid, size).otherwise(0)).alias("n"), s.alias("s"), e.alias("e")).cast(kind)

    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), none.alias("s"), none.alias("e")).cast(kind)
    return F.aggregate(F.regexp_extract_all(text, F.lit(r"(?U)\s+|\S+"), F.lit(0)), start, step, lambda a: F.struct(a.s.alias("s"), a.e.alias("e")))


def without_space(text: Column) -> Column:
    return F.translate(F.regexp_replace(text, r"(?U)\s+", ""), WIDE_BRACKETS, BRACKETS)


def find_loose(text: Column, pattern: Column, start: Column) -> Column:
    """Span (s, e) from 0 of a pattern in a text, white space left out and full-width brackets folded on both sides.

    The search begins at position ``start`` of the text and, if nothing follows, at its head; null where it finds nothing
    or where text or pattern is empty.
    """
    skipped = F.length(F.regexp_replace(F.substr(text, F.lit(1), start), r"(?U)\s+", ""))
    locate = lambda x, begin: F.call_function("locate", x.wanted, x.flat, begin)
    parts = F.struct(without_space(text).alias("flat"), without_space(pattern).alias("wanted"), skipped.alias("skipped"))
    found = lambda x: let(locate(x, x.skipped + 1), lambda later: F.when(later > 0, later).otherwise(locate(x, F.lit(1))))
    spot = lambda x: let(found(x), lambda at: F.when((F.length(x.wanted) > 0) & (at > 0), F.struct(at.alias("first"), (at + F.length(x.wanted) - 1).alias("last"))))
    span = let(let(parts, spot), lambda x: F.when(x.isNotNull(), places(text, x["first"], x["last"])))
    return F.when((F.length(text) > 0) & (F.length(pattern) > 0), span)


def escape(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def escape_attribute(text: Column) -> Column:
    return F.replace(escape(text), F.lit('"'), F.lit("&quot;"))


def wrap_links(text: Column, spans: Column) -> Column:
    """HTML of a text in which spans (s, e, href) are links; one that begins inside an earlier one is left out."""
    kind = "struct<out:string,pos:int>"
    ordered = F.array_sort(F.filter(spans, lambda x: x.s.isNotNull()))
    piece = lambda low, high: escape(F.substr(text, low + 1, high - low))

    def step(state: Column, x: Column) -> Column:
        link = F.concat(state.out, piece(state.pos, x.s), F.lit('<a href="'), escape_attribute(x.href), F.lit('">'), piece(x.s, x.e), F.lit("</a>"))
        return F.when(x.s < state.pos, state).otherwise(F.struct(link.alias("out"), x.e.cast("int").alias("pos"))).cast(kind)

    return F.aggregate(ordered, F.struct(F.lit("").alias("out"), F.lit(0).alias("pos")).cast(kind), step, lambda a: F.concat(a.out, piece(a.pos, F.length(text))))


def merge_fragments(pieces: DataFrame, order: list[str]) -> DataFrame:
    """Pieces of links (page, href, bbox) in order: those of one link on one line become one, (page, href, run, n, bbox).

    A piece goes on with the run before it if both overlap by more than half the lower height (1 at most) and the gap between
    them is -2 to 12.
    """

    def goes_on(p: Column, b: Column) -> Column:
        low = F.least(p.bbox.y1 - p.bbox.y0, b.bbox.y1 - b.bbox.y0, F.lit(1.0))
        return (p.href == b.href) & (F.least(p.bbox.y1, b.bbox.y1) - F.greatest(p.bbox.y0, b.bbox.y0) > 0.5 * low) & (b.bbox.x0 - p.bbox.x1).between(-2, 12)

    runs = running_unions(pieces, PAGE, order, ["href"], goes_on)
    return runs.groupBy(*PAGE, "run", "href").agg(F.count("*").alias("n"), geom.bbox(F.col("bbox")).alias("bbox"))


def goto_targets(dests: DataFrame, regions: DataFrame) -> DataFrame:
    """Region that each destination (page, dest, x, y) leads to: the smallest that holds it (2 points of slack), else the nearest below.

    The join carries the page as equal key; regions are (page, region, bbox), of equal ones the first.
    """
    r, x, y = F.col("bbox"), F.col("x"), F.col("y")
    holds = (x >= r.x0 - 2) & (x <= r.x1 + 2) & (y >= r.y0 - 2) & (y <= r.y1 + 2)
    rank = F.when(holds, F.struct(F.lit(0).alias("tier"), geom.area(r).alias("a"), F.lit(0.0).alias("b"), "region")).when(r.y0 >= y - 2, F.struct(F.lit(1).alias("tier"), (r.y0 - y).alias("a"), F.abs((r.x0 + r.x1) / 2 - x).alias("b"), "region"))
    best = dests.join(regions, PAGE).where(holds | (r.y0 >= y - 2)).groupBy(*PAGE, "dest").agg(F.min(rank).alias("best"))
    return dests.join(best, [*PAGE, "dest"], "left").select(*PAGE, "dest", F.col("best.region").alias("region"), F.col("best.tier").alias("tier"))


def link_key(rect: Column, *parts: str) -> list[Column]:
    """What a link is told by: its corner in tenths of points, its kind and where it leads."""
    return [F.bround(rect.x0, 1).alias("__x"), F.bround(rect.y0, 1).alias("__y"), *(F.coalesce(F.col(p).cast("string"), F.lit("")).alias(f"__{p}") for p in parts)]


def lost_links(before: DataFrame, after: DataFrame, *parts: str) -> DataFrame:
    """Links of ``before`` that ``after`` has not: to be put back."""
    key = link_key(F.col("rect"), *parts)
    names = [*PAGE, "__x", "__y", *(f"__{p}" for p in parts)]
    there = after.select(*PAGE, *key).distinct()
    return before.select("*", *key).join(there, names, "left_anti").drop(*names[2:])


def outside(blocks: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """Blocks that touch no region (page, rect) of their page."""
    hit = blocks.join(regions.select(*PAGE, "rect"), PAGE).where(geom.shared_area(F.col("bbox"), F.col("rect")) > 0).select(*PAGE, key).distinct()
    return blocks.join(hit, [*PAGE, key], "left_anti")
