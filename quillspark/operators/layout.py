"""Layout analytics on page lines: filters, column modes, sizes, order, neighbours and protected regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import geom
from quillspark.sources.adapters import PAGE_H, PAGE_W

PAGE = ["doc_id", "pno"]


def page_size(rows: DataFrame) -> tuple[Column, Column]:
    """Width and height of each row's page: its columns page_w and page_h, or the usual size where there are none."""
    return tuple(F.col(c) if c in rows.columns else F.lit(usual) for c, usual in (("page_w", PAGE_W), ("page_h", PAGE_H)))


def header_footer(b: Column, height: float | Column = PAGE_H) -> Column:
    return (b.y1 < 0.08 * height) | (b.y0 > 0.94 * height)


def line_number_block(b: Column, text: Column) -> Column:
    return (b.x1 < 45) & text.rlike(r"^[\d\s]+$")


def column_mode(lines: DataFrame) -> DataFrame:
    """Per page: 'two' unless 35 % of the body lines cross the middle or a side has fewer than two; under four lines 'one'.

    Pages are as wide and high as the lines' page_w and page_h say, if they have them.
    """
    width, height = page_size(lines)
    b, mid, slack = F.col("bbox"), width / 2, 0.02 * width
    body = ~header_footer(b, height)
    n = F.count_if(body)
    crossing, left, right = F.count_if(body & (b.x0 < mid - slack) & (b.x1 > mid + slack)), F.count_if(body & (b.x1 <= mid)), F.count_if(body & (b.x0 >= mid))
    one = (n < 4) | (crossing / F.greatest(n, F.lit(1)) >= 0.35) | (left < 2) | (right < 2)
    return lines.groupBy(*PAGE).agg(n.alias("n_body"), F.when(one, "one").otherwise("two").alias("mode"))


def weighted_mode(lines: DataFrame, keys: list[str], first: list[str]) -> DataFrame:
    """Size with the most characters in each group; of equal weights the one seen first."""
    sums = lines.groupBy(*keys, F.bround("size", 1).alias("size")).agg(F.sum(F.greatest(F.length("text"), F.lit(1))).alias("w"), F.min(F.struct(*first)).alias("first"))
    best = sums.groupBy(*keys).agg(F.min(F.struct((-F.col("w")).alias("w"), "first", "size")).alias("x"))
    return best.select(*keys, F.col("x.size").alias("body_size"), (-F.col("x.w")).alias("weight"))


def headings(lines: DataFrame) -> DataFrame:
    """Lines larger than 1.15 times their page's body size."""
    body = weighted_mode(lines, PAGE, ["pi"]).select(*PAGE, "body_size")
    return lines.join(body, PAGE).withColumn("is_heading", F.col("size") > 1.15 * F.col("body_size"))


def upper_median(values: Column) -> Column:
    """Element n div 2 of the sorted values, not interpolated; 10 where there is none."""
    s = F.sort_array(F.collect_list(values))
    return F.coalesce(F.try_element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int")), F.lit(10.0))


def counted_percentiles(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """(keys, names): exact, interpolated percentiles of columns, {name: (column, share)}, rounded to 6 places.

    Values are counted first, so that a few large groups send each value once from a task, and not each row.
    """
    columns = sorted({c for c, _ in wanted.values()})
    long = rows.select(*keys, F.inline(F.array(*(F.struct(F.lit(c).alias("__c"), F.col(c).cast("double").alias("__v")) for c in columns)))).where("__v is not null")
    counts = long.groupBy(*keys, "__c", "__v").agg(F.count("*").alias("__n"))
    pick = [F.round(F.percentile(F.when(F.col("__c") == c, F.col("__v")), F.lit(q), F.when(F.col("__c") == c, F.col("__n")).otherwise(F.lit(1).cast("long"))), 6).alias(name) for name, (c, q) in wanted.items()]
    return counts.groupBy(*keys).agg(*pick)


def template_quantiles(lines: DataFrame, keys: list[str], shares: tuple[float, ...]) -> DataFrame:
    """(keys, x0_q06, …, n): quantiles of the four corners of all lines' boxes."""
    corners = ("x0", "y0", "x1", "y1")
    wanted = {f"{c}_q{int(q * 100):02d}": (c, q) for c in corners for q in shares}
    quantiles = counted_percentiles(lines.select(*keys, "bbox.*"), keys, wanted)
    return quantiles.join(lines.groupBy(*keys).agg(F.count("*").alias("n")), keys)


def next_below(lines: DataFrame) -> DataFrame:
    """Of each line the nearest line below in its column with a fifth of x-overlap; joins carry the page as equal key."""
    a, b = lines.alias("a"), lines.select(*PAGE, F.col("col").alias("b_col"), F.col("pi").alias("b_pi"), F.col("bbox").alias("b_box")).alias("b")
    ok = (F.col("col") == F.col("b_col")) & (F.col("pi") != F.col("b_pi")) & (F.col("b_box").y0 > F.col("bbox").y1 - 1) & (geom.x_overlap(F.col("bbox"), F.col("b_box")) >= 0.2)
    hit = a.join(b, PAGE).where(ok).groupBy(*PAGE, "pi").agg(F.min(F.col("b_box").y0).alias("below_y"))
    return lines.join(hit, [*PAGE, "pi"], "left")


def line_gaps(lines: DataFrame) -> DataFrame:
    w = Window.partitionBy(*PAGE, "col").orderBy("pi")
    return lines.withColumn("gap", F.col("bbox").y0 - F.lag(F.col("bbox").y1).over(w)).withColumn("pitch", F.col("bbox").y0 - F.lag(F.col("bbox").y0).over(w))


def reading_order(lines: DataFrame) -> DataFrame:
    w = Window.partitionBy(*PAGE).orderBy("col", F.col("bbox").y0, F.col("bbox").x0, "pi")
    return lines.withColumn("ord", F.row_number().over(w) - 1)


def paragraph_islands(lines: DataFrame) -> DataFrame:
    """Runs of lines of one column and size whose gaps are under 1.5 sizes: (page, col, para, n, bbox, chars)."""
    w = Window.partitionBy(*PAGE, "col").orderBy("pi")
    new = F.coalesce((F.col("gap") >= 1.5 * F.col("size")) | (F.col("size") != F.lag("size").over(w)), F.lit(True))
    islands = line_gaps(lines).withColumn("para", F.sum(new.cast("int")).over(w))
    return islands.groupBy(*PAGE, "col", "para").agg(F.count("*").alias("n_lines"), geom.bbox(F.col("bbox")).alias("bbox"), F.sum(F.length("text")).alias("chars"))


def protected(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Lines whose centre lies in a region of their page (doc_id, pno, region, rect), with the first such region."""
    hit = lines.join(regions, PAGE).where(geom.center_in(F.col("bbox"), F.col("rect"))).groupBy(*PAGE, "pi").agg(F.min("region").alias("region"))
    return lines.join(hit, [*PAGE, "pi"], "left")


def crosspage_groups(lines: DataFrame) -> DataFrame:
    """Last line of a page that runs on in the first line of the next page."""
    from quillspark.functions import text as T

    ends = lines.groupBy(*PAGE).agg(F.max_by("text", "pi").alias("last"), F.min_by("text", "pi").alias("head"))
    nxt = ends.select("doc_id", (F.col("pno") - 1).alias("pno"), F.col("head").alias("next"))
    ok = T.ends_open(F.col("last")) & T.starts_lower(F.col("next")) & ~F.col("next").rlike(T.CAPTION) & ~F.col("next").rlike(T.REFERENCE) & ~F.col("last").rlike(T.REFERENCE) & (F.length("last") + F.length("next") <= 1200)
    joined = F.when(F.col("last").rlike(r"[A-Za-z]-$") & F.col("next").rlike(r"^\p{Ll}"), F.concat(F.expr("substr(last, 1, length(last) - 1)"), "next")).otherwise(F.concat("last", F.lit("\n"), "next"))
    return ends.join(nxt, PAGE).where(ok).select(*PAGE, joined.alias("joined"))
