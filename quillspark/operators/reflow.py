"""Output side: style factors of typesetting classes and HTML of block streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADINGS = ("title", "sec_title", "subsec_title", "head_plain")
EPS, SYSTEMIC, MARGIN = 0.004, 0.3, 0.998
TAGS = {"title": "h1", "sec_title": "h2", "subsec_title": "h3"}
CLASSES = {"head_plain": "hp", "abstract": "abs", "caption": "caption", "ref_entry": "ref"}


def fit_ladder(steps: list[float], tracking: float) -> list[tuple[float, float]]:
    """Levels of (leading, tracking): none, each step from the mildest, and the last one with tracking."""
    leads = sorted({max(s, 0.8) for s in steps if s < 1}, reverse=True)
    levels = [(1.0, 1.0), *((s, 1.0) for s in leads)]
    return levels + [(leads[-1], tracking)] if leads and tracking < 1 else levels


def style_factors(specs: DataFrame, keys: list[str], steps: list[float], tracking: float, min_scale: float = 0.78) -> DataFrame:
    """Size factor, leading and tracking of each class: (keys, cls, n, n_tight, factor, lead, tracking).

    ``specs`` are paragraphs (keys, cls, ratio): area of the box over the area that the text needs. A class in which
    fewer than 30 % do not fit is left as it is. Else levels of the ladder are tried until all fit; what then is still too
    large shrinks the class, but not under ``min_scale``. Headings have two more levels and never shrink. Enlarging a
    class with much room is not included: that needs the layout engine's own measure.
    """
    plain, heading = fit_ladder(steps, tracking), fit_ladder([*steps, *(s for s in (0.88, 0.85) if not steps or s < min(steps))], tracking)
    plain = plain + [plain[-1]] * (len(heading) - len(plain))
    is_heading = F.col("cls").isin(*HEADINGS)

    def at(level: int, part: int) -> Column:
        return F.when(is_heading, heading[level][part]).otherwise(plain[level][part])

    rows = specs
    for i in range(len(heading)):
        fit = F.least(F.lit(1.0), F.sqrt(F.col("ratio") / (at(i, 0) * at(i, 1))))
        rows = rows.withColumn(f"v{i}", fit if i == 0 else F.when(F.col(f"v{i - 1}") >= 1 - EPS, F.col(f"v{i - 1}")).otherwise(fit))
    classes = rows.groupBy(*keys, "cls").agg(F.count("*").alias("n"), F.count_if(F.col("v0") < 1 - EPS).alias("n_tight"), *(F.min(f"v{i}").alias(f"m{i}") for i in range(len(heading))))
    last = len(heading) - 1
    chosen = F.lit(last)
    for i in range(last - 1, 0, -1):
        chosen = F.when(F.col(f"m{i}") >= 1 - EPS, i).otherwise(chosen)
    out = classes.withColumn("level", F.when(F.col("n_tight") / F.col("n") >= SYSTEMIC, chosen).otherwise(0))
    low = F.element_at(F.array(*(F.col(f"m{i}") for i in range(len(heading)))), F.col("level") + 1)
    factor = F.when((F.col("level") == 0) | is_heading | (low >= 1), 1.0).when(low < min_scale, min_scale).otherwise(low * MARGIN)
    pick = [F.element_at(F.when(is_heading, F.array(*(F.lit(x[k]) for x in heading))).otherwise(F.array(*(F.lit(x[k]) for x in plain))), F.col("level") + 1) for k in (0, 1)]
    return out.select(*keys, "cls", "n", "n_tight", F.round(factor, 6).alias("factor"), pick[0].alias("lead"), pick[1].alias("tracking"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def block_html(kind: Column, cls: Column, text: Column, img: Column, caption: Column, extra: Column, width: Column, cjk: bool) -> Column:
    """HTML of one block: lists as they are, formulas and figures as images, captions over tables and under figures, else a paragraph."""
    size = F.format_string("%.1f", width)
    picture = F.concat(F.lit('<img src="'), img, F.lit('" style="width:'), size, F.lit('pt"></p>'))
    note = F.when(F.length(caption) > 0, F.concat(F.lit("<p class=caption>"), escape(caption), F.lit("</p>"))).otherwise("")
    shown = F.concat(F.lit("<p class=fc>"), picture)
    inner = F.when((kind == "table") & (F.length(extra) > 0), F.concat(note, extra)).when(kind == "table", F.concat(note, shown)).otherwise(F.concat(shown, note))
    tag, css = F.lit("p"), F.lit(' class="ti"' if cjk else "")
    css = F.when(cls == "body", css).otherwise("")
    for name, short in CLASSES.items():
        css = F.when(cls == name, f" class={short}").otherwise(css)
    for name, head in TAGS.items():
        tag = F.when(cls == name, head).otherwise(tag)
    paragraph = F.concat(F.lit("<"), tag, css, F.lit(">"), escape(text), F.lit("</"), tag, F.lit(">"))
    return F.when(kind == "list", extra).when(kind == "formula", F.concat(F.lit("<p class=fx>"), picture)).when(kind.isin("figure", "verbatim", "table"), F.concat(F.lit("<div class=fig>"), inner, F.lit("</div>"))).otherwise(paragraph)


def html_documents(blocks: DataFrame, key: str, col_width: float, cjk: bool = False) -> DataFrame:
    """(key, html): the blocks (key, i, kind, cls, text, img, caption, extra, width) of each document in order of i."""
    part = block_html(*(F.col(c) for c in ("kind", "cls", "text", "img", "caption", "extra")), F.least("width", F.lit(col_width)), cjk)
    out = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", part.alias("h")))).alias("s"))
    return out.select(key, F.array_join(F.transform("s", lambda s: s.h), "").alias("html"))
