"""Style expressions: title forms, largest span, CSS text, factors, budgets and the room below a box."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.geom import area, rect, shared_area

#: Line height by style class; every other class has the last one.
LINE_HEIGHT = {"title": 1.22, "sec_title": 1.22, "ref_entry": 1.22, "subsec_title": 1.28, "head_plain": 1.28}
LINE_HEIGHT_ELSE = 1.35


def section_title(text: Column) -> Column:
    """A roman number and a short line of which four fifths of the letters are capitals."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    return (F.length(text) <= 64) & text.rlike(r"^[IVX]+[.)]?\s+\S") & (letters > 0) & (capitals >= 0.8 * letters)


def largest_span(spans: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(spans, lambda s: s.size)), F.lit(0.0))


def line_height(cls: Column) -> Column:
    out = F.lit(LINE_HEIGHT_ELSE)
    for name, h in LINE_HEIGHT.items():
        out = F.when(cls == name, F.lit(h)).otherwise(out)
    return out


def style_class(text: Column, size: Column, body: Column, heading: Column, caption: Column, reference: Column) -> Column:
    """Class of a paragraph, the first that fits: title, sec_title, subsec_title, abstract, head_plain, caption, ref_entry, body."""
    t = F.trim(text)
    return (
        F.when(heading & (size > 1.3 * body), "title")
        .when((heading | section_title(t)) & t.rlike(r"^[IVX]+[.)]?\s+\S"), "sec_title")
        .when(heading & t.rlike(r"^[A-D][.)]\s+\S"), "subsec_title")
        .when(t.rlike(r"^(?i)(abstract|index terms)"), "abstract")
        .when(heading, "head_plain")
        .when(caption, "caption")
        .when(reference, "ref_entry")
        .otherwise("body")
    )


def char_budget(box: Column, size: Column, height: Column, cjk: bool, latin_width: float = 0.5) -> Column:
    """Characters that a box holds at a size and line height, a little under its area over a character's."""
    width = size * (1.0 if cjk else latin_width)
    return F.floor((box.x1 - box.x0) / width * ((box.y1 - box.y0) / (size * F.greatest(height, F.lit(0.8)))) * 0.92).cast("int")


def room_below(box: Column, below_y: Column, page_height: Column) -> Column:
    """The box with its lower edge 2 points above what comes next and the page's end, never raised."""
    low = F.greatest(box.y1, F.least(F.coalesce(below_y, page_height) - 2, page_height - 2))
    return rect(box.x0, box.y0, box.x1, low)


def mostly_covered(box: Column, graphics: Column, share: float = 0.3) -> Column:
    """Whether one of the rectangles of an array covers more than a share of the box."""
    return F.exists(graphics, lambda g: shared_area(box, g) > share * area(box))


def paragraph_css(family: Column, size: Column, height: Column, align: Column, indent: Column, factor: Column, lead: Column, tracking: Column) -> Column:
    """A paragraph's rule: size and line height scaled, letters closer where tracking is under 1."""
    scaled = size * factor
    spacing = F.when(tracking < 1, F.concat(F.lit("letter-spacing:"), F.format_string("%.3f", (tracking - 1) * scaled), F.lit("pt;"))).otherwise(F.lit(""))
    return F.concat(F.lit("p{font-family:"), family, F.lit(";font-size:"), F.format_string("%.2f", scaled), F.lit("pt;line-height:"), F.format_string("%.3f", height * lead), F.lit(";text-align:"), align, F.lit(";text-indent:"), F.format_string("%.2f", indent * scaled), F.lit("pt;margin:0;"), spacing, F.lit("}"))


def factors_of(own: Column, of_class: Column, can_shrink: Column) -> Column:
    """(factor, lead, tracking) of a paragraph: its own, else its class's (whose factor holds only if it may shrink), else 1."""
    one = F.lit(1.0)
    factor = F.coalesce(own.factor, F.when(can_shrink, of_class.factor), one)
    return F.struct(factor.alias("factor"), F.coalesce(own.lead, of_class.lead, one).alias("lead"), F.coalesce(own.tracking, of_class.tracking, one).alias("tracking"))
