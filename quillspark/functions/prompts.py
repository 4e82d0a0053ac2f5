"""Texts that a model is given, names of outputs, masks and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HAN = "一-鿿"
KANA_HANGUL = "぀-ヿ가-힯"


def has_cjk(text: Column, with_kana: bool = True) -> Column:
    return text.rlike(f"[{HAN}{KANA_HANGUL if with_kana else ''}]")


def has_letters(text: Column) -> Column:
    """Latin with its accents, Greek or Cyrillic: lines break between words."""
    return text.rlike("[A-Za-zÀ-ɏͰ-ϿЀ-ӿḀ-῿]")


def masked(key: Column) -> Column:
    """First six and last four characters of a key of more than 12, nothing of a shorter one."""
    return F.when(F.coalesce(F.length(key), F.lit(0)) == 0, "").when(F.length(key) > 12, F.concat(F.substr(key, F.lit(1), F.lit(6)), F.lit("***"), F.right(key, F.lit(4)))).otherwise("***")


def output_name(stem: Column, tag: Column, bilingual: Column, extra: Column) -> Column:
    return F.concat(stem, F.when(bilingual, "-bilingual").otherwise(""), F.coalesce(extra, F.lit("")), F.lit("-"), tag, F.lit(".pdf"))


def page_list(pages: Column, most: int = 8) -> Column:
    """Page numbers from 1 as text, the first ``most`` of them."""
    shown = F.array_join(F.transform(F.slice(pages, 1, most), lambda p: (p + 1).cast("string")), ", ")
    return F.concat(shown, F.when(F.size(pages) > most, " …").otherwise(""))


def glossary_block(terms: Column) -> Column:
    """Terms (k, v) as lines of the prompt, in order; empty where there are none."""
    lines = F.transform(terms, lambda t: F.concat(F.lit("- "), t.k, F.lit(" => "), t.v))
    head = F.array(F.lit("Glossary (translate these terms EXACTLY as specified):"))
    return F.when(F.size(terms) > 0, F.array_join(F.concat(head, lines), "\n")).otherwise("")


def budget_rule(budgets: Column) -> Column:
    """Limits of the numbered texts that have one, as a line of the prompt; empty where none has."""
    parts = F.filter(F.transform(budgets, lambda b, i: F.when(b > 0, F.concat(F.lit("id "), (i + 1).cast("string"), F.lit(" <= "), b.cast("string")))), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.concat(F.lit("Length limits in characters: "), F.array_join(parts, ", "), F.lit("."))).otherwise("")


def system_prompt(rules: list[str], *more: Column) -> Column:
    """Fixed rules and those of the batch that are not empty, a line each."""
    return F.array_join(F.filter(F.array(*map(F.lit, rules), *more), lambda x: x != ""), "\n")


def two_views(stream: Column) -> Column:
    """Bytes as Latin-1 in lower case, and, if they hold NUL, once more without it: texts in two-byte codes show up."""
    plain = F.lower(F.decode(stream, "ISO-8859-1"))
    return F.when(F.contains(plain, F.lit("\0")), F.concat(plain, F.lit("\n"), F.replace(plain, F.lit("\0"), F.lit("")))).otherwise(plain)


def without_skewed(stream: Column, words: str) -> Column:
    """A content stream without its text blocks whose matrix is skewed or turned and that hold a word of the pattern.

    Blocks reach from BT to the next ET; the second and third number before Tm tell the skew.
    """
    marked = F.regexp_replace(stream, r"(?s)(BT\b.*?\bET)", "\x01$1\x02")
    skew = r"(?s)-?[\d.]+\s+(-?[\d.]+)\s+(-?[\d.]+)\s+-?[\d.]+\s+[-\d.]+\s+[-\d.]+\s+Tm"
    number = lambda x, k: F.abs(F.coalesce(F.nullif(F.regexp_extract(x, skew, k), F.lit("")).try_cast("double"), F.lit(0.0)))
    gone = lambda x: F.endswith(x, F.lit("\x02")) & ((number(x, 1) > 0.001) | (number(x, 2) > 0.001)) & F.lower(x).rlike(words)
    parts = F.split(F.replace(marked, F.lit("\x02"), F.lit("\x02\x01")), "\x01")
    return F.replace(F.array_join(F.filter(parts, lambda x: ~gone(x)), ""), F.lit("\x02"), F.lit(""))


# Phrases and words of watermarks, and what excuses a text that holds them.
WATERMARK_PHRASES = ("accepted manuscript", "author submitted manuscript", "author manuscript", "unpublished manuscript", "manuscript version")
WATERMARK_WORDS, NO_WATERMARK = ("preprint", "do not distribute", "for review only"), ("arxiv:", "arxiv.org", "doi:")


def watermark(low: Column) -> Column:
    """Whether a text in lower case holds a phrase, or a word that stands alone, and nothing that excuses it."""
    excused, hit = F.lit(False), low.rlike("(?<![a-z0-9])(?:" + "|".join(WATERMARK_WORDS) + ")(?![a-z0-9])")
    for part in NO_WATERMARK:
        excused = excused | F.contains(low, F.lit(part))
    for part in WATERMARK_PHRASES:
        hit = hit | F.contains(low, F.lit(part))
    return ~excused & hit


def stream_removals(streams: DataFrame, words: str, short: int = 500) -> DataFrame:
    """What is done with content streams (id, stream, is_annotation): removed whole, cleaned of skewed blocks, or kept, (id, action, stream).

    A short stream or an annotation with a watermark goes whole; of a longer one the skewed blocks that hold it.
    """
    low = two_views(F.col("stream").cast("binary"))
    whole = low.rlike(words) & ((F.length("stream") < short) | F.col("is_annotation"))
    clean = without_skewed(F.col("stream"), words)
    action = F.when(whole, "removed").when(clean != F.col("stream"), "cleaned").otherwise("kept")
    return streams.select("id", action.alias("action"), F.when(action == "removed", F.lit("")).otherwise(clean).alias("stream"))
