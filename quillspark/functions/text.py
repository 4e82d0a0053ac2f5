"""Text expressions: keys, flags, sentences, tokens, splits and glossary rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAPTION = r"^(?i)(fig(ure)?\.?\s|table\s)"
REFERENCE = r"^\[\d+\]"
REFERENCES_END = r"(?i)references[\s.:]*$"
# What list items begin with; longest labels are two digits, four roman digits, or one letter up to h.
BULLETS = "•·◦‣▪●▸‧"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫"
OPENING, CLOSING, BEHIND_LABEL = "([（【", ")]）】", ".、："
LABELS = (r"\d{1,2}", "[ivxIVX]{1,4}", "[a-hA-H]")


def _one_of(chars: str) -> str:
    return "[" + "".join("\\" + c if c.isascii() else c for c in chars) + "]"


LABEL = "(?:" + "|".join(LABELS) + ")"
LIST_FAMILIES = {
    "label in brackets": f"{_one_of(OPENING)}?{LABEL}{_one_of(CLOSING)}(?:\\s|{_one_of(BEHIND_LABEL)})",
    "circled number": _one_of(CIRCLED),
    "bullet": _one_of(BULLETS) + r"\s",
    "number and text": r"\d{1,2}[.)]\s+\S",
}
LIST_ITEM = r"^\s*(?:" + "|".join(LIST_FAMILIES.values()) + ")"
#: The label of a list item as it is taken off; its text is left.
LIST_LABEL = rf"^\s*(?:{_one_of(OPENING)}?{LABEL}{_one_of(CLOSING)}?(?:\s|{_one_of(BEHIND_LABEL)})|{_one_of(CIRCLED)}|{_one_of(BULLETS)}\s?)\s*"
CJK = r"[一-鿿㐀-䶿぀-ヿ가-힯]"


def cache_key(*parts: Column | str) -> Column:
    """md5 over the parts with bars between them; null counts as empty."""
    return F.md5(F.concat_ws("|", *(F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts)))


def sentences(text: Column) -> Column:
    """Split behind . ! ? and white space, and behind CJK full stops; blank parts go."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+|(?<=[。！？])"), lambda s: F.length(F.trim(s)) > 0)


def tokens(text: Column) -> Column:
    """CJK characters, words, runs of white space as one space, any other character."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?U)({CJK}|[\w'’\-&&[^一-鿿㐀-䶿぀-ヿ가-힯]]+|\s+|.)"), F.lit(1)), lambda t: F.when(t.rlike(r"^\s+$"), F.lit(" ")).otherwise(t))


def ends_open(text: Column) -> Column:
    t = F.regexp_replace(text, r"\s+$", "")
    return (F.length(t) > 0) & ~t.rlike(r"[.:;!?。：；？！\")\]'”’]$")


def starts_lower(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+", "").rlike(r"^[\p{Ll}\p{Nd}(\[{]")


def math_fragment(text: Column) -> Column:
    return (F.length(text) <= 8) & text.rlike("[=<>]") & ~text.rlike("[A-Za-z]{4}")


def placeholders(text: Column) -> Column:
    """Sorted multiset of [FORMULA_n] numbers, as strings."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(r"\[FORMULA_(\d+)\]"), F.lit(1)))


def split_at(text: Column, ratio: Column) -> Column:
    """Position of the cheapest cut: distance from the ratio, plus 0 behind a stop or space, 2 before a conjunction, else 6."""
    n = F.length(text)
    costs = F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.struct((F.abs(i - n * ratio) + F.when(F.substr(text, i, F.lit(1)).isin(*" ，。；：、）】"), 0.0).when(F.substr(text, i + 1, F.lit(1)).isin(*"且和或与并而但及又以"), 2.0).otherwise(6.0)).alias("cost"), i.alias("i")),
    )
    return F.when(ratio <= 0, 0).when(ratio >= 1, n).when(n < 2, n).otherwise(F.array_min(costs).i)


def glossary_misses(source: Column, terms: list[tuple[str, str]]) -> Column:
    """Terms of the source text that stand there although their translation does not."""
    gl = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in terms))
    return F.transform(F.filter(gl, lambda g: F.contains(source, g.k) & ~F.contains(source, g.v)), lambda g: g.k)


def glossary_fix(text: Column, terms: list[tuple[str, str]]) -> Column:
    """Terms in order: the first occurrence is replaced, unless the translation is there."""
    for k, v in terms:
        at = F.instr(text, k)
        text = F.when((at > 0) & ~F.contains(text, F.lit(v)), F.concat(F.substr(text, F.lit(1), at - 1), F.lit(v), F.substr(text, at + F.lit(len(k))))).otherwise(text)
    return text


# Characters no line starts with, characters no line ends with, wide characters.
NO_START = "，。、；：？！」』）】〉》〕〗〙％‰.,;:?!)]}%·…—~"
NO_END = "（「『【〈《〔〖〘([{‘“"
KANA_HAN_HANGUL = "一-鿿぀-ヿ가-힯"
WIDE = "一-鿿　-〿！-￮‘’“”…"


def char_class(chars: str) -> str:
    return "".join("\\" + c if c.isascii() else c for c in chars)


def clean_text(text: Column) -> Column:
    """One line: lines trimmed, bullets and blank lines dropped, joined by a space, or by nothing between CJK; no space inside CJK."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, rf"^[ \t\u00a0]*[{BULLETS}]*[ \t\r\f\u00a0]*", ""), r"[ \t\r\f\u00a0]+$", ""))
    joined = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    joined = F.regexp_replace(joined, rf"(?<=[{KANA_HAN_HANGUL}{char_class(NO_START)}])\n(?=[{KANA_HAN_HANGUL}{char_class(NO_END)}])", "")
    return F.regexp_replace(F.replace(joined, F.lit("\n"), F.lit(" ")), rf"(?<=[{WIDE}])[ \t\u00a0]+(?=[{WIDE}])", "")


def monospaced(spans: Column, mono: str) -> Column:
    return F.exists(spans, lambda s: s.font.rlike(f"(?i){mono}|courier|consol"))


# Parts of the names of bold fonts, and how lines of algorithms begin.
BOLD_PARTS, BOLD_END = ("cmbx", "bold", "hei", "mt-b"), "-b"
ALGORITHM_PHRASES = ("Break out of", "End for", "End while", "End if")
ALGORITHM_WORDS, ALGORITHM_WORDS_ALONE = ("for", "if", "while", "return"), ("else", "Sample", "Initialise")


def font_is_bold(font: Column) -> Column:
    low = F.lower(font)
    found = F.endswith(low, F.lit(BOLD_END))
    for part in BOLD_PARTS:
        found = found | F.contains(low, F.lit(part))
    return found


def algorithm_line(text: Column) -> Column:
    """A line that begins with a phrase, or with a word of an algorithm (some of them only before white space)."""
    word = F.regexp_extract(text, r"^(\w+)", 1)
    found = word.isin(*ALGORITHM_WORDS_ALONE) | (word.isin(*ALGORITHM_WORDS) & text.rlike(r"^\w+\s"))
    for phrase in ALGORITHM_PHRASES:
        found = found | F.startswith(text, F.lit(phrase))
    return found


def bold_share(spans: Column) -> Column:
    """Share of the characters of spans (text, font, flags) that are bold; empty spans weigh one."""
    weight = lambda s: F.greatest(F.length(s.text), F.lit(1))
    bold = lambda s: font_is_bold(s.font) | (s.flags.bitwiseAND(16) > 0)
    total = lambda keep: F.aggregate(F.filter(spans, keep), F.lit(0), lambda a, s: a + weight(s))
    return F.try_divide(total(bold), total(lambda s: F.lit(True)))


def algorithm_body(text: Column, spans: Column) -> Column:
    """A numbered algorithm of several lines, monospaced or with input, for and do."""
    low = F.lower(text)
    several = F.contains(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("\n"))
    typical = F.contains(F.substr(low, F.lit(1), F.lit(80)), F.lit("input")) & F.contains(low, F.lit("for")) & F.contains(low, F.lit("do"))
    return text.rlike(r"^\s*Algorithm\s+\d+\s*:") & several & (monospaced(spans, r"mono|mon\b") | typical)


def algorithm_rest(text: Column, spans: Column) -> Column:
    """A loose line of an algorithm: keyword at its start unless bold, formula fragment, monospaced, or numbered; 200 characters at most."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    keyword = algorithm_line(t) & ~(F.coalesce(bold_share(spans), F.lit(0.0)) >= 0.5)
    return (F.length(t) <= 200) & (keyword | math_fragment(t) | monospaced(spans, "mon") | t.rlike(r"^\d+\s*[%\s]|^%\s"))
