"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, capitalised names and units become typed placeholders, so that a question asked again with other values has
the same template. Windows of a template are hashed and joined with the documents' windows; matched windows must then
fill each slot of an item in one consistent way, which a re-parameterised copy does and a chance match does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.scratch import Scratch

#: Units that follow a number.
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "ms", "min", "h", "hz", "khz", "w", "kw", "v", "j", "kj", "n", "pa", "mol", "percent", "usd", "eur", "dollars", "euros", "miles", "feet", "inches", "pounds", "hours", "minutes", "seconds", "days", "years", "meters", "metres", "kilometers", "kilometres", "grams", "kilograms", "litres", "liters")
#: Windows of a benchmark up to this count are broadcast (8 bytes of hash, item, position: under 64 MB); more are joined by shuffle.
BROADCAST_WINDOWS = 1_000_000
#: An occurrence also counts with a run of RUN_TOKENS matched tokens (an excerpt of a long item), or when this share of the item's tokens stands at its places (a short item with a word changed).
RUN_TOKENS, TOKEN_SHARE = 13, 0.8
_NUMBER, _WORD = r"\p{Nd}[\p{Nd}.,]*", r"[\p{L}\p{M}]+"


def raw_tokens(text: Column) -> Column:
    """Numbers and words of a text, in order."""
    return F.regexp_extract_all(text, F.lit(f"({_NUMBER}|{_WORD})"), F.lit(1))


def template_tokens(raw: Column, folded: bool = False) -> Column:
    """Tokens with numbers as 0, units right after a number as U and words that begin with a capital as A.

    ``folded``: capitals are lower-cased and no word counts as a name, so that a copy in another case has this template.
    Tokens are told apart by their first character; only those that begin outside ASCII need a regular expression.
    """
    other = lambda t, kind: (t >= "\x7f") & t.rlike(rf"^\p{{{kind}}}")
    number = lambda t: ((t >= "0") & (t < ":")) | other(t, "Nd")
    name = lambda t: ((t >= "A") & (t < "[")) | other(t, "Lu")

    def kind(t: Column, i: Column) -> Column:
        low = F.lower(t) if folded else t
        out = F.when(number(t), "0")
        out = out if folded else out.when(name(t), "A")
        return out.when(low.isin(*UNITS) & number(F.get(raw, i - 1)), "U").otherwise(low)

    return F.transform(raw, kind)


def _value(token: Column) -> Column:
    return F.regexp_replace(token, r"[.,]+$", "")


def _windows(df: DataFrame, keys: list[str], length: Column) -> DataFrame:
    """Rows (keys, length, pos, hash) of all windows of ``length`` tokens."""
    last = F.size("tokens") - length
    at = df.where(last >= 0).withColumn("length", length).withColumn("pos", F.explode(F.sequence(F.lit(0), last)))
    return at.select(*keys, "length", "pos", F.xxhash64(F.slice("tokens", F.col("pos") + 1, F.col("length"))).alias("hash"))


def _forms(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each form of a text, in which names are placeholders (0) or case is folded (1): (keys, form, tokens, raw)."""
    # raw passes through a generator, so that it is made once and not by each use
    cut = df.select(*keys, F.explode(F.array(raw_tokens(F.col("text")))).alias("raw"))
    forms = F.array(*(F.struct(F.lit(i).alias("form"), template_tokens(F.col("raw"), bool(i)).alias("tokens")) for i in (0, 1)))
    return cut.select(*keys, "raw", F.inline(forms))


def _leaks(docs: DataFrame, benchmark: DataFrame, window: int, coverage: float) -> DataFrame:
    """``contaminated`` with v, the hash of the text, which tells rows of one doc_id with different texts apart."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    items = items.withColumn("w", F.xxhash64("text"))
    tokens = _forms(items, ["item_id", "w"]).where(F.size("tokens") > 0)
    keyed = _windows(tokens, ["item_id", "w", "form"], F.least(F.size("tokens"), F.lit(window)))
    sizes = [r["length"] for r in keyed.select("length").distinct().collect()]  # at most ``window`` of them
    n_windows = keyed.groupBy("item_id", "w", "form").agg(F.countDistinct("hash").alias("windows"), F.max(F.col("pos") + F.col("length")).alias("n_tokens"))
    small = keyed.count() <= BROADCAST_WINDOWS
    bench = keyed.withColumnRenamed("pos", "item_pos")
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("v"), "text")
    length = F.explode(F.lit(sizes or [window]).cast("array<int>"))
    found = _windows(_forms(rows, ["doc_id", "v"]).drop("raw").withColumn("size", length), ["doc_id", "v", "form"], F.col("size"))
    found = found.join(F.broadcast(bench) if small else bench, ["form", "length", "hash"])
    spot = ["doc_id", "v", "item_id", "w", "form"]
    found = found.select(*spot, "hash", "pos", "item_pos", F.col("length").alias("item_length")).distinct()
    scratch = Scratch(docs.sparkSession, "leaks")
    found = scratch.keep(found, "found")  # read twice below; without it, all windows are made twice
    found = found.join(F.broadcast(n_windows) if small else n_windows, ["item_id", "w", "form"])
    spots = found.groupBy(*spot, "windows", "n_tokens", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.collect_set(F.struct("hash", "item_pos", "item_length")).alias("hits"))
    # the texts pass through the exchange once and unsorted, and each is cut into tokens once; the few candidates are the hashed side
    spots = spots.groupBy("doc_id", "v").agg(F.collect_list(F.struct("item_id", "w", "form", "windows", "n_tokens", "shift", "hits")).alias("spots"))
    spots = rows.join(spots.hint("shuffle_hash"), ["doc_id", "v"]).select("doc_id", "v", "spots", F.explode(F.array(raw_tokens(F.col("text")))).alias("doc_raw"))

    def placed_at(s: Column) -> Column:
        """A spot with the document's tokens at the item's places and the one before them, which tells units."""
        begin = F.greatest(s["shift"] - 1, F.lit(0))
        here = F.slice(F.col("doc_raw"), begin + 1, s["n_tokens"] + s["shift"] - begin)
        return F.struct(*(s[c].alias(c) for c in ("item_id", "w", "form", "windows", "hits")), (s["shift"] - begin).alias("shift"), here.alias("here"))

    # a row for each spot, of the item's length: with the whole text's tokens, the spots of a long text overflow the heap
    spots = spots.select("doc_id", "v", F.inline(F.transform("spots", placed_at))).withColumnRenamed("here", "doc_raw")
    spots = spots.withColumn("doc_tokens", F.when(F.col("form") == 0, template_tokens(F.col("doc_raw"))).otherwise(template_tokens(F.col("doc_raw"), True)))
    spots = spots.join(F.broadcast(tokens) if small else tokens, ["item_id", "w", "form"])
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h.item_pos, h.item_pos + h.item_length - 1))))
    slots = F.filter(covered, lambda p: F.element_at("tokens", p + 1).isin("0", "A", "U"))
    pairs = F.array_distinct(F.transform(slots, lambda p: F.struct(_value(F.element_at("raw", p + 1)).alias("x"), _value(F.element_at("doc_raw", p + F.col("shift") + 1)).alias("y"))))
    spots = spots.withColumn("slots", slots).withColumn("pairs", pairs)
    spots = spots.withColumn("agree", F.size(F.array_distinct(F.transform("pairs", lambda p: p.x))) == F.size("pairs")).where("agree")
    spots = spots.withColumn("same", ~F.exists("pairs", lambda p: p.x != p.y))
    at = F.transform("hits", lambda h: h.item_pos)
    n_run = F.lit(RUN_TOKENS - window + 1)  # windows that follow each other
    excerpt = F.exists(at, lambda p: F.size(F.array_intersect(at, F.sequence(p, p + n_run - 1))) == n_run) if window < RUN_TOKENS else F.lit(False)
    placed = F.size(F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda p: F.get("doc_tokens", p + F.col("shift")) == F.element_at("tokens", p + 1)))
    enough = excerpt | (placed >= TOKEN_SHARE * F.size("tokens"))
    out = spots.select(*spot, "windows", F.size("slots").alias("n_slots"), "same", enough.alias("enough"), F.explode("hits").alias("h"))
    out = out.groupBy(*spot, "windows").agg(F.bool_or("enough").alias("enough"), F.countDistinct("h.hash").alias("matched"), F.max("n_slots").cast("long").alias("n_slots"), (~F.bool_or("same")).alias("reworded"))
    out = out.where(F.col("enough") | (F.col("matched") >= coverage * F.col("windows")))
    # the better form of a row and item: unchanged slots first, then the most windows
    best = F.min(F.struct("reworded", (-F.col("matched")).alias("m"), "windows", (-F.col("n_slots")).alias("n")))
    out = out.groupBy("doc_id", "v", "item_id").agg(best.alias("x"))
    return out.select("doc_id", "v", "item_id", (-F.col("x.m")).alias("matched"), "x.windows", (-F.col("x.n")).alias("n_slots"), "x.reworded")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, coverage: float = 0.5) -> DataFrame:
    """Leaks: (doc_id, item_id, matched, windows, n_slots, reworded), a row for each document and item it holds.

    An item is found in a document when windows that make up at least ``coverage`` of its distinct windows occur there
    with consistent slots: along each occurrence (same offset between document and item) equal slot values of the item
    stand for equal values in the document; a number's trailing points and commas are no part of its value. An occurrence
    with ``RUN_TOKENS`` tokens in windows that follow each other, or ``TOKEN_SHARE`` of the item's tokens at their places,
    is enough alone. Texts are compared in two forms, with names as placeholders and with case folded; the form with
    unchanged slots, then with the most windows, is reported. ``reworded`` tells that in no occurrence all slots kept
    their values (case apart, in the folded form).

    * null or empty text, or none with a word or number: never in the result, on either side;
    * items of fewer tokens than ``window`` are matched as one window of their own length; items with the same template
      are all reported; null ids are left out;
    * repeated rows give one row; rows of one doc_id (or item_id) with different texts are judged by their own texts, and
      the best of them is reported for the id; other columns are ignored; empty tables give no rows;
    * texts of any length are read whole, and no window is dropped, however frequent.
    """
    out = _leaks(docs, benchmark, window, coverage)
    best = F.min(F.struct("reworded", (-F.col("matched")).alias("m"), "windows", (-F.col("n_slots")).alias("n")))
    out = out.groupBy("doc_id", "item_id").agg(best.alias("x"))
    return out.select("doc_id", "item_id", (-F.col("x.m")).alias("matched"), "x.windows", (-F.col("x.n")).alias("n_slots"), "x.reworded")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 8, coverage: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; rows with a null doc_id or text stay."""
    found = _leaks(docs, benchmark, window, coverage).select(F.col("doc_id").alias("__id"), F.col("v").alias("__v")).distinct()
    return docs.join(found, (docs.doc_id == found["__id"]) & (F.xxhash64(docs.text) == found["__v"]), "left_anti")


_SQL_TOKENS = r"regexp_extract_all(text, '\p{Nd}[\p{Nd}.,]*|[\p{L}\p{M}]+')"
_SQL_UNIT = "i > 1 AND regexp_matches(raw[i - 1], '^\\p{Nd}') AND %s IN (" + ", ".join(f"'{u}'" for u in UNITS) + ")"
_SQL_FORMS = (
    r"SELECT *, 0 AS form, list_transform(range(1, len(raw) + 1), lambda i: CASE WHEN regexp_matches(raw[i], '^\p{Nd}') THEN '0' WHEN regexp_matches(raw[i], '^\p{Lu}') THEN 'A'"
    + f" WHEN {_SQL_UNIT % 'raw[i]'} THEN 'U' ELSE raw[i] END) AS tok FROM t"
    + r" UNION ALL SELECT *, 1, list_transform(range(1, len(raw) + 1), lambda i: CASE WHEN regexp_matches(raw[i], '^\p{Nd}') THEN '0'"
    + f" WHEN {_SQL_UNIT % 'lower(raw[i])'} THEN 'U' ELSE lower(raw[i]) END) FROM t"
)
_PLACES = f"len(list_filter(range(0, len(b.tok)), lambda p: p + shift >= 0 AND d.tok[p + shift + 1] = b.tok[p + 1])) >= {TOKEN_SHARE} * len(b.tok)"
_RUN = f"len(list_filter(begins, lambda p: len(list_intersect(begins, range(p, p + {RUN_TOKENS - 7}))) = {RUN_TOKENS - 7})) > 0"
ORACLE = f"""
WITH d AS MATERIALIZED (WITH t AS (SELECT DISTINCT doc_id, md5(text) AS v, {_SQL_TOKENS} AS raw FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL) {_SQL_FORMS}),
b AS MATERIALIZED (WITH t AS (SELECT DISTINCT item_id, md5(text) AS w, {_SQL_TOKENS} AS raw FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL AND len({_SQL_TOKENS}) > 0) {_SQL_FORMS}),
bw AS (SELECT item_id, w, form, least(8, len(tok)) AS n, unnest(range(0, len(tok) - least(8, len(tok)) + 1)) AS p, tok FROM b),
bk AS (SELECT item_id, w, form, n, p, array_to_string(tok[p + 1:p + n], ' ') AS k FROM bw),
total AS (SELECT item_id, w, form, count(DISTINCT k) AS windows FROM bk GROUP BY ALL),
dw AS (SELECT doc_id, v, form, n, unnest(range(0, len(tok) - n + 1)) AS p, tok FROM d, (SELECT DISTINCT n FROM bk) WHERE len(tok) >= n),
dk AS (SELECT doc_id, v, form, n, p, array_to_string(tok[p + 1:p + n], ' ') AS k FROM dw),
hit AS (SELECT DISTINCT doc_id, v, item_id, w, form, k, bk.p AS bp, dk.p - bk.p AS shift, n FROM dk JOIN bk USING (form, n, k)),
pos AS (SELECT DISTINCT doc_id, v, item_id, w, form, shift, unnest(range(bp, bp + n)) AS p FROM hit),
slot AS (SELECT doc_id, v, item_id, w, form, shift, p, rtrim(b.raw[p + 1], '.,') AS x, rtrim(d.raw[p + shift + 1], '.,') AS y FROM pos JOIN b USING (item_id, w, form) JOIN d USING (doc_id, v, form) WHERE b.tok[p + 1] IN ('0', 'A', 'U')),
spot AS (SELECT doc_id, v, item_id, w, form, shift, count(DISTINCT p) AS slots, count(DISTINCT x) = count(DISTINCT (x, y)) AS agree, bool_and(x = y) AS same FROM slot GROUP BY ALL),
place AS (SELECT doc_id, v, item_id, w, form, shift, list(DISTINCT bp) AS begins FROM hit GROUP BY ALL),
whole AS (SELECT doc_id, v, item_id, w, form, shift, {_RUN} OR {_PLACES} AS enough FROM place JOIN b USING (item_id, w, form) JOIN d USING (doc_id, v, form)),
judged AS (SELECT doc_id, v, item_id, w, form, count(DISTINCT k) AS matched, any_value(windows) AS windows, CAST(max(coalesce(slots, 0)) AS BIGINT) AS n_slots, NOT bool_or(coalesce(same, true)) AS reworded, bool_or(enough) AS enough
  FROM hit JOIN total USING (item_id, w, form) JOIN whole USING (doc_id, v, item_id, w, form, shift) LEFT JOIN spot USING (doc_id, v, item_id, w, form, shift) WHERE coalesce(agree, true) GROUP BY ALL),
best AS (SELECT doc_id, item_id, min({{'r': reworded, 'm': -matched, 'w': windows, 'n': -n_slots}}) AS x FROM judged WHERE enough OR matched >= 0.5 * windows GROUP BY ALL)
SELECT doc_id, item_id, -x.m AS matched, x.w AS windows, -x.n AS n_slots, x.r AS reworded FROM best
"""
