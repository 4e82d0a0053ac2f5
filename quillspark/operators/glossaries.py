"""Glossaries and provider tables: terms merged over files, settings filled where they are not given."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_terms(terms: DataFrame) -> DataFrame:
    """One row for each term of rows (file, line, term, dst), (pos, term, dst, file, n): the last definition counts, in the place of the first.

    ``pos`` orders terms as they first appear, over files and then lines; n is how often a term is defined.
    """
    at = F.struct("file", "line")
    one = terms.groupBy("term").agg(F.max_by(F.struct("dst", "file"), at).alias("x"), F.min(at).alias("pos"), F.count("*").alias("n"))
    return one.select("pos", "term", "x.dst", "x.file", "n")


def term_issues(terms: DataFrame) -> DataFrame:
    """What a user is told of rows (file, line, term, dst): repeated terms in a file and over files, and terms without a text."""
    within = Window.partitionBy("term", "file").orderBy("line")
    over = Window.partitionBy("term").orderBy("file", "line").rowsBetween(Window.unboundedPreceding, -1)
    rows = terms.withColumn("again", F.row_number().over(within) > 1).withColumn("before", F.min("file").over(over))
    issue = F.when(F.col("dst").isNull() | (F.trim("dst") == ""), "empty").when(F.col("again"), "repeated").when(F.col("before") < F.col("file"), "overrides")
    return rows.withColumn("issue", issue).where("issue is not null").select("file", "line", "term", "issue")


def filled(settings: DataFrame, presets: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Settings whose null values come from the preset of their key (case and blanks apart); given ones stay."""
    p = presets.select(F.col(key).alias("__key"), *(F.col(n).alias(f"__{n}") for n in names))
    rows = settings.join(F.broadcast(p), F.lower(F.trim(key)) == F.col("__key"), "left")
    return rows.withColumns({n: F.coalesce(n, f"__{n}") for n in names}).drop("__key", *(f"__{n}" for n in names))


def parse_glossary(text: str) -> list[tuple[int, str, str | None]]:
    """(line from 1, term, translation) of flat lines "term: translation"; a value that is not a text is None.

    Quotes round a term or value are taken off and make a text of anything; comments and blank lines are left out. A line
    without a colon, or one that is indented, is an error.
    """
    out = []
    for i, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#") or line.strip() == "---":
            continue
        if line[0] in " \t" or ":" not in line:
            raise ValueError(f"line {i}: not a term and its translation")
        quote = line[0] if line[0] in "\"'" and line[0] in line[1:] else ""
        end = line.index(quote, 1) + 1 if quote else line.index(":")
        term, value = line[:end].strip().strip("\"'" if quote else ""), line[end:].strip().removeprefix(":").strip()
        if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1:
            out.append((i, term, value[1:-1]))
            continue
        value = value.split(" #")[0].strip()
        plain = value and value[0] not in "[{&*!|>" and value.lower() not in ("true", "false", "yes", "no", "on", "off", "null", "~") and not value.replace(".", "", 1).replace("-", "", 1).isdigit()
        out.append((i, term, value if plain else None))
    return out


def glossary_files(root: str, depth: int = 2, suffixes: tuple[str, ...] = (".yaml", ".yml", ".json")) -> list[str]:
    """Glossary files under a folder, at most ``depth`` folders deep, sorted; a file stands for itself."""
    top = Path(root)
    if top.is_file():
        return [str(top)]
    found = [p for p in top.rglob("*") if p.is_file() and p.suffix.lower() in suffixes and len(p.relative_to(top).parts) <= depth + 1]
    return sorted(map(str, found))


def dump_terms(terms: list[tuple[str, str]]) -> str:
    """Terms in order as lines that ``parse_glossary`` reads; quoted where they would be read as something else."""
    def plain(x: str) -> str:
        safe = x == x.strip() and x and not any(c in x for c in ":#\"'\n") and x[0] not in "[{&*!|>-" and parse_glossary(f"k: {x}")[0][2] == x
        return x if safe else '"' + x.replace('"', "'") + '"'

    return "".join(f"{plain(k)}: {plain(v)}\n" for k, v in terms)


def known_tag(tag: Column, known: dict[str, str], fallback: str) -> Column:
    """Value of a small fixed table, the fallback's for what it has not."""
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(F.element_at(table, tag), F.lit(known[fallback]))
