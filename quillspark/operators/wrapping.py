"""Lines of mixed scripts at a width, and how alike two texts are: both need a state that runs along the text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import partial

import pandas as pd
import regex
from pyspark.sql import DataFrame

from quillspark.functions import text as T

_TOKEN = regex.compile(rf"{T.CJK}|[\w'’\-&&[^\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Hangul}}]]+|\s+|.", regex.V1 | regex.S)
_WIDE = regex.compile(f"[{T.WIDE}぀-ヿ가-힯]")


def char_width(char: str, size: float, latin: float = 0.5) -> float:
    """Width of a character without a font: wide ones are as wide as high, others ``latin`` of it."""
    return size if _WIDE.match(char) else size * latin


def wrap(text: str, width: float, measure: Callable[[str], float], indent: float = 0.0) -> list[str]:
    """Lines of a text: words stay whole, CJK breaks anywhere but before what no line starts with and behind what no line ends with.

    A single mark that no line may start with stays on the line if it is at most 2 % too wide then; opening brackets move on
    with what follows. A word wider than a line is cut. The first line is shorter by the indent.
    """
    size_of: Callable[[str], float] = lambda s: sum(map(measure, s))
    lines, line, room = [], "", width - indent

    def close(rest: str = "") -> None:
        nonlocal line, room
        if line.strip():
            lines.append(line.rstrip())
        line, room = rest, width

    for token in _TOKEN.findall(text):
        if token.isspace():
            line += " " if line else ""
            continue
        wide = size_of(token)
        if wide > width:
            close()
            for char in token:
                if line and size_of(line + char) > width:
                    close()
                line += char
        elif not line or size_of(line) + wide <= room:
            line += token
        elif len(token) == 1 and token in T.NO_START:
            if size_of(line) + wide <= width * 1.02:
                line += token
            else:
                close(token)
        else:
            kept = line.rstrip(T.NO_END) if line[-1:] in T.NO_END else line
            moved, line = line[len(kept) :], kept
            close(moved + token)
    close()
    return lines


def wrapped(texts: DataFrame, key: str, width: float, size: float, indent: float = 0.0) -> DataFrame:
    """(key, i, line) of texts (key, text) at a width in points; null and blank texts give no lines."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, x) for k, t in zip(pdf[key], pdf["text"], strict=True) for i, x in enumerate(wrap(t or "", width, partial(char_width, size=size), indent))]
            yield pd.DataFrame(rows, columns=[key, "i", "line"])

    return texts.select(key, "text").mapInPandas(run, f"{key} {kind}, i int, line string")


def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of two texts in matching blocks, twice the matched characters over both lengths; case apart."""
    return pd.Series([SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b, strict=True)], dtype=float)
