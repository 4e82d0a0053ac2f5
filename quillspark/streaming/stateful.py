"""Streams with state for each document or job: batches sent when full, paragraphs held over a page break, job control.

State is bounded by what is open: unfilled batches, one paragraph, one word. Rows of a document are taken in their order
within a micro-batch; micro-batches must bring them in order. A row with ``last`` closes a document and frees its state; a
document without such a row stays open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPEN_END, LOWER_START = re.compile(r"[^.:;!?。：；？！\")\]'”’\s]\s*$"), re.compile(r"\s*[a-z0-9(\[{à-öø-ÿ]")


def full_batches(units: DataFrame, budget: int, size: int) -> DataFrame:
    """First-fit batches of a stream (doc_id, i, n, last): (doc_id, chars, units, items), sent as soon as they are full.

    A unit (n characters; null opens none and only carries ``last``) goes into the first open batch with fewer than
    ``size`` units and room in the ``budget`` (0: any), else into a new one. ``size`` units or the whole budget send it.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chars, items = ([*state.get[0]], [x.split(",") for x in state.get[1]]) if state.exists else ([], [])
        sent, ended = [], False
        rows = pd.concat(frames).sort_values("i", kind="stable").itertuples()
        for r in rows:
            ended = ended or bool(r.last)
            if pd.isna(r.n):
                continue
            at = next((k for k, c in enumerate(chars) if len(items[k]) < size and (budget <= 0 or c + r.n <= budget)), None)
            if at is None:
                at = len(chars)
                chars.append(0)
                items.append([])
            chars[at] += int(r.n)
            items[at].append(str(r.i))
            if len(items[at]) >= size or 0 < budget <= chars[at]:
                sent.append((chars.pop(at), items.pop(at)))
        if ended:
            sent += zip(chars, items, strict=True)
            if state.exists:
                state.remove()
        else:
            state.update((chars, [",".join(x) for x in items]))
        yield pd.DataFrame([(key[0], c, len(x), ",".join(x)) for c, x in sent], columns=["doc_id", "chars", "units", "items"])

    return units.groupBy("doc_id").applyInPandasWithState(run, "doc_id long, chars long, units int, items string", "chars array<long>, items array<string>", "append", GroupStateTimeout.NoTimeout)


def joined_pages(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs of a stream (doc_id, pno, pi, text, last) with those joined that run over a page break: (doc_id, pno, pi, text).

    The last paragraph is held back until the next one is known: it goes on there if that stands first on the next page,
    the end is open, the start is lower-case and both have 1200 characters at most. A hyphen at the end goes with the break.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        out, ended = [], False
        rows = pd.concat(frames).sort_values(["pno", "pi"], kind="stable").itertuples()
        for r in rows:
            ended, text = ended or bool(r.last), r.text or ""
            if held and r.pno == held[3] + 1 and OPEN_END.search(held[2]) and LOWER_START.match(text) and len(held[2]) + len(text) <= 1200:
                hyphen = re.search(r"[A-Za-z]-$", held[2]) and text[:1].islower()
                held = (held[0], held[1], held[2][:-1] + text if hyphen else f"{held[2]}\n{text}", int(r.pno))
                continue
            if held:
                out.append(held[:3])
            held = (int(r.pno), int(r.pi), text, int(r.pno))
        if ended:
            out += [held[:3]] if held else []
            if state.exists:
                state.remove()
        elif held:
            state.update(held)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["doc_id", "pno", "pi", "text"])

    return paragraphs.groupBy("doc_id").applyInPandasWithState(run, "doc_id long, pno int, pi int, text string", "pno int, pi int, text string, page int", "append", GroupStateTimeout.NoTimeout)


def control(commands: DataFrame) -> DataFrame:
    """State of each job after each command of a stream (job, event_id, cmd): running, paused, or cancelled for good."""
    moves = {"pause": "paused", "resume": "running", "cancel": "cancelled"}

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = state.get[0] if state.exists else "running", []
        for r in pd.concat(frames).sort_values("event_id", kind="stable").itertuples():
            now = now if now == "cancelled" else moves.get(r.cmd, now)
            out.append((key[0], r.event_id, now))
        state.update((now,))
        yield pd.DataFrame(out, columns=["job", "event_id", "state"])

    return commands.groupBy("job").applyInPandasWithState(run, "job long, event_id long, state string", "state string", "append", GroupStateTimeout.NoTimeout)
