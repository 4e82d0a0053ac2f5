"""Files: whole documents with fingerprints, JSON lines of a worker, control files, configuration, and what is written back."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "kind string, job bigint, done int, total int, stage string, message string"


def binary_documents(spark: SparkSession, path: str, glob: str = "*", depth: int | None = None) -> DataFrame:
    """Files under a folder, (path, length, fingerprint), at most ``depth`` folders deep: content is read on executors only."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", "length", F.md5("content").alias("fingerprint"))
    if depth is None:
        return rows
    top = F.length(F.lit(path.rstrip("/").removeprefix("file:"))) + 1
    inner = F.substr(F.regexp_replace("path", "^[a-z]+:/*(?=/)", ""), top)
    return rows.where(F.length(inner) - F.length(F.replace(inner, F.lit("/"), F.lit(""))) <= depth + 1)


def json_events(lines: DataFrame, schema: str = EVENT) -> DataFrame:
    """Events of a worker's output lines (value): what is no JSON object with a kind is skipped. Works on streams too."""
    got = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    return got.where("kind is not null")


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New lines of the files in a folder as events."""
    return json_events(spark.readStream.format("text").load(folder))


def write_events(events: DataFrame, folder: str, checkpoint: str):
    """A streaming query that appends events as JSON lines; each batch is committed whole."""
    return events.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def sse_frames(events: DataFrame) -> DataFrame:
    """Events (eid, …) as frames of a server-sent stream, (eid, frame): the id line lets a client go on after it."""
    data = F.to_json(F.struct(*(c for c in events.columns if c != "eid")))
    return events.select("eid", F.concat(F.lit("id: "), F.col("eid").cast("string"), F.lit("\ndata: "), data, F.lit("\n\n")).alias("frame"))


def new_commands(text: str, offset: int) -> tuple[list[str], int]:
    """Whole lines of a control file behind an offset in bytes, and the offset after them; a line without its end waits."""
    data = text.encode()[offset:]
    end = data.rfind(b"\n") + 1
    return [x for x in data[:end].decode("utf-8", "replace").splitlines() if x.strip()], offset + end


def write_atomically(path: str, data: bytes) -> None:
    """The file is there whole or as it was before: written beside and renamed."""
    beside = f"{path}.tmp"
    with open(beside, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(beside, path)


# What settings may say.
CHOICES = {"mode": ("faithful", "reflow"), "engine": ("heuristic", "external"), "overlap": ("auto", "on", "off"), "ocr": ("off", "appendix", "inplace")}


@dataclass(frozen=True)
class Settings:
    """Settings of a run; ``load`` reads them from JSON and says what is wrong with them."""

    pages: str = ""
    source: str = "en"
    target: str = "zh"
    mode: str = "faithful"
    engine: str = "heuristic"
    overlap: str = "auto"
    ocr: str = "off"
    bilingual: bool = False
    provider: str = ""
    batch_chars: int = 3000
    batch_size: int = 6
    max_calls: int = 10
    models: tuple[str, ...] = field(default=())

    @classmethod
    def load(cls, text: str) -> Settings:
        """Settings of a JSON object; on and off for a choice may come as true and false. Anything else is an error by name."""
        given = json.loads(text or "{}")
        if not isinstance(given, dict):
            raise ValueError("settings are one object")
        known = {f.name: f for f in fields(cls)}
        if unknown := sorted(set(given) - set(known)):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        for name, allowed in CHOICES.items():
            value = given.get(name, known[name].default)
            value = {True: "on", False: "off"}.get(value, value) if isinstance(value, bool) else value
            if value not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
            given[name] = value
        for name, f in known.items():
            if isinstance(f.default, int) and not isinstance(f.default, bool) and (not isinstance(given.get(name, 0), int) or given.get(name, 0) < 0):
                raise ValueError(f"{name} must be a number that is not negative")
        given["models"] = tuple(given.get("models", ()))
        out = cls(**given)
        if out.mode == "reflow" and out.bilingual:
            raise ValueError("reflow has no bilingual output")
        return out

    def overlaps(self, client: bool, n_pages: int) -> bool:
        """Whether translation begins while pages are still laid out: never without a client; auto from 12 pages of the own layout on."""
        if not client or self.overlap == "off":
            return False
        return self.overlap == "on" or (n_pages >= 12 and self.engine == "heuristic")


class Engines:
    """Named engines (layout, reading, clients) with what makes them; one that can't be made is left out, and the fallback is used."""

    def __init__(self, fallback: str):
        self.fallback, self._makers, self._made = fallback, {}, {}

    def add(self, name: str, make) -> None:
        self._makers[name] = make

    def available(self, name: str) -> bool:
        if name not in self._made and name in self._makers:
            try:
                self._made[name] = self._makers[name]()
            except (ImportError, OSError):
                del self._makers[name]
        return name in self._made

    def get(self, name: str) -> tuple[object, bool]:
        """The engine, and whether it is the fallback for the one that was asked for."""
        if self.available(name):
            return self._made[name], False
        if not self.available(self.fallback):
            raise ValueError(f"no engine {name} and no {self.fallback}")
        return self._made[self.fallback], True


def glossary_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, line, term, dst) of glossary files, for ``glossaries.merged_terms``; a value that is no text is null."""
    from quillspark.operators.glossaries import parse_glossary

    rows = [(i, Path(p).name, *x) for i, p in enumerate(paths) for x in parse_glossary(Path(p).read_text(encoding="utf-8"))]
    return spark.createDataFrame([(f"{i:06d}/{name}", line, term, dst) for i, name, line, term, dst in rows], "file string, line int, term string, dst string")
