"""Tables written between the steps of an operator, in the folder the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Scratch folders that still hold tables, in the order they were made.
_live: list[Scratch] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset (local runs, tests) a new temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Writes tables under one new subfolder and removes them when they are no longer needed.

    A written table cuts the lineage: a lost executor costs its running tasks only, never an earlier step. An operator
    drops each table once no step reads it; tables that its result still reads stay until ``release`` or the end of the
    driver's process.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._path, self._conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        self._names: set[str] = set()
        _live.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        self._names.add(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        path = self._path(path)
        path.getFileSystem(self._conf).delete(path, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._names.discard(name)
            self._delete(f"{self.root}/{name}")

    def keep_only(self, *names: str) -> None:
        self.drop(*(self._names - set(names)))

    def clear(self) -> None:
        self._delete(self.root)


def mark() -> int:
    """A point in time for ``release``."""
    return len(_live)


def release(since: int) -> None:
    """Removes all scratch folders made since ``mark``; what reads them must have been written elsewhere."""
    while len(_live) > since:
        _live.pop().clear()


@atexit.register
def _at_exit() -> None:
    try:
        release(0)
    except Exception:  # noqa: BLE001, S110 - the gateway may be gone; the folder is the cluster's to empty then
        pass
