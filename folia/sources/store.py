"""Where ingest keeps a library: a folder for each attempt, and marks that say which attempt is which generation."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

MARKS = "_generations"


def table_paths(spark: SparkSession, path: str, names) -> dict[str, str]:
    """Folders of the tables in the latest generation; a table that was never written is left out."""
    fs, base = _filesystem(spark, path)
    _, folder = latest(spark, path)
    return {name: f"{path}/{folder}/{name}" for name in names if folder and fs.exists(base.suffix(f"/{folder}/{name}/_SUCCESS"))}


def latest(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """The highest generation that was committed, and its folder; 0 and None before the first."""
    fs, base = _filesystem(spark, path)
    marks = base.suffix(f"/{MARKS}")
    names = [s.getPath().getName() for s in fs.listStatus(marks)] if fs.exists(marks) else []
    found = [n.split("-", 1) for n in names if n.split("-", 1)[0].isdigit()]
    generation, attempt = max(((int(n), a) for n, a in found), default=(0, None))
    return generation, attempt and f"g{generation}-{attempt}"


def attempt(generation: int) -> str:
    """A folder that no other attempt at this generation has: what a failed one leaves is in nobody's way."""
    return f"g{generation}-{uuid.uuid4().hex[:12]}"


def commit(spark: SparkSession, path: str, folder: str) -> None:
    """Publish a folder by a mark of its name. Of two attempts at one generation the one that comes second is refused."""
    fs, base = _filesystem(spark, path)
    generation = int(folder[1:].split("-", 1)[0])
    if latest(spark, path)[0] >= generation:
        raise RuntimeError(f"generation {generation} of {path} was committed by another ingest")
    fs.mkdirs(base.suffix(f"/{MARKS}"))
    fs.create(base.suffix(f"/{MARKS}/{folder[1:]}")).close()


def _filesystem(spark: SparkSession, path: str):
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    return base.getFileSystem(spark._jsc.hadoopConfiguration()), base
