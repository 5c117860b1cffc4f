"""Index generations: versioned snapshot folders with a manifest as the commit point.

A generation's tables are written to a folder of their own, and only then one
line about them is added to the manifest table. Readers take the newest line;
a folder without one, of a build that failed or still runs, is never read, and
a reader that holds a generation keeps its folder while others are published.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pipeline import _folder, exists

_MANIFEST = "name string, generation long, folder string, contract string, facts string, published double"


@dataclass(frozen=True)
class Generation:
    name: str
    number: int
    folder: str
    contract: str
    facts: dict[str, Any]

    def table(self, spark: SparkSession, which: str, schema: str | None = None) -> DataFrame:
        """A table of the snapshot; with ``schema`` an empty one can be read too."""
        return (spark.read.schema(schema) if schema else spark.read).parquet(f"{self.folder}/{which}")


def _manifests(spark: SparkSession, root: str) -> DataFrame | None:
    if not exists(spark, f"{root}/manifest"):
        return None
    return spark.read.schema(_MANIFEST).json(f"{root}/manifest")


def current(spark: SparkSession, root: str, name: str, contract: str | None = None) -> Generation | None:
    """The newest generation of ``name``, or the newest that was built under ``contract``."""
    lines = _manifests(spark, root)
    if lines is None:
        return None
    lines = lines.where(F.col("name") == name)
    if contract is not None:
        lines = lines.where(F.col("contract") == contract)
    newest = lines.orderBy(F.desc("generation"), F.desc("published")).limit(1).collect()
    return Generation(name, newest[0]["generation"], newest[0]["folder"], newest[0]["contract"], json.loads(newest[0]["facts"])) if newest else None


def refreshed(spark: SparkSession, root: str, held: Generation) -> Generation:
    """The generation a reader holds, or the newest if there is a newer one."""
    newest = current(spark, root, held.name)
    return newest if newest and newest.number > held.number else held


def publish(spark: SparkSession, root: str, name: str, contract: str, write: Callable[[str], dict[str, Any]]) -> Generation:
    """``write`` fills the new folder and returns facts about it; the manifest line that follows makes it readable."""
    folder = f"{root}/{name}-{uuid.uuid4().hex}"
    facts = write(folder)
    before = current(spark, root, name)
    made = Generation(name, before.number + 1 if before else 1, folder, contract, facts)
    line = [(name, made.number, folder, contract, json.dumps(facts), time.time())]
    spark.createDataFrame(line, _MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifest")
    return made


def built(spark: SparkSession, root: str, name: str, contract: str, write: Callable[[str], dict[str, Any]]) -> Generation:
    """The newest generation under ``contract``; made now where there is none."""
    return current(spark, root, name, contract) or publish(spark, root, name, contract, write)


def files_contract(df: DataFrame, *settings: Any) -> str:
    """A hash of the files behind a table (path, size, time of change) and of settings: another file, another contract.

    Only file metadata is read, and a single row leaves the executors.
    """
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    one = F.xxhash64("file_path", "file_size", F.col("file_modification_time").cast("string"))
    row = files.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(one).alias("x"), F.sum(one.cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']}-{row['x']}-{row['s']}-{json.dumps(settings, default=str)}"


def index_root(spark: SparkSession) -> str:
    """Where indexes rest: ``verisift.index.root``, or a folder beside the checkpoints."""
    return (spark.conf.get("verisift.index.root", None) or f"{_folder(spark)}/verisift-indexes").rstrip("/")


def parallel(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
