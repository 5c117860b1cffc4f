"""Event streams: windows, sessions, resumable ingest, keyed state."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.pipeline import exists


def windows(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums a window and type. On a stream, rows later than ``late`` are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if e.isStreaming else e
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if e.isStreaming else e
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def ingest(spark: SparkSession, source: str, schema, checkpoint: str, sink: Callable[[DataFrame, int], None], files: int = 1000) -> None:
    """New files since the last run, batch by batch; the checkpoint makes a rerun go on where it stopped."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    q = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()


def ingest_once(spark: SparkSession, source: str, schema: StructType, base: str, transform: Callable[[DataFrame], DataFrame], contract: dict, files: int = 1000) -> DataFrame:
    """What ``transform`` makes of all files so far, each file's rows once, whatever failed on the way.

    A batch replaces the folder named by its number, so one that failed after writing and runs again leaves no rows twice.
    The checkpoint and the folders belong to one ``contract`` (settings, with the source and its schema): under another one
    the state of the first is refused.
    """
    bound = hashlib.sha256(json.dumps([source, schema.jsonValue(), contract], sort_keys=True).encode()).hexdigest()
    if exists(spark, f"{base}/contract"):
        held = spark.read.text(f"{base}/contract").first()[0]
        if held != bound:
            raise ValueError(f"{base} was begun under another contract ({held[:12]}, now {bound[:12]})")
    else:
        spark.createDataFrame([(bound,)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/contract")
    ingest(spark, source, schema, f"{base}/state", lambda df, number: transform(df).write.mode("overwrite").parquet(f"{base}/out/batch={number}"), files)
    return spark.read.parquet(f"{base}/out")
