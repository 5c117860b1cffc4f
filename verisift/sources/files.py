"""File sources and sinks: JSON lines, CSV and JSON uploads, incremental discovery, split unions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASE = T.StructType([T.StructField(x, T.StringType()) for x in ("case_id", "query", "query_type", "patient_id")] + [T.StructField("gold_doc_ids", T.ArrayType(T.StringType()))])
UPLOAD_LIMIT = 100 * 1024 * 1024
UPLOAD_KINDS = (".csv", ".json", ".txt", ".pdf")


def split_union(splits: dict[str, DataFrame]) -> DataFrame:
    """Splits as one table with ``_split``; columns a split lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("_split", F.lit(k)) for k, df in splits.items()])


def jsonl(spark: SparkSession, path: str, schema: T.StructType = CASE) -> tuple[DataFrame, DataFrame]:
    """Well-formed rows, and the others with file and text. Blank lines are skipped."""
    lines = spark.read.text(path).select(F.col("value"), F.input_file_name().alias("file")).where(F.trim("value") != "")
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.withColumn("r", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r._bad").isNotNull() | F.col(f"r.{schema.fieldNames()[0]}").isNull()
    return parsed.where(~bad).select(*[F.col(f"r.{n}").alias(n) for n in schema.fieldNames()]), parsed.where(bad).select("file", F.col("value").alias("line"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upload(spark: SparkSession, path: str, size: int) -> DataFrame:
    """A CSV or JSON upload; other kinds and too large files are refused."""
    kind = PurePosixPath(path).suffix.lower()
    if kind not in UPLOAD_KINDS:
        raise ValueError(f"files of kind {kind or 'none'} are not taken")
    if size > UPLOAD_LIMIT:
        raise ValueError(f"{size} bytes exceed the limit of {UPLOAD_LIMIT}")
    if kind == ".csv":
        return spark.read.csv(path, header=True, inferSchema=True, multiLine=True)
    if kind == ".json":
        return spark.read.json(path, multiLine=True)
    raise ValueError(f"{kind} files are accepted but hold no table")


#: Bytes up to which a file's hash is its MD5, read by one task. Fixed: it is part of what a hash means.
WHOLE = 128 * 1024 * 1024
#: Modulus and base of the polynomial that joins the digests of lines; fixed values.
_MODULUS, _BASE = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835 % ((1 << 127) - 1)


def file_state(spark: SparkSession, root: str, pattern: str = "*.csv", whole: int = WHOLE) -> DataFrame:
    """``path, hash, mtime`` of all files below ``root``.

    The hash is the MD5 of a file of at most ``whole`` bytes. MD5 can't be taken in parts, so a larger file's hash is the MD5 of its
    size and of a polynomial over the MD5 of its lines, which joins from splits wherever Spark cuts the file.
    """
    below = {"recursiveFileLookup": "true", "pathGlobFilter": pattern}
    small = spark.read.format("binaryFile").options(**below).load(root).where(F.col("length") <= whole)
    m = F.col("_metadata")
    lines = spark.read.options(**below, lineSep="\n").text(root).where(m["file_size"] > whole)
    lines = lines.select(m["file_path"].alias("path"), m["file_modification_time"].alias("mtime"), m["file_size"].alias("size"), m["file_block_start"].alias("at"), F.col("value").cast("binary").alias("line"))
    splits = lines.mapInArrow(_joined_lines, "path string, mtime timestamp, size long, at long, n long, h string")

    @F.udf("string")
    def joined(size: int, parts: list) -> str:
        h = 0
        for part in parts:
            h = (h * pow(_BASE, part["n"], _MODULUS) + int(part["h"], 16)) % _MODULUS
        return hashlib.md5(f"{size}-{h:x}".encode()).hexdigest()

    large = splits.groupBy("path", "mtime", "size").agg(F.array_sort(F.collect_list(F.struct("at", "n", "h"))).alias("parts"))
    path = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:///", "file:/")
    return small.select("path", F.md5("content").alias("hash"), F.col("modificationTime").alias("mtime")).unionByName(large.select(path.alias("path"), joined("size", "parts").alias("hash"), "mtime"))


def _joined_lines(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split of a file: its number of lines and the polynomial over their digests."""
    now, n, h, types = None, 0, 0, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([x], t) for x, t in zip(now, types, strict=True)], pa.array([n], pa.int64()), pa.array([f"{h:x}"])], names=["path", "mtime", "size", "at", "n", "h"])

    for b in it:
        types = types or [c.type for c in b.columns[:4]]
        at, path, before = b.column(3).to_pylist(), b.column(0).to_pylist(), None
        for i, line in enumerate(b.column(4).to_pylist()):
            if (at[i], path[i]) != before:
                before, key = (at[i], path[i]), tuple(c[i].as_py() for c in b.columns[:4])
                if key != now:
                    if now is not None:
                        yield row()
                    now, n, h = key, 0, 0
            n, h = n + 1, (h * _BASE + int.from_bytes(hashlib.md5(line).digest())) % _MODULUS
    if now is not None:
        yield row()


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files that are new, or whose hash or time differs from the stored state."""
    b = before.select(F.col("path"), F.col("hash").alias("h0"), F.col("mtime").alias("t0"))
    return now.join(b, "path", "left").where(F.col("h0").isNull() | (F.col("hash") != F.col("h0")) | (F.col("mtime") != F.col("t0"))).select("path", "hash", "mtime")
