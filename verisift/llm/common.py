"""Shared plumbing: staged tables in the cluster's shared folder, ordered prefix sums, keys."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset a temporary one serves, in local mode only."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="verisift-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, and fixes what
    non-deterministic expressions (partition ids) returned.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._staged_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def keyed(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, th, text`` (+ ``more``). ``(doc_id, th)`` names a document.

    ``th`` hashes the text, so rows that repeat a document share a key and get
    one result, and rows that only share an id do not. Other columns of the
    input are left out, so clashing names cannot disturb a plan.
    """
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"), *more)


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row in one struct, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def wrapped(docs: DataFrame) -> DataFrame:
    """``doc_id, th, row``: the key beside the whole row, so that no column of the input clashes with a plan's own."""
    return docs.select("doc_id", F.xxhash64(text_or_empty()).alias("th"), whole_row(docs).alias("row"))


def same_doc(a: DataFrame, b: DataFrame) -> Column:
    """Null-safe equality of document keys; Spark plans it as an equi-join."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ordered_prefix(df: DataFrame, order: list[str], sums: list[str], name: str, spread: list[str] | None = None) -> DataFrame:
    """Global row number and running sums in ``order``, without a global window.

    Rows are range-partitioned on ``order`` (so an equal leading key, however
    frequent, is split by the later ones), each partition is numbered on its
    own, and the partitions' totals, one row each, give the offsets. Adds
    ``rn`` (from 0) and ``before_<c>`` for each ``c`` in ``sums``.
    """
    spark = df.sparkSession
    n = partitions(spark)
    ranged = stage(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()), name)
    totals = sorted(
        ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(c) for c in sums]).collect(),
        key=lambda r: r["_pid"],
    )
    offsets, run = [], [0] * (1 + len(sums))
    for r in totals:
        offsets.append((r["_pid"], *run))
        run = [a + (b or 0) for a, b in zip(run, [r["_rows"], *[r[c] for c in sums]], strict=True)]
    schema = "_pid int, _n0 long" + "".join(f", _s{i} long" for i in range(len(sums)))
    small = F.broadcast(spark.createDataFrame(offsets, schema))  # one row a partition
    inside = Window.partitionBy("_pid").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(small, "_pid")
    out = out.withColumn("rn", F.col("_n0") + F.row_number().over(inside) - 1)
    for i, c in enumerate(sums):
        out = out.withColumn(f"before_{c}", F.col(f"_s{i}") + F.sum(c).over(upto) - F.col(c))
    return out.drop("_pid", "_n0", *[f"_s{i}" for i in range(len(sums))])


def packed(rows: DataFrame) -> DataFrame:
    """``doc_id, th, z``: keyed documents with their texts compressed, for plans that must shuffle whole texts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in it:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                z = pa.array([pack(t) for t in part.column(2).cast(pa.binary()).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), z], names=["doc_id", "th", "z"])

    return rows.select("doc_id", "th", "text").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, th long, z binary")
