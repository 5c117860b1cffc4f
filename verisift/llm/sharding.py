"""Sharding by Hilbert-curve order.

Several metadata dimensions are quantised at bounds of equal frequency, the
cells are put in the order of a Hilbert curve, and the ordered rows are cut
into runs of near-equal bytes. Neighbours on the curve are neighbours in all
dimensions, so the files' min/max statistics prune on each of them.

Law ``bytes``: shard sizes are near equal. Documents of equal text form a
group, placed at the curve index of its smallest document id and kept in one
shard: the one that holds the group's middle on the line of all bytes. Cuts are
so made at the group boundary nearest to each even cut, and a shard differs
from an even share by no more than the largest group. Only a group above a
whole share is cut between its rows, so that the law also holds when copies
make up a third of the input.

String dimensions are ranked among their distinct values by a distributed sort,
so common prefixes do no harm; the values' table is broadcast up to
``BROADCAST_VALUES`` of them and joined by shuffle beyond.

Null or empty text has size 16 and CRC 0; null metadata sorts first, with empty
strings; texts of any length count whole; repeated rows get a slot each, ties
are in the order of the document id; only the id, the text and the dimensions
are read, so other columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ordered_prefix, same_doc, stage, text_or_empty, wrapped

OVERHEAD = 16
#: Distinct values of a string dimension up to which their table is broadcast.
BROADCAST_VALUES = 100_000


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of points ``coords`` (dims x n), by Skilling's transform."""
    x = coords.astype(np.int64).copy()
    dims = x.shape[0]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def ranked(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the strings of column ``name`` replaced by the number of rows with smaller values."""
    values = rows.groupBy(name).agg(F.count(F.lit(1)).alias("rows"))
    values = stage(ordered_prefix(values, [name], ["rows"], "shard-values").select(name, F.col("before_rows").alias("_rank")), "shard-ranks")
    small = values.count() <= BROADCAST_VALUES
    return rows.join(F.broadcast(values) if small else values, name).drop(name).withColumnRenamed("_rank", name)


def hilbert_shards(
    docs: DataFrame,
    n_shards: int = 40,
    dims: tuple[str, ...] = ("lang", "source", "size"),
    bits: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and the curve index ``cell``."""
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    size = F.octet_length(text).cast("long") + OVERHEAD
    kinds = dict(docs.dtypes)
    coded = [
        (size if d == "size" else F.coalesce(F.col(d), F.lit("")) if kinds[d] == "string" else F.coalesce(F.col(d).cast("long"), F.lit(-1))).alias(f"d{i}")
        for i, d in enumerate(dims)
    ]
    rows = stage(
        docs.select(
            F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("th"), *coded
        ),
        "shard-rows",
    )
    for i, d in enumerate(dims):
        if d != "size" and kinds[d] == "string":
            rows = ranked(rows, f"d{i}")
    cells = 1 << bits
    probs = [k / cells for k in range(1, cells)]
    found = rows.agg(*[F.percentile_approx(f"d{i}", probs, 2000).alias(f"d{i}") for i in range(len(dims))]).first()
    bounds = [np.unique(np.asarray(found[i] if found[i] is not None else [], dtype=np.int64)) for i in range(len(dims))]

    @F.pandas_udf("long")
    def cell(values: pd.DataFrame) -> pd.Series:
        grid = np.stack([np.searchsorted(b, values.iloc[:, i].to_numpy(), side="right") for i, b in enumerate(bounds)])
        return pd.Series(hilbert_index(grid, bits))

    rows = rows.withColumn("cell", cell(F.struct(*[f"d{i}" for i in range(len(dims))])))
    group = ["th", "text_crc32", "size"]
    # Written, so that the join has plain shuffles on both sides and a large group can be split.
    homes = stage(rows.groupBy(*group).agg(F.min(F.struct(F.col("doc_id"), F.col("cell"))).getField("cell").alias("home")), "shard-homes")
    placed = rows.join(homes, group).select("doc_id", "size", "text_crc32", "th", "home", F.col("cell").alias("own_cell"))
    placed = ordered_prefix(placed, ["home", "th", "text_crc32", "doc_id", "own_cell"], ["size"], "shard-order")
    placed = stage(placed, "shard-placed")
    total = placed.agg(F.sum("size")).first()[0] or 0
    starts = stage(placed.groupBy(*group, "home").agg(F.min("before_size").alias("g0"), F.sum("size").alias("g_bytes")), "shard-groups")
    placed = placed.join(starts, [*group, "home"])
    # Twice the middle of the group, or of the row of a group that has to be cut.
    middle = F.when(F.col("g_bytes") <= total / n_shards, 2 * F.col("g0") + F.col("g_bytes")).otherwise(2 * F.col("before_size") + F.col("size"))
    placed = placed.withColumn("shard", F.least(F.floor(middle * n_shards / F.lit(max(2 * total, 1))), F.lit(n_shards - 1)).cast("int"))
    first = placed.groupBy("shard").agg(F.min("rn").alias("rn0"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rn") - F.col("rn0")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("home").alias("cell"), "th",
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write the documents as files of one folder a shard, in slot order. Rows that repeat a document take its slots in turn."""
    turn = Window.partitionBy("doc_id", "th").orderBy("_o")
    rows = wrapped(docs).withColumn("_o", F.lit(0)).withColumn("_k", F.row_number().over(turn)).drop("_o")
    at = placed.select("doc_id", "th", "shard", "slot").withColumn("_o", F.col("slot")).withColumn("_k", F.row_number().over(turn)).drop("_o")
    joined = rows.join(at, same_doc(rows, at) & (rows["_k"] == at["_k"])).select("row", at["shard"], at["slot"])
    joined.repartition("shard").sortWithinPartitions("shard", "slot").select("row.*", F.col("shard").alias("_shard")).write.partitionBy("_shard").parquet(path)
