"""Sinks and integrity: upserts, anti-join inserts, fingerprints, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both, the latest a key: an aggregate that combines before the shuffle."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max(F.struct(F.col(version).alias("_v"), F.struct(*rest).alias("_r"))).alias("x"))
    return last.select(*keys, *[F.col(f"x._r.{c}").alias(c) for c in rest])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows to append, and one row of counts: inserted, skipped, failed (a null key)."""
    bad = ~F.array_contains(F.array(*[F.col(k).isNull() for k in keys]), True)
    marked = new.withColumn("_ok", bad).join(old.select(*keys, F.lit(True).alias("_had")), keys, "left")
    fresh = F.col("_ok") & F.col("_had").isNull()
    counts = marked.agg(F.count_if(fresh).alias("inserted"), F.count_if(F.col("_ok") & F.col("_had").isNotNull()).alias("skipped"), F.count_if(~F.col("_ok")).alias("failed"))
    return marked.where(fresh).drop("_ok", "_had"), counts


def fingerprint(ids: Column) -> list[Column]:
    """Order-independent multiset fingerprint in 60-bit slices of SHA-256: count, four xors, four sums modulo 2^60."""
    sha = F.sha2(ids.cast("string"), 256)
    parts = [F.conv(F.substring(sha, 1 + 15 * i, 15), 16, 10).cast("long") for i in range(4)]
    mod = F.lit(1 << 60).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("n"), *[F.bit_xor(p).alias(f"x{i}") for i, p in enumerate(parts)], *[(F.sum(p.cast("decimal(28,0)")) % mod).cast("long").alias(f"s{i}") for i, p in enumerate(parts)]]


def fingerprint_256(ids: DataFrame, column: str) -> tuple[int, int, int]:
    """Count, xor and sum modulo 2^256 of the SHA-256 of all ids; partial results a task."""
    import hashlib

    import pandas as pd

    def run(it):
        n, x, t = 0, 0, 0
        for pdf in it:
            for v in pdf[column]:
                if v is None or v == "":
                    raise ValueError("empty id")
                h = int.from_bytes(hashlib.sha256(str(v).encode()).digest(), "big")
                n, x, t = n + 1, x ^ h, (t + h) % (1 << 256)
        yield pd.DataFrame([(n, f"{x:064x}", f"{t:064x}")], columns=["n", "x", "t"])

    n, x, t = 0, 0, 0
    for r in ids.select(column).mapInPandas(run, "n long, x string, t string").collect():  # a row a task
        n, x, t = n + r["n"], x ^ int(r["x"], 16), (t + int(r["t"], 16)) % (1 << 256)
    return n, x, t


def signature(ids: DataFrame, column: str, by: list[str]) -> DataFrame:
    """SHA-256 over the sorted ids of each group, by way of a digest a bucket so that no row holds them all."""
    buckets = ids.groupBy(*by, F.pmod(F.xxhash64(column), F.lit(1024)).alias("_b")).agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(column))), 256).alias("_h"))
    return buckets.groupBy(*by).agg(F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("_b", "_h"))), lambda x: x["_h"])), 256).alias("signature"))
