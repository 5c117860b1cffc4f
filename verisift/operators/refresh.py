"""Embedding refresh: stale rows embedded in bounded batches, resumable, merged on reading.

A row is stale if its vector is missing or of another space, model or size, or
was made from another text. Fresh vectors go to a patch table beside the base
table, a folder a batch; the base is not rewritten. A batch's folder is named
by what it holds, so a batch that failed half-way is written again in its
place, and one that is done is not embedded again: its rows are stale no more.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import stale_embedding
from .pipeline import exists, written

Embed = Callable[[list[str]], list]
_PATCH = "content string, embedding array<float>, embedded_at timestamp"


@dataclass(frozen=True)
class Target:
    """The vectors that rows should have."""

    space: str
    model: str
    dim: int

    @property
    def key(self) -> str:
        return hashlib.sha256(f"{self.space}\0{self.model}\0{self.dim}".encode()).hexdigest()[:16]


def content(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def patches(rows: DataFrame, folder: str, target: Target, key: str = "chunk_id") -> DataFrame:
    """The fresh vectors so far, one for each row and text."""
    spark, path = rows.sparkSession, f"{folder}/{target.key}"
    schema = f"{key} {dict(rows.dtypes)[key]}, {_PATCH}, batch string"
    found = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    return found.dropDuplicates([key, "content"])


def stale(rows: DataFrame, folder: str, target: Target, key: str = "chunk_id") -> DataFrame:
    """``key, text, content`` of the rows that need a vector. ``embedded_content``, if the table has it, tells of which text its vector is."""
    own = stale_embedding(target.space, target.model, target.dim)
    if "embedded_content" in rows.columns:
        own = own | ~F.col("embedded_content").eqNullSafe(content(F.col("text")))
    wanted = rows.where(own).select(key, "text", content(F.col("text")).alias("content"))
    return wanted.join(patches(rows, folder, target, key).select(key, "content"), [key, "content"], "left_anti")


def refresh(rows: DataFrame, folder: str, target: Target, embed: Embed, batch_rows: int = 100_000, call_rows: int = 64, key: str = "chunk_id") -> dict[str, object]:
    """Embeds what is stale, ``batch_rows`` rows a batch and ``call_rows`` texts a call, and says how many rows there were.

    Blank texts, a wrong number of vectors or vectors of another size are errors, as of a batch they are in; batches before
    it stay done.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[key]
    todo = stale(rows, folder, target, key)
    n = todo.count()
    if not n:
        return {"stale": 0, "updated": 0, "batches": 0, "space": target.space}
    batches = math.ceil(n / batch_rows)
    # dealt once, so that a batch reads its own rows only
    dealt = written(todo.withColumn("b", F.pmod(F.xxhash64(key), F.lit(batches)).cast("int")), "refresh", "b")

    def vectors(it):
        for pdf in it:
            for at in range(0, len(pdf), call_rows):
                part = pdf.iloc[at : at + call_rows]
                texts = part["text"].fillna("").tolist()
                if any(not t.strip() for t in texts):
                    raise ValueError("rows with blank text cannot be embedded")
                got = [np.asarray(v, np.float32) for v in embed(texts)]
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
                if any(v.shape != (target.dim,) or not np.isfinite(v).all() for v in got):
                    raise ValueError(f"a vector is not of {target.dim} finite components")
                yield pd.DataFrame({key: part[key], "content": part["content"], "embedding": got})

    updated = 0
    for b in range(batches):
        mine = dealt.where(F.col("b") == b).select(key, "text", "content")
        facts = mine.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(key, "content")).alias("x")).first()
        if not facts["n"]:
            continue
        name = hashlib.sha256(f"{batches} {b} {facts['n']} {facts['x']}".encode()).hexdigest()[:24]
        fresh = mine.mapInPandas(vectors, f"{key} {kind}, content string, embedding array<float>").withColumn("embedded_at", F.current_timestamp())
        fresh.write.mode("overwrite").parquet(f"{folder}/{target.key}/batch={name}")
        updated += facts["n"]
    return {"stale": n, "updated": updated, "batches": batches, "space": target.space}


def merged(rows: DataFrame, folder: str, target: Target, key: str = "chunk_id") -> DataFrame:
    """The table as it stands: a fresh vector with its space, model and size where there is one for the row's text."""
    new = patches(rows, folder, target, key).select(key, F.col("content").alias("_content"), F.col("embedding").alias("_fresh"))
    both = rows.withColumn("_content", content(F.col("text"))).join(new, [key, "_content"], "left")
    has = F.col("_fresh").isNotNull()
    values = {"embedding": F.col("_fresh"), "embedding_space": F.lit(target.space), "embedding_model": F.lit(target.model), "embedding_dim": F.lit(target.dim), "embedding_size": F.lit(target.dim), "embedded_content": F.col("_content")}
    kept = dict(rows.dtypes)
    out = both.select(*[F.when(has, values[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in values else F.col(f"`{c}`") for c in rows.columns], has.alias("refreshed"), *([] if "embedding" in kept else [F.col("_fresh").alias("embedding")]))
    return out
