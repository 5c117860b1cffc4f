"""Centroid clustering: plain Lloyd in exact integers.

Components become integers, ``floor(scale * x)``. In each round the centroids,
``k`` lists of ``dim`` integers, are broadcast; a task computes the squared
differences of its vectors to each centroid and takes the nearest, the lowest
number among equals; its sums and counts, a few rows a task, meet in a groupBy.

Vectors without exactly ``dim`` components, or with a null or non-finite one,
are left out; every other row gives one row, repeated rows and ids too. Where
ids have equal hashes (repeated or null ones; null counts as empty in the
hash) the lesser vector in order of components starts the earlier centroid,
and with fewer than ``k`` vectors there are as many centroids as vectors. An
empty table gives an empty result. Components of any size are summed and
compared exactly; a distance or inertia beyond a long is given as the largest
long. Only the id and the vector are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage

MOST = (1 << 63) - 1
#: Below this the squared differences of up to 256 components fit a long.
SMALL = 1 << 26
#: Bits of a limb: sums of limbs of 2^31 rows fit a long.
LIMB = 31
ROWS = 8192


def usable(dim: int, col: str = "embedding") -> Column:
    """Exactly ``dim`` components, none null or non-finite."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(col) == dim) & ~bad, F.lit(False))


def integers(vectors: list, scale: int) -> np.ndarray:
    """A row of ``floor(scale * x)`` for each vector, as int64 or, where they are large, as exact Python integers.
    ``scale`` is a power of two, so the product is exact."""
    x = np.stack(vectors).astype(np.float64)
    if not x.size or np.abs(x).max() * scale < SMALL:
        return np.floor(x * scale).astype(np.int64)
    return np.array([[math.floor(v * scale) if abs(v) < 1 << 52 else int(v) * scale for v in row] for row in x.tolist()], object)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, the lowest among equals, and the squared distance."""
    exact = x.dtype == object or centroids.dtype == object
    distances = np.empty((len(x), len(centroids)), object if exact else np.int64)
    for j, c in enumerate(centroids):
        d = x - c
        distances[:, j] = (d * d).sum(axis=1)
    own = np.array([min(range(len(r)), key=r.__getitem__) for r in distances.tolist()], np.int64) if exact else distances.argmin(axis=1)
    return own, distances[np.arange(len(x)), own]


def _as_array(centroids: list[list[int]]) -> np.ndarray:
    largest = max((abs(v) for c in centroids for v in c), default=0)
    return np.array(centroids, np.int64 if largest < SMALL else object)


def _batches(it: Iterator[pd.DataFrame], scale: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for pdf in it:
        for at in range(0, len(pdf), ROWS):
            part = pdf.iloc[at : at + ROWS]
            yield part, integers(part["embedding"].tolist(), scale)


def first_centroids(kept: DataFrame, k: int, scale: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors whose ``salt + id`` has the least SHA-256, in that order."""
    order = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(order.alias("h"), "embedding").orderBy("h", "embedding").limit(k).collect()
    return integers([r["embedding"] for r in rows], scale).tolist() if rows else []


def means(kept: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """One round: the componentwise floors of the means of each centroid's vectors; without vectors it stays."""
    sent = kept.sparkSession.sparkContext.broadcast(_as_array(centroids))  # k x dim integers
    dim = len(centroids[0])

    def sums(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [[0] * dim for _ in centroids]
        count = [0] * len(centroids)
        for _, x in _batches(it, scale):
            own, _ = nearest(x, sent.value)
            for j in np.unique(own).tolist():
                here = x[own == j]
                count[j] += len(here)
                total[j] = [a + int(b) for a, b in zip(total[j], here.sum(axis=0).tolist(), strict=True)]
        rows = []
        for j, (t, n) in enumerate(zip(total, count, strict=True)):
            limb = 0
            while n and (limb == 0 or any(t)):  # signed limbs of 31 bits, the lowest first
                low = [(v + (1 << LIMB - 1)) % (1 << LIMB) - (1 << LIMB - 1) for v in t]
                t = [(v - w) >> LIMB for v, w in zip(t, low, strict=True)]
                rows += [(j, limb, i, v) for i, v in enumerate(low)] + [(j, limb, dim, n)] * (limb == 0)
                limb += 1
        if rows:
            yield pd.DataFrame(rows, columns=["cluster", "limb", "i", "s"])

    # a row a component, and the count at the end of the lowest limb's
    parts = kept.select("embedding").mapInPandas(sums, "cluster int, limb int, i int, s long")
    merged = parts.groupBy("cluster", "limb", "i").agg(F.sum("s").alias("s")).collect()  # k x dim rows a limb
    sent.unpersist()
    total = [[0] * (dim + 1) for _ in centroids]
    for r in merged:
        total[r["cluster"]][r["i"]] += r["s"] << LIMB * r["limb"]
    return [[v // t[dim] for v in t[:dim]] if t[dim] else list(c) for t, c in zip(total, centroids, strict=True)]


def lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, salt: str = "3:") -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance`` of every usable vector after ``rounds`` rounds, and the final centroids."""
    kept = stage(vectors.where(usable(dim)).select("vec_id", "embedding"), "lloyd")
    kind = dict(kept.dtypes)["vec_id"]
    centroids = first_centroids(kept, k, scale, salt)
    if not centroids:
        unstage(kept)
        return kept.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), []
    for _ in range(rounds):
        moved = means(kept, centroids, scale)
        if moved == centroids:
            break  # every later round would give the same
        centroids = moved
    final = _as_array(centroids)

    def assign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in _batches(it, scale):
            own, d = nearest(x, final)
            d = np.array([min(int(v), MOST) for v in d], np.int64) if d.dtype == object else d
            yield pd.DataFrame({"vec_id": part["vec_id"], "cluster": own.astype(np.int32), "distance": d})

    named = kept.withColumn("vec_id", F.col("vec_id").cast("string"))  # pandas would make floats of ids beside a null one
    return named.mapInPandas(assign, "vec_id string, cluster int, distance long").withColumn("vec_id", F.col("vec_id").cast(kind)), centroids


def clustering(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, salt: str = "3:") -> DataFrame:
    """``lloyd`` with ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` beside each vector."""
    assigned, centroids = lloyd(vectors, k, rounds, dim, scale, salt)
    per = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    total = sum(per.values())
    facts = [(j, min(per.get(j, 0), MOST), min(total, MOST), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    small = assigned.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
