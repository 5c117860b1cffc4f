"""Dense retrieval: exact top-k by blocks of queries, an inverted-file index, offline embedding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import cosine
from .lexical import top_k


def valid(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors of the right size without NaN or infinite parts."""
    bad = F.exists("embedding", lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))
    return vectors.where((F.size("embedding") == dim) & ~bad)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """``query_id, vec_id, score, rank``: exact cosine top-k.

    Queries go out in blocks of bounded size; each task multiplies a batch of
    vectors by a block and keeps its own best k a query, so what is shuffled
    is k rows a query and task.
    """
    n = queries.count()
    blocks = max(1, math.ceil(n / block))
    sc, out = vectors.sparkSession.sparkContext, None
    for i in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).select("query_id", "embedding").collect()
        ids = np.array([r["query_id"] for r in rows], np.int64)
        if not len(ids):
            continue
        q = np.array([r["embedding"] for r in rows], np.float64)
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        sent = sc.broadcast((ids, np.divide(q, norm, out=np.zeros_like(q), where=norm > 0)))

        def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best_s, best_v = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)
            for b in (whole.slice(at, 1024) for whole in it for at in range(0, whole.num_rows, 1024)):
                v = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
                s = np.hstack([best_s, np.round(q @ v.T, 9)])
                own = np.hstack([best_v, np.broadcast_to(b.column(0).to_numpy(), (len(ids), len(v)))])
                order = np.lexsort((own, -s), axis=1)[:, :k]
                best_s, best_v = np.take_along_axis(s, order, 1), np.take_along_axis(own, order, 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, best_s.shape[1])), pa.array(best_v.ravel().astype(np.int64)), pa.array(np.round(best_s.ravel(), 9))], names=["query_id", "vec_id", "score"]
            )

        part = vectors.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    return top_k(out, k, item="vec_id")


def embed_texts(texts: list[str], dim: int = 64) -> list[np.ndarray]:
    """Offline default embedder: signed feature hashing of words, unit length."""
    import zlib

    out = []
    for t in texts:
        h = np.array([zlib.crc32(w.encode()) for w in (t or "").lower().split()], np.int64)
        v = np.bincount(h % dim, np.where(h >> 16 & 1, 1.0, -1.0), dim) if len(h) else np.zeros(dim)
        n = np.linalg.norm(v)
        out.append((v / n if n else v).astype(np.float32))
    return out


def hash_embed(rows: DataFrame, dim: int = 64, text: str = "text") -> DataFrame:
    """``rows`` with the offline embedder's vectors. Swap for a model with the same shape."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(embed_texts(texts.tolist(), dim))

    return rows.withColumn("embedding", embed(text))
