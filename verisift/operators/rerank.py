"""The scorer slot: any function that scores a query's passages, checked for whole results, open to failure.

A scorer gets a query and its passages and returns a result for each: ``index``
into the passages, ``score``, and perhaps ``logit`` and ``p_hat``. Results that
lose or repeat an index count as a failure. Where a scorer fails the query keeps its
first order and says so; other queries are not touched.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FAILED = "identity:rerank-error"
Scorer = Callable[[str, list[str]], Sequence[Any]]


def checked(results: Sequence[Any], n: int) -> list[dict[str, Any]]:
    """Results by index, each passage exactly once; plain numbers stand for the passages in their order."""
    rows = [r if isinstance(r, dict) else {"index": i, "score": float(r)} for i, r in enumerate(results)]
    if len(rows) != n:
        raise ValueError(f"{len(rows)} results for {n} passages")
    by = {int(r.get("index", -1)): r for r in rows}
    if set(by) != set(range(n)):
        raise ValueError("the results do not have every passage exactly once")
    out = [by[i] for i in range(n)]
    if any(not np.isfinite(float(r.get("score", r.get("p_hat", 0.0)))) for r in out):
        raise ValueError("a score is not a number")
    return out


def calibrated(result: dict[str, Any], a: float, b: float) -> float:
    """Platt scaling of the logit, or of the score as a probability, clamped to 0 and 1."""
    p = float(result.get("p_hat", result.get("score", 0.0)))
    logit = result.get("logit")
    if logit is None:
        p = min(1 - 1e-6, max(1e-6, p))
        logit = np.log(p / (1 - p))
    return float(min(1.0, max(0.0, 1 / (1 + np.exp(-(a * float(logit) + b))))))


def rerank(candidates: DataFrame, scorer: Scorer, version: str = "identity", a: float = 1.0, b: float = 0.0, first: str = "dense", text: str = "text", query_text: str | None = None) -> DataFrame:
    """``query_id, chunk_id, p, rank, version`` of every candidate of each query.

    ``candidates`` (``query_id, chunk_id``, the first score, the text) holds a query's pool, which the first stage has cut to
    its k; a pool meets in one task. Ranks go by score, then id; after a failure by the first score, then id, with no ``p``.
    """
    kinds = dict(candidates.dtypes)
    asks = [query_text] if query_text else []

    def run(key: tuple, pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values([first, "chunk_id"], ascending=[False, True], ignore_index=True)
        asked = str(pool[query_text].iloc[0]) if query_text else str(key[0])
        try:
            results = checked(scorer(asked, pool[text].fillna("").tolist()), len(pool))
            p, used = [calibrated(r, a, b) for r in results], results[0].get("calibration_version") or version
        except Exception:  # noqa: BLE001  a scorer may fail in any way
            return pd.DataFrame({"query_id": pool["query_id"], "chunk_id": pool["chunk_id"], "p": None, "rank": range(1, len(pool) + 1), "version": FAILED}).astype({"p": float})
        order = np.lexsort((pool["chunk_id"].to_numpy(), -np.round(np.array(p), 9)))
        return pd.DataFrame({"query_id": pool["query_id"].to_numpy()[order], "chunk_id": pool["chunk_id"].to_numpy()[order], "p": np.array(p)[order], "rank": range(1, len(pool) + 1), "version": used})

    pool = candidates.select("query_id", "chunk_id", first, text, *asks)
    return pool.groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, p double, rank int, version string")
