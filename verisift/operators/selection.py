"""Greedy bundle selection under a token budget: sequential by nature, one query's bounded pool at a time."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from ..config import Settings


@dataclass(frozen=True)
class Passage:
    chunk_id: int
    doc_id: int
    source: str
    words: frozenset[str]
    tokens: int
    fusion: float
    safety: float
    ebm: float
    contradiction: float
    noise: float
    facets: dict[str, float]


def redundancy(p: Passage, chosen: list[Passage]) -> float:
    best = 0.0
    for q in chosen:
        union = len(p.words | q.words)
        best = max(best, (len(p.words & q.words) / union if union else 0.0) + (0.15 if p.doc_id == q.doc_id else 0.0))
    return min(1.0, best)


def facet_gain(p: Passage, weights: dict[str, float], covered: set[str]) -> float:
    return sum(w * p.facets.get(f, 0.0) * (0.35 if f in covered else 1.0) for f, w in weights.items())


def utility(p: Passage, chosen: list[Passage], weights: dict[str, float], covered: set[str]) -> float:
    return p.fusion + 0.35 * p.safety + 0.25 * p.ebm + facet_gain(p, weights, covered) + 0.12 * p.contradiction - 0.22 * redundancy(p, chosen) - 0.30 * p.noise


def select(pool: list[Passage], weights: dict[str, float], sources: tuple[str, ...] = (), budget: int = Settings.token_budget, most: int = Settings.max_passages, least: float = Settings.min_utility, protect: float = Settings.protect) -> list[Passage]:
    """The best utility a token at each step; passages that do not fit are passed over. Then one safety passage and
    the missing required sources are added, up to the configured number of passages."""
    pool = sorted(pool, key=lambda p: (-p.fusion, p.chunk_id))
    chosen: list[Passage] = []
    covered: set[str] = set()
    left = budget
    while len(chosen) < most:
        best, choice = None, None
        for p in pool:
            if p not in chosen and p.tokens <= left:
                rate = utility(p, chosen, weights, covered) / max(1, p.tokens)
                if best is None or rate > best:
                    best, choice = rate, p
        if choice is None or chosen and best <= least:
            break
        chosen.append(choice)
        left -= choice.tokens
        covered |= {f for f, v in choice.facets.items() if v > 0.25}
    danger = lambda p: max(p.safety, p.contradiction)
    if len(chosen) < Settings.max_passages and not any(danger(p) >= protect for p in chosen):
        extra = [p for p in pool if p not in chosen and danger(p) >= protect]
        chosen += sorted(extra, key=lambda p: (-danger(p), -p.fusion, p.chunk_id))[:1]
    for source in sorted(set(sources) - {p.source for p in chosen}):
        extra = [p for p in pool if p not in chosen and p.source == source]
        if extra and len(chosen) < Settings.max_passages:
            chosen.append(min(extra, key=lambda p: (-max(p.facets.values(), default=0.0), -p.fusion, p.chunk_id)))
    return chosen


def pack(chosen: list[Passage], weights: dict[str, float], budget: int = Settings.token_budget, protect: float = Settings.protect) -> list[Passage]:
    """Drop the least useful unprotected passage until the budget holds; one always stays."""
    kept = list(chosen)
    while len(kept) > 1 and sum(p.tokens for p in kept) > budget:
        free = [p for p in kept if max(p.safety, p.contradiction) < protect] or kept
        kept.remove(min(free, key=lambda p: (utility(p, [q for q in kept if q is not p], weights, set()), p.chunk_id)))
    return kept


def _passages(pdf: pd.DataFrame) -> list[Passage]:
    return [Passage(int(r.chunk_id), int(r.doc_id), r.source_type, frozenset(r.words), int(r.tokens), float(r.fusion), float(r.safety), float(r.ebm), float(r.contradiction), float(r.noise), dict(r.facets)) for r in pdf.itertuples()]


def select_bundles(pool: DataFrame, weights: dict[str, float], sources: tuple[str, ...], packed: bool = False, budget: int = Settings.token_budget) -> DataFrame:
    """``query_id, chunk_id, position, tokens``. ``pool`` holds at most the pool size of rows a query."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen = select(_passages(pdf), weights, sources, budget)
        chosen = pack(chosen, weights, budget) if packed else chosen
        return pd.DataFrame([(int(pdf.query_id.iloc[0]), p.chunk_id, i, p.tokens) for i, p in enumerate(chosen)], columns=["query_id", "chunk_id", "position", "tokens"])

    return pool.groupBy("query_id").applyInPandas(run, "query_id long, chunk_id long, position int, tokens long")
