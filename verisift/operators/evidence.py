"""Evidence ledger, coverage, contradictions and the sufficiency gate, for all queries at once."""

from __future__ import annotations

import random
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import scores as S
from ..functions.text import count_in


def align(passages: DataFrame, facets: DataFrame, safety_stems: tuple[str, ...], negative: tuple[str, ...], qualify: tuple[str, ...]) -> DataFrame:
    """A row for each passage and facet: ``score`` and ``polarity``. Facets are a few rows and are broadcast."""
    c, low = F.col, F.col("_low")
    # What does not depend on the facet is found once a passage, before rows are multiplied.
    once = passages.withColumn("_low", F.lower(F.coalesce("text", F.lit(""))))
    once = once.select(
        "*", S.clamp(count_in(low, safety_stems) * 0.18).alias("_safety"), (count_in(low, negative) > 0).alias("_negative"), (count_in(low, qualify) > 0).alias("_qualify"), S.section_score(c("section")).alias("_section")
    )
    j = once.join(F.broadcast(facets))
    hits = F.size(F.filter("keywords", lambda k: low.contains(k)))
    is_safety = c("facet") == "safety_contraindications"
    score = S.facet_alignment(hits, S.policy_bonus(c("policy"), c("source_type")), c("_section"), is_safety, c("_safety"))
    polarity = F.when(c("_negative"), F.when(is_safety, "SAFETY").otherwise("CONTRADICTS")).when(c("_qualify"), "QUALIFIES").otherwise("SUPPORTS")
    return j.withColumn("score", score).withColumn("polarity", polarity).drop("keywords", "_low", "_safety", "_negative", "_qualify", "_section")


def conflicting() -> Column:
    return (F.col("polarity") == "CONTRADICTS") | ((F.col("polarity") == "SAFETY") & (F.col("facet") != "safety_contraindications"))


def contributions(ledger: DataFrame) -> DataFrame:
    """``query_id, facet, doc_id, c``: the greatest contribution a chunk, then a document."""
    c = F.col
    part = S.clamp(c("score")) * S.clamp(c("rerank")) * S.clamp(c("grade")) * F.when(c("polarity") == "CONTRADICTS", 0.35).otherwise(1.0)
    by_chunk = ledger.groupBy("query_id", "facet", "doc_id", "chunk_id").agg(F.max(part).alias("c"))
    return by_chunk.groupBy("query_id", "facet", "doc_id").agg(F.max("c").alias("c"))


def coverage(contrib: DataFrame) -> DataFrame:
    """Noisy-or of the documents' contributions."""
    return contrib.groupBy("query_id", "facet").agg((1 - F.product(1 - F.col("c"))).alias("coverage"), F.count(F.lit(1)).alias("n_docs"))


def bootstrap_lcb(values: list[float], rounds: int = 64, seed: int = 42) -> float:
    """Lower confidence bound of the noisy-or: the 5 % order statistic of resamples."""
    def union(xs: list[float]) -> float:
        return 1 - reduce(lambda p, x: p * (1 - x), xs, 1.0)

    if not values:
        return 0.0
    if len(values) == 1:
        return min(1.0, max(0.0, union(values) - 0.08))
    rng = random.Random(seed)
    n = len(values)
    found = sorted(union([values[rng.randrange(n)] for _ in range(n)]) for _ in range(rounds))
    return found[int(0.05 * (rounds - 1))]


def lcb(contrib: DataFrame) -> DataFrame:
    """``query_id, facet, lcb``; contributions in falling order, ties by document, so draws are repeatable."""
    ordered = contrib.groupBy("query_id", "facet").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("m"), "doc_id"))), lambda x: -x["m"]).alias("cs"))

    @F.pandas_udf("double")
    def bound(cs: pd.Series) -> pd.Series:
        return pd.Series([bootstrap_lcb([float(x) for x in v]) for v in cs])

    return ordered.select("query_id", "facet", bound("cs").alias("lcb"))


def contradictions(ledger: DataFrame, high: float = Settings.high_grade) -> DataFrame:
    """Distinct pairs (supporting, conflicting chunk) of a query's facet with their severity.

    The join is on (query, facet); a query has a bounded pool of candidates.
    """
    c = F.col
    rows = ledger.withColumn("conflict", conflicting())
    a = rows.where(~c("conflict") & (c("polarity") != "IRRELEVANT")).select("query_id", "facet", c("chunk_id").alias("support"), c("grade").alias("ga"))
    b = rows.where("conflict").select("query_id", "facet", c("chunk_id").alias("conflicting"), c("grade").alias("gb"))
    j = a.join(b, ["query_id", "facet"]).where("support <> conflicting").distinct()
    return j.withColumn("severity", F.when(F.greatest("ga", "gb") >= high, "high").otherwise("moderate"))


def adjudicate(pairs: DataFrame, gap: float = Settings.grade_gap) -> DataFrame:
    """Pairs that are not of high severity are resolved by a clear gap in grade."""
    return pairs.withColumn("resolved", (F.col("severity") != "high") & (F.abs(F.col("ga") - F.col("gb")) >= gap - 1e-9))


def decide(facet_rows: DataFrame, pairs: DataFrame, bundle: DataFrame, iteration: int = 0, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """``action, missing, unresolved`` of each query, from facet rows (``facet, required, threshold, lcb, entropy``), resolved pairs and bundle facts."""
    c = F.col
    short = (c("lcb") < c("threshold")) | (c("entropy") > s.entropy_max)
    f = facet_rows.groupBy("query_id").agg(F.array_sort(F.collect_set(F.when(c("required") & short, c("facet")))).alias("missing"), F.sum(F.when(c("required"), F.greatest(F.lit(0.0), c("threshold") - c("lcb"))).otherwise(0.0)).alias("deficit"))
    p = pairs.groupBy("query_id").agg(F.count_if(~c("resolved")).alias("unresolved"), F.count_if(~c("resolved") & (c("severity") == "high")).alias("unresolved_high"))
    j = f.join(p, "query_id", "left").join(bundle, "query_id", "left").fillna({"unresolved": 0, "unresolved_high": 0, "n": 0, "tokens": 0, "weak": 0})
    j = j.withColumn("marginal", F.when(c("n") == 0, 1.0).otherwise(c("deficit") / F.greatest(c("tokens"), F.lit(1))))
    ok = (F.size("missing") == 0) & (c("unresolved_high") == 0) & (c("unresolved") <= s.max_contradictions) & (c("n") > 0) & (c("weak") == 0)
    more = (F.size("missing") > 0) | (c("unresolved_high") > 0) | (c("unresolved") > s.max_contradictions) | (c("marginal") > s.min_utility)
    go_on = F.lit(iteration < s.loops - 1) & more
    return j.withColumn("action", F.when(ok, "ACCEPT").when(go_on, "RETRIEVE_MORE").otherwise("INSUFFICIENT"))
