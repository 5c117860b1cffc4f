"""Ranking metrics and audit scores as aggregates over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import clamp


def ranking_metrics(ranks: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """``case_id, ndcg, precision, recall, rr`` from ``case_id, doc_id, rank`` and ``case_id, doc_id, grade``.

    Gain is 2^grade - 1, discount log2(rank + 1); precision divides by k; cases without relevant documents get 1 for ndcg and recall.
    """
    c = F.col
    cases = ranks.select("case_id").union(qrels.select("case_id")).distinct()
    rel = qrels.where("grade > 0")
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1.0)
    w = Window.partitionBy("case_id").orderBy(c("grade").desc(), "doc_id")
    ideal = rel.withColumn("r", F.row_number().over(w)).groupBy("case_id").agg(F.sum(F.when(c("r") <= k, gain(c("grade"), c("r")))).alias("idcg"), F.count(F.lit(1)).alias("n_rel"))
    hit = ranks.where(c("rank") <= k).join(rel, ["case_id", "doc_id"]).groupBy("case_id").agg(F.sum(gain(c("grade"), c("rank"))).alias("dcg"), F.count(F.lit(1)).alias("n_hit"), F.max(1.0 / c("rank")).alias("rr"))
    j = cases.join(ideal, "case_id", "left").join(hit, "case_id", "left").fillna({"dcg": 0.0, "n_hit": 0, "rr": 0.0})
    none = c("n_rel").isNull()
    return j.select("case_id", F.when(none, 1.0).otherwise(c("dcg") / c("idcg")).alias("ndcg"), (c("n_hit") / float(k)).alias("precision"), F.when(none, 1.0).otherwise(c("n_hit") / c("n_rel")).alias("recall"), c("rr"))


def msas(critical: Column, facet: Column, ground: Column, suff: Column, trace: Column, recall: Column, citation: Column, unsupported: Column) -> Column:
    """The audit score: a weighted sum of nine terms in [0, 1]."""
    return clamp(
        0.25 * critical + 0.15 * facet + 0.15 * ground + 0.15 * suff + 0.10 * trace + 0.10 * recall + 0.10 * citation - 0.20 * (1 - critical) - 0.10 * unsupported
    )


def sufficiency_term(passed: Column, gap: Column) -> Column:
    return F.when(passed.isNull(), 0.5).when(passed & gap, 0.0).when(~passed & ~gap, 0.5).otherwise(1.0)


def bucket(error: Column, in_corpus: Column, in_index: Column, n_literature: Column, recall: Column, critical: Column, passed: Column) -> Column:
    """What a case failed on first; null if on nothing. ``in_index`` and ``passed`` may be unknown."""
    return (
        F.when(error, "trace_or_runtime_failure").when(F.coalesce(in_corpus, F.lit(0)) == 0, "qrel_doc_absent_from_corpus").when(in_index == 0, "qrel_doc_absent_from_index")
        .when(n_literature == 0, "no_literature_retrieved").when(recall <= 0, "literature_retrieved_but_no_qrel_overlap").when(critical <= 0, "selected_evidence_not_facet_supported")
        .when(~passed, "policy_threshold_failure")
    )


def groundedness(answered: Column, n_claims: Column, n_supported: Column, n_citations: Column) -> Column:
    """Share of claims whose cited document supports them; without claims, what citations alone are worth; 0 without an answer."""
    return F.when(~answered, 0.0).when(n_claims > 0, n_supported / n_claims).when(n_citations > 0, 0.65).otherwise(0.25)


def facet_recall(facets: Column, found: Column, fallback: Column, critical_only: bool = False) -> Column:
    """Weighted share of ``facets`` (``weight, critical, gold``) with a gold document in ``found``.

    A facet whose gold documents are none of the case's (``fallback``) takes the case's; one without any counts as found.
    """
    mine = F.filter(facets, lambda f: f["critical"]) if critical_only else facets
    weight = lambda f: F.greatest(F.lit(0.0), f["weight"])
    gold = lambda f: F.when((F.size(fallback) > 0) & ~F.arrays_overlap(f["gold"], fallback), fallback).otherwise(f["gold"])
    total = F.aggregate(mine, F.lit(0.0), lambda a, f: a + weight(f))
    earned = F.aggregate(mine, F.lit(0.0), lambda a, f: a + F.when((F.size(gold(f)) == 0) | F.arrays_overlap(gold(f), found), weight(f)).otherwise(0.0))
    return F.when((F.size(mine) == 0) | (total == 0), 1.0).otherwise(earned / total)
