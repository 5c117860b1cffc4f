"""Scores of passages as Column expressions: calibration, priors, fusion, facets."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (
    CONTRADICTION_STEMS,
    EBM,
    FACET_SAFETY_STEMS,
    FUSION_SAFETY_STEMS,
    NEGATIVE_STEMS,
    QUALIFY_STEMS,
    SECTION_HIGH,
    SECTION_LOW,
    SOURCE_SCORE,
    Weights,
)
from .text import count_stems, has_any


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def truthy(x: Column) -> Column:
    """Null and zero both count as missing."""
    return F.when(x != 0, x)


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clamp(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def calibrate(raw: Column, bias: float = 0.0, temperature: float = 1.0, logits: Column | None = None) -> Column:
    t = temperature if temperature > 1e-6 else 1.0
    x = logit(raw) if logits is None else F.coalesce(logits, logit(raw))
    return logistic((x - bias) / t)


def recency(stamp: Column, as_of: Column, days: int = 730) -> Column:
    age = F.greatest(F.datediff(as_of, stamp), F.lit(0))
    return F.coalesce(F.exp(-age / float(days)), F.lit(0.5))


def section_score(section: Column) -> Column:
    return F.when(has_any(section, SECTION_HIGH), 1.0).when(has_any(section, SECTION_LOW), 0.30).otherwise(0.65)


def source_score(source: Column) -> Column:
    out = F
    for name in ("CPG", "EMR", "SAFETY"):
        out = out.when(source == name, SOURCE_SCORE[name])
    return out.otherwise(SOURCE_SCORE["LIT"])


def safety_score(text: Column, stems: tuple[str, ...] = FUSION_SAFETY_STEMS, step: float = 0.16) -> Column:
    return clamp(count_stems(text, stems) * step)


def facet_safety(text: Column, stems: tuple[str, ...] = FACET_SAFETY_STEMS) -> Column:
    return safety_score(text, stems, 0.18)


def contradiction_score(text: Column, stems: tuple[str, ...] = CONTRADICTION_STEMS) -> Column:
    return clamp(count_stems(text, stems) * 0.16)


def noise_score(obsolete: Column, mismatch: Column, weak: Column, incomplete: Column) -> Column:
    return clamp(sum(F.when(c, w).otherwise(0.0) for c, w in ((obsolete, 0.45), (mismatch, 0.35), (weak, 0.25), (incomplete, 0.15))))


def evidence_grade(source: Column, design: Column, given: Column | None = None) -> Column:
    """A given grade counts as it is; else the ladder from the label (grade or study design, or the source) and the source."""
    label = F.lower(F.coalesce(F.when(design != "", design), source, F.lit("")))
    has = lambda *xs: reduce(or_, (label.contains(x) for x in xs))
    ladder = (
        F.when((source == "CPG") | has("guideline", "cpg"), EBM["cpg"])
        .when(has("systematic") | label.isin("sr", "systematic_review"), EBM["sr"])
        .when(has("rct", "trial"), EBM["rct"])
        .when(has("observ") | (label == "obs"), EBM["obs"])
        .when(has("case"), EBM["case"])
        .when((source == "EMR") | has("emr"), EBM["emr"])
        .when((source == "SAFETY") | has("safety"), EBM["safety"])
        .when(source == "LIT", round(0.5 * EBM["obs"] + 0.3 * EBM["rct"], 6))
        .otherwise(0.5)
    )
    return ladder if given is None else F.when(given.isNotNull(), clamp(given)).otherwise(ladder)


def fusion(p: Column, dense: Column, lexical: Column, recent: Column, section: Column, source: Column, ebm: Column, safety: Column, noise: Column, w: Weights = Weights()) -> Column:  # noqa: B008
    clip = lambda x: clamp(x, -w.clip, w.clip)
    zero = lambda x: clamp(F.coalesce(x, F.lit(0.0)))
    raw = (
        w.rerank * clip(logit(F.coalesce(truthy(p), F.lit(0.5)))) + w.dense * zero(dense) + w.lexical * zero(lexical) + w.recency * recent
        + w.section * section + w.source * source + w.ebm * ebm + w.safety * safety - w.noise * noise
    )
    return clamp(logistic(clip(raw)))


def policy_bonus(policy: Column, source: Column) -> Column:
    """How well a source fits a facet's source policy."""
    want = F.regexp_replace(policy, "_ONLY$", "")
    return (
        F.when(want == "ANY", 0.20).when(want == source, 0.45)
        .when((want == "CPG") & source.isin("LIT", "SAFETY"), 0.15)
        .when((want == "SAFETY") & source.isin("CPG", "LIT"), 0.20).otherwise(0.0)
    )


def facet_alignment(hits: Column, bonus: Column, section: Column, is_safety: Column, safety: Column) -> Column:
    extra = F.when(is_safety & (safety > 0), 0.25).otherwise(0.0)
    score = clamp(0.20 + bonus + F.least(F.lit(0.65), hits * 0.18) + 0.15 * F.coalesce(truthy(section), F.lit(0.5)) + extra)
    return F.when((hits == 0) & (extra == 0) & (bonus < 0.45), 0.0).otherwise(score)


def polarity(text: Column, is_safety: Column, negative: tuple[str, ...] = NEGATIVE_STEMS, qualify: tuple[str, ...] = QUALIFY_STEMS) -> Column:
    return F.when(has_any(text, negative), F.when(is_safety, "SAFETY").otherwise("CONTRADICTS")).when(has_any(text, qualify), "QUALIFIES").otherwise("SUPPORTS")


def entropy(p: Column) -> Column:
    """Binary entropy in bits; 0 at both ends."""
    q = 1 - p
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log2(p) + q * F.log2(q)))


def beta_lcb(a: Column, b: Column, z: float = 1.64485) -> Column:
    n = a + b
    return clamp(a / n - z * F.sqrt(a * b / (n * n * (n + 1))))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal sizes or zero norms."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.coalesce(F.when(ok, dot / (norm(a) * norm(b))), F.lit(0.0))


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))
