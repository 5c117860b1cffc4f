"""Scope predicates over chunks: each a Column, so Catalyst pushes what it can to the scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_POLICY = {f"{s}_ONLY": s for s in ("CPG", "EMR", "LIT", "SAFETY")}
SECTION_STEMS = ("contraindicat", "warning", "adverse", "interaction")
TEXT_STEMS = ("contraindicat", "adverse", "interaction", "avoid")


@dataclass(frozen=True)
class Scope:
    """What a query may see. A source filter wins over a policy; a patient restricts EMR rows, or all when hard."""

    org_id: str
    source: str | None = None
    policy: str = "ANY"
    patient_id: str | None = None
    patient_only: bool = False
    min_grade: float | None = None
    start: str | None = None
    end: str | None = None
    specialties: tuple[str, ...] = ()
    safety_search: bool = False
    space: str | None = None
    dim: int | None = None
    model: str | None = None

    def column(self) -> Column:
        parts = [tenant(self.org_id), source_policy(self.source, self.policy)]
        if self.patient_id is not None:
            hard = self.source == "EMR" or (self.source is None and self.policy == "EMR_ONLY") or self.patient_only
            parts.append(patient(self.patient_id, hard))
        if self.min_grade is not None:
            parts.append(min_grade(self.min_grade))
        if self.start or self.end:
            parts.append(timeframe(self.start, self.end))
        if self.specialties:
            parts.append(specialties(*self.specialties))
        if self.safety_search:
            parts.append(safety_search())
        if self.space is not None:
            parts.append(embedding_space(self.space, self.dim or 0, self.model))
        out = parts[0]
        for p in parts[1:]:
            if p is not None:
                out = out & p
        return out


def tenant(org_id: str) -> Column:
    return F.col("org_id") == org_id


def source_policy(source: str | None, policy: str) -> Column | None:
    want = source or _POLICY.get(policy)
    return F.col("source_type") == want if want else None


def patient(patient_id: str, hard: bool) -> Column:
    own = F.coalesce(F.col("patient_id") == patient_id, F.lit(False))
    return own if hard else (F.col("source_type") != "EMR") | own


def min_grade(least: float) -> Column:
    return (F.coalesce(F.col("grade_score"), F.lit(0.0)) >= least) | (F.coalesce(F.col("reliability"), F.lit(0.0)) >= least)


def timeframe(start: str | None, end: str | None = None) -> Column:
    """Either date of a chunk lies in the range; four digits alone are a year."""
    if start and len(start) == 4 and start.isdigit():
        start, end = f"{start}-01-01", f"{start}-12-31"

    def within(name: str) -> Column:
        c = F.col(name)
        if start and end:
            return c.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        return c >= F.lit(start).cast("date") if start else c <= F.lit(end).cast("date")

    return within("stamp") | within("effective_date")


def specialties(*names: str) -> Column:
    """A chunk's tags or its specialty meet the names."""
    return F.arrays_overlap("tags", F.array(*map(F.lit, names))) | F.col("specialty").isin(*names)


def safety_search(section: tuple[str, ...] = SECTION_STEMS, text: tuple[str, ...] = TEXT_STEMS) -> Column:
    return (F.col("source_type") == "SAFETY") | F.col("section").rlike(f"(?i){'|'.join(section)}") | F.col("text").rlike(f"(?i){'|'.join(text)}")


def embedding_space(space: str, dim: int, model: str | None = None) -> Column:
    own = (F.col("embedding_space") == space) & (F.col("embedding_dim") == dim)
    return own if model is None else own & (F.col("embedding_model") == model)


def stale_embedding(space: str, model: str, dim: int) -> Column:
    """Without a vector, or with one of another space, model or size; what is not known is stale."""
    known = F.coalesce(F.col("embedding_size") > 0, F.lit(False))
    return ~known | ~F.col("embedding_space").eqNullSafe(space) | ~F.col("embedding_model").eqNullSafe(model) | ~F.col("embedding_dim").eqNullSafe(dim)
