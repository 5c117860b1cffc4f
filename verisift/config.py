"""Fixed values of the evidence model, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

# Source priors, grades, stems and weights that results depend on.
SOURCES = ("CPG", "EMR", "LIT", "SAFETY")
SOURCE_SCORE = {"CPG": 0.95, "EMR": 0.85, "LIT": 0.75, "SAFETY": 0.88}
EBM = {"cpg": 0.95, "sr": 0.90, "rct": 0.86, "obs": 0.62, "case": 0.38, "emr": 0.70, "safety": 0.88}
FUSION_SAFETY_STEMS = ("contraindicat", "allergy", "adverse", "interaction", "avoid", "renal", "pregnan", "dose")
FACET_SAFETY_STEMS = ("contraindicat", "allergy", "adverse", "interaction", "avoid", "risk", "toxicity", "dose")
CONTRADICTION_STEMS = ("conflict", "not recommended", "avoid", "insufficient", "uncertain", "contraindicat")
NEGATIVE_STEMS = ("contraindicat", "not recommended", "avoid", "do not", "should not")
QUALIFY_STEMS = ("unless", "except", "caution", "monitor")
SECTION_HIGH = ("recommendation", "guideline", "contraindication", "warning")
SECTION_LOW = ("background", "introduction")


@dataclass(frozen=True)
class Weights:
    """Weights of the fusion score's log-odds sum."""

    rerank: float = 0.45
    dense: float = 0.25
    lexical: float = 0.10
    recency: float = 0.07
    section: float = 0.08
    source: float = 0.05
    ebm: float = 0.12
    safety: float = 0.35
    noise: float = 0.20
    clip: float = 8.0

    def __post_init__(self) -> None:
        total = self.rerank + self.dense + self.lexical + self.recency + self.section + self.source
        if not 0.1 <= total <= 2.0:
            raise ValueError(f"fusion weights sum to {total:g}, outside [0.1, 2]")


@dataclass(frozen=True)
class Settings:
    """Operating values: retrieval breadth, budgets and thresholds."""

    k: int = 80
    k_more: int = 120
    loops: int = 3
    token_budget: int = 1800
    max_passages: int = 10
    min_utility: float = 2e-4
    entropy_max: float = 0.88
    max_contradictions: int = 0
    grade_gap: float = 0.25
    high_grade: float = 0.80
    protect: float = 0.48
    weights: Weights = field(default_factory=Weights)

    def __post_init__(self) -> None:
        for name in ("entropy_max", "grade_gap", "high_grade", "protect"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie in [0, 1]")


# The facets that a question of a type asks for (type, place, id, name, weight, critical, threshold, source, keywords).
TEMPLATES = (
    ("diagnosis", 0, "dx", "diagnosis evidence", 1.0, True, 0.76, "LIT", ["diagnosis", "symptom", "findings", "assessment", "differential", "presentation"]),
    ("diagnosis", 1, "patient_fit", "patient applicability", 1.0, True, 0.74, "EMR", ["patient", "history", "pmh", "age", "male", "female", "comorbidity", "medication"]),
    ("test", 0, "test_indication", "test indication", 1.0, True, 0.76, "LIT", ["test", "indication", "diagnostic", "screening", "workup", "evaluation"]),
    ("test", 1, "patient_fit", "patient applicability", 1.0, True, 0.74, "EMR", ["patient", "history", "pmh", "age", "pregnancy", "comorbidity", "allergy"]),
    ("test", 2, "risk", "test risks or limitations", 0.75, False, 0.70, "LIT", ["risk", "limitation", "contraindication", "false positive", "false negative", "harm"]),
    ("treatment", 0, "treatment", "treatment recommendation evidence", 1.0, True, 0.76, "LIT", ["treatment", "recommendation", "management", "therapy", "dose", "intervention"]),
    ("treatment", 1, "safety", "safety contraindications or adverse risks", 1.2, True, 0.76, "LIT", ["safety", "contraindication", "adverse", "risk", "avoid", "interaction"]),
    ("treatment", 2, "patient_fit", "patient applicability", 1.0, True, 0.74, "EMR", ["patient", "history", "pmh", "age", "comorbidity", "allergy", "medication"]),
    ("*", 0, "clinical_evidence", "clinically relevant evidence", 1.0, True, 0.76, "LIT", ["evidence", "finding", "diagnosis", "treatment", "management"]),
    ("*", 1, "patient_fit", "patient applicability", 1.0, True, 0.74, "EMR", ["patient", "history", "pmh", "age", "comorbidity", "allergy", "medication"]),
)


@dataclass(frozen=True)
class Facet:
    name: str
    threshold: float
    weight: float
    policy: str
    required: bool
    keywords: tuple[str, ...] = ()


DEFAULT_FACETS = (
    Facet("guideline_concordance", 0.78, 1.20, "CPG_ONLY", True, ("guideline", "recommend")),
    Facet("safety_contraindications", 0.78, 1.35, "SAFETY_ONLY", True, ("contraindicat", "adverse", "avoid")),
    Facet("patient_applicability", 0.70, 1.05, "ANY", False, ("patient", "elderly")),
    Facet("evidence_quality", 0.70, 0.95, "ANY", True, ("trial", "evidence", "study")),
)
