"""Quality rules: a decision list learned by sequential covering.

Labelled documents are measured; rules for the bad class are grown one at a
time as conjunctions of thresholds (FOIL's gain on the growing part), pruned
on a held-out part, and kept while they are precise enough there. The list
becomes one ordered ``CASE WHEN`` expression over the statistics.

Null and empty texts have zero statistics and fail the base rule; tables
without labels give an empty list, which keeps what passes the base rule;
repeated rows get equal results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, text_or_empty, unstage, whole_row
from .stats import RATIOS, RAW, labelled_sample, learn_lexicon, measure, stats_of, with_stats

FEATURES = (*RATIOS, "n_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.threshold if self.op == ">=" else c <= self.threshold

    def test(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v >= self.threshold if self.op == ">=" else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {self.op} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.test(x)
    return out


def _grow(x: np.ndarray, y: np.ndarray, most: int, cuts: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < most:
        p0, n0 = int((inside & y).sum()), int((inside & ~y).sum())
        if not p0 or not n0:
            break
        base, best, choice = math.log2(p0 / (p0 + n0)), 1e-9, None
        for j, name in enumerate(FEATURES):
            values = np.unique(x[inside, j])
            if len(values) > cuts:
                values = np.unique(np.quantile(values, np.linspace(0, 1, cuts), method="nearest"))
            values = (values[1:] + values[:-1]) / 2  # half way between what was seen
            for t in values:
                for op in (">=", "<="):
                    hit = inside & (x[:, j] >= t if op == ">=" else x[:, j] <= t)
                    p, n = int((hit & y).sum()), int((hit & ~y).sum())
                    if p and (gain := p * (math.log2(p / (p + n)) - base)) > best:
                        best, choice = gain, Condition(name, op, round(float(t), 6))
        if choice is None:
            break
        rule += (choice,)
        inside &= choice.test(x)
    return rule


def _worth(rule: Rule, x: np.ndarray, y: np.ndarray) -> float:
    hit = _covers(rule, x)
    p, n = int((hit & y).sum()), int((hit & ~y).sum())
    return (p - n) / (p + n) if p + n else -1.0


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    return max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(r, x, y)) if rule else rule


def learn(x: np.ndarray, bad: np.ndarray, grow_part: np.ndarray, precision: float = 0.85, least: int = 3, max_rules: int = 12, max_conditions: int = 3, cuts: int = 41) -> list[Rule]:
    """Sequential covering over rows ``x`` (columns ``FEATURES``)."""
    left, rules = np.ones(len(x), bool), []
    while len(rules) < max_rules:
        g, h = left & grow_part, left & ~grow_part
        if (g & bad).sum() < least:
            break
        rule = _prune(_grow(x[g], bad[g], max_conditions, cuts), x[h], bad[h])
        if not rule:
            break
        hit = _covers(rule, x)
        p, n = int((hit & h & bad).sum()), int((hit & h & ~bad).sum())
        pg = int((hit & g & bad).sum())
        # The held-out share decides; a rule it hardly sees must be pure where it was grown.
        if pg < least or (p + n >= least and p / (p + n) < precision) or (p + n < least and (n or (hit & g & ~bad).sum())):
            break
        rules.append(rule)
        left &= ~hit
    return rules


@dataclass
class DecisionList:
    rules: list[Rule]
    lexicon: list[str]

    def verdict(self) -> Column:
        """The number of the first rule that fires, 0 if none: the ordered conditional expression."""
        out = F
        for k, rule in enumerate(self.rules, 1):
            cond = rule[0].column()
            for c in rule[1:]:
                cond = cond & c.column()
            out = out.when(cond, k)
        return out.otherwise(0) if self.rules else F.lit(0)

    def __str__(self) -> str:
        return "\n".join(f"{k}: reject if {' and '.join(map(str, r))}" for k, r in enumerate(self.rules, 1)) + "\nelse keep"


def fit(docs: DataFrame, labels: DataFrame, n_rows: int = 4000) -> DecisionList:
    """Fit on at most ``n_rows`` labelled documents; bad means quality 0 or toxic 1. Only their statistics come to the driver."""
    sample = labelled_sample(docs, labels, n_rows)
    lexicon = learn_lexicon(sample)
    words = frozenset(lexicon)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(1).to_pylist()
            x = [[*(m := measure(t, words))[1], float(m[0][0])] for t in texts]
            grow = [xxhash.xxh64_intdigest(t) % 3 != 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64())), pa.array(grow, pa.bool_()), b.column(2)], names=["doc_id", "x", "grow", "bad"])

    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    kind = dict(sample.dtypes)["doc_id"]
    rows = sorted(sample.select("doc_id", "text", bad.alias("bad")).mapInArrow(run, f"doc_id {kind}, x array<double>, grow boolean, bad boolean").collect(), key=lambda r: r["doc_id"])
    unstage(sample)
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES))
    bad, grow = (np.array([r[c] for r in rows], bool) for c in ("bad", "grow"))
    usable = (x[:, -1] >= 50) & (100 * x[:, FEATURES.index("repeat_ratio")] <= 50)  # the base rule has the others
    return DecisionList(learn(x[usable], bad[usable], grow[usable]) if len(x) else [], lexicon)


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """``doc_id, th``, the raw statistics, ``base_failed, rule, kept``; no shuffle."""
    rows = with_stats(keyed(docs), rules.lexicon)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select("doc_id", "th", *RAW, failed.alias("base_failed"), rules.verdict().alias("rule")).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def kept_documents(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """Rows and columns of ``docs`` whose document is kept; statistics are taken beside the row, so nothing is joined and the row itself never goes to Python."""
    marked = docs.select(whole_row(docs).alias("_row"), stats_of(text_or_empty(), rules.lexicon).alias("_stats")).select("_row", "_stats.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return marked.where(~failed & (rules.verdict() == 0)).select("_row.*")
