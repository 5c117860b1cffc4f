"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent and normalised. The exponent
is found by repeated section of [0, 1]: either the entropy of the weights
reaches a target, or the most repeated source stays within a repetition
limit. The weights are realised as block permutations with a token budget:
each source's documents lie in a keyed random order along its token line, the
line is wrapped until the source's budget is spent, and the same fraction of
each line falls into each block, which is then permuted.

Tokens are white-space separated words. Null sources form one source of their
own. A document without tokens is scheduled exactly once. Repeated rows are
scheduled each. An empty table gives an empty schedule.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, ordered_prefix, same_doc, stage, text_or_empty, wrapped

_NO_SOURCE = "\x00none"
#: Sources up to which their table is broadcast; beyond it the joins shuffle.
BROADCAST_SOURCES = 100_000


def fit_exponent(shares: DataFrame, target_entropy: float | None, max_repetition: float | None, grid: int = 64, rounds: int = 4) -> float:
    """The largest exponent whose weights reach the entropy, or the smallest within the repetition limit.

    ``shares`` has a row ``p`` a source; each round is one aggregate over it, so any number of sources will do.
    Repetition is a source's passes over those of the least repeated one.
    """
    lo, hi = 0.0, 1.0

    def measure(points: list[float]) -> list[tuple[float, float]]:
        """Entropy, and repetition, at each exponent."""
        aggs = [F.min("p").alias("lo"), F.max("p").alias("hi")]
        for i, a in enumerate(points):
            aggs += [F.sum(F.pow("p", F.lit(a))).alias(f"z{i}"), F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias(f"l{i}")]
        r = shares.where("p > 0").agg(*aggs).first()
        if r["lo"] is None:
            return [(0.0, 1.0) for _ in points]
        return [(math.log(r[f"z{i}"]) - a * r[f"l{i}"] / r[f"z{i}"], (r["hi"] / r["lo"]) ** (1 - a)) for i, a in enumerate(points)]

    for _ in range(rounds):
        points = [lo + (hi - lo) * i / (grid - 1) for i in range(grid)]
        seen = measure(points)
        if target_entropy is not None:
            good = [i for i, (h, _) in enumerate(seen) if h >= target_entropy - 1e-12]
            if not good or good[-1] == grid - 1:
                return points[good[-1]] if good else 0.0
            lo, hi = points[good[-1]], points[good[-1] + 1]
        else:
            good = [i for i, (_, rep) in enumerate(seen) if rep <= (max_repetition or math.inf) + 1e-12]
            if not good or good[0] == 0:
                return points[good[0]] if good else 1.0
            lo, hi = points[good[0] - 1], points[good[0]]
    return lo if target_entropy is not None else hi


def mix(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_repetition: float | None = 2.0,
    budget_tokens: int | None = None,
    block_tokens: int = 1_000_000,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """A row for each scheduled copy: ``doc_id, th, source, n_tokens, copy, block, slot, weight, exponent``.

    Without ``budget_tokens`` the budget is the smallest that schedules every
    document at least once, so no document is lost to mixing.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = stage(
        docs.select(
            F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), F.coalesce(F.col(source_col).cast("string"), F.lit(_NO_SOURCE)).alias("src"),
            F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("n_tokens"),
        ),
        "mix-rows",
    )
    sources = stage(rows.groupBy("src").agg(F.sum("n_tokens").alias("t")), "mix-sources")
    total = sources.agg(F.sum("t")).first()[0] or 0
    shares = sources.withColumn("p", F.col("t") / F.lit(float(max(total, 1))))
    exponent = fit_exponent(shares, target_entropy, max_repetition)
    z = shares.where("p > 0").agg(F.sum(F.pow("p", F.lit(exponent)))).first()[0] or 1.0
    weighted = shares.withColumn("weight", F.when(F.col("p") > 0, F.pow("p", F.lit(exponent)) / z).otherwise(0.0))
    cover = weighted.where("weight > 0").agg(F.max(F.col("t") / F.col("weight"))).first()[0] or 0.0
    budget = float(budget_tokens) if budget_tokens else cover
    weighted = weighted.withColumn("quota", F.greatest(F.round(F.col("weight") * budget, 0), F.lit(0) if budget_tokens else F.col("t").cast("double")))
    blocks = max(1, math.ceil(budget / block_tokens))

    order = rows.withColumn("h", F.xxhash64(F.lit(seed), "th", "doc_id"))
    order = ordered_prefix(order, ["src", "h", "doc_id"], ["n_tokens"], "mix-order")
    order = stage(order, "mix-placed")
    begins = order.groupBy("src").agg(F.min("before_n_tokens").alias("s0"))
    begins = stage(begins.join(weighted, "src"), "mix-begins")
    line = order.join(F.broadcast(begins) if begins.count() <= BROADCAST_SOURCES else begins, "src").withColumn("at", F.col("before_n_tokens") - F.col("s0"))
    copies = F.when(F.col("t") > 0, F.ceil((F.col("quota") - F.col("at")) / F.col("t"))).otherwise(F.lit(0)).cast("int")
    copies = F.greatest(copies, F.when(F.col("n_tokens") == 0, 1).otherwise(0))
    line = line.withColumn("copies", copies).where("copies > 0")
    line = line.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    by_hash = F.pmod(F.xxhash64("h", F.lit(1)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    x = F.when((F.col("t") > 0) & (F.col("quota") > 0) & (F.col("n_tokens") > 0), (F.col("copy") * F.col("t") + F.col("at")) / F.col("quota")).otherwise(by_hash)
    line = line.withColumn("block", F.least(F.floor(x * blocks), F.lit(blocks - 1)).cast("long"))
    line = line.withColumn("key", F.xxhash64(F.lit(seed + 1), "block", "h", "copy", "doc_id"))
    # A block holds about block_tokens tokens however large the corpus is.
    line = line.withColumn("slot", F.expr("row_number() over (partition by block order by key, doc_id, copy) - 1").cast("long"))
    source = F.when(F.col("src") == _NO_SOURCE, None).otherwise(F.col("src"))
    return line.select(
        "doc_id", "th", source.alias("source"), "n_tokens", "copy", "block", "slot", F.round("weight", 9).alias("weight"), F.lit(round(exponent, 9)).alias("exponent")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The input's rows and columns, each as often as it is scheduled."""
    times = mix(docs, **options).groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("k"))
    rows = wrapped(docs)
    # Rows that repeat a document share its copies.
    same = rows.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    times = times.join(same, same_doc(times, same)).select(times["doc_id"], times["th"], F.ceil(F.col("k") / F.col("n")).cast("int").alias("k"))
    joined = rows.join(times, same_doc(rows, times)).select("row", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("copy"))
    return joined.select("row.*")
