"""The driver tables in the roles of the evidence model: chunks, candidates, facets, qrels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk, with metadata that depends on its id alone."""
    d = F.col("doc_id")
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    source = pick(("CPG", "EMR", "LIT", "SAFETY"), d)
    return table(spark, sf_dir, "documents").select(
        d.alias("chunk_id"), d, F.concat(F.lit("org"), (d % 3).cast("string")).alias("org_id"), source.alias("source_type"),
        F.when(d % 4 == 1, F.concat(F.lit("p"), (d % 10).cast("string"))).alias("patient_id"), "text", "lang", "source",
        pick(("Background", "Recommendation", "Warning signs", "Methods"), F.floor(d / 4)).alias("section"),
        ((d % 11) / 10.0).alias("grade_score"), ((d % 8) / 8.0).alias("reliability"), F.date_add(F.lit("2015-01-01").cast("date"), (d % 3650).cast("int")).alias("effective_date"),
        F.when(d % 9 == 0, "old").otherwise("cur").alias("embedding_space"), F.when(d % 10 == 0, 32).when(d % 23 == 0, 0).otherwise(64).alias("embedding_dim"),
        (d % 13 == 0).alias("obsolete"), (d % 17 == 0).alias("mismatch"), (d % 19 == 0).alias("weak"),
        F.date_add(F.lit("2014-06-01").cast("date"), (d * 7 % 3650).cast("int")).alias("stamp"), F.when(d % 14 == 0, None).when(d % 15 == 0, "m0").otherwise("m1").alias("embedding_model"),
        F.when(d % 21 == 0, None).when(d % 22 == 0, 0).otherwise(64).alias("embedding_size"), F.array(pick(("cardio", "renal", "neuro"), F.floor(d / 2)), F.lit("general")).alias("tags"),
        pick(("rct", "cohort", "systematic review", "case report", "observational", ""), F.floor(d / 3)).alias("design"), pick(("cardio", "renal", "onco"), d).alias("specialty"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as candidates of a query: 25 to a query, however many there are, with first-stage scores."""
    d = F.col("doc_id")
    return chunks(spark, sf_dir).select(
        "*", F.floor(d / 25).cast("long").alias("query_id"), ((d * 37 % 101) / 100.0).alias("rerank"), ((d * 53 % 97) / 96.0).alias("dense"),
        F.when(d % 3 != 0, (d * 29 % 89) / 88.0).alias("lexical"), word_count(F.col("text")).alias("tokens"),
    )


#: Stems that do occur in the driver's invented texts stand in for clinical ones.
SAFETY_STEMS = ("sch", "mente", "ouou", "ung", "blest", "whou", "ness", "license")
CONFLICT_STEMS = ("ouou", "blest", "ness", "license", "token", "###")
NEGATIVE = ("blest", "whou", "license")
QUALIFY = ("ness", "ouou")
FACETS = (
    ("guideline_concordance", 0.78, 1.20, "CPG_ONLY", True, ("sch", "ness")),
    ("safety_contraindications", 0.78, 1.35, "SAFETY_ONLY", True, ("mente", "ung")),
    ("patient_applicability", 0.70, 1.05, "ANY", False, ("ouou", "whou")),
    ("evidence_quality", 0.70, 0.95, "ANY", True, ("blest", "license", "token")),
)


def facets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FACETS, "facet string, threshold double, weight double, policy string, required boolean, keywords array<string>")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements: a case for 50 labelled documents, graded by their labels."""
    return table(spark, sf_dir, "labels").select(
        F.floor(F.col("doc_id") / 50).cast("long").alias("case_id"), "doc_id", F.greatest(F.lit(0), 2 * F.col("quality") - F.col("toxic")).cast("int").alias("grade")
    )
