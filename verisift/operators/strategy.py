"""Operating decisions as Column expressions: index strategies, retrieval hints, cache keys, concurrency, readiness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Settings

# Terms and what a query that names them is widened by, in their order.
SYNONYMS = {
    "metformin": ("biguanide", "glucophage"),
    "renal": ("kidney", "egfr", "creatinine", "ckd"),
    "contraindication": ("contraindicated", "do not use", "avoid", "not recommended"),
    "allergy": ("hypersensitivity", "allergic reaction"),
    "hypertension": ("high blood pressure", "htn"),
    "diabetes": ("dm", "t2dm", "type 2 diabetes"),
}
# Names of facets by parts of other names, in their order.
FACET_ALIASES = (
    ("contraindication", "safety_contraindications"),
    ("contraindications", "safety_contraindications"),
    ("safety", "safety_contraindications"),
    ("guideline", "guideline_concordance"),
    ("recommendation", "guideline_concordance"),
    ("patient", "patient_applicability"),
    ("applicability", "patient_applicability"),
    ("quality", "evidence_quality"),
    ("grade", "evidence_quality"),
)
_NONE = "cast(array() as array<string>)"


def ingestion_strategy(content_type: Column, tokens: Column, dataset_size: Column) -> Column:
    """The index a chunk goes to."""
    return (
        F.when(dataset_size > 100_000, "faiss_only")
        .when((tokens < 200) & content_type.isin("question_part1", "answer_part1"), "tree_only")
        .when(content_type.isin("complete_dialogue", "question_final_and_answer"), "hnsw_only")
        .when(content_type.isin("question_part1", "question_and_answer_part1"), "hnsw_faiss")
        .otherwise("hnsw_only")
    )


def retrieval_strategy(top_k: Column, reranking: Column, filters: Column, priority: Column) -> Column:
    """The index a query asks."""
    return (
        F.when((priority == "speed") & (top_k > 50), "faiss_only").when(reranking, "hnsw_faiss").when((top_k < 5) & filters, "tree_only").when(top_k > 20, "faiss_only").otherwise("hnsw_only")
    )


def index_config(size: Column) -> Column:
    """Parameters of each kind of index at a number of vectors."""
    lists = F.greatest(F.lit(100), F.least(F.floor(size / 1000), F.lit(8192)))
    return F.struct(
        F.when(size < 50_000, 16).otherwise(32).alias("m"), F.lit(200).alias("ef_construction"), (size * 2).cast("long").alias("max_elements"), lists.cast("long").alias("n_clusters"),
        F.least(F.lit(100), F.floor(lists / 10)).cast("long").alias("n_probe"), F.when(size < 100_000, 8).otherwise(16).alias("n_trees"),
    )


def should_rebuild(exists: Column, new: Column, current: Column, threshold: float = 0.2) -> Column:
    """An index that is absent, or that grows by the threshold or more, is built anew."""
    return ~exists | (F.when(current > 0, new / current).otherwise(1.0) >= threshold)


def canonical_facet(name: Column, facets: tuple[str, ...] = ()) -> Column:
    """A name as one of ``facets``: exact, then either within the other, then by alias; else in lower case."""
    raw = F.trim(F.coalesce(name, F.lit("")))
    low = F.replace(F.lower(raw), F.lit(" "), F.lit("_"))
    out = F.when(raw == "", "clinical_evidence")
    if facets:
        out = out.when(raw.isin(*facets), raw)
    for f in facets:
        out = out.when(low.contains(f) | F.lit(f).contains(low), f)
    for part, target in FACET_ALIASES:
        if not facets or target in facets:
            out = out.when(low.contains(part), target)
    return out.otherwise(low)


def expand_query(query: Column, missing: Column) -> Column:
    """The query with synonyms of its terms and the words of missing facets, sorted, once each."""
    low = F.lower(query)
    parts = [F.when(low.contains(term), F.array(*map(F.lit, more))).otherwise(F.expr(_NONE)) for term, more in SYNONYMS.items()]
    words = F.filter(F.flatten(F.transform(F.coalesce(missing, F.expr(_NONE)), lambda m: F.split(F.replace(m, F.lit("_"), F.lit(" ")), r"\s+"))), lambda w: w != "")
    extra = F.array_sort(F.array_distinct(F.concat(*parts, words)))
    return F.when(F.size(extra) > 0, F.concat(query, F.lit(" "), F.array_join(extra, " "))).otherwise(query)


#: Facet to the agent that looks for it and its source; fixed values in their order.
ROUTES = (("guideline_concordance", "guideline", "CPG"), ("evidence_quality", "quality", "CPG"), ("patient_applicability", "emr", "EMR"), ("safety_contraindications", "safety", "SAFETY"))


def hints(missing: Column, unresolved: Column) -> Column:
    """What the next round should look for: agents, a source to focus on (the only one, if one source has all that is missing), and what to relax."""
    has = lambda f: F.coalesce(F.array_contains(missing, f), F.lit(False))
    contested = F.coalesce(unresolved > 0, F.lit(False))
    agents = F.array_compact(F.array(*[F.when(has(f), F.lit(a)) for f, a, _ in ROUTES], F.when(contested, F.lit("critic"))))
    sources = F.array_distinct(F.array_compact(F.array(*[F.when(has(f), F.lit(x)) for f, _, x in ROUTES])))
    safety = has("safety_contraindications")
    return F.struct(
        F.lit(True).alias("increase_k"), (safety | contested).alias("relax_filters"), (F.coalesce(F.size(missing), F.lit(0)) > 0).alias("expand_synonyms"), missing.alias("missing"),
        F.get(sources, F.lit(0)).alias("focus"), (F.size(sources) == 1).alias("exclusive"), safety.alias("safety_search"), contested.alias("contradiction_review"),
        F.get(agents, F.lit(0)).alias("routed_agent"), agents.alias("agents"),
    )


def apply_hints(
    focus: Column, exclusive: Column, safety: Column, relax: Column, review: Column, increase_k: Column, top_k: Column, policy: Column, min_grade: Column, s: Settings = Settings(), timeframe: Column | None = None  # noqa: B008
) -> Column:
    """``k, source, policy, preferred, safety_search, min_grade, relaxed, review`` (and ``timeframe``) of the next round of retrieval.

    A focus is exclusive unless the hints say otherwise; relaxing drops the least grade and the timeframe.
    """
    known, exclusive, relax = F.upper(focus).isin("CPG", "EMR", "LIT", "SAFETY"), F.coalesce(exclusive, F.lit(True)), F.coalesce(relax, F.lit(False))
    only = F.coalesce(known & exclusive, F.lit(False))
    k = F.when(increase_k, s.k_more).otherwise(F.coalesce(F.when(top_k != 0, top_k), F.lit(s.k)))
    return F.struct(
        F.when(review, F.greatest(k, F.lit(s.k_more))).otherwise(k).cast("int").alias("k"),
        F.when(only, F.upper(focus)).alias("source"),
        F.when(only, F.concat(F.upper(focus), F.lit("_ONLY"))).when(safety, F.coalesce(policy, F.lit("ANY"))).otherwise(policy).alias("policy"),
        F.when(~exclusive, F.upper(focus)).alias("preferred"),
        safety.alias("safety_search"),
        F.when(~relax, min_grade).alias("min_grade"),
        relax.alias("relaxed"),
        review.alias("review"),
        *([] if timeframe is None else [F.when(~relax, timeframe).alias("timeframe")]),
    )


def scope_key(org: Column, source: Column, patient: Column, constraints: Column, space: str = "local") -> Column:
    """The key of a scope's cached index: the tenant and the start of a digest of the scope as JSON with sorted keys.

    ``constraints`` is JSON with sorted keys, as separators ", " and ": " write it.
    """
    text = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    payload = F.concat(
        F.lit('{"constraints": '), F.coalesce(constraints, F.lit("{}")), F.lit(', "org_id": '), text(org), F.lit(', "patient_id": '), text(patient), F.lit(', "source": '), text(source), F.lit(f', "space": "{space}"}}')
    )
    return F.concat(org, F.lit("_"), F.substring(F.sha2(payload, 256), 1, 16))


def concurrency_plan(pipeline: Column, most: Column, reranker: Column) -> Column:
    """``reranker_budget, cases, setup``: pipelines without a reranker follow the limit alone."""
    limit = F.greatest(F.lit(1), F.coalesce(most, F.lit(1)))
    budget = F.greatest(F.lit(1), F.least(F.coalesce(F.when(reranker != 0, reranker), F.lit(1)), limit))
    naive = pipeline == "naive_rag"
    return F.struct(
        F.when(naive, 0).otherwise(budget).cast("int").alias("reranker_budget"), F.when(naive, limit).otherwise(F.least(limit, budget)).cast("int").alias("cases"), F.least(limit, F.lit(4)).cast("int").alias("setup")
    )


def readiness_error(up: Column, chunks: Column, embedded: Column) -> Column:
    """Why a run without the gate can't start: ``unavailable`` or ``no_embeddings``; null if it can."""
    return F.when(~F.coalesce(up, F.lit(False)), "unavailable").when((chunks > 0) & (embedded == 0), "no_embeddings")


def embedding_response(body: Column) -> Column:
    """Vectors out of a service's JSON: ``data[].embedding``, ``embeddings`` or ``embeddings.float``, or a bare list."""
    kind = "array<array<float>>"
    listed = F.from_json(F.get_json_object(body, "$.data"), "array<struct<embedding:array<float>>>")
    own = F.filter(F.transform(listed, lambda x: x["embedding"]), lambda v: v.isNotNull())
    inner = F.get_json_object(body, "$.embeddings")
    typed = F.coalesce(F.get_json_object(body, "$.embeddings.float"), F.get_json_object(body, "$.embeddings.float_"))
    empty = F.expr(f"cast(array() as {kind})")
    return (
        F.when(listed.isNotNull(), own).when(inner.startswith("["), F.from_json(inner, kind)).when(inner.isNotNull(), F.coalesce(F.from_json(typed, kind), empty))
        .when(F.ltrim(body).startswith("["), F.from_json(body, kind)).otherwise(empty)
    )
