"""Filters and scalar scores over all chunks and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as X
from ..operators import filters as P
from ..operators import strategy as D
from ..sources import tables as T
from .base import CANDIDATES, CHUNKS, Registry

query = Registry()
IDS = ("chunk_id", "org_id", "source_type")


def _filter(name: str, where, sql: str, *more: str) -> None:
    cols = (*IDS, *more)
    query(f"SELECT {', '.join(cols)} FROM chunks WHERE {sql}", CHUNKS, name)(lambda s, d: T.chunks(s, d).where(where()).select(*cols))


_filter("filter_tenant", lambda: P.tenant("org1"), "org_id = 'org1'")
_filter("filter_source_policy", lambda: P.Scope("org1", policy="SAFETY_ONLY").column(), "org_id = 'org1' AND source_type = 'SAFETY'")
_filter("filter_patient_mixed", lambda: P.Scope("org1", patient_id="p5").column(), "org_id = 'org1' AND (source_type <> 'EMR' OR patient_id = 'p5')", "patient_id")
_filter("filter_patient_hard", lambda: P.Scope("org1", source="EMR", patient_id="p5").column(), "org_id = 'org1' AND source_type = 'EMR' AND patient_id = 'p5'", "patient_id")
_filter("filter_min_grade", lambda: P.Scope("org0", min_grade=0.7).column(), "org_id = 'org0' AND (grade_score >= 0.7 OR reliability >= 0.7)", "grade_score", "reliability")
_filter("filter_timeframe", lambda: P.Scope("org2", start="2015-06-01", end="2016-05-31").column(), "org_id = 'org2' AND (stamp BETWEEN DATE '2015-06-01' AND DATE '2016-05-31' OR effective_date BETWEEN DATE '2015-06-01' AND DATE '2016-05-31')")
_filter("filter_year", lambda: P.Scope("org1", start="2017").column(), "org_id = 'org1' AND (year(stamp) = 2017 OR year(effective_date) = 2017)", "stamp", "effective_date")
_filter("filter_specialties", lambda: P.Scope("org1", specialties=("neuro", "onco")).column(), "org_id = 'org1' AND (list_contains(tags, 'neuro') OR list_contains(tags, 'onco') OR specialty IN ('neuro', 'onco'))", "specialty")
_filter("filter_safety_search", lambda: P.tenant("org0") & P.safety_search(text=("license", "blest")), "org_id = 'org0' AND (source_type = 'SAFETY' OR regexp_matches(section, '(?i)contraindicat|warning|adverse|interaction') OR regexp_matches(text, '(?i)license|blest'))")
_filter("filter_embedding_space", lambda: P.Scope("org1", space="cur", dim=64, model="m1").column(), "org_id = 'org1' AND embedding_space = 'cur' AND embedding_dim = 64 AND embedding_model = 'm1'")
_filter("stale_embeddings", lambda: P.stale_embedding("cur", "m1", 64), "coalesce(embedding_size, 0) = 0 OR embedding_space <> 'cur' OR coalesce(embedding_model, '') <> 'm1' OR embedding_dim <> 64", "embedding_dim")
_filter("active_embeddings", lambda: (F.col("embedding_dim") > 0) & (F.col("embedding_space") == "cur"), "embedding_dim > 0 AND embedding_space = 'cur'")
_filter("filter_scope_any", lambda: P.Scope("org2", min_grade=0.5, start="2015-03-01", safety_search=True).column(), "org_id = 'org2' AND (grade_score >= 0.5 OR reliability >= 0.5) AND (stamp >= DATE '2015-03-01' OR effective_date >= DATE '2015-03-01') AND (source_type = 'SAFETY' OR regexp_matches(section, '(?i)contraindicat|warning|adverse|interaction') OR regexp_matches(text, '(?i)contraindicat|adverse|interaction|avoid'))")
_filter("filter_scope_patient", lambda: P.Scope("org1", patient_id="p5", min_grade=0.3, space="cur", dim=64).column(), "org_id = 'org1' AND (source_type <> 'EMR' OR patient_id = 'p5') AND (grade_score >= 0.3 OR reliability >= 0.3) AND embedding_space = 'cur' AND embedding_dim = 64")

AS_OF = "2017-01-01"


def _score(name: str, column, sql: str) -> None:
    query(f"SELECT chunk_id, round({sql}, 6) AS score FROM cand", CANDIDATES, name)(lambda s, d: T.candidates(s, d).select("chunk_id", F.round(column(), 6).alias("score")))


_stems = lambda xs, c="text": " + ".join(f"contains(lower({c}), '{x}')::INT" for x in xs)
RECENCY = f"exp(-greatest(DATE '{AS_OF}' - effective_date, 0) / 730.0::DOUBLE)"
SECTION = "CASE WHEN regexp_matches(lower(section), 'recommendation|guideline|contraindication|warning') THEN 1.0 WHEN regexp_matches(lower(section), 'background|introduction') THEN 0.3 ELSE 0.65 END::DOUBLE"
SOURCE = "CASE source_type WHEN 'CPG' THEN 0.95 WHEN 'EMR' THEN 0.85 WHEN 'SAFETY' THEN 0.88 ELSE 0.75 END::DOUBLE"
SAFETY = f"least(1.0, ({_stems(T.SAFETY_STEMS)}) * 0.16)::DOUBLE"
NOISE = "least(1.0, obsolete::INT * 0.45 + mismatch::INT * 0.35 + weak::INT * 0.25)::DOUBLE"
_LABEL = "lower(coalesce(nullif(design, ''), source_type))"
GRADE = f"""CASE WHEN source_type = 'CPG' OR contains({_LABEL}, 'guideline') THEN 0.95 WHEN contains({_LABEL}, 'systematic') THEN 0.90 WHEN contains({_LABEL}, 'rct') OR contains({_LABEL}, 'trial') THEN 0.86
 WHEN contains({_LABEL}, 'observ') THEN 0.62 WHEN contains({_LABEL}, 'case') THEN 0.38 WHEN source_type = 'EMR' THEN 0.70 WHEN source_type = 'SAFETY' THEN 0.88 ELSE 0.5 * 0.62 + 0.3 * 0.86 END::DOUBLE"""
_clip = lambda x, c: f"greatest(-{c}::DOUBLE, least({c}::DOUBLE, {x}))"
_P = "greatest(1e-6, least(1 - 1e-6, coalesce(nullif(rerank, 0), 0.5)))"
FUSED = f"""1 / (1 + exp(-{_clip(f"0.45 * {_clip(f'ln({_P} / (1 - {_P}))', 8)} + 0.25 * dense + 0.10 * coalesce(lexical, 0) + 0.07 * {RECENCY} + 0.08 * {SECTION} + 0.05 * {SOURCE} + 0.12 * {GRADE} + 0.35 * {SAFETY} - 0.20 * {NOISE}", 8)}))"""


def fused():
    """The fusion score of a candidate, with stems that the driver's texts have."""
    c = F.col
    noise = S.noise_score(c("obsolete"), c("mismatch"), c("weak"), c("chunk_id").isNull() | c("doc_id").isNull())
    return S.fusion(
        c("rerank"), c("dense"), c("lexical"), S.recency(c("effective_date"), F.lit(AS_OF).cast("date")), S.section_score(c("section")), S.source_score(c("source_type")),
        S.evidence_grade(c("source_type"), c("design")), S.safety_score(c("text"), T.SAFETY_STEMS), noise,
    )


_score("recency_score", lambda: S.recency(F.col("effective_date"), F.lit(AS_OF).cast("date")), RECENCY)
_score("section_score", lambda: S.section_score(F.col("section")), SECTION)
_score("source_score", lambda: S.source_score(F.col("source_type")), SOURCE)
_score("safety_score", lambda: S.safety_score(F.col("text"), T.SAFETY_STEMS), SAFETY)
_score("contradiction_score", lambda: S.contradiction_score(F.col("text"), T.CONFLICT_STEMS), f"least(1.0, ({_stems(T.CONFLICT_STEMS)}) * 0.16)::DOUBLE")
_score("noise_score", lambda: S.noise_score(F.col("obsolete"), F.col("mismatch"), F.col("weak"), F.lit(False)), NOISE)
_score("evidence_grade", lambda: S.evidence_grade(F.col("source_type"), F.col("design"), F.when(F.col("doc_id") % 6 == 0, F.col("grade_score") * 1.2)), f"CASE WHEN doc_id % 6 = 0 THEN least(1, grade_score * 1.2) ELSE {GRADE} END")
_score("calibrate_platt", lambda: S.calibrate(F.col("rerank"), 0.3, 1.7), "1 / (1 + exp(-(ln(greatest(1e-6, least(1 - 1e-6, rerank)) / (1 - greatest(1e-6, least(1 - 1e-6, rerank)))) - 0.3) / 1.7))")
_score("fusion_score", fused, FUSED)
_score("facet_entropy", lambda: S.entropy(F.col("dense")), "CASE WHEN dense <= 0 OR dense >= 1 THEN 0 ELSE -(dense * log2(dense) + (1 - dense) * log2(1 - dense)) END")


@query("SELECT chunk_id, tokens FROM cand", CANDIDATES)
def token_counts(s, d):
    return T.candidates(s, d).select("chunk_id", "tokens")


@query(f"""SELECT chunk_id, CASE WHEN {" OR ".join(f"contains(lower(text), '{x}')" for x in T.NEGATIVE)} THEN CASE WHEN source_type = 'SAFETY' THEN 'SAFETY' ELSE 'CONTRADICTS' END
 WHEN {" OR ".join(f"contains(lower(text), '{x}')" for x in T.QUALIFY)} THEN 'QUALIFIES' ELSE 'SUPPORTS' END AS polarity FROM chunks""", CHUNKS)
def polarity(s, d):
    return T.chunks(s, d).select("chunk_id", S.polarity(F.col("text"), F.col("source_type") == "SAFETY", T.NEGATIVE, T.QUALIFY).alias("polarity"))


_DESIGN = "CASE WHEN doc_id % 5 = 0 THEN 'bogus' WHEN doc_id % 7 <> 0 THEN source_type END"


@query(f"""SELECT chunk_id, CASE WHEN st IS NULL THEN 'CPG' WHEN st IN ('CPG','EMR','LIT','SAFETY') THEN st ELSE 'LIT' END AS source_type, coalesce(nullif(trim(section), ''), 'body') AS section,
 round(dense, 6) AS dense_score, 'dense' AS retrieved_by FROM (SELECT *, {_DESIGN} AS st FROM cand)""", CANDIDATES)
def candidate_projection(s, d):
    st = F.when(F.col("doc_id") % 5 == 0, "bogus").when(F.col("doc_id") % 7 != 0, F.col("source_type"))
    kind = F.when(st.isNull(), "CPG").when(st.isin("CPG", "EMR", "LIT", "SAFETY"), st).otherwise("LIT")
    return T.candidates(s, d).select("chunk_id", kind.alias("source_type"), F.coalesce(X.blank_to_null(F.col("section")), F.lit("body")).alias("section"), F.round("dense", 6).alias("dense_score"), F.lit("dense").alias("retrieved_by"))


#: Agents, their Beta priors and the source they read; fixed values.
AGENTS = (("emr", 8.0, 2.0, "EMR"), ("guideline", 9.0, 1.5, "CPG"), ("safety", 12.0, 2.0, "SAFETY"), ("quality", 5.0, 3.0, "LIT"), ("critic", 2.0, 2.0, None))


@query(f"""p AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {repr(x) if x else 'NULL'})" for n, a, b, x in AGENTS)}) t(agent, a, b, source_type)),
 o AS (SELECT source_type, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad FROM labels JOIN chunks USING (doc_id) GROUP BY 1),
 b AS (SELECT agent, a + coalesce(good, 0) AS a, b + coalesce(bad, 0) AS b FROM p LEFT JOIN o USING (source_type)),
 l AS (SELECT agent, a, b, greatest(0.0, least(1.0, a / (a + b) - 1.64485 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))) AS lcb FROM b)
 SELECT agent, a, b, round(lcb, 6) AS lcb, round(lcb / sum(lcb) OVER (), 6) AS weight FROM l""", CHUNKS)
def agent_weights(s, d):
    """Reliability of each agent: its prior and how the labels judged documents of its source, as a lower bound, normalised."""
    seen = T.table(s, d, "labels").join(T.chunks(s, d).select("doc_id", "source_type"), "doc_id").groupBy("source_type").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    priors = s.createDataFrame(AGENTS, "agent string, a double, b double, source_type string")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    counted = priors.join(seen, "source_type", "left").select("agent", (F.col("a") + n("good")).alias("a"), (F.col("b") + n("bad")).alias("b"))
    lcb = counted.select("*", S.beta_lcb(F.col("a"), F.col("b")).alias("lcb"))
    total = lcb.agg(F.sum("lcb").alias("t"))  # one row beside five
    return lcb.join(F.broadcast(total)).select("agent", "a", "b", F.round("lcb", 6).alias("lcb"), F.round(F.col("lcb") / F.col("t"), 6).alias("weight"))


@query(r"""SELECT conv_id, turn, CASE WHEN (SELECT count(*) FROM conversations) > 100000 THEN 'faiss_only' WHEN n < 200 AND t IN ('question_part1', 'answer_part1') THEN 'tree_only' WHEN t IN ('complete_dialogue', 'question_final_and_answer') THEN 'hnsw_only'
 WHEN t IN ('question_part1', 'question_and_answer_part1') THEN 'hnsw_faiss' ELSE 'hnsw_only' END AS strategy FROM (SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '\S+')) * 5 AS n,
 (['question_part1', 'answer_part1', 'complete_dialogue', 'question_and_answer_part1', 'other'])[(conv_id + turn) % 5 + 1] AS t FROM conversations)""")
def index_strategy_ingest(s, d):
    t = T.table(s, d, "conversations")
    size = t.agg(F.count(F.lit(1)).alias("size"))  # one row
    kinds = F.array(*map(F.lit, ("question_part1", "answer_part1", "complete_dialogue", "question_and_answer_part1", "other")))
    kind = F.element_at(kinds, ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    n = X.word_count(F.coalesce("text", F.lit(""))) * 5
    return t.join(F.broadcast(size)).select("conv_id", "turn", D.ingestion_strategy(kind, n, F.col("size")).alias("strategy"))


@query("""SELECT item_id, CASE WHEN p = 'speed' AND k > 50 THEN 'faiss_only' WHEN item_id % 5 = 0 THEN 'hnsw_faiss' WHEN k < 5 AND item_id % 2 = 0 THEN 'tree_only' WHEN k > 20 THEN 'faiss_only' ELSE 'hnsw_only' END AS strategy
 FROM (SELECT item_id, ([3, 10, 30, 60])[item_id % 4 + 1] AS k, (['accuracy', 'speed', 'balanced'])[item_id % 3 + 1] AS p FROM benchmark)""")
def index_strategy_query(s, d):
    i = F.col("item_id")
    k = F.element_at(F.array(*map(F.lit, (3, 10, 30, 60))), (i % 4 + 1).cast("int"))
    priority = F.element_at(F.array(*map(F.lit, ("accuracy", "speed", "balanced"))), (i % 3 + 1).cast("int"))
    return T.table(s, d, "benchmark").select("item_id", D.retrieval_strategy(k, i % 5 == 0, i % 2 == 0, priority).alias("strategy"))


@query("""SELECT source_type, n, CASE WHEN n < 50000 THEN 16 ELSE 32 END AS m, 200 AS ef_construction, n * 2 AS max_elements, greatest(100, least(n // 1000, 8192)) AS n_clusters,
 least(100, greatest(100, least(n // 1000, 8192)) // 10) AS n_probe, CASE WHEN n < 100000 THEN 8 ELSE 16 END AS n_trees FROM (SELECT source_type, count(*) AS n FROM chunks GROUP BY 1)""", CHUNKS)
def index_config(s, d):
    g = T.chunks(s, d).groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select("source_type", "n", D.index_config(F.col("n")).alias("x")).select("source_type", "n", "x.*")


@query("""SELECT source_type, n_new, n_old, source_type = 'LIT' OR CASE WHEN n_old > 0 THEN n_new / n_old ELSE 1 END >= 0.2 AS rebuild FROM (
 SELECT source_type, count(*) FILTER (effective_date >= DATE '2017-06-01') AS n_new, count(*) FILTER (effective_date < DATE '2017-06-01') AS n_old FROM chunks GROUP BY 1)""", CHUNKS)
def index_rebuild(s, d):
    new = F.col("effective_date") >= F.lit("2017-06-01").cast("date")
    g = T.chunks(s, d).groupBy("source_type").agg(F.count_if(new).alias("n_new"), F.count_if(~new).alias("n_old"))
    return g.select("*", D.should_rebuild(F.col("source_type") != "LIT", F.col("n_new"), F.col("n_old")).alias("rebuild"))


@query("""SELECT chunk_id, org_id || '_' || substr(sha256('{"constraints": ' || CASE WHEN doc_id % 2 = 0 THEN '{"min_evidence_grade": 0.5}' ELSE '{}' END || ', "org_id": "' || org_id || '", "patient_id": ' ||
 coalesce('"' || patient_id || '"', 'null') || ', "source": "' || source_type || '", "space": "local"}'), 1, 16) AS key FROM chunks""", CHUNKS)
def scope_cache_key(s, d):
    c = F.col
    return T.chunks(s, d).select("chunk_id", D.scope_key(c("org_id"), c("source_type"), c("patient_id"), F.when(c("doc_id") % 2 == 0, '{"min_evidence_grade": 0.5}')).alias("key"))


@query("""SELECT item_id, CASE WHEN r THEN greatest(k, 120) ELSE k END AS k, CASE WHEN f IN ('CPG', 'SAFETY') AND e THEN f END AS source, CASE WHEN f IN ('CPG', 'SAFETY') AND e THEN f || '_ONLY' WHEN sa THEN coalesce(p, 'ANY') ELSE p END AS policy,
 CASE WHEN NOT e THEN f END AS preferred, sa AS safety_search, CASE WHEN NOT x THEN 0.5::DOUBLE END AS min_grade, x AS relaxed, r AS review FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 120 WHEN item_id % 3 = 0 THEN 30 ELSE 80 END AS k,
 ([NULL, 'CPG', 'SAFETY', 'WEB'])[item_id % 4 + 1] AS f, item_id % 3 <> 1 AS e, item_id % 5 < 2 AS sa, item_id % 7 = 3 AS x, item_id % 11 = 5 AS r, CASE WHEN item_id % 6 = 1 THEN 'LIT_ONLY' END AS p FROM benchmark)""")
def apply_hints(s, d):
    i = F.col("item_id")
    focus = F.when(i % 4 == 1, "cpg").when(i % 4 == 2, "Safety").when(i % 4 == 3, "web")
    h = D.apply_hints(focus, i % 3 != 1, i % 5 < 2, i % 7 == 3, i % 11 == 5, i % 2 == 0, F.when(i % 3 == 0, 30), F.when(i % 6 == 1, "LIT_ONLY"), F.lit(0.5))
    return T.table(s, d, "benchmark").select("item_id", h.alias("h")).select("item_id", "h.*")


@query("""SELECT item_id, CASE WHEN nv THEN 0 ELSE b END AS reranker_budget, CASE WHEN nv THEN m ELSE least(m, b) END AS cases, least(m, 4) AS setup FROM (SELECT *, greatest(1, least(coalesce(nullif(r, 0), 1), m)) AS b FROM (
 SELECT item_id, item_id % 2 = 0 AS nv, greatest(1, coalesce(nullif(item_id % 9, 8), 1)) AS m, item_id % 5 AS r FROM benchmark))""")
def concurrency_plan(s, d):
    i = F.col("item_id")
    p = D.concurrency_plan(F.when(i % 2 == 0, "naive_rag").otherwise("full"), F.nullif(i % 9, F.lit(8)), i % 5)
    return T.table(s, d, "benchmark").select("item_id", p.alias("p")).select("item_id", "p.*")


@query("SELECT org_id, count(*) AS n_chunks, count(embedding_size) FILTER (embedding_size > 0 AND org_id <> 'org2') AS n_embedded, CASE WHEN org_id = 'org0' THEN 'unavailable' WHEN count(embedding_size) FILTER (embedding_size > 0 AND org_id <> 'org2') = 0 THEN 'no_embeddings' END AS error FROM chunks GROUP BY 1", CHUNKS)
def readiness(s, d):
    embedded = F.coalesce((F.col("embedding_size") > 0) & (F.col("org_id") != "org2"), F.lit(False))
    g = T.chunks(s, d).groupBy("org_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(embedded).alias("n_embedded"))
    return g.select("*", D.readiness_error(F.col("org_id") != "org0", F.col("n_chunks"), F.col("n_embedded")).alias("error"))


@query("SELECT chunk_id, org_id, source_type, section FROM chunks WHERE org_id = 'org1' AND chunk_id = 7", CHUNKS)
def chunk_lookup(s, d):
    """One chunk by id inside its tenant; both conditions reach the scan."""
    return T.chunks(s, d).where("org_id = 'org1' and chunk_id = 7").select("chunk_id", "org_id", "source_type", "section")
