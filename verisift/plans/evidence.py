"""Facets, ledger, coverage, contradictions, gate, bundles."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import TEMPLATES, Settings
from ..functions import scores as S
from ..functions import text as X
from ..operators import evidence as E
from ..operators import selection, strategy
from ..operators import strategy as decide_next
from ..operators.lexical import top_k
from ..operators.pipeline import in_scope, next_scopes, sufficiency, written
from ..sources import tables as T
from . import scope as P
from .base import CANDIDATES, Registry

query = Registry()
c = F.col
_OR = lambda xs: " OR ".join(f"contains(lower(text), '{x}')" for x in xs)
_HIT = lambda xs: " + ".join(f"contains(lower(text), '{x}')::INT" for x in xs)
_FACETS = "facets AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {t}::DOUBLE, {w}::DOUBLE, '{p}', {r}, {list(k)})" for n, t, w, p, r, k in T.FACETS) + ") f(facet, threshold, weight, policy, required, keywords))"
ALIGN = f"""{CANDIDATES}, {_FACETS}, scored AS (SELECT *, doc_id // 2 AS parent, {P.SECTION} AS sec, {P.GRADE} AS grade, least(1.0, ({_HIT(T.SAFETY_STEMS)}) * 0.18)::DOUBLE AS safety FROM cand),
 hit AS (SELECT s.*, f.*, len(list_filter(keywords, lambda k: contains(lower(text), k))) AS hits, CASE WHEN facet = 'safety_contraindications' AND safety > 0 THEN 0.25 ELSE 0 END AS extra,
 CASE WHEN policy = 'ANY' THEN 0.20 WHEN policy = source_type || '_ONLY' THEN 0.45 WHEN policy = 'CPG_ONLY' AND source_type IN ('LIT', 'SAFETY') THEN 0.15 WHEN policy = 'SAFETY_ONLY' AND source_type IN ('CPG', 'LIT') THEN 0.20 ELSE 0 END AS bonus FROM scored s, facets f),
 align AS (SELECT *, CASE WHEN hits = 0 AND extra = 0 AND bonus < 0.45 THEN 0 ELSE greatest(0, least(1, 0.20 + bonus + least(0.65, hits * 0.18) + 0.15 * sec + extra)) END::DOUBLE AS score,
 CASE WHEN {_OR(T.NEGATIVE)} THEN CASE WHEN facet = 'safety_contraindications' THEN 'SAFETY' ELSE 'CONTRADICTS' END WHEN {_OR(T.QUALIFY)} THEN 'QUALIFIES' ELSE 'SUPPORTS' END AS polarity FROM hit),
 ledger AS (SELECT * FROM align WHERE score > 0)"""
COVER = f"""{ALIGN}, contrib AS (SELECT query_id, facet, parent, max(score * greatest(0, least(1, rerank)) * grade * CASE WHEN polarity = 'CONTRADICTS' THEN 0.35 ELSE 1 END) AS c FROM ledger GROUP BY ALL),
 cover AS (SELECT query_id, facet, 1 - product(1 - c) AS coverage, count(*) AS n_docs FROM contrib GROUP BY ALL)"""
PAIRS = f"""{COVER}, marked AS (SELECT *, polarity = 'CONTRADICTS' OR (polarity = 'SAFETY' AND facet <> 'safety_contraindications') AS conflict FROM ledger),
 pairs AS (SELECT DISTINCT a.query_id, a.facet, a.chunk_id AS support, b.chunk_id AS conflicting, a.grade AS ga, b.grade AS gb, CASE WHEN greatest(a.grade, b.grade) >= 0.80 THEN 'high' ELSE 'moderate' END AS severity
 FROM marked a JOIN marked b ON a.query_id = b.query_id AND a.facet = b.facet AND NOT a.conflict AND b.conflict AND a.chunk_id <> b.chunk_id),
 judged AS (SELECT *, severity <> 'high' AND abs(ga - gb) >= 0.25 - 1e-9 AS resolved FROM pairs)"""


def passages(s, d):
    cand = T.candidates(s, d)
    return cand.withColumn("parent", F.floor(c("doc_id") / 2)).withColumn("grade", S.evidence_grade(c("source_type"), c("design")))


def align(s, d):
    return E.align(passages(s, d), T.facets(s), T.SAFETY_STEMS, T.NEGATIVE, T.QUALIFY)


def ledger(s, d):
    return align(s, d).where("score > 0")


def contrib(s, d):
    return E.contributions(ledger(s, d).select("query_id", "facet", c("parent").alias("doc_id"), "chunk_id", "score", "rerank", "grade", "polarity"))


def pairs(s, d):
    return E.adjudicate(E.contradictions(ledger(s, d)))


@query("SELECT query_id, chunk_id, facet, round(score, 6) AS score, polarity FROM align", ALIGN)
def facet_alignment(s, d):
    return align(s, d).select("query_id", "chunk_id", "facet", F.round("score", 6).alias("score"), "polarity")


@query("SELECT query_id, chunk_id, facet, round(score, 6) AS confidence, polarity, md5(substr(text, 1, 280)) AS claim_md5, source_type, section, effective_date::VARCHAR AS version FROM ledger", ALIGN)
def retrieval_ledger(s, d):
    return ledger(s, d).select("query_id", "chunk_id", "facet", F.round("score", 6).alias("confidence"), "polarity", F.md5(F.substring("text", 1, 280)).alias("claim_md5"), "source_type", "section", c("effective_date").cast("string").alias("version"))


@query("SELECT query_id, chunk_id, 'ungated' AS facet, substr(text, 1, 240) AS claim, round(dense, 6) AS confidence FROM cand", CANDIDATES)
def naive_ledger(s, d):
    return T.candidates(s, d).select("query_id", "chunk_id", F.lit("ungated").alias("facet"), F.substring("text", 1, 240).alias("claim"), F.round("dense", 6).alias("confidence"))


@query("SELECT query_id, facet, round(coverage, 6) AS coverage, n_docs FROM cover", COVER)
def facet_coverage(s, d):
    return E.coverage(contrib(s, d)).select("query_id", "facet", F.round("coverage", 6).alias("coverage"), "n_docs")


def _draws(most: int = 16, rounds: int = 64, seed: int = 42) -> str:
    """The resamples of 2 to ``most`` contributions, as the seeded generator draws them, for the SQL twins."""
    rows = []
    for n in range(2, most + 1):
        rng = random.Random(seed)
        rows.append(f"({n}, {[[rng.randrange(n) for _ in range(n)] for _ in range(rounds)]})")
    return f"draws AS (SELECT * FROM (VALUES {', '.join(rows)}) t(n, d))"


LCB = f"""{PAIRS}, {_draws()}, cs AS (SELECT query_id, facet, list(c ORDER BY c DESC, parent) AS v FROM contrib GROUP BY ALL),
 bounds AS (SELECT query_id, facet, CASE WHEN len(v) = 1 THEN greatest(0, least(1, v[1] - 0.08)) ELSE list_sort(list_transform(d, lambda r: 1 - list_product(list_transform(r, lambda i: 1 - v[i + 1]))))[4] END AS lcb FROM cs LEFT JOIN draws ON n = len(v))"""


@query("SELECT query_id, facet, round(lcb, 6) AS lcb FROM bounds", LCB)
def facet_lcb(s, d):
    return E.lcb(contrib(s, d)).select("query_id", "facet", F.round("lcb", 6).alias("lcb"))


@query("SELECT query_id, facet, support, conflicting, severity FROM pairs", PAIRS)
def contradiction_pairs(s, d):
    return pairs(s, d).select("query_id", "facet", "support", "conflicting", "severity")


@query("SELECT query_id, severity, resolved, count(*) AS n FROM judged GROUP BY ALL", PAIRS)
def adjudicate(s, d):
    return pairs(s, d).groupBy("query_id", "severity", "resolved").agg(F.count(F.lit(1)).alias("n"))


_CLAIMS = "claims AS (SELECT query_id, chunk_id, ['emr','guideline','quality'][(doc_id % 3) + 1] AS agent, facet, score * 0.9 AS conf FROM align WHERE doc_id % 2 = 0 UNION ALL SELECT query_id, -1 - chunk_id, 'emr', facet, 0.5 FROM align WHERE doc_id % 5 = 0)"


def claims(s, d):
    """Claims of agents; some name chunks that do not exist."""
    a = align(s, d)
    agent = F.element_at(F.array(*map(F.lit, ("emr", "guideline", "quality"))), (c("doc_id") % 3 + 1).cast("int"))
    known = a.where("doc_id % 2 = 0").select("query_id", "chunk_id", agent.alias("agent"), "facet", (c("score") * 0.9).alias("conf"))
    return known.unionByName(a.where("doc_id % 5 = 0").select("query_id", (-1 - c("chunk_id")).alias("chunk_id"), F.lit("emr").alias("agent"), "facet", F.lit(0.5).alias("conf")))


@query("SELECT query_id, chunk_id, agent, round(max(conf), 6) AS score FROM claims JOIN (SELECT DISTINCT query_id, chunk_id FROM cand) USING (query_id, chunk_id) GROUP BY ALL", f"{ALIGN}, {_CLAIMS}")
def merge_claims(s, d):
    """Claims on unknown chunks go; the greatest score an agent and chunk stays."""
    known = claims(s, d).join(T.candidates(s, d).select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    return known.groupBy("query_id", "chunk_id", "agent").agg(F.round(F.max("conf"), 6).alias("score"))


@query("SELECT query_id, chunk_id, agent, facet FROM claims WHERE chunk_id >= 0", f"{ALIGN}, {_CLAIMS}")
def parse_claims(s, d):
    """Claims through JSON, as agents send them; unknown chunks are dropped."""
    rows = claims(s, d).select("query_id", F.to_json(F.struct("chunk_id", "agent", "facet", "conf")).alias("j"))
    parsed = rows.select("query_id", F.from_json("j", "chunk_id long, agent string, facet string, conf double").alias("r")).select("query_id", "r.chunk_id", "r.agent", "r.facet")
    return parsed.join(T.candidates(s, d).select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")


@query("SELECT a.query_id, a.chunk_id, a.facet, round(greatest(a.score, coalesce(c.conf, 0)), 6) AS score FROM align a LEFT JOIN (SELECT query_id, chunk_id, facet, max(least(1, conf + 0.2)) AS conf FROM claims GROUP BY ALL) c ON a.query_id = c.query_id AND a.chunk_id = c.chunk_id AND a.facet = c.facet", f"{ALIGN}, {_CLAIMS}")
def claim_alignment(s, d):
    best = claims(s, d).groupBy("query_id", "chunk_id", "facet").agg(F.max(S.clamp(c("conf") + 0.2)).alias("conf"))
    r = align(s, d).join(best, ["query_id", "chunk_id", "facet"], "left")
    return r.select("query_id", "chunk_id", "facet", F.round(F.greatest("score", F.coalesce("conf", F.lit(0.0))), 6).alias("score"))


@query("SELECT query_id, facet, count(*) AS n FROM ledger WHERE chunk_id IN (SELECT chunk_id FROM cand WHERE dense >= 0.8) GROUP BY ALL", ALIGN)
def ledger_semi(s, d):
    keep = T.candidates(s, d).where("dense >= 0.8").select("chunk_id")
    return ledger(s, d).join(keep, "chunk_id", "left_semi").groupBy("query_id", "facet").agg(F.count(F.lit(1)).alias("n"))


_GATE = f"""{LCB}, fr AS (SELECT q.query_id, f.facet, f.required, f.threshold, coalesce(lcb, 0) AS lcb, CASE WHEN coalesce(coverage, 0) <= 0 OR coverage >= 1 THEN 0 ELSE -(coverage * log2(coverage) + (1 - coverage) * log2(1 - coverage)) END AS entropy
 FROM (SELECT DISTINCT query_id FROM cand) q CROSS JOIN facets f LEFT JOIN cover USING (query_id, facet) LEFT JOIN bounds USING (query_id, facet)),
 fa AS (SELECT query_id, list_sort(list(facet) FILTER (required AND (lcb < threshold OR entropy > 0.88))) AS missing, sum(CASE WHEN required THEN greatest(0, threshold - lcb) ELSE 0 END) AS deficit FROM fr GROUP BY 1),
 pa AS (SELECT query_id, count(*) FILTER (NOT resolved) AS unresolved, count(*) FILTER (NOT resolved AND severity = 'high') AS uh FROM judged GROUP BY 1),
 ba AS (SELECT query_id, count(*) AS n, sum(tokens)::BIGINT AS tokens, count(*) FILTER (weak) AS weak FROM cand WHERE dense >= 0.5 GROUP BY 1),
 g AS (SELECT fa.query_id, coalesce(missing, []) AS missing, coalesce(unresolved, 0) AS unresolved, coalesce(uh, 0) AS uh, coalesce(n, 0) AS n, coalesce(weak, 0) AS weak, CASE WHEN coalesce(n, 0) = 0 THEN 1.0 ELSE deficit / greatest(tokens, 1) END AS marginal FROM fa LEFT JOIN pa USING (query_id) LEFT JOIN ba USING (query_id))"""


def gate(s, d):
    """The ledger without texts is written once; coverage and contradictions both read it."""
    slim = written(ledger(s, d).select("query_id", "facet", "parent", "chunk_id", "score", "rerank", "grade", "polarity"), "gate-ledger")
    parts = E.contributions(slim.withColumnRenamed("parent", "doc_id"))
    cov = E.coverage(parts).join(E.lcb(parts), ["query_id", "facet"])
    every = T.candidates(s, d).select("query_id").distinct().join(F.broadcast(T.facets(s)))
    f = every.join(cov, ["query_id", "facet"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    f = f.withColumn("lcb", F.coalesce("lcb", F.lit(0.0))).withColumn("entropy", S.entropy(c("coverage")))
    bundle = T.candidates(s, d).where("dense >= 0.5").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.count_if(c("weak")).alias("weak"))
    return E.decide(f, E.adjudicate(E.contradictions(slim)), bundle)


@query("SELECT query_id, missing, unresolved, uh AS unresolved_high, CASE WHEN len(missing) = 0 AND uh = 0 AND unresolved <= 0 AND n > 0 AND weak = 0 THEN 'ACCEPT' WHEN len(missing) > 0 OR uh > 0 OR unresolved > 0 OR marginal > 2e-4 THEN 'RETRIEVE_MORE' ELSE 'INSUFFICIENT' END AS action FROM g", _GATE)
def gate_decision(s, d):
    return gate(s, d).select("query_id", "missing", "unresolved", "unresolved_high", "action")


@query("SELECT query_id, round(marginal, 9) AS marginal FROM g", _GATE)
def marginal_deficit(s, d):
    return gate(s, d).select("query_id", F.round("marginal", 9).alias("marginal"))


ROUTES = decide_next.ROUTES
_HINTS = f"""SELECT query_id, true AS increase_k, list_contains(missing, 'safety_contraindications') OR unresolved > 0 AS relax_filters, len(missing) > 0 AS expand_synonyms, missing, src[1] AS focus, len(src) = 1 AS exclusive,
 list_contains(missing, 'safety_contraindications') AS safety_search, unresolved > 0 AS contradiction_review, agents[1] AS routed_agent, agents FROM
 (SELECT *, list_filter([{', '.join(f"CASE WHEN list_contains(missing, '{f}') THEN '{a}' END" for f, a, _ in ROUTES)}, CASE WHEN unresolved > 0 THEN 'critic' END], lambda x: x IS NOT NULL) AS agents FROM
 (SELECT *, list_filter([CASE WHEN list_contains(missing, 'guideline_concordance') OR list_contains(missing, 'evidence_quality') THEN 'CPG' END, CASE WHEN list_contains(missing, 'patient_applicability') THEN 'EMR' END,
 CASE WHEN list_contains(missing, 'safety_contraindications') THEN 'SAFETY' END], lambda x: x IS NOT NULL) AS src FROM g))"""


@query(_HINTS, _GATE)
def gate_hints(s, d):
    return gate(s, d).select("query_id", decide_next.hints(c("missing"), c("unresolved")).alias("h")).select("query_id", "h.*")


_MORE = """act AS (SELECT *, CASE WHEN len(missing) = 0 AND uh = 0 AND unresolved <= 0 AND n > 0 AND weak = 0 THEN 'ACCEPT' WHEN len(missing) > 0 OR uh > 0 OR unresolved > 0 OR marginal > 2e-4 THEN 'RETRIEVE_MORE' ELSE 'INSUFFICIENT' END AS action FROM g),
 hint AS (SELECT h.* FROM (""" + _HINTS + """) h JOIN act USING (query_id) WHERE action = 'RETRIEVE_MORE'),
 sc AS (SELECT query_id, 16 AS k, CASE WHEN exclusive THEN focus END AS source, CASE WHEN exclusive THEN focus || '_ONLY' WHEN safety_search THEN 'ANY' END AS policy, CASE WHEN NOT exclusive THEN focus END AS preferred,
 CASE WHEN NOT relax_filters THEN 0.3::DOUBLE END AS min_grade, CASE WHEN NOT relax_filters THEN DATE '2016-01-01' END AS timeframe FROM hint)"""


def _scopes(s, d):
    return next_scopes(gate(s, d), Settings(k=8, k_more=16), 8, min_grade=0.3, since="2016-01-01")


@query("SELECT query_id, k, source, policy, preferred, min_grade, timeframe FROM sc", f"{_GATE}, {_MORE}")
def next_scope(s, d):
    """The scope of each query's next round, from the hints of its decision."""
    return _scopes(s, d).select("query_id", "k", "source", "policy", "preferred", "min_grade", "timeframe")


@query("""SELECT query_id, chunk_id, source_type, rank FROM (SELECT cand.*, k, row_number() OVER (PARTITION BY cand.query_id ORDER BY coalesce(source_type = preferred, false) DESC, dense DESC, chunk_id) AS rank FROM cand JOIN sc USING (query_id)
 WHERE (sc.source IS NULL OR source_type = sc.source) AND (min_grade IS NULL OR grade_score >= min_grade) AND (timeframe IS NULL OR effective_date >= timeframe)) WHERE rank <= k""", f"{_GATE}, {_MORE}")
def second_round(s, d):
    """The rows of each query's next round: its hints change its sources, filters and breadth."""
    return in_scope(T.candidates(s, d), written(_scopes(s, d), "scopes")).select("query_id", "chunk_id", "source_type", "rank")


@query("SELECT query_id, count(*) FILTER (source_type = 'CPG') / 3.0::DOUBLE AS kappa_cpg, count(*) FILTER (source_type = 'EMR') / 2.0::DOUBLE AS kappa_emr, round(avg(coalesce(nullif(rerank, 0), nullif(dense, 0))), 6) AS mean_confidence FROM cand WHERE dense >= 0.5 GROUP BY 1", CANDIDATES)
def gate_kappas(s, d):
    n = lambda x: F.count_if(c("source_type") == x)
    r = T.candidates(s, d).where("dense >= 0.5").groupBy("query_id").agg(n("CPG").alias("a"), n("EMR").alias("b"), F.round(F.avg(F.coalesce(S.truthy(c("rerank")), S.truthy(c("dense")))), 6).alias("mean_confidence"))
    return r.select("query_id", (c("a") / 3.0).alias("kappa_cpg"), (c("b") / 2.0).alias("kappa_emr"), "mean_confidence")


@query("SELECT query_id, count(*) AS n, sum(tokens)::BIGINT AS tokens, count(*) FILTER (source_type = 'CPG') AS cpg, count(*) FILTER (source_type = 'EMR') AS emr, count(*) FILTER (source_type = 'LIT') AS lit, count(*) FILTER (source_type = 'SAFETY') AS safety, round(count(*) FILTER (source_type = 'CPG') / count(*), 6) AS cpg_ratio FROM cand WHERE dense >= 0.6 GROUP BY 1", CANDIDATES)
def bundle_counts(s, d):
    n = F.count(F.lit(1))
    of = lambda x: F.count_if(c("source_type") == x)
    return T.candidates(s, d).where("dense >= 0.6").groupBy("query_id").agg(n.alias("n"), F.sum("tokens").alias("tokens"), *[of(x).alias(x.lower()) for x in ("CPG", "EMR", "LIT", "SAFETY")], F.round(of("CPG") / n, 6).alias("cpg_ratio"))


@query("SELECT query_id, rank, chunk_id, used FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS used FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, chunk_id) AS rank FROM cand)) WHERE used <= 1800 OR rank = 1", CANDIDATES)
def naive_pack(s, d):
    """A running token budget in dense order, cut before the first passage that overflows; one always stays."""
    by = Window.partitionBy("query_id").orderBy(c("dense").desc(), "chunk_id")
    r = T.candidates(s, d).withColumn("rank", F.row_number().over(by)).withColumn("used", F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return r.where("used <= 1800 or rank = 1").select("query_id", "rank", "chunk_id", "used")


@query("SELECT query_id, list(chunk_id ORDER BY dense DESC, chunk_id)[1:50] AS rejected FROM cand WHERE dense < 0.5 GROUP BY 1", CANDIDATES)
def rejected_ids(s, d):
    r = top_k(T.candidates(s, d).where("dense < 0.5"), 50, "dense", "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-c("dense")).alias("m"), "chunk_id"))).alias("x"))
    return r.select("query_id", F.slice(F.transform("x", lambda v: v["chunk_id"]), 1, 50).alias("rejected"))


@query("SELECT query_id, agent, count(*) AS n FROM (SELECT query_id, unnest(list_filter(['quality', 'critic', CASE WHEN source_type IN ('CPG', 'LIT') THEN 'guideline' END, CASE WHEN source_type = 'EMR' THEN 'emr' END, CASE WHEN source_type = 'SAFETY' OR sf >= 0.3 THEN 'safety' END], lambda x: x IS NOT NULL)) AS agent FROM (SELECT *, " + P.SAFETY + " AS sf FROM cand)) GROUP BY ALL", CANDIDATES)
def agent_routing(s, d):
    st = c("source_type")
    agents = F.array_compact(F.array(F.lit("quality"), F.lit("critic"), F.when(st.isin("CPG", "LIT"), "guideline"), F.when(st == "EMR", "emr"), F.when((st == "SAFETY") | (S.safety_score(c("text"), T.SAFETY_STEMS) >= 0.3), "safety")))
    return T.candidates(s, d).select("query_id", F.explode(agents).alias("agent")).groupBy("query_id", "agent").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT query_id, string_agg('[' || chunk_id || '] (' || source_type || ') ' || substr(text, 1, 1200), chr(10) ORDER BY rank) AS context FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, chunk_id) AS rank FROM cand) WHERE rank <= 12 GROUP BY 1", CANDIDATES)
def passage_context(s, d):
    r = top_k(T.candidates(s, d), 12, "dense", "chunk_id")
    line = F.concat(F.lit("["), c("chunk_id").cast("string"), F.lit("] ("), "source_type", F.lit(") "), F.substring("text", 1, 1200))
    return r.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))), lambda x: x["t"]), "\n").alias("context"))


@query("SELECT query_id, list_sort(list(chunk_id) FILTER (rank <= 5 AND doc_id % 2 = 0)) AS cited, list_sort(list(chunk_id) FILTER (rank > 5 AND doc_id % 7 = 0)) AS rejected FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, chunk_id) AS rank FROM cand) GROUP BY 1", CANDIDATES)
def citation_hardening(s, d):
    """Citations of an answer inside its bundle (first five), and those outside, which are refused."""
    r = T.candidates(s, d).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(c("dense").desc(), "chunk_id")))
    pick = lambda cond: F.array_sort(F.collect_list(F.when(cond, c("chunk_id"))))
    none = lambda x: F.when(F.size(x) > 0, x)
    return r.groupBy("query_id").agg(none(pick((c("rank") <= 5) & (c("doc_id") % 2 == 0))).alias("cited"), none(pick((c("rank") > 5) & (c("doc_id") % 7 == 0))).alias("rejected"))


@query(f"SELECT query_id, chunk_id, doc_id, source_type, strftime(effective_date, '%Y.%-m') AS version, round({P.GRADE}, 6) AS grade FROM cand WHERE dense >= 0.9", CANDIDATES)
def citations(s, d):
    version = F.concat(F.year("effective_date").cast("string"), F.lit("."), F.month("effective_date").cast("string"))
    return passages(s, d).where("dense >= 0.9").select("query_id", "chunk_id", "doc_id", "source_type", version.alias("version"), F.round("grade", 6).alias("grade"))


@query("""SELECT query_id, CASE WHEN contains(lower(t), 'decision support') THEN t ELSE 'For clinical decision support only. ' || t END AS answer FROM (
 SELECT query_id, 'Evidence is insufficient. Covered: ' || coalesce(string_agg(facet, ', ' ORDER BY facet) FILTER (NOT list_contains(missing, facet)), 'none') || '. Missing: ' || coalesce(nullif(array_to_string(any_value(missing), ', '), ''), 'none') || '.' AS t FROM g, facets GROUP BY query_id)""", _GATE)
def abstain_text(s, d):
    names = F.array(*[F.lit(n) for n in sorted(f[0] for f in T.FACETS)])
    or_none = lambda a: F.when(F.size(a) > 0, F.array_join(a, ", ")).otherwise("none")
    t = F.concat(F.lit("Evidence is insufficient. Covered: "), or_none(F.array_except(names, "missing")), F.lit(". Missing: "), or_none(c("missing")), F.lit("."))
    return gate(s, d).select("query_id", t.alias("t")).select("query_id", F.when(F.lower("t").contains("decision support"), c("t")).otherwise(F.concat(F.lit("For clinical decision support only. "), "t")).alias("answer"))


_QF = r"""own AS (SELECT item_id, regexp_extract_all(text, '\S+') AS w FROM benchmark), qf AS (SELECT item_id, 'safety_contraindications' AS facet, least(0.95, 0.5 + len(w) / 200.0)::DOUBLE AS threshold, 1.0::DOUBLE AS weight, 'ANY' AS policy, true AS required, [w[1]] AS keywords FROM own WHERE len(w) > 0
 UNION ALL SELECT item_id, 'dosing', 0.6, 1.1, 'CPG_ONLY', true, [w[-1]] FROM own WHERE len(w) > 10), df AS (SELECT item_id, f.* FROM benchmark, facets f)"""


@query("""SELECT item_id, facet, greatest(coalesce(f.threshold, 0), coalesce(qf.threshold, 0)) AS threshold, greatest(coalesce(f.weight, 0), coalesce(qf.weight, 0)) AS weight, coalesce(qf.policy, f.policy) AS policy, coalesce(f.required, false) OR coalesce(qf.required, false) AS required,
 list_concat(coalesce(f.keywords, []), list_filter(coalesce(qf.keywords, []), lambda k: NOT list_contains(coalesce(f.keywords, []), k))) AS keywords FROM df f FULL JOIN qf USING (item_id, facet)""", f"{_FACETS}, {_QF}")
def build_facets(s, d):
    """Default facets merged with those each question brings: the stricter threshold, the greater weight, both keywords, the question's policy.

    A question asks for safety by its first word, the stricter the longer it is; one of over ten words for dosing by its last.
    """
    q = T.table(s, d, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("w"))
    size = F.size("w")
    brings = F.array(
        F.when(size > 0, F.struct(F.lit("safety_contraindications").alias("facet"), F.least(F.lit(0.95), 0.5 + size / 200.0).alias("t"), F.lit(1.0).alias("v"), F.lit("ANY").alias("p"), F.array(F.get("w", F.lit(0))).alias("k"))),
        F.when(size > 10, F.struct(F.lit("dosing").alias("facet"), F.lit(0.6).alias("t"), F.lit(1.1).alias("v"), F.lit("CPG_ONLY").alias("p"), F.array(F.element_at("w", -1)).alias("k"))),
    )
    own = q.select("item_id", F.inline(F.array_compact(brings))).withColumn("r", F.lit(True))
    j = q.select("item_id").join(F.broadcast(T.facets(s))).join(own, ["item_id", "facet"], "full_outer")  # four default facets
    none = F.expr("cast(array() as array<string>)")
    return j.select("item_id", "facet", F.greatest("threshold", "t").alias("threshold"), F.greatest("weight", "v").alias("weight"), F.coalesce("p", "policy").alias("policy"), (F.coalesce("required", F.lit(False)) | F.coalesce("r", F.lit(False))).alias("required"), F.array_union(F.coalesce("keywords", none), F.coalesce("k", none)).alias("keywords"))


_TPL = "tpl AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', {n}, '{i}', '{name}', {w}::DOUBLE, {crit}, {th}::DOUBLE, '{p}', {list(k)})" for t, n, i, name, w, crit, th, p, k in TEMPLATES) + ") t(query_type, n, facet_id, name, weight, critical, threshold, policy, keywords))"


def question_types(s, d):
    kind = F.element_at(F.array(*map(F.lit, ("treatment", "diagnosis", "TEST", "prognosis", None))), (c("item_id") % 5 + 1).cast("int"))
    known = F.lower(kind).isin("treatment", "diagnosis", "test")
    return T.table(s, d, "benchmark").select("item_id", F.when(known, F.lower(kind)).otherwise("*").alias("query_type"))


def templates(s):
    return s.createDataFrame(TEMPLATES, "query_type string, n int, facet_id string, name string, weight double, critical boolean, threshold double, policy string, keywords array<string>")


@query("""SELECT tpl.*, coalesce(q.questions, 0) AS questions FROM tpl LEFT JOIN (SELECT CASE WHEN lower(t) IN ('treatment', 'diagnosis', 'test') THEN lower(t) ELSE '*' END AS query_type, count(*) AS questions
 FROM (SELECT (['treatment','diagnosis','TEST','prognosis',NULL])[item_id % 5 + 1] AS t FROM benchmark) GROUP BY 1) q USING (query_type)""", _TPL)
def facet_templates(s, d):
    """The templates, with the number of questions whose type takes them."""
    n = question_types(s, d).groupBy("query_type").agg(F.count(F.lit(1)).alias("questions"))
    return templates(s).join(n, "query_type", "left").withColumn("questions", F.coalesce("questions", F.lit(0)))


@query("""SELECT item_id, facet_id, name, weight, critical, threshold, policy, keywords FROM (SELECT item_id, (['treatment','diagnosis','TEST','prognosis',NULL])[item_id % 5 + 1] AS t FROM benchmark) q
 JOIN tpl ON query_type = CASE WHEN lower(t) IN ('treatment', 'diagnosis', 'test') THEN lower(t) ELSE '*' END""", _TPL)
def required_facets(s, d):
    """The facets of each case's question type; other types share a template."""
    return question_types(s, d).join(F.broadcast(templates(s)), "query_type").select("item_id", "facet_id", "name", "weight", "critical", "threshold", "policy", "keywords")


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'clinician_cds' ELSE 'research' END AS scope, coalesce(CASE WHEN item_id % 4 <> 1 THEN (item_id % 10) / 10.0 END, 0.7)::DOUBLE AS threshold, coalesce(CASE WHEN item_id % 2 = 0 THEN 1.25 END, 1.0)::DOUBLE AS weight, [CASE WHEN item_id % 2 = 0 THEN 'therapy' ELSE 'a' END] AS keywords FROM benchmark")
def coerce_spec(s, d):
    """Loosely typed JSON facets: unreadable numbers get defaults, a lone string becomes a list."""
    i = c("item_id")
    j = F.concat(F.lit('{"scope": "'), F.when(i % 3 == 0, "bogus").otherwise("research"), F.lit('", "threshold": "'), F.when(i % 4 == 1, "high").otherwise(((i % 10) / 10.0).cast("string")), F.lit('", "weight": '), F.when(i % 2 == 0, '"1.25"').otherwise("null"), F.lit(', "keywords": '), F.when(i % 2 == 0, '"therapy"').otherwise('["a"]'), F.lit("}"))
    g = lambda k: F.get_json_object("j", f"$.{k}")
    r = T.table(s, d, "benchmark").select("item_id", j.alias("j")).select("item_id", g("scope").alias("scope"), g("threshold").alias("t"), g("weight").alias("w"), g("keywords").alias("k"))
    words = F.when(c("k").startswith("["), F.from_json("k", "array<string>")).otherwise(F.array("k"))
    return r.select("item_id", F.when(c("scope").isin("clinician_cds", "research"), c("scope")).otherwise("clinician_cds").alias("scope"), F.expr("coalesce(try_cast(t as double), 0.7D)").alias("threshold"), F.expr("coalesce(try_cast(w as double), 1.0D)").alias("weight"), words.alias("keywords"))


_NAMES = ("", "Contraindications", "guideline", "Patient applicability", "safety", "Grade", "Dosing rules", "evidence_quality", "quality of life", "concord")


@query("""SELECT doc_id, CASE n WHEN '' THEN 'clinical_evidence' WHEN 'Contraindications' THEN 'safety_contraindications' WHEN 'guideline' THEN 'guideline_concordance' WHEN 'Patient applicability' THEN 'patient_applicability'
 WHEN 'safety' THEN 'safety_contraindications' WHEN 'Grade' THEN 'evidence_quality' WHEN 'Dosing rules' THEN 'dosing_rules' WHEN 'evidence_quality' THEN n WHEN 'quality of life' THEN 'evidence_quality' ELSE 'guideline_concordance' END AS facet
 FROM (SELECT doc_id, (['', 'Contraindications', 'guideline', 'Patient applicability', 'safety', 'Grade', 'Dosing rules', 'evidence_quality', 'quality of life', 'concord'])[doc_id % 10 + 1] AS n FROM documents)""")
def canonical_facet(s, d):
    """A name to its facet: exact, then by part, then by alias."""
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (c("doc_id") % 10 + 1).cast("int"))
    return T.table(s, d, "documents").select("doc_id", strategy.canonical_facet(name, tuple(f[0] for f in T.FACETS)).alias("facet"))


def pool(s, d):
    """The candidates of each query with all that selection looks at."""
    a = align(s, d).groupBy("query_id", "chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("facet", "score"))).alias("facets"))
    noise = S.noise_score(c("obsolete"), c("mismatch"), c("weak"), F.lit(False))
    p = passages(s, d).select(
        "query_id", "chunk_id", c("parent").alias("doc_id"), "source_type", F.array_distinct(X.tokens(c("text"))).alias("words"), "tokens", P.fused().alias("fusion"), S.safety_score(c("text"), T.SAFETY_STEMS).alias("safety"),
        c("grade").alias("ebm"), S.contradiction_score(c("text"), T.CONFLICT_STEMS).alias("contradiction"), noise.alias("noise"),
    )
    return p.join(a, ["query_id", "chunk_id"])


WEIGHTS = {f[0]: f[2] for f in T.FACETS}


@query()
def select_bundle(s, d):
    return selection.select_bundles(pool(s, d), WEIGHTS, ("CPG", "SAFETY"))


@query()
def pack_bundle(s, d):
    return selection.select_bundles(pool(s, d), WEIGHTS, ("CPG", "SAFETY"), packed=True, budget=1200)


@query()
def sufficiency_loop(s, d):
    """Retrieve, align, judge; queries that lack evidence look at more candidates, up to three times."""
    return sufficiency(passages(s, d), T.facets(s), Settings())
