"""Evaluation queries: qrels, rankings, audits, run comparison, contracts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources import tables as T
from .base import CANDIDATES, Registry

query = Registry()
c = F.col
_QRELS = "qrels AS (SELECT doc_id // 50 AS case_id, doc_id, greatest(0, 2 * quality - toxic) AS grade FROM labels)"
_RUN = f"{_QRELS}, run AS (SELECT doc_id // 50 AS case_id, doc_id, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY (doc_id * 53 % 97) DESC, doc_id) AS rank FROM documents)"
_MET = f"""{_RUN}, rel AS (SELECT * FROM qrels WHERE grade > 0), ideal AS (SELECT case_id, sum(CASE WHEN r <= 10 THEN (power(2, grade) - 1) / log2(r + 1) END) AS idcg, count(*) AS n_rel FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, doc_id) AS r FROM rel) GROUP BY 1),
 hit AS (SELECT case_id, sum((power(2, grade) - 1) / log2(rank + 1)) AS dcg, count(*) AS n_hit, max(1.0 / rank)::DOUBLE AS rr FROM run JOIN rel USING (case_id, doc_id) WHERE rank <= 10 GROUP BY 1),
 met AS (SELECT case_id, CASE WHEN n_rel IS NULL THEN 1.0 ELSE coalesce(dcg, 0) / idcg END AS ndcg, coalesce(n_hit, 0) / 10.0::DOUBLE AS precision, CASE WHEN n_rel IS NULL THEN 1.0 ELSE coalesce(n_hit, 0) / n_rel END AS recall, coalesce(rr, 0) AS rr
 FROM (SELECT DISTINCT case_id FROM run) LEFT JOIN ideal USING (case_id) LEFT JOIN hit USING (case_id))"""


def run(s, d, mul=53, mod=97):
    """A ranking of each case's documents."""
    r = T.table(s, d, "documents").select(F.floor(c("doc_id") / 50).cast("long").alias("case_id"), "doc_id", (c("doc_id") * mul % mod).alias("x"))
    return r.select("case_id", "doc_id", F.row_number().over(Window.partitionBy("case_id").orderBy(c("x").desc(), "doc_id")).alias("rank"))


def metrics(s, d, mul=53, mod=97):
    return M.ranking_metrics(run(s, d, mul, mod), T.qrels(s, d))


@query("SELECT case_id, round(ndcg, 6) AS ndcg FROM met", _MET)
def ndcg_at_10(s, d):
    return metrics(s, d).select("case_id", F.round("ndcg", 6).alias("ndcg"))


@query("SELECT case_id, precision, round(recall, 6) AS recall, round(rr, 6) AS rr FROM met", _MET)
def prr_at_10(s, d):
    return metrics(s, d).select("case_id", "precision", F.round("recall", 6).alias("recall"), F.round("rr", 6).alias("rr"))


@query("SELECT case_id, list_sort(list(DISTINCT doc_id)) AS docs, count(*) AS n, max(grade) AS best FROM qrels WHERE grade > 0 GROUP BY 1", _QRELS)
def qrels_grouped(s, d):
    r = T.qrels(s, d).where("grade > 0")
    g = r.groupBy("case_id").agg(F.sort_array(F.collect_set("doc_id")).alias("docs"), F.count(F.lit(1)).alias("n"), F.max("grade").alias("best"), F.map_from_entries(F.collect_list(F.struct("doc_id", "grade"))).alias("grades"))
    return g.select("case_id", "docs", "n", "best")


@query("SELECT DISTINCT doc_id FROM (SELECT unnest(docs) AS doc_id FROM (SELECT case_id, list(doc_id) AS docs FROM qrels WHERE grade > 0 GROUP BY 1))", _QRELS)
def gold_doc_ids(s, d):
    return qrels_grouped(s, d).select(F.explode("docs").alias("doc_id")).distinct()


@query("SELECT case_id, count(*) AS gold, count(*) FILTER (doc_id % 4 <> 1) AS indexed, round(count(*) FILTER (doc_id % 4 <> 1) / count(*), 6) AS coverage, count(*) FILTER (doc_id % 4 <> 1) / count(*) >= 0.95 AS ok FROM qrels WHERE grade > 0 GROUP BY 1", _QRELS)
def qrel_coverage(s, d):
    """Gold documents that are indexed; records of patients are not."""
    indexed = T.chunks(s, d).where("source_type <> 'EMR'").select("doc_id", F.lit(1).alias("in"))
    r = T.qrels(s, d).where("grade > 0").join(indexed, "doc_id", "left").groupBy("case_id").agg(F.count(F.lit(1)).alias("gold"), F.count("in").alias("indexed"))
    share = c("indexed") / c("gold")
    return r.select("case_id", "gold", "indexed", F.round(share, 6).alias("coverage"), (share >= 0.95).alias("ok"))


@query("SELECT case_id, doc_id FROM qrels WHERE grade > 0 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')", _QRELS)
def qrel_missing(s, d):
    return T.qrels(s, d).where("grade > 0").join(T.table(s, d, "documents").where("lang = 'en'"), "doc_id", "left_anti").select("case_id", "doc_id")


@query("SELECT case_id, doc_id, grade FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, doc_id) AS r FROM qrels WHERE grade > 0) WHERE r <= 8", _QRELS)
def select_gold_docs(s, d):
    w = Window.partitionBy("case_id").orderBy(c("grade").desc(), "doc_id")
    return T.qrels(s, d).where("grade > 0").withColumn("r", F.row_number().over(w)).where("r <= 8").select("case_id", "doc_id", "grade")


_TR = f"{CANDIDATES}, tr AS (SELECT query_id, list(chunk_id ORDER BY dense DESC, chunk_id) AS ids, list(source_type ORDER BY dense DESC, chunk_id) AS kinds FROM cand GROUP BY 1)"


def traces(s, d):
    """A trace a query: its candidates in dense order."""
    r = T.candidates(s, d).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-c("dense")).alias("m"), "chunk_id", "source_type"))).alias("x"))
    return r.select("query_id", F.transform("x", lambda v: v["chunk_id"]).alias("ids"), F.transform("x", lambda v: v["source_type"]).alias("kinds"))


@query("SELECT query_id, doc, min(pos) AS first FROM (SELECT query_id, unnest(ids) // 3 AS doc, unnest(kinds) AS kind, generate_subscripts(ids, 1) - 1 AS pos FROM tr) WHERE kind = 'LIT' GROUP BY ALL", _TR)
def ranked_docs(s, d):
    """Literature documents of a trace at their first position."""
    r = traces(s, d).select("query_id", F.posexplode(F.arrays_zip("ids", "kinds")).alias("pos", "e")).where("e.kinds = 'LIT'")
    return r.groupBy("query_id", F.floor(c("e.ids") / 3).cast("long").alias("doc")).agg(F.min("pos").cast("long").alias("first"))


@query("SELECT query_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS docs FROM (SELECT query_id, list_transform(ids, lambda x: x // 3) AS l FROM tr)", _TR)
def ordered_unique(s, d):
    return traces(s, d).select("query_id", F.array_distinct(F.transform("ids", lambda x: F.floor(x / 3).cast("long"))).alias("docs"))


@query("SELECT query_id, list_sort(list_distinct(list_transform(ids, lambda x: x // 3))) AS docs, list_sort(list_distinct(list_transform(ids[1:5], lambda x: x // 3))) AS cited, len(ids) AS n_chunks FROM tr", _TR)
def extract_ids(s, d):
    docs = lambda x: F.array_sort(F.array_distinct(F.transform(x, lambda v: F.floor(v / 3).cast("long"))))
    return traces(s, d).select("query_id", docs(c("ids")).alias("docs"), docs(F.slice("ids", 1, 5)).alias("cited"), F.size("ids").cast("long").alias("n_chunks"))


@query("SELECT query_id, len(ids) AS n_candidates, len(list_filter(kinds, lambda k: k = 'LIT')) AS n_literature, len(ids[1:40]) AS n_kept, (len(ids) > 0)::INT + list_contains(kinds, 'LIT')::INT + list_contains(kinds, 'CPG')::INT AS stages FROM tr", _TR)
def trace_summary(s, d):
    has = lambda k: F.array_contains("kinds", k).cast("int")
    return traces(s, d).select("query_id", F.size("ids").cast("long").alias("n_candidates"), F.size(F.filter("kinds", lambda k: k == "LIT")).cast("long").alias("n_literature"), F.size(F.slice("ids", 1, 40)).cast("long").alias("n_kept"), ((F.size("ids") > 0).cast("int") + has("LIT") + has("CPG")).alias("stages"))


_PARTS = ("len(ids) > 0", "len(ids) >= 20", "list_contains(kinds, 'LIT')", "list_contains(kinds, 'CPG')", "list_contains(kinds, 'EMR')", "list_contains(kinds[1:3], 'SAFETY')", "query_id % 4 <> 0")


@query(f"SELECT query_id, round(({' + '.join(f'({p})::INT' for p in _PARTS)}) / 7.0, 6)::DOUBLE AS completeness FROM tr", _TR)
def trace_completeness(s, d):
    has = lambda k: F.array_contains("kinds", k)
    parts = (F.size("ids") > 0, F.size("ids") >= 20, has("LIT"), has("CPG"), has("EMR"), F.array_contains(F.slice("kinds", 1, 3), "SAFETY"), c("query_id") % 4 != 0)
    return traces(s, d).select("query_id", F.round(sum(p.cast("int") for p in parts) / 7.0, 6).alias("completeness"))


_ERR = (("no_dense", "len(ids) = 0"), ("no_bm25", "query_id % 5 = 0"), ("no_rerank", "query_id % 7 = 0"), ("missing_agents", "NOT list_contains(kinds[1:4], 'CPG')"), ("over_budget", "len(ids) > 1 AND list_sum(ids) % 3 = 0"))


@query(f"SELECT query_id, list_sort(list_filter([{', '.join(f'CASE WHEN {q} THEN {chr(39)}{n}{chr(39)} END' for n, q in _ERR)}], lambda x: x IS NOT NULL)) AS errors FROM tr", _TR)
def contract_errors(s, d):
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    rules = (("no_dense", F.size("ids") == 0), ("no_bm25", c("query_id") % 5 == 0), ("no_rerank", c("query_id") % 7 == 0), ("missing_agents", ~F.array_contains(F.slice("kinds", 1, 4), "CPG")), ("over_budget", (F.size("ids") > 1) & (total % 3 == 0)))
    return traces(s, d).select("query_id", F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(q, F.lit(n)) for n, q in rules])))).alias("errors"))


_KEYS = ("org_id", "source_type", "embedding_space", "section", "design")


@query(f"SELECT a.chunk_id, list_filter([{', '.join(f'CASE WHEN a.{k} IS DISTINCT FROM b.{k} THEN {chr(39)}{k}{chr(39)} END' for k in _KEYS)}], lambda x: x IS NOT NULL) AS mismatched FROM cand a JOIN cand b ON b.chunk_id = a.chunk_id - a.chunk_id % 25", CANDIDATES)
def contract_mismatches(s, d):
    """Fields in which a chunk differs from its group's first, as a stored contract from the present one."""
    a = T.candidates(s, d).select("chunk_id", *_KEYS, (c("chunk_id") - c("chunk_id") % 25).alias("head"))
    b = a.where("chunk_id = head").select("head", *[c(k).alias(f"{k}0") for k in _KEYS])
    return a.join(b, "head").select("chunk_id", F.array_compact(F.array(*[F.when(~c(k).eqNullSafe(c(f"{k}0")), F.lit(k)) for k in _KEYS])).alias("mismatched"))


_CASE = f"""{CANDIDATES}, cs AS (SELECT query_id, count(*) AS n, count(*) FILTER (dense >= 0.5) AS sel, avg((dense >= 0.5)::INT) AS recall, avg((rerank >= 0.4)::INT) AS facet, avg((grade_score >= 0.3)::INT) AS critical, avg((reliability >= 0.25)::INT) AS ground,
 avg((doc_id % 3 <> 0)::INT) AS citation, avg(weak::INT) AS unsupported, count(*) FILTER (doc_id % 37 = 5) AS corpus, CASE WHEN query_id % 2 = 0 THEN count(*) FILTER (embedding_size > 0 AND doc_id % 41 = 3) END AS idx, count(*) FILTER (source_type = 'LIT' AND dense >= 0.9) AS lit, avg((NOT obsolete)::INT) AS trace, CASE WHEN query_id % 3 <> 2 THEN query_id % 3 = 0 END AS passed, query_id % 4 = 1 AS gap, query_id % 11 = 10 AS error FROM cand GROUP BY query_id),
 scored AS (SELECT *, greatest(0, least(1, 0.25 * critical + 0.15 * facet + 0.15 * ground + 0.15 * CASE WHEN passed IS NULL THEN 0.5 WHEN passed AND gap THEN 0 WHEN NOT passed AND NOT gap THEN 0.5 ELSE 1 END + 0.10 * trace + 0.10 * recall + 0.10 * citation - 0.20 * (1 - critical) - 0.10 * unsupported)) AS msas,
 CASE WHEN error THEN 'trace_or_runtime_failure' WHEN coalesce(corpus, 0) = 0 THEN 'qrel_doc_absent_from_corpus' WHEN idx = 0 THEN 'qrel_doc_absent_from_index' WHEN lit = 0 THEN 'no_literature_retrieved' WHEN recall <= 0.4 THEN 'literature_retrieved_but_no_qrel_overlap'
 WHEN critical <= 0.7 THEN 'selected_evidence_not_facet_supported' WHEN passed = false THEN 'policy_threshold_failure' END AS bucket FROM cs)"""


def audits(s, d):
    """An audit a query, with shares of its candidates in the place of measured terms."""
    share = lambda cond: F.avg(cond.cast("int"))
    q = c("query_id")
    r = T.candidates(s, d).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("dense") >= 0.5).alias("sel"), share(c("dense") >= 0.5).alias("recall"), share(c("rerank") >= 0.4).alias("facet"), share(c("grade_score") >= 0.3).alias("critical"),
        share(c("reliability") >= 0.25).alias("ground"), share(c("doc_id") % 3 != 0).alias("citation"), share(c("weak")).alias("unsupported"), share(~c("obsolete")).alias("trace"),
        F.count_if(c("doc_id") % 37 == 5).alias("corpus"), F.count_if((c("embedding_size") > 0) & (c("doc_id") % 41 == 3)).alias("_idx"), F.count_if((c("source_type") == "LIT") & (c("dense") >= 0.9)).alias("lit"),
    ).select("*", F.when(q % 3 != 2, q % 3 == 0).alias("passed"), (q % 4 == 1).alias("gap"), (q % 11 == 10).alias("error"), F.when(q % 2 == 0, c("_idx")).alias("idx"))
    r = r.withColumn("msas", M.msas(c("critical"), c("facet"), c("ground"), M.sufficiency_term(c("passed"), c("gap")), c("trace"), c("recall"), c("citation"), c("unsupported")))
    return r.withColumn("bucket", M.bucket(c("error"), c("corpus"), c("idx"), c("lit"), c("recall") - 0.4, c("critical") - 0.7, c("passed")))


@query("SELECT query_id, round(msas, 6) AS msas FROM scored", _CASE)
def msas(s, d):
    return audits(s, d).select("query_id", F.round("msas", 6).alias("msas"))


@query("SELECT bucket, count(*) AS n FROM scored GROUP BY 1", _CASE)
def failure_buckets(s, d):
    return audits(s, d).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, round(avg(msas), 6) AS mean_msas, round(avg(recall), 6) AS mean_recall, round(avg(passed::INT), 6) AS pass_rate, round(avg(error::INT), 6) AS error_rate, round(avg(ground), 6) AS mean_ground FROM scored", _CASE)
def run_aggregate(s, d):
    a = audits(s, d)
    r = lambda x: F.round(F.avg(x), 6)
    return a.agg(F.count(F.lit(1)).alias("n"), r("msas").alias("mean_msas"), r("recall").alias("mean_recall"), r(c("passed").cast("int")).alias("pass_rate"), r(c("error").cast("int")).alias("error_rate"), r("ground").alias("mean_ground"))


@query("""SELECT query_id, round(CASE WHEN query_id % 9 = 8 THEN 0 WHEN n > 0 THEN ok / n WHEN cites > 0 THEN 0.65 ELSE 0.25 END, 6)::DOUBLE AS groundedness, n AS n_claims FROM (SELECT query_id,
 count(*) FILTER (query_id % 5 < 3) AS n, count(*) FILTER (query_id % 5 < 3 AND doc_id % 3 <> 0 AND grade_score >= 0.3) AS ok, count(*) FILTER (query_id % 5 = 3 AND dense > 0.5) AS cites FROM cand GROUP BY 1)""", CANDIDATES)
def groundedness(s, d):
    """Claims are nested a query; some queries have citations only, some neither, some no answer."""
    has = c("query_id") % 5 < 3
    claim = F.when(has, F.struct((c("doc_id") % 3 != 0).alias("cited"), (c("grade_score") >= 0.3).alias("supports")))
    nested = T.candidates(s, d).groupBy("query_id").agg(F.collect_list(claim).alias("claims"), F.count_if((c("query_id") % 5 == 3) & (c("dense") > 0.5)).alias("cites"))
    supported = F.size(F.filter("claims", lambda x: x["cited"] & x["supports"]))
    g = M.groundedness(c("query_id") % 9 != 8, F.size("claims"), supported, c("cites"))
    return nested.select("query_id", F.round(g, 6).alias("groundedness"), F.size("claims").cast("long").alias("n_claims"))


@query("SELECT case_id, round(sum(CASE WHEN hit THEN w ELSE 0 END) / sum(w), 6) AS recall, round(sum(CASE WHEN hit AND crit THEN w ELSE 0 END) / nullif(sum(CASE WHEN crit THEN w ELSE 0 END), 0), 6) AS critical_recall FROM (SELECT case_id, doc_id % 4 AS facet, (1.0 + doc_id % 4)::DOUBLE AS w, doc_id % 4 < 2 AS crit, bool_or(rank <= 15) AS hit FROM run JOIN qrels USING (case_id, doc_id) WHERE grade > 0 GROUP BY ALL) GROUP BY 1", _RUN)
def facet_recall(s, d):
    """A facet is found if any of its gold documents is ranked in the first fifteen."""
    f = c("doc_id") % 4
    r = run(s, d).join(T.qrels(s, d).where("grade > 0"), ["case_id", "doc_id"]).groupBy("case_id", f.alias("facet")).agg(F.bool_or(c("rank") <= 15).alias("hit"))
    w, crit = 1.0 + c("facet"), c("facet") < 2
    total = lambda cond: F.sum(F.when(cond, w).otherwise(0.0))
    crit_all = total(crit)
    return r.groupBy("case_id").agg(F.round(total(c("hit")) / F.sum(w), 6).alias("recall"), F.round(F.when(crit_all != 0, total(c("hit") & crit) / F.nullif(crit_all, F.lit(0.0))), 6).alias("critical_recall"))


@query("""SELECT query_id, round(sum(CASE WHEN ok THEN w ELSE 0 END) / sum(w), 6) AS recall, round(coalesce(sum(CASE WHEN ok AND crit THEN w ELSE 0 END) / nullif(sum(CASE WHEN crit THEN w ELSE 0 END), 0), 1), 6) AS critical_recall FROM (
 SELECT query_id, w, crit, CASE WHEN len(g) = 0 THEN true ELSE list_has_any(g, found) END AS ok FROM (SELECT query_id, w, crit, found, CASE WHEN len(own) > 0 AND (len(gold) = 0 OR NOT list_has_any(gold, own)) THEN own ELSE gold END AS g FROM (
 SELECT query_id, f AS facet, (1.0 + f)::DOUBLE AS w, f < query_id % 3 AS crit, list_filter(ids, lambda x: x % 7 = f) AS gold, list_filter(ids, lambda x: x % 5 = query_id % 5 AND query_id % 4 > 0) AS own, ids[1:6] AS found FROM (SELECT query_id, ids, unnest([0, 1, 2, 3]) AS f FROM tr)))) GROUP BY 1""", _TR)
def facet_recall_stale(s, d):
    """Facets whose own gold documents are not the case's fall back to those of the case."""
    q = c("query_id")
    facet = lambda f: F.struct(F.lit(1.0 + f).alias("weight"), (F.lit(f) < q % 3).alias("critical"), F.filter("ids", lambda x: x % 7 == f).alias("gold"))
    facets = F.array(*[facet(f) for f in range(4)])
    own = F.filter("ids", lambda x: (x % 5 == q % 5) & (q % 4 > 0))
    rows = traces(s, d).select("query_id", facets.alias("facets"), own.alias("own"), F.slice("ids", 1, 6).alias("found"))
    return rows.select("query_id", F.round(M.facet_recall(c("facets"), c("found"), c("own")), 6).alias("recall"), F.round(M.facet_recall(c("facets"), c("found"), c("own"), True), 6).alias("critical_recall"))


_MET2 = _MET.replace("qrels AS", "qrels AS", 1) + ", " + _MET.split("qrels AS", 1)[1].split("), ", 1)[1].replace("53 % 97", "37 % 101").replace("run ", "run2 ").replace("rel ", "rel2 ").replace("ideal ", "ideal2 ").replace("hit ", "hit2 ").replace("met AS", "met2 AS").replace("FROM run)", "FROM run2)").replace("FROM rel)", "FROM rel2)")


@query("SELECT a.case_id, round(a.ndcg - b.ndcg, 6) AS d_ndcg, round(a.precision - b.precision, 6) AS d_precision, round(a.recall - b.recall, 6) AS d_recall FROM met a JOIN met2 b USING (case_id)", _MET2)
def compare_runs(s, d):
    b = metrics(s, d, 37, 101).select("case_id", *[c(x).alias(f"{x}0") for x in ("ndcg", "precision", "recall")])
    return metrics(s, d).join(b, "case_id").select("case_id", *[F.round(c(x) - c(f"{x}0"), 6).alias(f"d_{x}") for x in ("ndcg", "precision", "recall")])


@query("SELECT round(avg(a.ndcg), 6) AS full_ndcg, round(avg(b.ndcg), 6) AS naive_ndcg, round(avg(a.ndcg) - avg(b.ndcg), 6) AS d_ndcg, round(avg(a.rr) - avg(b.rr), 6) AS d_rr FROM met a JOIN met2 b USING (case_id)", _MET2)
def matrix_deltas(s, d):
    """Mean metrics of the two pipelines side by side."""
    both = metrics(s, d).withColumn("p", F.lit("full")).unionByName(metrics(s, d, 37, 101).withColumn("p", F.lit("naive")))
    m = both.groupBy().pivot("p", ["full", "naive"]).agg(F.avg("ndcg").alias("ndcg"), F.avg("rr").alias("rr"))
    return m.select(F.round("full_ndcg", 6).alias("full_ndcg"), F.round("naive_ndcg", 6).alias("naive_ndcg"), F.round(c("full_ndcg") - c("naive_ndcg"), 6).alias("d_ndcg"), F.round(c("full_rr") - c("naive_rr"), 6).alias("d_rr"))


@query("""a AS (SELECT query_id, list(chunk_id ORDER BY dense DESC, chunk_id)[1:8] AS x, list(chunk_id ORDER BY rerank DESC, chunk_id)[1:8] AS y FROM cand GROUP BY 1)
 SELECT query_id, list_sort(list_intersect(x, y)) AS overlap, list_sort(list_filter(x, lambda v: NOT list_contains(y, v))) AS naive_only, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM a""", CANDIDATES)
def set_overlap(s, d):
    first = lambda k: F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-c(k)).alias("m"), "chunk_id"))), lambda v: v["chunk_id"]), 1, 8)
    a = T.candidates(s, d).groupBy("query_id").agg(first("dense").alias("x"), first("rerank").alias("y"))
    both = F.array_intersect("x", "y")
    return a.select("query_id", F.array_sort(both).alias("overlap"), F.array_sort(F.array_except("x", "y")).alias("naive_only"), F.round(F.size(both) / F.size(F.array_union("x", "y")), 6).alias("jaccard"))


@query("SELECT user_id, ts, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rank FROM (SELECT user_id, date_trunc('day', ts) AS ts, count(*) AS n FROM events GROUP BY ALL)) WHERE rank <= 3")
def runs_recent(s, d):
    """Each user's last three daily runs, newest first."""
    r = T.table(s, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(c("ts").desc()))).where("rank <= 3")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM qrels WHERE grade > 0) AS judged FROM documents WHERE doc_id IN (SELECT doc_id FROM qrels WHERE grade > 0) OR doc_id IN (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM qrels WHERE grade > 0) ORDER BY md5(doc_id::VARCHAR || '-1337'), doc_id LIMIT 100)", _QRELS)
def sample_priority_then_hash(s, d):
    """Judged documents first, then a seeded sample of the others: a sampling operator."""
    gold = T.qrels(s, d).where("grade > 0").select("doc_id").distinct()
    docs = T.table(s, d, "documents").select("doc_id")
    rest = docs.join(gold, "doc_id", "left_anti").orderBy(F.md5(F.concat(c("doc_id").cast("string"), F.lit("-1337"))), "doc_id").limit(100)
    return docs.join(gold, "doc_id", "left_semi").withColumn("judged", F.lit(True)).unionByName(rest.withColumn("judged", F.lit(False)))
