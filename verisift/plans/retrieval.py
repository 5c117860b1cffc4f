"""Lexical, dense and hybrid retrieval queries."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as X
from ..operators import dense as D
from ..functions import porter
from ..operators import generations as G
from ..operators import ivf as I
from ..operators import lexical as L
from ..operators import postings as P
from ..operators import proximity as H
from ..operators import rerank as R
from ..operators import strategy as decide
from ..operators.pipeline import written
from ..sources import tables as T
from .base import CANDIDATES, CHUNKS, Registry

query = Registry()
c = F.col
_WS = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')"
_FTS = "regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_.+/-]*')"


def _bm25_sql(terms: str, query_terms: str, k1: str, idf: str, weight: str) -> str:
    return f"""d AS (SELECT doc_id, {terms} AS l FROM documents), p AS (SELECT doc_id, len(l) AS dl, unnest(l) AS term FROM d), tf AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM p GROUP BY ALL),
 size AS (SELECT count(*) AS n, avg(len(l)) AS avgdl FROM d), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS x FROM df, size),
 idf AS (SELECT term, {idf} AS idf FROM raw), q AS (SELECT item_id AS query_id, term, {weight} AS weight FROM (SELECT item_id, unnest({query_terms}) AS term FROM benchmark) GROUP BY ALL),
 s AS (SELECT query_id, doc_id, sum(weight * idf * tf * ({k1} + 1) / (tf + {k1} * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM q JOIN idf USING (term) JOIN tf USING (term), size GROUP BY ALL)"""


_TOP = "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10"


def _fts_terms(text):
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9_.+/-]*"), F.lit(0))


def _postings(s, d, kind, terms, k1, stem=None):
    """The index at rest over ``documents``, built where there is none for these files."""
    docs = T.table(s, d, "documents")
    contract = G.files_contract(docs, "postings", kind, k1)
    return P.open_index(s, G.built(s, G.index_root(s), f"postings-{kind}", contract, lambda folder: P.fill(docs, terms, folder, k1=k1, stem=stem)))


def _queries(s, d, terms):
    return T.table(s, d, "benchmark").select(c("item_id").alias("query_id"), F.explode(terms).alias("term"))


@query("WITH " + _bm25_sql(_FTS, f"list_distinct({_FTS})", "1.2", "greatest(x, 1e-6)", "1") + _TOP.replace("SELECT", " SELECT", 1))
def bm25_topk(s, d):
    """From posting blocks at rest: only the blocks of the queries' terms are read, and of them what their bounds ask for."""
    q = _queries(s, d, X.fts_terms(c("text"))).withColumn("weight", F.lit(1))
    return L.rounded(P.search(_postings(s, d, "fts", _fts_terms(c("text")), 1.2), q, 10))


@query("WITH " + _bm25_sql(_WS, _WS, "1.5", "CASE WHEN x < 0 THEN 0.25 * (SELECT avg(x) FROM raw) ELSE x END", "count(*)") + _TOP.replace("SELECT", " SELECT", 1).replace("FROM s)", "FROM s WHERE score > 0)"))
def bm25_okapi(s, d):
    q = _queries(s, d, X.tokens(c("text"))).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("weight"))
    index = _postings(s, d, "words", X.tokens(c("text")), 1.5)
    return L.rounded(P.search(index, q, 10, floor=0.25 * P.mean_idf(index)))


@query()
def bm25_stemmed(s, d):
    """The full-text index as the sources build it: Porter stems on both sides."""
    stems = lambda t: F.array_distinct(porter.stems(t))
    q = _queries(s, d, stems(X.fts_terms(c("text")))).withColumn("weight", F.lit(1))
    return L.rounded(P.search(_postings(s, d, "stems", _fts_terms(c("text")), 1.2, porter.stem), q, 10))


@query(f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_WS}) AS term FROM documents) GROUP BY ALL")
def inverted_index(s, d):
    return L.postings(T.table(s, d, "documents"), X.tokens(c("text"))).select("term", "doc_id", "tf")


@query(f"""WITH q AS (SELECT item_id AS query_id, list_distinct({_WS}) AS q FROM benchmark), t AS (SELECT doc_id, unnest(list_distinct({_WS})) AS term FROM documents),
 h AS (SELECT query_id, doc_id, count(*) AS n FROM (SELECT query_id, unnest(q) AS term FROM q) JOIN t USING (term) GROUP BY ALL), s AS (SELECT query_id, doc_id, n / len(q)::DOUBLE AS score FROM h JOIN q USING (query_id)) {_TOP}""")
def lexical_overlap(s, d):
    """Share of a query's distinct terms in a document, by an equi-join on terms."""
    q = T.table(s, d, "benchmark").select(c("item_id").alias("query_id"), F.array_distinct(X.tokens(c("text"))).alias("q"))
    terms = q.select("query_id", F.size("q").alias("n_q"), F.explode("q").alias("term"))
    t = T.table(s, d, "documents").select("doc_id", F.explode(F.array_distinct(X.tokens(c("text")))).alias("term"))
    r = t.join(terms, "term").groupBy("query_id", "doc_id").agg((F.count(F.lit(1)) / F.greatest(F.first("n_q"), F.lit(1))).alias("score"))
    return L.top_k(r.withColumn("score", F.round("score", 9)), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_COS = "round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), {})"


def _vectors(s, d):
    return T.table(s, d, "embeddings")


def _asked(s, d):
    """Every vector whose id is divisible by 20 is a query."""
    return _vectors(s, d).where("vec_id % 20 = 0").select(c("vec_id").alias("query_id"), "embedding")


_DENSE = f"s AS (SELECT q.vec_id AS query_id, v.vec_id, {_COS.format(9)} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)"
_DTOP = "SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"


@query(f"WITH {_DENSE} {_DTOP}")
def dense_topk(s, d):
    return D.exact_topk(_vectors(s, d), _asked(s, d), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_DENSE.replace('% 20 = 0)', '% 20 = 0 AND v.label % 3 = 1)')} {_DTOP}")
def dense_topk_filtered(s, d):
    """The filter comes before the top-k, so no neighbour in scope is lost."""
    return D.exact_topk(_vectors(s, d).where("label % 3 = 1"), _asked(s, d), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_DENSE} SELECT query_id, vec_id, round(greatest(0, 1 - score), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5")
def search_distance(s, d):
    return D.exact_topk(_vectors(s, d), _asked(s, d), 5).select("query_id", "vec_id", F.round(F.greatest(F.lit(0.0), 1 - c("score")), 6).alias("distance"))


@query(f"SELECT v.vec_id, {_COS.format(6)} AS score FROM embeddings v JOIN embeddings q ON q.vec_id = v.vec_id - v.vec_id % 20")
def cosine_scores(s, d):
    """Each vector against the head of its block of twenty."""
    v = _vectors(s, d).withColumn("head", c("vec_id") - c("vec_id") % 20)
    q = _asked(s, d).select(c("query_id").alias("head"), c("embedding").alias("q"))
    return v.join(q, "head").select("vec_id", F.round(S.cosine(c("q"), c("embedding")), 6).alias("score"))


@query("SELECT label, count(*) AS n, count(*) FILTER (vec_id % 10 = 0) AS mismatched, count(*) FILTER (vec_id % 10 <> 0) AS usable FROM embeddings GROUP BY 1")
def dense_dim_mismatch(s, d):
    cut = F.when(c("vec_id") % 10 == 0, F.slice("embedding", 1, 32)).otherwise(c("embedding"))
    v = _vectors(s, d).select("label", F.size(cut).alias("dim"))
    return v.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("dim") != 64).alias("mismatched"), F.count_if(c("dim") == 64).alias("usable"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 11 <> 0 AND vec_id % 7 <> 3")
def valid_embeddings(s, d):
    e = F.when(c("vec_id") % 11 == 0, F.slice("embedding", 1, 10)).when(c("vec_id") % 7 == 3, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(c("embedding"))
    return D.valid(_vectors(s, d).select("vec_id", e.alias("embedding")), 64).select("vec_id")


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * 3 * x * 3)) / list_sum(list_transform(embedding::DOUBLE[], lambda x: 9 * x * x)), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS first FROM embeddings")
def l2_normalize(s, d):
    n = S.l2_normalize(F.transform("embedding", lambda x: x * F.lit(3.0)))
    r = _vectors(s, d).select("vec_id", n.alias("n"))
    return r.select("vec_id", F.round(F.aggregate("n", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"), F.round(c("n")[0], 6).alias("first"))


_CODE = "list_transform(embedding::DOUBLE[], lambda x: round(x * 127))"


@query(f"""WITH {_DENSE}, code AS (SELECT vec_id, {_CODE} AS e FROM embeddings),
 z AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.e, q.e), 9) AS score FROM code v, code q WHERE q.vec_id % 20 = 0),
 a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM z) WHERE r <= 10),
 u AS (SELECT query_id, vec_id, max(score) AS score FROM (SELECT query_id, vec_id, score FROM a UNION ALL SELECT query_id, vec_id, score FROM b) GROUP BY ALL)
 {_DTOP.replace("FROM s", "FROM u")}""")
def ann_union_max(s, d):
    """Two indexes over all vectors, exact and in 8-bit codes, joined by the greatest similarity."""
    v, q = _vectors(s, d), _asked(s, d)
    code = lambda r: r.withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double") * 127)))
    a = D.exact_topk(v, q, 10).select("query_id", "vec_id", "score")
    b = D.exact_topk(code(v), code(q), 10).select("query_id", "vec_id", "score")
    u = a.unionByName(b).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return L.top_k(u, 10, item="vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def _ivf(s, d):
    """The inverted lists at rest over ``embeddings``, built where there are none for these files."""
    v = D.valid(_vectors(s, d), 64)
    contract = G.files_contract(_vectors(s, d), "ivf")
    return I.open_index(s, G.built(s, G.index_root(s), "ivf", contract, lambda folder: I.fill(v, folder)))


@query()
def ivf_assign(s, d):
    return _ivf(s, d).table.select("vec_id", "list_id")


@query()
def ann_ivf_topk(s, d):
    return I.search(_ivf(s, d), _asked(s, d), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query()
def ann_graph_topk(s, d):
    """Layered proximity graphs at rest, searched by beams."""
    v = D.valid(_vectors(s, d), 64)
    made = G.built(s, G.index_root(s), "graph", G.files_contract(_vectors(s, d), "graph"), lambda folder: H.fill(v, folder))
    return H.search(s, made, _asked(s, d), 10)


@query()
def hash_embed(s, d):
    return D.hash_embed(T.table(s, d, "documents").select("doc_id", "text")).select("doc_id", F.size("embedding").alias("dim"), F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("embedding"))


@query("SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS label, 'c' || vec_id AS chunk_id FROM embeddings")
def label_mapping(s, d):
    """Contiguous labels in id order, numbered without a global window."""
    v = _vectors(s, d).select("vec_id").repartitionByRange("vec_id").sortWithinPartitions("vec_id").withColumn("_m", F.monotonically_increasing_id())
    # Written once: both uses must see the same bounds of the ranges.
    v = written(v.select("vec_id", F.shiftright("_m", 33).alias("_p"), c("_m").bitwiseAND((1 << 33) - 1).alias("_i")), "labels")
    sizes = v.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    before = sizes.select("_p", (F.sum("n").over(Window.orderBy("_p")) - c("n")).alias("n0"))
    return v.join(F.broadcast(before), "_p").select("vec_id", (c("n0") + c("_i")).alias("label"), F.concat(F.lit("c"), c("vec_id").cast("string")).alias("chunk_id"))


@query("SELECT label, count(*) AS n, round(min(list_cosine_similarity(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS least, bool_and(list_cosine_similarity(embedding::DOUBLE[], embedding::DOUBLE[]) >= 0.9999) AS aligned FROM embeddings GROUP BY 1")
def vector_alignment(s, d):
    """Stored vectors against the index's copy."""
    a, b = _vectors(s, d), _vectors(s, d).select("vec_id", c("embedding").alias("indexed"))
    r = a.join(b, "vec_id").select("label", S.cosine(c("embedding"), c("indexed")).alias("x"))
    return r.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("x"), 6).alias("least"), F.bool_and(c("x") >= 0.9999).alias("aligned"))


# Hybrid retrieval over the candidates' first-stage scores: a list of ten by either score.
_LISTS = """dl AS (SELECT query_id, chunk_id, dense, source_type FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, chunk_id) AS r FROM cand) WHERE r <= 10),
 ll AS (SELECT query_id, chunk_id, lexical, source_type FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, chunk_id) AS r FROM cand WHERE lexical > 0) WHERE r <= 10),
 u AS (SELECT coalesce(dl.query_id, ll.query_id) AS query_id, coalesce(dl.chunk_id, ll.chunk_id) AS chunk_id, dense, lexical, coalesce(dl.source_type, ll.source_type) AS source_type,
 list_filter([CASE WHEN dense IS NOT NULL THEN 'dense' END, CASE WHEN lexical IS NOT NULL THEN 'lexical' END], lambda x: x IS NOT NULL) AS retrieved_by
 FROM dl FULL JOIN ll ON dl.query_id = ll.query_id AND dl.chunk_id = ll.chunk_id)"""
_H = f"{CANDIDATES}, {_LISTS}"


def _union(s, d):
    cand = T.candidates(s, d).select("query_id", "chunk_id", "dense", "lexical", "source_type")
    a = L.top_k(cand, 10, "dense", "chunk_id").select("query_id", "chunk_id", "dense", c("source_type").alias("sa"))
    b = L.top_k(cand.where("lexical > 0"), 10, "lexical", "chunk_id").select("query_id", "chunk_id", "lexical", c("source_type").alias("sb"))
    by = F.array_compact(F.array(F.when(c("dense").isNotNull(), "dense"), F.when(c("lexical").isNotNull(), "lexical")))
    return a.join(b, ["query_id", "chunk_id"], "full_outer").select("query_id", "chunk_id", "dense", "lexical", F.coalesce("sa", "sb").alias("source_type"), by.alias("retrieved_by"))


@query("SELECT query_id, chunk_id, round(dense, 6) AS dense, round(lexical, 6) AS lexical, source_type, retrieved_by FROM u", _H)
def hybrid_union(s, d):
    return _union(s, d).select("query_id", "chunk_id", F.round("dense", 6).alias("dense"), F.round("lexical", 6).alias("lexical"), "source_type", "retrieved_by")


_MM = "CASE WHEN {0} IS NULL THEN NULL WHEN max({0}) OVER w > min({0}) OVER w THEN ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) ELSE {0} END"


def _minmax(df):
    w = Window.partitionBy("query_id")

    def scale(x):
        lo, hi = F.min(x).over(w), F.max(x).over(w)
        return F.when(hi > lo, (c(x) - lo) / (hi - lo)).otherwise(c(x))

    return df.select("query_id", "chunk_id", scale("dense").alias("dense"), scale("lexical").alias("lexical"), "source_type")


@query(f"SELECT query_id, chunk_id, round({_MM.format('dense')}, 6) AS dense, round({_MM.format('lexical')}, 6) AS lexical FROM u WINDOW w AS (PARTITION BY query_id)", _H)
def minmax_normalize(s, d):
    return _minmax(_union(s, d)).select("query_id", "chunk_id", F.round("dense", 6).alias("dense"), F.round("lexical", 6).alias("lexical"))


@query(f"""m AS (SELECT query_id, chunk_id, {_MM.format('dense')} AS dense, {_MM.format('lexical')} AS lexical FROM u WINDOW w AS (PARTITION BY query_id))
 SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(dense, 0), 9) DESC, round(coalesce(lexical, 0), 9) DESC, chunk_id) AS rank FROM m) WHERE rank <= 12""", _H)
def hybrid_pool(s, d):
    z = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 9).desc()
    w = Window.partitionBy("query_id").orderBy(z("dense"), z("lexical"), "chunk_id")
    return _minmax(_union(s, d)).withColumn("rank", F.row_number().over(w)).where("rank <= 12").select("query_id", "chunk_id", "rank")


@query("SELECT query_id, source_type, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_type ORDER BY dense DESC, chunk_id) AS rank FROM cand WHERE source_type <> 'CPG') WHERE rank <= 3", CANDIDATES)
def source_balanced_topk(s, d):
    w = Window.partitionBy("query_id", "source_type").orderBy(c("dense").desc(), "chunk_id")
    return T.candidates(s, d).where("source_type <> 'CPG'").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("query_id", "source_type", "chunk_id", "rank")


@query("SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 1 / (1 + exp(-(ln(greatest(1e-6, least(1 - 1e-6, rerank)) / (1 - greatest(1e-6, least(1 - 1e-6, rerank))))))) DESC, chunk_id) AS rank FROM cand) WHERE rank <= 10", CANDIDATES)
def rerank_order(s, d):
    """Through the scorer slot; the scorer at hand reads the score that comes with a passage."""
    given = T.candidates(s, d).select("query_id", "chunk_id", "dense", c("rerank").cast("string").alias("text"))
    r = R.rerank(given, lambda _, passages: [{"index": i, "p_hat": float(p)} for i, p in enumerate(passages)])
    return r.where("rank <= 10").select("query_id", "chunk_id", "rank")


@query("""SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN bad THEN dense ELSE round(least(1 - 1e-6, greatest(1e-6, tokens / 1000.0)), 9) END DESC, chunk_id) AS rank,
 CASE WHEN bad THEN 'identity:rerank-error' ELSE 'identity' END AS version FROM (SELECT *, max(tokens) OVER (PARTITION BY query_id) > 5000 OR max(tokens) OVER (PARTITION BY query_id) > 1000 AND query_id % 2 = 1 AS bad FROM cand)""", CANDIDATES)
def rerank_open(s, d):
    """A scorer with faults: it fails on passages above 5,000 words, and for odd queries loses one above 1,000; such queries keep their first order."""

    def scorer(query, passages):
        sizes = [len(X.WORDS.findall(p)) for p in passages]
        if max(sizes) > 5000:
            raise TimeoutError("passage too long")
        return [{"index": i, "score": n / 1000} for i, n in enumerate(sizes) if not (int(query) % 2 and n > 1000)][::-1]

    return R.rerank(T.candidates(s, d), scorer).select("query_id", "chunk_id", "rank", "version")


@query("""SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, round(coalesce(nullif(a.dense, 0), b.dense), 6) AS dense, round(coalesce(b.rerank, a.rerank), 6) AS rerank
 FROM dl a FULL JOIN rl b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id""", CANDIDATES + """, dl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, chunk_id) AS r FROM cand) WHERE r <= 16),
 rl AS (SELECT query_id, chunk_id, dense / 2 AS dense, round(1 - rerank / 2, 9) AS rerank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, chunk_id) AS r FROM cand) WHERE r <= 16)""")
def candidate_merge(s, d):
    """Two rounds of retrieval over all candidates, the second with scores of its own: the first non-zero dense score stays, the newest rerank score wins."""
    cand = T.candidates(s, d).select("query_id", "chunk_id", "dense", "rerank")
    a = L.top_k(cand, 16, "dense", "chunk_id").select("query_id", "chunk_id", c("dense").alias("d1"), c("rerank").alias("r1"))
    b = L.top_k(cand, 16, "rerank", "chunk_id").select("query_id", "chunk_id", (c("dense") / 2).alias("d2"), F.round(1 - c("rerank") / 2, 9).alias("r2"))
    return a.join(b, ["query_id", "chunk_id"], "full_outer").select("query_id", "chunk_id", F.round(F.coalesce(S.truthy(c("d1")), "d2"), 6).alias("dense"), F.round(F.coalesce("r2", "r1"), 6).alias("rerank"))


_SET = "list_distinct(list_filter(regexp_split_to_array(lower({}.text), '\\s+'), lambda w: w <> ''))"


@query(f"""r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, chunk_id) AS rank FROM cand)
 SELECT query_id, a AS chunk_id, b AS selected_id, round(least(1.0, CASE WHEN n = 0 THEN 0 ELSE i / n END + CASE WHEN a // 2 = b // 2 THEN 0.15 ELSE 0 END), 6) AS redundancy FROM (
 SELECT x.query_id, x.chunk_id AS a, y.chunk_id AS b, len(list_intersect({_SET.format('x')}, {_SET.format('y')}))::DOUBLE AS i, len(list_distinct(list_concat({_SET.format('x')}, {_SET.format('y')}))) AS n
 FROM r x JOIN r y ON x.query_id = y.query_id AND y.rank < x.rank WHERE x.rank <= 5)""", CANDIDATES)
def redundancy_pairs(s, d):
    """Word-set overlap of each of a query's first five with those ranked above it."""
    r = T.candidates(s, d).select("query_id", "chunk_id", "dense", F.array_distinct(X.tokens(c("text"))).alias("w"))
    r = L.top_k(r, 5, "dense", "chunk_id").select("query_id", "chunk_id", "w", "rank")
    y = r.select("query_id", c("chunk_id").alias("selected_id"), c("w").alias("v"), c("rank").alias("above"))
    j = r.join(y, "query_id").where("above < rank")
    n = F.size(F.array_union("w", "v"))
    same = F.when(F.floor(c("chunk_id") / 2) == F.floor(c("selected_id") / 2), 0.15).otherwise(0.0)
    return j.select("query_id", "chunk_id", "selected_id", F.round(F.least(F.lit(1.0), F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect("w", "v")) / n) + same), 6).alias("redundancy"))


_ASK = ("renal dosing of metformin", "drug allergy", "Hypertension in diabetes", "plain words")
_MISSING = (("safety_contraindications", "evidence_quality"), ("dose",), ())


@query("""SELECT item_id, CASE WHEN len(x) > 0 THEN q || ' ' || array_to_string(x, ' ') ELSE q END AS query FROM (SELECT item_id, q, list_sort(list_distinct(flatten([
 CASE WHEN contains(lower(q), 'metformin') THEN ['biguanide', 'glucophage'] ELSE [] END, CASE WHEN contains(lower(q), 'renal') THEN ['kidney', 'egfr', 'creatinine', 'ckd'] ELSE [] END,
 CASE WHEN contains(lower(q), 'contraindication') THEN ['contraindicated', 'do not use', 'avoid', 'not recommended'] ELSE [] END, CASE WHEN contains(lower(q), 'allergy') THEN ['hypersensitivity', 'allergic reaction'] ELSE [] END,
 CASE WHEN contains(lower(q), 'hypertension') THEN ['high blood pressure', 'htn'] ELSE [] END, CASE WHEN contains(lower(q), 'diabetes') THEN ['dm', 't2dm', 'type 2 diabetes'] ELSE [] END,
 ([['safety', 'contraindications', 'evidence', 'quality'], ['dose'], []])[item_id % 3 + 1]]))) AS x
 FROM (SELECT item_id, (['renal dosing of metformin', 'drug allergy', 'Hypertension in diabetes', 'plain words'])[item_id % 4 + 1] || ' ' || text AS q FROM benchmark))""")
def expand_query(s, d):
    i = c("item_id")
    ask = F.element_at(F.array(*map(F.lit, _ASK)), (i % 4 + 1).cast("int"))
    missing = F.element_at(F.array(*[F.array(*map(F.lit, m)).cast("array<string>") for m in _MISSING]), (i % 3 + 1).cast("int"))
    return T.table(s, d, "benchmark").select("item_id", decide.expand_query(F.concat(ask, F.lit(" "), "text"), missing).alias("query"))


@query("""SELECT vec_id, CASE WHEN vec_id % 6 = 5 THEN 0 ELSE 2 END AS n, CASE WHEN vec_id % 6 <> 5 THEN round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 3) END AS total FROM embeddings""")
def parse_embeddings(s, d):
    """A service's replies in five shapes, and one that holds no vectors."""
    i, v = c("vec_id") % 6, F.to_json(F.transform("embedding", lambda x: x.cast("double")))
    two = F.concat(F.lit("["), v, F.lit(", "), v, F.lit("]"))
    body = (
        F.when(i == 0, F.concat(F.lit('{"data": [{"embedding": '), v, F.lit('}, {"index": 1}, {"embedding": '), v, F.lit("}]}"))).when(i == 1, F.concat(F.lit('{"embeddings": '), two, F.lit("}")))
        .when(i == 2, F.concat(F.lit('{"embeddings": {"float": '), two, F.lit("}}"))).when(i == 3, F.concat(F.lit('{"embeddings": {"float_": '), two, F.lit("}}"))).when(i == 4, two).otherwise('{"error": "busy"}')
    )
    r = _vectors(s, d).select("vec_id", decide.embedding_response(body).alias("e"))
    return r.select("vec_id", F.size("e").alias("n"), F.round(F.aggregate(F.get("e", F.lit(0)), F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("""SELECT patient_id, string_agg(array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[1:140], ' '), ' ' ORDER BY chunk_id) AS synopsis FROM (
 SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY chunk_id) AS r FROM chunks WHERE source_type = 'EMR' AND org_id = 'org1') WHERE r <= 3 GROUP BY 1""", CHUNKS)
def patient_synopsis(s, d):
    emr = T.chunks(s, d).where("source_type = 'EMR' and org_id = 'org1'").select("patient_id", "chunk_id", "text")
    w = Window.partitionBy("patient_id").orderBy("chunk_id")
    first = emr.withColumn("r", F.row_number().over(w)).where("r <= 3").select("patient_id", "chunk_id", X.first_words(c("text"), 140).alias("t"))
    return first.groupBy("patient_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "t"))), lambda x: x["t"]), " ").alias("synopsis"))
