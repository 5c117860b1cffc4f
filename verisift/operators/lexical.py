"""Lexical retrieval: inverted index and BM25 for a table of queries at once."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def postings(docs: DataFrame, terms: Column, wanted: DataFrame | None = None) -> DataFrame:
    """``term, doc_id, tf, dl``. With ``wanted`` (``term``) only those, dropped before the shuffle where it is small."""
    t = docs.select("doc_id", terms.alias("_t")).select("doc_id", F.size("_t").cast("long").alias("dl"), F.explode("_t").alias("term"))
    if wanted is not None:
        t = t.join(wanted, "term", "left_semi")
    return t.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def corpus_size(docs: DataFrame, terms: Column) -> DataFrame:
    """One row: the number of documents and their mean length in terms."""
    return docs.select(F.size(terms).alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def bm25(docs: DataFrame, queries: DataFrame, doc_terms: Column, k1: float, b: float, floor: str = "small", eps: float = 0.25) -> DataFrame:
    """``query_id, doc_id, score`` for ``queries`` (``query_id, term, weight``); documents without a term have no row.

    Negative idf becomes 1e-6 (``small``), or ``eps`` times the mean idf of the vocabulary (``mean``).
    """
    size = corpus_size(docs, doc_terms)
    found = postings(docs, doc_terms, queries.select("term").distinct())
    idf = found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(size))  # one row
    raw = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    if floor == "mean":
        every = postings(docs, doc_terms).groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(size))
        mean = every.agg(F.avg(raw).alias("mean_idf"))
        idf = idf.join(F.broadcast(mean)).withColumn("idf", F.when(raw < 0, eps * F.col("mean_idf")).otherwise(raw))
    else:
        idf = idf.withColumn("idf", F.greatest(raw, F.lit(1e-6)))
    hits = queries.join(idf, "term").join(found, "term")
    tf = F.col("tf")
    part = F.col("weight") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def bm25_scan(docs: DataFrame, queries: DataFrame, tokenize: Callable[[str], list[str]], k: int, k1: float, b: float, mean_idf: float | None = None, eps: float = 0.25, block: int = 2048) -> DataFrame:
    """``query_id, doc_id, score, rank``: BM25 top-k by scanning, the plan for many queries.

    Common terms match most documents, so joining postings makes rows in
    proportion to queries x documents. Here queries go out in blocks of
    bounded size, each task scores a document against a block at once and
    keeps its own best k; only k rows a query and task are shuffled. Negative
    idf becomes 1e-6, or ``eps * mean_idf`` if that is given.
    """
    n_queries = queries.select("query_id").distinct().count()
    blocks = max(1, math.ceil(n_queries / block))
    sc, out = docs.sparkSession.sparkContext, None
    for i in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).select("query_id", "term", "weight").collect()
        if not rows:
            continue
        ids = sorted({r["query_id"] for r in rows})
        terms = {t: j for j, t in enumerate(sorted({r["term"] for r in rows}))}
        place = {q: j for j, q in enumerate(ids)}
        sent = sc.broadcast(terms)

        def count(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            terms, df, n, total = sent.value, Counter(), 0, 0
            for batch in it:
                for text in batch.column(0).to_pylist():
                    words = tokenize(text or "")
                    n, total = n + 1, total + len(words)
                    df.update(terms[w] for w in set(words) if w in terms)
            yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *df]), pa.array([n, total, *df.values()], pa.int64())], names=["t", "n"])

        seen = {r["t"]: r["n"] for r in docs.select("text").mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}  # a row a term of the block
        n_docs, total = seen.get(-2, 0), seen.get(-1, 0)
        df = np.array([seen.get(j, 0) for j in range(len(terms))], float)
        raw = np.log((n_docs - df + 0.5) / (df + 0.5))
        idf = np.where(raw < 0, eps * mean_idf, raw) if mean_idf is not None else np.maximum(raw, 1e-6)
        weight = np.zeros((len(terms), len(ids)))
        for r in rows:
            weight[terms[r["term"]], place[r["query_id"]]] += r["weight"] * idf[terms[r["term"]]]
        model = sc.broadcast((weight, total / n_docs if n_docs else 1.0, np.array(ids)))

        def score(it: Iterator[pa.RecordBatch], sent=sent, model=model) -> Iterator[pa.RecordBatch]:
            terms, (weight, avgdl, ids) = sent.value, model.value
            best_s, best_d = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)

            def settle(scores: list[np.ndarray], names: list[int]) -> None:
                nonlocal best_s, best_d
                s = np.hstack([best_s, np.round(np.array(scores).T, 9)])
                d = np.hstack([best_d, np.broadcast_to(np.array(names, np.int64), (len(ids), len(names)))])
                order = np.lexsort((d, -s), axis=1)[:, :k]
                best_s, best_d = np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)

            for batch in it:
                scores, names = [], []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = tokenize(text or "")
                    tf = Counter(terms[w] for w in words if w in terms)
                    if not tf:
                        continue
                    f = np.fromiter(tf.values(), float)
                    scores.append((f * (k1 + 1) / (f + k1 * (1 - b + b * len(words) / avgdl))) @ weight[list(tf)])
                    names.append(doc)
                    if len(names) == 256:
                        settle(scores, names)
                        scores, names = [], []
                if names:
                    settle(scores, names)
            flat = best_s.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best_s.shape[1]), pa.int64()), pa.array(best_d.ravel(), pa.int64()), pa.array(flat, pa.float64())], names=["query_id", "doc_id", "score"]).filter(pa.array(flat > 0))

        part = docs.select("doc_id", "text").mapInArrow(score, "query_id long, doc_id long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    return top_k(out, k)


def mean_idf(docs: DataFrame, terms: Column) -> float:
    """Mean idf over the whole vocabulary."""
    size = corpus_size(docs, terms)
    words = docs.select("doc_id", F.explode(F.array_distinct(terms)).alias("term"))
    df = words.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(size))
    return df.agg(F.avg(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))).first()[0] or 0.0


def top_k(scored: DataFrame, k: int, score: str = "score", item: str = "doc_id", query: str = "query_id") -> DataFrame:
    """The k best of each query with ``rank`` from 1; ties by id. The rank filter lets Spark cut each group before the shuffle."""
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(item))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rounded(found: DataFrame) -> DataFrame:
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")
