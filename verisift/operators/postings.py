"""BM25 from an inverted index at rest: posting blocks with their greatest impact, written by term.

Documents are dealt into ranges by length, so that a range's greatest impact
says much: the same count weighs more in a shorter text. A block holds a
term's postings in a range. A search reads the heads of its terms' blocks
first, sums their greatest impacts to a bound for each query and range, scores
each query's most promising ranges, and then only those whose bound reaches
the score of its k-th document. The result is that of scoring everything.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from . import generations as G
from .lexical import top_k
from .pipeline import written

#: Rows of queries' terms up to which they are broadcast.
SMALL = 200_000
#: Score differences below this are rounding; bounds are widened by it.
SLACK = 1e-6


def _blocks(kind: str) -> str:
    return f"term string, range int, n long, most double, docs array<{kind}>, tf array<int>, dl array<int>, shard int"


def fill(docs: DataFrame, terms: Column, folder: str, k1: float = 1.2, b: float = 0.75, range_docs: int = 2048, shards: int | None = None, stem: Callable[[str], str] | None = None, range_terms: int = 2_000_000) -> dict[str, object]:
    """Writes posting blocks of ``docs`` (``doc_id, text``) for the array of ``terms`` of a text (null: none).

    A block has about ``range_docs`` postings at most, so no term, however common, is gathered in one row or task. The texts of a
    range meet in one task, which makes all its blocks; so a range is bounded by ``range_terms`` as well, and what is shuffled is
    the texts once and the finished blocks once, never a row a posting. ``stem`` maps a term to the one it is indexed by; it is
    asked once for each distinct term of a range.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    own = docs.select("doc_id", "text")
    listed = F.coalesce(terms, F.array().cast("array<string>"))
    dl = F.size(listed)
    band = F.floor(8 * F.log2(F.col("dl") + 1)).cast("int")
    sizes = own.select(dl.alias("dl")).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"))  # some 250 bands at most
    seen = sizes.collect()
    n_docs, total = sum(r["n"] for r in seen), sum(r["total"] for r in seen)
    avgdl = total / n_docs if total else 1.0
    # neighbouring bands share ranges up to the bounds; fuller ones are split by hash
    parts = lambda n, size: max(1, math.ceil(n / range_docs), math.ceil(size / range_terms))
    split, begin, n, size = [], 0, 0, 0
    for r in sorted(seen, key=lambda r: r["band"]):
        if n and parts(n + r["n"], size + r["total"]) > 1:
            begin, n, size = begin + parts(n, size), 0, 0
        n, size = n + r["n"], size + r["total"]
        split.append((r["band"], begin, parts(n, size)))
    ranges = begin + parts(n, size)
    dealt = own.withColumn("dl", dl).withColumn("band", band).join(F.broadcast(spark.createDataFrame(split, "band int, begin int, parts int")), "band")
    dealt = dealt.withColumn("range", F.col("begin") + F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).select("range", "doc_id", "text")
    tasks = max(G.parallel(spark), min(ranges, total // 20_000_000))
    together = dealt.repartition(tasks, "range").sortWithinPartitions("range", "doc_id").select("range", "doc_id", listed.alias("terms"))
    made = together.mapInArrow(_block_maker(kind, k1, b, avgdl, stem), f"range int, term string, n long, most double, docs array<{kind}>, tf array<int>, dl array<int>")
    many = shards or min(4096, max(G.parallel(spark), total // 5_000_000))
    shard = F.pmod(F.xxhash64("term"), F.lit(many)).cast("int")
    rows = made.select("term", "range", "n", "most", "docs", "tf", "dl", shard.alias("shard"))
    # by term within a file: its terms' blocks are what a search reads of it
    rows.repartition(many, "shard").sortWithinPartitions("shard", "term", "range").write.partitionBy("shard").parquet(f"{folder}/blocks")
    heads = spark.read.schema(_blocks(kind)).parquet(f"{folder}/blocks")
    words = heads.groupBy("shard", "term").agg(F.sum("n").alias("df"))
    words.repartition(many, "shard").sortWithinPartitions("shard", "term").write.partitionBy("shard").parquet(f"{folder}/terms")
    return {"n_docs": n_docs, "avgdl": avgdl, "shards": many, "k1": k1, "b": b, "doc_type": kind}


def _block_maker(kind: str, k1: float, b: float, avgdl: float, stem: Callable[[str], str] | None):
    """Documents in order of their ranges to blocks: a task holds the terms of one range, as numbers."""
    names = ["range", "term", "n", "most", "docs", "tf", "dl"]

    def blocks(at: int, docs: list, sizes: list[int], words: list[str], number: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not words:
            return
        if stem is not None:
            stems: dict[str, int] = {}
            number = np.array([stems.setdefault(stem(w), len(stems)) for w in words], np.int64)[number]
            words = list(stems)
        # one entry a term and document, in order of terms, then documents
        pair, tf = np.unique(number * len(docs) + doc, return_counts=True)
        term, doc = np.divmod(pair, len(docs))
        dl = np.array(sizes, np.int64)[doc]
        impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
        begin = np.searchsorted(term, np.arange(len(words) + 1))
        most, ids = np.maximum.reduceat(impact, begin[:-1]), pa.array(docs, doc_type)
        for i in range(0, len(words), 4096):
            cut = begin[i : i + 4097]
            n, inside, offsets = len(cut) - 1, slice(cut[0], cut[-1]), pa.array(cut - cut[0], pa.int32())
            lists = [ids.take(pa.array(doc[inside])), pa.array(tf[inside], pa.int32()), pa.array(dl[inside], pa.int32())]
            columns = [pa.array(np.full(n, at), pa.int32()), pa.array(words[i : i + n], pa.string()), pa.array(np.diff(cut), pa.int64()), pa.array(most[i : i + n], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.ListArray.from_arrays(offsets, x) for x in lists], names=names)

    doc_type = to_arrow_type(_parse_datatype_string(kind))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, sizes, vocabulary, numbers, owners = None, [], [], {}, [], []

        def settle() -> Iterator[pa.RecordBatch]:
            if docs:
                yield from blocks(now, docs, sizes, list(vocabulary), np.concatenate(numbers), np.concatenate(owners))

        for batch in it:
            ranges = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1), len(ranges)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if ranges[lo] != now:
                    yield from settle()
                    now, docs, sizes, vocabulary, numbers, owners = int(ranges[lo]), [], [], {}, [], []
                part = batch.slice(lo, hi - lo)
                lists = part.column(2)
                coded = lists.flatten().dictionary_encode()
                number = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in coded.dictionary.to_pylist()], np.int64)
                lengths, place = lists.value_lengths().to_pylist(), []
                for doc, n in zip(part.column(1).to_pylist(), lengths, strict=True):
                    if not docs or docs[-1] != doc:  # rows that repeat an id are one document
                        docs.append(doc)
                        sizes.append(n)
                    place.append(len(docs) - 1)
                numbers.append(number[coded.indices.to_numpy()] if len(coded) else number[:0])
                owners.append(np.repeat(np.array(place, np.int64), lengths))
        yield from settle()

    return run


@dataclass
class Index:
    generation: G.Generation
    terms: DataFrame
    blocks: DataFrame

    @property
    def facts(self) -> dict:
        return self.generation.facts


def open_index(spark: SparkSession, generation: G.Generation) -> Index:
    return Index(generation, generation.table(spark, "terms", "term string, df long, shard int"), generation.table(spark, "blocks", _blocks(generation.facts["doc_type"])))


def mean_idf(index: Index) -> float:
    """Mean idf over the whole vocabulary, from the term table alone."""
    n = index.facts["n_docs"]
    return index.terms.agg(F.avg(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))).first()[0] or 0.0


def search(index: Index, queries: DataFrame, k: int, floor: float | None = None, first: int = 2, block: int = 1024, only: DataFrame | None = None) -> DataFrame:
    """``query_id, doc_id, score, rank`` for ``queries`` (``query_id, term, weight``, a term once a query).

    Negative idf becomes 1e-6, or ``floor`` (a share of the mean idf) if that is given. Queries go through in blocks of about
    ``block``; ``only`` (``doc_id``) limits the documents before they are ranked.
    """
    spark, facts = queries.sparkSession, index.facts
    schema = f"query_id long, doc_id {facts['doc_type']}, score double, rank int"
    blocks, out = max(1, math.ceil(queries.select("query_id").distinct().count() / block)), None
    for i in range(blocks):
        part = _search_block(index, queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), k, floor, first, only)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def weighted(index: Index, queries: DataFrame, floor: float | None) -> DataFrame:
    """``query_id, shard, term, w``: the terms that the index has, with weight times idf."""
    n, many = index.facts["n_docs"], index.facts["shards"]
    asked = queries.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(many)).cast("int"))
    raw = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.greatest(raw, F.lit(1e-6)) if floor is None else F.when(raw < 0, floor).otherwise(raw)
    asked = asked.where(F.col("weight") > 0)
    return asked.join(index.terms, ["shard", "term"]).select("query_id", "shard", "term", (F.col("weight") * idf).alias("w")).where("w <> 0")


def _search_block(index: Index, queries: DataFrame, k: int, floor: float | None, first: int, only: DataFrame | None) -> DataFrame:
    spark, facts = queries.sparkSession, index.facts
    rows = weighted(index, queries, floor).collect()  # the terms of a block of queries
    # a block of queries is small, and its size is known here; beyond the limit the joins shuffle
    small = F.broadcast if len(rows) <= SMALL else lambda df: df
    asked = small(spark.createDataFrame(rows, "query_id long, shard int, term string, w double"))
    terms = sorted({r["term"] for r in rows})
    place, ids = {t: j for j, t in enumerate(terms)}, sorted({r["query_id"] for r in rows})
    number = {q: j for j, q in enumerate(ids)}
    by_term: list[list[tuple[int, float]]] = [[] for _ in terms]
    for r in rows:
        by_term[place[r["term"]]].append((number[r["query_id"]], r["w"]))
    model = ({t: (np.array([q for q, _ in x], np.int64), np.array([w for _, w in x])) for t, x in zip(terms, by_term, strict=True)}, np.array(ids, np.int64))
    sent = spark.sparkContext.broadcast(model)

    shards = sorted({r["shard"] for r in rows})
    blocks = index.blocks.where(F.col("shard").isin(shards)) if shards else index.blocks.limit(0)
    wanted = small(spark.createDataFrame(sorted({(r["shard"], r["term"]) for r in rows}), "shard int, term string"))
    heads = blocks.select("shard", "term", F.col("range").alias("at"), "most").join(asked, ["shard", "term"])
    bounds = heads.groupBy("query_id", "at").agg(F.sum(F.greatest(F.col("w"), F.lit(0.0)) * F.col("most")).alias("bound"))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "at"))
    bounds = written(bounds.withColumn("turn", turn), "bm25-bounds")
    scorer = _scorer(sent, facts, k, only is not None)
    kind = f"query_id long, doc_id {facts['doc_type']}, score double"

    def scored(pairs: DataFrame) -> DataFrame:
        postings = blocks.join(wanted, ["shard", "term"], "left_semi").join(pairs.select(F.col("at").alias("range")).distinct(), "range", "left_semi")
        found = postings.select("range", "term", "docs", "tf", "dl").groupBy("range").cogroup(pairs.select("at", "query_id").groupBy("at")).applyInPandas(scorer, kind)
        if only is not None:  # the scorer keeps all then, so that the limit comes before the ranks
            found = found.join(only, "doc_id", "left_semi")
        return found

    best = written(top_k(scored(bounds.where(F.col("turn") <= first)), k).drop("rank"), "bm25-first")
    least = best.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("have"))
    needed = F.when(F.col("have") >= k, F.col("least")).otherwise(0.0)
    rest = bounds.where(F.col("turn") > first).join(least, "query_id", "left").where(F.col("bound") * (1 + SLACK) + SLACK >= F.coalesce(needed, F.lit(0.0)))
    return top_k(best.unionByName(scored(rest)), k)


def _scorer(sent, facts: dict, k: int, keep_all: bool):
    k1, b, avgdl = facts["k1"], facts["b"], facts["avgdl"]

    def run(key: tuple, postings: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        by_term, ids = sent.value
        active = np.zeros(len(ids), bool)
        active[np.searchsorted(ids, pairs["query_id"].to_numpy())] = True
        if not active.any() or not len(postings):
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        docs = np.concatenate([np.asarray(d) for d in postings["docs"]])
        names, at = np.unique(docs, return_inverse=True)
        line = np.cumsum(active) - 1
        score, end = np.zeros((int(active.sum()), len(names))), 0
        for term, own, tf, dl in zip(postings["term"], postings["docs"], postings["tf"], postings["dl"], strict=True):
            here, end = at[end : end + len(own)], end + len(own)
            asks, w = by_term[term]
            on = active[asks]
            if on.any():
                tf, dl = np.asarray(tf, float), np.asarray(dl, float)
                score[np.ix_(line[asks[on]], here)] += np.outer(w[on], tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)))
        score = np.round(score, 9)
        if keep_all or score.shape[1] <= k:
            q, d = np.nonzero(score > 0)
        else:
            least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
            q, d = np.nonzero((score >= least[:, None]) & (score > 0))
        return pd.DataFrame({"query_id": ids[active][q], "doc_id": names[d], "score": score[q, d]})

    return run
