"""An inverted-file index at rest: lists by k-means, written by list, with product-quantised codes.

``fill`` fits the lists by distributed k-means, codes each vector's residual
from its list's centroid, and writes a table partitioned by list. A search
looks into the lists nearest to its queries: only their folders are read, in a
first pass only ids and codes, in a second the vectors of the few candidates
that are scored exactly. Nothing is fitted or assigned again in a search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import generations as G
from .lexical import top_k

#: Points a list for fitting, and those rounds; and the most lists, which bounds what is broadcast (with 64 components 16 MB).
POINTS, ROUNDS, MOST_LISTS = 256, 8, 65_536
#: Vectors scored at a time.
ROWS = 4096


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _vectors(column: pa.Array) -> np.ndarray:
    return unit(np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64))


def kmeans(points: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means over ``points.embedding``: sums a list and task meet in an aggregate, centroids come back."""
    c, sc = unit(start), points.sparkSession.sparkContext
    dim = c.shape[1]
    for _ in range(rounds):
        sent = sc.broadcast(c)

        def sums(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            c = sent.value
            n, total = np.zeros(len(c), np.int64), np.zeros(c.shape)
            for b in it:
                for at in range(0, b.num_rows, ROWS):
                    x = _vectors(b.column(0).slice(at, ROWS))
                    own = (x @ c.T).argmax(1)
                    n += np.bincount(own, minlength=len(c))
                    np.add.at(total, own, x)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["list_id", "total"])

        parts = points.select("embedding").mapInArrow(sums, "list_id int, total array<double>")
        moved = parts.groupBy("list_id").agg(F.array(*[F.sum(F.col("total")[i]) for i in range(dim)]).alias("total")).collect()  # a row a list
        sent.unpersist()
        c = c.copy()
        for r in moved:
            c[r["list_id"]] = r["total"]
        c = unit(c)
    return c


def fit_codes(residuals: np.ndarray, parts: int, codes: int = 256, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """``parts x codes x width`` codewords for the residuals, fitted on a bounded sample of them."""
    rng, width = np.random.default_rng(seed), residuals.shape[1] // parts
    words = []
    for m in range(parts):
        v = residuals[:, m * width : (m + 1) * width]
        w = v[rng.choice(len(v), min(codes, len(v)), replace=False)]
        for _ in range(rounds):
            own = ((w * w).sum(1) - 2 * (v @ w.T)).argmin(1)
            n = np.bincount(own, minlength=len(w))
            total = np.stack([np.bincount(own, v[:, i], minlength=len(w)) for i in range(width)], axis=1)
            w = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], w)
        words.append(w)
    return np.stack(words)


def encode(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    width = words.shape[2]
    return np.stack([((w * w).sum(1) - 2 * (x[:, m * width : (m + 1) * width] @ w.T)).argmin(1) for m, w in enumerate(words)], axis=1).astype(np.uint8)


@dataclass
class Index:
    """A generation that has been opened: its centroids and codewords, and the table of lists."""

    generation: G.Generation
    centroids: np.ndarray
    words: np.ndarray
    probes: int
    more: int
    table: DataFrame


def _sample(vectors: DataFrame, most: int) -> np.ndarray:
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("embedding").collect()
    return unit(np.array([r["embedding"] for r in rows], np.float64)) if rows else np.empty((0, 0))


def calibrated(x: np.ndarray, q: np.ndarray, centroids: np.ndarray, words: np.ndarray, k: int, recall: float) -> tuple[int, int]:
    """The fewest lists that hold ``recall`` of the true neighbours, and how many times ``k`` candidates by code have them.

    Measured with queries ``q`` that the lists were not fitted on, against the bounded sample ``x``.
    """
    k = min(k, len(x))
    if not k or not len(q):
        return len(centroids), 8
    near = np.argsort(-(q @ centroids.T), axis=1, kind="stable").argsort(1)  # rank of each list for each query
    own = (x @ centroids.T).argmax(1)
    best = np.argpartition(-(q @ x.T), k - 1, axis=1)[:, :k]
    needed = np.sort(np.take_along_axis(near, own[best], 1).ravel())
    at = min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)
    probes, width = int(needed[at]) + 1, words.shape[2]
    close = x - centroids[own]
    codes = encode(close, words)
    about = centroids[own] + np.hstack([w[codes[:, m]] for m, w in enumerate(words)]).reshape(len(x), -1)[:, : width * len(words)]
    s = np.where(near[:, own] < probes, q @ about.T, -np.inf)
    ranks = np.sort((-s).argsort(1, kind="stable").argsort(1, kind="stable")[np.arange(len(q))[:, None], best].ravel())
    return probes, max(8, math.ceil((int(ranks[: max(1, at)].max(initial=0)) + 1) / k))


def fill(vectors: DataFrame, folder: str, lists: int | None = None, parts: int = 16, recall: float = 0.98, k: int = 10, sample: int = 16_384, list_rows: int = 50_000) -> dict[str, object]:
    """Writes the index of ``vectors`` (``vec_id, embedding``, of one size).

    Lists are fitted on ``POINTS`` points each, spread over the executors, from starting points in hash order; codes and the
    number of lists a search looks into on at most ``sample`` vectors. Every vector is indexed. A full list is written by
    several tasks, ``list_rows`` rows each.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    if not n:
        spark.createDataFrame([], "vec_id long, codes binary, embedding array<float>, list_id int").write.parquet(f"{folder}/lists")
        return {"rows": 0}
    many = min(lists or max(1, round(math.sqrt(n))), MOST_LISTS, n)
    slot = F.pmod(F.xxhash64(F.lit("fit"), "vec_id"), F.lit(1 << 20))
    held, rest = vectors.where(slot < 1 << 14), vectors.where(slot >= 1 << 14)  # one in 64 asks only
    c = kmeans(rest.where(slot < (1 << 14) + math.ceil(POINTS * many / n * (1 << 20))), _sample(rest, many))
    x = _sample(rest, sample)
    words = fit_codes(x - c[(x @ c.T).argmax(1)], parts)
    probes, more = calibrated(x, _sample(held, 512), c, words, k, recall)
    sent = spark.sparkContext.broadcast((c, words))

    def listed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, words = sent.value
        for whole in it:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                x = _vectors(b.column(1))
                own = (x @ c.T).argmax(1)
                coded = [bytes(r) for r in encode(x - c[own], words)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(coded, pa.binary()), b.column(1), pa.array(own, pa.int32())], names=["vec_id", "codes", "embedding", "list_id"])

    kind = dict(vectors.dtypes)
    rows = vectors.select("vec_id", "embedding").mapInArrow(listed, f"vec_id {kind['vec_id']}, codes binary, embedding {kind['embedding']}, list_id int")
    files = max(1, math.ceil(n / many / list_rows))
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(files))
    rows.repartition(max(1, min(len(c) * files, 4096)), "list_id", salt).write.option("maxRecordsPerFile", list_rows).partitionBy("list_id").parquet(f"{folder}/lists")
    model = [("centroids", i, r.tolist()) for i, r in enumerate(c)] + [("words", i, r.ravel().tolist()) for i, r in enumerate(words)]
    spark.createDataFrame(model, "what string, i int, v array<double>").coalesce(1).write.parquet(f"{folder}/model")
    return {"rows": n, "lists": len(c), "probes": probes, "more": more, "dim": c.shape[1], "parts": parts}


def open_index(spark: SparkSession, generation: G.Generation) -> Index:
    facts = generation.facts
    if not facts["rows"]:
        return Index(generation, np.empty((0, 0)), np.empty((0, 0, 0)), 0, 0, generation.table(spark, "lists"))
    rows = generation.table(spark, "model").collect()  # a row a list and a part
    get = lambda what: np.array([r["v"] for r in sorted((r for r in rows if r["what"] == what), key=lambda r: r["i"])])
    words = get("words").reshape(facts["parts"], -1, facts["dim"] // facts["parts"])
    return Index(generation, get("centroids"), words, facts["probes"], facts["more"], generation.table(spark, "lists"))


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, more: int | None = None, block: int = 1024) -> DataFrame:
    """``query_id, vec_id, score, rank`` by cosine, from the index alone.

    Queries go out in blocks of bounded size. ``more`` times ``k`` candidates a query, found by their codes in the probed lists,
    are scored exactly. Both numbers are the index's own, measured when it was built, unless given.
    """
    spark, empty = queries.sparkSession, "query_id long, vec_id long, score double, rank int"
    if not len(index.centroids):
        return spark.createDataFrame([], empty)
    probes, more = min(probes or index.probes, len(index.centroids)), more or index.more
    blocks, out = max(1, math.ceil(queries.count() / block)), None
    for i in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).select("query_id", "embedding").collect()
        if not rows:
            continue
        ids, q = np.array([r["query_id"] for r in rows], np.int64), unit(np.array([r["embedding"] for r in rows], np.float64))
        near = np.argsort(-(q @ index.centroids.T), axis=1, kind="stable")[:, :probes]
        probed = np.unique(near)
        asks = {int(j): np.flatnonzero((near == j).any(1)) for j in probed}
        sent = spark.sparkContext.broadcast((ids, q, asks, index.centroids[probed], {int(j): at for at, j in enumerate(probed)}, index.words))
        lists = index.table if len(probed) == len(index.centroids) else index.table.where(F.col("list_id").isin(probed.tolist()))
        found = lists.select("list_id", "vec_id", "codes").mapInArrow(_by_codes(sent, k * more), "query_id long, list_id int, vec_id long, score double")
        near_ones = top_k(found, k * more, item="vec_id").select("query_id", "list_id", "vec_id")
        # exact scores of the candidates, from the lists that hold any
        vectors = lists.select("list_id", "vec_id", "embedding").join(near_ones, ["list_id", "vec_id"])
        part = vectors.select("query_id", "vec_id", "embedding").mapInArrow(_exactly(sent), "query_id long, vec_id long, score double")
        out = part if out is None else out.unionByName(part)
    return top_k(out, k, item="vec_id") if out is not None else spark.createDataFrame([], empty)


def _by_codes(sent, keep: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, asks, centroids, place, words = sent.value
        width = words.shape[2]
        tables = np.stack([q[:, m * width : (m + 1) * width] @ w.T for m, w in enumerate(words)])  # parts x queries x codes
        best_s = np.full((len(ids), keep), -np.inf)
        best_v, best_l = np.zeros((len(ids), keep), np.int64), np.zeros((len(ids), keep), np.int32)
        for whole in it:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                lists, names = b.column(0).to_numpy(), b.column(1).to_numpy()
                codes = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                for j in np.unique(lists):
                    ask, here = asks.get(int(j)), np.flatnonzero(lists == j)
                    if ask is None:
                        continue
                    s = np.repeat((q[ask] @ centroids[place[int(j)]])[:, None], len(here), axis=1)
                    for m, t in enumerate(tables):
                        s += t[ask][:, codes[here, m]]
                    s = np.hstack([best_s[ask], s])
                    v = np.hstack([best_v[ask], np.broadcast_to(names[here], (len(ask), len(here)))])
                    ls = np.hstack([best_l[ask], np.full((len(ask), len(here)), j, np.int32)])
                    top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                    best_s[ask], best_v[ask], best_l[ask] = (np.take_along_axis(m, top, 1) for m in (s, v, ls))
        ok = best_s.ravel() > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, keep)[ok]), pa.array(best_l.ravel()[ok]), pa.array(best_v.ravel()[ok]), pa.array(best_s.ravel()[ok])], names=["query_id", "list_id", "vec_id", "score"])

    return run


def _exactly(sent):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value[:2]
        order = np.argsort(ids)
        for b in it:
            if not b.num_rows:
                continue
            of = order[np.searchsorted(ids, b.column(0).to_numpy(), sorter=order)]
            s = np.einsum("ij,ij->i", q[of], _vectors(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(s, 9))], names=["query_id", "vec_id", "score"])

    return run
