"""Proximity graphs at rest: layered neighbour graphs over shards of bounded size, searched by beams.

Vectors are dealt into shards by the hash of their id. Each shard gets a graph
of its own: its members' nearest neighbours, thinned to diverse directions,
with links back; every sixteenth member also stands in the layer above. A
search descends the layers of each shard for a whole block of queries at once
and keeps ``ef`` nodes a query in its beam. The beam a shard needs is measured
when it is built, with members that are kept outside the graph. Nothing is fitted, and nothing but a line of facts passes
through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import generations as G
from .ivf import unit
from .lexical import top_k

#: Members of a layer for each member of the one above, and the size below which a layer is scored whole.
FAN, TOP = 16, 64
#: Beams that are tried when a shard is built, and the one that is not exceeded.
BEAMS, CEILING = (50, 100, 200, 400, 800, 1600), 2000
#: Members of a shard that stay outside its graph: they ask it for the beam it needs, and are scored whole in a search.
APART = 128
#: Nodes of a beam that are opened at a time.
OPENED = 4


def linked(x: np.ndarray, m: int) -> np.ndarray:
    """``n x 2m`` links (-1: none): the nearest neighbours, diverse ones first, and links back to those that name a node."""
    n = len(x)
    near = min(n - 1, 3 * m)
    if near <= 0:
        return np.full((n, 1), -1, np.int32)
    out = np.full((n, 2 * m), -1, np.int32)
    for at in range(0, n, 1024):
        rows = np.arange(at, min(n, at + 1024))
        s = x[rows] @ x.T
        s[np.arange(len(rows)), rows] = -np.inf
        names = np.argpartition(-s, near - 1, axis=1)[:, :near]
        own = np.take_along_axis(s, names, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        names, own = np.take_along_axis(names, order, 1), np.take_along_axis(own, order, 1)
        among = np.einsum("rid,rjd->rij", x[names], x[names])
        kept = np.zeros(names.shape, bool)
        for c in range(near):  # a neighbour stays if it is nearer to the node than to any that stays already
            kept[:, c] = ~(kept & (among[:, c, :] >= own[:, c : c + 1])).any(axis=1)
        first = np.argsort(~kept, axis=1, kind="stable")[:, :m]  # the rest fill up, nearest first
        out[rows, : first.shape[1]] = np.take_along_axis(names, first, 1)
    # links back, the nearest first, in the second half
    source, target = np.repeat(np.arange(n), m), out[:, :m].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.lexsort((-np.einsum("ij,ij->i", x[source], x[target]), target))
    source, target = source[order], target[order]
    begin = np.searchsorted(target, np.arange(n))
    place = np.arange(len(target)) - begin[target]
    ok = place < m
    out[target[ok], m + place[ok]] = source[ok]
    return out


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """``ef`` nodes a query found from its entries (unique in a row, -1: none), best first, and their scores (-inf: none)."""
    many, ef = len(q), min(ef, len(x))
    seen = np.zeros((many, len(x) + 1), bool)  # the last column stands for "none"
    seen[:, -1] = True
    row = np.arange(many)[:, None]
    seen[row, entries] = True
    ids = np.full((many, ef), -1, np.int64)
    scores, opened = np.full((many, ef), -np.inf), np.ones((many, ef), bool)
    new, new_s = entries, np.where(entries >= 0, np.einsum("qd,qnd->qn", q, x[entries]), -np.inf)
    alive = np.arange(many)
    while len(alive):
        all_s = np.hstack([scores[alive], new_s])
        top = np.argsort(-all_s, axis=1, kind="stable")[:, :ef]
        scores[alive] = np.take_along_axis(all_s, top, 1)
        ids[alive] = np.take_along_axis(np.hstack([ids[alive], new]), top, 1)
        opened[alive] = np.take_along_axis(np.hstack([opened[alive], ~np.isfinite(new_s)]), top, 1)
        alive = alive[~opened[alive].all(axis=1)]
        if not len(alive):
            break
        turn = np.argsort(opened[alive], axis=1, kind="stable")[:, :OPENED]  # the best that are still closed
        fresh = ~np.take_along_axis(opened[alive], turn, 1)
        opened[alive[:, None], turn] = True
        nodes = np.where(fresh, np.take_along_axis(ids[alive], turn, 1), -1)
        new = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(alive), -1).astype(np.int64)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[alive[:, None], new]] = -1
        seen[alive[:, None], new] = True
        new_s = np.where(new >= 0, np.einsum("qd,qnd->qn", q[alive], x[new]), -np.inf)
    return ids, scores


def descend(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """From the topmost layer, scored whole, down to the lowest. A layer: its members' positions and their links."""
    members, ef = layers[-1][0], min(ef, CEILING)
    if len(layers) == 1 and len(x) <= TOP:
        s = q @ x.T
        order = np.argsort(-s, axis=1, kind="stable")[:, :ef]
        return order, np.take_along_axis(s, order, 1)
    entries = members[np.argsort(-(q @ x[members].T), axis=1, kind="stable")[:, :8]]
    for members, links in reversed(layers[:-1]):
        place = np.full(len(x) + 1, -1)
        place[members] = np.arange(len(members))
        ids, scores = beam(x[members], links, q, place[entries], ef if len(members) == len(x) else 16)
        entries = np.where(ids[:, :8] >= 0, members[ids[:, :8]], -1)
    return np.where(ids >= 0, members[ids], -1), scores


def _layers(x: np.ndarray, m: int) -> list[tuple[np.ndarray, np.ndarray]]:
    members, layers = np.arange(len(x)), []
    while True:
        layers.append((members, linked(x[members], m)))
        if len(members) <= TOP:
            return layers
        members = members[:: FAN]  # members lie in hash order


def _needed(x: np.ndarray, layers: list, q: np.ndarray, k: int, recall: float) -> int:
    """The least beam that finds ``recall`` of the ``k`` nearest of vectors that are not in the graph."""
    k = min(k, len(x))
    if not len(q):
        return BEAMS[-1]
    least = -np.partition(-(q @ x.T), k - 1, axis=1)[:, k - 1]
    for ef in BEAMS:
        hits = (descend(x, layers, q, ef)[1] >= least[:, None] - 1e-9).sum(axis=1)
        if np.minimum(hits, k).sum() >= recall * k * len(q):
            return ef
    return CEILING


def _best(x: np.ndarray, apart: int, layers: list, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of a shard: its first ``apart`` members are scored whole, the others by the graph."""
    ids, scores = descend(x[apart:], layers, q, max(2 * k, ef))
    ids = np.hstack([np.broadcast_to(np.arange(apart), (len(q), apart)), np.where(ids >= 0, ids + apart, -1)])
    scores = np.hstack([q @ x[:apart].T, scores])
    top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(ids, top, 1), np.take_along_axis(scores, top, 1)


def fill(vectors: DataFrame, folder: str, shard_rows: int = 8192, m: int = 16, k: int = 10, recall: float = 0.97) -> dict[str, object]:
    """Writes the graphs of ``vectors`` (``vec_id, embedding``, of one size): a row a shard of about ``shard_rows`` vectors."""
    n = vectors.count()
    shards = max(1, math.ceil(n / shard_rows))
    kind = dict(vectors.dtypes)["vec_id"]

    def graph(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "vec_id"], ignore_index=True)
        x = unit(np.stack(pdf["embedding"].to_list()).astype(np.float64))
        apart = min(APART, len(x) // FAN)
        layers = _layers(x[apart:], m)
        return pd.DataFrame({
            "shard": [key[0]], "ids": [pdf["vec_id"].to_numpy()], "vectors": [x.astype(np.float32).tobytes()], "ef": [_needed(x[apart:], layers, x[:apart], k, recall)], "apart": [apart],
            "links": [[links.astype(np.int32).tobytes() for _, links in layers]], "members": [[p.astype(np.int32).tobytes() for p, _ in layers]],
        })

    h = F.xxhash64("vec_id")
    dealt = vectors.select(F.pmod(h, F.lit(shards)).cast("int").alias("shard"), h.alias("h"), "vec_id", "embedding")
    schema = f"shard int, ids array<{kind}>, vectors binary, ef int, apart int, links array<binary>, members array<binary>"
    dealt.groupBy("shard").applyInPandas(graph, schema).write.option("maxRecordsPerFile", 8).parquet(f"{folder}/shards")
    return {"rows": n, "shards": shards, "id_type": kind}


def search(spark: SparkSession, generation: G.Generation, queries: DataFrame, k: int, ef: int | None = None, block: int = 512) -> DataFrame:
    """``query_id, vec_id, score, rank`` by cosine. Queries go out in blocks; each shard keeps its best ``k`` a query.

    ``ef`` is the beam; if not given, each shard's own, at least twice ``k``.
    """
    kind = generation.facts["id_type"]
    out = None
    blocks = max(1, math.ceil(queries.count() / block))
    shards = generation.table(spark, "shards")
    for i in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).select("query_id", "embedding").collect()
        if not rows:
            continue
        sent = spark.sparkContext.broadcast((np.array([r["query_id"] for r in rows], np.int64), unit(np.array([r["embedding"] for r in rows], np.float64))))

        def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            for b in it:
                for r in b.to_pylist():
                    x = np.frombuffer(r["vectors"], np.float32).reshape(len(r["ids"]), -1).astype(np.float64)
                    layers = [(np.frombuffer(p, np.int32), np.frombuffer(e, np.int32)) for p, e in zip(r["members"], r["links"], strict=True)]
                    layers = [(p, e.reshape(len(p), -1)) for p, e in layers]
                    ids, scores = _best(x, r["apart"], layers, q, k, ef or r["ef"])
                    ok = (ids >= 0).ravel()
                    found = pa.array(np.array(r["ids"], dtype=object)[ids.ravel()[ok]].tolist())
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, ids.shape[1])[ok]), found, pa.array(np.round(scores.ravel()[ok], 6))], names=["query_id", "vec_id", "score"])

        part = shards.select("ids", "vectors", "ef", "apart", "links", "members").mapInArrow(run, f"query_id long, vec_id {kind}, score double")
        out = part if out is None else out.unionByName(part)
    return top_k(out, k, item="vec_id") if out is not None else spark.createDataFrame([], f"query_id long, vec_id {kind}, score double, rank int")
