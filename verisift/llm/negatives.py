"""Hard-negative mining by product quantisation with stored residual norms.

Vectors become integers, ``floor(scale * x)``, and are cut into sub-vectors.
The index is a table: for each row the nearest codeword of each sub-vector,
the norms of what the codewords leave over, and the vector itself. Codewords
are fitted on at most ``sample`` rows in hash order; every row is indexed.

For an anchor a, tables of inner products with all codewords give an estimate
of a row's score, and it is wrong by at most the sum over sub-vectors of
``|a_m| * |residual_m|``. All of it is integers (norms rounded up), so the
bound is rigorous: rows that it keeps out of a window or below the best so far
cannot belong to the result. The others get their exact integer score, and
each window is completed from those. A first pass finds each anchor's
positives, a second the negatives in the window of each positive. Anchors go
out in blocks of bounded size, each against all rows; a task returns its best
few for an anchor, which meet in a window function.

Rows without an id or a label, with a null vector or a null or non-finite
component, or with another number of components than ``dim`` take no part; nor
do vectors whose integer norm reaches 2^31, as their scores need not fit a
long. Rows that repeat an anchor's id are not its positives; otherwise
repeated rows are rows like any other, and each repeated anchor gives its own
rows. Anchors without a positive, and positives without a row in their window,
give none; an empty table gives an empty result. Columns other than id, label
and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clusters import usable
from .common import stage, unstage

#: Rows and anchors that are scored at a time.
ROWS, ANCHORS = 4096, 512
#: Up to here sums of products are exact as doubles.
EXACT = 1 << 53
LOWEST = -(1 << 62)


@dataclass
class Quantiser:
    """``words``: for each sub-vector its codewords, integers held as doubles."""

    words: np.ndarray  # parts x codes x width

    @property
    def width(self) -> int:
        return self.words.shape[2]

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and residual norms, rounded up, of a row's sub-vectors."""
        parts = len(self.words)
        codes, left = np.empty((len(x), parts), np.uint8), np.empty((len(x), parts))
        for m, w in enumerate(self.words):
            v = x[:, m * self.width : (m + 1) * self.width]
            codes[:, m] = ((w * w).sum(1) - 2 * (v @ w.T)).argmin(1)
            left[:, m] = norms(v - w[codes[:, m]])
        return codes, left

    def tables(self, a: np.ndarray) -> np.ndarray:
        """``parts x anchors x codes`` inner products."""
        return np.stack([a[:, m * self.width : (m + 1) * self.width] @ w.T for m, w in enumerate(self.words)])

    def part_norms(self, a: np.ndarray) -> np.ndarray:
        return np.stack([norms(a[:, m * self.width : (m + 1) * self.width]) for m in range(len(self.words))], axis=1)


def norms(v: np.ndarray) -> np.ndarray:
    """Euclidean norms, never too small."""
    return np.ceil(np.sqrt((v * v).sum(axis=1)) * (1 + 1e-12))


def quantised(vectors: list, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """``floor(scale * x)`` and which rows have a norm below 2^31."""
    x = np.floor(np.stack(vectors).astype(np.float64) * scale)
    with np.errstate(over="ignore"):
        return x, (x * x).sum(axis=1) < float(1 << 62)


def fit(rows: DataFrame, scale: int, parts: int, codes: int, sample: int, rounds: int = 6, seed: int = 11) -> Quantiser | None:
    """Codewords by k-means in each part, on at most ``sample`` rows in hash order."""
    taken = rows.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(sample).collect()
    x, fits = quantised([r["embedding"] for r in taken], scale) if taken else (np.empty((0, 0)), np.empty(0, bool))
    x = x[fits]
    if not len(x):
        return None
    rng, width = np.random.default_rng(seed), x.shape[1] // parts
    k, words = min(codes, len(x)), []
    for m in range(parts):
        v = x[:, m * width : (m + 1) * width]
        w = v[rng.choice(len(v), k, replace=False)]
        for _ in range(rounds):
            own = ((w * w).sum(1) - 2 * (v @ w.T)).argmin(1)
            n = np.bincount(own, minlength=k)
            total = np.stack([np.bincount(own, v[:, i], minlength=k) for i in range(width)], axis=1)
            w = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], w)
        words.append(np.rint(w))
    return Quantiser(np.stack(words))


def index(rows: DataFrame, by: Quantiser, scale: int) -> DataFrame:
    """The table at rest: ``row, vec_id, label, codes, norms, vector``."""
    sent = rows.sparkSession.sparkContext.broadcast(by)
    names = ["row", "vec_id", "label", "codes", "norms", "vector"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                x, fits = quantised(b.column(3).to_numpy(zero_copy_only=False).tolist(), scale)
                b, x = b.filter(pa.array(fits)), x[fits]
                codes, left = sent.value.codes(x)
                packed = [pa.array([bytes(r) for r in m], pa.binary()) for m in (codes, left.astype(np.float64), x.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *packed], names=names)

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    return stage(numbered.mapInArrow(run, "row long, vec_id long, label long, codes binary, norms binary, vector binary"), "pq-index")


def best(key: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` of each key by score downward, then identity."""
    order = np.lexsort((ident, -score, key))
    sorted_key = key[order]
    first = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]]) if len(order) else np.empty(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[rank < k]


class Best:
    """The first ``k`` rows of each key so far."""

    def __init__(self, keys: int, k: int) -> None:
        self.k, self.keys = k, keys
        self.key, self.score, self.ident = (np.empty(0, np.int64) for _ in range(3))
        self.least = np.full(keys, LOWEST)  # the score a further row needs

    def add(self, key: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ident = (np.concatenate(p) for p in ((self.key, key), (self.score, score), (self.ident, ident)))
        kept = best(key, score, ident, self.k)
        self.key, self.score, self.ident = key[kept], score[kept], ident[kept]
        full = np.bincount(self.key, minlength=self.keys) >= self.k
        self.least[:] = LOWEST
        lowest = np.full(self.keys, 1 << 62)
        np.minimum.at(lowest, self.key, self.score)
        self.least[full] = lowest[full]


def _unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    n = b.num_rows
    codes, left, x = (np.frombuffer(b"".join(b.column(i).to_pylist()), t).reshape(n, -1) for i, t in ((3, np.uint8), (4, np.float64), (5, np.int32)))
    return b.column(1).to_numpy(), b.column(2).to_numpy(), codes, left, x


class Block:
    """Anchors with their tables, for estimates with bounds and for exact scores."""

    def __init__(self, by: Quantiser, vectors: np.ndarray) -> None:
        self.whole, self.a = vectors, vectors.astype(np.float64)
        self.tables, self.norms = by.tables(self.a), by.part_norms(self.a)
        self.most = float(norms(self.a).max(initial=0))

    def fits(self, x: np.ndarray) -> bool:
        """All products and their sums are exact as doubles."""
        return self.most * float(norms(x.astype(np.float64)).max(initial=0)) * 4 < EXACT

    def bounds(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        estimate = np.zeros((len(self.a), len(codes)))
        for m, t in enumerate(self.tables):
            estimate += t[:, codes[:, m]]
        return estimate, self.norms @ left.T

    def scores(self, x: np.ndarray, at: np.ndarray, of: np.ndarray, exact: bool) -> np.ndarray:
        """Exact scores of pairs; as one product where they are a good part of all."""
        if 8 * len(at) > len(self.a) * len(x):
            s = self.a @ x.astype(np.float64).T if exact else self.whole.astype(np.int64) @ x.astype(np.int64).T
            return s[at, of].astype(np.int64)
        out = np.empty(len(at), np.int64)
        for i in range(0, len(at), 1 << 16):
            p, q = at[i : i + (1 << 16)], of[i : i + (1 << 16)]
            out[i : i + len(p)] = np.einsum("ij,ij->i", self.whole[p].astype(np.int64), x[q].astype(np.int64))
        return out


def _chunks(n: int) -> list[slice]:
    return [slice(i, min(n, i + ANCHORS)) for i in range(0, n, ANCHORS)]


def _rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for b in it:
        for at in range(0, b.num_rows, ROWS):
            yield _unpacked(b.slice(at, ROWS))


def positives_of(table: DataFrame, by: Quantiser, anchors: np.recarray, k: int) -> DataFrame:
    """``anchor_row, id, score``: each task's first ``k`` rows of the anchor's label under another id."""
    sent = table.sparkSession.sparkContext.broadcast((by, anchors))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, anchors = sent.value
        top = Best(len(anchors), k)
        groups = []
        for label in np.unique(anchors.label):
            mine = np.flatnonzero(anchors.label == label)
            groups += [(label, mine[c], Block(by, anchors.vector[mine[c]])) for c in _chunks(len(mine))]
        for ids, labels, codes, left, x in _rows(it):
            for label, mine, block in groups:
                here = np.flatnonzero(labels == label)
                if not len(here):
                    continue
                other = anchors.vec_id[mine][:, None] != ids[here][None, :]
                exact = block.fits(x[here])
                keep = other
                if exact:
                    estimate, bound = block.bounds(codes[here], left[here])
                    need = top.least[mine].astype(np.float64)
                    if len(here) > k:  # so many rows score at least the k-th greatest lower bound
                        low = np.where(other, estimate - bound, -np.inf)
                        need = np.maximum(need, np.partition(low, len(here) - k, axis=1)[:, len(here) - k])
                    keep = other & (estimate + bound >= need[:, None])
                at, of = np.nonzero(keep)
                score = block.scores(x[here], at, of, exact)
                good = score >= top.least[mine][at]
                top.add(mine[at[good]], score[good], ids[here][of[good]])
        yield pa.RecordBatch.from_arrays([pa.array(anchors.row[top.key]), pa.array(top.ident), pa.array(top.score)], names=["anchor_row", "id", "score"])

    return table.mapInArrow(run, "anchor_row long, id long, score long")


def negatives_of(table: DataFrame, by: Quantiser, anchors: np.recarray, low: np.ndarray, high: np.ndarray, k: int) -> DataFrame:
    """``anchor_row, slot, id, score``: each task's first ``k`` rows of another label in each window ``low..high`` of an anchor."""
    sent = table.sparkSession.sparkContext.broadcast((by, anchors, low, high))
    slots = low.shape[1]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, anchors, low, high = sent.value
        top = Best(len(anchors) * slots, k)
        blocks = [(c, Block(by, anchors.vector[c])) for c in _chunks(len(anchors))]
        for ids, labels, codes, left, x in _rows(it):
            for c, block in blocks:
                lows, highs = low[c], high[c]
                need = np.maximum(lows, top.least.reshape(-1, slots)[c])
                keep = anchors.label[c][:, None] != labels[None, :]
                exact = block.fits(x)
                if exact:
                    open_ = need <= highs
                    estimate, bound = block.bounds(codes, left)
                    keep &= estimate + bound >= np.where(open_, need, 1 << 62).min(axis=1)[:, None]
                    keep &= estimate - bound <= np.where(open_, highs, LOWEST).max(axis=1)[:, None]
                at, of = np.nonzero(keep)
                score = block.scores(x, at, of, exact)
                key, values, names = [], [], []
                for s in range(slots):
                    good = (score >= need[at, s]) & (score <= highs[at, s])
                    key.append((at[good] + c.start) * slots + s)
                    values.append(score[good])
                    names.append(ids[of[good]])
                top.add(np.concatenate(key), np.concatenate(values), np.concatenate(names))
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchors.row[top.key // slots]), pa.array((top.key % slots).astype(np.int32)), pa.array(top.ident), pa.array(top.score)], names=["anchor_row", "slot", "id", "score"]
        )

    return table.mapInArrow(run, "anchor_row long, slot int, id long, score long")


def mine(
    vectors: DataFrame, anchors_of: str = "vec_id % 50 = 0", relabel: str = "if(vec_id % 7 = 0, (label + 1) % 10, label)", positives: int = 5, negatives: int = 3,
    share: tuple[int, int, int] = (50, 95, 100), dim: int = 64, scale: int = 256, parts: int = 16, codes: int = 256, sample: int = 4096, block: int = 32_768,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors_of`` picks the anchors and ``relabel`` sets the label, both SQL over ``vec_id`` and ``label``. A negative of a
    positive scores ``share[0]`` to ``share[1]`` parts in ``share[2]`` of the positive's score.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = vectors.select(F.col("vec_id"), F.col("label").alias("label"), "embedding").where(usable(dim) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.withColumn("label", F.expr(relabel))
    by = fit(rows, scale, parts, codes, sample)
    if by is None:
        return spark.createDataFrame([], schema)
    table = index(rows, by, scale)
    chosen = table.where(anchors_of)
    blocks = max(1, -(-chosen.count() // block))
    out = None
    for i in range(blocks):
        own = chosen.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == i).select("row", "vec_id", "label", "vector").collect()  # about `block` rows
        if not own:
            continue
        kind = np.dtype([("row", np.int64), ("vec_id", np.int64), ("label", np.int64), ("vector", np.int32, (dim,))])
        anchors = np.array([(r["row"], r["vec_id"], r["label"], np.frombuffer(r["vector"], np.int32)) for r in own], kind).view(np.recarray)
        order = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "id")
        found = stage(positives_of(table, by, anchors, positives).withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < positives), "pq-positives")
        low, high = np.full((len(anchors), positives), 1 << 62), np.full((len(anchors), positives), LOWEST)  # empty windows
        place = {r: j for j, r in enumerate(anchors.row.tolist())}
        for r in found.select("anchor_row", "slot", "score").collect():  # `positives` rows an anchor of the block
            p = int(r["score"])
            low[place[r["anchor_row"]], r["slot"]] = -(-share[0] * p // share[2])
            high[place[r["anchor_row"]], r["slot"]] = share[1] * p // share[2]
        order = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), "id")
        part = negatives_of(table, by, anchors, low, high, negatives).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        part = part.select("anchor_row", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        paired = found.select("anchor_row", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        part = stage(part.join(paired, ["anchor_row", "slot"]), "pq-negatives")
        unstage(found)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    names = chosen.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    return out.join(names, "anchor_row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
