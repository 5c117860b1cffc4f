"""Quality classifier: weak labels by expectation-maximisation, then a hashed linear scorer.

Overlapping heuristic labellers vote bad (0) or good (1), or abstain (-1). Their
accuracies are estimated by EM on the counts
of vote patterns over all documents (at most 2^labellers rows, whatever the
corpus). The posteriors of a bounded sample of documents are the soft targets
of a logistic scorer over hashed words and binned statistics, which then
scores every whole text.

Null and empty texts: only the labeller of short texts votes, features are
the bins alone. Ties and repeated rows get equal scores; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed
from .stats import RATIOS, measure, one_text_each, words_of

LABELLERS = ("short", "symbols", "repeats", "dup_lines", "top_word", "upper", "word_len", "lexicon", "plain", "spread")
SALT = 1 << 20


def votes(text: str, lexicon: frozenset[str]) -> tuple[tuple[int, ...], list[float], int]:
    """Eight labellers vote bad or abstain, two vote good or abstain; also the ratios and the number of words."""
    raw, ratio = measure(text, lexicon)
    s = dict(zip(RATIOS, ratio, strict=True))
    n = raw[0]
    bad = [n < 50]
    if n:
        bad += [
            s["symbol_ratio"] > 0.05, s["repeat_ratio"] > 0.5, s["dup_line_ratio"] > 0.3, s["top_word_ratio"] > 0.3,
            s["upper_ratio"] > 0.3, not 2 <= s["mean_word_len"] <= 12, s["lexicon_hits"] >= 1,
        ]
    bad += [False] * (8 - len(bad))
    plain = n >= 50 and s["symbol_ratio"] < 0.02 and s["repeat_ratio"] < 0.3 and s["upper_ratio"] < 0.2 and not s["lexicon_hits"]
    spread = n >= 50 and s["top_word_ratio"] < 0.15 and 3 <= s["mean_word_len"] <= 9
    return (*(0 if x else -1 for x in bad), 1 if plain else -1, 1 if spread else -1), ratio, n


def fit_labels(patterns: dict[tuple[int, ...], int], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Posterior of good for each vote pattern, by EM on Dawid and Skene's model.

    Each labeller has its own vote probabilities in either class, so one that
    votes good on bad texts too counts for little. EM starts from the labels
    that any vote for bad is right and that all else is good.
    """
    if not patterns:
        return {}
    v = np.array(list(patterns), int)
    n = np.array(list(patterns.values()), float)
    post = np.where((v == 0).any(1), 0.05, 0.95)
    for _ in range(rounds):
        prior = float(np.clip((post * n).sum() / n.sum(), 0.05, 0.95))
        log = np.stack([np.full(len(v), np.log(1 - prior)), np.full(len(v), np.log(prior))])
        for j in range(v.shape[1]):
            for c, w in ((0, (1 - post) * n), (1, post * n)):
                table = np.array([w[v[:, j] == k].sum() for k in (-1, 0, 1)]) + 0.5
                log[c] += np.log(table / table.sum())[v[:, j] + 1]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - post).max() < 1e-7:
            break
        post = new
    return {tuple(int(k) for k in row): float(p) for row, p in zip(v, post, strict=True)}


class Hasher(dict):
    """Word to bucket, remembered up to a bound."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        b = xxhash.xxh32_intdigest(word) % self.buckets
        if len(self) < SALT:
            self[word] = b
        return b


def features(text: str, ratio: list[float], n: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: the text's distinct lower-case words, scaled to unit length, and its binned statistics, a half each."""
    words = set(words_of(text.lower()))
    found = {hasher[w.strip(b".,;:!?#*$%&|<>\"'()")] for w in words}
    bins = {hasher[b"\x00%d:%d" % (j, min(40, int(r * 20) if j < 7 else 0))] for j, r in enumerate(ratio)} | {hasher[b"\x00n:%d" % min(20, n.bit_length())]}
    index = np.fromiter((*found, *bins), np.int64)
    return index, np.repeat([1 / np.sqrt(max(1, len(found))), 0.5], [len(found), len(bins)])


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, buckets: int, epochs: int = 30, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows (buckets, values), by AdaGrad over full sweeps of mini-batches."""
    w, b, seen, seen_b = np.zeros(buckets), 0.0, np.full(buckets, 1e-8), 1e-8
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 64)):
            if not len(part):
                continue
            idx, scale = (np.concatenate([rows[i][k] for i in part]) for k in (0, 1))
            sizes = np.array([len(rows[i][0]) for i in part])
            owner = np.repeat(np.arange(len(part)), sizes)
            z = np.bincount(owner, w[idx] * scale, len(part)) + b
            g = 1 / (1 + np.exp(-z)) - target[part]
            grad = np.bincount(idx, g[owner] * scale, buckets) / len(part) + decay * w
            seen += grad * grad
            w -= rate * grad / np.sqrt(seen)
            gb = g.mean()
            seen_b += gb * gb
            b -= rate * gb / np.sqrt(seen_b)
    return w, b


def count_patterns(docs: DataFrame, lexicon: list[str]) -> dict[tuple[int, ...], int]:
    words = frozenset(lexicon)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for b in it:
            for i in range(b.num_rows):
                k = ",".join(map(str, votes(b.column(0)[i].as_py() or "", words)[0]))
                counts[k] = counts.get(k, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "n"])

    rows = docs.select("text").mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # 2^10 at most
    return {tuple(map(int, r["pattern"].split(","))): r["n"] for r in sorted(rows, key=lambda r: r["pattern"])}


def classify(docs: DataFrame, lexicon: list[str], n_sample: int = 4000, buckets: int = 1 << 16, threshold: float = 0.5) -> DataFrame:
    """``doc_id, th, weak_label`` (posterior of good), ``score`` (the scorer's probability of good) and ``kept``.

    ``n_sample`` documents, in hash order of their ids, bound the scorer's training set.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    words = frozenset(lexicon)
    posterior = fit_labels(count_patterns(docs, lexicon))
    ids = docs.select(F.col("doc_id").alias("_i")).where("_i is not null").distinct().orderBy(F.xxhash64("_i", F.lit(5)), "_i").limit(n_sample)
    sample = one_text_each(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("_i"), "left_semi"))

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(buckets)
        for b in it:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                fs, xs, ps = [], [], []
                for t in part.column(1).to_pylist():
                    v, ratio, n = votes(t, words)
                    index, value = features(t, ratio, n, hasher)
                    fs.append(index)
                    xs.append(value)
                    ps.append(posterior.get(v, 0.5))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fs, pa.list_(pa.int64())), pa.array(xs, pa.list_(pa.float64())), pa.array(ps, pa.float64())], names=["id", "f", "x", "p"])

    got = sorted(sample.mapInArrow(encode, f"id {kind}, f array<long>, x array<double>, p double").collect(), key=lambda r: (r["id"], r["f"]))
    w, bias = train([(np.array(r["f"], np.int64), np.array(r["x"])) for r in got], np.array([r["p"] for r in got]), buckets) if got else (np.zeros(buckets), 0.0)
    model = spark.sparkContext.broadcast(w)  # buckets x 8 bytes

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, weight = Hasher(buckets), model.value
        for b in it:
            weak, good = [], []
            for i in range(b.num_rows):
                t = b.column(2)[i].as_py() or ""
                v, ratio, n = votes(t, words)
                index, value = features(t, ratio, n, hasher)
                weak.append(posterior.get(v, 0.5))
                good.append(1 / (1 + np.exp(-np.clip(weight[index] @ value + bias, -500, 500))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(weak, pa.float64()), pa.array(good, pa.float64())], names=["doc_id", "th", "weak_label", "score"])

    scored = keyed(docs).mapInArrow(score, f"doc_id {kind}, th long, weak_label double, score double")
    return scored.select("doc_id", "th", F.round("weak_label", 6).alias("weak_label"), F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("kept"))
