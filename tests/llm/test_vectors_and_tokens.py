"""Centroid clustering, hard negatives and byte-level BPE against brute force and the public library."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from verisift.llm import bpe, clusters, negatives

BY = bpe.coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=BY.ranks, special_tokens={})


def vectors(spark, rows, extra=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int" + extra)


# 11


def lloyd(rows, k, rounds, dim, scale):
    """Brute force in Python integers, in the order of the rows given."""
    kept = [(i, tuple(math.floor(x * scale) if abs(x) < 2**52 else int(x) * scale for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [list(v) for _, v in first]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    own = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        lists = [[v for _, v in kept if own(v) == j] for j in range(len(c))]
        c = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c[j] for j, m in enumerate(lists)]
    out = [(i, own(v), far(v, c[own(v)])) for i, v in kept]
    return out, c


CASES = {
    "plain": lambda r: [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)],
    "ties": lambda r: [(i, [float(r.choice([0, 1])) for _ in range(4)]) for i in range(40)],
    "repeated": lambda r: [(i // 3, [float(i // 3), 0.5, -0.25, 1.0]) for i in range(30)] + [(None, [1.0, 2.0, 3.0, 4.0])] * 2,
    "few": lambda r: [(1, [0.1, 0.2, 0.3, 0.4]), (2, [0.4, 0.3, 0.2, 0.1])],
    "huge": lambda r: [(i, [r.choice([1e15, -1e15, 3e30, 0.5]), r.gauss(0, 1e6), 1e5 * i, -0.001]) for i in range(30)],
    "odd": lambda r: [(1, None), (2, [1.0, 2.0]), (3, [1.0, None, 2.0, 3.0]), (4, [math.nan, 0.0, 0.0, 0.0]), (5, [math.inf, 0.0, 0.0, 0.0]), (6, []), (7, [1.0, 1.0, 1.0, 1.0]), (8, [-1.0] * 4), (9, [0.0] * 5)],
}


@pytest.mark.parametrize("case", CASES)
def test_clusters_equal_brute_force(spark, case):
    rows = CASES[case](random.Random(3))
    want, c = lloyd(rows, 5, 6, 4, 1024)
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, inertia int")
    got = clusters.clustering(table.repartition(3), 5, 6, 4).collect()
    cut = lambda n: min(n, 2**63 - 1)
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(((i, j, cut(d)) for i, j, d in want), key=key)
    for r in got:
        assert r.cluster_inertia == cut(sum(cut(d) for _, j, d in want if j == r.cluster)) and r.inertia == cut(sum(cut(d) for _, _, d in want))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()


def test_clusters_of_nothing_and_string_ids(spark):
    assert clusters.clustering(vectors(spark, []), dim=4).collect() == []
    got = clusters.clustering(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [5.0, 6.0])], "vec_id string, embedding array<float>"), 1, 2, 2).collect()
    assert sorted((r.vec_id, r.cluster) for r in got) == [("a", 0), ("b", 0)]


# 12


def mined(rows, dim, scale=256):
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or len(v) != dim or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [math.floor(y * scale) for y in v]
        if sum(y * y for y in x) < 2**62:
            kept.append((i, x, (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, a, label in kept:
        if i % 50:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(a, x, strict=True)), j, other) for j, x, other in kept))
        for s, j, _ in [r for r in scored if r[2] == label and r[1] != i][:5]:
            fits = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out += [(i, j, n, m, -s, -t) for n, (t, m, _) in enumerate(fits, 1)]
    return sorted(out)


MINES = {
    "plain": lambda r: [(i, [r.gauss(0, 1) for _ in range(8)], r.randrange(4)) for i in range(1, 700)],
    "ties": lambda r: [(i, [float(r.choice([0, 0.25, 1])) for _ in range(8)], r.randrange(3)) for i in range(500)],
    "copies": lambda r: [(i, [0.3] * 8 if i % 2 else [r.gauss(0, 1) for _ in range(8)], r.randrange(3)) for i in range(400)],
    "repeated": lambda r: [(i // 2 * 25, [r.gauss(0.5, 1) for _ in range(8)], i % 3) for i in range(80)] * 2,
    "large": lambda r: [(i, [r.gauss(0, 1) * 2e5 for _ in range(8)], r.randrange(3)) for i in range(200)],
    "few": lambda r: [(0, [1.0] * 8, 1), (50, [1.0] * 8, 1), (3, [0.8] * 8, 2)],
    "negative": lambda r: [(i, [r.choice([-1.0, 1.0]) * 0.5 if j == i % 8 else 0.0 for j in range(8)], i % 2) for i in range(300)],
}


@pytest.mark.parametrize("case", MINES)
@pytest.mark.parametrize("block", [32_768, 3])
def test_mined_negatives_equal_brute_force(spark, case, block):
    rows = MINES[case](random.Random(4))
    odd = [(100, None, 1), (150, [1.0] * 7, 1), (200, [math.nan] * 8, 1), (250, [1.0] * 8, None), (None, [1.0] * 8, 1), (300, [1e12] * 8, 1), (350, [None] * 8, 1)]
    table = spark.createDataFrame([(*r, "z", 2) for r in rows + odd], "vec_id long, embedding array<double>, label int, row string, score int").repartition(3)
    got = negatives.mine(table, dim=8, parts=4, codes=16, sample=200, block=block)
    assert sorted(map(tuple, got.collect())) == mined(rows + odd, 8)


def test_bounds_hold_and_spare_rows():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(3000, 16)) * 256)
    by = negatives.Quantiser(np.stack([x[:64, i : i + 2] for i in range(0, 16, 2)]))
    codes, left = by.codes(x)
    block = negatives.Block(by, x[:20].astype(np.int32))
    estimate, bound = block.bounds(codes, left)
    assert (np.abs(x[:20] @ x.T - estimate) <= bound).all()
    near = np.sort(x[:20] @ x.T, axis=1)[:, -5]
    assert (estimate + bound >= near[:, None]).mean() < 0.25


def test_no_anchors_no_rows(spark):
    assert negatives.mine(vectors(spark, [])).collect() == []
    assert negatives.mine(vectors(spark, [(1, [1.0] * 64, 1), (2, [1.0] * 64, 2)])).collect() == []


# 13

BITS = ["a", "the ", " the", "'re", "'r", "e", "'", "''", " ", "  ", "\n", "\t", "日本", "é", "xxxxx", "1234", "12", "!!", "$ ", "don't", "🙂", "　", "'s", "'l", "l", " \n", "\x1c", "\x85"]


def ids(packed):
    return np.frombuffer(packed, np.int32).tolist()


@pytest.mark.parametrize(("span", "leaf"), [(4096, 64), (7, 4), (1, 1), (3, 2)])
def test_any_tree_gives_what_the_library_gives(monkeypatch, span, leaf):
    monkeypatch.setattr(bpe, "SPAN", span)
    monkeypatch.setattr(bpe, "LEAF", leaf)
    by, r = bpe.Coder(BY.ranks, BY.pattern), random.Random(span)
    for n in range(400):
        t = "".join(r.choice(BITS) for _ in range(r.randint(0, 40)))
        t = r.choice("a !1é日") * r.randint(0, 300) + t if n % 7 == 0 else t
        t = "".join(r.choice("abcde") for _ in range(r.randint(0, 700))) + t if n % 11 == 0 else t
        got = ids(by.encode(t))
        assert got == LIBRARY.encode_ordinary(t) and by.decode(np.array(got, np.int64)) == t.encode()


def test_windows_grow_until_they_fit():
    r = random.Random(5)
    for _ in range(300):
        a, b = ("".join(r.choice("aabcdt ") for _ in range(r.randint(0, 90))).encode() for _ in range(2))
        assert BY.join_tokens(BY._merged_long(a), BY._merged_long(b)) == BY._merged_long(a + b)
        assert BY.merged(a[:64]) == BY._merged_long(a[:64])


def test_long_runs_take_their_time_only():
    for t in ("a" * 300_000, " " * 300_001 + "x", "ab" * 150_000, "".join(random.Random(6).choice("abcdefgh") for _ in range(200_000))):
        got = np.frombuffer(BY.encode(t), np.int32)
        assert BY.decode(got) == t.encode()
        if not t.startswith(" "):  # the library's own stack ends on such runs
            assert got.tolist() == LIBRARY.encode_ordinary(t)


def test_tables(spark):
    r = random.Random(7)
    texts = [None, "", " ", "plain text", "plain text"] + ["".join(r.choice(BITS) for _ in range(r.randint(0, 400))) for _ in range(60)] + ["long " * 3000, "x" * 5000 + "'r" + "e" * 3000]
    rows = [(i // 2, t, "x", [1]) for i, t in enumerate(texts)] + [(None, "no id", "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, span string, ids array<int>")
    want = sorted((-1 if i is None else i, LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for i, t, _, _ in rows)
    for long_text in (1 << 20, 50):  # with 50, whole texts are cut into spans that are joined again
        got = bpe.decode(bpe.encode(docs.repartition(3), BY, long_text), BY).collect()
        assert sorted((-1 if x.doc_id is None else x.doc_id, list(x.ids), bytes(x.decoded)) for x in got) == want
    assert bpe.decode(bpe.encode(docs.limit(0), BY), BY).collect() == []
    named = docs.select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"), "text").where("doc_id = 'd2'")
    assert [x.doc_id for x in bpe.encode(named, BY, 3).collect()] == ["d2", "d2"]
