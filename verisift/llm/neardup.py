"""Near-duplicate removal by Order MinHash.

A document's k-mers of five words are labelled with their occurrence numbers.
Each of ``sketches`` hash functions takes the two smallest labelled k-mers
and keeps them in text order; the pair is a code. Texts with equal codes are
candidates, which makes the sketch sensitive to edits rather than to sets.
Candidates are verified by exact banded alignment of the words: similarity
is 1 - edits / words of the longer text, 0.8 or more.

Short texts have too few k-mers for that. A text of ``EXACT`` words or fewer
also gives all runs of as many words as the shortest of edits + 1 disjoint
pieces has; of those pieces one is intact in any similar text, so that similar
short texts always have such a run in common, wherever they are edited.

Copies (equal words, lower case) are one class from the start. In a first
round each member of a code's bucket is paired with the bucket's least class,
which joins most at linear cost. In a second round the buckets
whose members are still in several components, and those of short texts' runs,
are compared in full, block by block, between components, by length and by the
parities of their words; only pairs that these do not show to be too far apart
leave a block, which loses none. In the end no two components hold an unverified
pair with a common code. Components of the verified links are the classes.

Null texts and texts without words are never duplicates: each is a class of
its own. Texts of fewer than five words have one k-mer, all their words. Ties
go to the smallest document id, nulls first. Rows that repeat a document get
equal results. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, packed, release, same_doc, stage, unstage, wrapped
from .graph import components

K = 5
SKETCHES = 128
SIMILARITY = 0.8
#: Pairs of texts of at most so many words are all found.
EXACT = 50
#: Members of a bucket on each side of a block of pairs.
BLOCK = 4096
_C1, _C2, _C3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))
_SHIFT = np.uint64(32)


class WordHash(dict):
    """Word to 64-bit hash, remembered up to a bound."""

    def __missing__(self, w: str) -> int:
        h = xxhash.xxh64_intdigest(w)
        if len(self) < 1 << 18:
            self[w] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _C2
    return (x ^ (x >> _SHIFT)) * _C3


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    n = max(1, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(words))):
        out = out * _C1 + words[i : i + n]
    return _mix(out)


def labelled(kmer: np.ndarray) -> np.ndarray:
    """Keys of (k-mer, occurrence number)."""
    order = np.argsort(kmer, kind="stable")
    s = kmer[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return kmer
    first = np.concatenate(([True], ~same))
    at = np.arange(len(s))
    occ = np.empty(len(s), np.uint64)
    occ[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return np.where(occ > 0, _mix(kmer + occ * _C1), kmer)


def sketch(words: np.ndarray, odd: np.ndarray, salt: np.ndarray, step: int = 8192) -> np.ndarray:
    """One code for each multiplier in ``odd``."""
    kmer = kmers(words)
    key = labelled(kmer)
    m, top = len(odd), np.uint64(0xFFFFFFFFFFFFFFFF)
    rows = np.arange(m)
    values, places = np.full((m, 0), top), np.zeros((m, 0), np.int64)
    for at in range(0, len(key), step):
        v = odd[:, None] * key[None, at : at + step]
        for _ in range(2 if v.shape[1] > 1 else 1):
            i = v.argmin(axis=1)
            values = np.column_stack([values, v[rows, i]])
            places = np.column_stack([places, i + at])
            v[rows, i] = top
    two = np.argsort(values, axis=1, kind="stable")[:, :2]
    pair = np.sort(np.take_along_axis(places, two, axis=1), axis=1)
    return _mix(kmer[pair[:, 0]] * _C1 + kmer[pair[:, -1]] + salt)


def allowed(n: int, similarity: float) -> int:
    """Edits at which texts, the longer one of n words, are still similar."""
    return int((1 - similarity) * n + 1e-9)


def runs(words: np.ndarray, similarity: float, longest: int = EXACT) -> np.ndarray:
    """Codes of the word runs of which similar texts of at most ``longest`` words have one in common."""
    n = len(words)
    sizes = {m // (allowed(m, similarity) + 1) for m in range(n, longest + 1) if 0 < allowed(m, similarity) >= m - n}
    codes = [kmers(words, k) * _C1 + np.uint64(k) for k in sizes if k <= n]
    return np.unique(_mix(np.concatenate(codes))) if codes else np.zeros(0, np.uint64)


def parities(words: np.ndarray) -> np.ndarray:
    """Bits: parities of the numbers of words, labelled by occurrence, in hashed cells, 8 to 16 cells a word. An edit changes two at most."""
    cells = 512
    while cells < 8 * len(words):
        cells *= 2
    at = (_mix(labelled(words)) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=cells) & 1).astype(np.uint8), bitorder="little")


def not_apart(members: list[tuple], similarity: float, two_sides: bool, code: int) -> Iterator[tuple]:
    """``a, b, bits``: the members (hash, words, parities, codes, component, side) of different components (and sides)
    that may be similar by their numbers of words and by the bits in which their parities differ; each pair under the
    least code in common."""
    made = []
    for h, m, sig, codes, root, side in members:
        bits = int.from_bytes(sig, "little")
        half = len(sig) * 4
        made.append((m, h, root, side, len(sig), bits, (bits >> half) ^ (bits & ((1 << half) - 1)), frozenset(codes)))
    made.sort(key=lambda x: x[:2])
    for j, (m, h, root, side, size, bits, folded, codes) in enumerate(made):
        d = allowed(m, similarity)
        for i in range(j - 1, -1, -1):
            m2, h2, root2, side2, size2, bits2, _, codes2 = made[i]
            if m - m2 > d:
                break
            if root2 != root and (not two_sides or side2 != side):
                # The shorter text has as many cells or half of them; lengths that fit lie closer than that.
                apart = ((bits if size == size2 else folded) ^ bits2).bit_count()
                # Words of the longer text that the shorter one lacks: half of what differs and of what it has more.
                if apart + m - m2 <= 2 * d and min(codes & codes2) == code:
                    yield min(h, h2), max(h, h2), apart


def edits_within(a: list, b: list, d: int) -> int:
    """Edit distance of two sequences if it is at most ``d``, else d + 1.

    Bit-parallel over a band of 2 d + 1 diagonals that moves down with each
    column; the score is followed along the diagonal of the last cell.
    """
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    ea, eb = len(a), len(b)
    while ea > lo and eb > lo and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
    a, b = a[lo:ea], b[lo:eb]
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > d:
        return d + 1
    if not n:
        return m
    d = min(d, m)
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full, end = (1 << (2 * d + 1)) - 1, 1 << (d + m - n)
    vp, vn, score = ((1 << (d + 1)) - 1) << d, 0, m - n
    for j in range(n):
        x = at.get(b[j], 0)
        if x:
            x = (x >> (j - d) if j >= d else x << (d - j)) & full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        if not d0 & end:
            score += 1
            if score > d:
                return d + 1
        down = d0 >> 1
        vp = hn | (full & ~(down | hp))
        vn = down & hp
    return score


def similar(a: str, b: str, similarity: float) -> bool:
    x, y = a.lower().split(), b.lower().split()
    d = allowed(max(len(x), len(y)), similarity)
    return edits_within(x, y, d) <= d


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    sizes = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(parts)))


def sketched(docs: DataFrame, sketches: int, similarity: float, seed: int = 23) -> DataFrame:
    """``doc_id, th, h, codes, runs``: h hashes the words, null for texts without words."""
    rows = keyed(docs)
    kind = dict(rows.dtypes)["doc_id"]
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 63, sketches, np.uint64) * np.uint64(2) + np.uint64(1)
    salt = rng.integers(0, 1 << 63, sketches, np.uint64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = WordHash()
        for b in it:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                hs, codes, short = [], [], []
                for text in part.column(2).to_pylist():
                    words = text.lower().split()
                    if not words:
                        hs.append(None)
                        codes.append(np.zeros(0, np.int64))
                        short.append(np.zeros(0, np.int64))
                        continue
                    hs.append(xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63))
                    x = np.fromiter(map(word.__getitem__, words), np.uint64, len(words))
                    codes.append(sketch(x, odd, salt).view(np.int64))
                    short.append(runs(x, similarity).view(np.int64))
                columns = [pa.array(hs, pa.int64()), _lists(codes), _lists(short)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["doc_id", "th", "h", "codes", "runs"])

    return rows.mapInArrow(run, f"doc_id {kind}, th long, h long, codes array<long>, runs array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (``a, b``) whose texts are similar."""
    left = texts.select(F.col("h").alias("a"), F.col("z").alias("ta"))
    right = texts.select(F.col("h").alias("b"), F.col("z").alias("tb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in it:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ok = [similar(unpack(x).decode(), unpack(y).decode(), similarity) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _placed(rows: DataFrame, roots: DataFrame, h: str, root: str) -> DataFrame:
    """``rows`` with the component of ``h``; classes without links are their own."""
    known = roots.select(F.col("node").alias(h), F.col("root").alias("_root"))
    return rows.join(known, h, "left").withColumn(root, F.coalesce("_root", h)).drop("_root")


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose two classes are not in one component."""
    return _placed(_placed(pairs, roots, "a", "ra"), roots, "b", "rb").where("ra <> rb").drop("ra", "rb")


def _measured(texts: DataFrame) -> DataFrame:
    """``h, m, sig``: number of words and their parities."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, unpack = WordHash(), zstandard.ZstdDecompressor().decompress
        for b in it:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ms, sigs = [], []
                for z in part.column(1).to_pylist():
                    words = unpack(z).decode().lower().split()
                    ms.append(len(words))
                    sigs.append(parities(np.fromiter(map(word.__getitem__, words), np.uint64, len(words))).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ms, pa.int32()), pa.array(sigs, pa.binary())], names=["h", "m", "sig"])

    return texts.select("h", "z").mapInArrow(run, "h long, m int, sig binary")


def _open_pairs(members: DataFrame, texts: DataFrame, roots: DataFrame, similarity: float, block: int) -> DataFrame:
    """``a, b, apart``: the pairs of different components with a common code that can be similar.

    Codes with equal members count once. A bucket of more than ``block``
    members is cut into blocks; each pair of blocks is a group of its own, and
    only pairs that pass the filters leave it.
    """
    placed = stage(_placed(members, roots, "h", "root"), "omh-placed")
    one, two = F.xxhash64("h"), F.xxhash64(F.lit(1), "h")
    several = placed.groupBy("code").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("k"), F.bit_xor(one).alias("x1"), F.bit_xor(two).alias("x2"))
    several = several.where("lo <> hi").groupBy("k", "x1", "x2").agg(F.min("code").alias("code"))
    several = stage(several.select("code", F.ceil(F.col("k") / block).cast("int").alias("blocks")), "omh-open")
    rows = stage(placed.join(several, "code").groupBy("h", "root").agg(F.collect_list(F.struct("code", "blocks")).alias("open")), "omh-open-members")
    sizes = stage(_measured(texts.join(rows.select("h"), "h")), "omh-sizes")
    rows = rows.join(sizes, "h").select("h", "m", "sig", "root", F.col("open.code").alias("codes"), F.explode("open").alias("o")).select("*", "o.code", "o.blocks")
    rows = rows.withColumn("x", F.pmod(F.xxhash64("h", "code"), "blocks").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.withColumn("i", F.least("x", "other")).withColumn("j", F.greatest("x", "other"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group may go over batches."""
        key, held, ready = None, [], []

        def out() -> pa.RecordBatch:
            cols = [pa.array(c, pa.int64()) for c in zip(*ready, strict=True)] or [pa.array([], pa.int64())] * 3
            ready.clear()
            return pa.RecordBatch.from_arrays(cols, names=["a", "b", "apart"])

        def settle() -> Iterator[pa.RecordBatch]:
            if key:
                for pair in not_apart(held, similarity, key[1] != key[2], key[0]):
                    ready.append(pair)
                    if len(ready) >= 4096:
                        yield out()
            held.clear()

        for b in it:
            for code, i, j, *member in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (code, i, j):
                    yield from settle()
                    key = code, i, j
                held.append(member)
        yield from settle()
        yield out()

    ordered = rows.select("code", "i", "j", "h", "m", "sig", "codes", "root", "x").repartition("code", "i", "j").sortWithinPartitions("code", "i", "j")
    return ordered.mapInArrow(run, "a long, b long, apart long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, sketches: int = SKETCHES, block: int = BLOCK) -> DataFrame:
    """``doc_id, th, class_id`` (smallest document id of the class), ``n_docs`` in it and ``kept``."""
    spark = docs.sparkSession
    rows = stage(sketched(docs, sketches, similarity), "omh-sketches")
    codes = rows.where("h is not null").select("h", F.explode("codes").alias("code"))
    buckets = stage(codes.groupBy("code").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi"), "omh-buckets")
    members = stage(codes.join(buckets, "code"), "omh-members")
    stars = members.select(F.col("lo").alias("a"), F.col("h").alias("b")).where("a <> b")
    pairs = stage(stars.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "omh-pairs")
    unstage(buckets)
    release(spark)

    # The texts of candidate classes, one document each.
    short = stage(rows.where("h is not null").select("h", F.explode("runs").alias("code")).distinct(), "omh-runs")
    met = stage(short.groupBy("code").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("code"), "omh-runs-met")
    some = members.select("code", "h").unionByName(short.join(met, "code").select("code", "h")).distinct()
    wanted = some.select("h").distinct()
    firsts = rows.where("h is not null").groupBy("h").agg(F.min(F.struct("doc_id", "th")).alias("d"))
    firsts = stage(firsts.join(wanted, "h").select("h", F.col("d.doc_id").alias("doc_id"), F.col("d.th").alias("th")), "omh-firsts")
    source = packed(keyed(docs))
    texts = stage(source.join(firsts, same_doc(source, firsts)).groupBy(firsts["h"]).agg(F.first("z").alias("z")), "omh-texts")
    release(spark)

    # First each class's best partner; then only what these links have not joined yet.
    best = pairs.groupBy("b").agg(F.max(F.struct("n", F.col("a"))).alias("x")).select(F.col("x.a").alias("a"), "b")
    links = stage(_verified(best, texts, similarity), "omh-links1")
    roots = stage(components(links), "omh-roots1")
    rest = _between(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), roots)
    links = links.unionByName(stage(_verified(rest, texts, similarity), "omh-links2"))
    roots = stage(components(links), "omh-roots2")

    # Then all pairs of the buckets that still hold several components, less those already tried, again the closest first.
    more = _open_pairs(some, texts, roots, similarity, block)
    more = stage(more.join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "omh-pairs3")
    ends = more.select(F.explode(F.array(F.struct(F.col("a").alias("h"), F.col("b").alias("o")), F.struct(F.col("b").alias("h"), F.col("a").alias("o")))).alias("e"), "apart")
    best = ends.groupBy("e.h").agg(F.min(F.struct("apart", "e.o")).alias("x")).select(F.least("h", "x.o").alias("a"), F.greatest("h", "x.o").alias("b")).distinct()
    best = stage(best, "omh-best3")
    links = links.unionByName(stage(_verified(best, texts, similarity), "omh-links3"))
    roots = stage(components(links), "omh-roots3")
    rest = _between(more.select("a", "b").join(best, ["a", "b"], "left_anti"), roots)
    links = links.unionByName(stage(_verified(rest, texts, similarity), "omh-links4"))
    roots = stage(components(links), "omh-roots4")

    named = rows.select("doc_id", "th", "h").join(roots.select(F.col("node").alias("h"), "root"), "h", "left")
    # Texts without words: the document is its own class.
    named = named.select("doc_id", "th", F.when(F.col("h").isNull(), F.xxhash64("doc_id", "th")).otherwise(F.coalesce("root", "h")).alias("root"), F.col("h").isNull().alias("bare"))
    named = stage(named, "omh-named")
    # Written, so that the join has plain shuffles on both sides and a large class can be split.
    firsts = stage(named.groupBy("root", "bare").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.count(F.lit(1)).alias("n_docs")), "omh-firsts")
    out = named.join(firsts, ["root", "bare"])
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    return out.select("doc_id", "th", F.col("first.doc_id").alias("class_id"), "n_docs", kept.alias("kept"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """Rows and columns of ``docs`` without later members of near-duplicate classes."""
    gone = near_duplicates(docs, **options).where("not kept").select("doc_id", "th").distinct()
    rows = wrapped(docs)
    return rows.join(gone, same_doc(rows, gone), "left_anti").select("row.*")
