"""Removal of repeated byte strings of ``length`` or more, by longest-previous-factor matches in suffix order.

A byte goes if a string of ``length`` bytes that covers it starts elsewhere
too. Only suffixes that can matter are put in order:

1. Every window of ``length`` bytes has an anchor, the least k-gram hash in
   it (leftmost on ties). Equal windows have equal anchors at equal offsets,
   so only suffixes at anchors whose k-gram recurs are candidates.
2. Anchors with equal context (all windows they can be the anchor of) match
   as a whole; that is an aggregate on the contexts' hash.
3. The other contexts of a k-gram form a group. The suffixes at its anchors
   are put in order, and so are the bytes before them, read backwards; common
   bytes of neighbours give the LCP intervals of every depth on both sides.
   Windows that begin o bytes before their anchors are equal if they lie in one
   interval of depth ``length`` - o to the right and in one of depth o to the
   left. The smallest position there is the previous or next smaller one in
   suffix order at which every other position has its longest previous factor.
   A context's result is the farthest bytes to the left and right that are
   covered; all of an anchor's windows overlap at its k-gram, so what lies
   between is too. In groups of up to ``DIRECT`` contexts the common bytes of
   each two are counted directly, which gives the same factors for less work.

A group of more than ``SPLIT`` contexts is split by content: the windows that
begin ``BLOCK`` bytes or less from each other share a core, and contexts can
only match in these windows if their cores are equal, so each core is a group
of its own. Groups beyond ``group_limit`` contexts are resolved by a distributed
aggregate over all their windows instead.

``keep_first`` keeps the first occurrence in the order of (document id,
text hash, position); otherwise all occurrences go.

Null and empty texts have no bytes; a text shorter than ``length`` is left
alone, texts of any length are hashed in pieces; rows that repeat a document
are copies of each other like any others; only the id and the text are read, so
other columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, packed, release, same_doc, stage, unstage

LENGTH = 200
GRAM = 32
#: Contexts of a group that are compared directly; of one that is not split; bytes between the windows of a part.
DIRECT = 12
SPLIT = 1024
BLOCK = 24
#: Contexts of groups that are put in suffix order together.
TOGETHER = 1 << 12
_TABLE = np.random.default_rng(41).integers(1, 1 << 63, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_LOW = np.uint64((1 << 24) - 1)


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams (k a power of two), by doubling."""
    h, base, size = _TABLE[b], _BASE, 1
    while size < k:
        h = h[:-size] * np.uint64(base) + h[size:]
        base, size = base * base & _M64, size * 2
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(33)
    return h


def anchors(b: np.ndarray, length: int = LENGTH, k: int = GRAM, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all windows of ``b``, and their k-gram hashes."""
    at, hashes = [], []
    w = length - k + 1
    for c in range(0, len(b) - length + 1, step):
        h = gram_hashes(b[c : c + step + length - 1], k)
        least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < w:
            least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
        new = np.concatenate(([True], least[1:] != least[:-1]))
        pos = (least[new] & _LOW).astype(np.int64)
        at.append(pos + c)
        hashes.append(h[pos])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pos, h = np.concatenate(at), np.concatenate(hashes)
    pos, first = np.unique(pos, return_index=True)
    return pos, h[first]


def context(n: int, pos: int, length: int, k: int) -> tuple[int, int]:
    """Bounds of all windows that may have their anchor at ``pos``."""
    return max(0, pos - (length - k)), min(n, pos + length)


def _anchored(docs: DataFrame, length: int, k: int) -> DataFrame:
    rows = keyed(docs)
    kind = dict(rows.dtypes)["doc_id"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(2).cast(pa.binary())
            owner, poss, hs, cxs = [], [], [], []
            held = 0

            def out():
                own = pa.array(np.repeat(owner, [len(p) for p in poss]) if owner else np.zeros(0, np.int64))
                cat = lambda xs, t: pa.array(np.concatenate(xs) if xs else np.zeros(0, t))
                return pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), cat(poss, np.int32), cat(hs, np.int64), cat(cxs, np.int64)], names=["doc_id", "th", "pos", "h", "cx"])

            for i in range(batch.num_rows):
                raw = memoryview(texts[i].as_buffer()) if texts[i].is_valid else b""
                n = len(raw)
                if n < length:
                    continue
                pos, h = anchors(np.frombuffer(raw, np.uint8), length, k)
                digest = xxhash.xxh3_64_intdigest
                cx = np.fromiter((digest(raw[max(0, p - length + k) : p + length], min(p, length - k) * 4096 + min(n - p, length)) for p in pos.tolist()), np.uint64, len(pos))
                owner.append(i)
                poss.append(pos.astype(np.int32))
                hs.append(h.view(np.int64))
                cxs.append(cx.view(np.int64))
                held += len(pos)
                if held > 50_000:
                    yield out()
                    owner, poss, hs, cxs, held = [], [], [], [], 0
            yield out()

    return rows.mapInArrow(run, f"doc_id {kind}, th long, pos int, h long, cx long")


def _common(x: tuple, y: tuple, length: int, k: int) -> tuple[int, int]:
    """Bytes that two contexts share to the left of the anchor and from it on."""
    reach = length - k
    d = x[2] ^ y[2]
    left = min(x[0], y[0], reach if not d else ((d & -d).bit_length() - 1) // 8)
    d = x[3] ^ y[3]
    right = min(x[1], y[1], length if not d else length - (d.bit_length() + 7) // 8)
    return left, right


def suffix_order(suffixes: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each suffix (of ``width`` bytes at most) in their order, and the common prefix of each place's suffix with the one before."""
    n = len(suffixes)
    size = np.array([len(s) for s in suffixes])
    flat = b"".join(s.ljust(width, b"\0") for s in suffixes)
    by_bytes = np.unique(np.frombuffer(flat, f"S{width}"), return_inverse=True)[1]
    order = np.lexsort((size, by_bytes))  # of suffixes that differ by zero bytes at the end, the shorter is first
    table = np.frombuffer(flat, np.uint8).reshape(n, width)[order]
    differ = table[1:] != table[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width)
    common = np.minimum(common, np.minimum(size[order][1:], size[order][:-1]))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return place, np.concatenate(([0], common))


def previous_factors(rows: list[tuple[int, bytes, int, bool]], length: int, k: int, keep_first: bool) -> list[tuple[int, int] | None]:
    """As ``match_group``, in suffix order: which windows have a factor of ``length`` bytes at an earlier (any other) position."""
    n = len(rows)
    before = np.array([r[0] for r in rows])
    after = np.array([len(r[1]) for r in rows]) - before
    at = np.array([r[2] for r in rows], np.int64)
    right, common_right = suffix_order([r[1][r[0] :] for r in rows], length)
    left, common_left = suffix_order([r[1][: r[0]][::-1] for r in rows], max(1, length - k))
    most, least = np.full(n, -1), np.full(n, -1)
    for o in range(length - k + 1):
        own = np.flatnonzero((before >= o) & (after >= length - o))
        if len(own) < 2:
            continue
        # The LCP intervals of these depths; equal pairs of intervals are equal windows.
        key = np.cumsum(common_right < length - o)[right[own]] * (n + 1) + np.cumsum(common_left < o)[left[own]]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        if keep_first:
            first = np.full(len(count), np.iinfo(np.int64).max)
            np.minimum.at(first, which, at[own])
            hit = own[at[own] > first[which]]
        else:
            hit = own[count[which] > 1]
        least[hit[least[hit] < 0]] = o
        most[hit] = o
    return [None if r[3] or a < 0 else (int(a), length - int(b)) for r, a, b in zip(rows, most, least, strict=True)]


def match_group(rows: list[tuple[int, bytes, int, bool]], length: int, k: int, keep_first: bool) -> list[tuple[int, int] | None]:
    """For each context (bytes left of the anchor, context, place of its anchor, whether only a partner): the
    bytes covered to the left of the anchor and from it on, or None."""
    n = len(rows)
    if n > DIRECT:
        return previous_factors(rows, length, k, keep_first)
    best: list[list[int] | None] = [None] * n
    made = []
    for left, ctx, _, _ in rows:
        right = ctx[left:]
        made.append((left, len(right), int.from_bytes(ctx[:left], "big"), int.from_bytes(right.ljust(length, b"\0"), "big")))
    for i in range(n):
        for j in range(i + 1, n):
            a, b = _common(made[i], made[j], length, k)
            if a + b >= length:
                for x, y in ((i, j), (j, i)):
                    if not keep_first or rows[y][2] < rows[x][2]:
                        if best[x] is None:
                            best[x] = [a, b]
                        else:
                            best[x] = [max(best[x][0], a), max(best[x][1], b)]
    return [None if r[3] or b is None else (b[0], b[1]) for r, b in zip(rows, best, strict=True)]


def parts(key: int, left: int, ctx: bytes, whole: bool, length: int, k: int) -> Iterator[tuple[int, int, bytes]]:
    """(key, bytes left of the anchor, context) of a context: itself, or where its group has to be split, its part for
    each block of windows, under the hash of the bytes that all of the block share."""
    if whole:
        yield key, left, ctx
        return
    for lo in range(0, length - k + 1, BLOCK + 1):
        hi = min(lo + BLOCK, length - k)
        if left >= lo and len(ctx) - left >= length - hi:
            core = xxhash.xxh3_64_intdigest(ctx[left - lo : left - hi + length], (key ^ lo) & _M64) - (1 << 63)
            begin = max(0, left - hi)
            yield core, left - begin, ctx[begin : left - lo + length]


def repeated(docs: DataFrame, length: int = LENGTH, k: int = GRAM, keep_first: bool = False, split_limit: int = SPLIT, group_limit: int = 100_000) -> DataFrame:
    """``doc_id, th, spans``: arrays of (start, end) in bytes, overlapping, that go. Documents without any are left out."""
    spark = docs.sparkSession
    reach = length - k
    kind = dict(docs.dtypes)["doc_id"]
    place = F.struct("doc_id", "th", "pos")
    all_rows = stage(_anchored(docs, length, k), "lpf-anchors")
    # Written, so that the join has plain shuffles on both sides and a hot k-gram's rows can be split.
    recurring = stage(all_rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "lpf-grams")
    rows = stage(all_rows.join(recurring, "h", "left_semi"), "lpf-recurring")
    unstage(all_rows)
    release(spark)

    # Equal contexts. ``mixed``: the k-gram has other contexts as well.
    classes = rows.groupBy("h", "cx").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("p0"))
    classes = stage(classes, "lpf-classes")
    sizes = stage(classes.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "lpf-sizes")
    copies = rows.join(classes.where("n > 1").select("h", "cx", "p0"), ["h", "cx"])
    if keep_first:
        copies = copies.where(place > F.col("p0"))
    whole = copies.groupBy("doc_id", "th").agg(F.collect_list(F.struct(F.greatest(F.col("pos") - reach, F.lit(0)).alias("s"), (F.col("pos") + length).alias("e"))).alias("spans"))
    whole = stage(whole, "lpf-whole")
    unstage(rows)
    release(spark)

    # Distinct contexts of one k-gram: fetch the bytes of one occurrence each.
    wanted = classes.join(sizes, "h").select("h", "cx", "n", "size", "p0.*")
    wanted = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "cx", "n", "pos", "size")).alias("want"))
    source = packed(keyed(docs))
    fetched = wanted.join(source, same_doc(wanted, source)).select(wanted["doc_id"], wanted["th"], "z", "want")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        names = ["key", "cx", "n", "size", "pos", "left", "ctx"]
        types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
        for batch in it:
            made, own = [], []

            def out():
                cols = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)] if made else [pa.array([], t) for t in types]
                at = pa.array(own, pa.int64())
                return pa.RecordBatch.from_arrays([*cols, batch.column(0).take(at), batch.column(1).take(at)], names=[*names, "doc_id", "th"])

            for i, (z, want) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                raw = unpack(z)
                for w in want:
                    h, cx, n, pos, size = w["h"], w["cx"], w["n"], w["pos"], w["size"]
                    s, e = context(len(raw), pos, length, k)
                    for key, left, ctx in parts(h, pos - s, raw[s:e], size <= split_limit or size > group_limit, length, k):
                        made.append((key, cx, n, size, pos, left, ctx))
                        own.append(i)
                if len(made) > 4096:
                    yield out()
                    made, own = [], []
            yield out()

    contexts = fetched.mapInArrow(cut, f"key long, cx long, n long, size long, pos int, left int, ctx binary, doc_id {kind}, th long")
    oversize = bool(sizes.where(F.col("size") > group_limit).take(1))
    if oversize:
        contexts = stage(contexts, "lpf-contexts")
    small = contexts.where(F.col("size") <= group_limit) if oversize else contexts

    spans = f"doc_id {kind}, th long, s int, e int"

    def groups(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, cx, n, left, ctx, doc_id, th, pos) come sorted by key; a group may go over batches. Large groups are put in order together."""
        held: list[tuple] = []
        waiting: list[tuple] = []
        ready: list[tuple] = []
        weight = 0

        def settle(rows: list[tuple]) -> None:
            if len(rows) > 1:
                # The place of an anchor: its document's number, in order, then the position.
                docs = {d: i for i, d in enumerate(sorted({(x[5] is not None, x[5] or 0, x[6]) for x in rows}))}
                found = match_group([(x[3], x[4], (docs[x[5] is not None, x[5] or 0, x[6]] << 40) + x[7], x[2] > 1 and not keep_first) for x in rows], length, k, keep_first)
                ready.extend((x[5], x[6], x[7] - f[0], x[7] + f[1]) for x, f in zip(rows, found, strict=True) if f)
            rows.clear()

        def group() -> int:
            """The group is matched now, or put aside; returns the contexts put aside."""
            if len(held) <= DIRECT:
                settle(held)
                return 0
            waiting.extend(held)
            added = len(held)
            held.clear()
            return added

        def out() -> pa.RecordBatch:
            cols = list(zip(*ready, strict=True)) or [[]] * 4
            made = pa.RecordBatch.from_arrays([pa.array(cols[0], doc_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["doc_id", "th", "s", "e"])
            ready.clear()
            return made

        doc_type = pa.int64()
        for batch in it:
            doc_type = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, 1024):
                for x in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                    if held and held[0][0] != x[0]:
                        weight += group()
                        if weight > TOGETHER:
                            settle(waiting)
                            weight = 0
                    if not held or held[-1][1] != x[1]:  # rows that repeat a document bring a context twice
                        held.append(x)
                if len(ready) > 4096:
                    yield out()
        group()
        settle(waiting)
        yield out()

    ordered = small.select("key", "cx", "n", "left", "ctx", "doc_id", "th", "pos").repartition("key").sortWithinPartitions("key", "cx")
    near = ordered.mapInArrow(groups, spans)
    near = near.groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    every = whole.unionByName(stage(near, "lpf-near"))
    if oversize:
        every = every.unionByName(_by_windows(contexts.where(F.col("size") > group_limit), length, reach, kind, keep_first))
    return every.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _by_windows(far: DataFrame, length: int, reach: int, kind: str, keep_first: bool) -> DataFrame:
    """The exact way for groups of any size: every window of every context, counted by an aggregate."""
    place = F.struct("doc_id", "th", "pos")

    def windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for x in batch.to_pylist():
                left, ctx = x["left"], x["ctx"]
                os = [o for o in range(min(left, reach) + 1) if len(ctx) - left >= length - o]
                ds = [xxhash.xxh3_128_digest(ctx[left - o : left - o + length]) for o in os]
                i = len(os)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["doc_id"]] * i, batch.schema.field("doc_id").type), pa.array([x["th"]] * i, pa.int64()), pa.array([x["pos"]] * i, pa.int32()), pa.array(os, pa.int32()), pa.array(ds, pa.binary()), pa.array([x["n"]] * i, pa.int64())],
                    names=["doc_id", "th", "pos", "o", "d", "n"],
                )

    each = far.mapInArrow(windows, f"doc_id {kind}, th long, pos int, o int, d binary, n long")
    shared = each.groupBy("d", "o").agg(F.min(place).alias("w0"), F.max(place).alias("w1")).where("w0 <> w1")
    hits = each.join(shared, ["d", "o"]).where(place > F.col("w0") if keep_first else F.col("n") == 1)
    ends = hits.groupBy("doc_id", "th", "pos").agg(F.max("o").alias("a"), F.min("o").alias("b"))
    return ends.groupBy("doc_id", "th").agg(F.collect_list(F.struct((F.col("pos") - F.col("a")).alias("s"), (F.col("pos") - F.col("b") + length).alias("e"))).alias("spans"))


def merged(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Maximal runs; runs that touch are one."""
    out: list[list[int]] = []
    for s, e in sorted((s, min(e, n)) for s, e in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _removed(docs: DataFrame, make, schema: str, **options) -> DataFrame:
    spans = repeated(docs, **options)
    release(docs.sparkSession)
    rows = packed(keyed(docs))
    joined = rows.join(spans, same_doc(rows, spans), "left").select(rows["doc_id"], rows["th"], rows["z"], F.col("spans.s").alias("s"), F.col("spans.e").alias("e"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = []
                for z, s, e in zip(*(part.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                    raw = unpack(z)
                    runs = merged(list(zip(s or (), e or (), strict=True)), len(raw))
                    last, kept = 0, []
                    for a, b in runs:
                        kept.append(raw[last:a])
                        last = b
                    made.append(make(raw, runs, b"".join([*kept, raw[last:]])))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c) for c in zip(*made, strict=True))], names=names) if made else empty(part)

    names = ["doc_id", "th", *[x.split()[0] for x in schema.split(", ")]]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def empty(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([], types[x.split()[1]]) for x in schema.split(", "))], names=names)

    return joined.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, th long, {schema}")


def removal_digest(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, th, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    return _removed(
        docs, lambda raw, runs, kept: (len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()),
        "n_bytes long, n_removed long, n_spans long, kept_sha256 string", **options,
    )


def without_repeats(docs: DataFrame, keep_first: bool = True, **options) -> DataFrame:
    """``doc_id, th, kept`` (bytes left, which a cut inside a character may leave invalid as UTF-8) and ``n_removed``."""
    return _removed(docs, lambda raw, runs, kept: (kept, len(raw) - len(kept)), "kept binary, n_removed long", keep_first=keep_first, **options)
