"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts and benchmark items are sequences of normalised words (lower case,
letters and digits). An item occurs in a document if some passage is within
``floor((1 - similarity) * n)`` word edits of its n words.

1. Item-sized windows are embedded by the random walk of Chakraborty,
   Goldenberg and Koucky: at step j the current word is output, and the pointer
   moves on by a bit that depends on (walk, j, word). Edit distance becomes
   Hamming distance. The walk over a window is begun anew every few words
   (``stride``), so that it needs ``STEPS`` steps from each start and all windows
   that hold a word, of every item size, share them: a text is embedded once,
   whatever sizes the items have.
2. Bit sampling: a code is the outputs of a walk at ``BITS`` sampled steps. It
   counts only where these outputs lie at ``DISTINCT`` places or more inside the
   window, so that neither padding nor a single frequent word makes windows
   meet. Repeated walks with repeated samples give the codes under which
   windows and items are looked up; their number is set for the target recall,
   which the tests measure for items of 5 to 200 words.
3. Whatever meets is verified by exact bit-parallel alignment.

Items of fewer than ``SHORT`` words are looked up by samples of two outputs,
and one-word items by the first output.

Items are handled in blocks of bounded bytes, so what is sent to executors
does not grow with the benchmark; documents are read once a block and never
shuffled. Texts of any length are embedded in stretches of bounded size. Null
or empty texts and items match nothing; repeated rows are reported each; equal
items (ties) are reported each; empty tables give no rows; columns of the
input other than the id and the text are not looked at.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, text_or_empty, whole_row

_WORD = re.compile(r"[^\W_]+")
STEPS, BITS, DISTINCT = 8, 4, 3
#: Walks, and samples of each.
WALKS, SAMPLES = 10, 2
#: Items of fewer words are looked up by samples of two outputs.
SHORT = 6
#: Words of a stretch that is embedded at once.
STRETCH = 1 << 16


def normal_words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def stride(n: int) -> int:
    """Every so many words of an item of n words a walk begins."""
    return 1 if n < 30 else 2 if n < 100 else 4


@dataclass
class Family:
    """Walks with samples of steps (walks x samples x bits) and the least number of places that a sample must hold."""

    keys: np.ndarray
    samples: np.ndarray
    distinct: int

    @staticmethod
    def drawn(seed: int, walks: int, samples: int, steps: int, bits: int, distinct: int) -> Family:
        rng = np.random.default_rng(seed)
        keys = rng.integers(0, 1 << 63, walks, np.uint64) * np.uint64(2) + np.uint64(1)
        # The first step is in each sample; the others are drawn.
        picks = [[[0, *sorted(1 + rng.choice(steps - 1, bits - 1, replace=False))] for _ in range(samples)] for _ in range(walks)]
        return Family(keys, np.array(picks, np.int64).reshape(walks, samples, bits), distinct)

    def codes(self, hashes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each walk and sample: the codes at ``starts``, whether they hold places enough, and the last place sampled.

        ``hashes`` of words go on for the steps of a walk beyond the last start.
        """
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        last = int(self.samples.max(initial=0))
        for r, key in enumerate(self.keys):
            moves = hashes * key
            moves ^= moves >> np.uint64(29)
            moves = ((moves * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8)
            at, places = starts, [starts]
            for j in range(last):
                at = at + ((moves[at] >> np.uint8(j)) & np.uint8(1))
                places.append(at)
            outputs: dict[int, np.ndarray] = {}
            for s, sample in enumerate(self.samples[r]):
                code, held, before = None, np.ones(len(starts), np.uint8), None
                for j in sample:
                    if j not in outputs:
                        outputs[j] = low[places[j]]
                    if before is None:
                        code = outputs[j] * np.uint32(0x9E3779B1)
                    else:
                        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B) + outputs[j]
                        held += places[j] != places[before]
                    before = j
                code ^= code >> np.uint32(16)
                code *= np.uint32((0xC2B2AE35 + 2 * (97 * r + s)) & 0xFFFFFFFF)
                yield code, held >= self.distinct, places[before]


LONG_FAMILY = Family.drawn(11, WALKS, SAMPLES, STEPS, BITS, DISTINCT)
SHORT_FAMILY = Family.drawn(13, WALKS, 1, 2, 2, 2)
WORD_FAMILY = Family(np.ones(1, np.uint64), np.zeros((1, 1, 1), np.int64), 1)


class Table:
    """The codes of items under one walk and sample, behind a bitmap."""

    def __init__(self, codes: np.ndarray, items: np.ndarray, offsets: np.ndarray) -> None:
        order = np.argsort(codes, kind="stable")
        self.codes, self.items, self.offsets = codes[order], items[order], offsets[order]
        bits = min(24, max(16, 4 + len(codes).bit_length()))
        self.shift = np.uint32(32 - bits)
        self.seen = np.zeros(1 << bits, np.bool_)
        self.seen[codes >> self.shift] = True

    def meet(self, codes: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index into ``codes``, item and offset of everything that meets."""
        at = np.flatnonzero(self.seen[codes >> self.shift] & fit)
        lo, hi = (np.searchsorted(self.codes, codes[at], side) for side in ("left", "right"))
        n = hi - lo
        rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.items[rows], self.offsets[rows]


def infix(peq: dict[str, int], m: int, words: list[str], free_start: bool = True) -> tuple[int, int]:
    """Least edits of the pattern against a passage of ``words`` and where that passage ends (first such end)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(words, 1):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ((ph << 1) | (0 if free_start else 1)) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


def peq_of(words: list[str]) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, w in enumerate(words):
        out[w] |= 1 << i
    return dict(out)


@dataclass
class Matcher:
    """One block of items, ready to look through texts."""

    items: list[tuple[int, list[str]]]
    similarity: float = 0.8
    cache: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.items = [(i, w) for i, w in self.items if w]
        self.peq = [peq_of(w) for _, w in self.items]
        self.back = [peq_of(w[::-1]) for _, w in self.items]
        self.edits = [int((1 - self.similarity) * len(w) + 1e-9) for _, w in self.items]
        self.ids: dict[str, int] = {}  # words of items; all others are one word, 0
        for _, w in self.items:
            for x in w:
                self.ids.setdefault(x, len(self.ids) + 1)
        #: Windows that begin within so many words of each other are verified together.
        self.grid = np.array([d + 1 for d in self.edits], np.int64)
        self.hashes = np.fromiter((0, *map(xxhash.xxh64_intdigest, self.ids)), np.uint64, len(self.ids) + 1)
        sizes = {"one": range(1, 2), "short": range(2, SHORT), "long": range(SHORT, 1 << 60)}
        families = {"one": WORD_FAMILY, "short": SHORT_FAMILY, "long": LONG_FAMILY}
        self.tables: list[tuple[Family, list[Table]]] = []
        for kind, family in families.items():
            ks = [k for k, (_, w) in enumerate(self.items) if len(w) in sizes[kind]]
            if ks:
                self.tables.append((family, self._index(family, ks)))

    def _index(self, family: Family, ks: list[int]) -> list[Table]:
        words, starts, ends, items, offsets = [], [], [], [], []
        at = 0
        for k in ks:
            w = self.items[k][1]
            words += [self.ids[x] for x in w] + [0] * STEPS
            here = range(0, len(w), stride(len(w)))
            starts += [at + o for o in here]
            offsets += here
            items += [k] * len(here)
            ends += [at + len(w)] * len(here)
            at += len(w) + STEPS
        starts, ends, items, offsets = (np.array(x, np.int64) for x in (starts, ends, items, offsets))
        out = []
        for codes, fit, last in family.codes(self.hashes[np.array(words)], starts):
            ok = fit & (last < ends)  # all sampled outputs are words of the item
            out.append(Table(codes[ok], items[ok], offsets[ok]))
        return out

    def candidates(self, ids: np.ndarray, begins: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, item, place of its first word to within the item's grid) of the windows that meet an item.

        ``ids`` holds the texts' words, which begin at ``begins``, each followed by a walk's length of strange words.
        """
        found: set[tuple[int, int, int]] = set()
        for begin in range(0, len(ids) - STEPS, STRETCH):
            part = ids[begin : begin + STRETCH + STEPS]
            starts = np.flatnonzero(part[: min(STRETCH, len(part) - STEPS)])
            hashes = self.hashes[part]
            for family, tables in self.tables:
                for table, (codes, fit, _) in zip(tables, family.codes(hashes, starts), strict=True):
                    i, item, offset = table.meet(codes, fit)
                    if len(i):
                        place = starts[i] + begin
                        text = np.searchsorted(begins, place, "right") - 1
                        first = place - begins[text] - offset
                        found.update(zip(text.tolist(), item.tolist(), (first - first % self.grid[item]).tolist(), strict=True))
        return found

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text: (item index, edits, first word, number of words) of the best passage of each item in it."""
        out: list[list] = [[] for _ in texts]
        if not self.items:
            return out
        words_of = [normal_words(t) for t in texts]
        get, pad = self.ids.get, [0] * STEPS
        begins, line = [], []
        for words in words_of:
            begins.append(len(line))
            line += map(get, words, repeat(0))
            line += pad
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for t, k, first in sorted(self.candidates(np.array(line, np.int64), np.array(begins, np.int64))):
            hit = self._verify(k, words_of[t], first)
            if hit and ((t, k) not in best or hit < best[t, k]):
                best[t, k] = hit
        for (t, k), hit in sorted(best.items()):
            out[t].append((k, *hit))
        return out

    def _verify(self, k: int, words: list[str], start: int) -> tuple[int, int, int] | None:
        """The best passage of item k that begins within its edits of one of the grid's places from ``start`` on."""
        n, d = len(self.items[k][1]), self.edits[k]
        lo = max(0, start - d)
        text = words[lo : max(0, start + 2 * d + n)]
        if len(text) < n - d:
            return None
        key = (k, " ".join(text))
        got = self.cache.get(key, 0)
        if got == 0:
            edits, end = infix(self.peq[k], n, text)
            got = None
            if edits <= d and end:
                _, size = infix(self.back[k], n, text[:end][::-1], free_start=False)
                got = (edits, end - size, size)
            if len(self.cache) > 4096:
                self.cache.clear()
            self.cache[key] = got
        return got and (got[0], lo + got[1], got[2])


def item_blocks(benchmark: DataFrame, block_bytes: int, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, list[str]]]]:
    """The benchmark in blocks of about ``block_bytes``: each fits the driver and one broadcast, however many there are."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).distinct().collect()
        yield sorted(((r["i"], normal_words(r["t"])) for r in part), key=lambda x: (x[0] is None, x[0], x[1]))


_READY: dict[str, Matcher] = {}


def _matcher(name: str, block, similarity: float) -> Matcher:
    """The block's matcher; a worker keeps the last one for its next tasks."""
    if name not in _READY:
        _READY.clear()
        _READY[name] = Matcher(block.value, similarity)
    return _READY[name]


def _pieces(b: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for at in range(0, b.num_rows, 256):
        part = b.slice(at, 256)
        yield part, part.column(column).to_pylist()


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block_bytes: int = 2 << 20) -> DataFrame:
    """``doc_id, th, item_id, edits, similarity, start_word, n_words``: a row for each document and item that occurs in it."""
    rows, out = keyed(docs), None
    ids = dict(benchmark.dtypes)["item_id"]
    doc_ids = dict(docs.dtypes)["doc_id"]
    for items in item_blocks(benchmark, block_bytes):
        block = docs.sparkSession.sparkContext.broadcast(items)

        def run(it: Iterator[pa.RecordBatch], name=uuid.uuid4().hex, block=block) -> Iterator[pa.RecordBatch]:
            m = _matcher(name, block, similarity)
            for b in it:
                for part, texts in _pieces(b, 2):
                    hits = [(i, h) for i, found in enumerate(m.find(texts)) for h in found]
                    if hits:
                        own = pa.table([part.column(0), part.column(1)], names=["doc_id", "th"]).take(pa.array([i for i, _ in hits])).combine_chunks()
                        k = [m.items[h[0]] for _, h in hits]
                        cols = [pa.array([i for i, _ in k]), pa.array([h[1] for _, h in hits], pa.int32()), pa.array([round(1 - h[1] / len(w), 6) for (_, h), (_, w) in zip(hits, k, strict=True)], pa.float64()),
                                pa.array([h[2] for _, h in hits], pa.int32()), pa.array([h[3] for _, h in hits], pa.int32())]
                        yield pa.RecordBatch.from_arrays([own.column(0).chunk(0), own.column(1).chunk(0), *cols], names=["doc_id", "th", "item_id", "edits", "similarity", "start_word", "n_words"])

        found = rows.mapInArrow(run, f"doc_id {doc_ids}, th long, item_id {ids}, edits int, similarity double, start_word int, n_words int")
        out = found if out is None else out.unionByName(found)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block_bytes: int = 2 << 20) -> DataFrame:
    """Rows and columns of ``docs`` in which no item occurs; a filter in place, without a join."""
    rows = docs.select(whole_row(docs).alias("row"), text_or_empty().alias("text"))
    schema = rows.schema
    for items in item_blocks(benchmark, block_bytes):
        block = docs.sparkSession.sparkContext.broadcast(items)

        def run(it: Iterator[pa.RecordBatch], name=uuid.uuid4().hex, block=block) -> Iterator[pa.RecordBatch]:
            m = _matcher(name, block, similarity)
            for b in it:
                for part, texts in _pieces(b, 1):
                    yield part.filter(pa.array([not found for found in m.find(texts)], pa.bool_()))

        rows = rows.mapInArrow(run, schema)
    return rows.select("row.*")
