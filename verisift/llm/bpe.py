"""Byte-level BPE encoding and decoding by monoid tree reduction.

An element of the monoid is a piece of text with the matches of the split
pattern in it and the tokens of each match; ``join`` of two neighbours is the
element of their concatenation. Only a window at the boundary is split and
encoded again. It grows until what lies outside provably stays as it is:

* *Matches.* The pattern looks ahead by less than ``LOOK`` characters and never
  back. So a match of the left text that ends ``LOOK`` before its end is final,
  and from the first boundary that the new split shares with the right text's
  own split, both go on alike.
* *Tokens of one match.* If no pair of neighbouring tokens merges when encoded
  on its own, the whole list is what greedy merging makes of its bytes: the
  first merge across a boundary would, up to then, see the same bytes and
  merges on both sides as in the pair alone. So window and rest fit together
  as soon as the pairs at the window's ends do.

Texts are halved down to spans and long matches down to a few bytes, and
joined up the tree. Texts above ``long_text`` characters become rows of
their own a span, are encoded by all executors, and their elements are joined
in one more step, a tree again.

Every row of the input gives one row. A null text is empty; an empty text has
no tokens; equal rows have equal results; columns other than the id and the
text are not read, so their names cannot clash; an empty table gives an empty
result. A text may have any length that a Spark string can have.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stage, text_or_empty, unstage

#: Characters behind a match that decide whether it ends there (two are needed).
LOOK = 3
#: Characters of a leaf of a text's tree, and bytes of a leaf of a match's tree.
SPAN, LEAF = 4096, 64
#: Longer matches than this are no vocabulary entry and are joined by their tokens.
LONG_MATCH = 256
#: Matches whose tokens a worker remembers: so many new ones, and those met again of as many before.
REMEMBERED = 400_000
#: Above all ranks.
NONE = 1 << 62
#: Tokens after which an output batch is closed.
BATCH_TOKENS = 2_000_000

#: Matches, and the tokens of each as packed 32-bit integers.
Element = tuple[list[str], list[bytes]]


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of lines ``base64 rank``; its size bounds what is broadcast."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _cut(n: int) -> int:
    """Where to halve ``n``: at a power of two, where runs of one character mostly fall into whole tokens."""
    return 1 << (n - 1).bit_length() - 1


class Known(dict):
    """Tokens of matches met lately. When full, it starts anew and takes over what it meets again."""

    def __init__(self, make) -> None:
        self.make, self.old = make, {}

    def __missing__(self, m: str) -> bytes:
        found = self.old.get(m) or self.make(m)
        if len(m) <= LONG_MATCH:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[m] = found
        return found


class Coder:
    """Encodes and decodes by the ranks of byte strings and the pattern that splits texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, pattern
        self.vocabulary = {rank: token for token, rank in ranks.items()}
        size = max(ranks.values(), default=-1) + 1
        self._sizes = np.array([len(self.vocabulary.get(i, b"")) for i in range(size)], np.int64)
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._letters = np.frombuffer(b"".join(self.vocabulary.get(i, b"") for i in range(size)), np.uint8)
        self._matches = regex.compile(pattern).findall
        self.match = Known(self._match).__getitem__
        self.stable = lru_cache(1 << 16)(self._stable)

    def __reduce__(self):
        return Coder, (self.ranks, self.pattern)

    # tokens of one match

    def merged(self, b: bytes) -> list[int]:
        """Greedy merging: of all neighbours whose union is a token, the leftmost of the least rank, until none is left."""
        if len(b) > LEAF:
            return self._merged_long(b)
        get, parts = self.ranks.get, [b[i : i + 1] for i in range(len(b))]
        ranks = [get(b[i : i + 2], NONE) for i in range(len(b) - 1)]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], NONE)
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], NONE)
        return list(map(get, parts))

    def _merged_long(self, b: bytes) -> list[int]:
        """The same with a heap, for long windows."""
        get, n = self.ranks.get, len(b)
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(b[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, e = heappop(heap)
            j = end[i]
            if j >= e or j < 0 or end[j] != e:
                continue  # one of the two has been merged meanwhile
            end[i], end[j], before[e] = e, -1, i
            if e < n and (r := get(b[i : end[e]])) is not None:
                heappush(heap, (r, i, end[e]))
            p = before[i]
            if p >= 0 and (r := get(b[p:e])) is not None:
                heappush(heap, (r, p, e))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[b[i : end[i]]])
            i = end[i]
        return out

    def _stable(self, a: int, b: int) -> bool:
        return self.merged(self.vocabulary[a] + self.vocabulary[b]) == [a, b]

    def join_tokens(self, a: list[int], b: list[int]) -> list[int]:
        """The tokens of two byte strings put together, from the tokens of each."""
        if not a or not b or self.stable(a[-1], b[0]):
            return a + b
        left = right = 1
        while True:
            left, right = min(left, len(a)), min(right, len(b))
            window = self.merged(b"".join(map(self.vocabulary.__getitem__, a[len(a) - left :] + b[:right])))
            free = left == len(a) or self.stable(a[-left - 1], window[0])
            fits = right == len(b) or self.stable(window[-1], b[right])
            if free and fits:
                return a[: len(a) - left] + window + b[right:]
            left, right = left * (1 if free else 2), right * (1 if fits else 2)

    def tokens(self, b: bytes) -> list[int]:
        """Halves are encoded and joined."""
        if len(b) <= LEAF:
            return self.merged(b)
        cut = _cut(len(b))
        return self.join_tokens(self.tokens(b[:cut]), self.tokens(b[cut:]))

    def _match(self, m: str) -> bytes:
        """Tokens of one match; a match that is a token stays whole."""
        b = m.encode()
        whole = self.ranks.get(b)
        return array("i", self.tokens(b) if whole is None else (whole,)).tobytes()

    # texts

    def join(self, a: Element, b: Element) -> Element:
        """The element of two neighbouring texts, from the elements of each."""
        if not a[0] or not b[0]:
            return a if a[0] else b
        kept, behind = len(a[0]), 0
        while kept and behind < LOOK:
            kept -= 1
            behind += len(a[0][kept])
        # the match that ends LOOK characters before the end is final, those behind it are not
        tail, taken = "".join(a[0][kept:]), 0
        own = {0: 0}
        while True:
            more = min(len(b[0]), max(4, 2 * taken))
            at = max(own)
            for i in range(taken, more):
                at += len(b[0][i])
                own[at] = i + 1
            taken = more
            window = tail + "".join(b[0][:taken])
            new = self._matches(window)
            last = len(window) if taken == len(b[0]) else len(window) - LOOK
            for i, e in enumerate(accumulate(map(len, new)), 1):
                if e > last:
                    break
                if (shared := own.get(e - len(tail))) is not None:
                    middle = [self._match_of(m, a, b) for m in new[:i]]
                    return a[0][:kept] + new[:i] + b[0][shared:], a[1][:kept] + middle + b[1][shared:]

    def _match_of(self, m: str, a: Element, b: Element) -> bytes:
        left, right = a[0][-1], b[0][0]
        if min(len(left), len(right)) > LONG_MATCH and len(m) == len(left) + len(right) and m.startswith(left) and m.endswith(right):
            return array("i", self.join_tokens(array("i", a[1][-1]).tolist(), array("i", b[1][0]).tolist())).tobytes()
        return self.match(m)

    def element(self, text: str) -> Element:
        if len(text) <= SPAN:
            matches = self._matches(text)
            return matches, list(map(self.match, matches))
        cut = _cut(len(text))
        return self.join(self.element(text[:cut]), self.element(text[cut:]))

    def encode(self, text: str) -> bytes:
        """Token ids as packed 32-bit integers."""
        return b"".join(self.element(text)[1])

    def tree(self, elements: list[Element]) -> Element:
        """Neighbours joined level by level."""
        while len(elements) > 1:
            elements = [self.join(*elements[i : i + 2]) if i + 1 < len(elements) else elements[i] for i in range(0, len(elements), 2)]
        return elements[0] if elements else ([], [])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of tokens, concatenated up the tree."""
        if len(ids) > 16 * SPAN:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        sizes = self._sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self._starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self._letters[at].tobytes()


def coder(path: str, pattern: str) -> Coder:
    return Coder(load_ranks(path), pattern)


def _id_batch(names: pa.Array, lists: list[bytes]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, lists)]) // 4
    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(lists), np.int32)))
    return pa.RecordBatch.from_arrays([names, ids], names=["doc_id", "ids"])


def encode(docs: DataFrame, by: Coder, long_text: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text, a row for each row of ``docs``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(by)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = sent.value.encode
        for b in it:
            begun, lists, n = 0, [], 0
            for i, t in enumerate(b.column(1)):
                lists.append(encode(t.as_py()))
                n += len(lists[-1]) // 4
                if n >= BATCH_TOKENS:
                    yield _id_batch(b.column(0).slice(begun, i + 1 - begun), lists)
                    begun, lists, n = i + 1, [], 0
            if lists:
                yield _id_batch(b.column(0).slice(begun), lists)

    short = rows.where(F.length("text") <= long_text).mapInArrow(whole, f"doc_id {kind}, ids array<int>")
    long = stage(rows.where(F.length("text") > long_text).withColumn("row", F.monotonically_increasing_id()), "bpe-long")
    if not long.take(1):
        unstage(long)
        return short

    def spans(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = text.as_py()
                for no, at in enumerate(range(0, len(t), long_text)):
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([no], pa.int32()), pa.array([t[at : at + long_text]])], names=["row", "no", "span"])

    def elements(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                matches, tokens = sent.value.element(b.column(2)[i].as_py())
                sizes = np.array([list(map(len, matches)), list(map(len, tokens))], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1), b.column(1).slice(i, 1), b.column(2).slice(i, 1), pa.array([sizes.tobytes()], pa.binary()), pa.array([b"".join(tokens)], pa.binary())],
                    names=["row", "no", "span", "sizes", "tokens"],
                )

    def joined(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        leaves = []
        for r in pdf.sort_values("no").itertuples():
            cut = lambda whole, sizes: [whole[e - n : e] for n, e in zip(sizes, accumulate(sizes), strict=True)]
            chars, packed = np.frombuffer(r.sizes, np.int32).reshape(2, -1).tolist()
            leaves.append((cut(r.span, chars), cut(r.tokens, packed)))
        return pd.DataFrame({"row": [key[0]], "ids": [np.frombuffer(b"".join(sent.value.tree(leaves)[1]), np.int32)]})

    parts = long.select("row", "text").mapInArrow(spans, "row long, no int, span string").repartition(4 * partitions(spark), "row", "no")
    encoded = parts.mapInArrow(elements, "row long, no int, span string, sizes binary, tokens binary")
    ids = encoded.groupBy("row").applyInPandas(joined, "row long, ids array<int>")
    return short.unionByName(long.select("row", "doc_id").join(ids, "row").select("doc_id", "ids"))


def decode(tokens: DataFrame, by: Coder) -> DataFrame:
    """``doc_id, ids`` and ``decoded``, the bytes of the ids."""
    sent = tokens.sparkSession.sparkContext.broadcast(by)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = sent.value.decode
        for b in it:
            lists, done = b.column(1), 0
            ends, ids = np.asarray(lists.offsets), np.asarray(lists.values)
            while done < b.num_rows:  # a bounded number of tokens at a time
                upto = max(done + 1, int(np.searchsorted(ends, ends[done] + BATCH_TOKENS, "right")) - 1)
                texts = [decode(ids[ends[i] : ends[i + 1]]) for i in range(done, upto)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, upto - done), lists.slice(done, upto - done), pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])
                done = upto

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, ids array<int>, decoded binary")
