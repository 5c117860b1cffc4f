"""Statistics of whole texts, shared by the quality rules and the quality classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import stage

SYMBOLS = "#*$%&|<>"
#: Raw statistics, then the ratios that rules and labellers are made of.
RAW = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "mean_word_len", "upper_ratio", "top_word_ratio", "lexicon_hits", "lexicon_ratio")
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[bytes]:
    """Maximal runs of anything but ASCII white space: what bytes.split() splits on is exactly x20 and x09-x0D."""
    return text.encode("utf-8", "surrogatepass").split()


def repeat_words(words: list[bytes]) -> int:
    """Words inside a three-word window that is found twice or more, the first time included."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == n:
        return 0
    counts = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    counts = Counter(lines)
    return sum(n - 1 for line, n in counts.items() if n > 1 and line.strip(" \t\n\r\v\f"))


def measure(text: str, lexicon: frozenset[str]) -> tuple[list[int], list[float]]:
    words = words_of(text)
    n = len(words)
    spaces = text.count(" ") + text.count("\n") + text.count("\t") + text.count("\r") + text.count("\v") + text.count("\f")
    chars = len(text) - spaces
    symbols = sum(text.count(c) for c in SYMBOLS)
    dups, repeats = dup_lines(text), repeat_words(words)
    n_lines = text.count("\n") + 1
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    top = Counter(words).most_common(1)[0][1] if words else 0
    hits = 0
    if lexicon and n:
        low = text.lower()
        for w in lexicon:
            if w in low:
                hits += sum(m == w for m in _LETTERS.findall(low)) if low.count(w) else 0
    per = 1.0 / n if n else 0.0
    return [n, chars, symbols, dups, repeats], [symbols / chars if chars else 0.0, dups / n_lines, repeats * per, chars * per, upper / chars if chars else 0.0, top * per, float(hits), hits * per]


def batches(column: str) -> callable:
    """Strings of an Arrow column, nulls as empty texts."""
    return lambda b: ("" if v is None else v for v in b.column(column).to_pylist())


def with_stats(rows: DataFrame, lexicon: Iterable[str] = ()) -> DataFrame:
    """``rows`` (``doc_id, th, text, ...``) with all statistics in place of the text."""
    words = frozenset(lexicon)
    keep = [f for f in rows.schema.fields if f.name != "text"]
    schema = StructType([*keep, *[StructField(c, LongType()) for c in RAW], *[StructField(c, DoubleType()) for c in RATIOS]])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = [measure(t, words) for t in batches("text")(part)]
                raw = list(zip(*[f[0] for f in found], strict=True)) or [[]] * len(RAW)
                ratios = list(zip(*[f[1] for f in found], strict=True)) or [[]] * len(RATIOS)
                yield pa.RecordBatch.from_arrays(
                    [part.column(f.name) for f in keep] + [pa.array(c, pa.int64()) for c in raw] + [pa.array(c, pa.float64()) for c in ratios],
                    names=[f.name for f in keep] + [*RAW, *RATIOS],
                )

    return rows.mapInArrow(run, schema)


def stats_of(text: Column, lexicon: Iterable[str] = ()) -> Column:
    """All statistics of a text as a struct. Only the texts go to Python, so rows of any width stay where they are."""
    words = frozenset(lexicon)
    kinds = [*[(c, pa.int64()) for c in RAW], *[(c, pa.float64()) for c in RATIOS]]

    @F.arrow_udf(StructType([*[StructField(c, LongType()) for c in RAW], *[StructField(c, DoubleType()) for c in RATIOS]]))
    def run(texts: pa.Array) -> pa.Array:
        columns: list[list] = [[] for _ in kinds]
        for at in range(0, len(texts), 512):
            for t in texts.slice(at, 512).to_pylist():
                for column, value in zip(columns, chain(*measure(t or "", words)), strict=True):
                    column.append(value)
        return pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)], names=[c for c, _ in kinds])

    return run(text)


def one_text_each(rows: DataFrame) -> DataFrame:
    """``doc_id, text`` of ``rows``, one text (of least hash) an id, so that a bound on ids bounds the rows."""
    return rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("th"), "text")).alias("x")).select("doc_id", "x.text")


def labelled_sample(docs: DataFrame, labels: DataFrame, n_rows: int) -> DataFrame:
    """``doc_id, text, quality, toxic`` of at most ``n_rows`` labelled documents, in hash order: the documented bound of fitting.

    The texts stay on the executors, in the shared folder; copies count once.
    """
    some = labels.where("doc_id is not null").select("doc_id", "quality", "toxic").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_rows)
    some = F.broadcast(some)  # at most n_rows rows are sent
    text = one_text_each(docs.where("text is not null").select("doc_id", "text").join(some.select("doc_id"), "doc_id", "left_semi"))
    known = text.join(some, "doc_id")
    return stage(known.groupBy("text").agg(F.max(F.struct("doc_id", "quality", "toxic")).alias("x")).select("x.doc_id", "text", "x.quality", "x.toxic"), "labelled")


def learn_lexicon(sample: DataFrame, least_share: float = 0.08, least_docs: int = 3, ratio: float = 20.0) -> list[str]:
    """Words that mark the positive (toxic) texts: frequent there, next to absent elsewhere.

    Each task counts its texts with a word; what comes back is the lexicon, not the counts.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()
        for b in it:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (pos if y else neg).update({w for w in _LETTERS.findall(text.lower()) if len(w) > 2})
        words = [*pos, *(w for w in neg if w not in pos)]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([pos[w] for w in words], pa.int64()), pa.array([neg[w] for w in words], pa.int64())], names=["word", "pos", "neg"])

    toxic = F.coalesce(F.col("toxic") != 0, F.lit(False))
    n = sample.agg(F.count_if(toxic).alias("pos"), F.count_if(~toxic).alias("neg")).first()
    least = max(least_docs, least_share * n["pos"])
    counts = sample.select("text", toxic.alias("y")).mapInArrow(run, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    marks = counts.where((F.col("pos") >= least) & ((F.col("pos") + 0.5) / (n["pos"] + 1) >= ratio * (F.col("neg") + 0.5) / (n["neg"] + 1)))
    return sorted(r["word"] for r in marks.select("word").collect())  # each stands in least_share of the positive texts
