"""Line dedup: a suffix array over line ids by distributed prefix doubling.

The corpus is one sequence of line ids (lines with a word; blank lines stay
out of it and are never deleted), ended after each document. Ranks of lines
that occur once end every match and are dropped at once. A doubling step gives
each suffix the rank of (its rank, the rank of the suffix one prefix length
on) by a distributed sort of the distinct pairs; ranks keep the suffix order.
Depths between the doubled ones come from two ranks that overlap. Suffixes of
equal rank at a depth are an LCP interval of that depth, and deeper intervals
lie inside, so the order is taken no deeper than ``min_lines``: it would not
change which lines a repeated run covers.

An interval's smallest position, by (document id, text hash, line), stays. A
repeated run that begins at any other position is deleted if it has
``min_lines`` lines, or ``min_words`` words on fewer lines, or if it is all of
its document. Deleted lines that follow each other are a maximal run.

Everything is DataFrame functions; no group is ever gathered, hot lines are
pre-aggregated and joined back, which Spark splits when skewed.

Null and empty texts have no lines; texts of any length are sequences of as
many lines; rows that repeat a document are one document and get equal
results; ties are in the order of the place; only the id and the text are
read, so other columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, keyed, partitions, release, same_doc, stage, unstage

MIN_LINES = 3
MIN_WORDS = 50
#: Documents with deleted runs, and runs, up to which these are broadcast to the texts; beyond it the texts are shuffled to them.
BROADCAST_DOCS, BROADCAST_RUNS = 100_000, 1_000_000
WORD = r"[^\x20\x09-\x0D]"


def _ranked(keys: DataFrame, by: list[str], name: str) -> DataFrame:
    """Order-preserving ranks of distinct keys: a distributed sort, numbered by partition and row."""
    n = partitions(keys.sparkSession)
    return stage(keys.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()), name)


def _sequence(docs: DataFrame) -> DataFrame:
    """``doc_id, th, i`` (place among the document's m lines with a word), its words (``w``, and ``ws`` of the depth) and two hashes."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    at = keyed(docs).select("doc_id", "th", lines.alias("lines")).select("doc_id", "th", F.size("lines").alias("m"), F.posexplode("lines").alias("i", "line"))
    words = F.regexp_count("line", F.lit(WORD_PATTERN))
    return at.select("doc_id", "th", "i", "m", words.alias("w"), words.alias("ws"), F.xxhash64("line").alias("x"), F.xxhash64(F.lit(1), "line").alias("y"))


def _recurring(rows: DataFrame) -> DataFrame:
    """The keys ``x, y`` found at two places or more, with the first place."""
    place = F.struct("doc_id", "th", "i")
    return rows.groupBy("x", "y").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("x", "y", "first")


def _interval(rows: DataFrame, name: str) -> DataFrame:
    """The suffixes whose key recurs, ranked by it, with whether an earlier one has it: the LCP intervals of a depth."""
    ranks = _ranked(_recurring(rows), ["x", "y"], f"{name}-ranks")
    later = (F.struct("doc_id", "th", "i") > F.col("first")).alias("later")
    out = stage(rows.join(ranks, ["x", "y"]).select("doc_id", "th", "i", "m", "w", "ws", "rank", later), name)
    unstage(ranks)
    return out


def _pairs(rows: DataFrame, shift: int) -> DataFrame:
    """Suffixes by (rank, rank of the suffix ``shift`` lines on), with the words of the new depth; unmatched suffixes go.

    Of a suffix that recurs at the new depth, the ``shift`` lines before the
    second rank begin suffixes that recur at the old one, so none is missing.
    """
    by = "over (partition by doc_id, th order by i range between"
    on = f"{by} {shift} following and {shift} following)"
    ws = F.expr(f"sum(w) {by} current row and {shift - 1} following) + max(ws) {on}")
    return rows.select("doc_id", "th", "i", "m", "w", ws.alias("ws"), F.col("rank").alias("x"), F.expr(f"max(rank) {on}").alias("y")).where("y is not null")


def repeated_starts(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, th, starts``: (place, lines) of the repeated runs that are deleted, of the least depths that cover them."""
    spark = docs.sparkSession
    sequence = stage(_sequence(docs), "lines")
    doubled = {1: _interval(sequence, "lines-1")}
    release(spark)
    found, used = [], [sequence]
    for depth in range(1, min_lines + 1):
        power = 1 << (depth.bit_length() - 1)
        if depth == power:
            if power > 1:
                doubled[power] = _interval(_pairs(doubled[power // 2], power // 2), f"lines-{power}")
            rows = doubled[power]
        else:
            rows = _interval(_pairs(doubled[power], depth - power), f"lines-{depth}")
            used.append(rows)
        later = rows.where("later")
        if depth < min_lines:
            later = later.where((F.col("ws") >= min_words) | (F.col("m") == depth))
        found.append(later.select("doc_id", "th", "i", F.lit(depth).alias("n")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    out = stage(every.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("i", "n"))).alias("starts")), "lines-starts")
    for rows in [*used, *doubled.values()]:
        unstage(rows)
    return out


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, th, text`` without later copies, ``n_lines, n_removed, n_runs`` and ``runs`` ((first line, lines) among lines with a word)."""
    rows, starts = keyed(docs), repeated_starts(docs, min_lines, min_words)
    release(docs.sparkSession)
    size = starts.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("starts")).alias("runs")).first()
    few = size["docs"] <= BROADCAST_DOCS and (size["runs"] or 0) <= BROADCAST_RUNS
    joined = rows.join(F.broadcast(starts) if few else starts, same_doc(rows, starts), "left").select(rows["doc_id"], rows["th"], rows["text"], "starts")
    some = F.col("starts").isNotNull()
    lines = F.split("text", "\n")
    worded = F.filter(F.transform(lines, lambda x, j: F.struct(x.rlike(WORD).alias("w"), j.alias("j"))), lambda s: s["w"])["j"]
    flat = joined.withColumn("places", F.when(some, worded))
    gone = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["i"], s["i"] + s["n"] - 1)))))
    flat = flat.withColumn("gone", F.when(some, gone))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform("gone", lambda g: F.get("places", g)))
    kept = F.when(some, F.array_join(F.transform(left, lambda j: F.get(lines, j)), "\n")).otherwise(F.col("text"))
    opens = F.filter("gone", lambda g, k: (k == 0) | (g - F.get("gone", k - 1) > 1))
    closes = F.filter("gone", lambda g, k: (k == F.size("gone") - 1) | (F.get("gone", k + 1) - g > 1))
    runs = F.zip_with(opens, closes, lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("n")))
    n_lines = F.when(F.col("text") == "", 0).otherwise(F.size(lines)).cast("long")
    return flat.select(
        "doc_id", "th", kept.alias("text"), n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size(runs), F.lit(0)).cast("long").alias("n_runs"), runs.alias("runs"),
    )
