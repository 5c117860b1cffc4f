"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Two first-order Markov chains over a small alphabet are estimated from
labelled samples: strings drawn uniformly from the alphabets keys are made of
(label 1) and ordinary words and identifiers joined as programmers do (label
0). A token of a text is a finding of kind ``random`` if the log-likelihood
ratio of the two chains, per transition, exceeds a threshold and no pattern
has found any part of it. All distinct words of the corpus are samples of the
ordinary chain, so it follows the corpus in its languages and grows with it. Main path and training are DataFrame functions only.

Null and empty texts have no spans; tokens of ``LEAST_TOKEN`` characters or more
are scored, whole, however long; repeated rows get equal results; spans that
begin together are in the order of kinds; only the id and the text are read, so
other columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

#: Patterns, the group whose length counts, its least length; fixed values in the order of kinds.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
LEAST = {"assign": 6, "access": 20, "hex": 24}

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Shorter tokens are not scored: too few transitions tell them from identifiers.
LEAST_TOKEN = 20
TOKEN = rf"[A-Za-z0-9+/_=-]{{{LEAST_TOKEN},}}"
K = len(ALPHABET) + 1


def labelled_samples(spark: SparkSession, words: DataFrame | None = None, n_random: int = 6000, n_ordinary: int = 6000) -> DataFrame:
    """``token, label``: at most ``n_random`` + ``n_ordinary`` rows, the documented bound of the training set.

    Random strings are hexadecimal, base-64 and upper-case alphanumeric digests
    of a counter. Ordinary ones join three entries of ``words`` (column
    ``word``; else a small list of common identifier parts) in the usual
    styles: camel case, snake case, dashes, paths, with and without a number.
    """
    n = F.col("id")
    digest = F.sha2(n.cast("string"), 256)
    b64 = F.translate(F.base64(F.unhex(digest)), "=", "")
    random = spark.range(n_random).select(
        F.when(n % 3 == 0, F.substring(digest, 1, 40)).when(n % 3 == 1, F.substring(b64, 1, 40)).otherwise(F.substring(F.upper(F.translate(b64, "+/", "XQ")), 1, 32)).alias("token"),
        F.lit(1).alias("label"),
    )
    if words is None:
        parts = ("user account manager session request response handler service config database connection index table column value default option "
                 "parser builder factory buffer stream reader writer error message number string list update delete create select insert cluster node "
                 "version release package module function variable parameter return background foreground container element document window").split()
        words = spark.createDataFrame([(w,) for w in parts], "word string")
    pool = [r[0] for r in words.select("word").distinct().orderBy(F.xxhash64("word")).limit(2000).collect() if r[0]] or ["name"]
    bag = F.lit("\n".join(pool))
    pick = lambda k: F.element_at(F.split(bag, "\n"), (F.pmod(F.xxhash64(n, F.lit(k)), F.lit(len(pool))) + 1).cast("int"))
    w = spark.range(n_ordinary).select(n, *[pick(k).alias(f"w{k}") for k in range(3)])
    a, b, c = F.col("w0"), F.col("w1"), F.col("w2")
    ordinary = w.select(
        F.when(n % 6 == 0, F.concat(a, F.initcap(b), F.initcap(c))).when(n % 6 == 1, F.concat_ws("_", a, b, c)).when(n % 6 == 2, F.concat_ws("-", a, b, c))
        .when(n % 6 == 3, F.concat_ws("/", a, b, c)).when(n % 6 == 4, F.concat(a, b, c)).otherwise(F.concat_ws("_", F.upper(a), F.upper(b), (n % 100).cast("string"))).alias("token"),
        F.lit(0).alias("label"),
    )
    return random.unionByName(ordinary)


def _states(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of the K x K transitions, row by row; counts are one distributed aggregate."""
    s = samples.where("token is not null and length(token) > 1").select("label", F.filter(_states(F.col("token")), lambda i: i.isNotNull()).alias("s"))
    pairs = s.select("label", F.explode(F.zip_with(F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s") - 1), lambda x, y: x * K + y)).alias("pair"))
    counts = {(r["label"], r["pair"]): r["n"] for r in pairs.groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2 K^2 rows
    out = []
    for i in range(K):
        row = {y: [counts.get((y, i * K + j), 0) + smoothing for j in range(K)] for y in (0, 1)}
        total = {y: sum(v) for y, v in row.items()}
        out += [round(math.log(row[1][j] / total[1]) - math.log(row[0][j] / total[0]), 4) for j in range(K)]
    return out


def mean_ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio a transition of ``token`` under the random chain against the ordinary one."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # a constant; folded once
    s = _states(token)
    pairs = F.zip_with(F.slice(s, 1, F.length(token) - 1), F.slice(s, 2, F.length(token) - 1), lambda x, y: x * K + y)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, i: acc + F.get(table, i)) / (F.length(token) - 1)


_EMPTY = "cast(array() as array<struct<start:int,kind:int,end:int>>)"


#: Matches of a text that are placed together; a text's work is in proportion to its matches.
_GROUP = 256


def _located(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of ``pattern`` in code points. The pieces between matches and the matches themselves alternate,
    both found by the same left-to-right search, so their running lengths are the positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    both = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("gap"), F.length(m).alias("n"), keep(m).alias("ok")))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _GROUP).cast("int")), lambda k: F.slice(both, k * _GROUP + 1, F.lit(_GROUP)))
    sums = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda a, m: a + m["gap"] + m["n"]))
    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all"))
    begins = F.aggregate(sums, begin, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])

    def step(acc, m):
        s = acc["at"] + m["gap"]
        e = s + m["n"]
        one = F.array(F.struct(s.alias("start"), F.lit(kind).alias("kind"), e.alias("end")))
        return F.struct(e.alias("at"), F.when(m["ok"], F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    placed = F.zip_with(begins, groups, lambda at, g: F.aggregate(g, F.struct(at.alias("at"), F.expr(_EMPTY).alias("spans")), step, lambda acc: acc["spans"]))
    return F.when(F.size(found) > 0, F.flatten(placed)).otherwise(F.expr(_EMPTY))


def _if(cond: Column, spans: Column) -> Column:
    """Most texts have none: one cheap look decides whether the search is made at all."""
    return F.when(cond, spans).otherwise(F.expr(_EMPTY))


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[float], threshold: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, arrays ``base`` and ``spans`` of (start, kind, end) by start and kind. No shuffle, no Python."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    whole = F.lit(True)
    assign = _if(
        text.rlike(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
        _located(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST["assign"]),
    )
    access = _if(text.contains("AKIA"), _located(text, ACCESS, 1, lambda m: F.length(m) >= LEAST["access"]))
    hexa = _if(text.rlike(HEX), _located(text, HEX, 2, lambda m: whole))
    tokens = _if(text.rlike(TOKEN), _located(text, TOKEN, 3, lambda m: mean_ratio(m, model) > threshold))
    found = rows.select("doc_id", F.array_sort(F.concat(assign, access, hexa)).alias("base"), tokens.alias("tokens"))
    fresh = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", fresh)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] == 3)).cast("long").alias("n_random"),
    )


def corpus_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word``: every distinct word of letters in all documents, lower case; what is gathered grows with the corpus."""
    words = F.explode(F.regexp_extract_all(F.lower(text_or_empty(text_col)), F.lit(r"\b\p{L}{3,24}\b"), F.lit(0)))
    return docs.select(words.alias("word")).distinct()


def ordinary(words: DataFrame) -> DataFrame:
    """Words as labelled samples of the ordinary chain."""
    return words.select(F.col("word").alias("token"), F.lit(0).alias("label"))
