"""The gated loop for all queries at once, and the plain control."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import scores as S
from ..sources import tables as T
from . import evidence as E
from . import strategy as decide_next
from .lexical import top_k


def _folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset a temporary one serves, in local mode only."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="verisift-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` as a table in the shared folder, partitioned ``by`` columns: cuts the lineage of a loop."""
    path = f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def next_scopes(judged: DataFrame, s: Settings, top_k: int, policy: str | None = None, min_grade: float | None = None, since: str | None = None) -> DataFrame:
    """A row for each query that asks for more: the scope of its next round, from the hints of its decision.

    ``judged`` has ``query_id, action, missing, unresolved``; the rest is the scope that the queries began with.
    """
    asked = judged.where("action = 'RETRIEVE_MORE'").withColumn("h", decide_next.hints(F.col("missing"), F.col("unresolved")))
    h = lambda c: F.col(f"h.{c}")
    scope = decide_next.apply_hints(
        h("focus"), h("exclusive"), h("safety_search"), h("relax_filters"), h("contradiction_review"), h("increase_k"), F.lit(top_k), F.lit(policy).cast("string"), F.lit(min_grade).cast("double"), s,
        F.lit(since).cast("date"),
    )
    return asked.select("query_id", scope.alias("s")).select("query_id", "s.*")


def in_scope(passages: DataFrame, scopes: DataFrame) -> DataFrame:
    """The best ``k`` passages of each query within its own scope: scopes are data, joined, so every query may have another.

    A source or policy limits the sources; the least grade and the timeframe hold where they are set; a preferred source goes
    first, and within that the dense score decides.
    """
    sc = scopes.select("query_id", *[F.col(c).alias(f"_{c}") for c in ("k", "source", "policy", "preferred", "min_grade", "timeframe")])
    only = F.when(F.col("_policy").endswith("_ONLY"), F.regexp_replace("_policy", "_ONLY$", ""))
    want = F.coalesce("_source", only)
    rows = passages.join(sc, "query_id").where(
        (want.isNull() | (F.col("source_type") == want)) & (F.col("_min_grade").isNull() | (F.col("grade_score") >= F.col("_min_grade")))
        & (F.col("_timeframe").isNull() | (F.col("effective_date") >= F.col("_timeframe")))
    )
    first = F.coalesce(F.col("source_type") == F.col("_preferred"), F.lit(False))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(first.desc(), F.col("dense").desc(), "chunk_id"))
    return rows.withColumn("rank", turn).where(F.col("rank") <= F.col("_k")).drop("_k", "_source", "_policy", "_preferred", "_min_grade", "_timeframe")


def sufficiency(passages: DataFrame, facets: DataFrame, s: Settings, breadth: int = 8, policy: str | None = None, min_grade: float | None = None, since: str | None = None) -> DataFrame:
    """``query_id, iteration, action, missing, n``: the decision each query ended with, and the passages it was made on.

    The first round takes ``breadth`` passages under the scope given. The hints of a decision make the scope of the query's
    next round, whose passages join those it has; only queries that ask for more go on.

    Texts are read once: each passage is aligned with the facets before the rounds, and they work on rows without a text.
    """
    own = passages.withColumn("_row", F.monotonically_increasing_id())
    aligned = E.align(own, facets, T.SAFETY_STEMS, T.NEGATIVE, T.QUALIFY)
    fields = [c for c in own.columns if c != "text"]
    aligned = written(aligned.select(*fields, "facet", "score", "polarity"), "loop-aligned")
    one = facets.agg(F.min("facet")).first()[0]  # every passage has a row for each facet
    ledger, passages = aligned.where("score > 0"), aligned.where(F.col("facet") == one).select(*fields)
    queries = passages.select("query_id").distinct()
    begin = [F.lit(breadth).alias("k"), F.lit(None).cast("string").alias("source"), F.lit(policy).cast("string").alias("policy"), F.lit(None).cast("string").alias("preferred"), F.lit(min_grade).cast("double").alias("min_grade"), F.lit(since).cast("date").alias("timeframe")]
    scopes, held, done = queries.select("query_id", *begin), None, None
    for i in range(s.loops):
        seen = in_scope(passages, scopes).drop("rank")
        if held is not None:  # what a query has stays, once
            seen = seen.unionByName(held.join(scopes.select("query_id"), "query_id", "left_semi")).dropDuplicates(["query_id", "chunk_id"])
        seen = held = written(seen, "loop-passages")
        rows = ledger.join(seen.select("_row"), "_row", "left_semi")
        contrib = E.contributions(rows.select("query_id", "facet", F.col("parent").alias("doc_id"), "chunk_id", "score", "rerank", "grade", "polarity"))
        f = scopes.select("query_id").join(F.broadcast(facets)).join(E.coverage(contrib), ["query_id", "facet"], "left").join(E.lcb(contrib), ["query_id", "facet"], "left")
        f = f.fillna({"coverage": 0.0, "lcb": 0.0}).withColumn("entropy", S.entropy(F.col("coverage")))
        bundle = seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.count_if(F.col("weak")).alias("weak"))
        judged = E.decide(f, E.adjudicate(E.contradictions(rows)), bundle, i, s)
        judged = written(judged.select("query_id", F.lit(i).alias("iteration"), "action", "missing", "unresolved", "n"), "loop-judged")
        ended = judged.where("action <> 'RETRIEVE_MORE'").drop("unresolved")
        done = ended if done is None else done.unionByName(ended)
        scopes = written(next_scopes(judged, s, breadth, policy, min_grade, since), "loop-scopes")
        if not scopes.take(1):
            break
    return done


def naive(passages: DataFrame, k: int = 5, budget: int = Settings.token_budget) -> DataFrame:
    """The control: dense top-k within a token budget, always accepted."""
    r = top_k(passages, min(20, max(1, k)), "dense", "chunk_id")
    used = F.expr("sum(tokens) over (partition by query_id order by rank rows unbounded preceding)")
    return r.withColumn("used", used).where((F.col("used") <= budget) | (F.col("rank") == 1)).select("query_id", "rank", "chunk_id", F.lit("ACCEPT").alias("action"))
