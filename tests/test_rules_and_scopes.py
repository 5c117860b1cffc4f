"""Ordered constraints on nested records, word budgets, hints and scopes as data."""

import json

import pytest
from pyspark.sql import functions as F

from verisift.config import Settings
from verisift.functions import text as X
from verisift.operators import constraints, pipeline, strategy

GOOD = {
    "chunk_id": "c1", "content": "some text", "embedding": [0.5, 1.25, -3.0], "embedding_model": "m", "embedding_dim": 3,
    "metadata": {"parent_id": "p", "source": "s", "task": "t", "sequence": 1, "total_chunks": 2, "content_type": "text", "related_chunks": ["c2"], "chunk_length": 9, "created_timestamp": "2024-01-01T00:00:00Z"},
}


def broken(path, value):
    r = json.loads(json.dumps(GOOD))
    at = r
    *way, last = path.split(".")
    for p in way:
        at = at[p]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return r


FAULTS = [
    (GOOD, None), (broken("content", ...), "top_fields"), (broken("embedding_dim", ...), "top_fields"), (broken("chunk_id", "  "), "chunk_id"), (broken("chunk_id", 7), "chunk_id"), (broken("content", ""), "content"),
    (broken("content", ["a"]), "content"), (broken("embedding", [0.5]), "embedding_size"), (broken("embedding", "0.5"), "embedding_size"), (broken("embedding", [1, 2, 3]), "embedding_values"),
    (broken("embedding", [0.5, None, 1.0]), "embedding_values"), (broken("embedding", ["a", "b", "c"]), "embedding_values"), (broken("metadata", []), "metadata"), (broken("embedding_model", 3), "embedding_model"),
    (broken("embedding_model", None), "embedding_model"), (broken("metadata.task", ...), "metadata_fields"), (broken("metadata.parent_id", " "), "parent_id"), (broken("metadata.source", 1), "source"),
    (broken("metadata.task", ""), "task"), (broken("metadata.sequence", 0), "sequence"), (broken("metadata.sequence", "1"), "sequence"), (broken("metadata.sequence", 1.5), "sequence"),
    (broken("metadata.total_chunks", -1), "total_chunks"), (broken("metadata.content_type", None), "content_type"), (broken("metadata.related_chunks", "c2"), "related_chunks"),
    (broken("metadata.related_chunks", ["c2", 3]), "related_chunks"), (broken("metadata.related_chunks", []), None), (broken("metadata.chunk_length", 0), "chunk_length"),
    (broken("metadata.created_timestamp", "soon"), "created_timestamp"), (broken("metadata.created_timestamp", 5), "created_timestamp"), ({}, "top_fields"), ([1], "top_fields"),
]


def test_the_first_failing_rule_of_every_kind(spark):
    rules = constraints.chunk_rules("r")
    assert len(rules) == 18
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(FAULTS)], "i int, j string").withColumn("r", F.parse_json("j"))
    got = {r.i: r for r in rows.select("i", constraints.first_failing(rules).alias("first"), constraints.failing(rules).alias("all")).collect()}
    assert [got[i].first for i in range(len(FAULTS))] == [want for _, want in FAULTS]
    order = [r.name for r in rules]
    for r in got.values():
        assert r.all == sorted(r.all, key=order.index) and (r.all[0] if r.all else None) == r.first
    # a dimension of 0 meets an empty vector, and is itself at fault
    both = {**GOOD, "embedding": [], "embedding_dim": 0}
    assert spark.createDataFrame([(json.dumps(both),)], "j string").select(F.parse_json("j").alias("r")).select(constraints.failing(rules).alias("x")).first().x == ["embedding_dim"]


def composed(title, abstract, body, total):
    """In plain steps: what the title, then the abstract, leave of the total."""
    parts, left, cut = [], max(0, total), lambda t, n: " ".join(t.split()[:n]) if n > 0 else ""
    t = cut(title, min(32, left))
    parts += [t] if t else []
    left -= len(t.split())
    if abstract.split() and left > 0:
        a = cut(abstract, min(max(64, total // 4), left))
        parts += ["Abstract", a]
        left -= len(a.split()) + 1
    if body.split() and left > 0:
        parts += ["Body excerpt", cut(body, left)]
    return "\n\n".join(parts)


@pytest.mark.parametrize("total", [-5, 0, 1, 31, 33, 60, 97, 98, 100, 256, 400, 2000])
def test_a_word_budget_of_any_size(spark, total):
    many = lambda x, n: " ".join(f"{x}{i}" for i in range(n))
    rows = [(many("t", a), many(" a", b), many("b\n", c)) for a in (0, 5, 40) for b in (0, 30, 300) for c in (0, 10, 500)] + [(None, " \n ", None)]
    df = spark.createDataFrame(rows, "t string, a string, b string")
    got = [r.x for r in df.select(X.compose(F.col("t"), F.col("a"), F.col("b"), F.lit(total)).alias("x")).collect()]
    assert got == [composed(t or "", a or "", b or "", total) for t, a, b in rows]


def test_hints_name_one_source_or_prefer_the_first(spark):
    f = ("guideline_concordance", "evidence_quality", "patient_applicability", "safety_contraindications")
    rows = [([], 0), ([f[0], f[1]], 0), ([f[2]], 0), ([f[2], f[3]], 0), ([f[3]], 2), ([], 1), ([f[1], f[2]], 0)]
    df = spark.createDataFrame(rows, "missing array<string>, unresolved int").select(strategy.hints(F.col("missing"), F.col("unresolved")).alias("h")).select("h.*")
    got = [(r.focus, r.exclusive, r.safety_search, r.relax_filters, r.expand_synonyms, r.routed_agent, r.agents) for r in df.collect()]
    assert got == [
        (None, False, False, False, False, None, []), ("CPG", True, False, False, True, "guideline", ["guideline", "quality"]), ("EMR", True, False, False, True, "emr", ["emr"]),
        ("EMR", False, True, True, True, "emr", ["emr", "safety"]), ("SAFETY", True, True, True, True, "safety", ["safety", "critic"]), (None, False, False, True, False, "critic", ["critic"]),
        ("CPG", False, False, False, True, "quality", ["quality", "emr"]),
    ]


def test_each_query_has_its_own_next_round(spark):
    passages = spark.createDataFrame(
        [(q, 10 * q + i, s, i / 10, g, d) for q in (1, 2, 3, 4) for i, (s, g, d) in enumerate([("CPG", 0.9, "2020-01-01"), ("EMR", 0.1, "2020-01-01"), ("SAFETY", 0.1, "2010-01-01"), ("LIT", 0.9, "2010-01-01"), ("EMR", 0.9, "2021-01-01")])],
        "query_id long, chunk_id long, source_type string, dense double, grade_score double, effective_date string",
    ).withColumn("effective_date", F.col("effective_date").cast("date"))
    judged = spark.createDataFrame(
        [(1, "RETRIEVE_MORE", ["patient_applicability"], 0), (2, "RETRIEVE_MORE", ["safety_contraindications", "guideline_concordance"], 0), (3, "ACCEPT", [], 0), (4, "RETRIEVE_MORE", [], 1)],
        "query_id long, action string, missing array<string>, unresolved long",
    )
    scopes = pipeline.next_scopes(judged, Settings(k=2, k_more=4), 2, min_grade=0.5, since="2015-01-01")
    got = {}
    for r in pipeline.in_scope(passages, scopes).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id % 10)
    # one: only its EMR rows, by grade and date; two: relaxed, guidelines first; three: done; four: relaxed, by score
    assert got == {1: [4], 2: [0, 4, 3, 2], 4: [4, 3, 2, 1]}
