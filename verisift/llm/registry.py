"""The thin queries over the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, clusters, decontaminate, html, lines, mixing, neardup, negatives, repeats, rules, secrets, sharding
from .common import stage, unstage
from .stats import labelled_sample, learn_lexicon


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    words = stage(secrets.corpus_words(docs), "secret-words")
    model = secrets.train(secrets.labelled_samples(spark, words).unionByName(secrets.ordinary(words)))
    unstage(words)
    return secrets.digest(secrets.scan(docs, model))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("th")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    runs = F.array_join(F.transform(F.coalesce("runs", F.array()), lambda r: F.concat_ws("+", r["first"].cast("string"), r["n"].cast("string"))), ",")
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", runs.alias("runs"), F.sha2("text", 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.fit(docs, _table(spark, sf_dir, "labels"))).drop("th")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    lexicon = learn_lexicon(labelled_sample(docs, labels, 4000))
    return classifier.classify(docs, lexicon).drop("th")


def op6_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_digest(_table(spark, sf_dir, "documents")).drop("th")


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(_table(spark, sf_dir, "documents")).drop("th")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents")).drop("th")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("th")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustering(_table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(_table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = bpe.coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), by), by)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_decontaminate, op3_line_dedup, op4_quality_rules, op5_quality_classifier,
        op6_repeat_removal, op7_hilbert_sharding, op8_near_dedup, op9_source_mixing, op10_html_extract,
        op11_centroid_clustering, op12_hard_negatives, op13_byte_bpe,
    )
}



def _lloyd_sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, salt: str = "3:") -> str:
    """The rounds written one after the other."""
    far = "list_dot_product(v.e, v.e) - 2 * list_dot_product(v.e, c.c) + list_dot_product(c.c, c.c)"
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id)) - 1 AS j, e AS c FROM v ORDER BY j LIMIT {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(e) AS e, min({{'d': d, 'j': j}}) AS best FROM (SELECT v.vec_id, v.e, c.j, {far} AS d FROM v, c{r} c) GROUP BY vec_id)")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN (SELECT j, list(floor(s / n) ORDER BY i) AS c FROM (
  SELECT best.j AS j, i, sum(e[i]) AS s, count(*) AS n FROM a{r}, range(1, {dim + 1}) AS t(i) GROUP BY ALL) GROUP BY j) m USING (j))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, a.best.j::INT AS cluster, a.best.d::BIGINT AS distance, sum(a.best.d) OVER (PARTITION BY a.best.j)::BIGINT AS cluster_inertia, sum(a.best.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c.c, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.j = a.best.j"""


ORACLE_SQL: dict[str, str] = {
    "op11_centroid_clustering": _lloyd_sql(),
    "op12_hard_negatives": """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM s WHERE same) WHERE n <= 5),
f AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM f WHERE rank <= 3
""",
    "op3_line_dedup": r"""
WITH all_lines AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS j FROM documents),
worded AS (
  SELECT doc_id, j, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS m
  FROM all_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
suffixes AS (
  SELECT doc_id, i, m, w, line AS a, lead(line) OVER s AS b, lead(line, 2) OVER s AS c, w + lead(w) OVER s AS w2 FROM worded WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
starts AS (
  SELECT doc_id, i, 3 AS n FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS n FROM suffixes WHERE c IS NOT NULL) WHERE n > 1
  UNION ALL
  SELECT doc_id, i, 2 FROM (
    SELECT doc_id, i, m, w2, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, i) AS n FROM suffixes WHERE b IS NOT NULL) WHERE n > 1 AND (w2 >= 50 OR m = 2)
  UNION ALL
  SELECT doc_id, i, 1 FROM (
    SELECT doc_id, i, m, w, row_number() OVER (PARTITION BY a ORDER BY doc_id, i) AS n FROM suffixes) WHERE n > 1 AND (w >= 50 OR m = 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM starts),
runs AS (
  SELECT doc_id, min(i) AS first, count(*) AS n FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM gone) GROUP BY doc_id, g),
run_list AS (SELECT doc_id, count(*) AS n_runs, sum(n)::BIGINT AS n_removed, string_agg(first || '+' || n, ',' ORDER BY first) AS runs FROM runs GROUP BY doc_id),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.j) AS text FROM all_lines l
  LEFT JOIN worded w ON w.doc_id = l.doc_id AND w.j = l.j LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i WHERE g.i IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
       coalesce(r.n_removed, 0)::BIGINT AS n_removed, coalesce(r.n_runs, 0)::BIGINT AS n_runs, coalesce(r.runs, '') AS runs, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN run_list r USING (doc_id) LEFT JOIN kept k USING (doc_id)
""",
}
