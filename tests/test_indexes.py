"""Indexes at rest, generations, refresh, the scorer slot and streams that restart."""

import os
import random
import sqlite3
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from verisift.functions import porter
from verisift.operators import generations as G
from verisift.operators import ivf, lexical, postings, proximity, refresh, rerank
from verisift.streaming import events as Ev
from verisift.streaming import limiter


def vectors(spark, x, name="vec_id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], f"{name} long, embedding array<float>")


def mixture(rng, centres, n, spread=0.35):
    return centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, centres.shape[1]))


def neighbours(x, q, k):
    return np.argsort(-(ivf.unit(q) @ ivf.unit(x).T), axis=1)[:, :k]


def recall(got, best):
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    return sum(len(set(b.tolist()) & found.get(i, set())) for i, b in enumerate(best)) / best.size


# generations


def test_a_reader_keeps_its_generation(spark, tmp_path):
    root = str(tmp_path)
    put = lambda n: lambda folder: spark.range(n).write.parquet(f"{folder}/t") or {"rows": n}
    assert G.current(spark, root, "x") is None
    first = G.built(spark, root, "x", "c1", put(3))
    assert G.built(spark, root, "x", "c1", put(9)) == first

    def fails(folder):
        spark.range(5).write.parquet(f"{folder}/t")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        G.publish(spark, root, "x", "c2", fails)
    assert G.current(spark, root, "x") == first  # half a build is never seen
    second = G.publish(spark, root, "x", "c2", put(7))
    assert first.table(spark, "t").count() == 3 and second.table(spark, "t").count() == 7
    assert G.refreshed(spark, root, first) == second and G.refreshed(spark, root, second) is second
    assert (second.number, G.current(spark, root, "x", "c1")) == (2, first)


def test_a_changed_file_is_another_contract(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/t")
    one = G.files_contract(spark.read.parquet(f"{tmp_path}/t"), "k", 1)
    assert one == G.files_contract(spark.read.parquet(f"{tmp_path}/t"), "k", 1) != G.files_contract(spark.read.parquet(f"{tmp_path}/t"), "k", 2)
    time.sleep(0.01)
    spark.range(6).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    assert one != G.files_contract(spark.read.parquet(f"{tmp_path}/t"), "k", 1)


# inverted lists


def test_lists_find_vectors_that_are_not_in_the_table_and_read_little(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    x, q = mixture(rng, centres, 6000), mixture(rng, centres, 100)
    made = G.publish(spark, str(tmp_path), "ivf", "c", lambda folder: ivf.fill(vectors(spark, x), folder, parts=8))
    index = ivf.open_index(spark, made)
    assert index.table.count() == 6000
    asked = vectors(spark, q, "query_id")
    assert recall(ivf.search(index, asked, 10, block=33).collect(), neighbours(x, q, 10)) >= 0.95
    one = ivf.search(index, asked.where("query_id = 5"), 10)
    assert "PartitionFilters: [list_id" in one._jdf.queryExecution().toString() and one.count() == 10
    near = set(np.argsort(-(ivf.unit(q[5:6]) @ index.centroids.T))[0][: index.probes].tolist())
    size = {f: os.path.getsize(os.path.join(d, f)) * (int(d.split("list_id=")[1]) in near) for d, _, fs in os.walk(f"{made.folder}/lists") for f in fs if f.endswith(".parquet") and "list_id=" in d}
    whole = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{made.folder}/lists") for f in fs if f.endswith(".parquet"))
    assert sum(size.values()) < 0.2 * whole
    codes = sum(g.column(i).total_compressed_size for f in index.table.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for g in [m.row_group(0)] for i in range(g.num_columns) if g.column(i).path_in_schema == "codes")
    assert codes < 0.2 * whole  # the first pass reads ids and codes only


def test_all_lists_are_exact_and_an_empty_index_finds_nothing(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    x[17] = x[3]
    made = G.publish(spark, str(tmp_path), "ivf", "c", lambda folder: ivf.fill(vectors(spark, x), folder, lists=9, parts=4))
    index = ivf.open_index(spark, made)
    got = ivf.search(index, vectors(spark, x[:20], "query_id"), 5, probes=9, more=60).collect()
    assert recall(got, neighbours(x, x[:20], 5)) == 1.0 and {r.vec_id for r in got if r.query_id == 3 and r.rank <= 2} == {3, 17}
    none = G.publish(spark, str(tmp_path), "none", "c", lambda folder: ivf.fill(vectors(spark, x).limit(0), folder))
    assert ivf.search(ivf.open_index(spark, none), vectors(spark, x[:2], "query_id"), 5).count() == 0


# graphs


@pytest.mark.parametrize("kind", ["random", "clustered", "copies"])
def test_graphs_find_vectors_that_are_not_in_the_table(spark, tmp_path, kind):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 32))
    draw = (lambda n: rng.normal(size=(n, 32))) if kind == "random" else (lambda n: mixture(rng, centres, n))
    x, q = draw(5000), draw(60)
    if kind == "copies":
        x[1000:2500] = x[7]
    made = G.publish(spark, str(tmp_path), "graph", "c", lambda folder: proximity.fill(vectors(spark, x), folder, shard_rows=2000))
    assert made.facts["shards"] == 3
    got = proximity.search(spark, made, vectors(spark, q, "query_id"), 10, block=25).collect()
    best = neighbours(x, q, 10)
    least = np.take_along_axis(ivf.unit(q) @ ivf.unit(x).T, best[:, -1:], 1).ravel()
    assert sum(r.score >= least[r.query_id] - 2e-6 for r in got) >= 0.95 * best.size and len({(r.query_id, r.vec_id) for r in got}) == best.size


def test_a_beam_opens_what_it_must(spark):
    x = ivf.unit(np.random.default_rng(6).normal(size=(400, 8)))
    layers = proximity._layers(x, 8)
    assert [len(p) for p, _ in layers] == [400, 25]
    ids, scores = proximity.descend(x, layers, x[:50], 400)
    assert all(len(set(r[r >= 0].tolist())) == (r >= 0).sum() for r in ids)
    assert (ids[:, 0] == np.arange(50)).mean() > 0.98 and (np.diff(scores, axis=1)[:, :20] <= 0).all()
    assert proximity._layers(x[:1], 8)[0][1].tolist() == [[-1]]


# postings


def corpus(r, n):
    words = [f"w{i}" for i in range(60)]
    return [" ".join(r.choices(words, [1 / (i + 1) for i in range(60)], k=r.randint(0, 60))) or None for _ in range(n)]


def test_posting_blocks_give_what_a_scan_gives(spark, tmp_path):
    r = random.Random(2)
    docs = spark.createDataFrame(list(enumerate(corpus(r, 400))), "doc_id long, text string")
    terms = F.filter(F.split("text", " "), lambda w: w != "")
    made = G.publish(spark, str(tmp_path), "p", "c", lambda folder: postings.fill(docs, terms, folder, range_docs=16, shards=3))
    index = postings.open_index(spark, made)
    assert index.blocks.agg(F.max("n")).first()[0] <= 40  # a common term is in many blocks
    queries = spark.createDataFrame([(q, f"w{i}", w) for q in range(30) for i, w in {r.randint(0, 70): r.randint(1, 3) for _ in range(4)}.items()], "query_id long, term string, weight int")
    split = lambda t: t.split()
    show = lambda df: sorted((x.query_id, x.rank, x.doc_id, round(x.score, 6)) for x in df.collect())
    want = show(lexical.bm25_scan(docs, queries, split, 7, 1.2, 0.75))
    assert show(postings.search(index, queries, 7)) == want == show(postings.search(index, queries, 7, first=1, block=9))
    mean = postings.mean_idf(index)
    assert show(postings.search(index, queries, 7, floor=0.25 * mean)) == show(lexical.bm25_scan(docs, queries, split, 7, 1.2, 0.75, mean_idf=mean))
    only = docs.where("doc_id % 3 = 1").select("doc_id")
    every = [x for x in show(lexical.bm25_scan(docs, queries, split, 400, 1.2, 0.75)) if x[2] % 3 == 1]
    limited = {}
    for q, _, doc, score in every:
        limited.setdefault(q, []).append((doc, score))
    assert [(q, d, x) for q, _, d, x in show(postings.search(index, queries, 7, only=only))] == [(q, d, x) for q in sorted(limited) for d, x in limited[q][:7]]


def test_blocks_are_made_range_by_range(spark, tmp_path):
    r = random.Random(4)
    rows = [(i // 2 if i < 20 else i, f"{t or ''} runs running ran".strip()) for i, t in enumerate(corpus(r, 120))] + [(500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    terms = F.split("text", " ")
    postings.fill(docs, terms, f"{tmp_path}/a", shards=3, stem=porter.stem, range_terms=300)
    blocks = spark.read.parquet(f"{tmp_path}/a/blocks").collect()
    have = {}
    for x in blocks:
        assert x.n == len(x.docs) == len(set(x.docs)) and list(x.docs) == sorted(x.docs)
        for doc, tf in zip(x.docs, x.tf, strict=True):
            have[x.term, doc] = have.get((x.term, doc), 0) + tf
    want = {}
    for doc, text in rows:
        for w in (text or "").split():
            key = (porter.stem(w), doc)
            want[key] = want.get(key, 0) + 1
    assert have == want and have["run", rows[0][0]] > 1
    assert len({x.range for x in blocks}) > 5  # long texts are split over ranges by their terms


def test_bounds_spare_blocks(spark, tmp_path):
    # short texts first in score: their range decides, the long ones' bounds stay below
    texts = [f"rare a{i}" for i in range(40)] + ["rare " + " ".join(f"x{i} y{j}" for j in range(200)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = G.publish(spark, str(tmp_path), "p", "c", lambda folder: postings.fill(docs, F.split("text", " "), folder, range_docs=16))
    heads = postings.open_index(spark, made).blocks.where("term = 'rare'").select("range", "most", "docs").collect()
    short, long = [h for h in heads if max(h["docs"]) < 40], [h for h in heads if min(h["docs"]) >= 40]
    assert short and long and len(short) + len(long) == len(heads) and min(h["most"] for h in short) > 2 * max(h["most"] for h in long)


def test_empty_postings(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    made = G.publish(spark, str(tmp_path), "p", "c", lambda folder: postings.fill(docs, F.filter(F.split("text", " "), lambda w: w != ""), folder))
    queries = spark.createDataFrame([(1, "a", 1)], "query_id long, term string, weight int")
    assert postings.search(postings.open_index(spark, made), queries, 3).count() == 0
    assert postings.search(postings.open_index(spark, made), queries.limit(0), 3).count() == 0


def test_stems_are_those_of_a_full_text_index():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter')")
    db.execute("create virtual table v using fts5vocab(t, 'instance')")
    r = random.Random(1)
    ends = [*porter.STEP2, *porter.STEP3, *porter.STEP4, "ed", "ing", "s", "ies", "sses", "eed", "y", "ly", "ll", "e", ""]
    words = sorted({"".join(r.choice("aeioubcdlnrstyz") for _ in range(r.randint(1, 6))) + r.choice(ends) + r.choice([*ends, "", "", ""]) for _ in range(8000)} | {"caresses", "ponies", "relational", "hopping", "sky"})
    db.executemany("insert into t(rowid, x) values(?, ?)", list(enumerate(words)))
    got = dict(db.execute("select doc, term from v"))
    assert [(w, porter.stem(w)) for w in words] == [(w, got[i]) for i, w in enumerate(words)]


# refresh


def test_refresh_goes_on_where_it_failed(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}", "cur" if i % 3 else "old", "m1", 4, 4, [1.0, 0.0, 0.0, 0.0]) for i in range(60)], "chunk_id long, text string, embedding_space string, embedding_model string, embedding_dim int, embedding_size int, embedding array<float>")
    target, folder, calls = refresh.Target("cur", "m1", 4), str(tmp_path / "p"), str(tmp_path / "calls")

    def embed(texts):
        with open(calls, "a") as out:
            out.write("\n".join(texts) + "\n")
        return [[float(len(t)), 1.0, 2.0, 3.0] for t in texts]

    later = rows.where("chunk_id % 3 = 0 and pmod(xxhash64(chunk_id), 4) = 2").first().text  # in the third of four batches

    def breaks(texts):
        if later in texts:
            raise RuntimeError("provider down")
        return embed(texts)

    with pytest.raises(Exception, match="provider down"):
        refresh.refresh(rows, folder, target, breaks, batch_rows=5, call_rows=3)
    left = refresh.stale(rows, folder, target).count()
    assert 0 < left < 20
    assert refresh.refresh(rows, folder, target, embed, batch_rows=5)["updated"] == left
    assert refresh.refresh(rows, folder, target, embed)["stale"] == 0
    out = {r.chunk_id: r for r in refresh.merged(rows, folder, target).collect()}
    assert len(out) == 60 and all(r.embedding_space == "cur" for r in out.values())
    assert {i for i, r in out.items() if r.refreshed} == set(range(0, 60, 3)) and out[0].embedding == [6.0, 1.0, 2.0, 3.0] and out[1].embedding[0] == 1.0
    # a changed text makes its vector stale, and no other
    changed = refresh.merged(rows, folder, target).drop("refreshed").withColumn("embedded_content", refresh.content(F.col("text"))).withColumn("text", F.when(F.col("chunk_id") == 8, "new").otherwise(F.col("text")))
    assert [r.chunk_id for r in refresh.stale(changed, folder, target).collect()] == [8]
    with pytest.raises(Exception, match="blank"):
        refresh.refresh(changed.withColumn("text", F.lit(" ")).limit(1), folder, target, embed)
    with pytest.raises(Exception, match="vectors for"):
        refresh.refresh(changed, folder, target, lambda t: [])


# the scorer slot


def test_a_scorer_that_loses_or_doubles_results_leaves_the_first_order(spark):
    pool = spark.createDataFrame([(q, i, 1 - i / 10, f"{i}") for q in range(6) for i in range(4)], "query_id long, chunk_id long, dense double, text string")

    def scorer(query, passages):
        good = [{"index": i, "score": int(p) / 10 + 0.1} for i, p in enumerate(passages)]
        return {"0": good[::-1], "1": good[:-1], "2": [*good[:-1], good[0]], "3": [0.1, 0.2, 0.3, float("nan")], "4": [0.4, 0.1, 0.2, 0.3]}.get(query) or 1 / 0

    got = {}
    for r in rerank.rerank(pool, scorer, "v1").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id, r.version, r.p is None or np.isnan(r.p)))
    order = {q: [c for _, c, _, _ in sorted(x)] for q, x in got.items()}
    assert order == {0: [3, 2, 1, 0], 1: [0, 1, 2, 3], 2: [0, 1, 2, 3], 3: [0, 1, 2, 3], 4: [0, 3, 2, 1], 5: [0, 1, 2, 3]}
    assert {q: (x[0][2], x[0][3]) for q, x in got.items()} == {q: ("v1", False) if q in (0, 4) else (rerank.FAILED, True) for q in range(6)}
    assert rerank.calibrated({"logit": 0.0}, 2.0, 0.0) == 0.5 and rerank.calibrated({"score": 2.0}, 1.0, 0.0) == pytest.approx(1.0, abs=1e-5)


# streams


def test_a_batch_that_failed_is_not_doubled(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    kind = spark.createDataFrame([], schema).schema
    source = f"{tmp_path}/in"
    for i in range(3):
        spark.sql(f"select id as event_id, timestamp'2024-01-0{i + 1} 00:00:00' as ts, id % 3 as user_id, 'click' as event_type, 1.0D as value from range({i * 10}, {i * 10 + 10})").coalesce(1).write.parquet(f"{source}/f{i}")
    fail = {"now": True}
    base = f"{tmp_path}/base"

    def transform(df):
        if fail["now"] and df.where("event_id = 15").count():
            df.write.mode("overwrite").parquet(f"{base}/out/batch=1")  # written, then lost before the commit
            raise RuntimeError("executor lost")
        return df

    run = lambda contract: Ev.ingest_once(spark, f"{source}/*", kind, base, transform, contract, files=1)
    with pytest.raises(Exception, match="executor lost"):
        run({"v": 1})
    fail["now"] = False
    assert sorted(r.event_id for r in run({"v": 1}).collect()) == list(range(30))
    spark.sql("select 99L as event_id, timestamp'2024-02-01 00:00:00' as ts, 1L as user_id, 'x' as event_type, 1.0D as value").write.parquet(f"{source}/f9")
    assert run({"v": 1}).count() == 31
    with pytest.raises(ValueError, match="another contract"):
        run({"v": 2})


def test_limiter_state_goes_on_over_batches_and_restarts(spark, tmp_path):
    limiter.rocksdb_state(spark)
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    kind = spark.createDataFrame([], schema).schema
    rows = [(1, "error"), (2, "error"), (3, "ok"), (4, "error"), (5, "error"), (6, "error"), (7, "ok")]

    def run():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        limiter.limited(stream).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").start().awaitTermination()
        return {r.event_id: (r.run, r.delay, r.wait) for r in spark.read.schema(limiter.OUT).parquet(f"{tmp_path}/out").collect()}

    put = lambda n, part: spark.createDataFrame([(i, k) for i, k in part], "event_id long, event_type string").selectExpr("event_id", "timestamp_seconds(1700000000 + event_id) as ts", "1L as user_id", "event_type").coalesce(1).write.parquet(f"{tmp_path}/in/f{n}")
    put(1, rows[:2])
    assert run() == {1: (1, 1.0, 0.0), 2: (2, 2.0, 0.0)}
    put(2, rows[2:5])
    put(3, rows[5:])
    # the run of two goes on in the next start's state: a success ends it; waits come from the longest cooldown so far
    assert run() == {1: (1, 1.0, 0.0), 2: (2, 2.0, 0.0), 3: (0, 0.0, 1.0), 4: (1, 1.0, 0.0), 5: (2, 2.0, 0.0), 6: (3, 4.0, 1.0), 7: (0, 0.0, 3.0)}
