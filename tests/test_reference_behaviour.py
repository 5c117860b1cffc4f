"""Literal rows with known results, and properties that hold for any input."""

import hashlib
import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verisift.config import DEFAULT_FACETS, Settings, Weights
from verisift.functions import scores as S
from verisift.functions import text as X
from verisift.operators import chunking, dense, evidence, lexical, metrics, selection, storage
from verisift.operators.filters import Scope
from verisift.sources import files
from verisift.streaming import events as Ev
from verisift.streaming import limiter

REDACTED = [
    ("Patient ID: ABC1234, DOB: 01/02/1970, call +1 555 123 4567 or test@example.com", "[REDACTED_PATIENT_ID], [REDACTED_DOB], call +[REDACTED_PHONE] or [REDACTED_EMAIL]"),
    ("MRN: XYZZY99 needs review", "[REDACTED_PATIENT_ID] needs review"),
    ("Été. patient élevé 1234-5678-9012 a@b.com é", "Été. patient élevé [REDACTED_PHONE] [REDACTED_EMAIL] é"),
    ("Medicare #A1-22BB; date of birth 1-2-70", "[REDACTED_PATIENT_ID]; [REDACTED_DOB]"),
    ("no identifiers; avoid adverse risk in allergy", "no identifiers; avoid adverse risk in allergy"),
    ("ring +44 20 7946 0958 or (02) 9123 4567.", "ring +[REDACTED_PHONE] or ([REDACTED_PHONE]."),
    ("MRN-12345, DOB# 1/2/70, mrn 77A2", "[REDACTED_PATIENT_ID], [REDACTED_DOB], [REDACTED_PATIENT_ID]"),
    ("patient continued therapy; patient id ZZ-9 9", "[REDACTED_PATIENT_ID] therapy; [REDACTED_PATIENT_ID] 9"),
]


def one(spark, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols))


def test_redaction(spark):
    rows = spark.createDataFrame(REDACTED, "t string, want string").withColumn("got", X.redact(F.col("t"))).withColumn("again", X.redact(F.col("got")))
    for r in rows.collect():
        assert r.got == r.want == r.again


def test_nested_redaction(spark):
    df = spark.sql("select named_struct('query', 'mail a@b.com', 'items', array(named_struct('m', map('k', 'MRN: QQ1234')))) as p")
    got = df.select(X.redact_nested(F.col("p"), df.schema["p"].dataType).alias("p")).first().p
    assert got.query == "mail [REDACTED_EMAIL]" and got["items"][0].m["k"] == "[REDACTED_PATIENT_ID]"


def test_reference_tail(spark):
    for head in ("Acknowledgments of help", "appendix", "AUTHOR CONTRIBUTION", "Bibliography"):
        assert one(spark, t=f" body\n\n\n\ntext \n{head}\n1. x").select(X.strip_reference_tail(F.col("t"))).first()[0] == "body\n\ntext"
    assert one(spark, t="body text\nReferences\n1. x\nAppendix").select(X.strip_reference_tail(F.col("t"))).first()[0] == "body text"


def test_fusion_orders_and_stays_bounded(spark):
    rows = spark.createDataFrame([("high", 0.95, 0.9), ("low", 0.20, 0.1), ("none", None, None), ("zero", 0.0, 0.0)], "id string, p double, dense double")
    z = F.lit(0.5)
    got = {r.id: r.f for r in rows.select("id", S.fusion(F.col("p"), F.col("dense"), F.lit(None).cast("double"), z, z, z, z, z, F.lit(0.0)).alias("f")).collect()}
    assert got["high"] > got["none"] > got["low"] and got["none"] == got["zero"] and all(0 <= v <= 1 for v in got.values())


def test_grades(spark):
    rows = spark.createDataFrame([("CPG", None), ("LIT", "systematic review"), ("LIT", "rct"), ("LIT", "observational"), ("LIT", "case report"), ("EMR", ""), ("SAFETY", ""), ("LIT", "")], "s string, d string")
    assert [r[0] for r in rows.select(S.evidence_grade(F.col("s"), F.col("d"))).collect()] == [0.95, 0.90, 0.86, 0.62, 0.38, 0.70, 0.88, 0.568]
    rows = spark.createDataFrame([("LIT", "cohort", None), ("LIT", "case report", 0.95), ("WEB", "", None), ("LIT", "clinical trial", 1.4), ("EMR", "guideline", None)], "s string, d string, g double")
    assert [r[0] for r in rows.select(S.evidence_grade(F.col("s"), F.col("d"), F.col("g"))).collect()] == [0.568, 0.95, 0.5, 1.0, 0.95]


def test_cosine_guards(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0], [1.0, 0.0], 0.0), ([], [], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([0.6, 0.8], [0.8, 0.6], 0.96)], "a array<double>, b array<double>, want double")
    for r in rows.withColumn("got", S.cosine(F.col("a"), F.col("b"))).collect():
        assert r.got == pytest.approx(r.want)


def test_headings_make_sections():
    text = "Dosing\n\nTake one tablet daily with food.\n\nWarnings\n\nAvoid in renal failure."
    got = chunking.section_chunks(text)
    assert [g[0] for g in got] == ["Dosing", "Warnings"] and got[-1][3] == len(text)
    assert chunking.section_chunks("") == [] and chunking.section_chunks(None) == []


@given(st.integers(1, 2000))
def test_windows_overlap(n):
    words = [f"w{i}" for i in range(n)]
    got = chunking.section_chunks(" ".join(words) + ".")
    assert all(len(g[1].split()) <= 450 for g in got)
    joined = got[0][1].split()
    for g in got[1:]:
        assert joined[-40:] == g[1].split()[:40]
        joined += g[1].split()[40:]
    assert joined == [*words[:-1], words[-1] + "."]


@given(st.text("ab. !?", max_size=300), st.integers(1, 9))
def test_packed_sentences_keep_all_words(text, limit):
    parts = chunking.packed_sentences(text, limit)
    assert " ".join(parts).split() == text.split() and all(len(p.split()) <= limit for p in parts)


def test_shrink_and_dialogue():
    got = chunking.shrink({"q": "a " * 300, "a": "b " * 200}, 400)
    assert sum(len(v.split()) for v in got.values()) <= 400
    assert [s for s, _ in chunking.dialogue_parts("q " * 10, "", "a " * 10)] == ["single"]
    assert {s for s, _ in chunking.dialogue_parts("q. " * 500, "", "a " * 10)} == {"input_split"}
    assert {s for s, _ in chunking.dialogue_parts("q " * 10, "", "a. " * 500)} == {"output_split"}
    assert {s for s, _ in chunking.dialogue_parts("q. " * 300, "", "a. " * 300)} == {"both_split"}


def passage(i, source="LIT", tokens=50, fusion=0.5, safety=0.0, contradiction=0.0, facets=None, words=None, doc=None):
    return selection.Passage(i, i if doc is None else doc, source, frozenset(words or {f"w{i}"}), tokens, fusion, safety, 0.5, contradiction, 0.0, facets or {})


def test_selection_protects_safety_and_sources():
    pool = [passage(1, "CPG", fusion=0.9, words={"a", "b"}), passage(2, "CPG", fusion=0.89, words={"a", "b"}, doc=1), passage(3, "SAFETY", fusion=0.2, safety=0.64)]
    assert 3 in {p.chunk_id for p in selection.select(pool, {}, budget=200, most=2)}
    pool = [passage(1, "EMR", fusion=0.92), passage(2, "LIT", fusion=0.64), passage(3, "CPG", fusion=0.9, words={"x"})]
    assert {p.source for p in selection.select(pool, {}, ("EMR", "LIT"), budget=100, most=1)} >= {"EMR", "LIT"}
    assert selection.select([], {}) == []


@given(st.lists(st.tuples(st.integers(1, 400), st.floats(0, 1), st.floats(0, 0.4)), min_size=1, max_size=12))
def test_selection_keeps_the_budget(items):
    pool = [passage(i, tokens=t, fusion=f, safety=s) for i, (t, f, s) in enumerate(items)]
    chosen = selection.select(pool, {}, budget=600)
    assert sum(p.tokens for p in chosen) <= 600 and len(chosen) <= 10
    packed = selection.pack(pool, {}, budget=300)
    assert packed and (len(packed) == 1 or sum(p.tokens for p in packed) <= 300)


def test_bootstrap_bound():
    assert evidence.bootstrap_lcb([]) == 0 and evidence.bootstrap_lcb([0.5]) == pytest.approx(0.42)
    r, values = random.Random(42), [0.2, 0.5, 0.7]
    found = []
    for _ in range(64):
        p = 1.0
        for _ in values:
            p *= 1 - values[r.randrange(3)]
        found.append(1 - p)
    assert evidence.bootstrap_lcb(values) == pytest.approx(sorted(found)[3])


def gate(spark, lcb, polarity=("SUPPORTS", "SUPPORTS"), grades=(0.95, 0.9), weak=0, iteration=0):
    f = spark.createDataFrame([(1, "safety_contraindications", True, 0.55, lcb, 0.2)], "query_id int, facet string, required boolean, threshold double, lcb double, entropy double")
    rows = spark.createDataFrame([(1, "f", i, p, g) for i, (p, g) in enumerate(zip(polarity, grades, strict=True))], "query_id int, facet string, chunk_id int, polarity string, grade double")
    b = spark.createDataFrame([(1, 2, 100, weak)], "query_id int, n int, tokens int, weak int")
    return evidence.decide(f, evidence.adjudicate(evidence.contradictions(rows)), b, iteration).first()


def test_gate(spark):
    assert gate(spark, 0.9).action == "ACCEPT"
    short = gate(spark, 0.1)
    assert short.action == "RETRIEVE_MORE" and short.missing == ["safety_contraindications"]
    assert gate(spark, 0.1, iteration=2).action == "INSUFFICIENT"
    clash = gate(spark, 0.9, ("SUPPORTS", "CONTRADICTS"))
    assert clash.unresolved_high == 1 and clash.action == "RETRIEVE_MORE"
    assert gate(spark, 0.9, ("SUPPORTS", "CONTRADICTS"), (0.7, 0.38)).unresolved == 0
    assert gate(spark, 0.9, weak=1).action == "INSUFFICIENT"


def test_ranking_metrics(spark):
    q = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "case_id int, doc_id int, grade int")
    ranks = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "case_id int, doc_id int, rank int")
    m = metrics.ranking_metrics(ranks, q).first()
    assert (m.ndcg, m.precision, m.recall, m.rr) == (1.0, 0.2, 1.0, 1.0)
    back = spark.createDataFrame([(1, 2, 1), (1, 1, 2), (2, 9, 1)], "case_id int, doc_id int, rank int")
    got = {r.case_id: r for r in metrics.ranking_metrics(back, q).collect()}
    assert got[1].ndcg < 1 and got[2].ndcg == got[2].recall == 1.0


def test_fingerprints_ignore_order(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    same = spark.createDataFrame([("c",), ("a",), ("b",)], "id string").repartition(3)
    twice = ids.union(ids.limit(1))
    assert storage.fingerprint_256(ids, "id") == storage.fingerprint_256(same, "id") != storage.fingerprint_256(twice, "id")
    assert ids.agg(*storage.fingerprint(F.col("id"))).first() == same.agg(*storage.fingerprint(F.col("id"))).first()
    with pytest.raises(Exception):
        storage.fingerprint_256(spark.createDataFrame([("",)], "id string"), "id")


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(2, 2, "c"), (3, 2, "d")], "k int, v int, x string")
    assert sorted(map(tuple, storage.upsert(old, new, ["k"], "v").collect())) == [(1, 1, "a"), (2, 2, "c"), (3, 2, "d")]
    rows, counts = storage.insert_absent(old, new.union(spark.createDataFrame([(None, 3, "e")], "k int, v int, x string")), ["k"])
    assert [r.k for r in rows.collect()] == [3] and tuple(counts.first()) == (1, 1, 1)


def test_scopes_push_down(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("chunk_id"), F.lit("org1").alias("org_id"), F.lit("LIT").alias("source_type"), F.lit("t").alias("text")).write.parquet(f"{tmp_path}/c")
    plan = spark.read.parquet(f"{tmp_path}/c").where(Scope("org1", policy="LIT_ONLY").column()).select("chunk_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(org_id), IsNotNull(source_type), EqualTo(org_id,org1), EqualTo(source_type,LIT)]" in plan and "text" not in plan.split("ReadSchema")[1]


def test_json_lines(spark, tmp_path):
    (tmp_path / "cases.jsonl").write_text('{"case_id": "1", "query": "q", "gold_doc_ids": ["a"]}\n\n{"case_id": \nnot json\n')
    good, bad = files.jsonl(spark, str(tmp_path / "cases.jsonl"))
    assert [r.case_id for r in good.collect()] == ["1"] and bad.count() == 2
    files.write_jsonl(good, str(tmp_path / "out"))
    assert files.jsonl(spark, str(tmp_path / "out"))[0].count() == 1


def test_uploads(spark, tmp_path):
    (tmp_path / "a.csv").write_text("q,a\n1,x\n")
    assert files.upload(spark, str(tmp_path / "a.csv"), 10).first().a == "x"
    for name, size in (("a.exe", 1), ("a.csv", 1 << 30), ("a.pdf", 1)):
        with pytest.raises(ValueError):
            files.upload(spark, str(tmp_path / name), size)


def test_changed_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in "ab":
        (tmp_path / "in" / f"{n}.csv").write_text(n)
    state = files.file_state(spark, str(tmp_path / "in"))
    state.write.parquet(str(tmp_path / "state"))
    before = spark.read.parquet(str(tmp_path / "state"))
    assert files.changed(files.file_state(spark, str(tmp_path / "in")), before).count() == 0
    (tmp_path / "in" / "b.csv").write_text("changed")
    (tmp_path / "in" / "c.csv").write_text("new")
    assert {r.path[-5:] for r in files.changed(files.file_state(spark, str(tmp_path / "in")), before).collect()} == {"b.csv", "c.csv"}



def test_bm25_scan_equals_joins(spark):
    r = random.Random(3)
    vocab = [f"t{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(r.choice(vocab[: 1 + i % 30]) for _ in range(r.randint(0, 40)))) for i in range(80)], "doc_id long, text string")
    asked = [(q, t, 1) for q in range(6) for t in {r.choice(vocab) for _ in range(5)}]
    queries = spark.createDataFrame(asked, "query_id long, term string, weight int")
    joined = {(x.query_id, x.doc_id): x.score for x in lexical.top_k(lexical.bm25(docs, queries, X.tokens(F.col("text")), 1.2, 0.75).withColumn("score", F.round("score", 9)), 7).collect()}
    scanned = {(x.query_id, x.doc_id): x.score for x in lexical.bm25_scan(docs, queries, lambda t: t.lower().split(), 7, 1.2, 0.75, block=4).collect()}
    assert scanned.keys() == joined.keys() and all(scanned[k] == pytest.approx(v, abs=1e-8) for k, v in joined.items())


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 0{i % 9}:10:00", i % 4, "error" if i % 3 else "click", float(i)) for i in range(60)]
    ev = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.repartition(4).write.parquet(f"{tmp_path}/in")
    out = []
    sink = lambda df, _: out.extend(map(tuple, Ev.windows(df, "1 day").select("event_type", "n", "total").collect()))
    Ev.ingest(spark, f"{tmp_path}/in", ev.schema, f"{tmp_path}/state", sink)
    Ev.ingest(spark, f"{tmp_path}/in", ev.schema, f"{tmp_path}/state", sink)  # nothing is left to read
    assert sorted(out) == sorted(map(tuple, Ev.windows(ev, "1 day").select("event_type", "n", "total").collect()))


def test_limiter_state(spark, tmp_path):
    kinds = ["error", "error", "click", "error", "click", *["error"] * 9]
    ev = spark.createDataFrame([(i, "2024-01-01 00:00:00", 1, k) for i, k in enumerate(kinds)], "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.coalesce(1).write.parquet(f"{tmp_path}/in")
    limiter.rocksdb_state(spark)
    stream = spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/in")
    q = limiter.limited(stream).writeStream.format("memory").queryName("limits").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    q.awaitTermination()
    got = [(r.run, r.delay) for r in spark.table("limits").orderBy("event_id").collect()]
    assert got == [(1, 1.0), (2, 2.0), (0, 0.0), (1, 1.0), (0, 0.0), *[(n, min(60.0, 2.0 ** (n - 1))) for n in range(1, 10)]]


def test_settings_are_checked():
    with pytest.raises(ValueError):
        Weights(rerank=3.0)
    with pytest.raises(ValueError):
        Settings(protect=1.5)
    assert len(DEFAULT_FACETS) == 4 and Weights().clip == 8


def test_platt_is_identity_by_default(spark):
    got = one(spark, p=0.3).select(S.calibrate(F.col("p")), S.calibrate(F.col("p"), 0.0, 0.0), S.calibrate(F.lit(1.0))).first()
    assert got[0] == pytest.approx(0.3) and got[1] == pytest.approx(0.3) and got[2] < 1


def test_decisions(spark):
    from verisift.operators import strategy as D

    lit = F.lit
    row = spark.range(1).select(
        D.ingestion_strategy(lit("complete_dialogue"), lit(10), lit(100_001)).alias("a"), D.ingestion_strategy(lit("answer_part1"), lit(199), lit(5)).alias("b"), D.ingestion_strategy(lit("question_part1"), lit(200), lit(5)).alias("c"),
        D.retrieval_strategy(lit(51), lit(True), lit(False), lit("speed")).alias("d"), D.retrieval_strategy(lit(4), lit(False), lit(True), lit("accuracy")).alias("e"),
        D.should_rebuild(lit(True), lit(19), lit(100)).alias("f"), D.should_rebuild(lit(True), lit(1), lit(0)).alias("g"), D.should_rebuild(lit(False), lit(0), lit(9)).alias("h"),
        D.canonical_facet(lit(" contraindication of x ")).alias("i"), D.canonical_facet(lit("guideline"), ("evidence_quality",)).alias("j"), D.canonical_facet(lit(None).cast("string")).alias("k"),
        D.expand_query(lit("Metformin"), F.array(lit("safety_risk"))).alias("l"), D.expand_query(lit("plain"), F.expr("cast(array() as array<string>)")).alias("m"),
        D.scope_key(lit("o"), lit(None).cast("string"), lit("p1"), lit(None).cast("string")).alias("n"),
        D.concurrency_plan(lit("naive_rag"), lit(9), lit(3)).alias("o"), D.concurrency_plan(lit("full"), lit(9), lit(3)).alias("p"), D.concurrency_plan(lit("full"), lit(0), lit(None).cast("int")).alias("q"),
        D.readiness_error(lit(None).cast("boolean"), lit(1), lit(1)).alias("r"), D.readiness_error(lit(True), lit(12), lit(0)).alias("s"), D.readiness_error(lit(True), lit(0), lit(0)).alias("t"),
    ).first()
    assert tuple(row[:8]) == ("faiss_only", "tree_only", "hnsw_faiss", "faiss_only", "tree_only", False, True, True)
    assert tuple(row[8:13]) == ("safety_contraindications", "guideline", "clinical_evidence", "Metformin biguanide glucophage risk safety", "plain")
    key = hashlib.sha256(json.dumps({"org_id": "o", "source": None, "patient_id": "p1", "constraints": {}, "space": "local"}, sort_keys=True).encode()).hexdigest()[:16]
    assert row.n == f"o_{key}"
    assert (tuple(row.o), tuple(row.p), tuple(row.q)) == ((0, 9, 4), (3, 3, 4), (1, 1, 1))
    assert tuple(row[17:]) == ("unavailable", "no_embeddings", None)


def test_hints_change_the_next_round(spark):
    from verisift.operators import strategy as D

    def h(focus, exclusive, safety, relax, review, more, top_k=None, policy=None):
        b = lambda x: F.lit(x)
        e = D.apply_hints(F.lit(focus).cast("string"), b(exclusive), b(safety), b(relax), b(review), b(more), F.lit(top_k).cast("int"), F.lit(policy).cast("string"), F.lit(0.5))
        return spark.range(1).select(e.alias("h")).first().h.asDict()

    assert h("safety", True, True, False, False, False) == {"k": 80, "source": "SAFETY", "policy": "SAFETY_ONLY", "preferred": None, "safety_search": True, "min_grade": 0.5, "relaxed": False, "review": False}
    assert h("web", True, False, True, True, False, 30, "LIT_ONLY") == {"k": 120, "source": None, "policy": "LIT_ONLY", "preferred": None, "safety_search": False, "min_grade": None, "relaxed": True, "review": True}
    got = h("cpg", False, True, False, False, True, 30)
    assert (got["k"], got["preferred"], got["policy"]) == (120, "CPG", "ANY")


def test_large_files_are_hashed_by_splits(spark, tmp_path):
    import hashlib
    import random

    rng = random.Random(3)
    data = rng.randbytes(20_000)
    others = {"same": data, "byte": data[:9000] + bytes([data[9000] ^ 1]) + data[9001:], "end": data + b"\n", "swap": b"\n".join(reversed(data.split(b"\n"))), "s mall+%41": data[:900]}
    (tmp_path / "x").mkdir()
    for name, content in others.items():
        (tmp_path / "x" / f"{name}.csv").write_bytes(content)
    seen = []
    for size in ("700b", "128m"):
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = files.file_state(spark, str(tmp_path / "x"), whole=1000).collect()
            plain = files.file_state(spark, str(tmp_path / "x")).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert sorted((r.path, r.mtime) for r in rows) == sorted((r.path, r.mtime) for r in plain)
        seen.append({r.path.rsplit("/", 1)[1]: r.hash for r in rows})
    assert seen[0] == seen[1] and len(seen[0]) == len(set(seen[0].values())) == 5
    assert seen[0]["s mall+%41.csv"] == hashlib.md5(others["s mall+%41"]).hexdigest()
    assert {r.path.rsplit("/", 1)[1][:-4]: r.hash for r in plain} == {n: hashlib.md5(x).hexdigest() for n, x in others.items()}


def test_the_loop_aligns_each_passage_once(spark, monkeypatch):
    from verisift.config import Settings
    from verisift.operators import pipeline
    from verisift.plans import evidence
    from verisift.sources import tables

    asked, tabled = [], []
    align, written = pipeline.E.align, pipeline.written
    monkeypatch.setattr(pipeline.E, "align", lambda *a: asked.append(1) or align(*a))
    monkeypatch.setattr(pipeline, "written", lambda df, name, *by: tabled.append(df.columns) or written(df, name, *by))
    got = pipeline.sufficiency(evidence.passages(spark, "/root/testdata/sf0.001"), tables.facets(spark), Settings())
    assert got.select("query_id").distinct().count() == got.count() > 0
    assert len(asked) == 1 and len(tabled) > 3 and not any("text" in c for c in tabled)
