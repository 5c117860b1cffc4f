"""Storage, integrity and statistics queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import dense
from ..operators import refresh as Refresh
from ..operators import storage as St
from ..operators.pipeline import _folder
from ..sources import tables as T
from .base import CHUNKS, Registry

query = Registry()
c = F.col


def n():
    return F.count(F.lit(1))



@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'benchmark', count(*) FROM benchmark UNION ALL SELECT 'labels', count(*) FROM labels")
def corpus_counts(s, d):
    one = lambda t: T.table(s, d, t).agg(F.lit(t).alias("name"), n().alias("n"))
    return one("documents").unionByName(one("benchmark")).unionByName(one("labels"))


@query("SELECT org_id, count(DISTINCT text) AS n_texts, count(DISTINCT doc_id) AS n_docs FROM chunks GROUP BY 1", CHUNKS)
def distinct_docs(s, d):
    return T.chunks(s, d).groupBy("org_id").agg(F.countDistinct(F.md5("text")).alias("n_texts"), F.countDistinct("doc_id").alias("n_docs"))


@query("SELECT source_type, count(*) AS n FROM chunks GROUP BY 1", CHUNKS)
def source_counts(s, d):
    return T.chunks(s, d).groupBy("source_type").agg(n().alias("n"))


@query("SELECT org_id, source_type, count(*) AS n FROM chunks GROUP BY ROLLUP (org_id, source_type)", CHUNKS)
def source_rollup(s, d):
    return T.chunks(s, d).rollup("org_id", "source_type").agg(n().alias("n"))


_HEX = "('0x' || substr(sha256(chunk_id::VARCHAR), {}, 15))::BIGINT"


@query(f"SELECT org_id, count(*) AS n, {', '.join(f'bit_xor({_HEX.format(1 + 15 * i)}) AS x{i}' for i in range(4))}, {', '.join(f'(sum({_HEX.format(1 + 15 * i)}::HUGEINT) % 1152921504606846976)::BIGINT AS s{i}' for i in range(4))} FROM chunks GROUP BY 1", CHUNKS)
def fingerprint_ids(s, d):
    return T.chunks(s, d).groupBy("org_id").agg(*St.fingerprint(c("chunk_id")))


@query("SELECT org_id, sha256(string_agg(h, chr(10) ORDER BY b)) AS signature FROM (SELECT org_id, b, sha256(string_agg(id, chr(10) ORDER BY id)) AS h FROM (SELECT org_id, chunk_id::VARCHAR AS id, chunk_id % 64 AS b FROM chunks) GROUP BY ALL) GROUP BY 1", CHUNKS)
def corpus_signature(s, d):
    ids = T.chunks(s, d).select("org_id", c("chunk_id").cast("string").alias("id"), (c("chunk_id") % 64).alias("b"))
    h = ids.groupBy("org_id", "b").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("id"))), 256).alias("h"))
    return h.groupBy("org_id").agg(F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"])), 256).alias("signature"))


@query("SELECT org_id, count(*) AS total, count(*) FILTER (embedding_dim > 0) AS embedded, count(*) FILTER (embedding_dim = 64 AND embedding_space = 'cur') AS active, count(*) FILTER (embedding_dim <> 64 OR embedding_space <> 'cur') AS stale, count(*) FILTER (source_type = 'SAFETY') AS safety, max(effective_date)::VARCHAR AS newest, count(*) > 0 AND count(*) FILTER (embedding_dim > 0) = 0 AS infrastructure_gap FROM chunks GROUP BY 1", CHUNKS)
def storage_stats(s, d):
    active = (c("embedding_dim") == 64) & (c("embedding_space") == "cur")
    some = F.count_if(c("embedding_dim") > 0)
    return T.chunks(s, d).groupBy("org_id").agg(n().alias("total"), some.alias("embedded"), F.count_if(active).alias("active"), F.count_if(~active).alias("stale"), F.count_if(c("source_type") == "SAFETY").alias("safety"), F.max("effective_date").cast("string").alias("newest"), ((n() > 0) & (some == 0)).alias("infrastructure_gap"))


@query("SELECT org_id, list_filter([CASE WHEN dup > 0 THEN 'duplicate_keys' END, CASE WHEN stale > 0 THEN 'stale_vectors' END, CASE WHEN empty > 0 THEN 'missing_vectors' END, CASE WHEN nopat > 0 THEN 'emr_without_patient' END], lambda x: x IS NOT NULL) AS issues FROM (SELECT org_id, count(*) - count(DISTINCT chunk_id) AS dup, count(*) FILTER (embedding_space <> 'cur') AS stale, count(*) FILTER (embedding_dim = 0) AS empty, count(*) FILTER (source_type = 'EMR' AND patient_id IS NULL) AS nopat FROM chunks GROUP BY 1)", CHUNKS)
def validate_storage(s, d):
    r = T.chunks(s, d).groupBy("org_id", "chunk_id").agg(n().alias("k"), F.count_if(c("embedding_space") != "cur").alias("stale"), F.count_if(c("embedding_dim") == 0).alias("empty"), F.count_if((c("source_type") == "EMR") & c("patient_id").isNull()).alias("nopat"))
    r = r.groupBy("org_id").agg(F.sum(c("k") - 1).alias("dup"), *[F.sum(x).alias(x) for x in ("stale", "empty", "nopat")])
    names = {"dup": "duplicate_keys", "stale": "stale_vectors", "empty": "missing_vectors", "nopat": "emr_without_patient"}
    return r.select("org_id", F.array_compact(F.array(*[F.when(c(k) > 0, F.lit(v)) for k, v in names.items()])).alias("issues"))


@query("SELECT org_id, chunk_id // 2 AS key, count(*) AS n FROM chunks GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT org_id, -1, count(*) - count(DISTINCT chunk_id) FROM chunks GROUP BY 1", CHUNKS)
def key_uniqueness(s, d):
    """Keys held more than once; -1 counts repeated ids."""
    ch = T.chunks(s, d)
    key = F.floor(c("chunk_id") / 2).cast("long")
    some = ch.groupBy("org_id", key.alias("key")).agg(n().alias("n")).where("n > 1")
    return some.unionByName(ch.groupBy("org_id").agg(F.lit(-1).cast("long").alias("key"), (n() - F.countDistinct("chunk_id")).alias("n")))


@query("SELECT org_id, min(chunk_id) = 0 AS starts, max(dense) = count(*) - 1 AND min(dense) = 0 AND count(DISTINCT dense) = count(*) AS contiguous, count(*) AS n, count(DISTINCT embedding_space) = 1 AS one_space, count(*) FILTER (source_type IN ('CPG', 'EMR', 'LIT', 'SAFETY')) = count(*) AS known_sources FROM (SELECT *, doc_id // 3 AS dense FROM chunks) GROUP BY 1", CHUNKS)
def verify_corpus(s, d):
    lab = F.floor(c("doc_id") / 3)
    ok = (F.max(lab) == n() - 1) & (F.min(lab) == 0) & (F.countDistinct(lab) == n())
    return T.chunks(s, d).groupBy("org_id").agg((F.min("chunk_id") == 0).alias("starts"), ok.alias("contiguous"), n().alias("n"), (F.countDistinct("embedding_space") == 1).alias("one_space"), (F.count_if(c("source_type").isin("CPG", "EMR", "LIT", "SAFETY")) == n()).alias("known_sources"))


@query("SELECT doc_id // 100 AS batch, count(DISTINCT doc_id) AS n, count(DISTINCT doc_id) = 100 AND min(doc_id) % 100 = 0 AS complete FROM documents GROUP BY 1")
def resume_prefix_check(s, d):
    """Batches of a resumed run that hold all of their ordinals."""
    r = T.table(s, d, "documents").groupBy(F.floor(c("doc_id") / 100).cast("long").alias("batch")).agg(F.countDistinct("doc_id").alias("n"), F.min("doc_id").alias("lo"))
    return r.select("batch", "n", ((c("n") == 100) & (c("lo") % 100 == 0)).alias("complete"))


@query("SELECT org_id, max(embedding_dim) = 64 AND min(embedding_dim) = 64 AS dim_ok, bool_and(embedding_space = 'cur') AS space_ok, count(*) FILTER (embedding_space = 'cur' AND embedding_dim = 64) AS indexable, count(*) FILTER (source_type = 'EMR') >= 10 AS context_ready FROM chunks GROUP BY 1", CHUNKS)
def index_provenance(s, d):
    return T.chunks(s, d).groupBy("org_id").agg(((F.max("embedding_dim") == 64) & (F.min("embedding_dim") == 64)).alias("dim_ok"), F.bool_and(c("embedding_space") == "cur").alias("space_ok"), F.count_if((c("embedding_space") == "cur") & (c("embedding_dim") == 64)).alias("indexable"), (F.count_if(c("source_type") == "EMR") >= 10).alias("context_ready"))


_OLDNEW = "o AS (SELECT org_id, chunk_id, 1 AS v, source FROM chunks WHERE doc_id % 3 <> 0), w AS (SELECT org_id, chunk_id, 2 AS v, 'new-' || source AS source FROM chunks WHERE doc_id % 2 = 0)"


def _old_new(s, d):
    ch = T.chunks(s, d)
    old = ch.where("doc_id % 3 <> 0").select("org_id", "chunk_id", F.lit(1).alias("v"), "source")
    return old, ch.where("doc_id % 2 = 0").select("org_id", "chunk_id", F.lit(2).alias("v"), F.concat(F.lit("new-"), "source").alias("source"))


@query("SELECT org_id, chunk_id, max(v) AS v, arg_max(source, v) AS source FROM (SELECT * FROM o UNION ALL SELECT * FROM w) GROUP BY ALL", f"{CHUNKS}, {_OLDNEW}")
def upsert_latest_wins(s, d):
    return St.upsert(*_old_new(s, d), ["org_id", "chunk_id"], "v")


@query("SELECT count(*) FILTER (k IS NOT NULL AND NOT had) AS inserted, count(*) FILTER (k IS NOT NULL AND had) AS skipped, count(*) FILTER (k IS NULL) AS failed FROM (SELECT CASE WHEN w.chunk_id % 10 <> 0 THEN w.chunk_id END AS k, w.chunk_id % 10 <> 0 AND o.chunk_id IS NOT NULL AS had FROM w LEFT JOIN o ON o.org_id = w.org_id AND o.chunk_id = w.chunk_id)", f"{CHUNKS}, {_OLDNEW}")
def insert_if_absent(s, d):
    old, new = _old_new(s, d)
    new = new.withColumn("chunk_id", F.when(c("chunk_id") % 10 != 0, c("chunk_id")))
    return St.insert_absent(old, new, ["org_id", "chunk_id"])[1]


@query("SELECT org_id, count(*) AS n FROM chunks WHERE org_id <> 'org1' GROUP BY 1", CHUNKS)
def delete_tenant(s, d):
    return T.chunks(s, d).where("org_id <> 'org1'").groupBy("org_id").agg(n().alias("n"))


@query("SELECT chunk_id, source_type FROM chunks WHERE org_id = 'org2' ORDER BY chunk_id LIMIT 50 OFFSET 20", CHUNKS)
def list_chunks_page(s, d):
    """A page of a listing: the limit is the operator's own."""
    return T.chunks(s, d).where("org_id = 'org2'").select("chunk_id", "source_type").orderBy("chunk_id").offset(20).limit(50)


@query("SELECT org_id, parent, min(chunk_id) AS first_chunk, count(*) AS n_chunks, arg_min(lang, chunk_id) AS lang, 'doc-' || parent AS title FROM (SELECT *, doc_id // 4 AS parent FROM chunks) GROUP BY ALL", CHUNKS)
def materialize_documents(s, d):
    p = F.floor(c("doc_id") / 4).cast("long")
    r = T.chunks(s, d).groupBy("org_id", p.alias("parent")).agg(F.min("chunk_id").alias("first_chunk"), n().alias("n_chunks"), F.min_by("lang", "chunk_id").alias("lang"))
    return r.withColumn("title", F.concat(F.lit("doc-"), c("parent").cast("string")))


@query("SELECT d.parent, d.org_id, list_sort(list(c.chunk_id)) AS chunks FROM (SELECT DISTINCT org_id, doc_id // 4 AS parent FROM chunks WHERE source_type = 'LIT') d JOIN (SELECT *, doc_id // 4 AS parent FROM chunks) c ON c.parent = d.parent AND c.org_id = d.org_id GROUP BY ALL", CHUNKS)
def doc_chunks(s, d):
    ch = T.chunks(s, d).withColumn("parent", F.floor(c("doc_id") / 4).cast("long"))
    want = ch.where("source_type = 'LIT'").select("org_id", "parent").distinct()
    return ch.join(want, ["org_id", "parent"], "left_semi").groupBy("parent", "org_id").agg(F.sort_array(F.collect_list("chunk_id")).alias("chunks"))


@query("SELECT source AS dataset, count(*) AS rows, coalesce(nullif(sum(n_chars)::BIGINT, 0), 1000) AS bytes, round(sum(n_chars) / 1048576.0, 6)::DOUBLE AS mb, CASE WHEN max(doc_id) % 2 = 0 THEN 'ready' ELSE 'not_processed' END AS status FROM documents GROUP BY 1")
def dataset_stats(s, d):
    r = T.table(s, d, "documents").groupBy(c("source").alias("dataset")).agg(n().alias("rows"), F.sum("n_chars").alias("b"), F.max("doc_id").alias("m"))
    status = r.where("m % 2 = 0").select(c("dataset").alias("ds"), F.lit("ready").alias("st"))
    j = r.join(status, c("dataset") == c("ds"), "left")
    return j.select("dataset", "rows", F.coalesce(F.when(c("b") != 0, c("b")), F.lit(1000)).alias("bytes"), F.round(c("b") / 1048576.0, 6).alias("mb"), F.coalesce("st", F.lit("not_processed")).alias("status"))


@query("SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS version, round(avg(value), 4) AS progress FROM events GROUP BY 1")
def ingestion_status(s, d):
    return T.table(s, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.max("event_id").alias("version"), F.round(F.avg("value"), 4).alias("progress"))


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events WHERE event_type = 'signup' OR event_type = 'click') WHERE r <= 5")
def sessions_recent_by_user(s, d):
    w = Window.partitionBy("user_id").orderBy(c("ts").desc(), "event_id")
    return T.table(s, d, "events").where(c("event_type").isin("signup", "click")).withColumn("r", F.row_number().over(w)).where("r <= 5").select("user_id", "event_id", "ts")


@query("SELECT user_id, count(*) AS n, max(ts) AS last, string_agg(event_type, '>' ORDER BY ts DESC, event_id) AS path FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 10 GROUP BY 1")
def traces_recent(s, d):
    w = Window.partitionBy("user_id").orderBy(c("ts").desc(), "event_id")
    r = T.table(s, d, "events").withColumn("r", F.row_number().over(w)).where("r <= 10")
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "event_type"))), lambda x: x["event_type"]), ">")
    return r.groupBy("user_id").agg(n().alias("n"), F.max("ts").alias("last"), path.alias("path"))


@query("SELECT event_type, count(*) AS requests, count(*) FILTER (event_type = 'error') AS limited, sum((props ->> '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1")
def rate_limit_totals(s, d):
    e = T.table(s, d, "events").select("event_type", F.from_json("props", "map<string,bigint>").alias("m"))
    flat = e.select("event_type", F.explode_outer("m").alias("key", "v"))
    return flat.groupBy("event_type").agg(n().alias("requests"), F.count_if(c("event_type") == "error").alias("limited"), F.sum("v").alias("k"))


_FRESH = "coalesce(embedding_size, 0) = 0 OR embedding_space <> 'cur' OR coalesce(embedding_model, '') <> 'm1' OR embedding_dim <> 64"


@query(f"SELECT chunk_id, CASE WHEN stale THEN 'cur' ELSE embedding_space END AS embedding_space, CASE WHEN stale THEN 'm1' ELSE embedding_model END AS embedding_model, CASE WHEN stale THEN 64 ELSE embedding_dim END AS embedding_dim, stale AS refreshed FROM (SELECT *, coalesce({_FRESH}, true) AS stale FROM chunks WHERE regexp_matches(text, '\\S'))", CHUNKS)
def refresh_embeddings(s, d):
    """Stale vectors embedded in batches into a patch table, and the table as it stands after it; a second run has nothing to do."""
    rows = T.chunks(s, d).where(F.col("text").rlike(r"\S"))
    folder, target = f"{_folder(s)}/refresh-{uuid.uuid4().hex}", Refresh.Target("cur", "m1", 64)
    Refresh.refresh(rows, folder, target, dense.embed_texts)
    if Refresh.refresh(rows, folder, target, dense.embed_texts)["stale"]:
        raise RuntimeError("rows are stale after a refresh")
    return Refresh.merged(rows, folder, target).select("chunk_id", "embedding_space", "embedding_model", "embedding_dim", "refreshed")
