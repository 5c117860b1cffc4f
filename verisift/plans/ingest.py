"""Ingest, text and dialogue queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import constraints as Con
from ..operators import chunking
from ..sources import files
from ..sources import tables as T
from .base import CHUNKS, Registry

query = Registry()
c = F.col
_W = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"
W = _W.format("text")


@query(f"SELECT doc_id, array_to_string({W}[1:900], ' ') AS head, CASE WHEN len({W}) > 20 THEN array_to_string({W}[1:20], ' ') || '...' ELSE array_to_string({W}, ' ') END AS brief FROM documents")
def first_words(s, d):
    return T.table(s, d, "documents").select("doc_id", X.first_words(c("text"), 900).alias("head"), X.first_words_marked(c("text"), 20).alias("brief"))


@query("SELECT item_id, list_distinct_ordered AS terms FROM (SELECT item_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:64] AS list_distinct_ordered FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_.+/-]*') AS l FROM benchmark))")
def fts_query_terms(s, d):
    return T.table(s, d, "benchmark").select("item_id", X.fts_terms(c("text")).alias("terms"))


def _red(x: str) -> str:
    x = rf"regexp_replace({x}, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b', '[REDACTED_EMAIL]', 'g')"
    x = rf"regexp_replace({x}, '\b\+?\d[\d .()-]{{7,}}\d\b', '[REDACTED_PHONE]', 'g')"
    x = rf"regexp_replace({x}, '\b(MRN|patient\s+id|patient|medicare)\s*[:#-]?\s*[A-Z0-9-]{{4,}}\b', '[REDACTED_PATIENT_ID]', 'gi')"
    return rf"regexp_replace({x}, '\b(DOB|date of birth)\s*[:#-]?\s*\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b', '[REDACTED_DOB]', 'gi')"


# Identifiers in the forms that letters use, one a document, before its own text.
_IDS = ("call +44 20 7946 0958 or (02) 9123 4567", "MRN-12345 seen", "DOB# 1/2/70", "Patient ID: ABC1234, DOB: 01/02/1970", "medicare 2222-33333-1", "a.b@c.org wrote", "Date of Birth: 3-4-1999; patient id#XY-9987", "no identifier")
_NOTE = "(['" + "','".join(_IDS) + "'])[doc_id % 8 + 1] || ' ' || text"


def _note():
    return F.concat(F.element_at(F.array(*map(F.lit, _IDS)), (c("doc_id") % 8 + 1).cast("int")), F.lit(" "), c("text"))


@query(f"SELECT doc_id, md5({_red(_NOTE)}) AS redacted_md5, {_red('text')} <> text AS changed FROM documents")
def redact_phi(s, d):
    return T.table(s, d, "documents").select("doc_id", F.md5(X.redact(_note())).alias("redacted_md5"), (X.redact(c("text")) != c("text")).alias("changed"))


@query(f"SELECT doc_id, md5({_red(_NOTE)}) AS query, md5({_red('source')}) AS first_item, md5({_red('text')}) AS last_item FROM documents")
def redact_nested(s, d):
    rows = T.table(s, d, "documents").select("doc_id", F.struct(_note().alias("query"), F.array("source", "text").alias("items")).alias("payload"))
    r = rows.select("doc_id", X.redact_nested(c("payload"), rows.schema["payload"].dataType).alias("p"))
    return r.select("doc_id", F.md5("p.query").alias("query"), F.md5(c("p.items")[0]).alias("first_item"), F.md5(c("p.items")[1]).alias("last_item"))


@query("SELECT doc_id, md5(text) AS content_md5, md5(concat_ws('|', lang, source, text)) AS qca_md5 FROM documents")
def content_hash(s, d):
    return T.table(s, d, "documents").select("doc_id", F.md5("text").alias("content_md5"), X.content_hash(c("lang"), c("source"), c("text")).alias("qca_md5"))


@query("SELECT doc_id, n AS copies FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents) WHERE r = 1")
def dedup_exact(s, d):
    # An aggregate, not a window: copies are combined before the shuffle.
    return T.table(s, d, "documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, md5(trim(regexp_replace(regexp_replace(html, '(?is)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS body_md5 FROM pages""")
def topic_text(s, d):
    body = F.trim(F.regexp_replace(F.regexp_replace("html", r"(?is)<[^>]+>", " "), r"\s+", " "))
    return T.table(s, d, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), F.md5(body).alias("body_md5"))


_HEADS = ("References", "bibliography", "Acknowledgments", "ACKNOWLEDGEMENT", "Author contributions", "Appendix B", "Referencesque")
_TAIL = "text || chr(10) || chr(10) || chr(10) || source || chr(10) || (['" + "','".join(_HEADS) + "'])[doc_id % 7 + 1] || chr(10) || source"


@query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(split_part(regexp_replace({_TAIL}, '(?i)\n(references|bibliography|acknowledgements?|acknowledgments?|author contributions?|appendix)\b', chr(1)), chr(1), 1), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS kept_md5 FROM documents")
def strip_reference_tail(s, d):
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (c("doc_id") % 7 + 1).cast("int"))
    t = F.concat(c("text"), F.lit("\n\n\n"), c("source"), F.lit("\n"), head, F.lit("\n"), c("source"))
    return T.table(s, d, "documents").select("doc_id", F.md5(X.strip_reference_tail(t)).alias("kept_md5"))


@query(f"""WITH w AS (SELECT doc_id, (n_chars % 450)::INT AS t, {W}[1:40] AS tw, {W}[41:240] AS aw, {W}[1:300] AS bw FROM documents), a AS (SELECT *, least(len(tw), 32, t) AS nt FROM w),
 b AS (SELECT *, t - nt AS after, len(aw) > 0 AND t - nt > 0 AS has FROM a), c AS (SELECT *, least(len(aw), greatest(64, t // 4), after) AS na FROM b), d AS (SELECT *, CASE WHEN has THEN after - na - 1 ELSE after END AS rest FROM c)
 SELECT doc_id, t AS budget, md5(concat_ws(chr(10) || chr(10), CASE WHEN nt > 0 THEN array_to_string(tw[1:nt], ' ') END, CASE WHEN has THEN 'Abstract' || chr(10) || chr(10) || array_to_string(aw[1:na], ' ') END,
 CASE WHEN len(bw) > 0 AND rest > 0 THEN 'Body excerpt' || chr(10) || chr(10) || array_to_string(bw[1:least(len(bw), rest)], ' ') END)) AS text_md5 FROM d""")
def compose_text(s, d):
    """Parts of each document within a budget of its own; the body is an excerpt of 300 words."""
    w = X.words(c("text"))
    part = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    budget = (c("n_chars") % 450).cast("int")
    return T.table(s, d, "documents").select("doc_id", budget.alias("budget"), F.md5(X.compose(part(1, 40), part(41, 200), X.first_words(c("text"), 300), budget)).alias("text_md5"))


@query("""SELECT doc_id, md5(concat_ws(chr(10) || chr(10), CASE WHEN lang <> '' THEN 'Title' || chr(10) || lang END, CASE WHEN doc_id % 3 = 0 THEN 'Abstract' || chr(10) || source END,
 CASE WHEN length(text) > 200 THEN 'Body' || chr(10) || text END)) AS full_md5 FROM documents""")
def full_text(s, d):
    parts = (F.when(c("lang") != "", F.concat(F.lit("Title\n"), "lang")), F.when(c("doc_id") % 3 == 0, F.concat(F.lit("Abstract\n"), "source")), F.when(F.length("text") > 200, F.concat(F.lit("Body\n"), "text")))
    return T.table(s, d, "documents").select("doc_id", F.md5(F.concat_ws("\n\n", *parts)).alias("full_md5"))


_QCA = """turns AS (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS exchange FROM conversations),
 ctx AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS context FROM conversations WHERE role = 'system' GROUP BY 1),
 qca AS (SELECT t.conv_id, exchange, any_value(context) AS context, string_agg(text, chr(10) ORDER BY turn, text) FILTER (role = 'user') AS question, string_agg(text, chr(10) ORDER BY turn, text) FILTER (role = 'assistant') AS answer
 FROM turns t LEFT JOIN ctx USING (conv_id) WHERE role IN ('user', 'assistant') GROUP BY 1, 2)"""


def qca(s, d):
    """A dialogue as exchanges: each user turn with the answers that follow it, and all system texts as the context.

    Answers before any question make exchange 0, without a question; no turn is left out.
    """
    t = T.table(s, d, "conversations")
    said = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c("role") == role, F.struct("turn", "text")))), lambda x: x["text"]), "\n")
    some = lambda role: F.when(F.count_if((c("role") == role) & c("text").isNotNull()) > 0, said(role))
    asked = F.count_if(c("role") == "user").over(Window.partitionBy("conv_id").orderBy("turn"))
    exchanges = t.withColumn("exchange", asked).where(c("role").isin("user", "assistant")).groupBy("conv_id", "exchange").agg(some("user").alias("question"), some("assistant").alias("answer"))
    return exchanges.join(t.where("role = 'system'").groupBy("conv_id").agg(some("system").alias("context")), "conv_id", "left")


@query("SELECT conv_id, coalesce(question, '') AS question, coalesce(context, '') AS context, coalesce(answer, '') AS answer, md5(concat_ws('|', coalesce(question, ''), coalesce(context, ''), coalesce(answer, ''))) AS hash FROM qca WHERE question IS NOT NULL AND answer IS NOT NULL", _QCA)
def qca_extract(s, d):
    r = qca(s, d).where("question is not null and answer is not null")
    return r.select("conv_id", *[F.coalesce(x, F.lit("")).alias(x) for x in ("question", "context", "answer")], X.content_hash(c("question"), c("context"), c("answer")).alias("hash"))


_LABEL = "'Question: ' || coalesce(question, 'none') || chr(10) || 'Context: ' || coalesce(context, 'none') || chr(10) || 'Answer: ' || coalesce(answer, 'none')"


def _labelled_rows(s, d):
    f = lambda x: F.coalesce(x, F.lit("none"))
    return qca(s, d).select("conv_id", F.concat(F.lit("Question: "), f(c("question")), F.lit("\nContext: "), f(c("context")), F.lit("\nAnswer: "), f(c("answer"))).alias("t"))


@query(rf"SELECT conv_id, trim(regexp_extract(t, '(?is)question:\s*(.*?)\s*context:', 1)) AS question, trim(regexp_extract(t, '(?is)context:\s*(.*?)\s*answer:', 1)) AS context FROM (SELECT conv_id, {_LABEL} AS t FROM qca)", _QCA)
def qca_parse(s, d):
    return _labelled_rows(s, d).select("conv_id", X.labelled(c("t"), "question", "context").alias("question"), X.labelled(c("t"), "context", "answer").alias("context"))


@query(rf"SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'meta' ELSE trim(regexp_extract(t, '(?is)question:\s*(.*?)\s*context:', 1)) END AS question, trim(regexp_extract(t, '(?is)answer:\s*(.*)', 1)) AS answer FROM (SELECT conv_id, {_LABEL} AS t FROM qca)", _QCA)
def qca_from_text(s, d):
    meta = F.when(c("conv_id") % 4 == 0, F.lit("meta"))
    return _labelled_rows(s, d).select("conv_id", F.coalesce(meta, X.labelled(c("t"), "question", "context")).alias("question"), X.labelled(c("t"), "answer").alias("answer"))


@query("SELECT conv_id, concat_ws(chr(10) || chr(10), 'Question: ' || question, 'Context: ' || context, 'Answer: ' || answer) AS text FROM qca", _QCA)
def dialogue_text(s, d):
    part = lambda k: F.concat(F.lit(f"{k}: "), c(k.lower()))
    return qca(s, d).select("conv_id", F.concat_ws("\n\n", part("Question"), part("Context"), part("Answer")).alias("text"))


@query("SELECT conv_id || '_' || turn AS id, role AS task, trim(text) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations WHERE trim(coalesce(text, '')) <> ''")
def dialogue_normalize(s, d):
    t = T.table(s, d, "conversations").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long") - 1
    return t.select(F.concat_ws("_", c("conv_id").cast("string"), c("turn").cast("string")).alias("id"), c("role").alias("task"), F.trim("text").alias("text"), n.alias("n"))


@query("SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND NOT regexp_matches(text, '^(Hi|Hello|Welcome|The)[^ ]*$') AND length(trim(text)) > 10 AND NOT regexp_matches(text, '^(Anan|Erth)')")
def dialogue_clean(s, d):
    t = T.table(s, d, "conversations").dropna(subset=["text"])
    return t.where(~c("text").rlike(r"^(Hi|Hello|Welcome|The)[^ ]*$") & (F.length(F.trim("text")) > 10) & ~c("text").rlike("^(Anan|Erth)")).select("conv_id", "turn")


_WC = lambda x: f"len(regexp_extract_all(coalesce({x}, ''), '\\S+'))"


@query(f"""SELECT conv_id, CASE WHEN q = 0 OR a = 0 THEN 'skip' WHEN q + a + 20 <= 400 THEN 'single_chunk' WHEN q > 400 AND a <= 400 THEN 'split_input_keep_output' WHEN q <= 400 AND a > 400 THEN 'keep_input_split_output' ELSE 'split_both_fields' END AS strategy
 FROM (SELECT conv_id, {_WC('question')} + {_WC('context')} AS q, {_WC('answer')} AS a FROM qca)""", _QCA)
def chunk_strategy(s, d):
    n = lambda x: X.word_count(F.coalesce(x, F.lit("")))
    return qca(s, d).select("conv_id", chunking.split_strategy(n(c("question")) + n(c("context")), n(c("answer"))).alias("strategy"))


@query()
def dialogue_chunks(s, d):
    return chunking.explode_rows(qca(s, d), lambda q, x, a: chunking.dialogue_parts(q, x, a, 60), ["question", "context", "answer"], ["conv_id"], "conv_id long, n int, strategy string, text string")


@query()
def section_chunks(s, d):
    return chunking.explode_rows(T.table(s, d, "documents"), chunking.section_chunks, ["text"], ["doc_id"], "doc_id long, n int, section string, text string, offset_start int, offset_end int")


_LINES = "lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line, len(string_split(text, chr(10))) AS n FROM documents)"


@query("SELECT doc_id || '_chunk_' || lpad(i::VARCHAR, 5, '0') AS chunk_id, CASE WHEN i = 0 THEN 'head' ELSE 'body' END AS content_type, n - 1 AS n_related, length(line) AS n_chars FROM lines", _LINES)
def chunk_metadata(s, d):
    lines = T.table(s, d, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    key = F.concat(c("doc_id").cast("string"), F.lit("_chunk_"), F.lpad(c("i").cast("string"), 5, "0"))
    return lines.select(key.alias("chunk_id"), F.when(c("i") == 0, "head").otherwise("body").alias("content_type"), (c("n") - 1).cast("long").alias("n_related"), F.length("line").cast("long").alias("n_chars"))


@query("SELECT lang AS content_type, count(*) AS n, round(avg(length(text)), 6) AS mean_length FROM documents GROUP BY 1")
def chunk_stats(s, d):
    return T.table(s, d, "documents").groupBy(c("lang").alias("content_type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_length"))


@query(r"SELECT round(avg(length(text)), 6) AS mean_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars, round(avg(w), 6) AS mean_words, round(avg((w > 512)::INT), 6) AS over_limit FROM (SELECT text, len(regexp_extract_all(text, '\S+')) AS w FROM documents)")
def chunk_length_stats(s, d):
    r = T.table(s, d, "documents").select(F.length("text").cast("long").alias("n"), X.word_count(c("text")).alias("w"))
    return r.agg(F.round(F.avg("n"), 6).alias("mean_chars"), F.min("n").alias("min_chars"), F.max("n").alias("max_chars"), F.round(F.avg("w"), 6).alias("mean_words"), F.round(F.avg((c("w") > 512).cast("int")), 6).alias("over_limit"))


_RULES = [("no_text", "trim(coalesce(text, '')) = ''"), ("too_long", "len(regexp_extract_all(text, '\\S+')) > 512"), ("no_patient", "source_type = 'EMR' AND patient_id IS NULL"), ("bad_grade", "grade_score NOT BETWEEN 0 AND 0.95"), ("bad_vector", "embedding_dim NOT IN (0, 64)"), ("obsolete", "obsolete")]


@query(f"SELECT chunk_id, list_filter([{', '.join(f'CASE WHEN {q} THEN {chr(39)}{n}{chr(39)} END' for n, q in _RULES)}], lambda x: x IS NOT NULL) AS errors FROM chunks", CHUNKS)
def chunk_validation(s, d):
    rules = (
        ("no_text", F.trim(F.coalesce("text", F.lit(""))) == ""), ("too_long", X.word_count(c("text")) > 512), ("no_patient", (c("source_type") == "EMR") & c("patient_id").isNull()),
        ("bad_grade", ~c("grade_score").between(0, 0.95)), ("bad_vector", ~c("embedding_dim").isin(0, 64)), ("obsolete", c("obsolete")),
    )
    return T.chunks(s, d).select("chunk_id", F.array_compact(F.array(*[F.when(q, F.lit(n)) for n, q in rules])).alias("errors"))


@query("""SELECT 'c' || doc_id AS chunk_id, text AS content, coalesce(nullif(source_type, 'SAFETY'), 'LIT') AS source_type, round(coalesce(nullif(grade_score, 0), 0.5), 6) AS grade, round(coalesce(nullif(reliability, 0), 0.5), 6) AS reliability,
 len(regexp_extract_all(text, '\\S+'))::BIGINT AS tokens FROM chunks WHERE org_id = 'org1' AND text IS NOT NULL""", CHUNKS)
def normalize_chunks(s, d):
    from ..functions.scores import truthy

    half = lambda x: F.round(F.coalesce(truthy(c(x)), F.lit(0.5)), 6)
    rows = T.chunks(s, d).where("org_id = 'org1' and text is not null")
    return rows.select(F.concat(F.lit("c"), c("doc_id").cast("string")).alias("chunk_id"), c("text").alias("content"), F.when(c("source_type") == "SAFETY", "LIT").otherwise(c("source_type")).alias("source_type"), half("grade_score").alias("grade"), half("reliability").alias("reliability"), X.word_count(c("text")).alias("tokens"))


@query(f"""SELECT doc_id || '_' || i AS chunk_id, doc_id, 'LIT' AS source_type, array_to_string(w[i * 360 + 1 : i * 360 + 400], ' ') AS text, 0.65::DOUBLE AS grade, 0.75::DOUBLE AS reliability
 FROM (SELECT doc_id, w, unnest(range(greatest(1, ceil((len(w) - 40) / 360.0)::BIGINT))) AS i FROM (SELECT doc_id, {W} AS w FROM documents))""")
def ingest_documents(s, d):
    """Windows of 400 words that overlap by 40, with constant priors."""
    r = T.table(s, d, "documents").select("doc_id", X.words(c("text")).alias("w"))
    n = F.greatest(F.lit(1), F.ceil((F.size("w") - 40) / 360.0)).cast("int")
    r = r.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    return r.select(F.concat_ws("_", c("doc_id").cast("string"), c("i").cast("string")).alias("chunk_id"), "doc_id", F.lit("LIT").alias("source_type"), F.array_join(F.slice("w", c("i") * 360 + 1, F.lit(400)), " ").alias("text"), F.lit(0.65).alias("grade"), F.lit(0.75).alias("reliability"))


@query("SELECT 'note_' || conv_id || '_' || exchange AS chunk_id, 'p' || conv_id AS patient_id, 'EMR' AS source_type, coalesce(context, question) AS text, 0.70::DOUBLE AS grade, 0.80::DOUBLE AS reliability FROM qca WHERE coalesce(context, question) IS NOT NULL", _QCA)
def ingest_case_notes(s, d):
    r = qca(s, d).withColumn("text", F.coalesce("context", "question")).where("text is not null")
    return r.select(F.concat_ws("_", F.lit("note"), c("conv_id").cast("string"), c("exchange").cast("string")).alias("chunk_id"), F.concat(F.lit("p"), c("conv_id").cast("string")).alias("patient_id"), F.lit("EMR").alias("source_type"), "text", F.lit(0.70).alias("grade"), F.lit(0.80).alias("reliability"))


@query("SELECT doc_id AS id, 'documents' AS _split, source, NULL::VARCHAR AS url FROM documents UNION ALL SELECT page_id, 'pages', NULL, url FROM pages UNION ALL SELECT item_id, 'benchmark', NULL, NULL FROM benchmark")
def src_split_union(s, d):
    return files.split_union({
        "documents": T.table(s, d, "documents").select(c("doc_id").alias("id"), "source"),
        "pages": T.table(s, d, "pages").select(c("page_id").alias("id"), "url"),
        "benchmark": T.table(s, d, "benchmark").select(c("item_id").alias("id")),
    })


@query()
def src_incremental_files(s, d):
    """Files of the table folders against a state in which each benchmark file has an old hash."""
    now = files.file_state(s, d, "*.parquet")
    before = now.withColumn("hash", F.when(c("path").contains("benchmark"), F.lit("old")).otherwise(c("hash")))
    return files.changed(now, before).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "hash")


@query()
def src_jsonl_cases(s, d):
    """Cases through a JSON-lines text, as written and read again."""
    from ..sources.files import CASE

    rows = T.table(s, d, "benchmark").select(F.to_json(F.struct(c("item_id").cast("string").alias("case_id"), c("text").alias("query"))).alias("value"))
    return rows.select(F.from_json("value", CASE).alias("r")).select("r.case_id", F.length("r.query").alias("n_chars"))


@query("SELECT case_id, md5(coalesce(j ->> '$.answer', '')) AS answer_md5 FROM (SELECT conv_id || '_' || exchange AS case_id, json_object('answer', answer) AS j FROM qca)", _QCA)
def extract_json(s, d):
    """A JSON object out of a fenced reply, whatever its text holds."""
    reply = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct("answer")), F.lit("\n```"))
    body = F.regexp_extract("reply", r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    rows = qca(s, d).select(F.concat_ws("_", c("conv_id").cast("string"), c("exchange").cast("string")).alias("case_id"), reply.alias("reply"))
    return rows.select("case_id", F.md5(F.coalesce(F.get_json_object(body, "$.answer"), F.lit(""))).alias("answer_md5"))


_NOW = "2024-02-01 00:00:00"


@query(f"""SELECT event_id, CASE event_id % 8 WHEN 0 THEN (event_id % 90)::DOUBLE WHEN 1 THEN (event_id % 900) / 1000.0 WHEN 2 THEN (event_id % 5) * 60.0 WHEN 3 THEN 7.5 WHEN 4 THEN greatest(0, epoch(date_trunc('second', ts) + INTERVAL 20 DAY) - epoch(TIMESTAMP '{_NOW}'))
 WHEN 5 THEN (event_id % 100)::DOUBLE WHEN 6 THEN 3 END::DOUBLE AS seconds, round(least(30.0, 1.5 * power(2, event_id % 7)), 6)::DOUBLE AS backoff FROM events""")
def parse_retry_after(s, d):
    """Headers in all the forms services use, some unreadable, and the order in which they are believed."""
    e, k = c("event_id"), c("event_id") % 8
    later = F.date_trunc("second", "ts") + F.expr("interval 20 days")
    pair = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    headers = (
        F.when(k == 0, pair("retry-after", (e % 90).cast("string"), "x-ratelimit-reset", "1")).when(k == 1, pair("x-ratelimit-reset-tokens", "9s", "Retry-After", F.concat((e % 900).cast("string"), F.lit("ms"))))
        .when(k == 2, pair("x-ratelimit-reset-requests", F.concat((e % 5).cast("string"), F.lit("m")))).when(k == 3, pair("Retry-After", "soon", "x-ratelimit-reset", " 7.5S "))
        .when(k == 4, pair("Retry-After", F.concat(F.date_format(later, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))))
        .when(k == 5, pair("retry-after", (F.unix_timestamp(F.lit(_NOW).cast("timestamp")) + e % 100).cast("string"))).when(k == 6, pair("Retry-After-Ms", "3", "retry-after", "50")).otherwise(pair("retry-after", "", "x-ratelimit-reset", "xs"))
    )
    wait = X.retry_after(headers, F.lit(_NOW).cast("timestamp"))
    return T.table(s, d, "events").select("event_id", F.round(wait, 6).alias("seconds"), F.round(F.least(F.lit(30.0), 1.5 * F.pow(F.lit(2.0), e % 7)), 6).alias("backoff"))


@query("""SELECT doc_id, e, CASE WHEN n IS NULL THEN 'top_fields' WHEN NOT regexp_matches(text, '\\S') THEN 'content' WHEN source IS NULL OR lang IS NULL THEN 'metadata_fields'
 WHEN total < 1 THEN 'total_chunks' WHEN length < 1 THEN 'chunk_length' END AS first FROM (SELECT d.*, len(v.embedding) AS n, n_chars // 400 AS total, n_chars - 150 AS length,
 list_filter([CASE WHEN v.embedding IS NULL THEN 'top_fields' END, CASE WHEN NOT regexp_matches(text, '\\S') THEN 'content' END, CASE WHEN v.embedding IS NULL THEN 'embedding_size' END, CASE WHEN v.embedding IS NULL THEN 'embedding_values' END,
 CASE WHEN n_chars // 400 < 1 THEN 'total_chunks' END, CASE WHEN n_chars - 150 < 1 THEN 'chunk_length' END], lambda x: x IS NOT NULL) AS e FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id)""".replace("SELECT doc_id, e,", "SELECT doc_id, e AS errors,").replace("AS first FROM", "AS first_error FROM"))
def pre_store_validation(s, d):
    """Chunk records as JSON, with a vector where there is one, under the eighteen ordered checks."""
    v = T.table(s, d, "embeddings").select(c("vec_id").alias("doc_id"), "embedding")
    length = c("n_chars")
    meta = F.struct(c("source").alias("parent_id"), "source", c("lang").alias("task"), F.lit(1).alias("sequence"), F.floor(length / 400).alias("total_chunks"), F.lit("text").alias("content_type"), F.array(c("lang")).alias("related_chunks"), (length - 150).alias("chunk_length"), F.lit("2024-01-01T00:00:00Z").alias("created_timestamp"))
    record = F.struct(F.concat(F.lit("c"), c("doc_id").cast("string")).alias("chunk_id"), c("text").alias("content"), "embedding", meta.alias("metadata"), F.lit("m1").alias("embedding_model"), F.lit(64).alias("embedding_dim"))
    rows = T.table(s, d, "documents").join(v, "doc_id", "left").select("doc_id", F.parse_json(F.to_json(record)).alias("r"))
    rules = Con.chunk_rules("r")
    return rows.select("doc_id", Con.failing(rules).alias("errors"), Con.first_failing(rules).alias("first_error"))
