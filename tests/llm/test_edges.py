"""Nulls, empty and long texts, ties, repeated rows, empty tables, extra columns with clashing names: every operator and stage."""

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from verisift.llm import classifier, decontaminate, html, lines, mixing, neardup, repeats, rules, secrets, sharding

CLASH = "th long, h string, size string, cell int, rank int, copy string, block string, text_crc32 string, _id string, kept string, n_words string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
EXTRA = (1, "x", "y", 2, 3, "c", "b", "t", "i", "k", "w")
LONG = " ".join(f"word{i}" for i in range(60_000))
GOOD = " ".join(f"plain{i % 97} tale{i} of" for i in range(80))


def rows():
    base = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, GOOD, None, None, None), (None, None, None, None, None), (3, GOOD, "en", "a", 9),
        (3, GOOD, "en", "a", 9), (3, "other text under the same id", "de", "b", 9), (4, LONG, "en", "b", 9), (5, " \n\t ", "en", "b", 9), (6, "é" * 300 + "\n" + "日本" * 150, "fr", "c", 9),
        (7, "one two", "en", "c", 9), (8, "one two", "en", "d", 9),
    ]
    return [(*r, *EXTRA) for r in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (7, 0, 1), (None, 1, 0), (4, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "one two"), (2, None), (None, ""), (3, "!!")], "item_id long, text string")


OPERATORS = {
    "secrets": lambda d, la, b: secrets.digest(secrets.scan(d, [0.0] * (secrets.K * secrets.K))),
    "lines": lambda d, la, b: lines.dedup_lines(d),
    "rules": lambda d, la, b: rules.judge(d, rules.fit(d, la)),
    "classifier": lambda d, la, b: classifier.classify(d, ["bad"], n_sample=50),
    "repeats": lambda d, la, b: repeats.removal_digest(d),
    "repeats_first": lambda d, la, b: repeats.without_repeats(d),
    "sharding": lambda d, la, b: sharding.hilbert_shards(d, 4),
    "neardup": lambda d, la, b: neardup.near_duplicates(d),
    "mixing": lambda d, la, b: mixing.mix(d, max_repetition=None),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_document(name, docs, labels, bench):
    got = OPERATORS[name](docs, labels, bench).collect()
    assert len(got) == len(rows()) or name == "mixing" and len(got) >= len(rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, empty, labels, bench):
    assert OPERATORS[name](empty, labels, bench).collect() == []


def test_contamination_of_short_items(docs, empty, bench):
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()) == [(7, 1), (8, 1)]
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean_documents(docs, bench).count() == len(rows()) - 2


def test_pages_without_anything(spark):
    pages = spark.createDataFrame([(1, "http://a/x", None, 5), (2, None, "", 5), (None, "", "<p>", 5), (3, "http://a/x", "<article>x &amp; y</article>", 5), (3, "http://a/x", "<article>x &amp; y</article>", 5)], "page_id long, url string, html string, th int")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html.extract(pages).collect())
    assert got == [(0, "", 0), (1, "", 0), (2, "", 0), (3, "x & y", 5), (3, "x & y", 5)]
    assert html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_the_columns(stage, spark, docs, empty, labels, bench, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    f = dict(corpus_pipeline.STAGES)[stage]
    assert f(spark, empty, str(tmp_path)).count() == 0
    out = f(spark, docs, str(tmp_path))
    if stage == "sharding":
        assert out.count() == len(rows())
    else:
        assert out.columns == docs.columns
        kept = out.collect()
        assert all(tuple(r) in set(rows()) for r in kept)


def test_equal_rows_get_equal_results(docs):
    for r in ("kept", "class_id"):
        got = [x[r] for x in neardup.near_duplicates(docs).where("doc_id = 3 and th is not null").collect()]
        assert len(got) == 3


@pytest.mark.parametrize("name", OPERATORS)
def test_string_ids(name, spark, docs, bench):
    named = docs.select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"), *[c for c in docs.columns if c != "doc_id"])
    labels = spark.createDataFrame([("d3", 1, 0), ("d7", 0, 1), (None, 1, 0), ("d99", 1, 1)], "doc_id string, quality int, toxic int")
    got = OPERATORS[name](named, labels, bench).collect()
    assert {r.doc_id for r in got} == {"d1", "d2", "d3", "d4", "d5", "d6", "d7", "d8", None}


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_any_column_name(stage, spark, docs, labels, bench, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = docs.withColumn("a.b", F.lit(7)).withColumn("x y", F.struct(F.lit(1).alias("p.q"))).withColumn("row", F.lit("r")).withColumn("b`t", F.lit(None).cast("string"))
    f = dict(corpus_pipeline.STAGES)[stage]
    got, want = f(spark, odd, str(tmp_path)), f(spark, docs, str(tmp_path))
    plain = [c for c in want.columns if c in docs.columns]
    if stage != "sharding":
        assert got.columns == odd.columns
        assert all(r["a.b"] == 7 and r["x y"]["p.q"] == 1 and r["row"] == "r" and r["b`t"] is None for r in got.collect())
    show = lambda df: sorted(map(repr, df.select(*plain).collect()))
    assert show(got) == show(want)
