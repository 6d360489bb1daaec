"""Every operator on nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vigilake.llm import bpe, embedding_dup, language_id, license_scan, mixing, near_dup, quality, registry, token_store, toxicity, url_filter

ROWS = 12


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_language(odd_docs, no_docs):
    rows = language_id.identify(odd_docs).collect()
    assert len(rows) == ROWS
    found = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (3, 4, 5))
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {True}  # null ids fold as the empty text
    assert language_id.identify(no_docs).collect() == []


def test_quality(odd_docs, no_docs):
    rows = quality.judge(odd_docs).collect()
    assert len(rows) == ROWS
    found = by_id(quality.judge(odd_docs))
    assert found[3]["n_words"] == 0 and found[3]["base_failed"] and not found[3]["kept"]
    assert found[6]["n_words"] == 40_000
    assert quality.judge(no_docs).collect() == []


def test_toxicity(odd_docs, odd_labels, no_docs):
    rows = toxicity.judge(odd_docs, odd_labels).collect()
    assert len(rows) == ROWS and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity.judge(no_docs, odd_labels).collect() == []
    assert len(toxicity.judge(odd_docs, odd_labels.where("false")).collect()) == ROWS


def test_near_duplicates(odd_docs, no_docs):
    rows = near_dup.dedup(odd_docs).collect()
    found = by_id(near_dup.dedup(odd_docs))
    assert found[2]["class_id"] == 1 and not found[2]["kept"] and found[1]["kept"] and found[1]["copies"] == 2
    assert found[7]["kept"] and found[7]["copies"] == 1 and found[4]["kept"] and found[3]["kept"]
    assert sum(r["doc_id"] is None for r in rows) == 2 and all(r["kept"] for r in rows if r["doc_id"] is None)
    kept = near_dup.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 3, 4, 5, 6, 7, 9, 10, None, None])
    assert near_dup.dedup(no_docs).collect() == [] and near_dup.deduplicated(no_docs).collect() == []


def test_bpe(odd_docs, no_docs):
    rows = bpe.encode(odd_docs, with_ids=True).collect()
    assert len(rows) == ROWS
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r["n_tokens"] == 0 and r["ids_sha256"] == r["decoded_sha256"] == nothing for r in rows if r["doc_id"] in (3, 4))
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.where("doc_id is not null").collect()}
    for r in rows:
        if r["doc_id"] is not None:
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    back = bpe.decode(bpe.encode(odd_docs, with_ids=True))
    assert {r["doc_id"]: r["text"] for r in back.where("doc_id is not null").collect()} == texts
    assert bpe.encode(no_docs).collect() == []


def test_token_store(odd_docs, no_docs):
    rows = token_store.round_trip(odd_docs).collect()
    assert len(rows) == ROWS
    spans = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    assert all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (3, 4))
    ids = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert token_store.round_trip(no_docs).collect() == []


def test_mixing(odd_docs, no_docs):
    rows = mixing.mix_sources(odd_docs).collect()
    assert len(rows) == ROWS
    assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in rows)
    assert mixing.mixed_documents(odd_docs).columns == odd_docs.columns
    assert mixing.mix_sources(no_docs).collect() == [] and mixing.mixed_documents(no_docs).collect() == []


def test_licenses(odd_docs, no_docs):
    rows = license_scan.scan(odd_docs).collect()
    assert len(rows) == ROWS
    empty = [r for r in rows if r["doc_id"] in (3, 4, 5)]
    assert all(r["n_words"] == 0 and r["n_base"] == 0 and r["first_word"] is None and r["labels"] == "" and r["score"] == 0 for r in empty)
    assert license_scan.scan(no_docs).collect() == []


def test_urls(spark):
    rows = [(1, None, None), (2, "no scheme", "<a href='https://x.example.org/'>"), (3, "HTTP://A.Example.com/en/7?x", None), (4, "://", ""),
        (None, "http://b.org/es/1#f", None), (3, "HTTP://A.Example.com/en/7?x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit("clash").alias("host"),
        F.lit("clash").alias("rule"), F.lit(1).alias("trust"))
    found = url_filter.judge_urls(pages).collect()
    assert len(found) == 6
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found}
    assert got[1] == ("", "", None, "allow") and got[2] == ("", "", None, "allow") and got[4] == ("", "", None, "allow")
    assert got[3] == ("a.example.com", "/en/7", "example.com/en/7", "allow") and got[None] == ("b.org", "/es/1", "org/es/", "block")
    assert url_filter.judge_urls(pages.where("false")).collect() == []


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [2.0, 0.1, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 0.0]),
        (7, [inf, 0.0, 0.0]), (8, [None, 1.0, 0.0]), (9, []), (None, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]),
            (11, [0.0, 1e-30, 0.0]), (12, [0.0, 1e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", F.lit("clash").alias("rep"), F.lit(2).alias("label"),
        F.lit(0).alias("cell"))
    found = embedding_dup.dedup(df).collect()
    assert len(found) == len(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10)) and got[None] == (0, None, False)
    assert got[11] == (1, 11, True) and got[12] == (1, 11, False)
    assert embedding_dup.dedup(df.where("false")).collect() == []


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_registered_query_runs(spark, name):
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(df.columns) == len(set(df.columns)) and df.count() > 0


def test_pipeline_stages_keep_columns(spark, odd_docs):
    docs = odd_docs.select("*", *[F.lit(1).alias(c) for c in ("_row_key", "_mix_size", "row", "plan", "rejected_key", "text_key", "doc", "_near_dup_id")])
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == names
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").columns[:2] == ["doc_id", "n_tokens"]


def test_pipeline_stages_on_an_empty_table(spark, no_docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, no_docs, "/root/testdata/sf0.001")
        assert out.columns == no_docs.columns and out.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, "/root/testdata/sf0.001").collect() == []


def test_pipeline_keeps_texts_apart_that_share_an_id(spark):
    one, other = (" ".join(f"{x}{i}" for i in range(120)) for x in ("alpha", "beta"))
    docs = spark.createDataFrame([(1, one), (5, one), (5, other), (5, "too short")], "doc_id long, text string")
    docs = docs.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    kept = corpus_pipeline.quality_rules(spark, docs, "/root/testdata/sf0.001")
    assert Counter(r["text"] == "too short" for r in kept.collect()) == Counter({False: 3})
    left = corpus_pipeline.near_duplicates(spark, kept, "/root/testdata/sf0.001").collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == [(1, one), (5, other)]


def test_operators_ship_the_package(tmp_path):
    """Workers find the package though only the driver's path has it."""
    import pathlib
    import subprocess
    import sys

    root = pathlib.Path(corpus_pipeline.__file__).resolve().parent
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.createDataFrame([(i, "you are a b c d e f g " + str(i % 3), "en", "s") for i in range(6)], "doc_id long, text string, lang string, source string")
labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
from vigilake.llm import bpe, language_id, near_dup, token_store, toxicity
for rows in (near_dup.dedup(docs), language_id.identify(docs), toxicity.judge(docs, labels), bpe.encode(docs), token_store.round_trip(docs)):
    assert rows.count() == 6
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300,
        env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr[-2000:]


def test_long_ids_beside_nulls_stay_exact(spark):
    big = 2**62 + 1
    docs = spark.createDataFrame([(big, "you are here", "en", "s"), (None, "x y z", "en", "s"), (big + 2, None, "de", None)],
        "doc_id long, text string, lang string, source string").coalesce(1)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for rows in (near_dup.dedup(docs), language_id.identify(docs), toxicity.judge(docs, labels), bpe.encode(docs), token_store.round_trip(docs),
        quality.judge(docs), license_scan.scan(docs), mixing.mix_sources(docs)):
        assert sorted((r["doc_id"] for r in rows.collect()), key=str) == [big, big + 2, None], rows.columns
