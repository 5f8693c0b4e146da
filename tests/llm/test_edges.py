"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import public_tokenizers
import pytest

from claimgauge.llm import (
    bpe,
    decontaminate,
    html_text,
    lm_score,
    ngram_join,
    repeats,
    rules,
    sharding,
    token_rollup,
    weak_labels,
)

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "lorem ipsum dolor sit amet " * 3000
ROWS = [
    (1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27),
    (None, None, None, None, None), (None, None, None, None, None), (2, "", "en", None, 0), (3, LONG, None, "b", 1),
]
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(params=["rows", "empty"])
def documents(request, spark):
    return spark.createDataFrame(ROWS if request.param == "rows" else [], SCHEMA)


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([(1, None), (None, "x"), (2, "")], "item_id bigint, text string")


def test_lm_score(documents):
    rows = lm_score.scored(documents).collect()
    assert len(rows) == documents.count()
    assert all(r.held_out is not None and r.n_tokens >= 1 and r.score <= 0 for r in rows)


def test_rules(spark, documents):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None)], "doc_id bigint, quality int")
    rows = rules.judged(documents, labels).collect()
    assert len(rows) == documents.count() and not any(r.kept and r.base_failed for r in rows)
    assert rules.only_kept(documents, labels).columns == documents.columns


def test_bpe(documents):
    assert bpe.digests(documents, PATH, PATTERN).count() == documents.count()
    clashing = documents.withColumnRenamed("source", "ids")
    assert bpe.encode_texts(clashing, PATH, PATTERN).columns == ["doc_id", "text", "lang", "n_chars", "ids", "decoded"]


def test_leaks(documents, benchmark):
    assert decontaminate.leaks(documents, benchmark).count() == 0
    assert decontaminate.without_leaks(documents, benchmark).count() == documents.count()
    assert decontaminate.leaks(documents, benchmark.limit(0)).count() == 0


def test_near_duplicates(documents):
    rows = ngram_join.classes(documents).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in rows) == (
        [(0, 0, 0), (0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 2, 0), (3, 3, 0)] if rows else [])
    kept = ngram_join.one_of_each(documents)
    assert kept.columns == documents.columns and kept.count() == (5 if rows else 0)


def test_rollup(spark, documents, tmp_path):
    rollup = token_rollup.Rollup(spark, str(tmp_path), {"words": token_rollup.words})
    rollup.commit("x", token_rollup.inserts(documents))
    found = {(r.source, r.lang): (r.n_documents, r.n_tokens) for r in rollup.totals().collect()}
    assert found == ({("a", "en"): (2, 12), (None, None): (2, 0), (None, "en"): (1, 0), ("b", None): (1, 15000)}
                     if found else {})


def test_sharding(documents):
    rows = sharding.shard_documents(documents, 40).collect()
    assert len(rows) == documents.count()
    assert len({r.shard for r in rows if r.doc_id is None}) <= 1
    assert all(r.size == 16 and r.text_crc32 == 0 for r in rows if r.doc_id is None)


def test_weak_labels(documents):
    rows = weak_labels.scored(documents).collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 for r in rows)


def test_html(spark):
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (None, "x", "<p>" * 3000 + "deep")],
                                  "page_id bigint, url string, html string")
    assert sorted(r.text for r in html_text.texts(pages).collect()) == ["", "", "deep"]
    assert html_text.texts(pages.limit(0)).count() == 0


def test_repeats(documents):
    clashing = documents.withColumnRenamed("source", "kept").withColumnRenamed("lang", "key")
    found = repeats.without_repeats(clashing)
    assert found.columns == ["doc_id", "text", "key", "n_chars", "n_bytes", "n_removed", "n_spans", "kept"]
    rows = found.collect()
    assert sorted(r.n_removed for r in rows) == ([0, 0, 0, 0, 0, len(LONG)] if rows else [])
