"""The pipeline, whole, against its stages one by one in brute force."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_methods import near, removed

import corpus_pipeline
from claimgauge.llm import bpe, rules

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, row int, "
          "base_failed string, root int, node int, key string, meta map<string,string>")
#: Documents by what is planted in them.
COPIES, NEAR, PASSAGES, LEAKS, JUNK = {200: 0, 201: 0, 202: 3}, {210: 1, 211: 210}, (10, 11, 12), (20, 21), range(300, 380)


def documents():
    chance = random.Random(8)
    vocabulary = ["".join(chance.choice("aeioulnrstmé") for _ in range(chance.randrange(2, 9))) for _ in range(3000)]

    def prose(n):
        return " ".join(chance.choice(vocabulary) for _ in range(n))

    texts = {k: prose(chance.randrange(90, 170)) for k in range(120)}
    passage, leak = prose(60), prose(45)
    for k in PASSAGES:
        texts[k] = f"{texts[k]} {passage} {prose(20)}"
    for k in LEAKS:
        texts[k] = f"{texts[k]}\n{leak.upper()}.\n{prose(30)}"
    for k, of in COPIES.items():
        texts[k] = texts[of]
    for k, of in NEAR.items():
        words = texts[of].split()
        words[chance.randrange(len(words))] = "other"
        texts[k] = " ".join(words)
    for k in JUNK:
        texts[k] = " ".join(chance.choice("#*$%&|<>") * chance.randrange(1, 5) for _ in range(chance.randrange(40, 90)))
    rows = list(texts.items()) + [(400, None), (401, ""), (402, " \n"), (403, "too few words"), (None, None), (None, prose(100)), (5, texts[5])]
    chance.shuffle(rows)
    return rows, leak


def write(spark, folder, rows, leak):
    full = [(k, t, "en", "a", len(t or ""), "x", 1, None, 2, 3, "k", {"a": "b"}) for k, t in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, "short"), (3, None)], "item_id bigint, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    labels = [(k, int(k not in JUNK), 0) for k, _ in rows if k is not None and k < 400]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rows, leak = documents()
    write(spark, tmp_path, rows, leak)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in rules.judged(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).where("kept").collect()}
    assert kept == {k for k, t in rows if t and len(t.split()) >= 20 and k not in JUNK}
    left = sorted(((k, t) for k, t in rows if k in kept and t), key=lambda x: (x[0] is None, x[0] or 0))
    left = [left[i] for i, g, _ in near([t for _, t in left]) if i == g]
    assert not {*COPIES, *NEAR}.intersection(k for k, _ in left) and len(left) == 121
    cut = removed([t for _, t in left], 200)
    want = {k: c[3].decode("utf-8", "ignore") for (k, _), c in zip(left, cut, strict=True)}
    assert all(len(want[k]) < len(t) for k, t in left if k in PASSAGES)
    # The leaked passage is long enough to be cut as a repeat, if several documents have it.
    gone = {k for k, t in want.items() if leak.upper() in t}
    want = {k: t for k, t in want.items() if k not in gone}

    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == [*docs.columns, "ids", "n_tokens", "round_trip"]
    rows = {r.doc_id: r for r in found.collect()}
    assert found.count() == len(rows) == len(want)
    assert {k: r.text for k, r in rows.items()} == want
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                                mergeable_ranks=bpe.Vocabulary.from_file(path).ranks, special_tokens={})
    for r in rows.values():
        ids = library.encode_ordinary(r.text)
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes() and r.n_tokens == len(ids) and r.round_trip
        assert r.n_chars == len(r.text) and r.meta == {"a": "b"} and (r.kept, r.row, r.root) == ("x", 1, 2)


@pytest.mark.parametrize("planted", [1, 2])
def test_leaks_go_also_where_only_one_document_has_them(spark, tmp_path, planted):
    rows, leak = documents()
    drop = LEAKS[planted:]
    write(spark, tmp_path, [(k, t) for k, t in rows if k not in drop and k not in JUNK], leak)
    found = {r.doc_id: r.text for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "text").collect()}
    assert all(leak.upper() not in (found.get(k) or "") for k in LEAKS)
    if planted == 1:
        assert LEAKS[0] not in found


def test_pipeline_of_nothing(spark, tmp_path):
    write(spark, tmp_path, [], "x")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
