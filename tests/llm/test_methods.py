"""Each operator against brute force, on small tables made here."""

import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from claimgauge.llm import (
    bpe,
    bytehash,
    decontaminate,
    html_text,
    lm_score,
    ngram_join,
    queries,
    repeats,
    rules,
    sharding,
    token_rollup,
    weak_labels,
)
from claimgauge.llm.groups import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)


@pytest.fixture(scope="module")
def prose():
    """Words of a skewed vocabulary, with copies and passages that texts share."""
    chance = random.Random(4)
    vocabulary = ["".join(chance.choice("aeioulnrst") for _ in range(chance.randrange(1, 8))) for _ in range(300)]
    texts = [" ".join(chance.choice(vocabulary[: chance.choice([5, 40, 300])])
                      for _ in range(chance.randrange(1, 150))) for _ in range(60)]
    texts += texts[:5] + [texts[7] + " und so weiter", texts[8][3:], None, "", " \n\t", "x", "Ümlaut é\x00  y"]
    return texts


# 1


def test_unigram_base_is_exact_and_segments_agree(spark, prose):
    tokens = [[w.decode() for w in (t or "").encode().lower().split()] + [None] for t in prose]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(prose))]
    counts = collections.Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    total, scale = counts.total(), counts.total() + 0.5 * (len(counts) + 1)
    df = documents(spark, prose)
    one = {r.doc_id: r for r in lm_score.scored(df).collect()}
    many = {r.doc_id: r for r in lm_score.scored(df, segment_mb=0.002, frequent=7).collect()}
    for i, own in enumerate(tokens):
        for found in (one[i], many[i]):
            assert (found.held_out, found.n_tokens, found.train_tokens) == (held[i], len(own), total)
            assert found.n_known == sum(counts[w] > 0 for w in own)
            assert found.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / scale) for w in own))
        assert many[i].score == pytest.approx(one[i].score, abs=0.35 * len(own))


@pytest.mark.parametrize("read", [lm_score.READ, 1e-3])
def test_segments_answer_in_tasks_of_their_own(spark, prose, monkeypatch, read):
    """However many segments there are, none is broadcast, no plan has a worker for each, and scores are theirs."""
    sent, workers, models, keep, train = [], [], [], lm_score.keep, lm_score.train
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *a: sent.append(a) or broadcast(*a))
    monkeypatch.setattr(lm_score, "keep", lambda df, *a: workers.append(
        df._jdf.queryExecution().analyzed().toString().count("MapInArrow")) or keep(df, *a))
    monkeypatch.setattr(lm_score, "train", lambda *a: models.append(train(*a)) or models[-1])
    monkeypatch.setattr(lm_score, "READ", read, raising=False)
    ids = [i // 2 if i % 7 else None for i in range(len(prose))]
    df = spark.createDataFrame([*zip(ids, prose, strict=True)], "doc_id long, text string")
    rows = lm_score.scored(df.repartition(3), segment_mb=0.002).collect()
    model = models[0]
    n = model.grid[0] * model.grid[1]
    assert n > 4 and len(sent) == 1 and max(workers) == 2
    held = [lm_score.Filter(model.segment(i), model.first) for i in range(n)]
    expected = collections.Counter()
    for i, text in zip(ids, prose, strict=True):
        data = np.frombuffer((text or "").encode(), np.uint8)
        token, before, _ = lm_score.tokens(data, np.array([0, len(data)]))
        token, before = lm_score.half(token), lm_score.half(before)
        of = lm_score.segment_of(before, token, model.grid)
        score = sum(lm_score._log_probabilities(held[x], token[of == x], before[of == x], model.mass).sum()
                    for x in set(of.tolist()))
        expected[i, len(token), round(float(score), 6)] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, round(r.score, 6)) for r in rows) == expected


@pytest.mark.parametrize("most", [0, 1, 15, 16, 255, 4000, 70_000, 2**32 - 1])
@pytest.mark.parametrize("count", [1, 2, 7, 1000])
def test_numbers_of_lots_come_back(most, count):
    numbers = np.random.default_rng(most).integers(0, most, count, endpoint=True)
    content = lm_score._short(numbers)
    assert lm_score._long(pa.py_buffer(content), count).tolist() == numbers.tolist()
    assert len(content) <= max(1, -(-most.bit_length() // 4)) * count / 2 + 1


def test_filter_counts_are_close_and_rarely_false():
    items = np.arange(1, 4001, dtype=np.uint64) << np.uint64(20)
    levels = np.arange(4000) % 12 + 1
    set_ = lm_score.EACH * lm_score.PROBES * int((levels + np.maximum(levels - lm_score.HIGH + 1, 0)).sum())
    blocks = 1 + int(set_ / math.log(2)) // (lm_score.BLOCK_BYTES * 8)
    bits = np.zeros(blocks * lm_score.BLOCK_BYTES, np.uint8)
    held = lm_score.Filter(bits, lm_score.PROBES)
    for q in range(1, 13):
        mine = items[levels >= q]
        base = lm_score.block_of(mine, blocks) * (lm_score.BLOCK_BYTES // 8)
        for k in range(int(lm_score.probes_of(1, q, lm_score.PROBES))):
            word, mask = lm_score.probe(lm_score.places(lm_score.kinds(mine, 1), q), k)
            np.bitwise_or.at(held.words, base + word, mask)
    found = held.counts(items, 1, 1, 2.0)
    assert (found >= 2.0 ** (levels - 1)).all()
    assert (found == 2.0 ** (levels - 1)).mean() > 0.97
    assert (held.counts(items + np.uint64(1), 1, 1, 2.0) > 0).mean() < 0.02


def test_scores_are_near_the_exact_formula(spark, prose):
    tokens = [["<"] + (t or "").lower().split() + [">"] for t in prose]
    training = [t for i, t in enumerate(tokens) if zlib.crc32(str(i).encode()) % 5 != 1]
    single = collections.Counter(w for t in training for w in t[1:])
    pairs = collections.Counter(p for t in training for p in itertools.pairwise(t))
    scale = single.total() + 0.5 * (len(single) + 1)
    after = collections.defaultdict(list)
    for (v, _), n in pairs.items():
        after[v].append(n)

    def log_p(v, w):
        own, n = (single[w] + 0.5) / scale, after[v]
        if max(n, default=0) < 2:
            return math.log10(own)
        met = pairs[v, w] if pairs[v, w] > 1 else 0
        return math.log10((met + (len(n) + n.count(1)) * own) / (sum(n) + len(n)))

    off, count = 0.0, 0
    for r in lm_score.scored(documents(spark, prose)).collect():
        own = tokens[r.doc_id]
        exact = sum(log_p(v, w) for v, w in itertools.pairwise(own))
        assert r.score == pytest.approx(exact, abs=0.15 * (len(own) - 1))
        off, count = off + r.score - exact, count + len(own) - 1
    assert abs(off) / count < 0.02


@pytest.mark.parametrize("vocabulary", [300, 20_000])
def test_probabilities_after_a_context_sum_to_one(spark, vocabulary):
    chance = random.Random(vocabulary)
    texts = [" ".join(f"w{int(vocabulary * chance.random() ** 4)}" for _ in range(400)) for _ in range(150)]
    model = lm_score.train(documents(spark, texts))
    known = lm_score.half(model.counts.toPandas()["h"].to_numpy().view(np.uint64))
    held = lm_score.Filter(model.segment(0), model.first)
    unknown = 0.5 / model.mass
    _, z = held.contexts(known)
    kept = known[z > 0]
    assert len(kept) > 200
    sums = []
    for v in [*kept[:400], *known[z == 0][:20]]:
        p = 10 ** lm_score._log_probabilities(held, known, np.full(len(known), v), model.mass)
        escape, z = (x[0] for x in held.contexts(np.array([v])))
        sums.append(p.sum() + (unknown * escape / z if z else unknown))
    assert np.mean(sums) == pytest.approx(1, abs=0.02)
    assert np.mean(np.abs(np.array(sums) - 1) < 0.05) > 0.9


# 2


def counted(text):
    text = text or ""
    words, seen, again = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    places = collections.defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i:i + 8])].append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered),
            len(words) < 20 or 100 * len(covered) > 30 * len(words))


def test_statistics(spark, prose):
    texts = prose + ["a b c d e f g h " * 3, "x " * 40, "l 1\nl 1\n\n\nl 1 \nl 1", "# | a\x0bb\x0cc\rd <>&%$*#"]
    names = [*rules.COUNTS, "base_failed"]
    found = {r.doc_id: tuple(r[n] for n in names) for r in rules.with_statistics(documents(spark, texts)).collect()}
    assert found == {i: counted(t) for i, t in enumerate(texts)}


def test_learned_rules_separate_what_thresholds_can(spark):
    chance = random.Random(1)
    rows = []
    for i in range(600):
        x, y = chance.random(), chance.random()
        rows.append((i, x, y, False, 0 if x > 0.7 or (x < 0.3 and y > 0.6) else 1))
    stats = spark.createDataFrame(rows, "doc_id bigint, x double, y double, base_failed boolean, quality int")
    learned = rules.learn(stats.drop("quality"), stats.select("doc_id", "quality"), ("x", "y"))
    judged = stats.withColumn("kept", learned.verdict())
    right = judged.where("kept = (quality = 1)").count()
    assert right > 570
    assert judged.where("not kept and quality = 1").count() < 15
    assert "CASE WHEN base_failed" in str(learned.verdict())


# 3


def test_encoding_equals_the_library(spark, prose):
    ranks = bpe.Vocabulary.from_file(PATH).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = prose + ["=" * 700, "a" * 999, "\n\n  \n" * 30, "don't <|endoftext|> 12345 中文😀"]
    for row in bpe.digests(documents(spark, texts), PATH, public_tokenizers.PATTERN).collect():
        text = texts[row.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_appends_and_edits_are_exact():
    vocabulary = bpe.Vocabulary.from_file(PATH)
    chance = random.Random(2)
    for _ in range(60):
        piece = bytes(chance.choice(b"abcehnt ") for _ in range(chance.randrange(300)))
        own = bpe.PrefixEncoder(vocabulary, piece)
        assert b"".join(vocabulary.tokens[i] for i in own.ids()) == piece
        assert [vocabulary.tokens[i] for i in own.ids()] == vocabulary.merged(piece)
        begin = chance.randrange(len(piece) + 1)
        end = chance.randrange(begin, len(piece) + 1)
        own.replace(begin, end, b"the")
        own.append(b" end")
        assert own.last == bpe.PrefixEncoder(vocabulary, piece[:begin] + b"the" + piece[end:] + b" end").last
    long = bpe.PrefixEncoder(vocabulary, b"the quick brown " * 400)
    assert long.replace(10, 11, b"X") < 1000


# 4


def distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (a != b)))
        row = new
    return min(row)


def test_leaks_are_those_within_the_edit_budget(spark):
    chance = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz "
    items = ["".join(chance.choice(letters) for _ in range(n)) for n in (60, 119, 120, 150, 400)]
    texts = []
    for k in range(40):
        item = chance.choice(items)
        at = chance.randrange(max(1, len(item) - 130))
        passage = list(item[at:at + 130])
        for _ in range(chance.randrange(20)):
            passage[chance.randrange(len(passage))] = chance.choice(["", "q", "zz"])
        noise = "".join(chance.choice(letters) for _ in range(200))
        texts.append(noise + "".join(passage) + noise[::-1] if k % 4 else noise)
    benchmark = spark.createDataFrame([*enumerate(items), (77, None), (78, "short")], "item_id bigint, text string")
    df = documents(spark, texts)
    expected = set()
    for i, text in enumerate(texts):
        for j, item in enumerate(items):
            for window in decontaminate.windows(decontaminate.normalised(item)):
                most, _ = decontaminate.budget(len(window), decontaminate.GRAM, decontaminate.EDITS)
                if distance_inside(window, decontaminate.normalised(text)) <= most:
                    expected.add((i, j))
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, benchmark).collect()} == expected
    blocks = decontaminate.matches(df, benchmark, block=500)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == expected
    clean = {r.doc_id for r in decontaminate.without_leaks(df, benchmark).collect()}
    assert clean == set(range(len(texts))) - {i for i, _ in expected}


def test_least_passages_are_found_at_all_offsets():
    chance = random.Random(5)

    def letters(n):
        return "".join(chance.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    for size in (61, 119, 121, 350):
        item = letters(size)
        index = decontaminate.Index(decontaminate.windows(item), decontaminate.GRAM, decontaminate.EDITS)
        texts = [(k, letters(90) + item[k:k + 60] + letters(90)) for k in range(size - 59)]
        assert {k for k, *_ in index.confirmed(texts)} == set(range(size - 59))
        wide = []
        for k in range(0, size - 119, 7):  # twice the passage with nine edits, wherever they are
            passage = list(item[k // 60 * 60:][:120])
            for at in chance.sample(range(len(passage)), 9):
                passage[at] = chance.choice(["", "0", passage[at] + "0"])
            wide.append((k, letters(90) + "".join(passage) + letters(90)))
        found = {k for k, *_ in index.confirmed(wide)}
        assert found == {k for k, _ in wide if len(item[k // 60 * 60:][:120]) == 120} | found


def test_short_items_drop_no_documents(spark):
    item = "Every good boy deserves fudge, and art."
    benchmark = spark.createDataFrame([(1, "photosynthesis"), (2, "Yes, of course!"), (3, item)], "item_id bigint, text string")
    df = documents(spark, ["Plants live by photosynthesis.", "yes of course, yes of course", "eyes of courser", item.lower(),
                           f"he said: {item}", "photosynthesised"])
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, benchmark).collect()} == {(3, 3), (4, 3)}
    assert {r.doc_id for r in decontaminate.without_leaks(df, benchmark).collect()} == {0, 1, 2, 5}
    assert {(r.doc_id, r.item_id) for r in decontaminate.mentions(df, benchmark).collect()} == {(0, 1), (1, 2)}


def test_alignments_together_are_those_one_by_one():
    chance = random.Random(6)
    patterns = ["".join(chance.choice("abc ") for _ in range(chance.randrange(1, 65))) for _ in range(200)]
    regions = ["".join(chance.choice([c, c, c, c, "", "x"]) for c in "ab" * chance.randrange(9) + p + "c a") for p in patterns]
    together = zip(*decontaminate.aligned_together(patterns, regions), strict=True)
    codes = [[np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in x] for x in (patterns, regions)]
    assert list(together) == [decontaminate.aligned(p, r) for p, r in zip(*codes, strict=True)]


# 5


def near(texts, n=5):
    sets = []
    for text in texts:
        words = WORD.findall(text or "")
        sets.append({tuple(words[k:k + n]) for k in range(len(words) - n + 1)} or ({tuple(words)} - {()}))
    group, links = list(range(len(sets))), [0] * len(sets)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return [(i, g, k) for i, (g, k) in enumerate(zip(group, links, strict=True))]


@pytest.mark.parametrize("lot", [ngram_join.LOT, 9])
def test_near_duplicates(spark, prose, lot):
    chance = random.Random(6)
    base = [chance.choice("abcdefghij") * chance.randrange(1, 4) for _ in range(100)]
    texts = list(prose)
    for _ in range(50):
        words = list(base)
        for _ in range(chance.randrange(6)):
            words[chance.randrange(100)] = chance.choice("klm")
        texts.append(" ".join(words))
    found = ngram_join.near_duplicates(documents(spark, texts), lot=lot)
    assert sorted(tuple(r) for r in found.select("doc_id", "class_id", "n_links").collect()) == near(texts)


def test_one_document_of_each_group_stays(spark, prose):
    kept = ngram_join.one_of_each(documents(spark, prose))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, g, _ in near(prose) if i == g]


def test_prefix_is_shortened_until_the_recall():
    depth = ngram_join.prefix_length(0.8)
    assert 1 - (1 - 0.8**depth) ** ngram_join.TREES >= ngram_join.RECALL
    assert 1 - (1 - 0.8 ** (depth + 1)) ** ngram_join.TREES < ngram_join.RECALL


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    found = components(spark.createDataFrame(edges, "a bigint, b bigint"), "test")
    assert dict(tuple(r) for r in found.collect()) == {
        **dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


# 6


def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    schema = ("before struct<source:string,lang:string,text:string>, "
              "after struct<source:string,lang:string,text:string>")
    rollup = token_rollup.Rollup(spark, str(tmp_path), {"words": token_rollup.words, "w2": token_rollup.words})
    assert rollup.totals().count() == 0
    a, b, c, d = ("s", "en", "a b c"), ("s", "en", "d"), ("t", None, None), ("s", "de", "e f")
    assert rollup.commit("1", spark.createDataFrame([(None, a), (None, b), (None, c), (None, c)], schema))
    assert rollup.commit("2", spark.createDataFrame([(b, None), (a, d)], schema))
    assert not rollup.commit("2", spark.createDataFrame([(b, None)], schema))
    assert rollup.commit("3", spark.createDataFrame([], schema))
    found = {tuple(r) for r in rollup.totals().collect()}
    assert found == {(s, lang, k, n, t, z) for k in ("words", "w2")
                     for s, lang, n, t, z in [("s", "de", 1, 2, 3), ("t", None, 2, 0, 0)]}


def test_compacted_batches_count_once(spark, tmp_path):
    rollup = token_rollup.Rollup(spark, str(tmp_path), {"words": token_rollup.words})
    assert not rollup.compact()
    one = spark.createDataFrame([("s", "en", "a b")], "source string, lang string, text string")
    assert rollup.commit("1", token_rollup.inserts(one)) and rollup.compact()
    assert rollup.commit("2", token_rollup.inserts(one)) and not rollup.commit("1", token_rollup.inserts(one))
    assert [r.n_tokens for r in rollup.totals().collect()] == [4]
    assert rollup.compact() and rollup.compact()
    assert [r.n_tokens for r in rollup.totals().collect()] == [4]


def test_of_two_writers_of_a_batch_one_counts(spark, tmp_path, monkeypatch):
    rollup = token_rollup.Rollup(spark, str(tmp_path), {"words": token_rollup.words})
    one = token_rollup.inserts(spark.createDataFrame([("s", "en", "a b")], "source string, lang string, text string"))
    late = token_rollup.Rollup(spark, str(tmp_path), rollup.tokenizers)
    monkeypatch.setattr(late, "_exists", lambda path: False)  # it looked before the first had come
    assert rollup.commit("1", one) and not late.commit("1", one)
    assert [r.n_tokens for r in rollup.totals().collect()] == [2]
    assert sorted(x.name for x in tmp_path.iterdir()) == ["batch=1"]


def test_query_of_deltas(spark, prose, tmp_path):
    """Against all documents as they are after the changes, counted one by one."""
    chance = random.Random(3)
    rows = [(k if k % 50 else None, text, chance.choice(["en", "de", None]), chance.choice(["a", "b", None]))
            for k, text in enumerate(prose * 4)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(
        f"{tmp_path}/documents.parquet")
    ranks = bpe.Vocabulary.from_file(PATH).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want: dict = collections.defaultdict(lambda: [0, 0, 0])
    met = set()
    for doc_id, text, lang, source in rows:
        part = None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 64
        met.add(part)
        if part == 1:
            continue
        if part == 3 and text is not None:
            text += " revised"
        source = "moved" if part == 4 else source
        text = text or ""
        for name, n in (("words", len(text.encode().split())), ("byte_bpe_50k", len(library.encode_ordinary(text)))):
            sums = want[source, lang, name]
            sums[0], sums[1], sums[2] = sums[0] + 1, sums[1] + n, sums[2] + len(text.encode())
    assert {1, 2, 3, 4, None} <= met
    found = {tuple(r[:3]): list(r[3:]) for r in queries.op6_token_counts(spark, str(tmp_path)).collect()}
    assert found == dict(want)


# 7


def test_tree_law_balance_and_slots(spark):
    n = 6000
    df = spark.range(n).select("id", "id").toDF("doc_id", "text").selectExpr("doc_id", "cast(text as string) text")
    rows = sharding.shard_documents(df, 40).collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {40}
    assert 60 < len(moved) < 300
    by_shard = collections.defaultdict(list)
    for r in rows:
        assert r.text_crc32 == zlib.crc32(str(r.doc_id).encode()) and r.size == len(str(r.doc_id)) + 16
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert len(by_shard) == 40 and max(map(len, by_shard.values())) < 1.4 * n / 40


def test_weights_move_rows_only_within_what_changed(spark):
    df = spark.range(4000).withColumnRenamed("id", "k")
    tree = sharding.layout(16)
    heavier = tuple(sharding.Shard(s.region, s.rack, s.number, 3.0 if s.number == 5 else 1.0) for s in tree)
    both = sharding.with_shard(sharding.with_shard(df, tree, "k", "was"), heavier, "k", "now").collect()
    place = {s.number: (s.region, s.rack) for s in tree}
    for r in both:
        if r.was != r.now:
            assert place[r.now][0] == place[5][0]  # into the region that grew
            if place[r.was][0] == place[5][0] and place[r.was][1] != place[5][1]:
                assert place[r.now] == place[5]
    share = sum(r.now == 5 for r in both) / len(both)
    assert share == pytest.approx(3 / 18, abs=0.03)


# 8


def test_labellers_find_planted_accuracies():
    chance = np.random.default_rng(0)
    good = chance.random(20000) < 0.85
    patterns = []
    on_bad = chance.uniform(0.4, 0.95, len(weak_labels.LABELLERS))
    for is_good in good:
        p = np.where(is_good, 0.997, 1 - on_bad)
        patterns.append("".join("g" if x else "b" for x in chance.random(len(on_bad)) < p))
    counts = collections.Counter(patterns)
    posterior, accuracy = weak_labels.expectation_maximisation(list(counts), list(counts.values()))
    assert np.abs(accuracy[:, 0] - on_bad).max() < 0.08
    assert np.mean([(posterior[p] > 0.5) == g for p, g in zip(patterns, good, strict=True)]) > 0.99


def test_scorer_rejects_junk_and_keeps_prose(spark, prose):
    chance = random.Random(8)
    clean = [" ".join(chance.choice(["river", "and", "the", "stone", "walks", "over", "green", "hills,", "old."])
                      + str(chance.randrange(9)) * (chance.random() < 0.01) for _ in range(80))
             for _ in range(150)]
    clean = [" ".join(w + chance.choice(["", "s", "ed", "ing", "er", "ly"]) for w in t.split()) for t in clean]
    junk = [" ".join(chance.choice(["##", "$$%", "WORD!!", "||", "BUY!!"]) for _ in range(60)) for _ in range(30)]
    rows = {r.doc_id: r for r in weak_labels.scored(documents(spark, clean + junk)).collect()}
    assert all(rows[i].kept for i in range(150)) and not any(rows[i].kept for i in range(150, 180))


def test_votes_do_not_depend_on_neighbouring_texts():
    texts = [b"stop it!", b"! no", b"", b"a ##", b"", b"## b", b"c!!", b"!"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    together = weak_labels.statistics(data, np.cumsum([0, *map(len, texts)]))
    for i, text in enumerate(texts):
        alone = weak_labels.statistics(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        for name in alone.keys() - {"_words"}:
            assert together[name][i] == alone[name][0], (name, text)


# 9


def page(article, k):
    return (f"<html><head><title>t{k}</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav>"
            f"<div class='ad'>Buy {k}</div><article>{article}<p class=fixed>Read more here.</p></article>"
            f"<div id=comments><p>First {k}!</div><footer>&copy; me</footer><script>var x='</p>';</script></body>")


def test_main_text(spark):
    rows = [(k, f"https://Host.example:80/{k}?q", page(
        f"<h1>Head {k} &amp; co</h1><p>One <b>bold{k}</b>\n text<br>more<p>Two &lt;{k}&gt; ", k)) for k in range(20)]
    rows += [(100, None, None), (101, "x", ""), (102, "https://other.example/", "<p>alone &eacute;<div>next</div>tail<"),
             (103, "https://other.example/", "a<b>c</b> d<ul><li>e<li>f</ul><form>no</form>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    found = {r.page_id: r for r in html_text.texts(df).collect()}
    for k in range(20):  # the paragraph that all pages of the host share goes
        assert found[k].text == f"Head {k} & co\n\nOne bold{k} text more\n\nTwo <{k}>"
    assert found[100].text == found[101].text == ""
    assert found[102].text == "alone é\n\nnext\n\ntail<"
    assert found[103].text == "ac d\n\ne\n\nf"
    assert all(r.n_chars == len(r.text) for r in found.values())


def article(html):
    return [b["text"] for b in html_text.blocks(f"<body><article>{html}</article><p>end</p></body>")]


def test_left_out_branches_end_where_browsers_end_them():
    assert article("<p>one</p><p class=ad>Buy<p>two</p><p>three</p>") == ["one", "two", "three", "end"]
    assert article("<div><p class=ad>Buy</div><h2>two</h2>") == ["two", "end"]
    assert article("<ul><li class=share>Tweet<li>two<li>three</ul>four") == ["two", "three", "four", "end"]
    assert article("<p class=notice>All rights<table><tr><td>two</table>") == ["two", "end"]
    assert article("<dl><dt class=ad>Buy<dd>two</dl>three") == ["two", "three", "end"]
    assert article("<table><tr class=ad><td>Buy<tr><td class=ad>Buy<td>two<tbody><tr><td>three</table>") == [
        "two", "three", "end"]
    assert article("<table><tr class=ad><td>Buy<tbody><tr><td>two</table>") == ["two", "end"]
    assert article("<p>one <svg class=icon /><b>two</b>") == ["one two", "end"]
    assert article("<div class=ad><div>Buy<p>Now</div></p>still</div>two") == ["two", "end"]
    assert article("<ul class=share><li>a</li></li>b</ul>two") == ["two", "end"]
    assert article("<div class=ad>Buy") == ["end"]


def test_names_that_only_speak_of_other_branches_leave_none_out():
    def found(html):
        return [b["text"] for b in html_text.blocks(html)]

    for tag in ("html", "body", "main", "article"):
        assert found(f"<{tag} class=sidebar id=comments role=banner><p>one</p></{tag}>") == ["one"]
    for names in ("class='has-sidebar'", "id=content class='with-sidebar'", "class='post comments-open'",
                  "class=nav-below", "class='no_comments'", "id=related-work-section"):
        assert found(f"<div {names}><p>one</p></div>") == ["one"]
    for names in ("class='box sidebar'", "id=left-sidebar", "class=site-footer", "class=ad-300x250", "role=navigation",
                  "id=comments", "class='Cookie-Banner'", "hidden"):
        assert found(f"<div {names}><p>one</p></div><p>two</p>") == ["two"]
    # A branch with the article in it stays, without the branches beside the article in it.
    for begin, end in (("<div class=widget>", "</div>"), ("<form>", "</form>"), ("<div id=ad><div class=promo>", "</div></div>")):
        for tag in ("main", "article"):
            assert found(f"{begin}<h1>Head</h1><{tag}><p>one</p><div class=ad>Buy</div></{tag}>{end}") == ["Head", "one"]
    assert found("<aside><article>Teaser</article></aside><article>one</article>") == ["one"]


def test_wrappers_with_such_names_hold_the_article():
    def found(html):
        return [b["text"] for b in html_text.blocks(html) if b["inside"]] or [
            b["text"] for b in html_text.blocks(html)]

    assert found("<div class='elementor-widget wide'><p>one</p><div class='widget'>x</div></div>") == ["one"]
    # Nothing outside of left-out branches: what lies in the fewest.
    assert found("<form><p>one</p><label>Name</label><input><div class=comments>First</div><p>two</form>") == ["one", "two"]
    assert found("<div class=social><nav>Home</nav><p>one</p></div>") == ["one"]
    assert found("<form><nav>Home</nav><input value=x></form>") == []
    # The content comes before teasers, but its own article before the content.
    assert found("<div id=content><p>one</p></div><article>Teaser</article>") == ["one"]
    assert found("<article>Teaser</article><div role=main><p>one</p></div>") == ["one"]
    assert found("<div id=content><p>Lists</p><article>one</article></div>") == ["one"]
    assert found("<article><div id=content><p>one</p></div><p>two</p></article>") == ["one", "two"]
    assert found("<div id=content></div><article>one</article>") == ["one"]
    # Heads and labels within an article are its own.
    assert found("<main><div role=banner><h1>Head</h1></div><p><label>one</label> two</p></main>") == ["Head", "one two"]
    assert found("<div role=banner>Site</div><main>one</main>") == ["one"]
    # Elements without text or space of their own part no words.
    assert found("<p>super<wbr>man photo<img src=x>graph a<br>b</p>") == ["superman photograph a b"]


def test_deep_pages_take_memory_in_proportion():
    def peak(depth):
        tracemalloc.start()
        assert [b["text"] for b in html_text.blocks("<div>" * depth + "deep")] == ["deep"]
        size = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return size

    assert peak(20_000) < 3 * peak(10_000) < 60_000_000


def test_repeats_within_a_page_or_over_its_copies_are_no_noise(spark):
    refrain = "<article>" + "<p>La la la.</p>" * 12 + "<ul>" + "<li>0</li>" * 20 + "</ul><h2>End</h2></article>"
    alike = "<article><h1>Same</h1><p>Same body.</p><ul><li>x</li></ul></article>"
    own = "<article><h1>Own {0}</h1><p>Own body {0}.</p></article>"
    shared = "<article><h1>Part {0}</h1><p class=n>{1}</p><p class=n>Read more.</p></article>"
    rows = [(0, "https://alone.example/", refrain)]
    rows += [(k, f"https://copied.example/{k}", alike) for k in range(1, 61)]
    rows += [(k, f"https://copied.example/{k}", own.format(k)) for k in range(61, 64)]
    # Nearly all blocks of a path repeat; a page's own block on it stays all the same.
    rows += [(k, f"https://noisy.example/{k}", shared.format(k, "Note." if k == 110 else "Read more."))
             for k in range(100, 130)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    found = {r.page_id: r.text.split("\n\n") for r in html_text.texts(df).collect()}
    assert found[0] == ["La la la."] * 12 + ["0"] * 20 + ["End"]
    assert all(found[k] == ["Same", "Same body.", "x"] for k in range(1, 61))
    assert all(found[k] == [f"Own {k}", f"Own body {k}."] for k in range(61, 64))
    assert all(found[k] == [f"Part {k}"] + ["Note."] * (k == 110) for k in range(100, 130))


# 10


def removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    counts = collections.Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        marks = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i:i + length]] > 1:
                marks[i:i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, marks, strict=True) if not m)
        out.append((len(b), sum(marks), len(re.findall(b"\1+", bytes(marks))), kept))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repeated_bytes(spark, seed):
    chance = random.Random(seed)
    parts = ["".join(chance.choice("ab cé") for _ in range(chance.randrange(5, 70))) for _ in range(12)]
    texts = [None, "", "a" * 90, "ab" * 60, "é" * 45]
    texts += ["".join(chance.choice([*parts, "x", "yz", " "]) for _ in range(chance.randrange(1, 12)))
              for _ in range(60)]
    texts += texts[10:13]
    found = repeats.without_repeats(documents(spark, texts), 40, gram=8).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found} == dict(
        enumerate(removed(texts, 40)))


def test_kept_text_has_whole_characters(spark):
    shared = "é" * 30
    df = documents(spark, ["a" + shared + "ü", "b" + shared + "ö"])
    kept = {r.doc_id: r.kept for r in repeats.without_repeats(df, 40, gram=8, as_text=True).collect()}
    assert kept == {0: "a", 1: "b"}  # ü and ö have their first byte in common, the second is no character


def test_words_do_not_join_across_texts():
    data = np.frombuffer(b"ab cdef g", np.uint8)
    hashes, rows, counts = bytehash.words(data, np.array([0, 5, 5, 9]))
    assert counts.tolist() == [2, 0, 2] and rows.tolist() == [0, 0, 2, 2]
    assert len(set(hashes.tolist())) == 4


def test_grid_of_segments_fits():
    for entries in ([10, 10, 10], [1000, 10, 500], [5, 4000, 100], [0, 0, 0]):
        rows, columns = lm_score._grid(entries, 60)
        assert entries[0] / rows + entries[1] / columns + entries[2] / (rows * columns) <= 60
