"""Conversation repair, words that smaller documents have, ranked search: against brute force."""

import collections
import functools
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from claimgauge.llm import conversation_repair as repair
from claimgauge.llm import ranked_search, statements, word_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

# Conversations


def cheapest(symbols, most=3):
    """Every sequence of edits, with up to ``most`` inserts in a place, tried."""

    @functools.cache
    def go(i, state, inserted):
        found = []
        if i == len(symbols) and state in (0, 3):
            found.append((0, ""))
        other = "a" if state == 2 else "u"
        if inserted < most:
            found.append((3, "I", i, repair._STEP[state, other], inserted + 1))
        if i < len(symbols):
            c = symbols[i]
            found.append((4, "D", i + 1, state, 0))
            if c != "x":
                fault = 3 if c.isupper() else 0
                for role in "sua":
                    if (state, role) in repair._STEP:
                        after = repair._STEP[state, role]
                        if c.lower() == role:
                            found.append((fault, "K", i + 1, after, 0))
                        if role != "s":
                            found.append((fault + 3, "R", i + 1, after, 0))
        out = []
        for cost, letter, *rest in found:
            if not rest:
                out.append((cost, letter))
            elif (further := go(*rest)) is not None:
                out.append((cost + further[0], letter + further[1]))
        return min(out, default=None)

    return go(0, 0, 0)


def test_search_finds_the_cheapest_edits_and_pieces_agree():
    chance = random.Random(2)
    short = ["".join(s) for n in range(4) for s in itertools.product("xsuaoUA", repeat=n)]
    long = ["".join(chance.choice("xsuaoSUAOuaua") for _ in range(chance.randrange(4, 25))) for _ in range(150)]
    for symbols in short + long:
        found = repair.search(symbols)
        assert found == cheapest(symbols), symbols
        fresh, _ = repair.bounds(symbols)
        assert fresh[0] <= found[0]
        at = chance.randrange(len(symbols) + 1)
        states = (0, 1, 2, 3)
        pieces = [repair.table_of(symbols[:at], states), repair.table_of(symbols[at:], states)]
        assert repair.closed(repair.joined(pieces)) == found


def expected_repair(rows):
    """From damaged (turn, role, text) rows of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, symbols, counts = set(), "", collections.Counter()
    for _, role, text in rows:
        kept = WORD.findall(text)
        if not kept or (role, text) in seen:
            counts["duplicate" if kept else "blank"] += 1
            symbols += "x"
            continue
        seen.add((role, text))
        symbol = role[:1] if role[:1] in ("s", "u", "a") else "o"
        cut = kept[-1][-1] not in ".!?"
        counts["truncated"] += cut
        symbols += symbol.upper() if cut else symbol
    counts["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    turns = [t for t, *_ in rows if t is not None]
    counts["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = repair.search(symbols)
    lines, at, started = [], 0, ""
    for letter in audit:
        if letter != "I":
            _, role, text = rows[at]
            at += 1
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if started == "u" else "user"
        started = role[0]
        lines.append((letter, role, "" if letter == "I" else text))
    return counts, cost, audit, lines


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, extra int"


@pytest.fixture(scope="module")
def conversations(spark):
    chance = random.Random(5)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(chance.choice([0, 1, 3, 5, 9, 80])):
            role = chance.choice(["system", "user", "assistant", "assistant", "tool", "", None])
            text = chance.choice(["Yes.", "No", "", " \n", "Why? ", "Ümlaut!", "x" * 50 + ".", None, f"Number {turn}."])
            rows.append((conv, chance.choice([turn, turn, turn + 2, None]), role, text, 1))
    return spark.createDataFrame(rows, CONVERSATIONS).repartition(3), rows


def test_repair_of_damaged_rows(spark, conversations, monkeypatch):
    frame, rows = conversations
    damaged = collections.defaultdict(list)
    for conv, turn, role, text, _ in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            damaged[conv] += [(turn, "user" if kind == 4 else role, "" if kind == 1 else
                               re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)
    found = {r.conv_id: r for r in repair.digests(repair.damaged(frame), frame).collect()}
    assert set(found) == {r[0] for r in rows}
    for conv, row in found.items():
        counts, cost, audit, lines = expected_repair(damaged[conv])
        text = "\n".join(f"{role}:{text}" for _, role, text in lines)
        assert (row.cost, row.audit) == (cost, audit)
        assert row.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert all(row[name] == counts[name] for name in ("gaps", "blank", "duplicate", "truncated", "illegal"))


def test_repaired_rows_are_in_order(conversations):
    frame, rows = conversations
    own = collections.defaultdict(list)
    for conv, turn, role, text, _ in rows:
        own[conv].append((turn, " " if role is None else role, " " if text is None else text))
    found = collections.defaultdict(list)
    for r in repair.repaired(frame).orderBy("conv_id", "place").collect():
        found[r.conv_id].append((r.edit, r.role, r.text))
        assert r.place == len(found[r.conv_id])
    for conv in own:
        assert found[conv] == expected_repair(own[conv])[3]


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert repair.digests(repair.damaged(none), none).count() == 0
    one = spark.createDataFrame([(1, 0, "user", "x", 1)], CONVERSATIONS)
    row = repair.digests(one.limit(0), one).first()
    assert (row.cost, row.audit, row.repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())


def test_repair_sql(conversations):
    rows = conversations[1]
    want = run_sql(statements.conversation_repair(), "conversations", rows, "conv_id bigint, turn bigint, role varchar, text varchar, extra int")
    found = repair.digests(repair.damaged(conversations[0]), conversations[0])
    assert sorted(map(repr, map(tuple, found.select(*want[0]).collect()))) == sorted(map(repr, want[1]))


def run_sql(statement, name, rows, schema, **others):
    connection = duckdb.connect()
    for table, columns, values in ((name, schema, rows), *((k, *v) for k, v in others.items())):
        connection.execute(f"create table {table} ({columns})")
        connection.executemany(f"insert into {table} values ({', '.join('?' * len(values[0]))})", values)
    done = connection.execute(statement)
    return [d[0] for d in done.description], done.fetchall()


# Words


@pytest.fixture(scope="module")
def prose():
    chance = random.Random(8)
    vocabulary = ["".join(chance.choice("aeinrst") for _ in range(chance.randrange(1, 6))) for _ in range(80)] + ["Ö", "é\x00"]
    passage = [" ".join(chance.choice(vocabulary) for _ in range(chance.randrange(10, 60))) for _ in range(6)]
    texts = []
    for _ in range(70):
        parts = [" ".join(chance.choice(vocabulary[: chance.choice([2, 80])]) for _ in range(chance.randrange(0, 40)))]
        parts += chance.sample(passage, chance.choice([0, 0, 1, 2]))
        chance.shuffle(parts)
        texts.append(chance.choice([" ", "\n", " \t "]).join(parts))
    texts += [None, "", " \n", "a " * 500, "a " * 300, texts[3], texts[3].replace(" ", "\n"), texts[3]]
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (3, texts[3]), (3, texts[5] + " " + texts[4])]


def without_copies(rows, length):
    split = [WORD.findall(t or "") for _, t in rows]
    least = {}
    for (doc, _), w in zip(rows, split, strict=True):
        for i in range(len(w) - length + 1):
            if doc is not None:
                window = tuple(w[i:i + length])
                least[window] = min(least.get(window, doc), doc)
    out = []
    for (doc, _), w in zip(rows, split, strict=True):
        gone = {j for i in range(len(w) - length + 1) if doc is not None
                and least[tuple(w[i:i + length])] < doc for j in range(i, i + length)}
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length, lot, part", [(13, 5000, 1 << 18), (13, 2, 1 << 18), (5, 3, 64), (13, 5000, 40)])
def test_words_of_smaller_documents_go(spark, prose, monkeypatch, length, lot, part):
    monkeypatch.setattr(word_repeats, "PART", part)
    frame = spark.createDataFrame(prose, "doc_id bigint, text string").repartition(5)
    found = word_repeats.without_copies(frame, length, min(4, length), lot)
    assert found.columns == ["doc_id", "text", "n_words", "n_removed", "kept"]
    rows = found.select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, rows), key=repr) == without_copies(prose, length)


def test_words_sql(spark, prose):
    want = run_sql(statements.word_repeats(), "documents", prose, "doc_id bigint, text varchar")
    found = word_repeats.digests(spark.createDataFrame(prose, "doc_id bigint, text string"))
    assert sorted(map(repr, map(tuple, found.select(*want[0]).collect()))) == sorted(map(repr, want[1]))


def test_words_of_a_long_text_and_of_clashing_columns(spark):
    chance = random.Random(1)
    words = [str(chance.randrange(10**6)) for _ in range(400_000)]
    long, other = " ".join(words), "start " + " ".join(words[262_000:262_300])
    frame = spark.createDataFrame([(1, long, 5, 6), (2, other, 5, 6)], "doc_id bigint, text string, kept int, mini int")
    rows = {r.doc_id: r for r in word_repeats.without_copies(frame).collect()}
    assert (rows[1].n_removed, rows[2].n_removed, rows[2].kept, rows[2].mini) == (0, 300, "start", 6)
    assert word_repeats.without_copies(frame.limit(0)).count() == 0


# Search


def best(documents, items, top):
    split = [(doc, TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for doc, t in documents]
    split = [(doc, t, collections.Counter(t)) for doc, t in split if t]
    n, total = len(split), sum(len(t) for _, t, _ in split)
    df = collections.Counter(x for _, _, c in split for x in c)
    out = []
    for item, text in items:
        own = set(TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))
        scored = []
        for doc, t, c in split:
            m = 50 + 50 * len(t) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 20 * m))
                        for x in own if x in c)
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, r, doc, -score) for r, (score, _, _, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    chance = random.Random(3)
    vocabulary = [f"W{i}" for i in range(150)] + ["É", "straße", "İ", "naïve"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = ["-".join(chance.choices(vocabulary, weights, k=chance.randrange(0, 60))) for _ in range(250)]
    documents = [(i, t) for i, t in enumerate([*texts, None, "", "...", texts[0], texts[1]])] + [(None, texts[2]), (7, texts[2])]
    items = [(i, "_".join(chance.choices(vocabulary, weights, k=chance.choice([1, 5, 100])))) for i in range(20)]
    return documents, [*items, (3, items[4][1]), (None, "w1 w2"), (90, None), (91, "?"), (92, "unknown")]


@pytest.mark.parametrize("top, lot, block", [(50, 4 << 20, 1 << 20), (3, 300, 200)])
def test_ranked_search_is_exact(spark, corpus, monkeypatch, top, lot, block):
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    documents, items = (spark.createDataFrame(rows, schema).repartition(3) for rows, schema in zip(
        corpus, ("doc_id bigint, text string", "item_id bigint, text string"), strict=True))
    found = ranked_search.ranked(documents.selectExpr("*", "1 as score"), items.selectExpr("*", "2 as rank"), top, lot)
    assert sorted(map(tuple, found.collect()), key=repr) == best(*corpus, top)
    assert ranked_search.ranked(documents.limit(0), items).count() == 0
    assert ranked_search.ranked(documents, items.limit(0)).count() == 0


def test_search_sql(spark, corpus):
    want = run_sql(statements.ranked_search(), "documents", corpus[0], "doc_id bigint, text varchar",
                   benchmark=("item_id bigint, text varchar", corpus[1]))
    assert sorted(want[1], key=repr) == best(*corpus, 50)


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(ranked_search, "CUT", 16)
    text = "".join(random.Random(1).choices("aB9 -é", k=700)) + "x" * 100 + " end"
    assert [t.decode() for part in ranked_search.terms(text) for t in part] == TERM.findall(text.lower())


def test_masks_below_the_last_score_are_not_evaluated():
    """One document has all five rare terms; a thousand have one common term."""
    owners = np.r_[np.zeros(5, int), np.arange(1000)]
    ids = np.r_[np.arange(5), np.full(1000, 5)]
    block = ranked_search.Block([10] * 1000, owners, ids, np.ones(1005, np.int64), 6, 1000, 10000)
    seen = []
    item, weights = np.arange(6), np.array([9, 9, 9, 9, 9, 1])
    have, scores = block.search(item, weights, 1, np.arange(1000), seen)
    assert have.tolist() == [0] and len(seen) == 1 and scores[0] == 46 * block.best[0]
