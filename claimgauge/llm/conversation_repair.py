"""Repair of conversations at least cost, by depth-first branch-and-bound.

The rows of a conversation are kept, given another role, deleted, or preceded by inserted rows, so
that the initials of the roles read ``(s?(ua)+)?``. The cheapest edits are wanted, and among them
those whose initials (Delete, Insert, Keep, Rerole), the *audit*, come first in ASCII order.

``search`` goes depth first over (row, state) with an explicit stack. Suffix lower bounds count what
the rest must cost whatever is done: faults, roles that can't stay, and disjoint neighbours of equal
role. The incumbent (cost, audit) cuts prefixes that can't beat it. A dominance table for each node
holds its best prefix; a worse one goes. Prefixes that meet in a node have consumed the same rows, so
at equal cost neither begins with the other, and the lesser audit stays less whatever follows.

Rows are sorted by range, so a conversation with very many rows is spread over tasks. Each task cuts
it into pieces of ``PIECE`` rows and solves a piece for every pair of states at its ends; the few
pieces of a conversation are then put together. Only the last step streams a conversation's texts
through one task, a batch at a time, since it is hashed or numbered from its first row on; the audit,
one letter for a row, is one value of the result and held whole there.

Edge cases: null role and text are one space; null turns come first; a null conv_id is a
conversation; rows of one turn go by role and then by text, so equal rows are neighbours, and all but
the first are duplicates; a role that begins with none of s, u, a (an empty one too) can't be kept;
texts of any length are hashed whole; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgauge.llm.shared import SPACE_CHARS, keep

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a piece. A whole conversation of no more rows, inside one task, is solved at once.
PIECE = 32

START, AFTER_S, AFTER_U, AFTER_A = range(4)
_STEP = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U,
         (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
#: What the end costs in each state: an open turn needs its answer, a lone system row a whole turn.
_CLOSING = {START: "", AFTER_S: "II", AFTER_U: "I", AFTER_A: ""}
_LEGAL_PAIRS = {"su", "ua", "au"}

Answer = tuple[int, str]
Table = dict[tuple[int, int], Answer]


# Symbols: x must go; s, u, a, o (another role) may stay; S, U, A, O are truncated.

def _must_cost(symbol: str, started: bool) -> int:
    if symbol == "x":
        return DELETE
    fault = TRUNCATED if symbol.isupper() else 0
    kind = symbol.lower()
    if kind == "o" or (kind == "s" and started):
        return min(DELETE, REROLE + fault)
    return min(DELETE, fault)


def bounds(symbols: str) -> tuple[list[int], list[int]]:
    """What rows i and later cost at least, before and after the first row that stays."""
    n = len(symbols)
    fresh, started, pairs = [0] * (n + 1), [0] * (n + 1), [0] * (n + 2)
    following, after = "", n  # the next row that need not go, and its place
    for i in range(n - 1, -1, -1):
        symbol = symbols[i]
        fresh[i] = fresh[i + 1] + _must_cost(symbol, False)
        started[i] = started[i + 1] + _must_cost(symbol, True)
        pairs[i] = pairs[i + 1]
        if symbol != "x":
            if following and symbol.lower() == following.lower() and symbol.lower() in "ua":
                # One of the two changes its role or goes, or a row comes between. A truncated row
                # that goes costs 1 more than it does anyway.
                more = 1 if symbol.isupper() or following.isupper() else min(REROLE, INSERT)
                pairs[i] = max(pairs[i], more + pairs[after + 1])
            following, after = symbol, i
    return ([a + p for a, p in zip(fresh, pairs, strict=False)],
            [a + p for a, p in zip(started, pairs, strict=False)])


@lru_cache(1 << 16)
def search(symbols: str, entry: int = START, leave: int | None = None) -> Answer | None:
    """The least (cost, audit) from state ``entry``.

    Without ``leave`` to the end of a conversation, with what may be inserted there; else to state
    ``leave`` after the last row, or None where it can't be reached.
    """
    n = len(symbols)
    fresh, started = bounds(symbols)
    best: Answer | None = None
    tables: list[dict[int, Answer]] = [{} for _ in range(n + 1)]
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        rest = (fresh if state == START else started)[i]
        if i == n and leave is None:
            rest = INSERT * len(_CLOSING[state])
        if best is not None and (
                cost + rest > best[0] or cost + rest == best[0] and audit > best[1][:len(audit)]):
            continue
        known = tables[i].get(state)
        if known is not None and known <= (cost, audit):
            continue
        tables[i][state] = (cost, audit)
        if i == n:
            if leave is None:
                found = (cost + rest, audit + _CLOSING[state])
            elif leave == state:
                found = (cost, audit)
            else:
                continue
            best = found if best is None else min(best, found)
            continue
        children = []
        for letter, price, after, role in _moves(symbols[i], state):
            place = i if letter == "I" else i + 1
            bound = (fresh if role == START else started)[place]
            children.append((cost + price + bound, letter, (place, role, cost + price, audit + letter)))
        children.sort(reverse=True)
        stack += [child for *_, child in children]
    return best


@lru_cache
def _moves(symbol: str, state: int) -> list[tuple[str, int, str, int]]:
    """(letter, cost, role or "", next state) of each edit of a row, or before it."""
    other = "a" if state == AFTER_U else "u"
    moves = [("D", DELETE, "", state), ("I", INSERT, other, _STEP[state, other])]
    if symbol != "x":
        fault, kind = (TRUNCATED if symbol.isupper() else 0), symbol.lower()
        if (state, kind) in _STEP:
            moves.append(("K", fault, kind, _STEP[state, kind]))
        if kind != other:
            moves.append(("R", REROLE + fault, other, _STEP[state, other]))
    return moves


def table_of(symbols: str, entries: tuple[int, ...]) -> Table:
    found = {(e, x): search(symbols, e, x) for e in entries for x in range(4)}
    return {ends: answer for ends, answer in found.items() if answer is not None}


def joined(tables: list[Table]) -> Table:
    """One table for pieces that follow each other, neighbours first."""
    while len(tables) > 1:
        pairs = [_two(a, b) for a, b in zip(tables[::2], tables[1::2], strict=False)]
        tables = pairs + tables[len(tables) - len(tables) % 2:]
    return tables[0] if tables else {(START, START): (0, "")}


def _two(left: Table, right: Table) -> Table:
    out: Table = {}
    for (entry, middle), (cost, audit) in left.items():
        for (start, leave), (more, further) in right.items():
            ends = (entry, leave)
            if middle == start and (ends not in out or cost + more <= out[ends][0]):
                found = (cost + more, audit + further)
                out[ends] = min(out.get(ends, found), found)
    return out


def closed(table: Table) -> Answer:
    return min((cost + INSERT * len(_CLOSING[leave]), audit + _CLOSING[leave])
               for (entry, leave), (cost, audit) in table.items() if entry == START)


# Rows

_FACTS = ("rows", "low", "high", "turns", "illegal", "blank", "duplicate", "truncated")
_PIECE = T.StructType([
    *(T.StructField(name, T.LongType()) for name in _FACTS),
    T.StructField("first", T.StringType()), T.StructField("last", T.StringType()),
    T.StructField("ends", T.ArrayType(T.IntegerType())),
    T.StructField("costs", T.ArrayType(T.LongType())),
    T.StructField("audits", T.ArrayType(T.StringType())),
])


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows as the check of this operator damages them, by a checksum of ``conv_id:turn``."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.encode(F.concat(shown("conv_id"), F.lit(":"), shown("turn")), "UTF-8")) % 20
    return conversations.select("conv_id", "turn", "role", "text", kind.alias("kind")).where("kind != 0").select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(shown("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(shown("text"), ".!?", ""))
        .otherwise(shown("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def _sorted(rows: DataFrame) -> DataFrame:
    """Adds ``at``, which numbers all rows in order, and what a row alone tells. Written once."""
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    filled = rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        copies.alias("copies"))
    # Texts as range keys would be sampled whole by the driver.
    ranged = filled.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32))
    last = F.substring(F.regexp_replace("text", f"[{SPACE_CHARS}]+$", ""), -1, 1)
    return keep(
        ranged.sortWithinPartitions("conv_id", "turn", "role", "text").select(
            "*", F.monotonically_increasing_id().alias("at"), F.unhex(F.sha2("text", 256)).alias("hash"),
            (F.translate("text", SPACE_CHARS, "") == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut_off")),
        "conversations")


def _pieces(rows: DataFrame) -> DataFrame:
    """(conv_id, at, piece): solved pieces of conversations, numbered in order by ``at``."""
    said = rows.where("not blank")
    firsts = said.groupBy("conv_id", "role", "hash").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    marked = rows.select("conv_id", "at", "turn", F.substring("role", 1, 1).alias("initial"), "copies",
                         "blank", "cut_off").join(firsts, "at", "left")
    ordered = marked.repartitionByRange("at").sortWithinPartitions("at").select(
        "conv_id", "at", "turn", "initial", "copies", "blank", "cut_off", "new")
    kind = rows.schema["conv_id"]
    schema = T.StructType([kind, T.StructField("at", T.LongType()), T.StructField("piece", _PIECE)])
    arrow = _arrow(schema)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        open_piece: _Open | None = None
        first = True
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for conv, at, turn, initial, copies, blank, cut_off, new in zip(*columns, strict=True):
                other = open_piece is None or open_piece.conv != conv
                if other or len(open_piece.symbols) >= PIECE:
                    if open_piece is not None:
                        done.append(open_piece.solved(ends=other))
                        first = False
                    # The first conversation of a task may have begun in another.
                    begins = other and not first
                    open_piece = _Open(conv, at, begins)
                open_piece.add(turn, initial, copies, blank, cut_off, new)
            if done:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done = []
        if open_piece is not None:
            yield pa.RecordBatch.from_pylist([open_piece.solved(ends=False)], arrow)

    return ordered.mapInArrow(solve, schema)


class _Open:
    """A piece while its rows come in."""

    def __init__(self, conv: object, at: int, begins: bool):
        self.conv, self.at, self.begins = conv, at, begins
        self.symbols: list[str] = []
        self.facts = dict.fromkeys(_FACTS, 0) | {"low": None, "high": None, "first": None, "last": None}

    def add(self, turn, initial, copies, blank, cut_off, new) -> None:
        facts = self.facts
        if turn is not None:
            facts["turns"] += turn != facts["high"]
            facts["low"] = turn if facts["low"] is None else facts["low"]
            facts["high"] = turn
        for copy in range(copies):
            if facts["last"] is None:
                facts["first"] = initial
            else:
                facts["illegal"] += facts["last"] + initial not in _LEGAL_PAIRS
            facts["last"] = initial
            facts["rows"] += 1
            if blank or copy or not new:
                facts["blank" if blank else "duplicate"] += 1
                self.symbols.append("x")
            else:
                symbol = initial if initial and initial in "sua" else "o"
                facts["truncated"] += cut_off
                self.symbols.append(symbol.upper() if cut_off else symbol)

    def solved(self, ends: bool) -> dict:
        symbols = "".join(self.symbols)
        if self.begins and ends:
            cost, audit = search(symbols)
            table = {(START, -1): (cost, audit)}
        else:
            table = table_of(symbols, (START,) if self.begins else (START, AFTER_S, AFTER_U, AFTER_A))
        return {"conv_id": self.conv, "at": self.at, "piece": self.facts | {
            "ends": [5 * e + x + 1 for e, x in table],
            "costs": [cost for cost, _ in table.values()],
            "audits": [audit for _, audit in table.values()]}}


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _summed(pieces: list[dict]) -> tuple[dict[str, int], Answer]:
    """The facts of a conversation and its answer."""
    facts = dict.fromkeys(_FACTS, 0) | {"low": None, "high": None, "last": None}
    for p in pieces:
        if not p["rows"]:
            continue
        for name in ("rows", "illegal", "blank", "duplicate", "truncated"):
            facts[name] += p[name]
        if facts["last"] is not None:
            facts["illegal"] += facts["last"] + p["first"] not in _LEGAL_PAIRS
        facts["last"] = p["last"]
        if p["low"] is not None:
            facts["turns"] += p["turns"] - (p["low"] == facts["high"])
            facts["low"] = p["low"] if facts["low"] is None else facts["low"]
            facts["high"] = p["high"]
    facts["gaps"] = 0 if facts["low"] is None else facts["high"] - facts["low"] + 1 - facts["turns"]
    tables = [{divmod(e, 5): (cost, audit) for e, cost, audit in zip(p["ends"], p["costs"], p["audits"], strict=True)}
              for p in pieces if p["rows"]]
    tables = [{(e, x - 1): answer for (e, x), answer in t.items()} for t in tables]
    if len(tables) == 1 and (START, -1) in tables[0]:
        return facts, tables[0][START, -1]
    return facts, closed(joined(tables))


class _Editor:
    """Applies an audit to the rows of its conversation as they come."""

    def __init__(self, audit: str):
        self.audit, self.i, self.state = audit, 0, START

    def _other(self) -> str:
        role = "assistant" if self.state == AFTER_U else "user"
        self.state = _STEP[self.state, role[0]]
        return role

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.i:self.i + 1] == "I":
            self.i += 1
            yield "I", self._other(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        letter = self.audit[self.i]
        self.i += 1
        if letter == "K":
            self.state = _STEP[self.state, role[0]]
            yield letter, role, text
        elif letter == "R":
            yield letter, self._other(), text


_FOUND = ("gaps", "blank", "duplicate", "truncated", "illegal")


def _applied(rows: DataFrame, all_ids: DataFrame, schema: T.StructType, make) -> DataFrame:
    """Streams each conversation's pieces and then its rows through ``make(conv, facts, answer)``,
    which has ``edit`` for each edited row and ``end`` for the conversation's output rows."""
    rows = _sorted(rows)
    heads = all_ids.select("conv_id").distinct().select(
        "conv_id", F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("at"), F.lit(None).cast(_PIECE).alias("piece"))
    pieces = keep(_pieces(rows), "pieces").select("conv_id", F.lit(0).alias("kind"), "at", "piece")
    none = [F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies")]
    stream = heads.unionByName(pieces).select("*", *none).unionByName(rows.select(
        "conv_id", F.lit(1).alias("kind"), "at", F.lit(None).cast(_PIECE).alias("piece"), "role", "text", "copies"))
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "at")
    arrow = _arrow(schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unset = object()
        conv, pieces, editor, target = unset, [], None, None
        out: list[dict] = []

        def start() -> None:
            nonlocal editor, target
            facts, answer = _summed(pieces)
            editor, target = _Editor(answer[1]), make(conv, facts, answer)

        def end() -> None:
            if conv is unset:
                return
            if editor is None:
                start()
            for edit in editor.inserted():
                out.extend(target.edit(*edit))
            out.extend(target.end())

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for own, kind, _, piece, role, text, copies in zip(*columns, strict=True):
                if own != conv or conv is unset:
                    end()
                    conv, pieces, editor = own, [], None
                if kind == 0:
                    if piece is not None:
                        pieces.append(piece)
                    continue
                if editor is None:
                    start()
                for _ in range(copies):
                    for edit in editor.row(role, text):
                        out.extend(target.edit(*edit))
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
        end()
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return stream.mapInArrow(apply, schema)


class _Digest:
    def __init__(self, conv: object, facts: dict, answer: Answer):
        self.row = {"conv_id": conv} | {name: facts[name] for name in _FOUND} | {"cost": answer[0], "audit": answer[1]}
        self.hash, self.lines = hashlib.sha256(), 0

    def edit(self, letter: str, role: str, text: str) -> list[dict]:
        self.hash.update(b"\n" if self.lines else b"")
        self.hash.update(f"{role}:{text}".encode())
        self.lines += 1
        return []

    def end(self) -> list[dict]:
        return [self.row | {"repaired_sha256": self.hash.hexdigest()}]


class _Rows:
    def __init__(self, conv: object, facts: dict, answer: Answer):
        self.conv, self.place = conv, 0

    def edit(self, letter: str, role: str, text: str) -> list[dict]:
        self.place += 1
        return [{"conv_id": self.conv, "place": self.place, "edit": letter, "role": role, "text": text}]

    def end(self) -> list[dict]:
        return []


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 1), edit (I, K or R), role, text.

    ``rows`` has conv_id, turn, role and text, and may have ``copies``, how often a row stands there.
    """
    schema = T.StructType([rows.schema["conv_id"], T.StructField("place", T.LongType()),
                           *(T.StructField(x, T.StringType()) for x in ("edit", "role", "text"))])
    return _applied(rows, rows, schema, _Rows)


def digests(rows: DataFrame, all_ids: DataFrame) -> DataFrame:
    """For each conv_id of ``all_ids``: faults, cost, audit and the hash of the repaired rows."""
    schema = T.StructType([
        all_ids.schema["conv_id"], *(T.StructField(x, T.LongType()) for x in (*_FOUND, "cost")),
        T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return _applied(rows, all_ids, schema, _Digest)
