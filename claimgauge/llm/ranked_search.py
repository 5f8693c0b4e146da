"""Ranked lexical search by presence masks.

Every document's terms are looked up among the terms of the searched items. A task takes its documents
in blocks of about ``BLOCK`` found terms and answers each item block by block:

1. each document of the block gets a mask, one bit for each term of the item that it holds, by
   or-ing the bits of the terms' postings into words of 64;
2. documents are grouped by equal masks, and a mask's maximum score is the sum, over its terms, of the
   best contribution that the term makes anywhere in the block;
3. masks are evaluated by descending maximum: the documents of the best ones are scored exactly, and
   it ends safely when the next mask's maximum lies below the score of the ``top``-th document so far.
   An equal maximum is still evaluated, as a smaller doc_id may tie.

The best of each block are merged per item. Documents travel nowhere: only document counts of terms,
from a first pass, and up to ``top`` rows for each item and block are shuffled.

Items go out by broadcast in lots of about ``LOT_BYTES`` of text, dealt by hash; more items mean more
passes over the documents, never a larger broadcast (but for one item that is larger by itself).

Edge cases: a null or empty text has no terms; a document or item without terms is in no result;
repeated rows are documents, or items, of their own; equal scores go by doc_id, null first; a long text
is cut into terms ``CUT`` bytes at a time; empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimgauge.llm.shared import keep

LOT_BYTES = 4 << 20
#: Found terms of a block, and documents of a block at most.
BLOCK, MOST = 1 << 20, 1 << 15
CUT = 1 << 20

#: A-Z to a-z; ASCII but digits and letters to a space. Bytes of other characters stay.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, list by list."""
    data = text.encode()
    begin = 0
    while begin < len(data):
        part = data[begin:begin + CUT].translate(_TABLE)
        if begin + CUT < len(data):  # end the part after its last separator
            end = part.rfind(b" ") + 1
            while not end:
                more = data[begin + len(part):begin + len(part) + CUT].translate(_TABLE)
                end = len(part) + more.find(b" ") + 1 if b" " in more else 0
                part += more
                if not more:
                    end = len(part)
            part = part[:end]
        begin += len(part)
        yield part.split()


def _counts(text: str, known: dict[bytes, int]) -> tuple[int, Counter]:
    """(number of terms, how often each known term occurs)."""
    n, found = 0, Counter()
    for part in terms(text):
        n += len(part)
        found.update(map(known.get, part))
    found.pop(None, None)
    return n, found


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        yield batch, [x or "" for x in batch.column(column).to_pylist()]


def _statistics(documents: DataFrame, lot: _Lot) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, their terms, and for each term of the lot the documents that hold it.

    Counted by task first; what is collected has a row for each term of the lot at most.
    """
    sent = documents.sparkSession.sparkContext.broadcast(lot.known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        holding = Counter()
        for _, texts in _texts(batches, "text"):
            for text in texts:
                n, found = _counts(text, known)
                holding.update(found.keys())
                holding[-1] += n > 0
                holding[-2] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array(holding.keys(), pa.int64()), pa.array(holding.values(), pa.int64())], ["term", "n"])

    rows = documents.select("text").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r.term: r.n for r in rows.collect()}
    sent.destroy()
    return found.pop(-1, 0), found.pop(-2, 0), found


class _Lot:
    """Items with the numbers of their terms."""

    def __init__(self, items: list[tuple[int, str]]):
        self.known: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for number, text in items:
            own = {self.known.setdefault(t, len(self.known)) for part in terms(text) for t in part}
            self.items.append((number, np.array(sorted(own), np.int64)))


class Block:
    """Found terms of some documents, ready for any item."""

    def __init__(self, sizes: list[int], owners: np.ndarray, ids: np.ndarray, tf: np.ndarray,
                 n_terms: int, documents: int, total: int):
        m = 50 + 50 * np.array(sizes, np.int64) * documents // total
        self.n, self.n_terms = len(sizes), n_terms
        part = 1_000_000_000 * tf // (1000 * tf + 20 * m[owners])
        order = np.argsort(owners * n_terms + ids, kind="stable")
        self.keys, self.by_key = (owners * n_terms + ids)[order], part[order]
        order = np.argsort(ids, kind="stable")
        self.holders, self.parts = owners[order], part[order]
        self.ends = np.searchsorted(ids[order], np.arange(n_terms + 1))
        self.best = np.zeros(n_terms, np.int64)
        np.maximum.at(self.best, ids, part)

    def masks(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct masks, documents sorted by mask, where each mask's documents begin and end)."""
        words = np.zeros((self.n, -(-len(item) // 64)), np.uint64)
        for bit, term in enumerate(item.tolist()):
            holders = self.holders[self.ends[term]:self.ends[term + 1]]
            words[holders, bit // 64] |= np.uint64(1 << bit % 64)
        some = np.flatnonzero(words.any(axis=1))
        order = np.lexsort(words[some].T)
        rows = words[some[order]]
        new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]) if len(rows) else np.empty(0, int)
        return rows[new], some[order], np.r_[new, len(rows)]

    def scores(self, documents: np.ndarray, item: np.ndarray, weights: np.ndarray) -> np.ndarray:
        wanted = documents[:, None] * self.n_terms + item[None, :]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.by_key[at], 0) @ weights

    def search(self, item: np.ndarray, weights: np.ndarray, top: int, ids: np.ndarray,
               seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the ``top`` best; ``ids`` orders equal scores."""
        masks, documents, bounds = self.masks(item)
        if not len(masks):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        bits = np.unpackbits(masks.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :len(item)]
        most = bits.astype(np.int64) @ (weights * self.best[item])
        order = np.argsort(-most, kind="stable")
        sizes = np.diff(bounds)[order]
        have, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        at, step, limit = 0, top, 1
        while at < len(order) and most[order[at]] >= limit:
            # Masks for about ``step`` documents, of those that may still matter.
            end = at + 1 + int(np.searchsorted(np.cumsum(sizes[at:]), step))
            end = min(end, at + int(np.searchsorted(-most[order[at:]], -limit, "right")))
            new = np.concatenate([documents[bounds[g]:bounds[g + 1]] for g in order[at:end]])
            have = np.r_[have, new]
            scores = np.r_[scores, self.scores(new, item, weights)]
            if seen is not None:
                seen.extend(order[at:end].tolist())
            best = np.lexsort((ids[have], -scores))[:top]
            have, scores = have[best], scores[best]
            if len(scores) == top:
                limit = max(1, int(scores[-1]))
            at, step = end, step * 2
        return have[scores > 0], scores[scores > 0]


_FOUND = "item bigint, score bigint, doc_id bigint"


def _best(documents: DataFrame, lot: _Lot, top: int) -> DataFrame:
    """The best of each item in each block."""
    n_documents, total, holding = _statistics(documents, lot)
    weight = np.zeros(len(lot.known), np.int64)
    for term, n in holding.items():
        weight[term] = math.floor(1000 * math.log((2 * n_documents + 2) / (2 * n + 1)))
    items = [(number, own[weight[own] > 0]) for number, own in lot.items]
    items = [(number, own) for number, own in items if len(own)]
    sent = documents.sparkSession.sparkContext.broadcast((lot.known, weight, items))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight, items = sent.value
        sizes, doc_ids, counts, held = [], [], [], 0

        def answer() -> pa.RecordBatch:
            owners = np.repeat(np.arange(len(sizes)), [len(c) for c in counts])
            ids = np.fromiter((t for c in counts for t in c), np.int64, held)
            tf = np.fromiter((x for c in counts for x in c.values()), np.int64, held)
            block = Block(sizes, owners, ids, tf, len(known), n_documents, total)
            # Places of the doc_ids in their order, null first.
            places = np.empty(len(sizes), np.int64)
            places[sorted(range(len(sizes)), key=lambda i: (doc_ids[i] is not None, doc_ids[i]))] = np.arange(len(sizes))
            out = [], [], []
            for number, item in items:
                have, scores = block.search(item, weight[item], top, places)
                out[0].extend([number] * len(have))
                out[1].extend(scores.tolist())
                out[2].extend(doc_ids[d] for d in have.tolist())
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["item", "score", "doc_id"])

        for batch, texts in _texts(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                n, found = _counts(text, known)
                if found:
                    sizes.append(n)
                    doc_ids.append(doc_id)
                    counts.append(found)
                    held += len(found)
                if held >= BLOCK or len(sizes) >= MOST:
                    yield answer()
                    sizes, doc_ids, counts, held = [], [], [], 0
        if sizes:
            yield answer()

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(search, _FOUND)


def ranked(documents: DataFrame, items: DataFrame, top: int = 50, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``top`` best documents of each item."""
    numbered = keep(items.select("item_id", "text", F.monotonically_increasing_id().alias("item")), "items")
    size = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lots = 1 + size // lot_bytes
    found: DataFrame | None = None
    for n in range(lots):
        mine = numbered.where(F.pmod(F.xxhash64("item"), F.lit(lots)) == n).where("text is not null")
        lot = _Lot([(r.item, r.text) for r in mine.select("item", "text").collect()])
        best = keep(_best(documents, lot, top), "ranked")
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    placed = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return placed.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
