"""Benchmark passages in documents, by q-gram counts in diagonal bands and banded alignment.

Both sides are normalised: lower case, runs of other characters than letters and digits become one
space. Benchmark items are cut into windows of 60 characters, one begun every 6, so that each verbatim
passage of 60 characters is found wherever it begins; the edits allowed make good what it lacks of a
window at its ends. Passages of 120 characters, and whole items under that, are found with twice the edits.
A window of m characters may be met with up to e edits. By the q-gram lemma, a region of a document
with so many edits shares at least m + 1 - q - e * q of the window's q-grams, and all of them lie on
diagonals that differ by e at most. Bands of diagonals overlap by e, so each such region lies whole
in one band. Bands with enough shared q-grams are verified by an alignment confined to the band.

The windows are taken in blocks of bounded size; each block is broadcast and held against all rows.

Edge cases: null and empty texts have no matches; items of fewer than LEAST characters are no evidence
and only reported by ``mentions``, those of fewer than q characters, which have no q-gram, not at all;
repeated rows match alike; an empty table or benchmark gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Hashable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgauge.llm.bytehash import mix

GRAM = 10
#: The least passage of an item that is found wherever it begins, in normalised characters.
WINDOW = 60
#: Characters from window to window. A passage of WINDOW characters lies off a window by half of it at
#: most, which the edits allowed make good; it divides WINDOW, so two windows make up any text twice as
#: long with twice the edits.
STRIDE = 6
#: Edits allowed for each character.
EDITS = 0.08
#: Characters of all windows of a block; the index takes about 20 bytes for each.
BLOCK = 2_000_000
#: Characters that a task looks at together.
CHUNK = 1 << 18
#: More than any place in a window, so that no diagonal is negative.
REACH = 120_000
#: Hits of q-grams that a task holds at a time.
MOST_HITS = 1 << 20
#: Alignments that a task does at a time.
TOGETHER = 512
#: Normalised characters of an item from which on meeting it is a leak; shorter ones are also met by chance.
LEAST = 30
_NOT_WORD = re.compile(r"[\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str | None) -> str:
    return _NOT_WORD.sub(" ", (text or "").lower()).strip()


def windows(text: str, size: int = WINDOW) -> list[str]:
    """Pieces of ``size`` characters, begun so densely that any passage of that length covers one but
    for the edits allowed; of a text of two windows at most, also the whole. A text shorter than a
    window has the bounds of its words on."""
    if len(text) <= size:
        return [text if len(text) == size else f" {text} "]
    begins = {*range(0, len(text) - size, STRIDE), len(text) - size}
    if len(text) <= 2 * size:
        return [text, *(text[b:b + size] for b in sorted(begins))]
    begins.add(len(text) - 2 * size)
    return [text[b:b + size] for b in sorted(begins)]


def budget(length: int, q: int, edits: float) -> tuple[int, int]:
    """(edits allowed, q-grams that must then be shared, at least one)."""
    most = min(int(length * edits), (length - q) // q)
    return most, length + 1 - q - most * q


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash for each q-gram of code points."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    grams = np.zeros(len(codes) - q + 1, np.uint64)
    for k in range(q):
        grams = grams * _ODD + codes[k:len(codes) - q + 1 + k]
    return mix(grams)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Index:
    """Where the q-grams of some windows are."""

    def __init__(self, texts: list[str], q: int, edits: float):
        self.texts, self.q = texts, q
        self.budgets = np.array([budget(len(t), q, edits) for t in texts], np.int64).reshape(-1, 2)
        grams = [_grams(_codes(t), q) for t in texts]
        sizes = [len(g) for g in grams]
        grams = np.concatenate([np.empty(0, np.uint64), *grams])
        order = np.argsort(grams, kind="stable")
        self.of = np.repeat(np.arange(len(texts)), sizes)[order]
        self.at = np.concatenate([np.empty(0, np.int64), *map(np.arange, sizes)]).astype(np.int64)[order]
        self.grams, self.begin, self.count = np.unique(
            grams[order], return_index=True, return_counts=True)
        #: Most q-grams of a document are in no window; this tells so from a few of their bits.
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.grams >> np.uint64(42)).astype(np.int64)] = True
        self.most = int(self.budgets[:, 0].max()) if len(texts) else 0
        self.step = 1 << max(4, self.most.bit_length())

    def regions(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(window, band, shared q-grams) of the bands that meet their window's bound."""
        grams = _grams(_codes(text), self.q)
        places = np.flatnonzero(self.seen[(grams >> np.uint64(42)).astype(np.int64)])
        if not len(places) or not len(self.grams):
            return
        found = np.minimum(np.searchsorted(self.grams, grams[places]), len(self.grams) - 1)
        hit = self.grams[found] == grams[places]
        places, found = places[hit], found[hit]
        bands = (len(text) + REACH) // self.step + 3
        met, sums = [], []
        upto = np.cumsum(self.count[found])
        begin = 0
        while begin < len(found):  # a q-gram may be in very many windows: so many hits at a time
            done = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, done + MOST_HITS, "right")))
            keys, n = self._bands(places[begin:end], found[begin:end], bands)
            met.append(keys)
            sums.append(n)
            begin = end
        if not met:
            return
        keys, at = np.unique(np.concatenate(met), return_inverse=True)
        shared = np.bincount(at, weights=np.concatenate(sums)).astype(np.int64)
        window, band = keys // bands, keys % bands
        enough = shared >= self.budgets[window, 1]
        yield from zip(window[enough].tolist(), band[enough].tolist(), shared[enough].tolist(), strict=True)

    def _bands(self, places: np.ndarray, found: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray]:
        """(window * bands + band, hits) for the q-grams at some places of a text."""
        counts = self.count[found]
        entry = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) \
            + np.repeat(self.begin[found], counts)
        window = self.of[entry]
        diagonal = np.repeat(places, counts) - self.at[entry] + REACH
        band = diagonal // self.step
        over = diagonal % self.step < self.most
        window, band = np.r_[window, window[over]], np.r_[band, band[over] - 1]
        return np.unique(window * bands + band, return_counts=True)

    def confirmed(self, texts: Iterable[tuple[Hashable, str]]) -> Iterator[tuple[Hashable, int, int, int]]:
        """(key, window, edits, end of the region) of the best alignment in each band that meets its
        window's bound, where that is within the budget; ``texts`` are pairs of key and text."""
        waiting: list[tuple[Hashable, int, int, str]] = []
        for key, text in texts:
            for window, band, _ in self.regions(text):
                pattern, most = self.texts[window], int(self.budgets[window, 0])
                low = band * self.step - REACH
                begin = max(0, low - most)
                region = text[begin:max(0, low + self.step + 2 * most + len(pattern))]
                at = region.find(pattern)
                if at >= 0:
                    yield key, window, 0, begin + at + len(pattern)
                elif len(pattern) <= 64:
                    waiting.append((key, window, begin, region))
                else:
                    edits, end = aligned(_codes(pattern), _codes(region))
                    if edits <= most:
                        yield key, window, edits, begin + end
            if len(waiting) >= TOGETHER:
                yield from self._aligned(waiting)
                waiting = []
        yield from self._aligned(waiting)

    def _aligned(self, waiting: list[tuple[Hashable, int, int, str]]) -> Iterator[tuple[Hashable, int, int, int]]:
        for k in range(0, len(waiting), TOGETHER):
            part = waiting[k:k + TOGETHER]
            found = aligned_together([self.texts[w] for _, w, _, _ in part], [r for *_, r in part])
            for (key, window, begin, _), edits, end in zip(part, *found, strict=True):
                if edits <= self.budgets[window, 0]:
                    yield key, window, edits, begin + end


def aligned_together(patterns: list[str], regions: list[str]) -> tuple[list[int], list[int]]:
    """What ``aligned`` gives for each pair, for normalised patterns of up to 64 characters: a column
    of the table is held as bits of its differences (Myers), one word for each pair."""
    if not patterns:
        return [], []
    across = max(map(len, regions))
    # Neither filler occurs in normalised text.
    p = _codes("".join(x.ljust(64, "\0") for x in patterns)).reshape(-1, 1, 64)
    r = _codes("".join(x.ljust(across, "\1") for x in regions)).reshape(-1, across, 1)
    equal = np.packbits(p == r, axis=2, bitorder="little").view("<u8")[:, :, 0].T.copy()
    one = np.uint64(1)
    last = np.array([len(x) - 1 for x in patterns], np.uint64)
    up, down = np.full(len(patterns), ~np.uint64(0)), np.zeros(len(patterns), np.uint64)
    edits = last.astype(np.int64) + 1
    best, end = edits.copy(), np.zeros(len(patterns), np.int64)
    for j in range(across):
        e = equal[j]
        across_up = (((e & up) + up) ^ up) | e
        more, less = down | ~(across_up | up), up & across_up
        edits += ((more >> last) & one).astype(np.int64) - ((less >> last) & one).astype(np.int64)
        more, less = more << one, less << one
        e = e | down
        up, down = less | ~(e | more), more & e
        better = edits < best
        best = np.where(better, edits, best)
        end[better] = j + 1
    return best.tolist(), end.tolist()


def aligned(pattern: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edits between the pattern and any part of the region, and where that part ends."""
    across = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, c in enumerate(pattern):
        new = np.empty_like(row)
        new[0] = i + 1
        np.minimum(row[1:] + 1, row[:-1] + (region != c), out=new[1:])
        row = np.minimum.accumulate(new - across) + across
    end = int(row.argmin())
    return int(row[end]), end


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], str]]:
    """((row, place), part) of the normalised texts between spaces; parts overlap by more than a region."""
    for row, text in enumerate(batch.column("text")):
        text = f" {normalised(text.as_py())} "
        for begin in range(0, max(1, len(text)), CHUNK):
            yield (row, begin), text[begin:begin + CHUNK + 4 * WINDOW]


def _block_matches(documents: DataFrame, found: list, q: int, edits: float) -> DataFrame:
    """Matches of one block's windows: (doc_id, item_id, edits, begin of the region's end)."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(
        ([r["item_id"] for r in found], [r["window"] for r in found]))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, texts = shared.value
        index = Index(texts, q, edits)
        for batch in batches:
            ids, item_ids, best, ends = [], [], [], []
            for (row, begin), window, least, end in index.confirmed(_chunks(batch)):
                ids.append(row)
                item_ids.append(items[window])
                best.append(least)
                ends.append(begin + end - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(ids, pa.int64())),
                 pa.array(item_ids, item_kind), pa.array(best, pa.int32()), pa.array(ends, pa.int64())],
                ["doc_id", "item_id", "edits", "region_end"])

    item_kind = pa.int64()
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        match, f"doc_id {kind}, item_id bigint, edits int, region_end bigint")


def benchmark_windows(benchmark: DataFrame, size: int, q: int, least: int = LEAST, below: int | None = None) -> DataFrame:
    """(item_id, window), each window once for each item of ``least`` characters or more, and under ``below``."""

    def cut(text: str | None) -> list[str]:
        text = normalised(text)
        if len(text) < max(least, q) or below is not None and len(text) >= below:
            return []
        return windows(text, size)

    return benchmark.select(
        F.col("item_id").cast("bigint"), F.explode(F.udf(cut, "array<string>")("text")).alias("window")).distinct()


def matches(documents: DataFrame, benchmark: DataFrame, q: int = GRAM, size: int = WINDOW,
            edits: float = EDITS, block: int = BLOCK, least: int = LEAST, below: int | None = None) -> DataFrame:
    """Every verified region: doc_id, item_id, edits, region_end (in the normalised text)."""
    pieces = benchmark_windows(benchmark, size, q, least, below)
    total = pieces.agg(F.sum(F.length("window"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block))
    numbered = pieces.withColumn("block", F.pmod(F.xxhash64("item_id", "window"), F.lit(blocks)))
    parts = [
        _block_matches(documents, numbered.where(F.col("block") == i).collect(), q, edits)
        for i in range(blocks)
    ]
    return reduce(DataFrame.unionByName, parts)


def mentions(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and n_regions of verbatim items under LEAST characters, between word bounds: no
    evidence of a leak, so neither ``leaks`` nor ``without_leaks`` minds them."""
    found = matches(documents, benchmark, edits=0.0, least=GRAM, below=LEAST)
    return found.groupBy("doc_id", "item_id").agg(F.count_distinct("region_end").alias("n_regions"))


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item it holds a passage of: the least edits, and the regions."""
    return matches(documents, benchmark).groupBy("doc_id", "item_id").agg(
        F.min("edits").alias("edits"), F.count_distinct("region_end").alias("n_regions"))


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no passage of the benchmark is found. Decided for each row by itself,
    so rows with a null or repeated doc_id are kept or dropped for their own text."""
    spark = documents.sparkSession
    pieces = benchmark_windows(benchmark, WINDOW, GRAM)
    total = pieces.agg(F.sum(F.length("window"))).first()[0] or 0
    blocks = max(1, -(-2 * total // BLOCK))
    numbered = pieces.withColumn("block", F.pmod(F.xxhash64("item_id", "window"), F.lit(blocks)))
    for i in range(blocks):
        texts = spark.sparkContext.broadcast(
            [r["window"] for r in numbered.where(F.col("block") == i).select("window").collect()])

        def clean(batches: Iterator[pa.RecordBatch], texts=texts) -> Iterator[pa.RecordBatch]:
            index = Index(texts.value, GRAM, EDITS)
            for batch in batches:
                clear = np.ones(batch.num_rows, bool)
                for (row, _), *_ in index.confirmed(_chunks(batch)):
                    clear[row] = False
                yield batch.filter(pa.array(clear))

        documents = documents.mapInArrow(clean, documents.schema)
    return documents
