"""Language-model scores from a log-frequency Bloom filter.

The filter holds counts of single tokens, of token pairs and of contexts, each quantised to a level on
a logarithmic scale. An item of level q is inserted q times, as (item, 1) to (item, q). Reading it
asks for (item, 1), (item, 2), ... until one is absent; the level before is the count. Unseen items
mostly stop at the first question, and a count is rarely too high, as each further level would need
one more false positive.

A token's probability is Witten-Bell's with pairs met once given to the escape: with c(v w) of a pair
met twice or more and e(v) the kinds of tokens after v plus the pairs met once,
p(w | v) = (c(v w) + e(v) p(w)) / z(v). z(v) is the sum of the numerators over all w, made from the
quantised counts that the filter gives back, so the probabilities after v sum to 1 but for the last digit
of z(v), which is kept on two scales, coarse and fine. A context without a pair met twice is not kept:
there p(w | v) = p(w). p(w) is the token's share by quantised counts, plus a half for every token and for
the unknown one.

False pairs would add to that sum, one for every token that is asked. So a pair is asked only after a
context that is kept and for a token met twice, and its first level takes so many probes
(``first_probes``) that false ones add less than FALSE_MASS to any context. Their number grows with the
logarithm of the vocabulary.

The filter is made of blocks that a hash of the item chooses, so that tasks build them apart from
one another. It is cut into segments of at most ``segment_mb``, by the tokens of the pair. A single
segment is broadcast and scores in the pass that the base takes; at 100 million items it suffices. Several
segments are not broadcast: the pairs of the texts travel once to tasks that hold one segment each, and a
sum for each text travels back. So a worker holds one segment however many there are, and texts are read
once. Segments are cells of contexts by tokens, which repeat the counts of their contexts and tokens: the
filter grows faster than the corpus.

The exact unigram base uses counts by token hash. The most frequent tokens, a bounded table, are
looked up where the texts are; the others, none of which is frequent, are joined.

Edge cases: null text is empty and has one token, its end; a null doc_id is not held out; repeated
rows count as often as they come; with no training text every score is that of an empty model; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgauge.llm.bytehash import mix, packed, words
from claimgauge.llm.shared import discard, keep, release

#: Ratio of counts between two levels, for tokens and contexts and for pairs.
RATIO = 1.4
PAIR_RATIO = 1.6
#: Steps of the fine scale between two levels of a context's sum.
FINE = 6
#: A probe sets, or asks for, three bits of one word of 64; half of all bits are set. A level has PROBES,
#: from level HIGH on, whose few items hold most of the mass, twice as many.
PROBES = 2
HIGH = 8
EACH = 3
#: What a probe tells in bits, less than EACH as words are not filled evenly.
TELLS = 2.85
#: The probability that false pairs may add after a context.
FALSE_MASS = 0.02
BLOCK_BYTES = 1 << 16
_WORDS = BLOCK_BYTES // 8
#: A factor for each probe.
_FACTORS = np.random.default_rng(21).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SEGMENT_MB = 96
#: Bytes of pairs that a task reads for each byte of the segment it holds, and pairs that it looks up together.
READ = 2
TOGETHER = 1 << 19
#: The most frequent tokens whose exact counts are broadcast: 16 bytes each.
FREQUENT = 100_000
_END = np.uint64(0x5EED0E17D0000001)
_BEGIN = np.uint64(0x5EED0E17D0000002)
_TOKEN, _PAIR, _CONTEXT, _ESCAPE, _FINE = 1, 2, 3, 4, 5


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, hash of the token before, row) of every token; each text ends with its end."""
    hashes, rows, counts = words(data, offsets, lower=True)
    n = len(counts)
    at = np.arange(len(hashes)) + rows
    out = np.full(len(hashes) + n, _END, np.uint64)
    out[at] = hashes
    row = np.repeat(np.arange(n), counts + 1)
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[np.cumsum(counts + 1) - (counts + 1)] = _BEGIN
    return out, before, row


def half(token: np.ndarray) -> np.ndarray:
    """32 bits of a token's hash."""
    return token >> np.uint64(32)


def pair_key(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The halves of a token before and a token."""
    return half(before) << np.uint64(32) | half(token)


def level(count: Column, least: int, ratio: float) -> Column:
    return (F.round(F.log(count / F.lit(float(least))) / float(np.log(ratio))) + 1).cast("int")


def quantised(count: Column, least: int, ratio: float) -> Column:
    """The count that its level stands for."""
    return F.lit(float(least)) * F.pow(F.lit(ratio), level(count, least, ratio) - 1)


def probes_of(kind: np.ndarray | int, at_level: np.ndarray | int, first: int) -> np.ndarray:
    """The probes of an item's level; ``first`` are those of a pair's first level."""
    of = np.where(np.asarray(at_level) >= HIGH, 2 * PROBES, PROBES)
    return np.where((np.asarray(kind) == _PAIR) & (np.asarray(at_level) == 1), first, of)


def first_probes(repeated: int) -> int:
    """Probes of a pair's first level, where so many tokens met twice may be asked after a context.

    A false pair counts 2 in a sum z(v) of at least 3.
    """
    return max(PROBES, math.ceil(math.log2(max(1, repeated) * 2 / 3 / FALSE_MASS) / TELLS))


@dataclass(frozen=True)
class Model:
    """A trained model, in segments of which a worker holds one."""

    blocks: DataFrame  # segment, block, bits
    grid: tuple[int, int]  # parts of contexts, parts of tokens
    blocks_each: int
    first: int  # probes of a pair's first level
    counts: DataFrame  # h, c: exact, by token
    total: int
    distinct: int
    mass: float  # sum of the quantised counts of tokens, with a half for each and for the unknown one

    def segment(self, number: int) -> np.ndarray:
        """The bits of one segment, its blocks in order."""
        rows = self.blocks.where(F.col("segment") == number).select("block", "bits").toArrow()
        bits = np.zeros((self.blocks_each, BLOCK_BYTES), np.uint8)
        for at, content in zip(rows.column("block").to_pylist(), rows.column("bits"), strict=True):
            bits[at] = np.frombuffer(content.as_buffer(), np.uint8)
        return bits.reshape(-1)


class Filter:
    """One segment, in a worker."""

    def __init__(self, bits: np.ndarray, first: int):
        self.words, self.blocks_each, self.first = bits.view(np.uint64), len(bits) // BLOCK_BYTES, first

    def has(self, places: np.ndarray, base: np.ndarray, probes: int) -> np.ndarray:
        """Which items are in the filter, by number: an absent one mostly fails at the first probes."""
        left = np.arange(len(places))
        for k in range(probes):
            word, mask = probe(places, k)
            there = self.words[base + word] & mask == mask
            if not there.all():
                left, base, places = left[there], base[there], places[there]
        return left

    def counts(self, items: np.ndarray, kind: int, least: int, ratio: float) -> np.ndarray:
        """0, or the count that the highest level in the filter stands for."""
        levels = np.zeros(len(items), np.int64)
        asked = np.arange(len(items))
        of, base = kinds(items, kind), block_of(items, self.blocks_each) * _WORDS
        q = 1
        while len(asked):
            found = self.has(places(of, q), base, int(probes_of(kind, q, self.first)))
            asked, of, base = asked[found], of[found], base[found]
            levels[asked] = q
            q += 1
        return np.where(levels > 0, least * ratio ** (levels - 1.0), 0.0)

    def contexts(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Escape and sum of contexts, 0 and 0 of those that are not kept."""
        escape = self.counts(items, _ESCAPE, 1, RATIO)
        kept = np.flatnonzero(escape)
        coarse = self.counts(items[kept], _CONTEXT, 1, RATIO)
        fine = self.counts(items[kept], _FINE, 1, RATIO ** (1 / FINE))
        z = np.zeros(len(items))
        z[kept] = coarse * fine * RATIO ** (0.5 / FINE)
        return np.where(z > 0, escape, 0.0), z


def block_of(items: np.ndarray, blocks: int) -> np.ndarray:
    return ((mix(items, 77) >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)


def segment_of(before: np.ndarray, token: np.ndarray, grid: tuple[int, int]) -> np.ndarray:
    """The cell of a pair, from the halves of its tokens."""
    row, column = before % np.uint64(grid[0]), token % np.uint64(grid[1])
    return (row * np.uint64(grid[1]) + column).astype(np.int64)


def kinds(items: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    return mix(items ^ np.asarray(kind, np.uint64) * np.uint64(0x1F123BB5), 11)


def places(of_kind: np.ndarray, at_level: np.ndarray | int) -> np.ndarray:
    return mix(of_kind + np.asarray(at_level, np.uint64) * np.uint64(0xD6E8FEB86659FD93), 12)


def _bits(places: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The word of the k-th probe in a block, and the bits in it, from the upper bits of a product."""
    x = places * _FACTORS[k]
    return (x >> np.uint64(51)).astype(np.int64), [
        x >> np.uint64(51 - 6 * (i + 1)) & np.uint64(63) for i in range(EACH)]


def probe(places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of the k-th probe in a block, and its mask."""
    word, bits = _bits(places, k)
    mask = np.uint64(1) << bits[0]
    for bit in bits[1:]:
        mask |= np.uint64(1) << bit
    return word, mask


def _set(bits: np.ndarray, places: np.ndarray, k: int) -> None:
    """Sets the bits of the k-th probe in a block of booleans."""
    word, own = _bits(places, k)
    for bit in own:
        bits[word * 64 + bit.astype(np.int64)] = True


def _by_batch(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, token, token before, row) of about 8 MB of texts, cut up in parts of 1 MB."""
    first, size, held = 0, 0, []
    for begin, end, data, offsets in packed(texts, 1 << 20):
        token, before, row = tokens(data, offsets)
        held.append((token, before, row + (begin - first)))
        size += len(data)
        if size >= 1 << 23 or end == len(texts):
            yield first, end, *map(np.concatenate, zip(*held, strict=True))
            first, size, held = end, 0, []


def _counted(texts: DataFrame, pairs: bool) -> DataFrame:
    """(h, n) of tokens, or of pairs, summed within each chunk of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, token, before, _row in _by_batch(batch.column("text")):
                h, n = np.unique(pair_key(before, token) if pairs else token, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return texts.select("text").mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def _built(items: DataFrame, blocks_each: int, first_level: int) -> DataFrame:
    """The blocks of the filter from (segment, kind, h, level)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = block_of(batch.column("h").to_numpy().view(np.uint64), blocks_each)
            block += batch.column("segment").to_numpy() * blocks_each
            yield pa.RecordBatch.from_arrays(
                [pa.array(block), *(batch.column(c) for c in ("kind", "h", "level"))],
                ["block", "kind", "h", "level"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by block, so one block of bits is held at a time.
        held, bits = -1, np.zeros(BLOCK_BYTES * 8, bool)
        for batch in batches:
            block, kind, most = (batch.column(c).to_numpy() for c in ("block", "kind", "level"))
            h = batch.column("h").to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist() if len(block) else []
            for begin, end in zip(starts, [*starts[1:], len(block)], strict=True):
                if block[begin] != held:
                    if held >= 0:
                        yield _block_row(held, bits, blocks_each)
                    held = int(block[begin])
                    bits[:] = False
                of = np.repeat(np.arange(begin, end), most[begin:end])
                first = np.repeat(np.cumsum(most[begin:end]) - most[begin:end], most[begin:end])
                at_level = np.arange(len(of)) - first + 1
                where = places(kinds(h[of], kind[of]), at_level)
                probes = probes_of(kind[of], at_level, first_level)
                for k in range(int(probes.max(initial=0))):
                    _set(bits, where[probes > k], k)
        if held >= 0:
            yield _block_row(held, bits, blocks_each)

    dealt = items.select("segment", "kind", "h", "level").mapInArrow(
        deal, "block bigint, kind bigint, h bigint, level int")
    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(
        build, "segment int, block int, bits binary")


def _block_row(block: int, bits: np.ndarray, blocks_each: int) -> pa.RecordBatch:
    content = np.packbits(bits, bitorder="little").tobytes()
    return pa.RecordBatch.from_arrays(
        [pa.array([block // blocks_each], pa.int32()), pa.array([block % blocks_each], pa.int32()),
         pa.array([content], pa.binary())], ["segment", "block", "bits"])


def train(texts: DataFrame, segment_mb: float = SEGMENT_MB) -> Model:
    """Counts all tokens and pairs of column ``text`` and builds the filter."""
    unigrams = keep(_counted(texts, False).withColumnRenamed("n", "c"), "lm-tokens")
    pairs = keep(_counted(texts, True), "lm-pairs")
    total, distinct, repeated, mass = unigrams.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count(F.when(F.col("c") > 1, 1)),
        F.coalesce(F.sum(quantised(F.col("c"), 1, RATIO)), F.lit(0.0))).first()
    first = first_probes(repeated)
    before, token = F.shiftrightunsigned("h", 32), F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))
    again = F.col("n") > 1
    contexts = pairs.groupBy(before.alias("h")).agg(
        (F.count("*") + F.count(F.when(~again, 1))).alias("escape"),
        F.sum(F.when(again, quantised(F.col("n"), 2, PAIR_RATIO))).alias("sum")).where("sum is not null")
    digits = F.log(F.col("sum") + quantised(F.col("escape"), 1, RATIO)) / float(np.log(RATIO))
    contexts = keep(contexts.select(
        "h", level(F.col("escape"), 1, RATIO).alias("escape"), (F.floor(digits) + 1).cast("int").alias("coarse"),
        (F.floor((digits - F.floor(digits)) * FINE) + 1).cast("int").alias("fine")), "lm-contexts")

    def items(df: DataFrame, kind: int, of: Column) -> DataFrame:
        return df.select(F.lit(kind).cast("bigint").alias("kind"), "h", of.alias("level"))

    by_half = unigrams.groupBy(F.shiftrightunsigned("h", 32).alias("h")).agg(F.sum("c").alias("c"))
    of_tokens = items(by_half, _TOKEN, level(F.col("c"), 1, RATIO))
    of_contexts = (
        items(contexts, _CONTEXT, F.col("coarse")).unionByName(items(contexts, _FINE, F.col("fine")))
        .unionByName(items(contexts, _ESCAPE, F.col("escape")))
    )
    of_pairs = items(pairs.where(again), _PAIR, level(F.col("n"), 2, PAIR_RATIO))

    # As many bits that half of them are set.
    levels = F.coalesce(F.sum(F.col("level") + F.greatest(F.col("level") - HIGH + 1, F.lit(0))), F.lit(0)) * PROBES
    needs = [float(x.agg(n * (EACH / math.log(2))).first()[0]) for x, n in (
        (of_contexts, levels), (of_tokens, levels), (of_pairs, levels + F.count("*") * (first - PROBES)))]
    grid = _grid(needs, segment_mb * (1 << 23))
    each = needs[0] / grid[0] + needs[1] / grid[1] + needs[2] / (grid[0] * grid[1])
    blocks_each = max(1, int(np.ceil(each / (BLOCK_BYTES * 8))))

    rows, columns = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in grid)
    placed = (
        of_contexts.withColumn("other", columns)
        .withColumn("segment", F.col("h") % grid[0] * grid[1] + F.col("other")).drop("other")
        .unionByName(of_tokens.withColumn("other", rows)
                     .withColumn("segment", F.col("other") * grid[1] + F.col("h") % grid[1]).drop("other"))
        .unionByName(of_pairs.withColumn("segment", before % grid[0] * grid[1] + token % grid[1]))
    )
    blocks = keep(_built(placed, blocks_each, first), "lm-filter")
    discard(pairs, contexts)
    return Model(blocks, grid, blocks_each, first, unigrams, int(total), int(distinct), mass + 0.5 * (distinct + 1))


def _grid(entries: list[float], room: float) -> tuple[int, int]:
    """The parts of contexts and of tokens, as few cells as have ``room`` for what each holds."""
    rows = columns = 1
    while entries[0] / rows + entries[1] / columns + entries[2] / (rows * columns) > room:
        if entries[0] / rows >= entries[1] / columns:
            rows += 1
        else:
            columns += 1
    return rows, columns


def _log_probabilities(filter_: Filter, token: np.ndarray, before: np.ndarray, mass: float) -> np.ndarray:
    """log10 p(token | before) from the halves, each different token, context and pair read once."""
    p, p_at = np.unique(before << np.uint64(32) | token, return_inverse=True)
    return _log_of_pairs(filter_, p, mass)[p_at]


def _log_of_pairs(filter_: Filter, p: np.ndarray, mass: float) -> np.ndarray:
    """log10 of the probability of different pairs."""
    t, t_at = np.unique(p & np.uint64(0xFFFFFFFF), return_inverse=True)
    c, c_at = np.unique(p >> np.uint64(32), return_inverse=True)
    met = filter_.counts(t, _TOKEN, 1, RATIO)
    own = ((met + 0.5) / mass)[t_at]
    escape, z = (x[c_at] for x in filter_.contexts(c))
    asked = np.flatnonzero((z > 0) & (met > 1.5)[t_at])
    pair = np.zeros(len(p))
    pair[asked] = filter_.counts(p[asked], _PAIR, 2, PAIR_RATIO)
    mixed = np.divide(pair + escape * own, z, out=own.copy(), where=z > 0)
    return np.log10(np.minimum(mixed, 1.0))


#: What the first pass finds of each text, and what it asks the segments of several.
_FOUND = [("n_tokens", "bigint", pa.int64()), ("__known", "bigint", pa.int64()), ("__sum", "double", pa.float64()),
          ("__rest", "array<bigint>", pa.list_(pa.int64())), ("__id", "bigint", pa.int64())]
_OF_LOT = ("__bits", "__contexts", "__runs", "__times", "__at")
_ASKED = [("__task", "bigint", pa.int64()), *((x, "int", pa.int32()) for x in ("__block", "__rows", "__of")),
          *((x, "binary", pa.binary()) for x in _OF_LOT)]


def _asked(token: np.ndarray, before: np.ndarray, row: np.ndarray, grid: tuple[int, int]) -> Iterator[dict]:
    """What a lot of tokens asks each segment: its different contexts, the number of different pairs of each and
    their tokens, as halves; how often each pair comes, and in which rows."""
    pair = pair_key(before, token)
    order = np.argsort(pair, kind="stable")
    pair, row = pair[order], row[order]
    starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    pair, times = pair[starts], np.diff(np.r_[starts, len(pair)])
    segment = segment_of(pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF), grid)
    segment = segment.astype(np.min_scalar_type(grid[0] * grid[1]))
    row = row[np.argsort(np.repeat(segment, times), kind="stable")]
    order = np.argsort(segment, kind="stable")
    segment, pair, times = segment[order], pair[order], times[order]
    context, ends = (pair >> np.uint64(32)).astype(np.uint32), np.r_[0, np.cumsum(times)]
    starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]).tolist()
    for a, b in zip(starts, [*starts[1:], len(segment)], strict=True):
        runs = np.flatnonzero(np.r_[True, context[a + 1:b] != context[a:b - 1]])
        yield {"segment": int(segment[a]), "__bits": pair[a:b].astype(np.uint32).tobytes(),
               "__contexts": _short(np.diff(context[a:b][runs], prepend=np.uint32(0))),
               "__of": len(runs), "__runs": _short(np.diff(np.r_[runs, b - a])),
               "__times": _short(times[a:b]), "__at": _short(row[ends[a]:ends[b]])}


def _short(numbers: np.ndarray) -> bytes:
    """Whole numbers in as few half bytes each as the greatest needs: bytes of all by place, then half bytes."""
    numbers = numbers.astype(np.uint64)
    whole, half_ = divmod((int(numbers.max()).bit_length() + 3) // 4, 2)
    planes = [(numbers >> np.uint64(8 * i)).astype(np.uint8) for i in range(whole + half_)]
    if half_:
        last = np.append(planes[-1], np.zeros(len(numbers) % 2, np.uint8))
        planes[-1] = last[::2] | last[1::2] << 4
    return b"".join(x.tobytes() for x in planes)


def _long(content: pa.Buffer, count: int) -> np.ndarray:
    data, numbers = np.frombuffer(content, np.uint8), np.zeros(count, np.int64)
    whole = len(data) // count
    for i in range(whole):
        numbers |= data[i * count:(i + 1) * count].astype(np.int64) << 8 * i
    last = data[whole * count:].astype(np.int64)
    if len(last):
        numbers[::2] |= (last & 15) << 8 * whole
        numbers[1::2] |= last[:count // 2] >> 4 << 8 * whole
    return numbers


def _batch(names: list[str], types: list[pa.DataType], columns: dict, rows: int) -> pa.RecordBatch:
    """Rows with nulls in the columns that are not given."""
    return pa.RecordBatch.from_arrays(
        [pa.nulls(rows, of) if x not in columns else columns[x] if isinstance(columns[x], pa.Array)
         else pa.array(columns[x], of) for x, of in zip(names, types, strict=True)], names)


def _answered(lots: DataFrame, model: Model, parts: int) -> DataFrame:
    """In place of what a lot asks a segment, the sums of logs of its texts; the rows of texts stay.

    Each of the ``parts`` tasks of a segment has its blocks and some of the lots."""
    first, mass, blocks_each = model.first, model.mass, model.blocks_each
    names = [x for x in lots.columns if x not in [x for x, *_ in _ASKED]] + ["__sums"]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by task, the blocks of its segment before its lots.
        held, bits = -1, np.zeros((blocks_each, BLOCK_BYTES), np.uint8)
        filter_ = Filter(bits.reshape(-1), first)
        lots: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []  # id, rows, pairs, times, row of each

        def answered() -> pa.RecordBatch:
            # Lots that are read together ask for what they have in common once.
            pairs, where = np.unique(np.concatenate([x[2] for x in lots]), return_inverse=True)
            logs = np.split(_log_of_pairs(filter_, pairs, mass)[where], np.cumsum([len(x[2]) for x in lots])[:-1])
            sums = [np.bincount(at, weights=np.repeat(own, times), minlength=rows)
                    for (_, rows, _, times, at), own in zip(lots, logs, strict=True)]
            found = _batch(names, types, {"__id": [x[0] for x in lots], "__sums": sums}, len(lots))
            lots.clear()
            return found

        for batch in batches:
            types = [batch.schema.field(x).type for x in names[:-1]] + [pa.list_(pa.float64())]
            task = batch.column("__task").to_numpy()
            texts = batch.filter(pa.array(task < 0))
            if len(texts):
                yield _batch(names, types, {x: texts.column(x) for x in names[:-1]}, len(texts))
            for i in np.flatnonzero(task >= 0).tolist():
                if lots and (task[i] != held or sum(len(x[2]) for x in lots) >= TOGETHER):
                    yield answered()
                if task[i] != held:
                    held, bits[:] = task[i], 0
                content, contexts, runs, times, at = (batch.column(x)[i].as_buffer() for x in _OF_LOT)
                if contexts is None:
                    bits[batch.column("__block")[i].as_py()] = np.frombuffer(content, np.uint8)
                    continue
                id_, rows, n = (batch.column(x)[i].as_py() for x in ("__id", "__rows", "__of"))
                contexts = np.cumsum(_long(contexts, n)).view(np.uint64) << np.uint64(32)
                pairs = np.repeat(contexts, _long(runs, n)) | np.frombuffer(content, np.uint32)
                times = _long(times, len(pairs))
                lots.append((id_, rows, pairs, times, _long(at, int(times.sum()))))
        if lots:
            yield answered()

    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    blocks = model.blocks.select("segment", F.col("block").alias("__block"), F.col("bits").alias("__bits"), part)
    task = (F.col("segment") * parts + F.col("part")).cast("bigint").alias("__task")
    met = lots.unionByName(blocks.select(task, "__block", "__bits"), allowMissingColumns=True)
    fields = ", ".join(f"`{x}` {lots.schema[x].dataType.simpleString()}" for x in names[:-1])
    return met.repartition("__task").sortWithinPartitions("__task", "__id").mapInArrow(
        answer, f"{fields}, __sums array<double>")


def with_scores(texts: DataFrame, model: Model, frequent: int = FREQUENT) -> DataFrame:
    """In place of ``text``: n_tokens, n_known and base_score, exact, and score. Frequent tokens are looked up
    in a broadcast table of ``frequent`` rows, the others are joined. A model of one segment is broadcast too
    and scores in the same pass; else the pairs go to the tasks of their segments."""
    top = model.counts.orderBy(F.desc("c"), "h").limit(frequent).toArrow()
    known = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(known)
    context = texts.sparkSession.sparkContext
    shared = context.broadcast((known[order], top.column("c").to_numpy()[order].astype(float)))
    grid, first, mass = model.grid, model.first, model.mass
    several = grid != (1, 1)
    segment = None if several else context.broadcast(model.segment(0))
    scale = model.total + 0.5 * (model.distinct + 1)
    each = model.blocks_each * BLOCK_BYTES
    parts = max(1, math.ceil(8 * model.total / (grid[0] * grid[1] * each * READ)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        logs = np.log10((counts + 0.5) / scale)
        filter_ = Filter(segment.value, first) if segment else None
        lot = TaskContext.get().partitionId()
        id_ = lot << 33
        for batch in batches:
            types = [batch.schema.field(x).type for x in others] + [of for *_, of in own]
            for begin, end, token, before, row in _by_batch(batch.column("text")):
                rows, part = end - begin, batch.slice(begin, end - begin)
                at = np.minimum(np.searchsorted(known, token), max(0, len(known) - 1))
                met = known[at] == token if len(known) else np.zeros(len(token), bool)
                counted = np.bincount(row[~met], minlength=rows)
                ids = np.arange(id_, id_ + rows)
                found = {x: part.column(x) for x in others} | {
                    "n_tokens": np.bincount(row, minlength=rows), "__known": np.bincount(row[met], minlength=rows),
                    "__sum": np.bincount(row[met], weights=logs[at[met]], minlength=rows),
                    "__rest": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counted)], pa.int32()),
                                                       pa.array(token[~met].view(np.int64))),
                    "__id": ids}
                if filter_:
                    p = _log_probabilities(filter_, half(token), half(before), mass)
                    yield _batch(names, types, found | {"score": np.bincount(row, weights=p, minlength=rows)}, rows)
                else:
                    # The texts are dealt over other tasks.
                    yield _batch(names, types, found | {"__task": -1 - ids // 1024}, rows)
                    asked = [*_asked(token, before, row, grid)]
                    yield _batch(names, types, {k: [x[k] for x in asked] for k in ("__of", *_OF_LOT)} | {
                        "__task": [x["segment"] * parts + lot % parts for x in asked], "__id": [id_] * len(asked),
                        "__rows": [rows] * len(asked)}, len(asked))
                id_, lot = id_ + rows, lot + 1

    others = [x for x in texts.columns if x != "text"]
    own = [*_FOUND, *(_ASKED if several else [("score", "double", pa.float64())])]
    names = others + [x for x, *_ in own]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields if f.name != "text"]
    parts_of = texts.mapInArrow(look_up, ", ".join([*fields, *(f"{x} {kind}" for x, kind, _ in own)]))
    if several:
        parts_of = _answered(parts_of, model, parts)
    parts_of = keep(parts_of, "lm-base")
    release(texts.sparkSession)
    found = parts_of.where("n_tokens is not null")
    joined = (
        found.select("__id", F.explode("__rest").alias("h")).join(model.counts, "h", "left").groupBy("__id").agg(
            F.count("c").alias("__more"),
            F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(scale))).alias("__more_sum"))
    )
    found = found.join(joined, "__id", "left")
    if several:
        sums = parts_of.where("n_tokens is null").select("__id", F.posexplode("__sums").alias("__at", "sum"))
        found = found.join(sums.groupBy((F.col("__id") + F.col("__at")).alias("__id")).agg(
            F.sum("sum").alias("score")), "__id")
    return found.select(
        *others, "score", "n_tokens", (F.col("__known") + F.coalesce("__more", F.lit(0))).alias("n_known"),
        (F.col("__sum") + F.coalesce("__more_sum", F.lit(0.0))).alias("base_score"))


def scored(documents: DataFrame, segment_mb: float = SEGMENT_MB, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; the model learns from the
    documents that are not held out."""
    remainder = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5
    texts = documents.select(
        "doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"))
    model = train(texts.where(~F.col("held_out")), segment_mb)
    release(documents.sparkSession)
    found = with_scores(texts, model, frequent)
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        "base_score", "score")
