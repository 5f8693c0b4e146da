"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``length`` bytes, in passes from the most significant digit; a
group whose members agree in all digits is a repeated window. What makes this small enough to
shuffle: a window's most significant digit is not read at its begin but at its *anchor*, the place
of its least k-gram hash. Equal windows have equal anchors, so windows with the same anchor place
travel as one row, a *stretch*, until a pass tells them apart.

1. First digit: the k-gram at the anchor. Stretches whose digit is met once hold no repeated window.
2. Second digit: the bytes of the whole stretch. Stretches that agree in it are repeated with all
   their windows; one of them goes on for all, so a large group of copies becomes one row.
3. Third digit, where one first digit has several second ones: stretches are cut into *blocks* of up
   to 16 windows with the same distances from the anchor; the digit is the ``length`` - 15 bytes that
   these windows have in common.
4. Last digit: the up to 15 bytes on either side. Blocks that agree in them are repeated whole. Where
   they do not, it is taken window by window: groups of two or more are exactly the repeated windows.

All digits but the last are hashes of 64 bits, of which two or more have to agree; the last is bytes.

Edge cases: null text is empty; texts shorter than ``length`` keep all; equal texts repeat each
other whole; repeated rows are copies of their texts; an empty table gives no rows. Cuts are made
between bytes, so kept text may hold parts of a character: ``kept`` is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgauge.llm.bytehash import packed, prefixes, span
from claimgauge.llm.shared import discard, keep

#: Bytes of the k-gram at an anchor.
GRAM = 32
#: Windows of a block.
BLOCK = 16
_CLASSES = ("key binary, first array<bigint>, second array<bigint>, "
            "a array<int>, windows array<smallint>, before array<smallint>")
_BLOCKS = ("id bigint, alone boolean, first bigint, third bigint, p int, "
           "low smallint, high smallint, left binary, right binary")


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, gram: int
              ) -> tuple[np.ndarray, ...]:
    """(row, first digit, second digit, a, b, p) of each stretch; places count from the row's begin."""
    n, width = len(data), length - gram + 1
    none = tuple(np.empty(0, np.int64) for _ in range(6))
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    if not sizes.sum():
        return none
    sums = prefixes(data)
    places = np.arange(n - gram + 1)
    grams = span(sums, places, places + gram)
    low = np.uint64(max(1, int(n).bit_length()))
    least = (grams >> low << low) | places.astype(np.uint64)  # the hash, and among equals the first
    have = 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[:have - width], least[width - have:])
    rows = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + offsets[rows]
    anchors = (least[begins] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1])])
    a, b = begins[new], begins[np.r_[new[1:], len(begins)] - 1]
    p, row = anchors[new], rows[new]
    first = grams[p]
    second = span(sums, a, b + length, 1) + (p - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    base = offsets[row]
    return row, first.view(np.int64), second.view(np.int64), a - base, b - base, p - base


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(values, kind)
    )


def _counted(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items with so many parts each: the item of every part, and the part's number in it."""
    return (np.repeat(np.arange(len(sizes)), sizes),
            np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))


def _classes(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """One row for each text of ``length`` bytes or more: its key and stretches. ``before``: bytes
    from the first window to the anchor."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in packed(batch.column(1)):
                row, first, second, a, b, p = stretches(data, offsets, length, gram)
                counts = np.bincount(row, minlength=end - begin)
                found = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin),
                     _lists(first, counts, pa.int64()), _lists(second, counts, pa.int64()),
                     _lists(a, counts, pa.int32()), _lists(b - a + 1, counts, pa.int16()),
                     _lists(p - a, counts, pa.int16())],
                    ["key", "first", "second", "a", "windows", "before"],
                )
                yield found.filter(pa.array(counts > 0))

    return texts.mapInArrow(find, _CLASSES)


def _blocks(texts: DataFrame, length: int) -> DataFrame:
    """Blocks of the given stretches. ``alone``: no other stretch has its second digit. ``low`` and
    ``high``: distances from a window's begin to the anchor."""
    core = length - BLOCK + 1

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("stretches")
            for begin, end, data, offsets in packed(batch.column("text")):
                sums, raw = prefixes(data), data.tobytes()
                part = wanted.slice(begin, end - begin)
                rows = np.repeat(np.arange(end - begin), np.diff(part.offsets.to_numpy()))
                first, a, windows, before, alone = (
                    x.to_numpy(zero_copy_only=False) for x in part.flatten().flatten())
                nearest, farthest = (before - windows + 1).astype(np.int64), before.astype(np.int64)
                of, number = _counted(farthest // BLOCK - nearest // BLOCK + 1)
                number = number + (nearest // BLOCK)[of]
                low = np.maximum(number * BLOCK, nearest[of])
                high = np.minimum(number * BLOCK + BLOCK - 1, farthest[of])
                p = (a.astype(np.int64) + before)[of]
                anchor = p + offsets[rows[of]]
                shared = anchor - number * BLOCK
                third = span(sums, shared, shared + core, 2) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(begin, end - begin).take(pa.array(rows[of])),
                     pa.array(alone[of], pa.bool_()), pa.array(first[of]), pa.array(third.view(np.int64)),
                     pa.array(p, pa.int32()), pa.array(low, pa.int16()), pa.array(high, pa.int16()),
                     _bytes_between(raw, anchor - high, shared),
                     _bytes_between(raw, shared + core, anchor - low + length)],
                    ["id", "alone", "first", "third", "p", "low", "high", "left", "right"],
                )

    return texts.mapInArrow(divide, _BLOCKS)


def _bytes_between(raw: bytes, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    return pa.array([raw[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())


def repeated_ranges(texts: DataFrame, length: int = 200, gram: int = GRAM) -> DataFrame:
    """From (key, text): key, ``whole`` and ``ranges`` of each text with repeated bytes.

    ``key`` has to be the same for equal texts only. ``whole``: there are copies, all bytes go.
    ``ranges``: array of (a, end), in no order and overlapping, as many as the text has bytes at most.
    """
    texts = texts.where(F.octet_length("text") >= length)
    classes = keep(
        _classes(texts, length, gram).groupBy("key").agg(
            F.count("*").alias("copies"),
            F.first(F.struct("first", "second", "a", "windows", "before")).alias("s"),
        ).select("key", "copies", "s.*").withColumn("id", F.monotonically_increasing_id()),
        "repeats-classes",
    )
    rows = classes.select(
        "id", F.explode(F.arrays_zip("first", "second", "a", "windows", "before")).alias("s")
    ).select("id", "s.*")

    # First digit, over all stretches.
    # The groups are a written table, here and below, so that Spark can split the join at a hot digit.
    groups = keep(
        rows.groupBy("first")
        .agg(F.count("*").alias("n"), F.min("second").alias("low"), F.max("second").alias("high"))
        .where("n > 1").select("first", (F.col("low") != F.col("high")).alias("mixed")),
        "repeats-groups",
    )
    met = keep(rows.join(groups, "first"), "repeats-met")

    # Second digit, in the groups that do not agree in it. ``of``: one member for all.
    second = keep(
        met.where("mixed").groupBy("first", "second").agg(
            F.count("*").alias("n"), F.min(F.struct("id", "a", "windows", "before")).alias("of")
        ),
        "repeats-second",
    )
    same = met.where("mixed").join(
        second.where("n > 1").select("first", "second"), ["first", "second"], "left_semi"
    )

    # Third digit. Equal texts are one class, so any of them has the wanted stretches.
    wanted = (
        second.groupBy("of.id").agg(F.collect_list(F.struct(
            "first", "of.a", "of.windows", "of.before", (F.col("n") == 1).alias("alone"))).alias("stretches"))
        .join(classes.select("id", "key"), "id")
    )
    bodies = texts.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key")
    blocks = keep(_blocks(bodies.select("id", "text", "stretches"), length), "repeats-blocks")
    sides = F.xxhash64("left", "right", "low", "high")
    thirds = keep(
        blocks.groupBy("first", "third")
        .agg(F.count("*").alias("n"), F.min(sides).alias("least"), F.max(sides).alias("most"))
        .where("n > 1").select("first", "third", (F.col("least") != F.col("most")).alias("mixed")),
        "repeats-thirds",
    )
    met_blocks = keep(blocks.join(thirds, ["first", "third"]), "repeats-met-blocks")

    # Last digit, block by block and then window by window.
    block = ["first", "third", "low", "high", "left", "right"]
    last = keep(
        met_blocks.where("mixed").groupBy(*block).agg(
            F.count("*").alias("n"), F.min(F.struct("id", "p", "alone")).alias("of")),
        "repeats-last",
    )
    same_blocks = met_blocks.where("mixed and alone").join(
        last.where("n > 1").select(*block), block, "left_semi")
    place = F.col("distance") % BLOCK
    windows = (
        last.withColumn("distance", F.explode(F.sequence("low", "high")))
        .select(
            "first", "third", "distance",
            F.concat(F.substring("left", F.col("high") - F.col("distance") + 1, place.cast("int")),
                     F.substring("right", F.lit(1), (BLOCK - 1 - place).cast("int"))).alias("rest"),
            "of.id", (F.col("of.p") - F.col("distance")).alias("a"),
            ((F.col("n") == 1) & F.col("of.alone")).alias("alone"))
    )
    windows = keep(windows, "repeats-windows")
    window = ["first", "third", "distance", "rest"]
    repeated = keep(
        windows.groupBy(*window).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeats-repeated")
    single = windows.where("alone").join(repeated, window, "left_semi")

    def ranges_of(found: DataFrame, a: str, windows: str) -> DataFrame:
        return found.select("id", F.struct(
            F.expr(a).cast("int").alias("a"),
            F.expr(f"{a} + {windows} + {length - 1}").cast("int").alias("end")).alias("range"))

    ranges = (
        ranges_of(met.where("not mixed"), "a", "windows")
        .unionByName(ranges_of(same, "a", "windows"))
        .unionByName(ranges_of(met_blocks.where("not mixed and alone"), "p - high", "high - low + 1"))
        .unionByName(ranges_of(same_blocks, "p - high", "high - low + 1"))
        .unionByName(ranges_of(single, "a", "1"))
        .groupBy("id").agg(F.collect_list("range").alias("ranges"))
    )
    found = keep(
        classes.select("id", "key", (F.col("copies") > 1).alias("whole")).join(ranges, "id", "left")
        .where("whole or ranges is not null")
        .select("key", "whole", F.when(~F.col("whole"), F.col("ranges")).alias("ranges")),
        "repeats-ranges",
    )
    discard(classes, groups, met, second, blocks, thirds, met_blocks, last, windows, repeated)
    return found


def cut(text: bytes, whole: bool, ranges: list[dict] | None) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed)."""
    if whole:
        return b"", len(text), 1
    if not ranges:
        return text, 0, 0
    left, at, removed, spans = [], 0, 0, 0
    for begin, end in sorted((r["a"], r["end"]) for r in ranges):
        if begin > at or not spans:
            spans += 1
        if begin > at:
            left.append(text[at:begin])
        removed += max(0, end - max(begin, at))
        at = max(at, end)
    left.append(text[at:])
    return b"".join(left), removed, spans


def without_repeats(documents: DataFrame, length: int = 200, text: str = "text", gram: int = GRAM,
                    as_text: bool = False) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans and ``kept``, the bytes left of each text.

    Columns of these names are replaced; all others stay as they are. With ``as_text`` kept is a
    string, without the parts of characters that a cut left over.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept"]
    documents = documents.drop(*added)
    own = F.coalesce(F.col(text), F.lit(""))
    keyed = documents.withColumn("__key", F.unhex(F.md5(own)))
    ranges = repeated_ranges(keyed.select(F.col("__key").alias("key"), own.alias("text")), length, gram)
    ranges = ranges.select(F.col("key").alias("__key"), F.col("whole").alias("__whole"),
                           F.col("ranges").alias("__ranges"))
    schema = T.StructType([
        *documents.schema.fields, *(T.StructField(x, T.LongType()) for x in added[:3]),
        T.StructField("kept", T.StringType() if as_text else T.BinaryType()),
    ])

    names = documents.columns

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x.as_py() or "").encode() for x in batch.column(text)]
            done = [cut(t, w.as_py(), r.as_py())
                    for t, w, r in zip(texts, batch.column("__whole"), batch.column("__ranges"), strict=True)]
            columns = [batch.column(name) for name in names]
            columns += [pa.array(map(len, texts), pa.int64()),
                        pa.array((d[1] for d in done), pa.int64()),
                        pa.array((d[2] for d in done), pa.int64()),
                        pa.array((d[0].decode("utf-8", "ignore") for d in done), pa.string()) if as_text
                        else pa.array((d[0] for d in done), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    return keyed.join(ranges, "__key", "left").mapInArrow(remove, schema)


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return without_repeats(documents.select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
