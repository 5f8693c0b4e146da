"""Removal of words in passages that a document with a smaller doc_id has, by super-k-mers.

A window is ``length`` consecutive words; its *minimiser* is its ``gram`` words of least hash. Equal
windows have equal minimisers at the same place, so they meet in the minimiser's bucket.

1. Consecutive windows of a text that share a minimiser make one super-k-mer. Equal texts count once.
2. Minimisers met under one doc_id only drop out; of the others, super-k-mers travel as one packed
   string each to their bucket. Equal strings become one row, however many texts have them.
3. In a bucket all windows of its strings are sorted; a run of equal windows shows the smallest
   doc_id that has it, exactly: words are compared, not hashes. A bucket of more than ``LOT`` strings
   is dealt out window by window: the windows are grouped with partial counts and joined again, so no
   task sees a whole hot bucket, nor all rows of a hot window.
4. A window that some smaller doc_id has loses its words in every text.

Windows are judged on the input, and words are cut from the texts at the end.

Edge cases: null text has no words; texts of under ``length`` words keep all; a passage repeated under
one doc_id only (in one text, or in rows of that doc_id) stays; rows with a null doc_id lose nothing and
take nothing from others; equal rows get equal results; an empty table gives no rows. Texts of
over ``PART`` words are searched in overlapping parts. Added columns replace those of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgauge.llm.bytehash import mix, packed, words
from claimgauge.llm.groups import runs
from claimgauge.llm.shared import discard, keep

GRAM = 4
#: Strings of a bucket that is sorted as a whole.
LOT = 5000
#: Words of a text that are searched at a time.
PART = 1 << 18

#: Odd factors for the words of a gram.
_FACTORS = np.random.default_rng(12).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64(32)

_CLASSES = "key binary, doc_id bigint, mini array<bigint>, start array<int>, windows array<int>"
_STRINGS = "mini bigint, id bigint, least bigint, start int, windows int, packed string"
_RUNS = "mini bigint, hash binary, begin int, windows int, low bigint"


def super_kmers(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, minimiser, first word, windows) of the super-k-mers of texts of at most 2**32 words."""
    hashes, _, counts = words(data, offsets)
    sizes = np.maximum(counts - length + 1, 0)
    if not sizes.sum():
        return tuple(np.empty(0, np.int64) for _ in range(4))
    n = len(hashes) - gram + 1
    grams = np.zeros(n, np.uint64)
    for i in range(gram):
        grams += hashes[i:i + n] * _FACTORS[i]
    grams = mix(grams)
    # The upper half of the hash, and among equals the first place: the same choice in equal windows.
    least = (grams >> _LOW << _LOW) | np.arange(n, dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[:have - width], least[width - have:])
    rows = np.repeat(np.arange(len(sizes)), sizes)
    first_words = np.cumsum(counts) - counts
    begins = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first_words[rows]
    anchors = (least[begins] & np.uint64(2**32 - 1)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1])])
    row = rows[new]
    return (row, grams[anchors[new]].view(np.int64), begins[new] - first_words[row],
            np.diff(np.r_[new, len(begins)]))


def _parts(text: str, length: int) -> list[tuple[int, bytes]]:
    """A text as (first word, words) parts that share ``length`` - 1 words with the next."""
    split = text.encode().split()
    return [(i, b" ".join(split[i:i + PART + length - 1])) for i in range(0, max(1, len(split) - length + 1), PART)]


def _classes(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The super-k-mers of each text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in packed(batch.column("text"), PART):
                if end - begin == 1 and len(data) > PART:  # a long text comes alone
                    own = [(at, np.frombuffer(part, np.uint8)) for at, part in _parts(data.tobytes().decode(), length)]
                    found = [super_kmers(part, np.array([0, len(part)]), length, gram) for _, part in own]
                    row, mini, start, windows = (np.concatenate(x) for x in zip(*found, strict=True))
                    start = start + np.repeat([at for at, _ in own], [len(f[0]) for f in found])
                else:
                    row, mini, start, windows = super_kmers(data, offsets, length, gram)
                counts = np.bincount(row, minlength=end - begin)
                ends = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(begin, end - begin), batch.column("doc_id").slice(begin, end - begin),
                     pa.ListArray.from_arrays(ends, pa.array(mini, pa.int64())),
                     pa.ListArray.from_arrays(ends, pa.array(start, pa.int32())),
                     pa.ListArray.from_arrays(ends, pa.array(windows, pa.int32()))],
                    ["key", "doc_id", "mini", "start", "windows"]).filter(pa.array(counts > 0))

    return texts.select("key", "doc_id", "text").mapInArrow(find, _CLASSES)


def _strings(bodies: DataFrame, length: int) -> DataFrame:
    """The wanted super-k-mers of each text as packed strings: words joined by one space."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("stretches")
            counts = np.diff(wanted.offsets.to_numpy())
            mini, start, windows = wanted.flatten().flatten()
            begin, end = start.to_numpy(), start.to_numpy() + windows.to_numpy() + length - 1
            strings, at = [], 0
            for text, n in zip(batch.column("text").to_pylist(), counts.tolist(), strict=True):
                split = text.encode().split()
                joined = b" ".join(split)
                places = np.r_[0, np.cumsum([len(w) + 1 for w in split])]
                own = slice(at, at + n)
                strings += [joined[x:y] for x, y in zip(
                    places[begin[own]].tolist(), (places[end[own]] - 1).tolist(), strict=True)]
                at += n
            of = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays(
                [mini, batch.column("id").take(of), batch.column("least").take(of), start, windows,
                 pa.array(strings, pa.binary()).cast(pa.string())],
                ["mini", "id", "least", "start", "windows", "packed"])

    return bodies.select("id", "least", "text", "stretches").mapInArrow(pack, _STRINGS)


def smallest(strings: list[tuple[str, int]], length: int) -> list[list[int]]:
    """For (packed string, least doc_id) of a bucket: the smallest doc_id of each of their windows."""
    found: list[list[int]] = []
    windows = []
    for number, (string, least) in enumerate(strings):
        split = string.split(" ")
        found.append([least] * (len(split) - length + 1))
        if len(strings) > 1:
            windows += [(split[i:i + length], least, number, i) for i in range(len(found[-1]))]
    windows.sort()
    run: list[str] | None = None
    low = 0
    for window, least, number, i in windows:
        if window != run:
            run, low = window, least
        found[number][i] = low
    return found


def _in_buckets(strings: DataFrame, length: int, lot: int) -> DataFrame:
    """(mini, hash, begin, windows, low): windows of a string that doc_id low has, low below the greatest
    doc_id of the string."""
    sizes = keep(strings.groupBy("mini").agg(F.count("*").alias("n")).where(F.col("n") > lot), "repeat-hot")
    words = F.split("packed", " ", -1)
    windows = strings.join(sizes, "mini").select(
        "mini", "hash", "least", "most", words.alias("words"),
        F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("begin"),
    ).withColumn("window", F.array_join(F.slice("words", F.col("begin") + 1, F.lit(length)), " "))
    lows = keep(
        windows.groupBy("mini", "window").agg(F.min("least").alias("low"), F.max("most").alias("high"))
        .where("low < high").drop("high"), "repeat-lows")
    hot = windows.join(lows, ["mini", "window"]).where("low < most").select(
        "mini", "hash", "begin", F.lit(1).alias("windows"), "low")
    cold = strings.join(sizes, "mini", "left_anti").select("mini", "hash", "least", "most", "packed")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches, 1):
            mini, hashes, least, most, string = (table.column(i).to_pylist() for i in range(5))
            out: list[tuple] = []
            for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(mini)], strict=True):
                for r, lows in enumerate(smallest(list(zip(string[a:b], least[a:b], strict=True)), length), a):
                    at = 0
                    for i in range(1, len(lows) + 1):
                        if i == len(lows) or lows[i] != lows[at]:
                            if lows[at] < most[r]:
                                out.append((mini[r], hashes[r], at, i - at, lows[at]))
                            at = i
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 5,
                                                (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64()), strict=True)],
                ["mini", "hash", "begin", "windows", "low"])

    found = cold.repartition("mini").sortWithinPartitions("mini").mapInArrow(sort, _RUNS)
    return found.unionByName(hot)


def copied_ranges(texts: DataFrame, length: int = 13, gram: int = GRAM, lot: int = LOT) -> DataFrame:
    """From (key, doc_id, text), where equal keys mean equal texts: for each text with words to cut its
    key, ``least`` (its smallest doc_id) and ``ranges``, array of (a, end) in words, which go from the
    rows of doc_id least. Rows of a greater doc_id lose all words if they have a window."""
    texts = texts.where("doc_id is not null and text != ''")
    classes = keep(
        _classes(texts, length, gram).groupBy("key").agg(
            F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"),
            F.first(F.struct("mini", "start", "windows")).alias("s"),
        ).select("key", "least", "greatest", "s.*").withColumn("id", F.monotonically_increasing_id()),
        "repeat-classes")
    heads = keep(classes.select("id", "key", "least", "greatest"), "repeat-heads")
    rows = classes.select(
        "id", "least", F.explode(F.arrays_zip("mini", "start", "windows")).alias("s")).select("id", "least", "s.*")
    # Written, here and below, so that Spark can split the join at a hot minimiser.
    shared = keep(
        rows.groupBy("mini").agg(F.min("least").alias("low"), F.max("least").alias("high"))
        .where("low < high").select("mini"), "repeat-minimisers")
    wanted = keep(
        rows.join(shared, "mini", "left_semi").groupBy("id").agg(
            F.collect_list(F.struct("mini", "start", "windows")).alias("stretches"))
        .join(heads.select("id", "key", "least"), "id"), "repeat-wanted")
    discard(classes, shared)
    bodies = texts.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key")
    met = keep(_strings(bodies, length).withColumn("hash", F.substring(F.unhex(F.sha2("packed", 256)), 1, 16)), "repeat-strings")
    discard(wanted)
    strings = met.groupBy("mini", "hash").agg(
        F.min("least").alias("least"), F.max("least").alias("most"),
        F.first("windows").alias("windows"), F.first("packed").alias("packed"))
    strings = keep(strings, "repeat-distinct")
    places = keep(met.select("mini", "hash", "id", "least", "start"), "repeat-places")
    discard(met)
    found = keep(_in_buckets(strings, length, lot), "repeat-found")
    discard(strings)
    place = F.col("start") + F.col("f.begin")
    ranges = (
        places.join(found.alias("f"), ["mini", "hash"]).where(F.col("low") < F.col("least"))
        .groupBy("id").agg(F.collect_list(F.struct(
            place.alias("a"), (place + F.col("f.windows") + (length - 1)).alias("end"))).alias("ranges")))
    result = keep(
        heads.join(ranges, "id", "left")
        .where("greatest > least or ranges is not null").select("key", "least", "ranges"), "repeat-ranges")
    discard(heads, places, found)
    return result


def cut(split: list[bytes], ranges: list[dict]) -> list[bytes]:
    """The words outside the ranges."""
    left, at = [], 0
    for begin, end in sorted((r["a"], r["end"]) for r in ranges):
        left += split[at:begin]
        at = max(at, end)
    return left + split[at:]


def without_copies(documents: DataFrame, length: int = 13, gram: int = GRAM, lot: int = LOT) -> DataFrame:
    """Adds n_words, n_removed and ``kept``, the words left, joined by one space."""
    added = ["n_words", "n_removed", "kept"]
    documents = documents.drop(*added)
    own = F.coalesce(F.col("text"), F.lit(""))
    keyed = documents.withColumn("__key", F.unhex(F.sha2(own, 256)))
    ranges = copied_ranges(
        keyed.select(F.col("__key").alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), own.alias("text")),
        length, gram, lot)
    ranges = ranges.select(F.col("key").alias("__key"), F.col("least").alias("__least"), F.col("ranges").alias("__ranges"))
    names = documents.columns
    schema = T.StructType([*documents.schema.fields, T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, doc_id, least, cuts in zip(
                    *(batch.column(x).to_pylist() for x in ("text", "doc_id", "__least", "__ranges")), strict=True):
                split = (text or "").encode().split()
                left = split
                if least is not None and doc_id is not None:
                    if doc_id > least and len(split) >= length:
                        left = []
                    elif doc_id == least and cuts:
                        left = cut(split, cuts)
                sizes.append(len(split))
                removed.append(len(split) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in names), pa.array(sizes, pa.int64()),
                 pa.array(removed, pa.int64()), pa.array(kept, pa.string())], [*names, *added])

    return keyed.join(ranges, "__key", "left").mapInArrow(remove, schema)


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return without_copies(documents.select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
