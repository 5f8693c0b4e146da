"""Near duplicates by the Jaccard similarity of word n-grams: banded MinHash LSH, then exact checks.

This is not an LSH forest: there are no sorted prefixes of varying length. As the threshold is fixed, one
depth of the prefixes, known before any data are read, gives the recall, and equal prefixes are one key.

1. Signatures. Each text gets the minima of ``trees`` x depth hash functions over its n-grams. Texts
   with the same set of n-grams form one class and go on as one row.
2. Bands. Every tree groups the classes by its part of the signature, hashed to one key. Its depth is
   the largest, up to LONGEST, at which the chance to miss a pair at the threshold, in all trees
   together, is below 1 - ``recall``: 20 bands of 4 for the constants below.
3. Sketches. Classes that share a prefix are compared by their whole signatures, and only those that
   agree in ``sketch`` of it or more stay connected. Their connected components are small groups of
   texts that are alike; texts that merely share a passage do not get in.
4. Exact verification of all pairs within a component by their n-grams, so that a pair missed by the
   bands is still found if others connect it.

Large buckets and components are cut into lots; pairs are met inside tasks and leave them as a count
and one edge to a root for each member, never as pairs.

A text of fewer than n words, but at least one, has all its words as its only n-gram. Edge cases:
null text and text without words are linked to nothing; repeated rows are copies; an empty table
gives no rows. ``class_id`` is the smallest doc_id of the group, null if the group has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from claimgauge.llm.bytehash import mix, packed, words
from claimgauge.llm.groups import components, in_blocks, roots, runs
from claimgauge.llm.shared import keep

THRESHOLD = 0.8
WORDS = 5
TREES = 20
#: Prefixes begin with this length.
LONGEST = 8
RECALL = 0.9999
#: The share of a signature that has to agree. With 80 functions a pair of similarity 0.8 falls below
#: it by 4.5 standard deviations, one of 0.3 gets there by 5.9.
SKETCH = 0.6
#: Members of a lot.
LOT = 400


def prefix_length(threshold: float, trees: int = TREES, longest: int = LONGEST,
                  recall: float = RECALL) -> int:
    """Shortens the prefix until the recall of all trees at the threshold is reached."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-grams of each text, sorted."""
    hashes, rows, counts = words(data, offsets)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    begins = np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(counts)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begins[of]
    padded = np.r_[hashes, np.zeros(n, np.uint64)]
    grams = np.zeros(len(at), np.uint64)
    for k in range(n):
        inside = (at + k) < (begins + counts)[of]
        grams = mix(grams * np.uint64(5) + np.where(inside, padded[at + k], np.uint64(k)), k + 1)
    order = np.lexsort((grams, of))
    of, grams = of[order], grams[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (grams[1:] != grams[:-1])
    return of[new], grams[new]


def _signatures(texts: DataFrame, n: int, trees: int, depth: int) -> DataFrame:
    """From (doc_id, text_key, text), for texts with a word: class_key, size, prefixes, sketch."""
    factors = np.random.default_rng(5).integers(1, 2**63, trees * depth, dtype=np.uint64)
    factors = factors * np.uint64(2) + np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, _, data, offsets in packed(batch.column("text")):
                row, grams = shingles(data, offsets, n)
                if not len(row):
                    continue
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                sizes = np.diff(np.r_[first, len(row)])
                least = np.stack([np.minimum.reduceat(grams * f, first) for f in factors], 1)
                keys = np.stack([np.add.reduceat(mix(grams, 1), first),
                                 np.add.reduceat(mix(grams, 2), first)], 1)
                prefix = np.zeros((len(first), trees), np.uint64)
                by_tree = mix(least).reshape(len(first), trees, depth)
                for k in range(depth):
                    prefix = mix(prefix * np.uint64(3) + by_tree[:, :, k], k + 1)
                prefix = mix(prefix + np.arange(trees, dtype=np.uint64))
                sketch = (mix(least) >> np.uint64(56)).astype(np.uint8)
                take = pa.array(row[first] + begin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(take), batch.column("text_key").take(take),
                     _bytes(keys), pa.array(sizes.astype(np.int64)),
                     pa.FixedSizeListArray.from_arrays(pa.array(prefix.ravel().view(np.int64)), trees)
                     .cast(pa.list_(pa.int64())), _bytes(sketch)],
                    ["doc_id", "text_key", "class_key", "size", "prefixes", "sketch"],
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text_key", "text").mapInArrow(
        sign, f"doc_id {kind}, text_key binary, class_key binary, size bigint, "
              "prefixes array<bigint>, sketch binary")


def _bytes(matrix: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.itemsize * matrix.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(width), len(matrix), [None, pa.py_buffer(matrix)]).cast(pa.binary())


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _alike(classes: DataFrame, least: float, lot: int) -> DataFrame:
    """Edges (a, b) between classes of a bucket whose sketches agree."""
    buckets = classes.select("class_key", F.explode("prefixes").alias("bucket"))
    met = in_blocks(buckets, "bucket", "class_key", lot).join(
        classes.select("class_key", "sketch"), "class_key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in runs(batches, 3):
            sketches, keys = _matrix(rows.column("sketch")), rows.column("class_key").to_pylist()
            a, b = [], []
            for begin, end in pairwise(bounds.tolist()):
                mine = sketches[begin:end]
                left, right = [], []
                for i in range(len(mine) - 1):
                    close = i + 1 + np.flatnonzero(
                        (mine[i + 1:] == mine[i]).sum(1) >= least * mine.shape[1])
                    left.append(np.full(len(close), i))
                    right.append(close)
                if not left:
                    continue
                root = roots(len(mine), np.concatenate(left), np.concatenate(right))
                for x in np.flatnonzero(root != np.arange(len(mine))):
                    a.append(keys[begin + x])
                    b.append(keys[begin + root[x]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return (
        met.select("bucket", "lot_a", "lot_b", "class_key", "sketch")
        .repartition("bucket", "lot_a", "lot_b")
        .sortWithinPartitions("bucket", "lot_a", "lot_b", "class_key")
        .mapInArrow(compare, "a binary, b binary")
    )


def _verified(met: DataFrame, n: int, threshold: float) -> DataFrame:
    """For each member of each meeting of lots: links there, and the root it is linked with."""
    ratio = Fraction(str(threshold))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in runs(batches, 3):
            keys, lots = rows.column("class_key").to_pylist(), rows.column("lot").to_numpy()
            copies = rows.column("copies").to_numpy()
            a, b = rows.column("lot_a").to_numpy(), rows.column("lot_b").to_numpy()
            out = [[], [], []]
            for begin, end in pairwise(bounds.tolist()):
                shared, sizes = _overlaps(rows.column("text").slice(begin, end - begin), n)
                union = sizes[:, None] + sizes[None, :] - shared
                linked = shared * ratio.denominator >= union * ratio.numerator
                np.fill_diagonal(linked, False)
                if a[begin] != b[begin]:
                    linked &= lots[begin:end, None] != lots[None, begin:end]
                root = roots(end - begin, *np.nonzero(np.triu(linked)))
                out[0] += keys[begin:end]
                out[1] += (linked @ copies[begin:end]).tolist()
                out[2] += [keys[begin + x] for x in root]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())],
                ["class_key", "links", "root"])

    return (
        met.select("component", "lot_a", "lot_b", "lot", "class_key", "copies", "text")
        .repartition("component", "lot_a", "lot_b")
        .sortWithinPartitions("component", "lot_a", "lot_b", "class_key")
        .mapInArrow(verify, "class_key binary, links bigint, root binary")
    )


def _overlaps(texts: pa.ChunkedArray, n: int, width: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """How many n-grams each two texts share, and how many each has."""
    row, grams = [], []
    for begin, _, data, offsets in packed(texts):
        r, g = shingles(data, offsets, n)
        row.append(r + begin)
        grams.append(g)
    row, grams = np.concatenate(row), np.concatenate(grams)
    members = len(texts)
    _, number, counts = np.unique(grams, return_inverse=True, return_counts=True)
    common = counts[number] > 1
    row_common = row[common]
    _, number = np.unique(number[common], return_inverse=True)
    order = np.argsort(number, kind="stable")
    row_common, number = row_common[order], number[order]
    shared = np.zeros((members, members), np.int64)
    for begin in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        lo, hi = np.searchsorted(number, [begin, begin + width])
        part = np.zeros((members, width), np.float32)
        part[row_common[lo:hi], number[lo:hi] - begin] = 1
        shared += (part @ part.T).astype(np.int64)
    return shared, np.bincount(row, minlength=members)


def text_key(text: Column) -> Column:
    """The same for equal texts only."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, trees: int = TREES,
                    recall: float = RECALL, lot: int = LOT) -> DataFrame:
    """For each text of (doc_id, text): text_key, class_id, class_text (the key of the text that
    stands for the class) and n_links, the number of other rows it is linked with. One row for each
    row of ``documents``, in no order."""
    texts = documents.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    depth = prefix_length(threshold, trees, recall=recall)
    signed = keep(_signatures(texts, n, trees, depth), "join-signed")
    least_id = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    classes = keep(
        signed.groupBy("class_key").agg(
            F.count("*").alias("copies"), F.min(least_id).alias("rep"),
            F.first(F.struct("prefixes", "sketch")).alias("s"),
        ).select("class_key", "copies", "rep", "s.*"),
        "join-classes",
    )
    grouped = components(_alike(classes, SKETCH, lot), "join-alike").select(
        F.col("node").alias("class_key"), F.col("root").alias("component"))
    members = keep(
        in_blocks(grouped, "component", "class_key", lot)
        .join(classes.select("class_key", "copies", F.col("rep.text_key").alias("text_key")), "class_key"),
        "join-members",
    )
    own = members.select("text_key").distinct()
    bodies = texts.groupBy("text_key").agg(F.first("text").alias("text")).join(own, "text_key")
    checked = keep(_verified(members.join(bodies, "text_key"), n, threshold), "join-checked")
    edges = checked.select(F.col("class_key").alias("a"), F.col("root").alias("b"))
    together = components(edges, "join-linked")
    links = checked.groupBy("class_key").agg(F.sum("links").alias("links"))
    found = keep(
        classes.select("class_key", "copies", "rep")
        .join(links, "class_key", "left")
        .join(together.select(F.col("node").alias("class_key"), "root"), "class_key", "left")
        .select("class_key", "rep", F.coalesce("root", "class_key").alias("root"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "join-found",
    )
    heads = found.groupBy("root").agg(F.min("rep").alias("head"))
    by_class = found.join(heads, "root").select("class_key", "head", "n_links")
    known = signed.select("doc_id", "text_key", "class_key").join(by_class, "class_key").select(
        "doc_id", "text_key", F.col("head.doc_id").alias("class_id"),
        F.col("head.text_key").alias("class_text"), "n_links")
    wordless = texts.where(~F.coalesce("text", F.lit("")).rlike("[^ \\t\\n\\x0B\\f\\r]")).select(
        "doc_id", "text_key", F.col("doc_id").alias("class_id"),
        F.lit(None).cast("binary").alias("class_text"), F.lit(0).cast("bigint").alias("n_links"))
    return known.unionByName(wordless)


def _has_no_order(field: StructField) -> bool:
    return "map<" in field.dataType.simpleString() or "variant" in field.dataType.simpleString()


def one_of_each(documents: DataFrame, **options: float) -> DataFrame:
    """The documents without those that a document of the same class, with a smaller id, stands for.

    Documents without a word all stay: they are linked to nothing.
    """
    kept = near_duplicates(documents, **options).select(
        F.col("class_text").alias("__key")).where("__key is not null").distinct()
    keyed = documents.withColumn("__key", text_key(F.col("text")))
    has_word = F.coalesce("text", F.lit("")).rlike("[^ \\t\\n\\x0B\\f\\r]")
    others = [f for f in documents.schema.fields if f.name != "doc_id"]
    row = F.struct(F.col("doc_id").isNull().alias("__none"), "doc_id", *[f.name for f in others])
    if any(map(_has_no_order, others)):
        # Rows of one id and text go by their columns, those without an order as JSON.
        least = F.min_by(row, F.struct(F.col("doc_id").isNull(), "doc_id", *[
            F.to_json(F.struct(f.name)) if _has_no_order(f) else F.col(f.name) for f in others]))
    else:
        least = F.min(row)
    first = keyed.where(has_word).groupBy("__key").agg(least.alias("row")).join(kept, "__key", "left_semi")
    return first.select(*[F.col("row")[c].alias(c) for c in documents.columns]).unionByName(
        documents.where(~has_word))


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links."""
    return near_duplicates(documents).select("doc_id", "class_id", "n_links")
