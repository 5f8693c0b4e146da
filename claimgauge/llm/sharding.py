"""Sharding by a hierarchical weighted hash tree.

A row descends from the root to a region, a rack and a shard. At each level every child makes a
draw from a hash of (path of the child, key of the row), scaled by the child's weight, and the
smallest draw wins. A child's draw depends on nothing but its own path and weight, so a change of
weights moves rows only into or out of the children whose weights changed.

A new shard is hung below the root as a region of its own (``grow``). No other weight changes, so
it takes rows and no other row moves: the law is ``key``.

Edge cases: a null key is a key like any other; rows with equal keys share a shard; null text has
size 16 and the checksum of the empty text; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgauge.llm.shared import keep

#: Bytes that a stored row takes besides its text.
ROW_OVERHEAD = 16


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


def layout(shards: int, racks_per_region: int = 2, shards_per_rack: int = 4) -> tuple[Shard, ...]:
    """A tree of equal shards, filled rack by rack."""
    per_region = racks_per_region * shards_per_rack
    return tuple(
        Shard(f"region{n // per_region}", f"rack{n % per_region // shards_per_rack}", n)
        for n in range(shards)
    )


def grow(tree: tuple[Shard, ...], weight: float = 1.0) -> tuple[Shard, ...]:
    """The tree with one more shard, in a new region."""
    number = max(shard.number for shard in tree) + 1
    return (*tree, Shard(f"grown{number}", "rack0", number, weight))


def _draw(path: str, weight: float, key: Column) -> Column:
    """Exponentially distributed with the weight as its rate; from the 52 upper bits of the hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(path), key), 12)
    uniform = (bits.cast("double") + 0.5) / F.lit(float(2**52))
    return -F.log(uniform) / F.lit(weight)


def _winner(children: dict[str, float], key: Column) -> Column:
    """The path of the child with the smallest draw."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    draws = [F.struct(_draw(path, weight, key).alias("draw"), F.lit(path).alias("path"))
             for path, weight in children.items()]
    return F.array_min(F.array(*draws))["path"]


def with_shard(df: DataFrame, tree: tuple[Shard, ...], key: str, out: str) -> DataFrame:
    """Adds column ``out``, the number of the shard that ``key`` falls into."""
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    numbers = {}
    for shard in tree:
        paths = ("", shard.region, f"{shard.region}/{shard.rack}",
                 f"{shard.region}/{shard.rack}/{shard.number}")
        numbers[paths[3]] = shard.number
        for level, (parent, child) in enumerate(zip(paths, paths[1:], strict=False)):
            children = levels[level].setdefault(parent, {})
            children[child] = children.get(child, 0.0) + shard.weight
    at = f"__{out}_at"
    df = df.withColumn(at, F.lit(""))
    for level in levels:
        step = None
        for parent, children in level.items():
            chosen, here = _winner(children, F.col(key)), F.col(at) == parent
            step = F.when(here, chosen) if step is None else step.when(here, chosen)
        df = df.withColumn(at, step)
    shards = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    return df.withColumn(out, shards[F.col(at)].cast("int")).drop(at)


def with_slot(placed: DataFrame, shard: str = "shard", out: str = "slot") -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps.

    Rows are written once with the partition they came from. A shard's rows of one partition are
    numbered among themselves, after as many as the partitions before hold. So no task sees a whole
    shard, and a key with very many rows is spread over its partitions.
    """
    numbered = keep(
        placed.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}),
        "shards",
    )
    counts = numbered.groupBy(shard, "__part").agg(F.count("*").alias("__rows"))
    before = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        shard, "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy(shard, "__part").orderBy("__at")
    return (
        numbered.withColumn("__row", F.row_number().over(inside) - 1)
        .join(offsets, [shard, "__part"])
        .withColumn(out, (F.col("__before") + F.col("__row")).cast("long"))
        .drop("__part", "__at", "__before", "__row")
    )


def shard_documents(documents: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard with one more shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tree = layout(shards)
    sized = documents.select(
        "doc_id",
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = with_shard(with_shard(sized, tree, "doc_id", "shard"), grow(tree), "doc_id", "grown_shard")
    return with_slot(placed).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
