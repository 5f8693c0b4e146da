"""Groups inside tasks, and connected components of a graph kept as rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgauge.llm.shared import keep


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups from rows that come sorted by their first ``keys`` columns.

    Yields (rows, bounds): group g is rows bounds[g] to bounds[g + 1]. A group may lie across batches.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for k in range(keys):
            column = rows.column(k).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        bounds = np.flatnonzero(new)
        if len(bounds) > 1:
            yield rows.slice(0, bounds[-1]), bounds
        held = rows.slice(bounds[-1])
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n members the smallest member it is linked with."""
    at = list(range(n))

    def root(x: int) -> int:
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            at[max(a, b)] = min(a, b)
    return np.array([root(x) for x in range(n)])


def in_blocks(members: DataFrame, group: str, member: str, most: int) -> DataFrame:
    """Deals out the pairs within groups: adds ``lot_a``, ``lot_b`` and ``lot``.

    A group of more than ``most`` members is cut into lots of about that size by hash; each member
    goes to every pair of lots that has its own. So every pair of members meets in one (group,
    lot_a, lot_b), and no such meeting has more than about 2 * ``most`` members.
    """
    # Written, so that Spark can split the join at a hot group.
    sizes = keep(members.groupBy(group).agg(F.count("*").alias("__n")).where("__n > 1"), "group-sizes")
    lots = F.ceil(F.col("__n") / most).cast("int")
    own = F.pmod(F.xxhash64(member, F.lit(7)), F.col("lots")).cast("int")
    return (
        members.join(sizes, group)
        .withColumn("lots", lots)
        .withColumn("lot", own)
        .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
        .withColumn("lot_a", F.least("lot", "__other"))
        .withColumn("lot_b", F.greatest("lot", "__other"))
        .drop("__other", "__n")
    )


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node it is connected with.

    Alternates large-star and small-star steps (Kiveris et al.), each written to the shared folder,
    until nothing moves. Only rows travel; a node with very many neighbours is aggregated before the
    shuffle, and its join is one that Spark can split.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = keep(edges.distinct(), name)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a != b").distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.*").where("a != b").distinct()
        edges = keep(small, name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
