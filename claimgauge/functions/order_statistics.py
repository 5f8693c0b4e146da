"""Exact medians, percentiles and ranks without a global sort in one task.

A ``RankIndex`` is a table of a column's distinct values, each with the rows that have it, cut into
ranges of values by Spark's range partitioning, and a fence for each range: its first and last value,
its rows and the rows before it. A value shared by a third of all rows is one row. Whatever is asked
looks up its range in the fences and reads that range only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimgauge.functions.expressions import ratio
from claimgauge.sources.staging import Staging


class RankIndex:
    """The order statistics of one column, as tables in a folder.

    ``values``: value, weight and its range, one folder for each range. ``fences``: one row for each
    range. ``facts``: one row with n, the mean and the sample standard deviation (``spread``).
    """

    def __init__(self, values: DataFrame, fences: DataFrame, facts: DataFrame) -> None:
        self.values, self.fences, self.facts = values, fences, facts

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> RankIndex:
        fences, facts = (spark.read.parquet(f"{folder}/{name}") for name in ("fences", "facts"))
        # Without values there is no file to take the type from.
        kind = fences.schema["low"].dataType.simpleString()
        values = spark.read.schema(f"value {kind}, weight bigint, range int").parquet(f"{folder}/values")
        return cls(values, fences, facts)

    @classmethod
    def build(cls, frame: DataFrame, column: str, folder: str, ranges: int | None = None) -> RankIndex:
        """Writes the index of a column's values that are not null. ``ranges``: by default Spark's choice."""
        spark = frame.sparkSession
        placed = _in_ranges(frame, column, ranges)
        placed.write.mode("overwrite").partitionBy("range").parquet(f"{folder}/values")
        values = spark.read.schema(placed.schema).parquet(f"{folder}/values")
        _fences(values).coalesce(1).write.mode("overwrite").parquet(f"{folder}/fences")
        _facts(values, spark.read.parquet(f"{folder}/fences")).write.mode("overwrite").parquet(f"{folder}/facts")
        return cls.open(spark, folder)

    def median(self) -> DataFrame:
        """One row, one column: the mean of the two middle values. Reads the ranges that hold them."""
        return self._mean_of(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)

    def at(self, position: int) -> DataFrame:
        """One row, one column named median: the value of the row at a position from 1. Reads its range."""
        return self._mean_of(F.lit(position), F.lit(position))

    def _mean_of(self, lower: Column, upper: Column) -> DataFrame:
        fences = self.fences.select("*", F.sum("inside").over(Window.partitionBy()).alias("n"))
        near = fences.where((F.col("before") < upper) & (F.col("before") + F.col("inside") >= lower))
        placed = self._placed(near)

        def first_at(position: Column) -> Column:
            return F.min(F.when(F.col("up_to") >= position, F.col("value"))).cast("double")

        return placed.agg(((first_at(lower) + first_at(upper)) / 2).alias("median"))

    def cumulative(self) -> DataFrame:
        """One row for each distinct value: ``value``, ``up_to`` (rows at or below it), ``n`` (all rows)."""
        fences = self.fences.select("*", F.sum("inside").over(Window.partitionBy()).alias("n"))
        return self._placed(fences).select("value", "up_to", "n")

    def rows_up_to(self, value: object) -> DataFrame:
        """One row: ``up_to`` for a value, which need not occur, and ``n``. Reads one range."""
        at = F.lit(value)
        fence = self.fences.where(F.col("low") <= at).orderBy(F.col("range").desc()).select("range", "before").first()
        n = self.facts.select("n").scalar()
        if fence is None:
            return self.facts.select(F.lit(0).cast("bigint").alias("up_to"), "n")
        own = self.values.where((F.col("range") == fence["range"]) & (F.col("value") <= at))
        return own.agg((F.sum("weight") + fence["before"]).alias("up_to")).withColumn("n", n)

    def _placed(self, fences: DataFrame) -> DataFrame:
        inside = Window.partitionBy("range").orderBy("value")
        joined = self.values.join(F.broadcast(fences.select("range", "before", "n")), "range")
        return joined.withColumn("up_to", F.col("before") + F.sum("weight").over(inside))


def _in_ranges(frame: DataFrame, column: str, ranges: int | None = None) -> DataFrame:
    """Distinct values with their weight and range, sorted."""
    counts = (
        frame.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    ranged = counts.repartitionByRange(*([ranges] if ranges else []), "value")
    return ranged.withColumn("range", F.spark_partition_id()).sortWithinPartitions("range", "value")


def _fences(values: DataFrame) -> DataFrame:
    sizes = values.groupBy("range").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.sum("weight").alias("inside"),
        F.sum(F.col("value") * F.col("weight")).alias("total"))
    # One row for each range: safe to order in one task.
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("*", F.coalesce(F.sum("inside").over(earlier), F.lit(0)).alias("before"))


def _facts(values: DataFrame, fences: DataFrame) -> DataFrame:
    mean = ratio(F.sum("total"), F.sum("inside"))
    middle = fences.agg(mean.alias("mean")).scalar()
    apart = F.pow(F.col("value").cast("double") - middle, 2) * F.col("weight")
    spread = values.agg(
        F.sqrt(ratio(F.sum(apart), F.nullif(F.sum("weight") - 1, F.lit(0)))).alias("spread")).scalar()
    counted = fences.agg(F.coalesce(F.sum("inside"), F.lit(0)).alias("n"), mean.alias("mean"))
    return counted.withColumn("spread", spread)


def indexed(frame: DataFrame, column: str, staging: Staging | None = None) -> RankIndex:
    """An index for one job: the values are a shared table, fences and facts are derived as needed."""
    staging = staging or Staging(frame.sparkSession)
    values = staging.keep(_in_ranges(frame, column), "ranks")
    fences = _fences(values)
    return RankIndex(values, fences, _facts(values, fences))


def median(
    frame: DataFrame, column: str, exact: bool = True, accuracy: int = 10_000, staging: Staging | None = None
) -> DataFrame:
    """One row, one column. Exact: the mean of the two middle values. Otherwise the lower of them, which
    exists; of the values only those near it are ordered."""
    if not exact:
        return _lower_median(frame.where(F.col(column).isNotNull()), column, accuracy, staging)
    return indexed(frame, column, staging).median()


def _lower_median(frame: DataFrame, column: str, accuracy: int, staging: Staging | None) -> DataFrame:
    """An approximate percentile on either side, twice its error away, tells where the middle lies; the rows
    between are ranked. Should they not hold it, all are."""
    value = F.col(column)
    off = min(0.5, 2 / accuracy)
    sides = frame.agg(F.percentile_approx(value, [0.5 - off, 0.5 + off], accuracy)).first()[0]
    if sides is None:
        return frame.agg(F.max(value).cast("double").alias("median"))
    between = value.between(*sides)
    n, before, inside = frame.agg(
        F.count(F.lit(1)), F.count_if(value < sides[0]), F.count_if(between)).first()
    position = (n + 1) // 2
    if before < position <= before + inside:
        return indexed(frame.where(between), column, staging).at(position - before)
    return indexed(frame, column, staging).at(position)


def global_rank(frame: DataFrame, order: list[Column], name: str, staging: Staging) -> DataFrame:
    """Number the rows 1..n in the given order, which must leave no ties.

    The rows are range-sorted and written once; a row's rank is the number of rows in earlier
    ranges (one small row per range) plus its place in its own.
    """
    ordered = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staging.keep(ordered.withColumns(
        {"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), name)
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select(
        "_range",
        (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"),
    )
    in_range = F.row_number().over(Window.partitionBy("_range").orderBy("_place"))
    ranked = placed.withColumn("_in_range", in_range).join(F.broadcast(before), "_range")
    return ranked.select(
        (F.col("_before") + F.col("_in_range")).alias("rank"), *[F.col(c) for c in frame.columns]
    )
