"""Tables that are asked for one key at a time.

Rows are dealt to a fixed number of buckets, one folder each, by a hash of the key, and lie there
sorted by key, with a Bloom filter of the keys and small pages. A lookup lists one folder; in its files
it skips row groups by the filter and by least and greatest key, and pages by the column index. So what it
reads grows neither with the table nor with its number of files. Inside a bucket rows are cut by range, so
a key with very many rows spans several files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
_BUCKET = "key_bucket"
#: Bytes of a row group and rows of a page.
_ROW_GROUP, _PAGE_ROWS = 16 << 20, 1000


def bloom_filtered(writer: DataFrameWriter, key: str) -> DataFrameWriter:
    """Options that make lookups by ``key`` skip what can't hold it."""
    return writer.options(**{
        f"parquet.bloom.filter.enabled#{key}": "true",
        f"parquet.bloom.filter.adaptive.enabled#{key}": "true",
        "parquet.block.size": str(_ROW_GROUP),
        "parquet.page.row.count.limit": str(_PAGE_ROWS),
    })


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_keyed(
    frame: DataFrame, path: str, key: str = "npi", order: tuple[str, ...] = (), buckets: int = BUCKETS,
    by: Column | None = None,
) -> None:
    """``order``: columns that further sort the rows of a key. ``by``: what the bucket is taken from, if
    not the key itself."""
    dealt = frame.withColumn(_BUCKET, bucket_of(F.col(key) if by is None else by, buckets))
    placed = dealt.repartitionByRange(_BUCKET, key, *order).sortWithinPartitions(_BUCKET, key, *order)
    bloom_filtered(placed.write.mode("overwrite"), key).partitionBy(_BUCKET).parquet(path)
    # An empty table has no file that could tell its columns.
    frame.limit(0).write.parquet(f"{path}/_columns")


def open_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The whole table with the column that its folders are named after."""
    columns = spark.read.parquet(f"{path}/_columns").schema
    return spark.read.schema(columns.add(_BUCKET, T.IntegerType())).parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The whole table."""
    return open_keyed(spark, path).drop(_BUCKET)


def read_key(
    spark: SparkSession, path: str, value: str, key: str = "npi", buckets: int = BUCKETS
) -> DataFrame:
    """The rows of one key."""
    bucket = F.pmod(F.xxhash64(F.lit(value)), F.lit(buckets)).cast("int")
    return open_keyed(spark, path).where((F.col(_BUCKET) == bucket) & (F.col(key) == value)).drop(_BUCKET)


def read_keys(
    found: DataFrame, path: str, keys: tuple[str, ...] = ("npi",), buckets: int = BUCKETS
) -> DataFrame:
    """The rows that agree with one of ``found`` in ``keys``, of which the first is the table's key, each
    row once. Few keys read few buckets: Spark prunes the folders once it has the keys."""
    wanted = found.select(*keys, bucket_of(F.col(keys[0]), buckets).alias(_BUCKET)).distinct()
    return open_keyed(found.sparkSession, path).join(wanted, [_BUCKET, *keys], "left_semi").drop(_BUCKET)
