"""Tables in the shared folder of the cluster, and small helpers the operators have in common."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: ASCII white space, as a Java character class and as the characters themselves (fixed values).
SPACE_CLASS = "[ \\t\\n\\x0B\\f\\r]"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: The folder made where none is named.
_OWN: list[str] = []
#: Applications whose workers have the library.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this library to the Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = shutil.make_archive(
            f"{tempfile.mkdtemp()}/{os.path.basename(package)}", "zip",
            os.path.dirname(package), os.path.basename(package))
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where it is unset and the master is local, as in tests, a temporary folder takes its place.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="llm-shared-"))
    return _OWN[0]


def keep(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes ``df`` once into the shared folder and reads it back.

    What is read again later, or must not change when a lost task runs once more, goes through
    here. The table stays until the folder is cleaned, as Spark's own checkpoints do.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps, which it does when their plans are
    collected as garbage; else they stay until the driver happens to run out of memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*kept: DataFrame) -> None:
    """Deletes tables that ``keep`` wrote and nothing reads any more."""
    for df in kept:
        files = df.inputFiles()
        if files:
            jvm = df.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
