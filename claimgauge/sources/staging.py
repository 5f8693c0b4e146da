"""Tables that several branches of a job share, written once to the cluster's shared folder.

A written table survives the loss of executors, cuts the lineage back to the raw claims, is read
column by column, and carries its real size, from which Spark decides whether it may broadcast.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The folder made for a local session that names none.
_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, or the context's checkpoint folder. A local session needs neither; a
    cluster must name a folder that is not on one machine."""
    local = spark.sparkContext.master.startswith("local")
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        if not local and folder.startswith("file:"):
            raise RuntimeError(f"{folder} is a folder of one machine; executors cannot share it")
        return folder.rstrip("/")
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="claimgauge-"))
    return _LOCAL[0]


class Staging:
    """A folder of its own for one job's shared tables."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.folder = f"{folder or shared_folder(spark)}/staged-{uuid.uuid4().hex}"

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    def close(self) -> None:
        """Delete this job's tables. Frames that read them cannot be used afterwards."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
