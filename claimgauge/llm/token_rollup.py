"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A change has an image of the document before and after: no image before is an insert, none after a
delete, both a revision. Either image is counted by every tokenizer and its counts are added with the
sign of the image, so a batch is reduced to one additive row for each (source, lang, tokenizer). The
totals are the sums over all committed batches.

A batch is committed under its id. It is written aside and then renamed to a folder of that name, so
it counts whole or not at all, whatever marks the writer leaves. Committing the same id again does
nothing; of two writers of one id the first to rename wins and the other's folder goes. (The store
has to rename folders in one step, as HDFS does.) ``compact`` sums the batches so far into a base, after
which totals read the base and the batches since.

Edge cases: null text counts no tokens but is a document; a null source or language is a group like
any other; a revision that changes the source or language moves the counts; repeated rows are
changes of their own; an empty batch commits no rows; without batches the totals are empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgauge.llm.bpe import encoder

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_documents", "n_tokens", "n_bytes")
_TOTALS = "source string, lang string, tokenizer string, n_documents bigint, n_tokens bigint, n_bytes bigint"

Tokenizers = dict[str, Callable[[], Callable[[str], int]]]


def words() -> Callable[[str], int]:
    """Runs of other characters than ASCII white space."""
    return lambda text: len(text.encode().split())


def byte_bpe(path: str, pattern: str) -> Callable[[], Callable[[str], int]]:
    def make() -> Callable[[str], int]:
        return encoder(path, pattern).count

    return make


def inserts(documents: DataFrame) -> DataFrame:
    """Every row of source, lang and text as an insert."""
    return documents.select(
        F.lit(None).cast("struct<source:string,lang:string,text:string>").alias("before"),
        F.struct("source", "lang", "text").alias("after"))


def changes(documents: DataFrame, gone: Column, after: Column) -> DataFrame:
    """Every row of source, lang and text as a delete where ``gone``, else as a revision to ``after``, a struct
    like the row's own."""
    kind = "struct<source:string,lang:string,text:string>"
    return documents.select(
        F.struct("source", "lang", "text").cast(kind).alias("before"), F.when(~gone, after).cast(kind).alias("after"))


def deltas(changes: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """One signed row for each source, language and tokenizer that the changes touch."""
    images = changes.select(F.explode(F.filter(
        F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("image")),
                F.struct(F.lit(1).alias("sign"), F.col("after").alias("image"))),
        lambda x: x["image"].isNotNull())).alias("x"))
    images = images.select("x.sign", "x.image.source", "x.image.lang", "x.image.text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {name: make() for name, make in tokenizers.items()}
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column("text")]
            sizes = pa.array([len(x.encode()) for x in texts], pa.int64())
            for name, counter in counters.items():
                yield pa.RecordBatch.from_arrays(
                    [batch.column("source"), batch.column("lang"), pa.array([name] * len(texts), pa.string()),
                     batch.column("sign").cast(pa.int64()), pa.array(map(counter, texts), pa.int64()), sizes],
                    ["source", "lang", "tokenizer", "sign", "tokens", "bytes"])

    counted = images.mapInArrow(
        count, "source string, lang string, tokenizer string, sign bigint, tokens bigint, bytes bigint")
    return counted.groupBy(*KEYS).agg(
        F.sum("sign").alias("n_documents"), F.sum(F.col("sign") * F.col("tokens")).alias("n_tokens"),
        F.sum(F.col("sign") * F.col("bytes")).alias("n_bytes"))


class Rollup:
    """Totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, tokenizers: Tokenizers):
        self.spark, self.folder, self.tokenizers = spark, folder.rstrip("/"), tokenizers

    def _exists(self, path: str) -> bool:
        where, files = self._files(path)
        return files.exists(where)

    def _files(self, path: str):
        """A path, and the file system it is in."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _place(self, attempt: str, path: str) -> bool:
        """Renames a finished attempt to ``path``, unless another has come first."""
        target, files = self._files(path)
        source = self._files(attempt)[0]
        if not files.exists(target) and files.rename(source, target):
            # Onto a folder that has come up meanwhile the rename moves into it, where readers do not look.
            inside = self._files(f"{path}/{source.getName()}")[0]
            if not files.exists(inside):
                return True
            files.delete(inside, True)
        files.delete(source, True)
        return False

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Whether the batch was new."""
        path = f"{self.folder}/batch={batch}"
        if self._exists(path):
            return False
        attempt = f"{self.folder}/_attempt-{uuid.uuid4().hex}"
        deltas(changes, self.tokenizers).write.parquet(attempt)
        return self._place(attempt, path)

    def _found(self, pattern: str) -> list[str]:
        where, files = self._files(f"{self.folder}/{pattern}")
        return sorted(str(x.getPath()) for x in files.globStatus(where) or [])

    def batches(self) -> list[str]:
        """The paths of the committed batches."""
        return self._found("batch=*")

    def _base(self) -> tuple[str | None, set[str]]:
        """The latest base, and the names of the batches in it."""
        bases = self._found("base-*")
        if not bases:
            return None, set()
        names = self.spark.read.schema("name string").parquet(f"{bases[-1]}/batches")
        return bases[-1], {r["name"] for r in names.collect()}  # one for each commit

    def _sums(self) -> tuple[DataFrame | None, list[str]]:
        """Sums by group over the base and the batches since, and the names of all of them."""
        base, names = self._base()
        since = [x for x in self.batches() if x.rsplit("/", 1)[1] not in names]
        paths = [f"{base}/sums"] * (base is not None) + since
        if not paths:
            return None, []
        summed = self.spark.read.schema(_TOTALS).parquet(*paths).groupBy(*KEYS).agg(*[F.sum(x).alias(x) for x in SUMS])
        return summed, sorted(names) + [x.rsplit("/", 1)[1] for x in since]

    def compact(self) -> bool:
        """Sums all batches so far into a new base; whether there was one to make."""
        base = self._base()[0]
        summed, names = self._sums()
        if summed is None:
            return False
        number = int(base.rsplit("-", 1)[1]) + 1 if base else 0
        attempt = f"{self.folder}/_attempt-{uuid.uuid4().hex}"
        summed.write.parquet(f"{attempt}/sums")
        self.spark.createDataFrame([(x,) for x in names], "name string").coalesce(1).write.parquet(f"{attempt}/batches")
        return self._place(attempt, f"{self.folder}/base-{number:09d}")

    def totals(self) -> DataFrame:
        summed, _ = self._sums()
        if summed is None:
            return self.spark.createDataFrame([], _TOTALS)
        return summed.where(" or ".join(f"{x} != 0" for x in SUMS))
