"""Summaries that take a month at a time.

A delivery of claims holds whole months, new ones or old ones stated anew. ``put`` sums it and rewrites
the partitions of its months in both summaries, no others. A manifest lists what each delivery put
there, so a delivery counts once, however often it is put, and the sums of the tables can be checked.

A delivery is first entered as pending with its months and last in the manifest. If it fails in
between, its months may be half written: readers then refuse until the same delivery, or a later one of
all these months, is put again. One writer at a time.

``refresh`` derives from the summaries what a scan needs of all providers, in a folder named after
the manifest's last entry: totals by provider, the rank index of total paid, the revenue baseline.
With these a scan of one provider or one state, and one provider's peers, read nothing about others.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimgauge.config import ScanConfig
from claimgauge.functions.expressions import ratio
from claimgauge.functions.order_statistics import RankIndex
from claimgauge.operators import detectors as D
from claimgauge.operators import summaries as S
from claimgauge.schema import MONEY_SUM
from claimgauge.sources.keyed import bloom_filtered, read_key, read_keyed, write_keyed
from claimgauge.sources.staging import Staging

MONTHLY, PROCEDURE, SKETCHES = "provider_monthly", "provider_procedure", "month_sketches"
#: Sizes of the sketches: ranks are off by about 0.4 % and provider counts by 0.8 % (one standard error).
KLL_K, HLL_LOG_K = 800, 14
_MONTH = "service_month"
_MANIFEST = (
    "batch string, entry bigint, service_month date, monthly_rows bigint, procedure_rows bigint, "
    f"total_claims bigint, total_paid {MONEY_SUM.simpleString()}"
)
_SCHEMAS = {
    MONTHLY: f"npi string, total_claims bigint, total_paid {MONEY_SUM.simpleString()}, "
             f"beneficiaries bigint, {_MONTH} date",
    PROCEDURE: f"npi string, procedure_code string, total_claims bigint, "
               f"total_paid {MONEY_SUM.simpleString()}, {_MONTH} date",
    SKETCHES: f"rates binary, providers binary, {_MONTH} date",
}


def month_sketches(monthly: DataFrame) -> DataFrame:
    """One row for each month: its rows, and sketches of its providers and of their paid per claim. Built
    by partial aggregates, so what is shuffled is sketches."""
    rate = F.when(F.col("total_claims") > 0, ratio(F.col("total_paid"), F.col("total_claims")))
    return monthly.groupBy(_MONTH).agg(
        F.count(F.lit(1)).alias("monthly_rows"),
        F.kll_sketch_agg_double(rate, F.lit(KLL_K)).alias("rates"),
        F.hll_sketch_agg("npi", F.lit(HLL_LOG_K)).alias("providers"))


class UnfinishedDelivery(RuntimeError):
    """Months of a delivery may be half written."""


class MonthStore:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    # Deliveries

    def put(self, claims: DataFrame, batch: str, staging: Staging | None = None) -> bool:
        """Adds or restates the months of ``claims``. Whether the delivery was new.

        Claims without a month or a provider are in neither summary.
        """
        if not batch or "/" in batch:
            raise ValueError("a delivery's name must not be empty or hold a slash")
        if self._done(f"manifest/batch={batch}"):
            return False
        own = staging or Staging(self.spark)
        known = claims.where(F.col(_MONTH).isNotNull() & F.col("npi").isNotNull())
        cells = own.keep(S.claim_cells(known), "cells")
        if "beneficiaries" not in cells.columns:
            cells = cells.withColumn("beneficiaries", F.lit(0).cast("bigint"))
        self._save(cells.select(_MONTH).distinct(), f"pending/batch={batch}")
        # Ranges of months and providers: a month of a provider lies in one, so it is summed there.
        placed = cells.repartitionByRange(_MONTH, "npi")
        self._overwrite(MONTHLY, S.monthly_of_cells(placed))
        self._overwrite(PROCEDURE, S.procedure_of_cells(placed))
        # A row for each month, of which the calendar allows few.
        sums = cells.groupBy(_MONTH).agg(
            F.count("procedure_code").alias("procedure_rows"),
            F.sum("total_claims").alias("total_claims"), F.sum("total_paid").cast(MONEY_SUM).alias("total_paid"))
        sums = own.keep(sums, "sums")
        months = [row[0] for row in sums.select(_MONTH).collect()]
        written = self._read(MONTHLY, _SCHEMAS[MONTHLY]).where(F.col(_MONTH).isin(*months))
        rows = own.keep(month_sketches(written), "sketches")
        self._overwrite(SKETCHES, rows.repartitionByRange(_MONTH), ())
        for row in sums.where("procedure_rows = 0").select(_MONTH).collect():
            self._delete(f"{PROCEDURE}/{_MONTH}={row[0]}")  # nothing was written there
        entry = self._last_entry() + 1
        sums = sums.join(rows.select(_MONTH, "monthly_rows"), _MONTH)
        self._save(sums.select(F.lit(entry).cast("bigint").alias("entry"), _MONTH, "monthly_rows",
                               "procedure_rows", "total_claims", "total_paid"), f"manifest/batch={batch}")
        if staging is None:
            own.close()
        return True

    def _overwrite(self, name: str, frame: DataFrame, key: tuple[str, ...] = ("npi",)) -> None:
        """Replaces the months of ``frame``, which lies in ranges of month and key."""
        fields = [f.name for f in self._empty(name).schema]
        ordered = frame.select(*fields).sortWithinPartitions(_MONTH, *key)
        writer = ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        for column in key:
            writer = bloom_filtered(writer, column)
        writer.partitionBy(_MONTH).parquet(f"{self.folder}/{name}")

    # What is there

    def manifest(self) -> DataFrame:
        """What each delivery put, one row for each of its months."""
        return self._read("manifest", _MANIFEST)

    def months(self) -> DataFrame:
        """What the summaries hold: the last entry of each month."""
        latest = Window.partitionBy(_MONTH).orderBy(F.col("entry").desc())
        numbered = self.manifest().withColumn("_back", F.row_number().over(latest))
        return numbered.where("_back = 1").drop("_back")

    def monthly(self, months: Iterable[date] | None = None) -> DataFrame:
        return self._summary(MONTHLY, S.MONTHLY_KEY, months)

    def procedure(self, months: Iterable[date] | None = None) -> DataFrame:
        return self._summary(PROCEDURE, S.PROCEDURE_KEY, months)

    def estimates(self, months: Iterable[date] | None = None) -> DataFrame:
        """One row about a span of months, from one row of sketches for each: its months, the rows of the
        monthly summary with claims, about how many providers, and about the median of paid per claim
        and month and the median deviation from it."""
        merged = self._of_months(SKETCHES, months).agg(
            F.count(F.lit(1)).alias("months"), F.kll_merge_agg_double("rates", F.lit(KLL_K)).alias("_rates"),
            F.hll_sketch_estimate(F.hll_union_agg("providers")).alias("providers"))
        # Deviations of evenly spaced quantiles stand for those of all rates.
        steps = F.array(*[F.lit((i + 0.5) / 501) for i in range(501)])
        found = merged.select(
            "months", F.kll_sketch_get_n_double("_rates").alias("provider_months"), "providers",
            F.kll_sketch_get_quantile_double("_rates", steps).alias("_points"))
        middle = F.col("_points")[250]
        apart = F.array_sort(F.transform("_points", lambda x: F.abs(x - middle)))
        return found.select("months", "provider_months", "providers", middle.alias("median"), apart[250].alias("mad"))

    def _summary(self, name: str, key: tuple[str, ...], months: Iterable[date] | None) -> DataFrame:
        frame = self._of_months(name, months)
        return frame.select(*key, *[c for c in frame.columns if c not in key])

    def _of_months(self, name: str, months: Iterable[date] | None) -> DataFrame:
        """Only the folders of the months asked for are read."""
        unfinished = self._unfinished()
        if unfinished:
            raise UnfinishedDelivery(f"put again: {', '.join(unfinished)}")
        frame = self._read(name, _SCHEMAS[name])
        return frame if months is None else frame.where(F.col(_MONTH).isin(*months))

    def differences(self) -> DataFrame:
        """Months whose tables do not hold what the manifest says: none, unless files were changed."""
        held = self._read(MONTHLY, _SCHEMAS[MONTHLY]).groupBy(_MONTH).agg(
            F.count(F.lit(1)).alias("rows"), F.sum("total_claims").alias("claims"),
            F.sum("total_paid").cast(MONEY_SUM).alias("paid"))
        coded = self._read(PROCEDURE, _SCHEMAS[PROCEDURE]).groupBy(_MONTH).agg(F.count(F.lit(1)).alias("coded"))
        both = self.months().join(held, _MONTH, "full").join(coded, _MONTH, "left")
        same = (
            F.col("monthly_rows").eqNullSafe(F.col("rows")) & F.col("total_claims").eqNullSafe(F.col("claims"))
            & F.col("total_paid").eqNullSafe(F.col("paid"))
            & (F.col("procedure_rows") == F.coalesce("coded", F.lit(0))))
        return both.where(~F.coalesce(same, F.lit(False))).select(_MONTH)

    # What is derived from all months

    def refresh(self, config: ScanConfig, staging: Staging | None = None) -> bool:
        """Writes totals, rank index and baseline of the summaries as they are. Whether that was needed."""
        folder = self._derived()
        if self._done(f"{folder}/baseline"):
            return False
        own = staging or Staging(self.spark)
        where = f"{self.folder}/{folder}"
        write_keyed(S.provider_totals(self.monthly()), f"{where}/totals")
        totals = read_keyed(self.spark, f"{where}/totals")
        RankIndex.build(totals, "total_paid", f"{where}/rank_total_paid")
        baseline = D.revenue_baseline(S.qualifying(totals, config), config, own)
        self._save(baseline, f"{folder}/baseline")
        if staging is None:
            own.close()
        return True

    def totals(self) -> DataFrame:
        return read_keyed(self.spark, self._fresh("totals"))

    def provider_totals(self, npi: str) -> DataFrame:
        """One provider's row; one bucket of the totals is read."""
        return read_key(self.spark, self._fresh("totals"), npi)

    def rank_index(self) -> RankIndex:
        return RankIndex.open(self.spark, self._fresh("rank_total_paid"))

    def baseline(self) -> DataFrame:
        """The revenue baseline under the configuration it was refreshed with."""
        return self.spark.read.parquet(self._fresh("baseline"))

    def _derived(self) -> str:
        return f"derived/entry={self._last_entry()}"

    def _fresh(self, name: str) -> str:
        folder = self._derived()
        if not self._done(f"{folder}/baseline"):
            raise LookupError("the summaries have changed; call refresh first")
        return f"{self.folder}/{folder}/{name}"

    # Files

    def _unfinished(self) -> list[str]:
        """Pending deliveries whose months no later entry has covered."""
        done = {r.batch for r in self.manifest().select("batch").distinct().collect()}
        pending = self._read("pending", f"batch string, {_MONTH} date")
        open_ = pending.where(~F.col("batch").isin(*done)) if done else pending
        if open_.isEmpty():
            return []
        began = {r.batch: r.at for r in open_.groupBy("batch").agg(F.min("_metadata.file_modification_time").alias("at")).collect()}
        covered = self.manifest().groupBy(_MONTH).agg(F.max("_metadata.file_modification_time").alias("at"))
        still = open_.join(covered, _MONTH, "left").collect()
        return sorted({r.batch for r in still if r["at"] is None or r["at"] <= began[r.batch]})

    def _last_entry(self) -> int:
        return self.manifest().agg(F.max("entry")).first()[0] or 0

    def _empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], _SCHEMAS[name])

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _save(self, frame: DataFrame, name: str) -> None:
        """A small table; it counts once Spark has put its success mark there."""
        frame.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def _done(self, name: str) -> bool:
        return self._exists(f"{self.folder}/{name}/_SUCCESS")

    def _path(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _exists(self, path: str) -> bool:
        system, where = self._path(path)
        return system.exists(where)

    def _delete(self, name: str) -> None:
        system, where = self._path(f"{self.folder}/{name}")
        system.delete(where, True)
