"""The provider registry: a wide CSV, or answers of the registry service as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgauge import fixed_values as fv
from claimgauge.functions.expressions import filled, or_blank, prefix
from claimgauge.schema import REGISTRY_ANSWER
from claimgauge.sources.claims import CSV


def read_registry(
    spark: SparkSession, path: str, multi_line: bool = False, positions: bool = False
) -> DataFrame:
    """The used columns of the extracted registry file, all text. Only they are parsed.

    With ``positions`` each row says where it stands: its file, the split of the file, and its number
    in the task that reads the split from its begin. So rows compare as they stand in the files, whatever
    task reads them; ``state_map`` and ``search`` then follow the order of the file.
    """
    frame = spark.read.options(**CSV, multiLine=multi_line).csv(path)
    if positions:
        place = F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("row"))
        frame = frame.select("*", place.alias("position"))
    return normalize_registry(frame)


def normalize_registry(frame: DataFrame) -> DataFrame:
    """Internal names for the columns present. Rows without an identifier go."""
    columns = []
    for raw, name in fv.REGISTRY_COLUMNS:
        source = raw if raw in frame.columns else name if name in frame.columns else None
        if source:
            columns.append(F.col(f"`{source}`").cast("string").alias(name))
    kept = ["position"] if "position" in frame.columns else []
    registry = frame.select(*columns, *kept)
    return registry.withColumn("npi", filled(F.col("npi"))).where(F.col("npi").isNotNull())


def providers_from_answers(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """Provider rows from service answers. Unknown providers and broken answers give no row."""
    parsed = answers.select("npi", F.from_json(payload, REGISTRY_ANSWER).alias("a"))
    known = parsed.where(F.coalesce(F.col("a.result_count"), F.lit(0)) > 0).select(
        "npi", F.get("a.results", F.lit(0)).alias("r")
    )
    basic = F.col("r.basic")
    parts = [F.nullif(basic[p], F.lit("")) for p in ("first_name", "middle_name", "last_name")]
    credential = F.concat(F.lit(", "), F.nullif(basic["credential"], F.lit("")))
    person = F.concat(F.concat_ws(" ", *parts), or_blank(credential))
    located = F.get(
        F.filter("r.addresses", lambda a: a["address_purpose"] == "LOCATION"), F.lit(0)
    )
    primary = F.get(F.filter("r.taxonomies", lambda t: t["primary"]), F.lit(0))
    return known.select(
        "npi",
        F.coalesce(basic["organization_name"], person).alias("name"),
        or_blank(primary["desc"]).alias("specialty"),
        or_blank(located["address_1"]).alias("address"),
        or_blank(located["city"]).alias("city"),
        or_blank(located["state"]).alias("state"),
        or_blank(prefix(located["postal_code"], 5)).alias("zip"),
        or_blank(F.col("r.enumeration_type")).alias("enumeration_type"),
    )
