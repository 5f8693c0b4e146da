"""Claims in: Parquet or CSV, raw or internal column names, one normalized frame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgauge import fixed_values as fv
from claimgauge.schema import CLAIMS

#: CSV as it is published: quotes inside quoted fields are doubled, a backslash is a backslash.
CSV = {"header": True, "quote": '"', "escape": '"'}

_RAW_OF = {name: raw for raw, name in fv.CLAIM_COLUMNS}


def read_raw(
    spark: SparkSession, path: str, fmt: str | None = None, multi_line: bool = False
) -> DataFrame:
    """The file as it is. CSV columns stay text and are taken by their header names.

    `multi_line` is for CSV with line breaks inside fields; such files cannot be split.
    """
    fmt = fmt or ("csv" if path.lower().endswith((".csv", ".csv.gz")) else "parquet")
    reader = spark.read.options(**CSV, multiLine=multi_line) if fmt == "csv" else spark.read
    return reader.format(fmt).load(path)


def normalize(frame: DataFrame) -> DataFrame:
    """Internal names and types for the columns that are present; rows without a provider go.

    Values that do not fit their type stop the job (ANSI casts) instead of turning into nulls.
    """
    columns = [
        _typed(frame, source, field.dataType).alias(field.name)
        for field in CLAIMS
        if (source := source_column(frame, field.name)) is not None
    ]
    return frame.select(*columns).where(F.col("npi").isNotNull())


def load_claims(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    return normalize(read_raw(spark, path, fmt))


def load_provider_claims(
    spark: SparkSession, path: str, npi: str, fmt: str | None = None
) -> DataFrame:
    return provider_claims(read_raw(spark, path, fmt), npi)


def provider_claims(raw: DataFrame, npi: str) -> DataFrame:
    """One provider's claims. The literal takes the column's type, so the filter reaches the scan."""
    source = source_column(raw, "npi")
    numeric = isinstance(raw.schema[source].dataType, T.NumericType)
    return normalize(raw.where(F.col(source) == F.lit(int(npi) if numeric else npi)))


def providers(claims: DataFrame) -> DataFrame:
    return claims.select("npi").distinct()


def source_column(frame: DataFrame, name: str) -> str | None:
    """The column that holds `name`: under its raw name, under its own name, or not at all."""
    return next((c for c in (_RAW_OF[name], name) if c in frame.columns), None)


def _typed(frame: DataFrame, source: str, wanted: T.DataType) -> Column:
    column = F.col(f"`{source}`")
    have = frame.schema[source].dataType
    if have == wanted:
        return column
    if isinstance(wanted, T.StringType) and isinstance(have, (T.FloatType, T.DoubleType)):
        column = column.cast("bigint")  # an identifier read as 1.0E9 is still a whole number
    if isinstance(have, T.StringType):
        column = F.nullif(F.trim(column), F.lit(""))
        if isinstance(wanted, T.IntegralType):
            return _whole(column, wanted)
    return column.cast(wanted)


def _whole(text: Column, wanted: T.DataType) -> Column:
    """A whole number, also one written as `2.0`. Anything else stops the job."""
    value = text.cast("decimal(38,6)")
    broken = F.raise_error(F.concat(F.lit("not a whole number: "), text)).cast(wanted)
    return F.when((value == F.floor(value)) | value.isNull(), value.cast(wanted)).otherwise(broken)
