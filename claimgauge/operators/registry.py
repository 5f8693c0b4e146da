"""Filters and lookups on the provider registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgauge import fixed_values as fv
from claimgauge.functions.expressions import filled, or_blank, prefix, state_code

_ENTITY_LABELS = {"1": "NPI-1", "2": "NPI-2"}


def organizations(registry: DataFrame) -> DataFrame:
    return registry.where(F.trim("entity_type") == "2").select("npi").distinct()


def state_map(registry: DataFrame) -> DataFrame:
    """Provider to state: practice state, or mailing state where the practice state is empty.

    Of a provider listed twice the later row counts, if the registry was read with positions. Else
    it keeps its highest state, so a filled state wins over a blank one.
    """
    practice = F.nullif(_present(registry, "practice_state"), F.lit(""))
    state = state_code(F.coalesce(practice, _present(registry, "mailing_state")))
    if "position" in registry.columns:
        rows = registry.select("npi", "position", state.alias("state"))
        return rows.groupBy("npi").agg(F.max_by("state", "position").alias("state"))
    return registry.select("npi", state.alias("state")).groupBy("npi").agg(
        F.max("state").alias("state")
    )


def providers_in_state(registry: DataFrame, state: str) -> DataFrame:
    return state_map(registry).where(F.col("state") == state.strip().upper()).select("npi")


def display_name(registry: DataFrame) -> Column:
    """Organizations by their name, persons as `first last, credential`."""
    names = [filled(_present(registry, name)) for name in ("first_name", "last_name")]
    credential = F.concat(F.lit(", "), filled(_present(registry, "credential")))
    person = F.concat(F.concat_ws(" ", *names), or_blank(credential))
    organization = or_blank(filled(_present(registry, "organization_name")))
    return F.when(F.trim("entity_type") == "2", organization).otherwise(person)


def search(
    registry: DataFrame, query: str, state: str | None = None, limit: int = fv.SEARCH_LIMIT
) -> DataFrame:
    """The first matches: in the order of the file, if the registry was read with positions, else by
    identifier. Ten digits look for that provider, all else for a name."""
    found = _matching(registry, query, state)
    if "position" in registry.columns:
        found = found.select("position", *_result_columns(registry)).orderBy("position").limit(limit)
        return found.drop("position")
    return found.select(*_result_columns(registry)).orderBy("npi").limit(limit)


def matches(registry: DataFrame, query: str, state: str | None = None) -> DataFrame:
    return _matching(registry, query, state).select(*_result_columns(registry))


def search_rows(registry: DataFrame) -> DataFrame:
    """Every row as a search shows it, with what a search compares: both names in lower case and the
    state; and its position, if there is one."""
    words = [F.lower(or_blank(_present(registry, name))) for name in ("organization_name", "last_name")]
    kept = ["position"] if "position" in registry.columns else []
    return registry.select(
        *_result_columns(registry), words[0].alias("organization_words"), words[1].alias("last_words"),
        _practice_state(registry).alias("practice"), *kept)


def asks_for_identifier(query: str) -> bool:
    return len(query) == 10 and query.isascii() and query.isdigit()


def _matching(registry: DataFrame, query: str, state: str | None) -> DataFrame:
    query = query.strip()
    found = registry.where(_asked_for(registry, query))
    if state is not None and state.strip():
        found = found.where(_practice_state(registry) == state.strip().upper())
    return found


def provider_rows(registry: DataFrame) -> DataFrame:
    """One row per provider as a dossier shows it."""
    entity = F.trim(_present(registry, "entity_type"))
    label = F.lit("")
    for code, name in _ENTITY_LABELS.items():
        label = F.when(entity == code, F.lit(name)).otherwise(label)
    rows = registry.select(
        *_result_columns(registry), label.alias("enumeration_type")
    ).withColumnRenamed("taxonomy", "specialty")
    columns = [c for c in rows.columns if c != "npi"]
    return rows.groupBy("npi").agg(F.max(F.struct(*columns)).alias("p")).select("npi", "p.*")


def enumeration_label(enumeration_type: Column) -> Column:
    return F.when(enumeration_type == "NPI-2", F.lit("Organization")).otherwise(
        F.lit("Individual")
    )


def region_providers(registry: DataFrame, state: str, zip_prefixes: tuple[str, ...]) -> DataFrame:
    """Active providers that practise in the state, under one of the three-digit zip prefixes."""
    return region_rows(registry, state, zip_prefixes).distinct()


def region_rows(registry: DataFrame, state: str, zip_prefixes: tuple[str, ...]) -> DataFrame:
    """The same, a provider as often as the registry lists it: enough for a semi-join, and a filter right
    over the registry's scan, of which Spark makes a runtime filter for the other side."""
    active = or_blank(F.trim("deactivation_date")) == ""
    in_state = state_code(F.col("practice_state")) == state.strip().upper()
    nearby = prefix(F.trim("postal_code"), 3).isin(*zip_prefixes)
    return registry.where(active & in_state & nearby).select("npi")


def _asked_for(registry: DataFrame, query: str) -> Column:
    if asks_for_identifier(query):
        return F.col("npi") == query
    wanted = query.lower()
    found = F.lit(False)
    for name in ("organization_name", "last_name"):
        found = found | F.lower(or_blank(_present(registry, name))).contains(wanted)
    return found


def _practice_state(registry: DataFrame) -> Column:
    """The practice state; the mailing state only in a registry that has no practice states."""
    name = "practice_state" if "practice_state" in registry.columns else "mailing_state"
    return state_code(_present(registry, name))


def _result_columns(registry: DataFrame) -> list[Column]:
    shown_state = F.coalesce(
        filled(_present(registry, "practice_state")), filled(_present(registry, "mailing_state"))
    )
    return [
        "npi",
        display_name(registry).alias("name"),
        or_blank(F.trim(_present(registry, "address"))).alias("address"),
        or_blank(F.trim(_present(registry, "city"))).alias("city"),
        or_blank(shown_state).alias("state"),
        or_blank(prefix(F.trim(_present(registry, "postal_code")), 5)).alias("zip"),
        or_blank(F.trim(_present(registry, "taxonomy"))).alias("taxonomy"),
    ]


def _present(registry: DataFrame, name: str) -> Column:
    return F.col(name) if name in registry.columns else F.lit(None).cast("string")

