"""Registered queries against their SQL, and what their plans must not contain."""

import functools
import math
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from claimgauge.sources.month_store import MONTHLY, PROCEDURE, MonthStore
from claimgauge.sources.staging import Staging
from workload import oracles, queries

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = queries.registered(), oracles.statements()

needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


@pytest.fixture(scope="module", autouse=True)
def one_scan():
    """Many queries differ in what they do with the same scan or stored tables; here they share them."""
    kept = {name: getattr(queries, name) for name in (
        "_scan", "_detection", "_dossiers", "_month_store", "_name_index", "_registry_twice")}
    for name, function in kept.items():
        setattr(queries, name, functools.cache(function))
    yield
    for name, function in kept.items():
        setattr(queries, name, function)


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    return str(value)


def test_every_query_has_sql_and_is_registered():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@needs_tables
@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    expected = duck.execute(SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(repr([plain(row[i]) for i in order]) for row in expected.fetchall())
    got = sorted(repr([plain(row[c]) for c in columns]) for row in found.collect())
    assert got == want


@needs_tables
@pytest.mark.parametrize("name", [
    "volume_flags", "revenue_flags_state", "consistency_flags", "upcoding_flags", "region_subset",
    "peer_comparisons", "procedure_monthly", "registry_json_provider", "scan",
])
def test_plans_stay_distributed(spark, name):
    """No pairwise joins and no Python, even where nothing is small enough to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search("CartesianProduct|NestedLoop|Python", plan)


@needs_tables
def test_entry(spark):
    assert entry.entry(spark).count() == 74


def _cut_tables(spark, folder, kept):
    """The tables in a folder, with the lines of the flagged provider cut to those for which `kept` holds."""
    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    own = read("orders").where(f"o_custkey = {queries.t.FLAGGED_PROVIDER}").select("o_orderkey")
    lines = read("lineitem")
    others = lines.join(own, lines.l_orderkey == own.o_orderkey, "left_anti")
    some = lines.join(own, lines.l_orderkey == own.o_orderkey, "left_semi").where(kept)
    for name in ("customer", "nation", "orders", "part"):
        read(name).write.parquet(f"{folder}/{name}.parquet")
    others.unionByName(some).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    connection = duckdb.connect()
    for name in ("customer", "nation", "orders", "part", "lineitem"):
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    return connection


@needs_tables
@pytest.mark.parametrize("kept", ["l_quantity < 3", "false"])  # claims but no flag; no claims
def test_profiles_of_a_provider_without_flags(spark, tmp_path, kept):
    connection = _cut_tables(spark, str(tmp_path), kept)
    for name in ("dossier_one_request", "dossier_from_store"):
        assert connection.execute(SQL[name]).fetchall() == []
        assert QUERIES[name](spark, str(tmp_path)).collect() == []


def _exchanges(frame):
    return re.findall(r"Exchange (\w+\([^)]*\))", frame._jdf.queryExecution().executedPlan().toString())


@needs_tables
def test_cells_travel_once_by_range_into_the_month_store(spark, tmp_path, monkeypatch):
    placed = {}
    write = MonthStore._overwrite

    def watched(self, name, frame, *key):
        placed[name] = _exchanges(frame)
        write(self, name, frame, *key)

    monkeypatch.setattr(MonthStore, "_overwrite", watched)
    MonthStore(spark, str(tmp_path)).put(queries.t.claims(spark, FOLDER), "all")
    for name in (MONTHLY, PROCEDURE):
        (only,) = placed[name]
        assert only.startswith("rangepartitioning(service_month")


@needs_tables
def test_scan_and_dossiers_shuffle_by_provider_alone(spark, monkeypatch):
    kept = []
    keep = Staging.keep

    def watched(self, frame, name):
        kept.append((name, _exchanges(frame)))
        return keep(self, frame, name)

    monkeypatch.setattr(Staging, "keep", watched)
    dossier = queries._dossiers.__wrapped__(spark, FOLDER)
    plans = kept + [("dossier", _exchanges(dossier))]
    for name, exchanges in plans:
        if name != "cells":
            assert not [e for e in exchanges if re.match(r"hashpartitioning\(npi#\d+, [a-z]", e)], name
    assert len(dict(kept)["history"]) == 1
