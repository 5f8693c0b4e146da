"""Against brute force, with hot values."""

import random
import re
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimgauge.functions.order_statistics import RankIndex, global_rank, indexed, median
from claimgauge.sources.staging import Staging


def values(kind, n, seed):
    rng = random.Random(seed)
    if kind == "spread":
        return [rng.gauss(0, 100) for _ in range(n)]
    if kind == "hot":  # a third of all rows share one value
        return [7.5 if rng.random() < 1 / 3 else rng.uniform(0, 15) for _ in range(n)]
    return [float(rng.randint(0, 3)) for _ in range(n)]


def frame(spark, numbers):
    return spark.createDataFrame([(float(x),) for x in numbers], "x double").repartition(5)


@pytest.mark.parametrize("kind", ["spread", "hot", "few"])
@pytest.mark.parametrize("n", [1, 2, 3, 10, 101, 30_000])
def test_median(spark, kind, n):
    numbers = values(kind, n, n)
    (row,) = median(frame(spark, numbers), "x").collect()
    assert row.median == statistics.median(numbers)


def test_median_ignores_nulls(spark):
    with_null = spark.createDataFrame([(None,), (1.0,), (4.0,)], "x double")
    assert median(with_null, "x").collect()[0].median == 2.5
    assert median(with_null.where("x is null"), "x").collect()[0].median is None


@pytest.mark.parametrize("kind", ["spread", "hot", "few"])
@pytest.mark.parametrize("accuracy", [1, 20, 10_000])
@pytest.mark.parametrize("n", [1, 2, 101, 30_000])
def test_median_that_exists(spark, kind, accuracy, n):
    numbers = values(kind, n, n)
    (row,) = median(frame(spark, numbers), "x", exact=False, accuracy=accuracy).collect()
    assert row.median == statistics.median_low(numbers)


def test_median_that_exists_of_nothing(spark):
    nothing = spark.createDataFrame([(None,)], "x double")
    assert median(nothing, "x", exact=False).collect()[0].median is None


@pytest.fixture(scope="module")
def index(spark):
    """Twenty ranges of values, some of them hot."""
    numbers = values("hot", 5000, 9) + values("few", 500, 3)
    folder = f"{Staging(spark).folder}/index"
    RankIndex.build(frame(spark, numbers), "x", folder, ranges=20)
    opened = RankIndex.open(spark, folder)
    assert opened.fences.count() == 20
    return opened, numbers


def test_cumulative_counts(index):
    index, numbers = index
    rows = index.cumulative().collect()
    running, expected = 0, {}
    for value, weight in sorted(Counter(numbers).items()):
        running += weight
        expected[value] = running
    assert {r.value: r.up_to for r in rows} == expected
    assert {r.n for r in rows} == {5500}


def test_facts(index):
    index, numbers = index
    assert index.median().first().median == statistics.median(numbers)
    facts = index.facts.first()
    assert (facts.n, facts.mean, facts.spread) == (
        5500, pytest.approx(statistics.mean(numbers)), pytest.approx(statistics.stdev(numbers)))


@pytest.mark.parametrize("value", [-1.0, 0.0, 2.0, 7.5, 7.4999, 3.3, 14.9, 99.0])
def test_rows_up_to_a_value_are_read_from_its_range(index, value):
    index, numbers = index
    found = index.rows_up_to(value)
    row = found.first()
    assert (row.up_to, row.n) == (sum(x <= value for x in numbers), 5500)
    if value >= 0:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[isnotnull\(range#\d+\), \(range#\d+ = \d+\)\]", plan)


def test_index_of_nothing_and_of_one_value(spark):
    empty = indexed(frame(spark, [1]).limit(0), "x")
    assert empty.median().first().median is None and empty.cumulative().count() == 0
    assert tuple(empty.rows_up_to(3.0).first()) == (0, 0)
    one = indexed(frame(spark, [4, 4]), "x")
    assert (one.median().first().median, one.facts.first().spread) == (4.0, 0.0)


def test_global_rank(spark):
    rows = [(i % 3, str(i)) for i in range(2000)]
    data = spark.createDataFrame(rows, "score int, npi string").repartition(7)
    ranked = global_rank(data, [F.col("score").desc(), F.col("npi").asc()], "r", Staging(spark))
    expected = sorted(rows, key=lambda r: (-r[0], r[1]))
    got = [(r.score, r.npi) for r in sorted(ranked.collect(), key=lambda r: r["rank"])]
    assert got == expected
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 2001))
