"""The registry: what counts as an organization, a state, a name, a region, a match."""

import json

import pytest
from pyspark.sql import functions as F

from claimgauge import fixed_values as fv
from claimgauge.config import LookupRequest
from claimgauge.operators import registry as R
from claimgauge.operators.report import address_line
from claimgauge.plans.region import region_counts, region_subset
from claimgauge.plans.request import lookup_request
from claimgauge.sources.name_index import NameIndex
from claimgauge.sources.registry import (
    normalize_registry,
    providers_from_answers,
    read_registry,
)

NAMES = [name for _, name in fv.REGISTRY_COLUMNS]
_number = iter(range(1_300_500_117, 2**40, 7_919_003))


def provider(**fields):
    """A row from the fields that its case is about; the others are empty."""
    row = {"npi": str(next(_number)), "entity_type": "1"} | fields
    return tuple(row.get(name, "") for name in NAMES)


CASES = {
    # names
    "full name": provider(last_name="Vasquez-Thorne", first_name="Ines", credential="PT", practice_state="OR"),
    "no credential": provider(last_name="Adeyemi", first_name="Bo", practice_state="OR"),
    "last name only": provider(last_name="Thornely", practice_state="ID"),
    "nothing": provider(practice_state="ID"),
    "organization": provider(entity_type="2", organization_name="Kelp & Thorn Dialysis", practice_state="OR",
                             address="9 Wharf", city="Astoria", postal_code="971030044", taxonomy="261QE0700X"),
    "organization, blanks": provider(entity_type=" 2 ", organization_name="  Dune Hospice ", practice_state="OR"),
    "organization with a person's name": provider(entity_type="2", organization_name="", last_name="Dune",
                                                  first_name="Al", practice_state="ID"),
    # states
    "lower case": provider(last_name="Quill", practice_state=" or ", mailing_state="ID"),
    "mailing only": provider(last_name="Quillan", practice_state="", mailing_state="id"),
    "blank is not empty": provider(last_name="Quilp", practice_state=" ", mailing_state="OR"),
    "no state": provider(last_name="Quince"),
    # regions
    "near": provider(last_name="Aster", practice_state="OR", postal_code="97110"),
    "near, blanks": provider(last_name="Aster", practice_state="or ", postal_code=" 97145-2 "),
    "other prefix": provider(last_name="Aster", practice_state="OR", postal_code="97301"),
    "other state": provider(last_name="Aster", practice_state="ID", postal_code="97110"),
    "gone": provider(last_name="Aster", practice_state="OR", postal_code="97110", deactivation_date="2021-05-06"),
    "gone, blank date": provider(last_name="Aster", practice_state="OR", postal_code="97110", deactivation_date="  "),
    "mailing near": provider(last_name="Aster", mailing_state="OR", postal_code="97110"),
    "no identifier": provider(npi="  ", last_name="Aster", practice_state="OR"),
}
ID = {case: row[0] for case, row in CASES.items()}


def ids(*cases):
    return sorted(ID[case] for case in cases)


def npis(frame):
    return sorted(row.npi for row in frame.collect())


@pytest.fixture(scope="module")
def file(spark, tmp_path_factory):
    """The cases as CSV under the published column names, with a column nobody asks for."""
    path = str(tmp_path_factory.mktemp("registry") / "providers.csv")
    columns = [raw for raw, _ in fv.REGISTRY_COLUMNS]
    wide = spark.createDataFrame([("x", *row) for row in CASES.values()], ["Other", *columns])
    wide.coalesce(1).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return path


@pytest.fixture(scope="module")
def registry(spark, file):
    return read_registry(spark, file).cache()


def test_registry_reads_only_what_it_uses(registry):
    assert registry.columns == NAMES
    assert npis(registry) == sorted(x for x in ID.values() if x.strip())


def test_organizations(registry):
    assert npis(R.organizations(registry)) == ids(
        "organization", "organization, blanks", "organization with a person's name")


@pytest.mark.parametrize("case, state", [
    ("full name", "OR"), ("lower case", "OR"), ("mailing only", "ID"), ("blank is not empty", ""), ("no state", ""),
])
def test_state_map(registry, case, state):
    assert {r.npi: r.state for r in R.state_map(registry).collect()}[ID[case]] == state
    assert (ID[case] in npis(R.providers_in_state(registry, " or "))) == (state == "OR")


def test_state_of_a_provider_listed_twice_without_positions(spark):
    twice = spark.createDataFrame(
        [("8", "", ""), ("8", "OR", "ID"), ("9", "ID", ""), ("9", "AK", "")],
        "npi string, practice_state string, mailing_state string",
    )
    assert {tuple(r) for r in R.state_map(twice).collect()} == {("8", "OR"), ("9", "ID")}


def test_names(registry):
    found = {r.npi: r.n for r in registry.select("npi", R.display_name(registry).alias("n")).collect()}
    assert {case: found[ID[case]] for case in list(CASES)[:7]} == {
        "full name": "Ines Vasquez-Thorne, PT", "no credential": "Bo Adeyemi", "last name only": "Thornely",
        "nothing": "", "organization": "Kelp & Thorn Dialysis", "organization, blanks": "Dune Hospice",
        "organization with a person's name": "",
    }


# (query, state, cases): names are searched as text in organizations and last names
SEARCHES = [
    ("thorn", None, ("full name", "last name only", "organization")),
    (" THORN ", "or", ("full name", "organization")),
    ("dune", None, ("organization, blanks", "organization with a person's name")),
    ("Ines", None, ()),  # first names are not searched
    ("thorn.", None, ()),
    ("th%n", None, ()),
    ("&", None, ("organization",)),
    ("z-", None, ("full name",)),
    ("qu", "OR", ("full name", "lower case")),  # no fallback to the mailing state here
    ("quil", " ", ("lower case", "mailing only", "blank is not empty")),
    ("thornelyx", None, ()),
    ("zzz", None, ()),
    (ID["organization"], None, ("organization",)),
    (f" {ID['organization']}", "ID", ()),
    ("1300500116", None, ()),
]


@pytest.mark.parametrize("query, state, cases", SEARCHES)
def test_search(registry, query, state, cases):
    assert npis(R.search(registry, query, state)) == ids(*cases)


def test_search_limit_and_columns(registry):
    found = R.search(registry, "", limit=3).collect()
    assert [r.npi for r in found] == sorted(x for x in ID.values() if x.strip())[:3]
    (row,) = R.search(registry, "kelp").collect()
    assert row.asDict() == {
        "npi": ID["organization"], "name": "Kelp & Thorn Dialysis", "address": "9 Wharf",
        "city": "Astoria", "state": "OR", "zip": "97103", "taxonomy": "261QE0700X",
    }
    assert R.search(registry, "quillan").first().state == "id"  # shown, with fallback


def test_search_state_falls_back_only_without_practice_states(spark):
    registry = normalize_registry(spark.createDataFrame(
        [("8", "Kelp", "OR")], "npi string, organization_name string, mailing_state string"
    ).selectExpr("*", "'2' as entity_type"))
    assert npis(R.search(registry, "kelp", "OR")) == ["8"]


# The index

@pytest.fixture(scope="module")
def index(spark, registry, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("names"))
    NameIndex.build(registry, folder)
    return NameIndex(spark, folder)


@pytest.mark.parametrize("query, state, cases", [*SEARCHES, ("h", None, ("full name", "last name only", "organization",
                                                                         "organization, blanks"))])
def test_index_finds_what_the_scan_finds(registry, index, query, state, cases):
    found = index.matches(query, state)
    assert npis(found) == ids(*cases)
    assert sorted(found.collect()) == sorted(R.matches(registry, query, state).collect())
    assert index.search(query, state, 2).collect() == R.search(registry, query, state, 2).collect()


def test_index_of_everything_and_of_nothing(spark, registry, index, tmp_path):
    assert sorted(index.matches(" ").collect()) == sorted(R.matches(registry, "").collect())
    empty = NameIndex.build(registry.limit(0), str(tmp_path))
    assert empty.matches("thorn").isEmpty() and empty.search("").isEmpty()


def test_index_reads_postings_of_one_folder_and_not_the_registry(index):
    found = index._candidates("thorn", None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "postings" in plan and "/rows" not in plan and ".csv" not in plan
    assert "PartitionFilters: [isnotnull(key_bucket" in plan and "EqualTo(gram," in plan


def test_lookup_requests(registry, index):
    request = LookupRequest("thorn", "OR")
    assert npis(lookup_request(registry, request)) == npis(lookup_request(index, request)) == ids(
        "full name", "organization")


# The order of the file

def test_positions_follow_the_files(spark, tmp_path):
    """Two files, read in splits of a few hundred bytes by many tasks."""
    header = "NPI,Entity Type Code,Provider Organization Name (Legal Business Name)," \
             "Provider Business Practice Location Address State Name\n"
    rows = [(f"{i * 7919 % 1000:010d}", f"Reef {i}", "OR" if i < 300 else "ID") for i in range(600)]
    for name, part in (("a.csv", rows[:350]), ("b.csv", rows[350:])):
        (tmp_path / name).write_text(header + "".join(f"{n},2,{x},{s}\n" for n, x, s in part))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        registry = read_registry(spark, str(tmp_path), positions=True)
        assert registry.rdd.getNumPartitions() > 8
        ordered = [r.organization_name for r in registry.repartition(5).orderBy("position").collect()]
        assert ordered == [x for _, x, _ in rows]
        last = {n: s for n, _, s in rows}
        assert {r.npi: r.state for r in R.state_map(registry).collect()} == last
        first = [n for n, x, _ in rows if "9" in x][:10]
        assert [r.npi for r in R.search(registry, "9").collect()] == first
        index = NameIndex.build(registry, str(tmp_path / "index"))
        assert [r.npi for r in index._candidates("9", None).orderBy("place", "row").limit(10).collect()] == first
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


# Rows as a dossier shows them, regions, labels

def test_provider_rows(registry):
    rows = R.provider_rows(registry)
    assert {r.npi: r for r in rows.collect()}[ID["full name"]].enumeration_type == "NPI-1"
    shown = rows.where(F.col("npi") == ID["organization"]).selectExpr("specialty", "struct(*) as p")
    line = shown.select("specialty", address_line(shown.p).alias("a")).first()
    assert tuple(line) == ("261QE0700X", "9 Wharf, Astoria, OR, 97103")


def test_region(registry, claims):
    near = ids("near", "near, blanks", "gone, blank date")
    assert npis(R.region_providers(registry, "or", ("971",))) == sorted([*near, ID["organization"]])
    billed = claims.limit(4).withColumn("npi", F.lit(ID["near"])).unionByName(claims)
    billed = billed.unionByName(claims.limit(2).withColumn("npi", F.lit(ID["gone"])))
    subset = region_subset(billed, registry, "OR", ("971",))
    assert tuple(region_counts(subset).first()) == (1, 4)


def test_service_answers(spark):
    def answer(**result):
        return json.dumps({"result_count": 1, "results": [result]})

    places = [
        {"address_purpose": "MAILING", "address_1": "Box 4"},
        {"address_purpose": "LOCATION", "address_1": "9 Wharf", "city": "Astoria", "state": "OR", "postal_code": "971030044"},
        {"address_purpose": "LOCATION", "address_1": "second"},
    ]
    kinds = [{"primary": False, "desc": "Clinic"}, {"primary": True, "desc": "Dialysis"}]
    payloads = [
        ("8", answer(enumeration_type="NPI-2", basic={"organization_name": "Kelp", "first_name": "x"},
                     addresses=places, taxonomies=kinds)),
        ("9", answer(basic={"first_name": "Bo", "middle_name": "", "last_name": "Adeyemi", "credential": "PT"})),
        ("none", json.dumps({"result_count": 0, "results": []})),
        ("broken", "{"),
        ("bare", answer(basic={})),
    ]
    frame = spark.createDataFrame(payloads, "npi string, payload string")
    rows = {r.npi: r.asDict() for r in providers_from_answers(frame).collect()}
    assert set(rows) == {"8", "9", "bare"}
    assert rows["8"] == {
        "npi": "8", "name": "Kelp", "specialty": "Dialysis", "address": "9 Wharf", "city": "Astoria",
        "state": "OR", "zip": "97103", "enumeration_type": "NPI-2",
    }
    assert rows["9"]["name"] == "Bo Adeyemi, PT" and rows["9"]["address"] == rows["bare"]["name"] == ""


def test_labels(spark):
    frame = spark.createDataFrame([("NPI-2",), ("NPI-1",)], "e string")
    assert [r.x for r in frame.select(R.enumeration_label(frame.e).alias("x")).collect()] == [
        "Organization", "Individual"
    ]
