"""An index for the name search of the registry: lookups read postings, not the registry.

Every position of an organization's name or a last name, in lower case, begins a gram of up to three
characters. A posting holds the gram, the name and the row it belongs to, so a candidate is verified
on the spot, and the rarest gram of a query is enough: the result is that of the scan. A query of one or
two characters asks for the grams that begin with it.

``rows`` are the registry's rows as a search shows them, keyed by provider. ``postings`` are dealt by
the first character of the gram and sorted by gram; a common gram spans several files. ``grams`` counts
the postings of each gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgauge import fixed_values as fv
from claimgauge.operators.registry import asks_for_identifier, search_rows
from claimgauge.sources.keyed import bucket_of, open_keyed, read_key, read_keyed, read_keys, write_keyed
from claimgauge.sources.staging import Staging

GRAM = 3
_SHOWN = ("npi", "name", "address", "city", "state", "zip", "taxonomy")


class NameIndex:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def build(cls, registry: DataFrame, folder: str, staging: Staging | None = None) -> NameIndex:
        """``registry`` is normalized; with positions, first matches come in the order of the file."""
        index = cls(registry.sparkSession, folder)
        own = staging or Staging(index.spark)
        shown = search_rows(registry)
        order = F.col("position") if "position" in shown.columns else F.col("npi")
        rows = own.keep(shown.withColumns({"place": order, "row": F.monotonically_increasing_id()}), "rows")
        write_keyed(rows.drop("position", "organization_words", "last_words"), f"{index.folder}/rows")
        grams = F.transform(F.sequence(F.lit(1), F.length("words")), lambda i: F.substring(F.col("words"), i, F.lit(GRAM)))
        postings = rows.select(
            "npi", "row", "place", "practice", F.explode(F.array("organization_words", "last_words")).alias("words"),
        ).where("words != ''").select("*", F.explode(F.array_distinct(grams)).alias("gram"))
        write_keyed(postings, f"{index.folder}/postings", "gram", ("npi",), by=F.substring("gram", 1, 1))
        counts = read_keyed(index.spark, f"{index.folder}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        write_keyed(counts, f"{index.folder}/grams", "gram", by=F.substring("gram", 1, 1))
        if staging is None:
            own.close()
        return index

    def matches(self, query: str, state: str | None = None) -> DataFrame:
        """All rows that match, as the scan gives them."""
        return self._rows(self._candidates(query, state)).select(*_SHOWN)

    def search(self, query: str, state: str | None = None, limit: int = fv.SEARCH_LIMIT) -> DataFrame:
        """The first matches, in the order of the file where the index has it, else by identifier."""
        first = self._candidates(query, state).orderBy("place", "row").limit(limit)
        return self._rows(first).orderBy("place", "row").select(*_SHOWN)

    def _rows(self, found: DataFrame) -> DataFrame:
        """The rows of the candidates; few candidates read few folders."""
        return read_keys(found, f"{self.folder}/rows", ("npi", "row"))

    def _candidates(self, query: str, state: str | None) -> DataFrame:
        """npi, row and place of the rows that match."""
        query = query.strip()
        wanted = query.lower()
        if asks_for_identifier(query):
            found = read_key(self.spark, f"{self.folder}/rows", query)
        elif not wanted:
            found = read_keyed(self.spark, f"{self.folder}/rows")
        else:
            found = self._postings(wanted)
        if state is not None and state.strip():
            found = found.where(F.col("practice") == state.strip().upper())
        return found.select("npi", "row", "place").distinct()

    def _postings(self, wanted: str) -> DataFrame:
        gram = wanted if len(wanted) < GRAM else self._rarest({wanted[i:i + GRAM] for i in range(len(wanted) - GRAM + 1)})
        if gram is None:
            return self._of_first(open_keyed(self.spark, f"{self.folder}/postings"), wanted).where(F.lit(False))
        postings = self._of_first(open_keyed(self.spark, f"{self.folder}/postings"), gram)
        if len(wanted) < GRAM:
            return postings.where(F.col("gram").startswith(wanted))
        return postings.where((F.col("gram") == gram) & F.col("words").contains(wanted))

    def _rarest(self, grams: set[str]) -> str | None:
        """The gram with the fewest postings; None if one has none, as then nothing matches."""
        counts = open_keyed(self.spark, f"{self.folder}/grams")
        buckets = [bucket_of(F.lit(g[0])) for g in grams]
        found = counts.where(F.col("key_bucket").isin(*buckets) & F.col("gram").isin(*grams)).select("gram", "n").collect()
        return min(found, key=lambda r: (r.n, r.gram)).gram if len(found) == len(grams) else None

    def _of_first(self, postings: DataFrame, gram: str) -> DataFrame:
        first: Column = bucket_of(F.lit(gram[0]))
        return postings.where(F.col("key_bucket") == first)
