"""Quality rules as a learned decision list, in DataFrame expressions only.

``with_statistics`` counts words, symbols, repeated lines and repeated 8-word windows of each text.
``learn`` covers the rejected documents among the labelled ones rule by rule: a rule grows by the
threshold with the best information gain, is pruned on documents that it did not grow on, and is
taken if it is precise there. All it reads is counts by feature and bin that Spark has summed up.
``DecisionList.verdict`` is the ordered conditional expression.

Edge cases: null text is empty and has no words; documents without words and with the base filter's
failures are not kept; without labels of both kinds there are no rules and the base filter alone
decides; labels for the same document are joined into the lowest; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgauge.llm.shared import SPACE_CHARS, SPACE_CLASS, discard, keep

#: Fixed values of the base filter.
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share",
            "upper_share", "mark_share", "digit_share", "distinct_share")
#: Where the values of either kind of document are cut to get candidate thresholds.
CUTS = [0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]
MOST_RULES = 16
MOST_CONDITIONS = 4
LEAST_PRECISION = 0.95
LEAST_COVERED = 3


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words covered by windows that are found twice or more.

    Hashes of 1, 2, 4 and 8 words are made from one another. Most texts repeat no window, and then
    the hashes need no sorting.
    """

    def pairs(hashes: Column, apart: int) -> Column:
        return _let(hashes, lambda h: F.zip_with(
            h, F.slice(h, apart + 1, F.size(h)), lambda a, b: F.xxhash64(a, b)))

    hashes = pairs(pairs(pairs(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)
    windows = F.slice(hashes, 1, F.greatest(F.size(words) - (REPEAT_WINDOW - 1), F.lit(0)))

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = _let(ordered, lambda s: F.filter(
            F.transform(s, lambda x, k: F.when(
                (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])),
            lambda i: i.isNotNull()))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
        return F.aggregate(F.array_sort(found), zero, lambda done, i: F.struct(
            (i + REPEAT_WINDOW).alias("end"),
            (done["total"] + REPEAT_WINDOW - F.greatest(F.lit(0), done["end"] - i)).alias("total"),
        ))["total"]

    return _let(windows, lambda w: F.when(
        F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))


def with_statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts, the features and base_failed; columns of these names are replaced."""
    own = F.coalesce(F.col(text), F.lit(""))
    length = F.length(own)
    words = F.filter(F.split(own, f"{SPACE_CLASS}+", -1), lambda w: w != "")
    lines = F.filter(F.split(own, "\n", -1), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    from_words = _let(words, lambda w: F.struct(
        F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), _repeat_words(w).alias("repeated")))
    from_lines = _let(lines, lambda x: F.struct(
        F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))
    df = documents.drop(*COUNTS, *FEATURES, "base_failed").withColumns({
        "__words": from_words,
        "__lines": from_lines,
        "word_chars": F.length(F.translate(own, SPACE_CHARS, "")).cast("long"),
        "n_symbols": (length - F.length(F.translate(own, SYMBOLS, ""))).cast("long"),
        "__upper": F.length(F.regexp_replace(own, "[^\\p{Lu}]+", "")),
        "__marks": length - F.length(F.translate(own, "!?|*#$%&<>=~^", "")),
        "__digits": length - F.length(F.translate(own, "0123456789", "")),
    })

    def share(part: Column, whole: Column) -> Column:
        return part.cast("double") / F.greatest(whole, F.lit(1))

    words, chars = F.col("__words.n"), F.col("word_chars")
    return df.withColumns({
        "n_words": words.cast("long"),
        "n_dup_lines": F.col("__lines.again").cast("long"),
        "n_repeat_words": F.col("__words.repeated").cast("long"),
        "chars_per_word": share(chars, words),
        "symbols_per_word": share(F.col("n_symbols"), words),
        "dup_line_share": share(F.col("__lines.again"), F.col("__lines.n")),
        "repeat_share": share(F.col("__words.repeated"), words),
        "upper_share": share(F.col("__upper"), chars),
        "mark_share": share(F.col("__marks"), chars),
        "digit_share": share(F.col("__digits"), chars),
        "distinct_share": share(F.col("__words.distinct"), words),
        "base_failed": (words < LEAST_WORDS) | (100 * F.col("__words.repeated") > MOST_REPEATED * words),
    }).drop("__words", "__lines", "__upper", "__marks", "__digits")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self) -> Column:
        column = F.col(self.feature).cast("double")
        return column >= self.threshold if self.at_least else column < self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Documents that meet all conditions of a rule are rejected."""

    rules: tuple[tuple[Condition, ...], ...]

    def verdict(self) -> Column:
        """Whether a document is kept: one conditional expression, rule after rule."""
        steps = F.when(F.col("base_failed"), False)
        for rule in self.rules:
            steps = steps.when(_all(rule), False)
        return steps.otherwise(True)


def _all(rule: tuple[Condition, ...]) -> Column:
    holds = F.lit(True)
    for condition in rule:
        holds = holds & condition.holds()
    return holds


def _gain(p: float, n: float, p_all: float, n_all: float) -> float:
    """FOIL's information gain of a condition that leaves p of p_all and n of n_all."""
    return p * (math.log2(p / (p + n)) - math.log2(p_all / (p_all + n_all))) if p else 0.0


class _Counts:
    """Sums over the labelled documents that no rule has covered yet."""

    def __init__(self, labelled: DataFrame, thresholds: dict[str, list[float]]):
        self.left, self.thresholds = labelled, thresholds

    def candidates(self, rule: tuple[Condition, ...]) -> list[tuple[float, Condition]]:
        """Every further condition with its gain, from one grouped sum."""
        bins = [
            F.struct(F.lit(name).alias("feature"), sum(
                (F.col(name).cast("double") >= t).cast("int") for t in cuts).alias("bin"))
            for name, cuts in self.thresholds.items() if cuts
        ]
        rows = (
            self.left.where(~F.col("held") & _all(rule))
            .select("bad", F.explode(F.array(*bins)).alias("b"))
            .groupBy("b.feature", "b.bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
            .collect()  # features x thresholds rows
        )
        found = []
        for name, cuts in self.thresholds.items():
            mine = sorted((r["bin"], r["p"], r["n"]) for r in rows if r["feature"] == name)
            p_all, n_all = sum(r[1] for r in mine), sum(r[2] for r in mine)
            for j, cut in enumerate(cuts):
                p, n = (sum(r[k] for r in mine if r[0] > j) for k in (1, 2))
                if p_all:
                    found.append((_gain(p, n, p_all, n_all), Condition(name, True, cut)))
                    found.append((_gain(p_all - p, n_all - n, p_all, n_all), Condition(name, False, cut)))
        return sorted(found, key=lambda x: (-x[0], x[1].feature, x[1].threshold, x[1].at_least))

    def of_prefixes(self, rule: tuple[Condition, ...]) -> list[tuple[int, int, int]]:
        """(held-out bad, held-out good, bad that it grew on) met by each beginning of the rule."""
        sums = []
        for k in range(1, len(rule) + 1):
            met = _all(rule[:k])
            sums += [F.sum(F.when(met & F.col("held"), F.col("bad")).otherwise(0)),
                     F.sum(F.when(met & F.col("held"), 1 - F.col("bad")).otherwise(0)),
                     F.sum(F.when(met & ~F.col("held"), F.col("bad")).otherwise(0))]
        row = [x or 0 for x in self.left.agg(*sums).first()]
        return [tuple(row[i:i + 3]) for i in range(0, len(row), 3)]

    def cover(self, rule: tuple[Condition, ...]) -> None:
        self.left = self.left.where(~_all(rule))


def learn(statistics: DataFrame, labels: DataFrame, features: tuple[str, ...] = FEATURES) -> DecisionList:
    """A decision list from statistics (doc_id, features, base_failed) and labels (doc_id, quality)."""
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").alias("__quality"))
    labelled = keep(
        statistics.where(~F.col("base_failed")).join(marked, "doc_id").select(
            *features, (F.col("__quality") == 0).cast("int").alias("bad"),
            (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held")),
        "rules-labelled",
    )
    cuts = labelled.groupBy("bad").agg(
        *[F.percentile_approx(F.col(f).cast("double"), CUTS, 1000).alias(f) for f in features]).collect()
    thresholds = {f: sorted({x for row in cuts for x in row[f] or []}) for f in features}
    counts, rules = _Counts(labelled, thresholds), []
    while len(cuts) == 2 and len(rules) < MOST_RULES:
        rule: tuple[Condition, ...] = ()
        while len(rule) < MOST_CONDITIONS:
            gains = counts.candidates(rule)
            if not gains or gains[0][0] <= 1e-9:
                break
            rule += (gains[0][1],)
        if not rule:
            break
        prefixes = counts.of_prefixes(rule)
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n, _ in prefixes]
        best = worth.index(max(worth))
        p, n, grown = prefixes[best]
        if p + grown < LEAST_COVERED or p + n == 0 or p / (p + n) < LEAST_PRECISION:
            break
        rule = rule[:best + 1]
        rules.append(rule)
        counts.cover(rule)
    return DecisionList(tuple(rules))


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept, for every document."""
    statistics = keep(
        with_statistics(documents.select("doc_id", "text")).drop("text"), "rules-statistics")
    rules = learn(statistics, labels)
    return statistics.select("doc_id", *COUNTS, "base_failed", rules.verdict().alias("kept"))


def only_kept(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep. The rules are learned on the labelled ones."""
    statistics = keep(
        with_statistics(documents.select("doc_id", "text")).drop("text"), "rules-statistics")  # no text meets the labels
    rules = learn(statistics, labels)
    discard(statistics)
    names = documents.columns
    stated = with_statistics(documents.select(F.struct(*names).alias("__row"), "text"))
    return stated.where(rules.verdict()).select("__row.*")
