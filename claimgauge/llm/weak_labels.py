"""Document quality from a weak-label model and a hashed linear scorer.

Heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation estimates
the accuracy of each labeller for either kind from how often they agree, over all documents: what it
needs is the count of every pattern of votes, of which there are at most 3 ** labellers. A document's
weak label is the posterior of its pattern. A linear scorer over hashed features is then trained on
the posteriors of about ``SAMPLE`` documents, drawn with a fixed seed, and scores every document.

Edge cases: null text is empty and, like all texts without words, scored by its intercept and the
features of its length; a labeller that never votes keeps its prior; repeated rows count as often as
they come; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgauge.llm.bytehash import mix, packed, prefixes, span, word_spans, words

#: Labellers: statistic, bad below, good from, good up to, bad above. None: no such vote.
LABELLERS = (
    ("n_words", 20, 40, None, None),
    ("chars_per_word", 1.5, 3.0, 10.0, 14.0),
    ("upper_share", None, None, 0.15, 0.4),
    ("mark_share", None, None, 0.003, 0.02),
    ("marked_words", None, None, 0.02, 0.1),
    ("mark_runs", None, None, 0.01, 0.05),
    ("bare_words", None, None, 0.01, 0.05),
    ("digit_share", None, None, 0.05, 0.2),
    ("distinct_share", 0.25, 0.4, None, None),
    ("repeated_words", None, None, 0.02, 0.1),
    ("repeated_lines", None, None, 0.05, 0.3),
)
#: Documents that the scorer is trained on, about, and the size of its feature space.
SAMPLE = 8_000
BUCKETS = 1 << 16
ROUNDS = 100
EM_ROUNDS = 50
LEAST_SCORE = 0.5
#: What a labeller's accuracy may be. The thresholds are such that few good documents get a bad vote;
#: bad documents are of several kinds, and each kind is noticed by some labellers only.
ON_GOOD = (0.99, 0.9999)
ON_BAD = (0.3, 0.99)

_KIND = np.full(256, 97, np.uint8)  # shape of a byte: A, a, 0, or itself
_KIND[:128] = np.arange(128)
_KIND[65:91] = 65
_KIND[97:123] = 97
_KIND[48:58] = 48
_ALNUM = (np.arange(256) >= 128) | np.isin(_KIND, [48, 65, 97])
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "!|*#$%&<>~^"]] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags)]
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def _distinct(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    order = np.lexsort((values, row))
    r, v = row[order], values[order]
    new = np.r_[True, (r[1:] != r[:-1]) | (v[1:] != v[:-1])] if len(r) else np.zeros(0, bool)
    return np.bincount(r[new], minlength=rows).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The labellers' statistics of each text, and its words for the features."""
    rows = len(offsets) - 1
    begin, end, counts = word_spans(data, offsets)
    hashes, row = span(prefixes(data), begin, end), np.repeat(np.arange(rows), counts)
    n = counts.astype(float)
    space = np.isin(data, [9, 10, 11, 12, 13, 32])
    marks = _MARKS[data]
    runs = marks.copy()
    runs[:-1] &= data[1:] == data[:-1]
    runs[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False  # the next byte is another text's

    def share_of_words(flags: np.ndarray, none: bool = False) -> np.ndarray:
        """Words with a flagged byte, or with none."""
        total = np.r_[0, np.cumsum(flags)]
        met = (total[end] > total[begin]) != none
        return np.bincount(row[met], minlength=rows) / np.maximum(n, 1)

    chars = np.maximum(_sums(~space, offsets), 1)
    letters = _sums(~space & (data & 0xC0 != 0x80), offsets)  # characters, not bytes
    fours = mix(mix(mix(hashes[3:] * np.uint64(3) + hashes[2:-1]) + hashes[1:-2]) + hashes[:-3])
    four_row = row[3:][row[3:] == row[:-3]]
    fours = fours[row[3:] == row[:-3]]
    n_fours = np.maximum(np.bincount(four_row, minlength=rows), 1)
    ends = np.flatnonzero(data == 10)
    cuts = np.unique(np.r_[offsets, ends, ends + 1])
    lines, line_row = _lines(data, offsets, cuts)
    n_lines = np.maximum(np.bincount(line_row, minlength=rows), 1)
    return {
        "n_words": n,
        "chars_per_word": letters / np.maximum(n, 1),
        "upper_share": _sums((data >= 65) & (data <= 90), offsets) / chars,
        "mark_share": _sums(marks, offsets) / chars,
        "marked_words": share_of_words(marks),
        "mark_runs": share_of_words(runs),
        "bare_words": share_of_words(_ALNUM[data], none=True),
        "digit_share": _sums((data >= 48) & (data <= 57), offsets) / chars,
        "distinct_share": np.where(n > 0, _distinct(row, hashes, rows) / np.maximum(n, 1), 1.0),
        "repeated_words": 1 - (_distinct(four_row, fours, rows) + (np.bincount(four_row, minlength=rows) == 0)) / n_fours,
        "repeated_lines": 1 - (_distinct(line_row, lines, rows) + (np.bincount(line_row, minlength=rows) == 0)) / n_lines,
        "_words": (hashes, row),
    }


def _lines(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every line with a character besides its end."""
    begin, end = cuts[:-1], cuts[1:]
    full = (end > begin) & (data[np.minimum(begin, max(0, len(data) - 1))] != 10) if len(data) else np.zeros(len(begin), bool)
    begin, end = begin[full], end[full]
    return span(prefixes(data), begin, end), np.searchsorted(offsets, begin, "right") - 1


def votes(found: dict[str, np.ndarray]) -> np.ndarray:
    """For each text and labeller 1 (good), 0 (bad) or -1 (no vote)."""
    out = []
    for name, bad_below, good_from, good_to, bad_above in LABELLERS:
        x = found[name]
        good = (x >= (-np.inf if good_from is None else good_from)) & (x <= (np.inf if good_to is None else good_to))
        bad = (x < (-np.inf if bad_below is None else bad_below)) | (x > (np.inf if bad_above is None else bad_above))
        out.append(np.where(bad, 0, np.where(good, 1, -1)))
    return np.stack(out, 1).astype(np.int8) if out else np.empty((0, 0), np.int8)


def _pattern(votes_: np.ndarray) -> list[str]:
    letters = np.array(list("bg-"))
    return ["".join(v) for v in letters[votes_]]


def features(found: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight): the texts' words and word shapes, and the steps of their statistics."""
    rows = len(offsets) - 1
    hashes, row = found["_words"]
    shapes, shape_row, counts = words(_KIND[data], offsets)
    keys = [mix(hashes, 21), mix(shapes, 22)]
    of = [row, shape_row]
    per = np.concatenate([(1 / np.maximum(counts, 1))[r] for r in of])
    for k, (name, *_) in enumerate(LABELLERS):
        step = np.floor(np.log2(found[name] * 64 + 1) * 2).astype(np.uint64)
        keys.append(mix(step + np.uint64(1000 * (k + 1)), 23))
        of.append(np.arange(rows))
        per = np.r_[per, np.full(rows, 0.5)]
    bucket = (np.concatenate(keys) % np.uint64(BUCKETS)).astype(np.int64)
    both = np.concatenate(of) * BUCKETS + bucket
    cells, at = np.unique(both, return_inverse=True)
    return cells // BUCKETS, cells % BUCKETS, np.bincount(at, weights=per, minlength=len(cells))


def expectation_maximisation(patterns: list[str], counts: list[int], rounds: int = EM_ROUNDS
                             ) -> tuple[dict[str, float], np.ndarray]:
    """The posterior of good for each pattern, and each labeller's accuracy on bad and on good."""
    if not patterns:
        return {}, np.full((len(LABELLERS), 2), 0.8)
    v = np.array([["bg-".index(c) for c in p] for p in patterns])
    n = np.array(counts, float)
    good_vote, bad_vote = v == 1, v == 0
    accuracy, prior = np.full((v.shape[1], 2), 0.8), 0.8
    posterior = np.full(len(v), prior)
    for _ in range(rounds):
        on_good = np.log(prior) + (good_vote * np.log(accuracy[:, 1]) + bad_vote * np.log(1 - accuracy[:, 1])).sum(1)
        on_bad = np.log(1 - prior) + (bad_vote * np.log(accuracy[:, 0]) + good_vote * np.log(1 - accuracy[:, 0])).sum(1)
        posterior = 1 / (1 + np.exp(np.clip(on_bad - on_good, -500, 500)))
        good, bad = posterior * n, (1 - posterior) * n
        # Ten votes of the first accuracy keep a labeller without evidence where it began.
        accuracy[:, 1] = (good @ good_vote + 8) / (good @ (good_vote | bad_vote) + 10)
        accuracy[:, 0] = (bad @ bad_vote + 8) / (bad @ (good_vote | bad_vote) + 10)
        accuracy = np.clip(accuracy, [ON_BAD[0], ON_GOOD[0]], [ON_BAD[1], ON_GOOD[1]])
        prior = float(np.clip(good.sum() / n.sum(), 0.01, 0.99))
    return dict(zip(patterns, posterior.tolist(), strict=True)), accuracy


def _voted(texts: DataFrame) -> DataFrame:
    """Adds ``pattern``, the votes on each text."""
    names = texts.columns

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in packed(batch.column("text")):
                part = batch.slice(begin, end - begin)
                found = _pattern(votes(statistics(data, offsets)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], [*names, "pattern"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.mapInArrow(vote, f"{fields}, pattern string")


def fit(texts: DataFrame, posterior: dict[str, float], total: int, sample: int = SAMPLE) -> np.ndarray:
    """Weights of the scorer, the intercept last."""
    share = min(1.0, sample / max(1, total))
    chosen = texts.where(F.rand(8) < share)  # row by row, so copies do not come all together

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in packed(batch.column("text")):
                found = statistics(data, offsets)
                row, bucket, weight = features(found, data, offsets)
                split = np.searchsorted(row, np.arange(len(offsets)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([posterior[p] for p in _pattern(votes(found))], pa.float64()),
                     pa.ListArray.from_arrays(pa.array(split, pa.int32()), pa.array(bucket, pa.int32())),
                     pa.ListArray.from_arrays(pa.array(split, pa.int32()), pa.array(weight, pa.float32()))],
                    ["y", "bucket", "weight"])

    rows = chosen.select("text").mapInArrow(
        extract, "y double, bucket array<int>, weight array<float>").toArrow()
    w = np.zeros(BUCKETS + 1)
    if not rows.num_rows:
        return w
    y = rows.column("y").to_numpy()
    sizes = pc.list_value_length(rows.column("bucket")).to_numpy()
    row = np.repeat(np.arange(len(y)), sizes)
    bucket = pc.list_flatten(rows.column("bucket")).to_numpy()
    weight = pc.list_flatten(rows.column("weight")).to_numpy().astype(float)
    squares = np.full(BUCKETS + 1, 1e-8)
    for _ in range(ROUNDS):  # AdaGrad on the logistic loss with soft labels
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[bucket] * weight, minlength=len(y)) + w[-1], -30, 30)))
        error = (p - y) / len(y)
        gradient = np.r_[np.bincount(bucket, weights=error[row] * weight, minlength=BUCKETS), error.sum()]
        gradient[:-1] += 1e-6 * w[:-1]
        squares += gradient**2
        w -= 0.3 * gradient / np.sqrt(squares)
    return w


def scored(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, votes, weak_label (posterior of good), score (of the linear scorer) and kept."""
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    patterns = _voted(texts.select("text")).groupBy("pattern").agg(F.count("*").alias("n")).collect()
    posterior, _ = expectation_maximisation([r["pattern"] for r in patterns], [r["n"] for r in patterns])
    w = fit(texts, posterior, sum(r["n"] for r in patterns), sample)
    shared = texts.sparkSession.sparkContext.broadcast((posterior, w))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior, w = shared.value
        for batch in batches:
            for begin, end, data, offsets in packed(batch.column("text")):
                found = statistics(data, offsets)
                row, bucket, weight = features(found, data, offsets)
                z = np.bincount(row, weights=w[bucket] * weight, minlength=end - begin) + w[-1]
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                pattern = _pattern(votes(found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, end - begin), pa.array(pattern, pa.string()),
                     pa.array([posterior[x] for x in pattern], pa.float64()), pa.array(p), pa.array(p >= LEAST_SCORE)],
                    ["doc_id", "votes", "weak_label", "score", "kept"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(
        score, f"doc_id {kind}, votes string, weak_label double, score double, kept boolean")
