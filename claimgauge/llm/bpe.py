"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every byte prefix of a piece exactly one token can be the last of its encoding. The encoder
stores it: ``last[j]`` is the token that ends the encoding of the first j bytes. A token t ending at j is that token if it stands alone, or if (last token of the prefix before t, t)
is a pair that BPE would leave as it is. Hence

* appending bytes only adds entries, and the result is exact,
* after an edit, the entries before it stay, and entries behind it are taken over as soon as the
  chain of last tokens has come together with the old one.

The ranks are those of a tiktoken file, whose pieces (the matches of a pattern) are encoded one by
one. Special tokens are never produced.

Edge cases: null text is the empty text with no tokens; repeated rows are encoded alike; an empty
table gives no rows. Extra columns are kept, unless they have the name of a result column, which
replaces them.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces and pairs that a worker remembers; the memory is emptied when it is full.
REMEMBERED = 500_000


class Vocabulary:
    """Tokens by rank, and which pairs of them BPE leaves as they are."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        #: Every ending of a token, and whether it is one: no token is longer than what is in here.
        self.endings = {t[i:]: t[i:] in ranks for t in ranks for i in range(len(t))}
        self.never = len(self.tokens)
        self.known: dict[tuple[bytes, bytes], bool] = {}
        self._edges: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        #: Whether every token's parts have lower ranks than it has, as in every trained vocabulary.
        self.in_order = all(
            len(t) == 1 or (len(h := self.merged(t, 2)) == 2 and max(map(ranks.get, h)) < r)
            for t, r in ranks.items()
        )

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def merged(self, piece: bytes, parts_left: int = 1) -> list[bytes]:
        """The definition of BPE: merge the neighbours of lowest rank, leftmost first."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > parts_left:
            best = min(range(len(parts) - 1),
                       key=lambda i: self.ranks.get(parts[i] + parts[i + 1], self.never))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The tokens that lie in turn at one end of ``token`` (0: its begin, 1: its end) while BPE
        makes it from bytes, each with the rank of the merge that takes it up."""
        key = (token, side)
        known = self._edges.get(key)
        if known is None:
            known, at = [(token, self.never)], token
            while len(at) > 1:
                halves = self.merged(at, 2)
                known.append((halves[-side], self.ranks[at]))
                at = halves[-side]
            known.reverse()
            self._edges[key] = known
        return known

    def stays(self, left: bytes, right: bytes) -> bool:
        """Whether BPE encodes ``left + right`` as these two tokens.

        Both tokens grow from bytes, the lower rank first; they stay apart if at no time the two
        that touch have a merge of a lower rank than the next merge of either.
        """
        pair = (left, right)
        if pair not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[pair] = (
                self._apart(self._edge(left, 1), self._edge(right, 0)) if self.in_order
                else self.merged(left + right) == [left, right]
            )
        return self.known[pair]

    def _apart(self, left: list[tuple[bytes, int]], right: list[tuple[bytes, int]]) -> bool:
        i = j = 0
        while True:
            (a, next_a), (b, next_b) = left[i], right[j]
            across = self.ranks.get(a + b, self.never)
            if across < next_a and across <= next_b:
                return False
            if next_a == next_b == self.never:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1


class PrefixEncoder:
    """Bytes of one piece with the last token of every prefix."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary = vocabulary
        self.bytes = b""
        self.last = [b""]
        self.append(piece)

    def append(self, more: bytes) -> None:
        endings, known, stays = self.vocabulary.endings, self.vocabulary.known, self.vocabulary.stays
        self.bytes = piece = self.bytes + more
        last = self.last
        for end in range(len(last), len(piece) + 1):
            for begin in range(end - 1, -1, -1):
                token = piece[begin:end]
                is_token = endings.get(token)
                if is_token is None:
                    raise ValueError(f"byte {begin} is no token")
                if is_token:
                    before = last[begin]
                    apart = known.get((before, token)) if before else True
                    if apart is None:
                        apart = stays(before, token)
                    if apart:
                        last.append(token)
                        break

    def replace(self, begin: int, end: int, by: bytes) -> int:
        """Puts ``by`` in the place of bytes begin to end. Returns how many prefixes were redone.

        A last token depends on the bytes it covers and on the last tokens before. Behind the edit,
        once as many prefixes in a row as two longest tokens have bytes got the last tokens they
        had, all later prefixes would too.
        """
        rest, old = self.bytes[end:], self.last[end + 1:]
        self.bytes = self.bytes[:begin]
        del self.last[begin + 1:]
        self.append(by)
        same, i = 0, 0
        while i < len(rest) and same <= 2 * self.vocabulary.longest:
            self.append(rest[i:i + 1])
            same = same + 1 if self.last[-1] == old[i] and len(old[i]) <= i + 1 else 0
            i += 1
        self.bytes += rest[i:]
        self.last += old[i:]
        return len(by) + i

    def ids(self) -> list[int]:
        """Follows the last tokens from the end of the piece to its beginning."""
        found, end = [], len(self.bytes)
        while end:
            token = self.last[end]
            found.append(self.vocabulary.ranks[token])
            end -= len(token)
        found.reverse()
        return found


class _Memory(dict):
    """Makes what it does not hold, and forgets everything when it is full."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> object:
        if len(self) >= REMEMBERED:
            self.clear()
        made = self[piece] = self.make(piece)
        return made


class Encoder:
    """Encodes texts; remembers the pieces it has met."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.pieces = regex.compile(pattern).findall
        self._packed = _Memory(lambda piece: struct.pack(f"<{len(ids := self._ids(piece))}I", *ids))
        self._counts = _Memory(lambda piece: len(self._ids(piece)))

    def _ids(self, piece: str) -> list[int]:
        raw = piece.encode()
        rank = self.vocabulary.ranks.get(raw)
        return [rank] if rank is not None else PrefixEncoder(self.vocabulary, raw).ids()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._packed.__getitem__, self.pieces(text)))

    def count(self, text: str) -> int:
        return sum(map(self._counts.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(Vocabulary.from_file(path), pattern)


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text",
                 ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the packed ids (little-endian unsigned 32-bit) and the bytes that they decode to."""
    kept = df.drop(ids, decoded)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.BinaryType()),
                           T.StructField(decoded, T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            for part in slices(batch):
                packed = [coder.encode(x or "") for x in part.column(text).to_pylist()]
                columns = [*part.columns, pa.array(packed, pa.binary()),
                           pa.array(map(coder.decode, packed), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, ids, decoded])

    return kept.mapInArrow(encode, schema)


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """A batch in parts of few rows, as each row's result may be as large as the text."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded bytes, made where the ids are."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column("text"):
                packed = coder.encode(text.as_py() or "")
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()),
                 pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    columns = documents.select("doc_id", "text")
    schema = T.StructType([
        columns.schema["doc_id"], T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])
    return columns.mapInArrow(digest, schema)

