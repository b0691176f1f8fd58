"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece of text there is exactly one token that can end the
prefix's encoding.  It is the token that ends there, stays whole when its own
bytes are encoded, and whose left neighbour (the last token of the prefix
before it) stays apart from it when the two are encoded together.  Walking back
through these last tokens gives the encoding.  As a prefix's last token does
not depend on what follows, text can be appended exactly, and after an edit
only the prefixes near it are worked out anew.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import documents, held, in_arrow

#: Entries that each of the two generations of a remembered table holds at most.
REMEMBERED = 200_000
#: Documents that a worker holds the ids of.
ROWS_AT_ONCE = 256
#: Longer pieces are encoded each time they occur.
LONG_PIECE = 64
#: The rank of what is no token.
NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Remembered:
    """A table of bounded size that keeps what was used lately: two generations, the older one goes when the newer one is full."""

    def __init__(self, work, most: int = REMEMBERED):
        self.work, self.most, self.new, self.old = work, most, {}, {}

    def __call__(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.work(key)
            if len(self.new) >= self.most:
                self.old, self.new = self.new, {}
            self.new[key] = found
        return found


class Vocabulary:
    """Ranks of byte strings, and what follows from them.

    ``ending`` has, for each byte string that occurs within a token, the
    longest token that ends it: its length, its id, and the same for the next
    shorter one.  Tokens that their own bytes do not give are left out.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        #: for each token the tokens at its end and at its beginning while it is put together, from the single byte to itself
        self.last_parts: dict[int, tuple[int, ...]] = {}
        self.first_parts: dict[int, tuple[int, ...]] = {}
        whole = set()
        for token, rank in sorted(ranks.items(), key=lambda x: len(x[0])):
            if len(token) == 1:
                self.last_parts[rank] = self.first_parts[rank] = (rank,)
            elif len(halves := self._put_together(token, 2)) == 2 and halves[0] in whole and halves[1] in whole:
                self.first_parts[rank] = (*self.first_parts[ranks[halves[0]]], rank)
                self.last_parts[rank] = (*self.last_parts[ranks[halves[1]]], rank)
            else:
                continue
            whole.add(token)
        self.ending: dict[bytes, tuple | None] = {b"": None}
        for end in sorted({token[k:m] for token in ranks for m in range(1, len(token) + 1) for k in range(m)}, key=len):
            shorter = self.ending[end[1:]]
            self.ending[end] = (len(end), ranks[end], shorter) if end in whole else shorter
        self.apart = Remembered(self._apart, REMEMBERED // 2)
        self.piece = Remembered(self._piece)

    def _put_together(self, data: bytes, least: int = 1) -> list[bytes]:
        """Join the neighbours of least rank, leftmost first, until none can be joined or ``least`` parts are left."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > least:
            rank, k = min(((self.ranks.get(parts[k] + parts[k + 1], NEVER), k) for k in range(len(parts) - 1)))
            if rank == NEVER:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition."""
        return [self.ranks[part] for part in self._put_together(data)]

    def _apart(self, pair: tuple[int, int]) -> bool:
        """Whether two tokens stay apart when they are encoded together.

        Both are put together side by side, in order of rank.  They stay apart
        unless, at some time, what then stands at the end of the one and at the
        beginning of the other joins before either goes on; of equal ranks the
        left one goes first.
        """
        ends, begins = self.last_parts[pair[0]], self.first_parts[pair[1]]
        bytes_of, rank_of = self.bytes_of, self.ranks.get
        i = j = 0
        while True:
            joint = rank_of(bytes_of[ends[i]] + bytes_of[begins[j]], NEVER)
            left = ends[i + 1] if i + 1 < len(ends) else NEVER
            right = begins[j + 1] if j + 1 < len(begins) else NEVER
            if joint < left and joint <= right and joint != NEVER:
                return False
            if left == right == NEVER:
                return True
            if left <= right:
                i += 1
            else:
                j += 1

    def last_tokens(self, data: bytes, last: list[int], stop: int | None = None) -> list[int]:
        """Extend ``last`` (the last tokens of the first prefixes of ``data``) up to ``stop`` bytes."""
        ending, known, apart = self.ending, self.apart.new.get, self.apart
        reach = self.longest
        for end in range(len(last) + 1, (len(data) if stop is None else stop) + 1):
            reach = min(reach + 1, end)
            while (tail := data[end - reach : end]) not in ending:
                reach -= 1
            fit = ending[tail]
            while fit:
                size, token, fit = fit
                if size == end:
                    break
                pair = (last[end - size - 1], token)
                fits = known(pair)
                if fits is None:
                    fits = apart(pair)
                    known = apart.new.get
                if fits:
                    break
            else:
                raise ValueError(f"the vocabulary has no token for byte {data[end - 1]}")
            last.append(token)
        return last

    def walk(self, last: list[int]) -> list[int]:
        ids, end = [], len(last)
        while end:
            ids.append(token := last[end - 1])
            end -= len(self.bytes_of[token])
        ids.reverse()
        return ids

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        return tuple(self.walk(self.last_tokens(data, [])))

    def encode(self, text: str, pattern: regex.Pattern) -> list[int]:
        """Encode each match of ``pattern`` by itself."""
        ids: list[int] = []
        known, extend, piece_ids = self.piece.new.get, ids.extend, self.piece
        for piece in pattern.findall(text):
            found = known(piece)
            if found is None:
                found = piece_ids(piece) if len(piece) <= LONG_PIECE else self._piece(piece)
                known = piece_ids.new.get
            extend(found)
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Prefixes:
    """One piece of text whose encoding follows appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, data
        self.last = vocabulary.last_tokens(data, [])

    def ids(self) -> list[int]:
        return self.vocabulary.walk(self.last)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.last_tokens(self.data, self.last)

    def replace(self, begin: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of the bytes from ``begin`` to ``end``; returns the number of prefixes worked out anew.

        Prefixes before the edit stay.  Behind it, a last token depends on the
        bytes and last tokens of one longest token's length: once so many in a
        row are as they were, all that follow are.
        """
        old, shift = self.last, len(new) - (end - begin)
        self.data = self.data[:begin] + new + self.data[end:]
        last, same, reach = old[:begin], 0, self.vocabulary.longest
        while len(last) < len(self.data):
            self.vocabulary.last_tokens(self.data, last, len(last) + 1)
            at = len(last)
            same = same + 1 if at > begin + len(new) and last[at - 1] == old[at - 1 - shift] else 0
            if same >= reach:
                self.last = last + old[at - shift :]
                return at - begin
        self.last = last
        return len(last) - begin


def _vocabulary(raw: bytes) -> Vocabulary:
    """The vocabulary of a rank file's content; a worker builds it once."""
    return held("bpe " + hashlib.sha256(raw).hexdigest(), lambda: Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}))


def _added(docs: DataFrame, new: list[T.StructField]) -> T.StructType:
    names = {f.name for f in new}
    return T.StructType([f for f in docs.schema.fields if f.name not in names] + new)


def encode_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, ids: bool = True, digests: bool = False) -> DataFrame:
    """The documents with ``n_tokens`` and the ids of their whole texts.

    ``path`` is a rank file; its content (of fixed size) is broadcast, so only
    the driver reads it.  With ``ids`` the column ``ids`` has the ids.  With
    ``digests`` the ids are decoded again where they are made, and there are
    ``ids_sha256`` and ``decoded_sha256``.

    A null text counts as empty: no ids, and the digests of nothing.  Every
    other column, null or not, stays as it is, except that ones named like a
    new column are replaced.  Rows are independent: repeated ones give repeated
    results, and an empty table gives an empty one.
    """
    raw = docs.sparkSession.sparkContext.broadcast(open(path, "rb").read())
    new = [T.StructField("n_tokens", T.LongType())]
    new += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []
    new += [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")] if digests else []
    schema = _added(docs, new)
    kept = schema.names[: -len(new)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, split = _vocabulary(raw.value), regex.compile(pattern)
        written = {token: str(token) for token in vocabulary.bytes_of}
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                found = [vocabulary.encode(text.as_py() or "", split) for text in part.column("text")]
                added = [pa.array([len(x) for x in found], pa.int64())]
                if ids:
                    added.append(pa.array([np.array(x, np.int32) for x in found], pa.list_(pa.int32())))
                if digests:
                    added.append(pa.array([hashlib.sha256(" ".join(map(written.__getitem__, x)).encode()).hexdigest() for x in found]))
                    added.append(pa.array([hashlib.sha256(vocabulary.decode(x)).hexdigest() for x in found]))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + added, schema.names)

    return docs.transform(in_arrow, encode, schema)


def decode_documents(docs: DataFrame, path: str) -> DataFrame:
    """The documents with ``decoded``, the bytes of the ids in ``ids`` (null ids: null)."""
    raw = docs.sparkSession.sparkContext.broadcast(open(path, "rb").read())
    schema = _added(docs, [T.StructField("decoded", T.BinaryType())])
    kept = [f.name for f in schema.fields][:-1]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(raw.value)
        for batch in batches:
            decoded = [None if ids is None else vocabulary.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(decoded, pa.binary())], [f.name for f in schema.fields])

    return docs.transform(in_arrow, decode, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), ids=False, digests=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
