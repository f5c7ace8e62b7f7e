"""Byte-level BPE encoding and decoding in linear time by backtracking.

Bytes are read as Latin-1 characters, so that one Aho-Corasick automaton over
all tokens finds the longest token at every place. An encoding is the one that
merging by rank gives if and only if each two adjacent tokens are: their bytes,
merged by rank, give the two tokens again. So the encoder takes the longest
token, checks it against its left neighbour (a memoised answer), tries shorter
prefixes, and steps back from places that proved to be dead ends; each place is
marked dead once at most. A piece that is a token as a whole is that token.

Defined results: a null text is the empty text and has no ids; null ids decode
to null; row ids are not looked at; repeated rows are encoded each; equal merges
are taken in order of rank, then from the left, as merging does; a very long
text is encoded whole, piece by piece, and a very long piece in memory of some
bytes a byte; an empty table gives an empty result; input columns named like an
output column are replaced by it, no other name clashes.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from readloom.llm.common import drop_names, numbered, quoted, release, small_batches

#: Bounds of what a worker remembers: pieces with their ids, and judged token pairs.
PIECES, PAIRS = 200_000, 250_000
#: Characters of text whose ids are sent on together.
CHUNK = 1_000_000


#: Texts of these characters are split by the expression behind, which finds there
#: what the tokenizers' usual pattern finds, at half its cost.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ¡¿]*")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\\s+(?!\\S)|\\s+")
_USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class BytePairCodec:
    """Encoder and decoder for a file of ranks (base64 token, rank a line)."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        self.find, self.usual = regex.compile(pattern).findall, pattern == _USUAL
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = [len(t) for t in self.tokens]
        self.auto = ahocorasick.Automaton()
        self.shorter = [-1] * size
        for token, rank in self.ranks.items():
            self.auto.add_word(token.decode("latin-1"), rank)
            for n in range(len(token) - 1, 0, -1):
                if (r := self.ranks.get(token[:n])) is not None:
                    self.shorter[rank] = r
                    break
        self.auto.make_automaton()
        self.memo: dict[str, bytes] = {}
        self.table = pa.array(self.tokens, pa.large_binary())
        self.pairs: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of some bytes by merging the pair of least rank, again and again."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        """Whether two tokens may stand next to each other."""
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return got

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        sizes, shorter, pairs, fits = self.sizes, self.shorter, self.pairs, self.fits
        n = len(data)
        longest = [-1] * n
        for end, token in self.auto.iter(data.decode("latin-1")):
            longest[end + 1 - sizes[token]] = token  # ends ascend, so the longest comes last
        out: list[int] = []
        dead: set[int] = set()
        at, token = 0, longest[0]
        while True:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + sizes[token]
                if end not in dead:
                    if last < 0:
                        break
                    ok = pairs.get(last << 32 | token)
                    if ok or ok is None and fits(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            elif out:
                dead.add(at)
                token = out.pop()
                at -= sizes[token]
                token = shorter[token]
            else:  # ranks that no chain of compatible tokens covers
                return self.merge(data)

    def packed(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers."""
        plain = self.usual and _PLAIN.fullmatch(text)
        pieces = _SPLIT.findall(text) if plain else self.find(text)
        memo = self.memo
        new = set(pieces).difference(memo)
        if new:
            if len(memo) + len(new) > PIECES:
                memo.clear()
                new = set(pieces)
            for p in new:
                memo[p] = array("i", self.piece(p.encode("utf-8"))).tobytes()
        return b"".join([memo[p] for p in pieces])

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without special tokens."""
        return array("i", self.packed(text or "")).tolist()

    def encode_all(self, texts: list[str]) -> pa.Array:
        """Lists of ids."""
        parts = [self.packed(t) for t in texts]
        ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
        ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))])
        return pa.ListArray.from_arrays(pa.array(ends), ids)

    def decode_all(self, lists: pa.Array) -> pa.Array:
        """Bytes of lists of ids: the taken tokens' bytes already stand in one row."""
        ids, counts = lists.flatten(), pa.compute.list_value_length(lists).fill_null(0).to_numpy()
        taken = self.table.take(ids)
        at = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1]
        ends = at[np.concatenate([[0], np.cumsum(counts)])] if len(ids) else np.zeros(len(lists) + 1, np.int64)
        mask = pa.compute.is_valid(lists).to_numpy(zero_copy_only=False)
        bits = pa.py_buffer(np.packbits(mask, bitorder="little").tobytes())
        data = taken.buffers()[2] if len(ids) else pa.py_buffer(b"")
        return pa.Array.from_buffers(pa.binary(), len(lists), [bits, pa.py_buffer(ends.astype(np.int32).tobytes()), data])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[tuple[str, str], BytePairCodec] = {}


def codec(path: str, pattern: str) -> BytePairCodec:
    """The codec of this process."""
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS[key] = BytePairCodec(path, pattern)
    return _CODECS[key]


def _chunks(weights: list[int], most: int):
    """Ranges of rows whose weights sum to about ``most``."""
    first = total = 0
    for i, w in enumerate(weights):
        total += w
        if total >= most:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(weights):
        yield first, len(weights)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` (columns ``carry``, all by default) with ``ids``."""
    small_batches(df.sparkSession)
    keep = drop_names(df.select(*map(quoted, df.columns if carry is None else carry)), ("ids",))
    rows, fields = numbered(df, keep, F.coalesce(F.col(text), F.lit("")))
    schema = StructType([*fields, StructField("ids", ArrayType(IntegerType(), False))])

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            t = batch.column(batch.num_columns - 1)
            for a, b in _chunks(pa.compute.binary_length(t).to_pylist(), CHUNK):
                ids = c.encode_all(t.slice(a, b - a).to_pylist())
                part = [x.slice(a, b - a) for x in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*part, ids], [*keep, "ids"])
        release()

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes of its ids."""
    keep = drop_names(df, ("decoded",))
    rows, fields = numbered(df, keep, F.col(ids))
    schema = StructType([*fields, StructField("decoded", BinaryType())])

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            for a, b in _chunks([4 * (n or 0) for n in pa.compute.list_value_length(lists).to_pylist()], CHUNK):
                part = [x.slice(a, b - a) for x in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*part, c.decode_all(lists.slice(a, b - a))], [*keep, "decoded"])

    return rows.mapInArrow(run, schema)
