"""Token ids in compressed blocks: an adaptive context-mixing range coder.

Ids are cut into blocks of ``BLOCK``. Each block starts from the same state, has
a checksum of its ids, and can be read without the others. In a block, two
tables remember which id followed the last two ids (order 2) and the last one
(order 1), with a confidence. An id is one symbol of the range coder: the order-2
prediction, the order-1 prediction, or an id by order 0. The odds of the three are
adaptive counts in the context of both predictions' confidences. Order 0 is by
counts in the segment: ids are ranked by how often they stand there, ranks are cut
into classes (frequent ids are a class each, see ``CLASSES``), a class has its
share and its few lower bits are plain. The segment's head has the frequent ids and
the counts of classes, so that order 0 covers whole ids from the first one on.
All arithmetic is on integers, so that every machine reads what another wrote.

Blocks are independent, so numpy codes all blocks of a segment in lockstep: step
``t`` codes the t-th id of every block.

A file is a Parquet table of segments; a segment is a self-contained binary
value (see ``pack``) of whole documents in ascending order of id. Segments are
written and read by Spark, so any store will do, and a lost task is repeated.

Special tokens that stand in a text as such become their ids, as the library has
it by default; none are added but the end id.

Defined results: a null text is empty and has the end id only; rows with a null
id stand first; rows of equal id, null or not, are documents of their own in
order of a hash of their texts, equal rows in any; a very long text is in a
segment of its own, coded in memory of about 60 bytes an id; a tokenizer with
ids of more than 16 bits is refused; an empty table gives an empty file; columns
beside id and text are not stored, so none can clash.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F, Window as W

from readloom.llm.common import release, small_batches

#: Ids in a block, and about how many in a segment.
BLOCK, SEGMENT = 1024, 1 << 22
#: Slots of a prediction table, as a power of two; words a worker remembers.
TABLE_BITS, CACHE = 10, 500_000
#: Classes of ranks: so many classes of ids with so many plain bits, most frequent ids first.
CLASSES = ((64, 0), (8, 1), (8, 2), (8, 3), (8, 4), (8, 5), (8, 6), (4, 7), (4, 8), (4, 9), (4, 10), (28, 11))
#: What the counts of classes in a segment's head sum to.
TOTAL = 1 << 14
#: What a sight adds to the count of a way, and contexts of ways.
GAIN, CONTEXTS = 4, 64
#: Factors that spread the last id and the one before over the slots.
_SPREAD, _TOP = (np.uint32(2654435761), np.uint32(2246822519)), np.uint32(32 - TABLE_BITS)
MAGIC = b"RLIDS3\0\0"

_BITS = np.repeat([b for _, b in CLASSES], [n for n, _ in CLASSES])
UPPER, _LOW = len(_BITS), np.concatenate([[0], np.cumsum(1 << _BITS)])
_CLASS = np.repeat(np.arange(UPPER), 1 << _BITS)
#: Ranks below have fewer plain bits than the last classes: so many ids are listed at most.
LISTED = int(_LOW[UPPER - CLASSES[-1][0]])
_U = np.uint64
_SCALE, _SHIFT = int(_BITS.max()), _U(14 + _BITS.max())
_BOT, _WORD, _HEAD = _U(1 << 48), _U(16), _U(48)
_SEEN, _LESS = np.array([GAIN, GAIN << 16, GAIN << 32], np.uint64), _U(0xFFFF)
#: Confidence after a wrong and after a right prediction.
_NEXT = np.array([1, 1, 1, 1, 2, 2, 3, 3, 1, 2, 3, 4, 5, 6, 7, 7], np.uint32)


class _Model:
    """Adaptive state of ``n`` blocks side by side: predictions, eight times the id plus the confidence; counts of ways, 16 bits each."""

    def __init__(self, n: int):
        self.lane = np.arange(n, dtype=np.int64)
        self.base, self.own = self.lane << TABLE_BITS, self.lane * CONTEXTS
        self.table = [np.full(n << TABLE_BITS, 1 << 19, np.uint32) for _ in range(2)]  # 65,536 is no id
        self.ways = np.full(n * CONTEXTS, 0x200020002, np.uint64)
        self.before = np.zeros(n, np.uint32), np.full(n, 7, np.uint32)

    def predict(self, m: int):
        """Slots, entries, ids and confidences of both orders, and counts of the ways, of the first ``m`` blocks."""
        a, b = self.before
        slots = self.base[:m] + ((a[:m] + b[:m]) >> _TOP), self.base[:m] + (a[:m] >> _TOP)
        e2, e1 = self.table[0].take(slots[0]), self.table[1].take(slots[1])
        c2, c1 = e2 & 7, e1 & 7
        v2, v1 = e2 >> 3, e1 >> 3
        at = self.own[:m] + ((c2 << 3) + (np.minimum(c1, 3) << 1) + (v2 == v1))
        return slots, (e2, e1), (v2, v1), (c2, c1), at, self.ways.take(at)

    def learn(self, x, way, slots, entries, right, sure, at, odds) -> None:
        self.ways[at] = odds + _SEEN.take(way)
        ids8 = x << 3
        for table, slot, e, ok, c in zip(self.table, slots, entries, right, sure):
            table[slot] = np.where(ok | (c > 1), e - c, ids8) + _NEXT.take(c + (ok.view(np.uint8) << 3))
        self.before = x * _SPREAD[0], self.before[0][: len(x)] * _SPREAD[1]


class _Writer:
    """Range coders side by side. A carry is added to the word before, and carried on at the end.

    Words are kept in the order they come in, each with its coder, and sorted at the end.
    """

    def __init__(self, n: int, longest: int):
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, ~_U(0))
        self.words, self.owner = (np.zeros(n * (longest // 2 + 8), kind) for kind in (np.uint32, np.int32))
        self.last, self.n = np.zeros(n, np.int64), 0

    def log(self, k, low) -> None:
        end = self.n + len(k)
        if end > len(self.words):
            self.words, self.owner = (np.concatenate([x, np.zeros(end, x.dtype)]) for x in (self.words, self.owner))
        self.words[self.n : end] = low >> _HEAD
        self.owner[self.n : end] = k
        self.last[k] = np.arange(self.n, end)
        self.n = end

    def put(self, m: int, start, size, total) -> None:
        low, rng = self.low[:m], self.range[:m]
        rng //= total
        start *= rng
        low += start
        rng *= size
        over = np.flatnonzero(low < start)
        if len(over):
            self.words[self.last[over]] += np.uint32(1)
        while len(k := np.flatnonzero(rng < _BOT)):
            x = low[k]
            self.log(k, x)
            low[k] = x << _WORD
            rng[k] <<= _WORD

    def finish(self) -> list[bytes]:
        every = np.arange(len(self.low))
        for _ in range(4):
            self.log(every, self.low)
            self.low <<= _WORD
        owner = self.owner[: self.n]
        out = self.words[: self.n][np.argsort(owner, kind="stable")]
        while len(k := np.flatnonzero(out >> 16)):
            out[k] &= 0xFFFF
            out[k - 1] += np.uint32(1)
        ends = np.cumsum(np.bincount(owner, minlength=len(every))).tolist()
        out = out.astype("<u2")
        return [out[a:b].tobytes() for a, b in zip([0, *ends], ends)]


class _Reader:
    """Range decoders side by side; ``code`` is counted from the lower end of the range."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        self.words = np.concatenate([words, np.zeros(8, np.uint16)])
        self.range, self.at = np.full(len(starts), ~_U(0)), starts + 4
        self.code = np.zeros(len(starts), np.uint64)
        for i in range(4):
            self.code = self.code << _WORD | self.words.take(starts + i, mode="clip")

    def peek(self, m: int, total):
        rng = self.range[:m]
        rng //= total
        return np.minimum(self.code[:m] // rng, total - _U(1))

    def take(self, m: int, start, size) -> None:
        code, rng, at = self.code[:m], self.range[:m], self.at[:m]
        start *= rng
        code -= start
        rng *= size
        while len(k := np.flatnonzero(rng < _BOT)):
            of = at[k]
            code[k] = code[k] << _WORD | self.words.take(of, mode="clip")
            at[k] = of + 1
            rng[k] <<= _WORD


def _shares(prior: np.ndarray):
    """Of each class where it starts, out of ``1 << _SHIFT``, and what one of its ids has; its class for each value of ``TOTAL``."""
    prior = prior.astype(np.int64)
    return ((np.cumsum(prior) - prior) << _SCALE).astype(np.uint64), (prior << (_SCALE - _BITS)).astype(np.uint64), np.repeat(np.arange(UPPER), prior)


def encode_blocks(ids: np.ndarray, prior: np.ndarray) -> list[bytes]:
    """Code of each block of ``BLOCK`` ranks (all below 65,536); ``prior``: counts of classes, ``TOTAL`` in all."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return []
    grid = np.zeros(n * BLOCK, np.uint32)
    grid[: len(ids)] = ids
    longest = min(BLOCK, len(ids))
    steps = np.ascontiguousarray(grid.reshape(n, BLOCK).T)
    tail = len(ids) - (n - 1) * BLOCK
    base, own, _ = _shares(prior)
    plain = np.arange(len(_CLASS)) - _LOW[_CLASS]
    below, size_of = (base[_CLASS] + plain.astype(np.uint64) * own[_CLASS])[: 1 << 16], own[_CLASS][: 1 << 16]
    model, out = _Model(n), _Writer(n, longest)
    for t in range(longest):
        m = n if t < tail else n - 1
        x = steps[t, :m]
        slots, entries, guess, sure, at, odds = model.predict(m)
        right = guess[0] == x, guess[1] == x
        way = np.where(right[0], 0, 2 - right[1])
        n0, n1, n2 = odds & _LESS, odds >> _WORD & _LESS, odds >> _U(32)
        ab = n0 + n1
        start, size = np.where(right[0], _U(0), n0) << _SHIFT, np.where(right[0], n0, n1) << _SHIFT
        rest = np.flatnonzero(way == 2)
        start[rest] = (ab[rest] << _SHIFT) + n2[rest] * below.take(x[rest])
        size[rest] = n2[rest] * size_of.take(x[rest])
        out.put(m, start, size, (ab + n2) << _SHIFT)
        model.learn(x, way, slots, entries, right, sure, at, odds)
    return out.finish()


def decode_blocks(data: np.ndarray, starts: np.ndarray, n_ids: int, prior: np.ndarray) -> np.ndarray:
    """Ranks of blocks whose codes start at ``starts`` in 16-bit words."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64)
    longest = min(BLOCK, n_ids)
    steps = np.zeros((BLOCK, n), np.uint32)
    tail = n_ids - (n - 1) * BLOCK
    base, own, class_of = _shares(prior)
    first = _LOW[:-1].astype(np.uint64)
    model, src = _Model(n), _Reader(data, starts)
    for t in range(longest):
        m = n if t < tail else n - 1
        slots, entries, guess, sure, at, odds = model.predict(m)
        n0 = (odds & _LESS) << _SHIFT
        n1 = (odds >> _WORD & _LESS) << _SHIFT
        n2 = odds >> _U(32)
        ab = n0 + n1
        goal = src.peek(m, ab + (n2 << _SHIFT))
        after, late = goal >= n0, goal >= ab
        way = after.view(np.uint8) + late.view(np.uint8)
        start, size = np.where(after, n0, _U(0)), np.where(after, n1, n0)
        x = np.where(after, guess[1], guess[0])
        rest = np.flatnonzero(late)
        if len(rest):
            by, low = n2[rest], ab[rest]
            z = (goal[rest] - low) // by
            c = class_of.take((z >> _U(_SCALE)).astype(np.int64))
            each, from_ = own.take(c), base.take(c)
            lower = (z - from_) // each
            x[rest] = first.take(c) + lower
            start[rest] = low + by * (from_ + lower * each)
            size[rest] = by * each
        src.take(m, start, size)
        right = guess[0] == x, guess[1] == x
        model.learn(x, way, slots, entries, right, sure, at, odds)
        steps[t, :m] = x
    return np.ascontiguousarray(steps.T).reshape(-1)[:n_ids].astype(np.int64)


def ranking(ids: np.ndarray) -> np.ndarray:
    """Ids that stand three times or more, most frequent first, ``LISTED`` at most."""
    n = np.bincount(ids, minlength=1 << 16)
    order = np.argsort(-n, kind="stable")[:LISTED]
    return order[n[order] > 2].astype("<u2")


def by_rank(listed: np.ndarray) -> np.ndarray:
    """All ids by rank: the listed ones, then the others in order."""
    other = np.ones(1 << 16, bool)
    other[listed] = False
    return np.concatenate([listed.astype(np.int64), np.flatnonzero(other)])


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment: magic; counts of documents, ids, blocks and listed ids; the listed ids and
    the counts of classes; then for documents their id, whether it is
    null and their number of ids; for blocks their words and the checksum of their ids; then
    the codes. All little-endian."""
    listed = ranking(ids)
    rank = np.empty(1 << 16, np.int64)
    rank[by_rank(listed)] = np.arange(1 << 16)
    ranks = rank[ids]
    seen = np.bincount(_CLASS[ranks], minlength=UPPER)
    prior = 1 + seen * (TOTAL - UPPER) // max(len(ids), 1)
    prior[prior.argmax()] += TOTAL - prior.sum()
    prior = prior.astype("<u2")
    codes = encode_blocks(ranks, prior)
    raw = ids.astype("<u4")
    sums = [zlib.crc32(raw[i * BLOCK : (i + 1) * BLOCK].tobytes()) for i in range(len(codes))]
    head = MAGIC + struct.pack("<QQQQ", len(doc_ids), len(ids), len(codes), len(listed)) + listed.tobytes() + prior.tobytes()
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes()
    blocks = np.array([len(c) // 2 for c in codes], "<u4").tobytes() + np.array(sums, "<u4").tobytes()
    return b"".join([head, docs, lengths.astype("<u8").tobytes(), blocks, *codes])


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, numbers of ids, and ids of a segment; raises if a checksum is wrong."""
    if data[:8] != MAGIC:
        raise ValueError("not a segment of token ids")
    n_docs, n_ids, n_blocks, n_listed = struct.unpack_from("<QQQQ", data, 8)
    at = 40

    def read(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    listed, prior = read("<u2", n_listed), read("<u2", UPPER)
    docs, null, lengths = read("<i8", n_docs), read("u1", n_docs), read("<u8", n_docs)
    words, sums = read("<u4", n_blocks).astype(np.int64), read("<u4", n_blocks)
    ranks = decode_blocks(np.frombuffer(data, "<u2", -1, at), np.cumsum(words) - words, n_ids, prior)
    ids = by_rank(listed)[np.minimum(ranks, (1 << 16) - 1)]
    raw = ids.astype("<u4")
    for i in range(n_blocks):
        if zlib.crc32(raw[i * BLOCK : (i + 1) * BLOCK].tobytes()) != sums[i]:
            raise ValueError(f"block {i} is damaged")
    return [None if z else int(d) for d, z in zip(docs, null)], lengths.astype(np.int64), ids


#: Texts of these Latin-1 bytes only are split here as the tokenizer's own rules would; others go to it whole.
_LETTER = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *(i for i in range(0xC0, 0x100) if i not in (0xD7, 0xF7))])
_PLAIN = _LETTER + bytes([*b"\t\n\r", *range(0x20, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F), 0xA1, 0xBF])
#: Lower case of a byte, and its kind: 0 space, 1 letter, 2 digit, 3 other.
_LOWER = np.frombuffer(bytes(range(256)).decode("latin-1").translate({i: i + 32 for i in _LETTER if i < 0x5B or 0xC0 <= i < 0xDF}).encode("latin-1"), np.uint8)
_KIND = np.array([1 if i in _LETTER else 2 if 0x30 <= i <= 0x39 else 0 if i in b"\t\n\r " else 3 for i in range(256)], np.uint8)
#: Characters of texts that are encoded together, about.
AT_ONCE = 1 << 21


def word_starts(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in lower-case plain bytes that end with three spaces, and which bytes words consist of.

    Words are ``'s|'t|'re|'ve|'m|'ll|'d``, letters, a digit, or others that are no spaces.
    """
    kind = _KIND.take(low)
    first = kind == 2
    first[0] = True
    first[1:] |= kind[1:] != kind[:-1]
    q = np.flatnonzero((low == 0x27) & first)  # inside a run of others an apostrophe starts nothing
    a, b = low[q + 1], low[q + 2]
    one = (a == 0x73) | (a == 0x74) | (a == 0x6D) | (a == 0x64)
    two = ((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)
    first[q[one | two] + 1] = False
    for ends in (q[one] + 2, q[two] + 3):
        first[ends[kind[ends] == 1]] = True
    return np.flatnonzero(first & (kind > 0)), kind > 0


#: Splitting rules under which ``word_starts`` finds the words of plain texts; fixed values of a tokenizer file.
_WORD_RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def words_apart(path: str) -> bool:
    """Whether a tokenizer file splits plain texts into words as ``word_starts`` does, each encoded for itself."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    plain = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
    added = all(not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"])
    return plain and added and all(spec.get(k) == v for k, v in _WORD_RULES.items())


class WordEncoder:
    """Ids of texts by the tokenizers library; where its words are apart it sees each distinct one once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tool = Tokenizer.from_file(path)
        self.apart, self.memo = words_apart(path), {}
        if max(self.tool.get_vocab(True).values(), default=0) >= 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.special = [t.content for t in self.tool.get_added_tokens_decoder().values()]  # texts with them go to the library whole
        bytes_ = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {i: bytes_.pre_tokenize_str(chr(i))[0][0] for i in range(0x80, 0x100)}

    def learn(self, words: list[bytes]) -> None:
        """Remember the ids of new words. The library's model takes them as its own byte-level step spells them."""
        model = self.tool.model
        for w in words:
            spelt = w.decode("latin-1")
            if not w.isascii():
                spelt = spelt.translate(self.spelling)
            self.memo[w] = array("H", [t.id for t in model.tokenize(spelt)]).tobytes()

    def plain(self, text: str) -> bytes | None:
        """A text as Latin-1 if it is split here."""
        if not self.apart:
            return None
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if raw.translate(None, _PLAIN) or any(s in text for s in self.special) else raw

    def split(self, raw: list[bytes]) -> list[bytes]:
        """Ids of each plain text; words are told apart by Arrow, so that Python sees each once."""
        low = _LOWER.take(np.frombuffer(b"\n".join([*raw, b"  "]), np.uint8))
        starts, inside = word_starts(low)
        size = np.cumsum(inside)  # a word's bytes stand together once spaces are gone
        offsets = np.append(size[starts] - 1, size[-1])
        kind, values = (pa.binary(), np.int32) if size[-1] < 1 << 31 else (pa.large_binary(), np.int64)
        words = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets.astype(values)), pa.py_buffer(low[inside])]).dictionary_encode()
        distinct, code = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        if len(self.memo) + len(distinct) > CACHE:
            self.memo.clear()
        new = [w for w in distinct if w not in self.memo]
        if new:
            self.learn(new)
        of = [self.memo[w] for w in distinct]
        flat = np.frombuffer(b"".join(of), np.uint16)
        n = np.fromiter(map(len, of), np.int64, len(of)) >> 1
        count = n.take(code)
        ends = np.append(0, np.cumsum(count))
        ids = flat.take(np.arange(ends[-1]) + np.repeat((np.cumsum(n) - n).take(code) - ends[:-1], count))
        texts = np.cumsum([0, *(len(r) + 1 for r in raw)])
        at = ends[np.searchsorted(starts, texts)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 16-bit integers."""
        raw = [self.plain(t) for t in texts]
        apart = iter(self.split([r for r in raw if r is not None]))
        whole = [t for t, r in zip(texts, raw) if r is None]
        others = iter(self.tool.encode_batch_fast(whole, add_special_tokens=False))
        return [np.array(next(others).ids, np.uint16).tobytes() if r is None else next(apart) for r in raw]


@lru_cache(maxsize=1)
def _encoder(path: str, changed: float) -> WordEncoder:
    """The encoder of a worker: its tasks, one after the other, remember the same words."""
    return WordEncoder(path)


def _together(batches):
    """``(ids, texts)`` of batches in the same order, about ``AT_ONCE`` characters at once."""
    docs, texts, n = [], [], 0
    for batch in batches:
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            docs.append(d)
            texts.append(t or "")
            n += len(texts[-1])
            if n >= AT_ONCE:
                yield docs, texts
                docs, texts, n = [], [], 0
    if docs:
        yield docs, texts


def write_ids(df: DataFrame, folder: str, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode every text and write the ids, each document's with ``end_id`` behind, in ascending id order."""
    WordEncoder(tokenizer)  # refuses a tokenizer that doesn't fit

    def run(batches):
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, number = TaskContext.get().partitionId(), 0
        tool = _encoder(tokenizer, os.stat(tokenizer).st_mtime)
        docs, sizes, held, total = [], [], [], 0
        end = np.array([end_id], np.uint16).tobytes()

        def flush():
            nonlocal number, total
            ids = np.concatenate(held) if held else np.zeros(0, np.uint16)
            row = pa.RecordBatch.from_pydict(
                {"part": [part], "segment": [number], "n_ids": [len(ids)], "data": [pack(docs, np.array(sizes), ids)]},
                pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("data", pa.binary())]),
            )
            number, total = number + 1, 0
            docs.clear(), sizes.clear(), held.clear()
            return row

        for some, texts in _together(batches):
            for d, ids in zip(some, tool.encode(texts)):
                held.append(np.frombuffer(ids + end, np.uint16))
                docs.append(d)
                sizes.append(len(held[-1]))
                total += len(held[-1])
                if total >= SEGMENT:
                    yield flush()
        if docs:
            yield flush()
        release()

    small_batches(df.sparkSession)
    rows = df.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))  # so that rows of one id, null above all, are not one range
    order = (F.col("d").asc_nulls_first(), "h")
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order, "t").select("d", "t")
    spread.mapInArrow(run, "part int, segment int, n_ids long, data binary").write.parquet(folder)


def read_ids(spark, folder: str, digest: bool = False) -> DataFrame:
    """Documents of the files: ``(doc_id, start, n_tokens, ids)``, or ``ids_crc32`` instead of the ids.

    ``start`` counts the ids of all documents before; segments are numbered by
    one running sum over their sizes, a row for about ``SEGMENT`` ids.
    """
    files = spark.read.schema("part int, segment int, n_ids long, data binary").parquet(folder)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sizes.withColumn("first", F.sum("n").over(W.orderBy("part")) - F.col("n")).select("part", "first")
    within = files.select("part", "segment", "n_ids")
    w = W.partitionBy("part").orderBy("segment")
    within = within.withColumn("inside", F.sum("n_ids").over(w) - F.col("n_ids")).drop("n_ids")
    at = within.join(before, "part").select("part", "segment", (F.col("first") + F.col("inside")).alias("first"))
    rows = files.join(at, ["part", "segment"]).select("first", "data")

    def run(batches):
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs, lengths, ids = unpack(data.as_py())
                ends = np.cumsum(lengths)
                starts = ends - lengths
                raw = ids.astype("<u4")
                cols = [pa.array(docs, pa.int64()), pa.array(starts + first), pa.array(lengths)]
                if digest:
                    cols.append(pa.array([zlib.crc32(raw[a:b].tobytes()) for a, b in zip(starts, ends)], pa.int64()))
                else:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return rows.mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<int>'}")
