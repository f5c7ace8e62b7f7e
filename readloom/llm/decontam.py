"""Benchmark decontamination by a broadcast set of hashed n-grams, each hit verified.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lowered. A window is
``WORDS`` consecutive words of a benchmark item; an item of fewer words, but not
none, is one window. The distinct windows are hashed, the hash set goes to the
tasks, and every document is scanned once: a word's hash is a difference of
prefix sums over bytes, a window's one over words, so a scan costs the same
whatever the window's length. What the set holds is compared word by word, byte
by byte, before it counts.

What is broadcast is bounded: the windows of an item are dealt into blocks of at
most about ``ROWS`` rows and ``BYTES`` bytes by a hash, and documents are scanned
block after block. Every pass merges its hits with those of the passes before;
after each pass but the last its table is written, so one pass runs at a time.

Defined results: a null or empty text has no words; an item without words has no
window; rows of equal item id are one item, and so are all rows without an id,
whose name is the empty string; texts may have any length (bytes are hashed in
pieces of ``PIECE``, arrays of words and the text itself are held for the rows of
a batch); repeated rows are scanned each; a benchmark without rows hits nothing;
an empty table gives an empty result; columns of the input that are named like
an output column are replaced, others stay, whatever their name.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from readloom.llm.common import drop_names, hold, let_go, quoted, release, small_batches
from readloom.session import Tables

WORDS = 10
#: Rows and bytes of windows in a block, and bytes hashed together.
ROWS, BYTES, PIECE = 400_000, 48 << 20, 1 << 20
#: Bytes that no word has, as a regex class body.
GAP = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
OUT = ("n_words", "n_hit", "items", "spans", "contaminated")

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOW = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
_INSIDE = ((_LOW >= 48) & (_LOW <= 57)) | ((_LOW >= 97) & (_LOW <= 122)) | (_LOW >= 128)
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xC2B2AE3D27D4EB4F}
_powers: dict[tuple[str, int], np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODE = _mix(_LOW.astype(np.uint64) + np.uint64(1))


def _power(base: str, sign: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of a base or, for sign -1, of its inverse, modulo 2^64."""
    p = _powers.get((base, sign))
    if p is None or len(p) < n:
        p = np.full(max(n, PIECE), pow(_BASES[base], sign, 1 << 64), np.uint64)
        p[:1] = 1
        p = _powers[base, sign] = np.cumprod(p)
    return p[:n]


class Text:
    """Words of the texts of a batch: bytes from ``start`` to ``end``, ``hash`` and ``row``; those of row i start at ``first[i]``."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.data, self.offsets = data, offsets - offsets[0]
        self._hash_words()
        self.first = np.searchsorted(self.start, self.offsets)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def _hash_words(self) -> None:
        data, found = self.data, ([], [], [], [])
        carry, before = np.uint64(0), False
        up, down = _power("byte", 1, PIECE), _power("byte", -1, PIECE)
        far = []
        for a in range(0, len(data), PIECE):
            piece = data[a : a + PIECE]
            inside = _INSIDE[piece]
            new = np.zeros(len(piece), bool)
            lo, hi = np.searchsorted(self.offsets, (a, a + len(piece)))
            new[self.offsets[lo:hi] - a] = True
            last = np.empty(len(piece), bool)
            last[0], last[1:] = before, inside[:-1]
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_CODE[piece] * up[: len(piece)], out=total[1:])
            total *= np.uint64(pow(_BASES["byte"], a, 1 << 64))
            total += carry
            far.append(pow(_BASES["byte"], -a, 1 << 64))
            for k, at in ((0, np.flatnonzero(inside & (new | ~last))), (1, np.flatnonzero(last & (new | ~inside)))):
                found[k].append(at + a)
                found[k + 2].append(total[at])
            carry, before = total[-1], inside[-1]
        if before:
            found[1].append(np.array([len(data)]))
            found[3].append(np.array([carry]))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.start, self.end = join(found[0], np.int64), join(found[1], np.int64)
        back = down[self.start % PIECE] * np.array(far, np.uint64)[self.start // PIECE] if far else np.zeros(0, np.uint64)
        self.hash = _mix((join(found[3], np.uint64) - join(found[2], np.uint64)) * back)

    def windows(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; those that run into the next text are among them."""
        if len(self.hash) < n:
            return np.zeros(0, np.uint64)
        total = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * _power("word", 1, len(self.hash)), out=total[1:])
        at = len(total) - n
        return _mix((total[n:] - total[:at]) * _power("word", -1, at))


class WindowSet:
    """A block of windows: hash set by length, their words for the exact check, and the items of each."""

    def __init__(self, windows: pa.Array, items: pa.Array):
        coded = windows.combine_chunks().dictionary_encode() if isinstance(windows, pa.ChunkedArray) else windows.dictionary_encode()
        self.text = Text(coded.dictionary)
        names = items.combine_chunks().dictionary_encode() if isinstance(items, pa.ChunkedArray) else items.dictionary_encode()
        self.names = names.dictionary.to_pylist()
        entry, item = coded.indices.to_numpy(), names.indices.to_numpy()
        order = np.lexsort((item, entry))
        self.item, self.item_at = item[order], np.searchsorted(entry[order], np.arange(len(coded.dictionary) + 1))
        size = np.diff(self.text.first)
        self.by_length = {}
        for n in np.unique(size).tolist():
            entries = np.flatnonzero(size == n)
            key = self.text.windows(n)[self.text.first[entries]]
            order = np.argsort(key)
            key = key[order]
            bits = min(24, max(12, math.ceil(math.log2(len(key))) + 6))
            there = np.zeros(1 << bits, bool)
            there[key >> np.uint64(64 - bits)] = True
            _, runs = np.unique(key, return_counts=True)
            self.by_length[n] = (key, entries[order], there, np.uint64(64 - bits), int(runs.max()))

    def hits(self, text: Text):
        """``(word, n, entry)``: the word at which an entry of n words stands in a text, for every place."""
        for n, (key, entries, there, shift, most) in self.by_length.items():
            h = text.windows(n)
            at = np.flatnonzero(there[h >> shift])
            at = at[text.row[at] == text.row[at + n - 1]]
            place = np.searchsorted(key, h[at])
            for k in range(most):  # windows of equal hash, one nearly always
                slot = np.minimum(place + k, len(key) - 1)
                ok = key[slot] == h[at]
                w, e = at[ok], entries[slot[ok]]
                ok = np.zeros(len(w), bool)
                for a in range(0, len(w), 65_536):
                    ok[a : a + 65_536] = self._same(text, w[a : a + 65_536], e[a : a + 65_536], n)
                yield w[ok], n, e[ok]

    def _same(self, text: Text, word: np.ndarray, entry: np.ndarray, n: int) -> np.ndarray:
        """Whether the n words at each place are those of its entry."""
        a = (word[:, None] + np.arange(n)).ravel()
        b = (self.text.first[entry][:, None] + np.arange(n)).ravel()
        size = text.end[a] - text.start[a]
        ok = (size == self.text.end[b] - self.text.start[b]).reshape(-1, n).all(1)
        a, b, size = (x.reshape(-1, n)[ok].ravel() for x in (a, b, size))
        if len(a):
            ends = np.cumsum(size)
            step = np.arange(ends[-1]) - np.repeat(ends - size, size)
            wrong = _LOW[text.data[np.repeat(text.start[a], size) + step]] != self.text.data[np.repeat(self.text.start[b], size) + step]
            ok[ok] = ~np.logical_or.reduceat(wrong, (ends - size)[::n])
        return ok


def _scan(block: WindowSet, texts: pa.Array, spans: pa.Array, items: pa.Array) -> list[pa.Array]:
    """``n_words, n_hit, items, spans`` of texts that had ``spans`` and ``items`` before."""
    t = Text(texts)
    edge = np.zeros(len(t.start) + 1, np.int64)
    own = [np.zeros(0, np.int64)]
    for w, n, entry in block.hits(t):
        np.add.at(edge, w, 1)
        np.add.at(edge, w + n, -1)
        many = block.item_at[entry + 1] - block.item_at[entry]
        ends = np.cumsum(many)
        flat = np.repeat(block.item_at[entry], many) + np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many)
        own.append(np.unique(np.repeat(t.row[w], many) * len(block.names) + block.item[flat]))
    old = spans.flatten()
    row = np.repeat(np.arange(len(texts)), pa.compute.list_value_length(spans).to_numpy())
    base = t.offsets[row]
    np.add.at(edge, np.searchsorted(t.start, base + old.field(0).to_numpy()), 1)
    np.add.at(edge, np.searchsorted(t.start, base + old.field(1).to_numpy()), -1)
    hit = np.cumsum(edge)[:-1] > 0
    at = np.flatnonzero(hit)
    lead = np.ones(len(at), bool)
    lead[1:] = (np.diff(at) > 1) | (np.diff(t.row[at]) > 0)
    tail = np.roll(lead, -1) if len(at) else lead
    row = t.row[at[lead]]
    made = [(t.start[at[lead]] - t.offsets[row]).astype(np.int32), (t.end[at[tail]] - t.offsets[row]).astype(np.int32)]
    of = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
    new_spans = pa.ListArray.from_arrays(pa.array(of), pa.StructArray.from_arrays([pa.array(x) for x in made], ["start", "end"]))
    found = np.unique(np.concatenate(own))
    names = dict(zip(*_lists(found // max(len(block.names), 1), found % max(len(block.names), 1), block.names)))
    listed = [sorted({*(o or ()), *names.get(i, ())}) for i, o in enumerate(items.to_pylist())]
    n_hit = np.add.reduceat(np.append(hit, False), t.first[:-1]) * (np.diff(t.first) > 0) if len(texts) else np.zeros(0, np.int64)
    return [pa.array(np.diff(t.first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(listed, pa.list_(pa.string())), new_spans]


def _lists(row: np.ndarray, item: np.ndarray, names: list[str]) -> tuple[list[int], list[list[str]]]:
    rows, at = np.unique(row, return_index=True)
    return rows.tolist(), [[names[i] for i in part.tolist()] for part in np.split(item, at[1:])] if len(rows) else []


def _word_array(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, f"[{GAP}]+"), lambda w: w != "")


def item_windows(benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``(window, item)``: the distinct windows of each item, words joined by a space."""
    items = benchmark.select(F.coalesce(F.col(quoted(item_id)).cast("string"), F.lit("")).alias("item"), _word_array(F.col(quoted(text))).alias("w"))
    n = F.least(F.size("w"), F.lit(WORDS))
    cut = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    return items.where(F.size("w") > 0).select(F.explode(cut).alias("window"), "item").distinct()


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", carry: list[str] | None = None, item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Rows of ``docs`` (columns ``carry``, all by default) with ``n_words``, ``n_hit`` (words inside a window),
    ``items`` (sorted ids of items with windows there), ``spans`` (hit stretches by their UTF-8 bytes) and ``contaminated``."""
    spark = docs.sparkSession
    small_batches(spark)
    tables = Tables(spark, "decontamination")
    windows = tables.save(item_windows(benchmark, item_text, item_id), "windows")
    n_rows, n_bytes = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item")), F.lit(0))).first()
    blocks = max(1, math.ceil(n_rows / ROWS), math.ceil(n_bytes / BYTES))
    keep = drop_names(docs.select(*map(quoted, docs.columns if carry is None else carry)), OUT)
    out = docs.select(
        hold(docs, keep),
        F.coalesce(F.col(quoted(text)), F.lit("")).alias("t"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<string>").alias("items"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
    )
    for b in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == b)
        out = out if b == 0 else tables.save(out, "pass")
        out = _pass(out, part.toArrow())  # at most about ROWS rows and BYTES bytes
    return out.select(*let_go(keep), "n_words", "n_hit", "items", "spans", (F.col("n_hit") > 0).alias("contaminated"))


def _pass(rows: DataFrame, block: pa.Table) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast((block.column("window").to_pylist(), block.column("item").to_pylist()))
    names = rows.columns

    def run(batches):
        made = WindowSet(*(pa.array(x, pa.string()) for x in sent.value))
        for batch in batches:
            held, t, _, _, items, spans = batch.columns
            yield pa.RecordBatch.from_arrays([held, t, *_scan(made, t, spans, items)], names)
        release()

    return rows.mapInArrow(run, rows.schema)


def without_spans(text: Column, spans: Column) -> Column:
    """A text less its ``spans``."""
    raw, n = text.cast("binary"), F.size(spans)
    piece = lambda i: F.substring(
        raw, F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0) + 1, F.when(i < n, F.get(spans, i)["start"]).otherwise(F.octet_length(text)) - F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)
    ).cast("string")
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n), piece), "")).otherwise(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", text: str = "text", **names) -> DataFrame:
    """``docs`` with the hit stretches cut out of their texts, or without the documents that have any."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    found = find_contamination(docs, benchmark, text, **names)
    if remove == "documents":
        return found.where("not contaminated").drop(*OUT)
    return found.withColumn(text, without_spans(F.col(quoted(text)), F.col("spans"))).drop(*OUT)
