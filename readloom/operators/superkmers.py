"""k-mers dealt in runs: neighbouring k-mers with the same minimiser travel as one string.

A row a k-mer is some 50 bytes to shuffle, sort and spill for each base. The k-mers of a
run overlap in all but one base, so a run of n costs n + k - 1 bases, three to a byte. The
minimiser is told by the k-mer alone, so equal k-mers meet in the same bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from readloom.session import size_of

#: Longest k-mer that fits a number of 64 bits, and the bases of a minimiser.
LONGEST, MINIMISER = 31, 11
#: Bytes of input files to a bin; bases that are dealt, and k-mers that are sorted, at once.
BIN_BYTES, AT_ONCE, SORTED = 8 << 20, 500_000, 8_000_000

_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)
_THREE = np.array([(b // 25, b // 5 % 5, b % 5) for b in range(125)], np.uint8)


def bins_for(df: DataFrame) -> int:
    """Bins for the k-mers of ``df``: in proportion to the files that it reads, two a core at least."""
    spark = df.sparkSession
    least = 2 * spark.sparkContext.defaultParallelism
    return max(least, -(-sum(size_of(spark, f) for f in df.inputFiles()) // BIN_BYTES))


def numbers(codes: np.ndarray, k: int, kind: type = np.uint64) -> np.ndarray:
    """The number, two bits a base, of every window of ``k`` codes."""
    size = len(codes)
    if size < k:
        return np.empty(0, kind)
    out, have, power, wide = None, 0, codes.astype(kind), 1
    while True:
        if k & wide:
            n = size - have - wide + 1
            out = power if out is None else (out[:n] << kind(2 * wide)) | power[have : have + n]
            have += wide
        if have == k:
            return out
        n = size - 2 * wide + 1
        power = (power[:n] << kind(2 * wide)) | power[wide : wide + n]
        wide *= 2


def whole(codes: np.ndarray, k: int) -> np.ndarray:
    """Which windows of ``k`` codes are bases throughout."""
    bad = np.concatenate(([0], np.cumsum(codes > 3, dtype=np.int32)))
    return bad[k:] == bad[:-k]


def reverse_complements(x: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the reverse complements of k-mers."""
    x = ~x
    for bits, low in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        x = ((x >> np.uint64(bits)) & np.uint64(low)) | ((x & np.uint64(low)) << np.uint64(bits))
    return x.byteswap() >> np.uint64(64 - 2 * k)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def minimisers(codes: np.ndarray, k: int, both_strands: bool) -> np.ndarray:
    """For every window of ``k`` codes the least of its minimisers' hashes; with ``both_strands`` the same for its reverse complement."""
    m = min(MINIMISER, k)
    h = _mixed(numbers(codes & 3, m, np.uint32))
    if both_strands:
        h = np.minimum(h, _mixed(numbers((3 - (codes & 3))[::-1], m, np.uint32)[::-1]))
    width, have = k - m + 1, 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    rest = width - have
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def cut(codes: np.ndarray, k: int, n_bins: int, both_strands: bool):
    """``(bin, start, length)`` of runs, in order of their bins."""
    ok, low = whole(codes, k), minimisers(codes, k, both_strands)
    breaks = np.ones(len(ok) + 1, bool)
    breaks[1:-1] = (low[1:] != low[:-1]) | ~ok[1:] | ~ok[:-1]
    start = np.flatnonzero(breaks[:-1] & ok)
    length = np.flatnonzero(breaks[1:] & ok) - start + k
    bins = _mixed(low[start] ^ np.uint32(0x9E3779B9)) % np.uint32(n_bins)
    order = np.argsort(bins, kind="stable")
    return bins[order].astype(np.int32), start[order], length[order]


def _packed(codes: np.ndarray, start: np.ndarray, length: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bases of runs, each with a mark behind, three to a byte, and where the bytes of each bin begin; ``first``: a bin's first run."""
    wide = length + 1
    last = np.append(first[1:], len(start)) - 1
    wide[last] += -np.add.reduceat(wide, first) % 3
    end = np.cumsum(wide)
    at = end - wide
    out = codes[np.minimum(np.repeat(start - at, wide) + np.arange(end[-1]), len(codes) - 1)]
    for gap in range(3):
        marked = wide - length > gap
        out[(at + length + gap)[marked]] = 4
    return out[0::3] * 25 + out[1::3] * 5 + out[2::3], np.append(at[first], end[-1]) // 3


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def runs(rows: DataFrame, k: int, n_bins: int, both_strands: bool = False, key: str | None = None) -> DataFrame:
    """``(bin, bases, keys, places)`` of ``rows (seq[, key])``: runs of k-mers, a row for each bin and piece of input.

    ``keys`` holds the key of each run, ``places`` the position of its first k-mer, from 1.
    """

    def pieces(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            seqs = b.column(0).to_pylist()
            keys = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64) if key else None
            lo = size = 0
            for hi, s in enumerate(seqs):
                if size and size + len(s or "") > AT_ONCE:
                    yield seqs[lo:hi], keys[lo:hi] if key else None
                    lo = hi
                    size = 0
                size += len(s or "") + 1
            if lo < len(seqs):
                yield seqs[lo:], keys[lo:] if key else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seqs, keys in pieces(batches):
            parts = [(s or "").encode("ascii", "replace") for s in seqs]
            codes = _CODE[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
            if len(codes) < k:
                continue
            bins, start, length = cut(codes, k, n_bins, both_strands)
            if not len(bins):
                continue
            first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
            data, at = _packed(codes, start, length, first)
            ends = np.append(first, len(bins))
            if key:
                begin = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
                own = np.searchsorted(begin, start, "right") - 1
                kept, places = keys[own], (start - begin[own] + 1).astype(np.int32)
            else:
                kept = places = np.empty(0)
                ends = np.zeros_like(ends)
            yield pa.RecordBatch.from_arrays([pa.array(bins[first]), _binary(data, at), _binary(kept.view(np.uint8), ends * 8), _binary(places.view(np.uint8), ends * 4)], ["bin", "bases", "keys", "places"])

    columns = ["seq", key] if key else ["seq"]
    return rows.select(*columns).mapInArrow(run, "bin int, bases binary, keys binary, places binary")


def deal(rows: DataFrame, k: int, n_bins: int, both_strands: bool = False, key: str | None = None) -> DataFrame:
    """``runs``, dealt so that a bin is a partition."""
    return runs(rows, k, n_bins, both_strands, key).repartitionById(n_bins, "bin")


def unpack(bases: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the k-mers of packed runs, and how many each run has."""
    codes = _THREE[np.frombuffer(b"".join(bases.to_pylist()), np.uint8)].reshape(-1)
    ok = whole(codes, k)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
    return numbers(codes & 3, k)[ok], edges[1::2] - edges[0::2]


def blocks(batch: pa.RecordBatch, size: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, about ``size`` packed bytes at once."""
    ends = np.cumsum(pc.binary_length(batch.column("bases")).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


class Tally:
    """Counts of numbers, sorted a few million at once; holds the different ones and as many again."""

    def __init__(self):
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.new: list[np.ndarray] = []
        self.n = 0

    def add(self, x: np.ndarray) -> None:
        self.new.append(x)
        self.n += len(x)
        if self.n > max(SORTED, len(self.keys)):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if self.n:
            x = np.concatenate(self.new)
            self.new, self.n = [], 0
            x.sort()
            at = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            keys, counts = x[at], np.diff(np.append(at, len(x)))
            if len(self.keys):
                both, n = np.concatenate((self.keys, keys)), np.concatenate((self.counts, counts))
                order = np.argsort(both, kind="stable")
                both, n = both[order], n[order]
                at = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
                keys, counts = both[at], np.add.reduceat(n, at)
            self.keys, self.counts = keys, counts
        return self.keys, self.counts


_LETTER = np.frombuffer(b"ACGT", np.uint8)


def strings(x: np.ndarray, k: int) -> pa.Array:
    """k-mers of numbers."""
    out = np.empty((len(x), k), np.uint8)
    for i in range(k):
        out[:, i] = _LETTER[((x >> np.uint64(2 * (k - 1 - i))) & np.uint64(3)).astype(np.intp)]
    return pa.StringArray.from_buffers(len(x), pa.py_buffer(np.arange(0, (len(x) + 1) * k, k, dtype=np.int32)), pa.py_buffer(out))


def counted(reads: DataFrame, k: int, hard: int, is_canonical: bool) -> DataFrame:
    """``(kmer, cnt)`` of at least ``hard``, a bin a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for b in (x for batch in batches for x in blocks(batch)):
            x, _ = unpack(b.column("bases"), k)
            tally.add(np.minimum(x, reverse_complements(x, k)) if is_canonical else x)
        keys, counts = tally.settle()
        keep = counts >= hard
        keys, counts = keys[keep], counts[keep]
        for i in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([strings(keys[i : i + 50_000], k), pa.array(counts[i : i + 50_000])], ["kmer", "cnt"])

    dealt = deal(reads, k, bins_for(reads), is_canonical)
    return dealt.select("bases").mapInArrow(run, "kmer string, cnt long")


def keyed(batches, k: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k-mers and the keys of their runs, about ``size`` at once."""
    held, n = [], 0
    for b in (x for batch in batches for x in blocks(batch)):
        x, wide = unpack(b.column("bases"), k)
        held.append((x, np.repeat(np.frombuffer(b"".join(b.column("keys").to_pylist()), np.int64), wide)))
        n += len(x)
        if n >= size:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    if not len(columns[0]):
        return np.empty(0, bool)
    return np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))


def _rows(names: list[str], *columns: np.ndarray, at_once: int = 100_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), at_once):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + at_once]) for c in columns], names)


def repeated(x: np.ndarray, bits: int = 23) -> np.ndarray:
    """Places of numbers that occur again, and of a few others: those that share a slot of a hashed table."""
    slot = ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)
    last = np.empty(1 << bits, np.int32)
    last[slot] = np.arange(len(x), dtype=np.int32)
    more = np.zeros(1 << bits, bool)
    more[slot[last[slot] != np.arange(len(x), dtype=np.int32)]] = True
    return np.flatnonzero(more[slot])


def links_of_bin(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """``link_blocks`` of a bin. A bin of one block, as bins are unless few k-mers make up most of one, is linked by its repeated k-mers alone."""
    first, second = next(parts, None), next(parts, None)
    if first is None:
        return
    if second is None:
        at = repeated(first[0])
        yield from link_blocks(iter([(first[0][at], first[1][at])]))
    else:
        yield from link_blocks(chain([first, second], parts))


def link_blocks(blocks_: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Links between the keys of equal k-mers, block by block; different k-mers are held with the least key so far."""
    known, low = np.empty(0, np.uint64), np.empty(0, np.int64)
    for x, ids in blocks_:
        order = np.argsort(x)  # not stable: of equal k-mers only the least key counts
        s = x[order]
        first = changes(s)
        at = np.flatnonzero(first)
        new, least = s[at], np.minimum.reduceat(ids[order], at)
        place = np.searchsorted(known, new)
        hit = np.zeros(len(new), bool)
        inside = place < len(known)
        hit[inside] = known[place[inside]] == new[inside]
        old = low[place[hit]]
        least[hit] = np.minimum(least[hit], old)
        low[place[hit]] = least[hit]
        own = np.empty_like(ids)
        own[order] = least[np.cumsum(first) - 1]
        a, b = np.concatenate((own, least[hit])), np.concatenate((ids, old))
        known, low = np.insert(known, place[~hit], new[~hit]), np.insert(low, place[~hit], least[~hit])
        differ = a != b
        a, b = a[differ], b[differ]
        keep = changes(a, b)
        yield from _rows(["src", "dst"], a[keep], b[keep])


def links(rows: DataFrame, k: int, key: str) -> DataFrame:
    """``(src, dst)``: links that join all keys of a k-mer, one less than it has keys; the smaller key first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from links_of_bin(keyed(batches, k, SORTED))

    return deal(rows, k, 2 * bins_for(rows), key=key).mapInArrow(run, "src long, dst long").distinct()


def shared(rows: DataFrame, k: int, key: str, pairs_at_once: int = 4_000_000) -> DataFrame:
    """``(src, dst, w)``: pairs of keys ``src < dst`` and the number of position pairs with equal k-mers, summed up in a bin first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(keyed(batches, k, SORTED))
        if not parts:
            return
        x, ids = map(np.concatenate, zip(*parts))
        del parts
        order = np.lexsort((ids, x))
        x, ids = x[order], ids[order]
        at = np.flatnonzero(changes(x, ids))
        n = np.diff(np.append(at, len(x)))
        x, ids = x[at], ids[at]
        begin = np.flatnonzero(changes(x))
        begin = np.repeat(begin, np.diff(np.append(begin, len(x))))
        before = np.arange(len(x)) - begin
        done = np.cumsum(before)
        lo = 0
        while lo < len(x):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + pairs_at_once, "right")))
            c = before[lo:hi]
            right = np.repeat(np.arange(lo, hi), c)
            left = np.arange(len(right)) - np.repeat(np.cumsum(c) - c, c) + begin[right]
            a, b, w = ids[left], ids[right], n[left] * n[right]
            order = np.lexsort((b, a))
            a, b, w = a[order], b[order], w[order]
            at = np.flatnonzero(changes(a, b))
            if len(at):
                yield from _rows(["src", "dst", "w"], a[at], b[at], np.add.reduceat(w, at))
            lo = hi

    parts = deal(rows, k, 2 * bins_for(rows), key=key).mapInArrow(run, "src long, dst long, w long")
    return parts.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def _pairs(ids: np.ndarray, begin: np.ndarray, at_once: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Pairs ``src < dst`` of the ids of a group, without repeats in a block; ids ascend in a group, ``begin`` is where each one's group begins."""
    before = np.arange(len(ids)) - begin
    done = np.cumsum(before)
    lo = 0
    while lo < len(ids):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + at_once, "right")))
        c = before[lo:hi]
        right = np.repeat(np.arange(lo, hi), c)
        left = np.arange(len(right)) - np.repeat(np.cumsum(c) - c, c) + begin[right]
        a, b = ids[left], ids[right]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        keep = changes(a, b)
        yield from _rows(["src", "dst"], a[keep], b[keep])
        lo = hi


def _groups(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of k-mer and key in order, where each one's k-mer begins, and how many keys that has."""
    order = np.lexsort((ids, x))
    x, ids = x[order], ids[order]
    keep = changes(x, ids)
    x, ids = x[keep], ids[keep]
    first = np.flatnonzero(changes(x))
    n = np.diff(np.append(first, len(x)))
    return x, ids, np.repeat(first, n), np.repeat(n, n)


def _set_hash(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def sharing(rows: DataFrame, k: int, key: str, most: int) -> DataFrame:
    """What each bin knows of keys that share k-mers, by ``kind``: ``pair`` (src, dst) have a k-mer of at most ``most`` keys in common;
    ``set`` (src, h1, h2): hashes of the k-mers of more keys that a key has, to be combined by xor; ``kmer``: one of those k-mers."""
    names = ["kind", "src", "dst", "h1", "h2", "kmer"]

    def row(kind: str, n: int, **columns) -> pa.RecordBatch:
        empty = {"kmer": pa.nulls(n, pa.string())}
        return pa.RecordBatch.from_arrays([pa.array([kind] * n), *(columns.get(c, empty.get(c, pa.nulls(n, pa.int64()))) for c in names[1:])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(keyed(batches, k, SORTED))
        if not parts:
            return
        x, ids = map(np.concatenate, zip(*parts))
        del parts
        at = repeated(x)
        x, ids, begin, n = _groups(x[at], ids[at])
        few = (n > 1) & (n <= most)
        moved = np.cumsum(few) - few  # places among those of few keys
        for b in _pairs(ids[few], moved[begin[few]]):
            yield row("pair", b.num_rows, src=b.column(0), dst=b.column(1))
        x, ids, n = x[n > most], ids[n > most], n[n > most]
        own = x[changes(x)]
        order = np.argsort(ids)
        x, ids = x[order], ids[order]
        at = np.flatnonzero(changes(ids))
        if len(at):
            h = [np.bitwise_xor.reduceat(_set_hash(x, seed), at).view(np.int64) for seed in (1, 2)]
            for b in _rows(["src", "h1", "h2"], ids[at], *h):
                yield row("set", b.num_rows, src=b.column(0), h1=b.column(1), h2=b.column(2))
            for i in range(0, len(own), 50_000):
                yield row("kmer", len(own[i : i + 50_000]), kmer=strings(own[i : i + 50_000], k))

    return deal(rows, k, 2 * bins_for(rows), key=key).mapInArrow(run, "kind string, src long, dst long, h1 long, h2 long, kmer string")


def pairs_among(rows: DataFrame, table: DataFrame, k: int, key: str) -> DataFrame:
    """``(src, dst)`` without repeats: pairs of keys of ``rows`` that share a ``kmer`` of ``table``."""

    def run(packed: list[pa.RecordBatch], parts) -> Iterator[pa.RecordBatch]:
        known, _ = _distinct(parts)
        held = []
        for x, ids in keyed(packed, k, SORTED // 8):
            hit = known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x
            held.append((x[hit], ids[hit]))
        x, ids, begin, _ = _groups(*map(np.concatenate, zip(*held)))
        yield from _pairs(ids, begin)

    zero = F.lit(0).cast("long").alias("zero")
    return _meet(rows, table.select(F.col("kmer").alias("seq"), zero), k, key, "zero", run, "src long, dst long").distinct()


def _meet(a: DataFrame, b: DataFrame, k: int, key_a: str, key_b: str, run, schema: str, is_left: bool = False) -> DataFrame:
    """Runs of ``a`` (side 0) and ``b`` (side 1) dealt alike; ``run`` gets the batches of ``a`` in a bin, packed, and k-mers and keys of ``b``.
    Bins without ``b`` are left out unless ``is_left``."""
    n = 2 * max(bins_for(a), bins_for(b))
    both = runs(a, k, n, key=key_a).withColumn("side", F.lit(0)).union(runs(b, k, n, key=key_b).withColumn("side", F.lit(1)))

    def bin_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        for batch in batches:
            side = batch.column("side")
            for i in (0, 1):
                part = batch.filter(pc.equal(side, i))
                if part.num_rows:
                    sides[i].append(part)
        if sides[0] and (sides[1] or is_left):
            yield from run(sides[0], keyed(sides[1], k, SORTED // 2))

    return both.repartitionById(n, "bin").mapInArrow(bin_, schema)


def weights(rows: DataFrame, k1: DataFrame, k: int, key: str) -> DataFrame:
    """``(key, wt)``: summed ``cnt`` in ``k1 (kmer, cnt)`` of the k-mers of each key that has any."""

    def run(packed: list[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
        known, cnt = map(np.concatenate, zip(*table))
        order = np.argsort(known, kind="stable")
        known, cnt = known[order], cnt[order]
        for x, ids in keyed(packed, k, SORTED // 8):
            place = np.minimum(np.searchsorted(known, x), len(known) - 1)
            hit = known[place] == x
            ids, wt = ids[hit], cnt[place[hit]]
            at = np.flatnonzero(changes(ids))
            if len(at):
                yield from _rows([key, "wt"], ids[at], np.add.reduceat(wt, at))

    table = k1.select(F.col("kmer").alias("seq"), "cnt")
    return _meet(rows, table, k, key, "cnt", run, f"{key} long, wt long").groupBy(key).agg(F.sum("wt").alias("wt"))


def _distinct(parts) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs of k-mer and key, in order; blocks are merged as they come."""
    x, keys, new = np.empty(0, np.uint64), np.empty(0, np.int64), 0
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(c) for c in zip((x, keys), *held))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        keep = changes(a, b)
        return a[keep], b[keep]

    for part in parts:
        held.append(part)
        new += len(part[0])
        if new > max(SORTED, len(x)):
            x, keys = merged()
            held, new = [], 0
    return merged() if held else (x, keys)


def kmer_keys(rows: DataFrame, k: int, key: str) -> DataFrame:
    """``(kmer, key)`` without repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, keys = _distinct(keyed(batches, k, SORTED // 2))
        for i in range(0, len(x), 50_000):
            yield pa.RecordBatch.from_arrays([strings(x[i : i + 50_000], k), pa.array(keys[i : i + 50_000])], ["kmer", key])

    return deal(rows, k, 2 * bins_for(rows), key=key).mapInArrow(run, f"kmer string, {key} long")


def counted_keys(rows: DataFrame, reads: DataFrame, k: int, key: str, hard: int) -> DataFrame:
    """``(kmer, key, cnt)`` without repeats: k-mers of ``rows`` with their keys and how often they occur in ``reads``, 0 if not ``hard`` times."""
    n = 2 * max(bins_for(rows), bins_for(reads))
    own = runs(rows, k, n, key=key).select("bin", "bases", "keys")
    both = own.union(runs(reads, k, n).select("bin", "bases", F.lit(None).cast("binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, packed = Tally(), []
        for batch in batches:
            is_read = pc.is_null(batch.column("keys"))
            packed.append(batch.filter(pc.invert(is_read)))
            for b in blocks(batch.filter(is_read)):
                tally.add(unpack(b.column("bases"), k)[0])
        x, keys = _distinct(keyed(packed, k, SORTED // 2))
        known, counts = tally.settle()
        known, counts = known[counts >= hard], counts[counts >= hard]
        cnt = np.zeros(len(x), np.int64)
        if len(known):
            place = np.minimum(np.searchsorted(known, x), len(known) - 1)
            hit = known[place] == x
            cnt[hit] = counts[place[hit]]
        for i in range(0, len(x), 50_000):
            s = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([strings(x[s], k), pa.array(keys[s]), pa.array(cnt[s])], ["kmer", key, "cnt"])

    return both.repartitionById(n, "bin").mapInArrow(run, f"kmer string, {key} long, cnt long")


def met(rows: DataFrame, table: DataFrame, k: int, key: str, other: str) -> DataFrame:
    """``(key, other)`` without repeats: keys of ``rows`` and ``table`` that share a k-mer."""

    def run(packed: list[pa.RecordBatch], parts) -> Iterator[pa.RecordBatch]:
        known, to = _distinct(parts)
        for x, ids in keyed(packed, k, SORTED // 8):
            lo, hi = np.searchsorted(known, x, "left"), np.searchsorted(known, x, "right")
            n = hi - lo
            at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
            yield from _rows([key, other], np.repeat(ids, n), to[at])

    return _meet(rows, table, k, key, other, run, f"{key} long, {other} long").distinct()


def places_of(rows: DataFrame, table: DataFrame, k: int, key: str) -> DataFrame:
    """``(kmer, key, pos)``: places in ``rows`` of every k-mer that is a ``kmer`` of ``table``."""

    def run(packed: list[pa.RecordBatch], parts) -> Iterator[pa.RecordBatch]:
        known, _ = _distinct(parts)
        for x, ids, pos in _placed(packed, k):
            hit = known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x
            x, ids, pos = x[hit], ids[hit], pos[hit]
            if len(x):
                yield pa.RecordBatch.from_arrays([strings(x, k), pa.array(ids), pa.array(pos)], ["kmer", key, "pos"])

    ends = table.select(F.col("kmer").alias("seq"), F.lit(0).cast("long").alias("zero"))
    return _meet(rows, ends, k, key, "zero", run, f"kmer string, {key} long, pos int")


def _placed(batches, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """k-mers, the keys of their runs and their places from 1, block by block."""
    for b in (x for batch in batches for x in blocks(batch)):
        x, wide = unpack(b.column("bases"), k)
        ids = np.repeat(np.frombuffer(b"".join(b.column("keys").to_pylist()), np.int64), wide)
        first = np.frombuffer(b"".join(b.column("places").to_pylist()), np.int32)
        yield x, ids, (np.arange(len(x)) + np.repeat(first - (np.cumsum(wide) - wide), wide)).astype(np.int32)


def places_without(rows: DataFrame, table: DataFrame, k: int, key: str) -> DataFrame:
    """``(key, pos, n)``: stretches of n k-mers in ``rows`` from place ``pos`` on none of which is a ``kmer`` of ``table``."""

    def run(packed: list[pa.RecordBatch], parts) -> Iterator[pa.RecordBatch]:
        known, _ = _distinct(parts)
        for x, ids, pos in _placed(packed, k):
            if len(known):
                lost = known[np.minimum(np.searchsorted(known, x), len(known) - 1)] != x
                ids, pos = ids[lost], pos[lost]
            at = np.flatnonzero(changes(ids, pos - np.arange(len(pos))))
            yield from _rows([key, "pos", "n"], ids[at], pos[at], np.diff(np.append(at, len(ids))).astype(np.int32))

    own = table.select(F.col("kmer").alias("seq"), F.lit(0).cast("long").alias("zero"))
    return _meet(rows, own, k, key, "zero", run, f"{key} long, pos int, n int", True)


def held_by_others(rows: DataFrame, k: int, key: str) -> DataFrame:
    """``(key, pos, n, others)``: stretches of n k-mers from place ``pos`` on that so many other keys hold each; none if no other does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(_placed(batches, k))
        if not parts:
            return
        x, ids, pos = map(np.concatenate, zip(*parts))
        del parts
        at = repeated(x)
        x, ids, pos = x[at], ids[at], pos[at]
        order = np.lexsort((ids, x))
        x, ids, pos = x[order], ids[order], pos[order]
        if not len(x):
            return
        at = np.flatnonzero(changes(x))
        keys = np.add.reduceat(changes(x, ids), at, dtype=np.int32)
        others = np.repeat(keys, np.diff(np.append(at, len(x)))) - 1
        keep = others > 0
        ids, pos, others = ids[keep], pos[keep], others[keep]
        order = np.lexsort((pos, ids))
        ids, pos, others = ids[order], pos[order], others[order]
        at = np.flatnonzero(changes(ids, pos - np.arange(len(pos)), others))
        yield from _rows([key, "pos", "n", "others"], ids[at], pos[at], np.diff(np.append(at, len(ids))).astype(np.int32), others[at])

    return deal(rows, k, 2 * bins_for(rows), key=key).mapInArrow(run, f"{key} long, pos int, n int, others int")


def greater_holders(rows: DataFrame, table: DataFrame, k: int, key: str, greatest: bool, pairs_at_once: int = 4_000_000) -> DataFrame:
    """``(q, t)`` without repeats: keys q of ``rows`` and greater ones t of ``table`` that share a k-mer; with ``greatest`` just the greatest
    t of each k-mer. Keys are below 2^31."""

    def run(packed: list[pa.RecordBatch], parts) -> Iterator[pa.RecordBatch]:
        known, to = _distinct(parts)
        for x, ids in keyed(packed, k, SORTED // 8):
            lo, hi = np.searchsorted(known, x, "left"), np.searchsorted(known, x, "right")
            if greatest:
                lo = np.maximum(lo, hi - 1)
            n = hi - lo
            done = np.cumsum(n)
            i = 0
            while i < len(x):
                j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + pairs_at_once, "right")))
                c = n[i:j]
                at = np.arange(c.sum()) + np.repeat(lo[i:j] - (np.cumsum(c) - c), c)
                q, t = np.repeat(ids[i:j], c), to[at]
                both = np.unique((q << 32 | t)[t > q])
                yield from _rows(["q", "t"], both >> 32, both & 0xFFFFFFFF)
                i = j

    return _meet(rows, table, k, key, key, run, "q long, t long").distinct()


def frequent_runs(rows: DataFrame, k: int, hard: int, key: str) -> DataFrame:
    """``(key, n)``: runs of n k-mers all of which occur ``hard`` times in ``rows``; a key whose runs add up to all of its k-mers has no rare one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, tally = list(batches), Tally()
        for b in (x for batch in packed for x in blocks(batch)):
            tally.add(unpack(b.column("bases"), k)[0])
        known, counts = tally.settle()
        known = known[counts >= hard]
        if not len(known):
            return
        for b in (x for batch in packed for x in blocks(batch)):
            x, wide = unpack(b.column("bases"), k)
            hit = known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x
            good = np.logical_and.reduceat(hit, np.cumsum(wide) - wide)
            keys = np.frombuffer(b"".join(b.column("keys").to_pylist()), np.int64)
            yield from _rows([key, "n"], keys[good], wide[good])

    return deal(rows, k, bins_for(rows), key=key).mapInArrow(run, f"{key} long, n long")


def counted_among(rows: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """``(kmer, n)``: how often each ``kmer`` of ``table`` occurs in ``rows (seq)``, if it does."""

    def run(packed: list[pa.RecordBatch], parts) -> Iterator[pa.RecordBatch]:
        known, _ = _distinct(parts)
        n = np.zeros(len(known), np.int64)
        for x, _ in keyed(packed, k, SORTED // 8):
            place = np.minimum(np.searchsorted(known, x), len(known) - 1)
            n += np.bincount(place[known[place] == x], minlength=len(known))
        known, n = known[n > 0], n[n > 0]
        for i in range(0, len(known), 50_000):
            yield pa.RecordBatch.from_arrays([strings(known[i : i + 50_000], k), pa.array(n[i : i + 50_000])], ["kmer", "n"])

    zero = F.lit(0).cast("long").alias("zero")
    return _meet(rows.select("seq", zero), table.select(F.col("kmer").alias("seq"), zero), k, "zero", "zero", run, "kmer string, n long")


def _words(seqs: pa.Array, k: int) -> np.ndarray:
    """For each sequence and code of ``k`` bases, whether it occurs."""
    parts = [(s or "").encode("ascii", "replace") for s in seqs.to_pylist()]
    codes = _CODE[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
    at = np.flatnonzero(whole(codes, k)) if len(codes) >= k else np.empty(0, np.intp)
    out = np.zeros((len(parts), 4**k), bool)
    out[np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), at, "right"), numbers(codes & 3, k)[at].astype(np.intp)] = True
    return out


def common_words(pairs: DataFrame, key: str, k: int = 3) -> DataFrame:
    """``(key, n_common, n_common5)`` of ``pairs (key, seq1, seq2)``: different k-mers of both and of the first one's reverse; those that the
    second one's reverse and the first one's complement hold as well. A row is looked at once, as flags of its 4^k possible k-mers."""
    code = np.arange(4**k)
    back = sum((code >> 2 * i & 3) << 2 * (k - 1 - i) for i in range(k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = _words(b.column(1), k), _words(b.column(2), k)
            three = x & y & x[:, back]
            five = three & y[:, back] & x[:, ::-1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(three.sum(1, dtype=np.int64)), pa.array(five.sum(1, dtype=np.int64))], [key, "n_common", "n_common5"])

    return pairs.select(key, "seq1", "seq2").mapInArrow(run, f"{key} long, n_common long, n_common5 long")
