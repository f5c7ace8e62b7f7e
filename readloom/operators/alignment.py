"""Gapped local alignment of sequences against others: minimiser seeds, chains on diagonals, banded dynamic programming.

Of every ``WINDOW`` k-mers beside each other the one of least hash is a seed. Seeds that a query shares with a
target lie near one diagonal where the two align; bins of diagonals overlap by half, so that a
chain with gaps falls into one, and of the bins of a pair the one with most seeds is aligned. The best local
alignment in a band around it is found in Arrow batches: a row of the matrices of many pairs is a few numpy operations. Work follows shared seeds, and only pairs with ``LEAST`` seeds in a bin meet their sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from readloom.functions import sequence as S
from readloom.session import Tables, broadcast_if_small

#: Bases of a seed, k-mers of a window, diagonals of a bin, seeds of a chain at least, diagonals on either side of a band.
SEED, WINDOW, BIN, LEAST, BAND = 13, 5, 32, 2, 24
#: Cells of the matrices that are filled at once.
CELLS = 1 << 22
_ROW = "q string, t string, strand string, score int, matches int, mismatches int, q_gaps int, t_gaps int, q_start int, q_end int, t_start int, t_end int"


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_CODE = np.full(256, 255, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hashes(text: np.ndarray, k: int) -> np.ndarray:
    """``xxhash64``, as Spark has it, of every window of ``k`` bytes, fewer than 32."""
    n = len(text) - k + 1
    read = lambda at, kind, size: np.ndarray((n,), kind, text, at, (1,)).astype(np.uint64)
    h, at = np.full(n, _P5 + np.uint64(42 + k)), 0
    for _ in range(k // 8):
        h = _turned(h ^ _turned(read(at, "<u8", 8) * _P2, 31) * _P1, 27) * _P1 + _P4
        at += 8
    if k - at >= 4:
        h = _turned(h ^ read(at, "<u4", 4) * _P1, 23) * _P2 + _P3
        at += 4
    for at in range(at, k):
        h = _turned(h ^ read(at, "u1", 1) * _P5, 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def minimisers(seqs: list[bytes], k: int = SEED, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(own, code, pos)`` of the seeds of sequences: which sequence, the k-mer as a number, its place from 1; in order.

    Two bits a base tell a k-mer of ACGT; one with other letters is its hash, below zero.
    """
    length = np.array([len(s) for s in seqs], np.int64)
    n = np.maximum(length - k + 1, 0)
    if not n.sum():
        return (np.empty(0, np.int64),) * 3
    text = np.frombuffer(b"".join(seqs) + bytes(k + w), np.uint8)
    begin = np.cumsum(length) - length
    own = np.repeat(np.arange(len(seqs)), n)
    at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + begin[own]
    hashed = hashes(text, k)
    h = np.full(len(hashed), np.iinfo(np.int64).max)
    h[at] = hashed[at]
    windows = np.where(n > 0, np.maximum(n - w + 1, 1), 0)
    own = np.repeat(np.arange(len(seqs)), windows)
    first = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[own]
    best, low = first.copy(), h[first]
    for d in range(1, w):
        other = h[first + d]  # k-mers behind the last one of a sequence are no less than any
        less = other < low
        best[less], low[less] = first[less] + d, other[less]
    keep = np.append(True, (best[1:] != best[:-1]) | (own[1:] != own[:-1]))
    own, best, low = own[keep], best[keep], low[keep]
    code, plain = np.zeros(len(best), np.int64), np.ones(len(best), bool)
    for i in range(k):
        base = _CODE[text[best + i]]
        plain &= base < 4
        code = code << 2 | (base & 3)
    return own, np.where(plain, code, low | np.iinfo(np.int64).min), best - begin[own] + 1


def _seeds(seqs: DataFrame, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(i, 2000) for batch in batches for i in range(0, batch.num_rows, 2000)):
            own, code, pos = minimisers([(s or "").encode("ascii", "replace") for s in b.column(1).to_pylist()])
            ends = pa.array(np.searchsorted(own, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(code)), pa.ListArray.from_arrays(ends, pa.array(pos.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["name", "codes", "places"])

    rows = seqs.select("name", "seq").mapInArrow(run, "name string, codes array<long>, places array<int>")
    return rows.select(F.col("name").alias(name), F.explode(F.arrays_zip("codes", "places")).alias("m")).select(name, F.col("m.codes").alias("kmer"), F.col("m.places").alias(name + "_pos"))


def chains(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """``(q, t, diagonal)``: the middle diagonal of the bin with most shared seeds of each pair that has enough in one."""
    hit = _seeds(queries, "q").join(broadcast_if_small(_seeds(targets, "t")), "kmer").select("q", "t", (F.col("t_pos") - F.col("q_pos")).alias("d"))
    half = F.floor(F.col("d") / (BIN // 2))
    bins = hit.select("q", "t", "d", F.explode(F.array(half, half - 1)).alias("bin")).groupBy("q", "t", "bin")
    bins = bins.agg(F.count(F.lit(1)).alias("n"), F.floor((F.min("d") + F.max("d")) / 2).cast("int").alias("diagonal")).where(F.col("n") >= LEAST)
    return bins.groupBy("q", "t").agg(F.max_by("diagonal", F.struct("n", (-F.col("bin")).alias("b"))).alias("diagonal"))


def local_alignments(qs: list[bytes], ts: list[bytes], diagonals: list[int], band: int = BAND) -> np.ndarray:
    """``local_alignment`` of many pairs, a row each; row i of all matrices is made at once, and all go a step back at once."""
    n, width = len(qs), 2 * band + 1
    na, nb = (np.array([len(x) for x in xs], np.int64) for xs in (qs, ts))
    longest = int(na.max(initial=0))
    a = np.zeros((n, longest + 1), np.uint8)
    b = np.zeros((n, longest + width), np.uint8)  # column x: the base of t that lies x - band off the diagonal's start, or 0
    low = np.array(diagonals, np.int64) - band
    for p, (x, y) in enumerate(zip(qs, ts)):
        a[p, 1 : len(x) + 1] = np.frombuffer(x, np.uint8)
        lo, hi = max(0, -low[p]), min(b.shape[1], nb[p] - low[p])
        if lo < hi:
            b[p, lo:hi] = np.frombuffer(y, np.uint8)[lo + low[p] : hi + low[p]]
    step = np.arange(width, dtype=np.int32)
    h = np.zeros((longest + 1, n, width + 2), np.int32)  # a column of zeros on either side
    for i in range(1, longest + 1):
        there = b[:, i - 1 : i - 1 + width]
        off = (there == 0) | (i > na)[:, None]
        row = h[i - 1, :, 1:-1] + np.where(there == a[:, i, None], np.int32(1), np.int32(-1))
        np.maximum(row, h[i - 1, :, 2:] - 1, out=row)
        np.maximum(row, 0, out=row)
        row[off] = 0
        row = np.maximum.accumulate(row + step, axis=1) - step
        row[off] = 0
        h[i, :, 1:-1] = row
    tops = h.max(axis=2)  # the first row, and in it the first column, of the best score
    i = tops.argmax(axis=0)
    every = np.arange(n)
    score = tops[i, every]
    c = h[i, every].argmax(axis=1)
    at = lambda i, c: i - 2 + low + c
    q_end, t_end = i.copy(), at(i, c) + 1
    seen = np.zeros((4, n), np.int64)  # matches, mismatches, q_gaps, t_gaps
    on = np.flatnonzero(score > 0)
    while len(on):
        x, y = i[on], c[on]
        here, same = h[x, on, y], a[on, x] == b[on, x + y - 2]
        straight = here == h[x - 1, on, y] + np.where(same, 1, -1)
        t_gap = ~straight & (here == h[x - 1, on, y + 1] - 1)
        q_gap = ~straight & ~t_gap
        for k, of in enumerate((straight & same, straight & ~same, q_gap, t_gap)):
            seen[k, on] += of
        i[on], c[on] = x - ~q_gap, y + t_gap - q_gap.astype(np.int64)
        on = on[h[i[on], on, c[on]] > 0]
    return np.stack([score, *seen, i, q_end, at(i, c) + 1, t_end], axis=1)


def local_alignment(q: str, t: str, diagonal: int, band: int = BAND) -> tuple[int, ...]:
    """``(score, matches, mismatches, q_gaps, t_gaps, q_start, q_end, t_start, t_end)`` of the best local alignment in the band: 1 for a
    match, -1 for a mismatch or a gapped base; the first of equal ends, and mismatches before gaps on the way back."""
    return tuple(map(int, local_alignments([q.encode()], [t.encode()], [diagonal], band)[0]))


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _ROW.split(", ")]
    for batch in batches:
        q, t = ([x.encode("ascii", "replace") for x in batch.column(c).to_pylist()] for c in ("q_seq", "t_seq"))
        diagonal = batch.column("diagonal").to_pylist()
        order = np.argsort([len(x) for x in q])
        lo = 0
        while lo < len(q):
            hi, longest = lo + 1, len(q[order[lo]])
            while hi < len(q) and (hi - lo + 1) * (max(longest, len(q[order[hi]])) + 1) <= CELLS // (2 * BAND + 3):
                longest = max(longest, len(q[order[hi]]))
                hi += 1
            part = order[lo:hi]
            found = local_alignments([q[i] for i in part], [t[i] for i in part], [diagonal[i] for i in part]).astype(np.int32)
            same = batch.select(["q", "t", "strand"]).take(pa.array(part))
            yield pa.RecordBatch.from_arrays([*same.columns, *map(pa.array, np.ascontiguousarray(found.T))], names)
            lo = hi


def align(queries: DataFrame, targets: DataFrame, both_strands: bool = True) -> DataFrame:
    """Alignments of ``queries (name, seq)`` with ``targets (name, seq)``, names being unique: one a pair at most and the better strand; places
    count from 0 on the strand that is aligned. Sequences shorter than a seed align with nothing."""
    tables = Tables(queries.sparkSession, "alignment")
    own = lambda strand, seq: queries.select(F.concat(F.lit(strand), F.col("name").cast("string")).alias("name"), seq.alias("seq"))
    q = own("+", F.col("seq"))
    q = tables.save(q.union(own("-", S.reverse_complement(F.col("seq")))) if both_strands else q, "queries")
    t = tables.save(targets.select(F.col("name").cast("string").alias("name"), "seq"), "targets")
    pairs = tables.save(chains(q, t), "chains")
    rows = pairs.join(q.select(F.col("name").alias("q"), F.col("seq").alias("q_seq")), "q").join(t.select(F.col("name").alias("t"), F.col("seq").alias("t_seq")), "t")
    rows = rows.select(F.substring("q", 2, 2**30).alias("q"), "t", F.substring("q", 1, 1).alias("strand"), "q_seq", "t_seq", "diagonal")
    made = tables.save(rows.mapInArrow(_align, _ROW), "aligned")
    best = F.row_number().over(W.partitionBy("q", "t").orderBy(F.desc("score"), "strand"))  # two rows at most
    return made.withColumn("place", best).where("place = 1").drop("place")
