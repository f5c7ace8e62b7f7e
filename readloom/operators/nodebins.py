"""Nodes of the de Bruijn graph with all of their edges in one bin.

Reads are dealt in runs of nodes of one bin, with a base more on either side. So a bin sees every
occurrence of each edge that enters or leaves one of its nodes: edges are counted, degrees are known and
chains are drawn inside the bin, and only pieces of chains are dealt again, about one for each run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from readloom.operators import superkmers as X
from readloom.operators.kmers import chain_ends
from readloom.session import Tables

#: Longest node: an edge is a base longer, and two bits tell which of its ends are the bin's.
LONGEST = X.LONGEST - 1


def cut(codes: np.ndarray, k: int, n_bins: int) -> tuple[np.ndarray, ...]:
    """``(bin, start, length, sides)`` of runs with the bases beside them, in order of their bins; ``sides``: 1 for a base before, 2 for one behind."""
    ok, low = X.whole(codes, k), X.minimisers(codes, k, False)
    bins = X._mixed(low ^ np.uint32(0x9E3779B9)) % np.uint32(n_bins)
    breaks = np.ones(len(ok) + 1, bool)
    breaks[1:-1] = (bins[1:] != bins[:-1]) | ~ok[1:] | ~ok[:-1]
    start, end = np.flatnonzero(breaks[:-1] & ok), np.flatnonzero(breaks[1:] & ok) + 1
    beside = np.concatenate(([False], ok, [False]))
    left, right = beside[start], beside[end + 1]
    length = end - start + k - 1 + left + right
    keep = length > k  # else there is no edge
    bins, start, length, left, right = bins[start][keep], (start - left)[keep], length[keep], left[keep], right[keep]
    order = np.argsort(bins, kind="stable")
    return bins[order].astype(np.int32), start[order], length[order], (left + 2 * right)[order].astype(np.uint8)


def deal(reads: DataFrame, k: int, n_bins: int, key: str | None = None) -> DataFrame:
    """``(bin, bases, sides[, keys, places])``: runs of ``reads (seq[, key])``, dealt so that a bin is a partition; ``places`` are those of
    the runs' first bases, from 1."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[int]]]:
        held, keys, size = [], [], 0
        for b in batches:
            own = b.column(1).to_pylist() if key else [0] * b.num_rows
            for s, i in zip(b.column(0).to_pylist(), own):
                held.append((s or "").encode("ascii", "replace"))
                keys.append(i)
                size += len(held[-1]) + 1
                if size > X.AT_ONCE:
                    yield held, keys
                    held, keys, size = [], [], 0
        if held:
            yield held, keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, ids in pieces(batches):
            codes = X._CODE[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
            if len(codes) <= k:
                continue
            bins, start, length, sides = cut(codes, k, n_bins)
            if not len(bins):
                continue
            first = np.flatnonzero(X.changes(bins))
            data, at = X._packed(codes, start, length, first)
            ends = np.append(first, len(bins))
            columns = [pa.array(bins[first]), X._binary(data, at), X._binary(sides, ends)]
            if key:
                begin = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
                own = np.searchsorted(begin, start, "right") - 1
                places = (start - begin[own] + 1).astype(np.int32)
                columns += [X._binary(np.array(ids, np.int64)[own].view(np.uint8), ends * 8), X._binary(places.view(np.uint8), ends * 4)]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["bin", "bases", "sides"] + (["keys", "places"] if key else [])
    kind = "bin int, bases binary, sides binary" + (", keys binary, places binary" if key else "")
    return reads.select("seq", *([F.col(key).cast("long")] if key else [])).mapInArrow(run, kind).repartitionById(n_bins, "bin")


def bin_edges(batches: Iterator[pa.RecordBatch], k: int, hard: int) -> tuple[np.ndarray, ...]:
    """``(edge, cnt, has_src, has_dst)`` of a bin's edges of at least ``hard``, in order; which of their ends are nodes of the bin."""
    tally = X.Tally()
    for b in (x for batch in batches for x in X.blocks(batch)):
        codes = X._THREE[np.frombuffer(b"".join(b.column("bases").to_pylist()), np.uint8)].reshape(-1)
        sides = np.frombuffer(b"".join(b.column("sides").to_pylist()), np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (codes < 4).view(np.int8), [0]))))
        start, end = edges[0::2], edges[1::2]
        x = X.numbers(codes & 3, k + 1) << np.uint64(2) | np.uint64(3)
        x[start[sides & 1 > 0]] &= ~np.uint64(2)
        x[end[sides & 2 > 0] - (k + 1)] &= ~np.uint64(1)
        tally.add(x[X.whole(codes, k + 1)])
    keys, counts = tally.settle()
    keep = counts >= hard
    keys, counts = keys[keep], counts[keep]
    return keys >> np.uint64(2), counts, keys & np.uint64(2) > 0, keys & np.uint64(1) > 0


def _ends(edge: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return edge >> np.uint64(2), edge & np.uint64((1 << 2 * k) - 1)


def _sums(at: np.ndarray, n: int, w: np.ndarray | None = None) -> np.ndarray:
    """Sums of ``w``, or counts, by place."""
    out = np.zeros(n, np.int64)
    np.add.at(out, at, 1 if w is None else w)
    return out


def nodes(reads: DataFrame, k: int, hard: int) -> DataFrame:
    """``(node, indeg, outdeg, w_in, w_out, dst, cnt)`` of the graph of (k+1)-mers that occur ``hard`` times: degrees, summed counts of
    edges in and out, and the heaviest edge out, ties by A, G, C, T; null if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge, cnt, has_src, has_dst = bin_edges(batches, k, hard)
        src, dst = _ends(edge, k)
        own = np.union1d(src[has_src], dst[has_dst])
        a, b = np.searchsorted(own, src[has_src]), np.searchsorted(own, dst[has_dst])
        outdeg, w_out = _sums(a, len(own)), _sums(a, len(own), cnt[has_src])
        indeg, w_in = _sums(b, len(own)), _sums(b, len(own), cnt[has_dst])
        out, n = edge[has_src], cnt[has_src]
        order = np.lexsort((np.array([0, 2, 1, 3])[(out & np.uint64(3)).astype(np.intp)], -n, a))
        best = order[np.flatnonzero(X.changes(a[order]))]
        place = np.full(len(own), -1)
        place[a[best]] = best
        for i in range(0, len(own), 50_000):
            s = slice(i, i + 50_000)
            at, none = np.maximum(place[s], 0), place[s] < 0
            to = _ends(out[at], k)[1] if len(out) else np.zeros(len(at), np.uint64)
            heaviest = pc.if_else(pa.array(none), pa.scalar(None, pa.string()), X.strings(to, k))
            yield pa.RecordBatch.from_arrays(
                [X.strings(own[s], k), *(pa.array(c[s]) for c in (indeg, outdeg, w_in, w_out)), heaviest, pa.array(n[at] if len(n) else np.zeros(len(at), np.int64), mask=none)],
                ["node", "indeg", "outdeg", "w_in", "w_out", "dst", "cnt"],
            )

    return deal(reads, k, X.bins_for(reads)).mapInArrow(run, "node string, indeg long, outdeg long, w_in long, w_out long, dst string, cnt long")


def _branches(packed: list[pa.RecordBatch], k: int, hard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(node, indeg, outdeg)`` of a bin's nodes with two edges or more on a side, in order."""
    edge, _, has_src, has_dst = bin_edges(iter(packed), k, hard)
    src, dst = _ends(edge, k)
    own = np.union1d(src[has_src], dst[has_dst])
    outdeg, indeg = _sums(np.searchsorted(own, src[has_src]), len(own)), _sums(np.searchsorted(own, dst[has_dst]), len(own))
    keep = (indeg >= 2) | (outdeg >= 2)
    return own[keep], indeg[keep], outdeg[keep]


def _bridges(packed: list[pa.RecordBatch], known: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(place in known, run, start, before, after)`` of the nodes ``known`` in runs with a base on either side, a block at once; bases are
    codes, ``start`` is the place in the run from 0. The block comes first."""
    for b in (x for batch in packed for x in X.blocks(batch)):
        codes = X._THREE[np.frombuffer(b"".join(b.column("bases").to_pylist()), np.uint8)].reshape(-1)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (codes < 4).view(np.int8), [0]))))
        # a window of k + 2 bases lies within a run, and its inner node is the bin's whichever side the run was drawn out on
        at = np.flatnonzero(X.whole(codes, k + 2)) if len(codes) >= k + 2 else np.empty(0, np.intp)
        x = X.numbers(codes & 3, k)[at + 1]
        place = np.minimum(np.searchsorted(known, x), len(known) - 1)
        hit = known[place] == x
        at, place = at[hit], place[hit]
        run = np.searchsorted(edges[0::2], at, "right") - 1
        yield b, place, run, at - edges[0::2][run], codes[at], codes[at + k + 1]


def bridging_reads(reads: DataFrame, k: int, hard: int, key: str = "read_id") -> DataFrame:
    """``(node, read_id, pos, before, after)``: places in reads of nodes with two edges or more on a side, of the graph of (k+1)-mers that occur
    ``hard`` times, with the bases on either side; a bin knows its nodes' edges, so each read is dealt once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = list(batches)
        known = _branches(packed, k, hard)[0]
        if not len(known):
            return
        letters = pa.array(list("ACGT"))
        for b, place, runs, start, before, after in _bridges(packed, known, k):
            keys = np.frombuffer(b"".join(b.column("keys").to_pylist()), np.int64)
            first = np.frombuffer(b"".join(b.column("places").to_pylist()), np.int32)
            if len(place):
                yield pa.RecordBatch.from_arrays(
                    [X.strings(known[place], k), pa.array(keys[runs]), pa.array((first[runs] + start + 1).astype(np.int32)), letters.take(pa.array(before)), letters.take(pa.array(after))],
                    ["node", key, "pos", "before", "after"],
                )

    return deal(reads, k, X.bins_for(reads), key).mapInArrow(run, f"node string, {key} long, pos int, before string, after string")


def bridged(reads: DataFrame, k: int, hard: int) -> DataFrame:
    """``(node, is_bridged)`` of nodes with two edges or more on a side: whether reads bridge all of their sides, or all but one on each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = list(batches)
        known, indeg, outdeg = _branches(packed, k, hard)
        if not len(known):
            return
        seen = np.zeros((2, len(known), 4), bool)
        for _, place, _, _, before, after in _bridges(packed, known, k):
            seen[0, place, before] = True
            seen[1, place, after] = True
        left, right = indeg - seen[0].sum(1), outdeg - seen[1].sum(1)
        good = ((left <= 0) & (right <= 0)) | ((left == 1) & (right == 1))
        yield pa.RecordBatch.from_arrays([X.strings(known, k), pa.array(good)], ["node", "is_bridged"])

    return deal(reads, k, X.bins_for(reads)).mapInArrow(run, "node string, is_bridged boolean")


def both_strands(reads: DataFrame, k: int, hard: int) -> DataFrame:
    """``(kmer, cnt)``: k-mers of at least ``hard`` and their reverse complements with the same count, which meet in a bin; a palindrome counts twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = X.Tally()
        for b in (x for batch in batches for x in X.blocks(batch)):
            tally.add(X.unpack(b.column("bases"), k)[0])
        x, n = tally.settle()
        x, n = x[n >= hard], n[n >= hard]
        x, n = np.concatenate((x, X.reverse_complements(x, k))), np.concatenate((n, n))
        order = np.argsort(x, kind="stable")
        x, n = x[order], n[order]
        at = np.flatnonzero(X.changes(x))
        x, n = x[at], np.add.reduceat(n, at) if len(at) else n
        for i in range(0, len(x), 50_000):
            yield pa.RecordBatch.from_arrays([X.strings(x[i : i + 50_000], k), pa.array(n[i : i + 50_000])], ["kmer", "cnt"])

    return X.deal(reads, k, X.bins_for(reads), True).select("bases").mapInArrow(run, "kmer string, cnt long")


def _opened(before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(before, head, steps)`` of nodes on chains, ``before`` being a node's place before it or -1; rings are opened before their smallest node."""
    n = len(before)
    for _ in range(2):
        head, steps = np.where(before < 0, np.arange(n), before), (before >= 0).astype(np.int64)
        low = np.minimum(head, np.arange(n))
        for _ in range(max(n, 1).bit_length()):
            if (before[head] < 0).all():
                break
            low = np.minimum(low, low[head])
            head, steps = head[head], steps + steps[head]
        ring = before[head] >= 0
        if not ring.any():
            break
        before = before.copy()
        before[np.unique(low[ring])] = -1
    return before, head, steps


_PART = "kind int, a long, b long, n long, w long, low long, low_w long, enters long, leaves long, seq string"


def _parts(batches: Iterator[pa.RecordBatch], k: int, hard: int) -> Iterator[pa.RecordBatch]:
    """Pieces of chains (kind 0) and edges that are on none in the bin (kind 1).

    A piece: first and last node, nodes, summed counts of edges out, its smallest node and the count of the edge
    into that one; ``enters`` and ``leaves``: edges from and to another bin that go on with the chain if the other end agrees.
    An edge: its ends and count; ``leaves``: the edge, where the bin of its end has to agree.
    """
    edge, cnt, has_src, has_dst = bin_edges(batches, k, hard)
    src, dst = _ends(edge, k)
    own = np.union1d(src[has_src], dst[has_dst])
    if not len(own):
        return
    top = len(own) - 1
    a, b = np.minimum(np.searchsorted(own, src), top), np.minimum(np.searchsorted(own, dst), top)
    outdeg, w_out, indeg = _sums(a[has_src], len(own)), _sums(a[has_src], len(own), cnt[has_src]), _sums(b[has_dst], len(own))
    one_out, one_in = has_src & (outdeg[a] == 1) & (src != dst), has_dst & (indeg[b] == 1) & (src != dst)
    link, out, into = one_out & one_in, one_out & ~has_dst, one_in & ~has_src
    before = np.full(len(own), -1)
    before[b[link]] = a[link]
    was = before
    before, head, steps = _opened(before)
    opened = link & (before[b] < 0)
    enters, leaves, w_in = np.full(len(own), -1), np.full(len(own), -1), np.zeros(len(own), np.int64)
    enters[b[into]], leaves[a[out]], w_in[b[into]] = edge[into], edge[out], cnt[into]
    w_in[was >= 0] = w_out[was[was >= 0]]
    order = np.lexsort((steps, head))
    at = np.flatnonzero(X.changes(head[order]))
    last = order[np.append(at[1:], len(order)) - 1]
    first, n = order[at], np.diff(np.append(at, len(order)))
    low, w = np.minimum.reduceat(order, at), np.add.reduceat(w_out[order], at)
    code = own.astype(np.int64)
    letters = X._LETTER[(own[order] & np.uint64(3)).astype(np.intp)]
    null = lambda x: pa.array(x, mask=x < 0)
    names = [c.split()[0] for c in _PART.split(", ")]
    for i in range(0, len(at), 20_000):
        s = slice(i, i + 20_000)
        lo, hi = at[i], at[i + 20_000] if i + 20_000 < len(at) else len(order)
        # a piece: its first node, then the last base of each other
        size = n[s] + (k - 1)
        ends = np.cumsum(size)
        text = np.empty(ends[-1], np.uint8)
        begin = ends - size
        text[np.repeat(begin, n[s]) + steps[order[lo:hi]] + (k - 1)] = letters[lo:hi]
        for j in range(k - 1):
            text[begin + j] = X._LETTER[((own[first[s]] >> np.uint64(2 * (k - 1 - j))) & np.uint64(3)).astype(np.intp)]
        seq = pa.StringArray.from_buffers(len(size), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(text))
        kind = np.zeros(len(size), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(c) for c in (code[first[s]], code[last[s]], n[s], w[s], code[low[s]], w_in[low[s]])), null(enters[first[s]]), null(leaves[last[s]]), seq], names)
    rest = np.flatnonzero(has_src & (~link | opened))
    for i in range(0, len(rest), 50_000):
        x = rest[i : i + 50_000]
        ends_ = [pa.array(c[x].astype(np.int64)) for c in (src, dst)]
        none = pa.nulls(len(x), pa.int64())
        go = np.where(out[x], edge[x].astype(np.int64), -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(x), np.int32)), *ends_, none, pa.array(cnt[x]), none, none, none, null(go), X.strings(edge[x], k + 1)], names)


def condensed(reads: DataFrame, k: int, hard: int) -> tuple[DataFrame, DataFrame]:
    """``(first_kmer, n_nodes, seq, prevalence)``, the unitigs of the graph of (k+1)-mers that occur ``hard`` times and the summed counts of
    the edges that leave their nodes, and ``(src, dst, cnt, kmer)``, the edges between them.

    Chains are drawn in bins of nodes; their pieces are joined by pointer doubling on numbers. A closed ring starts at its smallest node.
    """
    tables = Tables(reads.sparkSession, "condensed")
    parts = tables.save(deal(reads, k, X.bins_for(reads)).mapInArrow(lambda batches: _parts(batches, k, hard), _PART), "parts")
    piece, edge = parts.where("kind = 0"), parts.where("kind = 1")
    out = piece.where("leaves is not null").select(F.col("leaves").alias("edge"), F.col("a").alias("src"))
    one = out.join(piece.where("enters is not null").select(F.col("enters").alias("edge"), F.col("a").alias("dst")), "edge")
    one = tables.save(one, "one")
    ends = one.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    walked = tables.save(chain_ends(ends, one.select("src", "dst"), tables), "walked")
    p = piece.join(walked, piece.a == walked.node, "left").withColumn("at", F.coalesce("at", "a"))
    x = F.struct((-F.coalesce("steps", F.lit(0))).alias("o"), "seq", "b", "n", "w", "low", "low_w", "enters", "leaves")
    u = p.groupBy("at").agg(F.sort_array(F.collect_list(x)).alias("p"), F.sum("n").alias("n_nodes"), F.sum("w").alias("prevalence"), F.min(F.struct("low", "low_w")).alias("low"))
    rest = F.array_join(F.transform(F.slice("p", 2, 2**30), lambda x: F.substring(x["seq"], k, F.length(x["seq"]))), "")
    is_ring = (F.size("p") > 1) & F.equal_null(F.col("p")[0]["enters"], F.element_at("p", -1)["leaves"]) & F.col("p")[0]["enters"].isNotNull()
    u = u.select(F.concat(F.col("p")[0]["seq"], rest).alias("seq"), "n_nodes", "prevalence", is_ring.alias("is_ring"), F.element_at("p", -1)["b"].alias("last"), F.col("low.low_w").alias("low_w"))
    # a ring over several bins is turned to its smallest node
    n = F.col("n_nodes").cast("int")
    starts = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substring("seq", i, F.lit(k)).alias("s"), i.alias("i")))
    ring = F.repeat(F.substring("seq", F.lit(1), n), F.ceil(F.lit(k) / n).cast("int") + 2)
    u = tables.save(u.withColumn("seq", F.when(F.col("is_ring"), F.substring(ring, F.array_min(starts)["i"], n + (k - 1))).otherwise(F.col("seq"))), "unitigs")
    unitigs = u.select(F.substring("seq", 1, k).alias("first_kmer"), "n_nodes", "seq", "prevalence")
    edge = edge.join(one.select(F.col("edge").alias("leaves")), "leaves", "left_anti")
    last = u.where("not is_ring").select(F.substring("seq", 1, k).alias("src"), "last")
    links = edge.join(last, edge.a == last["last"]).select("src", F.substring("seq", 2, k).alias("dst"), F.col("w").alias("cnt"), F.col("seq").alias("kmer"))
    first = F.substring("seq", 1, k)
    closing = F.concat(F.substring("seq", -k, k), F.substring("seq", k, F.lit(1)))
    closed = u.where("is_ring").select(first.alias("src"), first.alias("dst"), F.col("low_w").alias("cnt"), closing.alias("kmer"))
    return unitigs, tables.save(links.union(closed), "links")
