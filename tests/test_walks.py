"""Read correction, reads and mates laid on the graph, and clean-up on tables, against plain Python."""

import random
from collections import Counter
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from readloom.operators import assembly as A
from readloom.operators import cleanup, correction, kmers, laying
from readloom.operators import graph as G


def genome(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def swapped(s, p):
    return s[:p] + s[p].translate(str.maketrans("ACGT", "CGTA")) + s[p + 1 :]


# -- correction


def brute_correction(reads, k, cutoff, rounds):
    """Each read alone, by recursion over the base beside the first trusted stretch."""
    counts = Counter()
    for _, s, q in reads:
        for i in range(len(s) - k + 1):
            if q is None or all(ord(c) - 33 >= 5 for c in q[i : i + k]):
                counts[s[i : i + k]] += "N" not in s[i : i + k]
    good = {x for x, n in counts.items() if n >= cutoff}

    def solutions(s, q, left):
        ok = [s[i : i + k] in good for i in range(len(s) - k + 1)]
        if all(ok):
            return [(0, 0, s)]
        edge = next((i for i in range(1, len(ok)) if ok[i - 1] and not ok[i]), None)
        at = edge + k - 1 if edge is not None else ok.index(True) - 1 if True in ok else None
        if at is None or not left:
            return []
        edge = at if edge is None else edge
        out = []
        for b in "ACGT":
            t = s[:at] + b + s[at + 1 :]
            if b != s[at] and t[edge : edge + k] in good:
                out += [(c + (ord(q[at]) - 33 if q else 40), n + 1, x) for c, n, x in solutions(t, q, left - 1)]
        return out

    out = {}
    for i, s, q in reads:
        found = sorted(solutions(s, q, rounds))
        best = [f for f in found if f[0] == found[0][0]] if found else []
        if len(s) < k or (found and found[0][1] == 0):
            out[i] = (s, 0, 0, "clean")
        elif len(best) == 1:
            out[i] = (best[0][2], best[0][1], best[0][0], "corrected")
        else:
            out[i] = (s, 0, 0, "ambiguous" if best else "unsolved")
    return out


def test_reads_are_corrected(spark):
    rnd, base = random.Random(5), genome(1500, 1)
    other = swapped(swapped(base, 700), 705)  # a second real variant
    reads = []
    for g in (base, other):
        for at in range(0, len(g) - 60, 7):
            s, q = g[at : at + 60], "I" * 60
            for _ in range(rnd.choice([0, 0, 0, 1, 1, 2, 3])):
                p = rnd.randrange(60)
                s = swapped(s, p)
                q = q[:p] + rnd.choice("#I5") + q[p + 1 :]
            reads.append((len(reads), s, rnd.choice([q, q, None])))
    reads += [(9001, base[200:230] + "N" + base[231:260], None), (9002, "ACGT", None), (9003, genome(60, 99), None), (9004, base[100:160].lower(), None)]
    d = spark.createDataFrame(reads, "read_id long, seq string, qual string")
    got = {r.read_id: (r.seq, r.n_replaced, r.cost, r.status) for r in correction.correct(d, k=15, cutoff=3, rounds=3).collect()}
    want = brute_correction([(i, s.upper(), q) for i, s, q in reads], 15, 3, 3)
    assert got == want
    kinds = Counter(x[3] for x in got.values())
    assert kinds["corrected"] > 100 and kinds["unsolved"] >= 1 and got[9001][0] == base[200:260] and got[9003][3] == "unsolved" and got[9004][0] == base[100:160]
    none = correction.correct(d.limit(0), k=15)
    assert none.count() == 0
    mates = spark.createDataFrame([(1, 9001, 9003), (2, 9003, 9001), (3, 9001, 9004), (4, 9003, 9003)], "pair_id long, left_id long, right_id long")
    out = correction.part_mates(mates, correction.correct(d, k=15, cutoff=3, rounds=3))
    assert {(r.pair_id, r.kind) for r in out.collect()} == {(1, "left"), (2, "right"), (3, "paired")}


@pytest.mark.parametrize(("counts", "want"), [({}, 1), ({1: 9}, 1), ({1: 9, 2: 3}, 1), ({1: 9, 2: 3, 3: 5}, 2), ({1: 9, 5: 3}, 2), ({1: 2, 2: 9}, 1), ({1: 9, 2: 4, 3: 4}, 2), ({2: 5, 3: 1, 7: 4}, 4)])
def test_valley(spark, counts, want):
    hist = spark.createDataFrame(list(counts.items()), "cnt long, n long")
    assert correction.valley(hist) == want


# -- reads and mates on the graph


def graph_of(spark, k1, k):
    """Unitigs and edges as tables, and the kernel's graph with names for its nodes."""
    e = kmers.dbg_edges(spark.createDataFrame(sorted(k1.items()), "kmer string, cnt double"), k).cache()
    u = kmers.unitigs(e)
    g = A.Graph.from_kmers(k1, k)
    g.condense()
    return u.cache(), G.unitig_graph(u, e, k).cache(), g, {v: s[:k] for v, s in g.seq.items()}, e


def counted(seqs, k):
    out = Counter()
    for s in seqs:
        for i in range(len(s) - k):
            out[s[i : i + k + 1]] += 1
    return {x: float(n) for x, n in out.items()}


def tangled(seed):
    """Sequences with repeats, a repeat in itself, variants and a ring."""
    rnd = random.Random(seed)
    rep, x, y, z = (genome(n, seed * 10 + i) for i, n in enumerate((40, 120, 120, 90)))
    ring = genome(50, seed + 77)
    return [x + rep + y, z + rep + x[:60], swapped(x, 50) + rep, y[:80] + rep[:30] + rep + z, ring * 3, genome(12, seed) * 8, rnd.choice([x, y]) + rep[::-1]]


def test_read_paths_are_those_of_the_kernel(spark):
    k = 11
    seqs = tangled(3)
    u, links, g, name, _ = graph_of(spark, counted(seqs, k), k)
    reads = sorted({s[i : i + 45] for s in seqs for i in range(0, len(s) - 45, 3)} | {genome(45, 5), seqs[0][:10], seqs[0][:20] + "A" + seqs[0][21:45], seqs[4][:45] + seqs[4][45:90]})
    d = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    got = {}
    for r in laying.read_paths(d, u, links, k).collect():
        got.setdefault(r.read_id, {})[r.step] = r.unitig
    at = g.index()
    laid = {i: g.lay(s, at, 100) for i, s in enumerate(reads)}
    assert {i: [p[j] for j in range(len(p))] for i, p in got.items()} == {i: [name[v] for v in p] for i, p in laid.items() if p}
    paths = laying.read_paths(d, u, links, k)
    known = {r.path: r.n for r in laying.known_paths(paths).collect()}
    assert known == Counter(">".join(name[v] for v in p) for p in laid.values() if p and len(p) > 2) and len(known) > 5
    edges = {(r.src, r.dst): r.support for r in laying.path_edges(paths).collect()}
    assert edges == Counter((name[a], name[b]) for p in laid.values() if p for a, b in pairwise(p))
    assert laying.read_paths(d.limit(0), u, links, k).count() == 0


@pytest.mark.parametrize("seed", [4])
def test_unique_ways_are_those_of_the_kernel(spark, seed):
    k = 11
    u, links, g, name, _ = graph_of(spark, counted(tangled(seed), k), k)
    nodes = sorted(g.seq)
    goals = [(a, b) for a in nodes for b in nodes if a != b and b not in g.out[a]]
    table = spark.createDataFrame([(name[a], name[b]) for a, b in goals], "a string, b string")
    got = {}
    for r in laying.unique_ways(table, u, links, k).collect():
        got.setdefault((r.a, r.b), {})[r.step] = r.unitig
    want = {(name[a], name[b]): [name[v] for v in p] for a, b in goals if (p := g.mate_path(a, b))}
    assert {x: [p[j] for j in range(len(p))] for x, p in got.items()} == want and len(want) > 10


def test_mate_paths(spark):
    """Along the left mate, the way between, the right mate; mates in one node need no way."""
    k = 11
    seqs = tangled(3)
    u, links, g, name, _ = graph_of(spark, counted(seqs, k), k)
    pairs = [(s[i : i + 30], s[i + 60 : i + 90]) for s in seqs for i in range(0, len(s) - 90, 4)]
    table = lambda j: spark.createDataFrame([(i, p[j]) for i, p in enumerate(pairs)], "pair_id long, seq string")
    left, right = (laying.read_paths(table(j), u, links, k, "pair_id") for j in (0, 1))
    goals = laying.mate_goals(left, right, links)
    ways = laying.unique_ways(goals, u, links, k)
    got = {r.path: r.n for r in laying.mate_paths(left, right, ways).collect()}
    at, want = g.index(), Counter()
    for a, b in pairs:
        p, q = g.lay(a, at, 100), g.lay(b, at, 100)
        if not p or not q or q[0] in g.out[p[-1]] and q[0] != p[-1]:
            continue
        way = (p[-1],) if p[-1] == q[0] else g.mate_path(p[-1], q[0])
        if way and len(p[:-1] + way + q[1:]) > 2:
            want[">".join(name[v] for v in p[:-1] + way + q[1:])] += 1
    assert got == want and len(want) > 3


# -- clean-up


def tables_of(nodes, links):
    return {(r.id, r.seq, r.prevalence, r.n) for r in nodes.collect()}, {(r.src, r.dst) for r in links.collect()}


def kernel_of(g, k):
    name = {v: s[:k] for v, s in g.seq.items()}
    return {(name[v], g.seq[v], g.prevalence[v], g.size[v]) for v in g.seq}, {(name[a], name[b]) for a in g.out for b in g.out[a]}


@pytest.mark.parametrize("seed", [1, 2])
def test_clean_up_equals_going_through_nodes_one_by_one(spark, monkeypatch, seed):
    """Errors in reads make tips, bubbles and rare bridges; suspects lie side by side and depend on each other."""
    k, rnd = 9, random.Random(seed)
    base = [genome(150, seed * 7 + i) for i in range(3)] + [genome(30, seed + 70) * 3]
    base.append(base[0][:60] + base[1][60:120])
    k1 = Counter()
    for s in base:
        for _ in range(25):
            i = rnd.randrange(max(1, len(s) - 40))
            r = s[i : i + 40]
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                r = swapped(r, rnd.randrange(len(r)))
            for x, n in counted([r], k).items():
                k1[x] += n
    monkeypatch.setattr(A, "LEAST_PREVALENCE", 3.0)
    u, links, g, _, e = graph_of(spark, dict(k1), k)
    nodes, links = cleanup.condensed(u, G.prevalences(u, e, k), links)
    assert tables_of(nodes, links) == kernel_of(g, k)
    before = len(g.seq)
    g.remove_suspicious(25)
    nodes, links = cleanup.remove_suspicious(nodes, links, 25, 3.0, k)
    assert tables_of(nodes, links) == kernel_of(g, k) and len(g.seq) < before
    g.collapse()
    nodes, links = cleanup.collapse(nodes, links)
    assert tables_of(nodes, links) == kernel_of(g, k)
    g.condense()
    nodes, links, _ = cleanup.condense(nodes, links, None, k, cleanup.Tables(spark, "test"))
    assert tables_of(nodes, links) == kernel_of(g, k)


def test_bubbles_collapse(spark):
    """Three variants of a stretch become one with the weight of all; one with too many differences stays."""
    k, s = 9, genome(120, 8)
    far = s[:50] + genome(10, 4) + s[60:]
    k1 = Counter()
    for x, n in ((s, 5), (swapped(s, 55), 9), (swapped(swapped(s, 55), 55), 2), (far, 4)):
        for kmer in counted([x], k):
            k1[kmer] += float(n)
    u, links, g, _, e = graph_of(spark, dict(k1), k)
    nodes, links = cleanup.condensed(u, G.prevalences(u, e, k), links)
    before = nodes.count()
    nodes, links = cleanup.collapse(nodes, links, 0.2)
    g_share, A.HAMMING_SHARE = A.HAMMING_SHARE, 0.2
    try:
        g.collapse()
    finally:
        A.HAMMING_SHARE = g_share
    assert tables_of(nodes, links) == kernel_of(g, k) and nodes.count() < before


def test_cleaned_graph_of_the_tables(spark, monkeypatch):
    """The query on the whole smallest tables against the kernel."""
    import os

    from readloom.plans import walks

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    monkeypatch.setattr(A, "LEAST_PREVALENCE", walks.RARE)
    g = A.Graph.from_kmers({r.kmer: float(r.cnt) for r in walks.solid(spark, d).collect()}, 24)
    g.condense()
    g.remove_suspicious(walks.LENGTH)
    g.collapse()
    g.condense()
    got = {(r.id, r.seq, r.prevalence, r.n) for r in walks.cleaned_nodes(spark, d).collect()}
    assert got == kernel_of(g, 24)[0] and len(got) > 10
    g.bridge_all(sorted({r.seq for r in walks.dna.reads(spark, d).collect()}))
    got = sorted((r.seq, round(r.prevalence, 6), r.n) for r in walks.bridged_nodes(spark, d).collect())
    assert got == sorted((g.seq[v], round(g.prevalence[v], 6), g.size[v]) for v in g.seq)


def test_clean_up_of_nothing(spark):
    nodes = spark.createDataFrame([], "id string, seq string, prevalence double, n long")
    links = spark.createDataFrame([], "src string, dst string")
    nodes, links = cleanup.clean(nodes, links, 100, 1.0)
    assert nodes.count() == 0 and links.count() == 0


# -- bridging


@pytest.mark.parametrize("seed", [1, 2, 5])
def test_bridging_equals_the_kernel(spark, seed):
    """Repeats shorter than reads, some of them next to each other, are resolved; longer ones stay."""
    from readloom.operators import bridging

    k = 9
    rep, small, long = genome(20, seed + 50), genome(13, seed + 60), genome(50, seed + 90)
    part = [genome(40, seed * 20 + i) for i in range(12)]
    seqs = [part[0] + rep + part[1], part[2] + rep + part[3], part[4] + small + rep + part[5], part[6] + small + part[7], part[8] + long + part[9], part[10] + long + part[11]]
    reads = sorted({s[i : i + 36] for s in seqs for i in range(0, max(1, len(s) - 35), 1 if seed < 5 else 4)})
    u, links, g, name, e = graph_of(spark, counted(seqs, k), k)
    nodes, links = cleanup.condensed(u, G.prevalences(u, e, k), links)
    before = len(g.seq)
    g.bridge_all(reads)
    nodes, links = bridging.bridge_all(nodes, links, spark.createDataFrame([(r,) for r in reads], "seq string"), k)
    rows = {r.id: r for r in nodes.collect()}
    got = sorted((r.seq, round(r.prevalence, 6), r.n) for r in rows.values())
    assert got == sorted((g.seq[v], round(g.prevalence[v], 6), g.size[v]) for v in g.seq) and len(g.seq) != before
    assert sorted((rows[r.src].seq, rows[r.dst].seq, r.overlap) for r in links.collect()) == sorted((g.seq[a], g.seq[b], o) for a in g.out for b, o in g.out[a].items())


def test_a_node_with_a_loop_is_bridged(spark):
    from readloom.operators import bridging

    nodes = spark.createDataFrame([("p", "TTACA", 2.0, 1), ("v", "ACAC", 4.0, 1), ("q", "CACGG", 2.0, 1)], "id string, seq string, prevalence double, n long")
    links = spark.createDataFrame([("p", "v", 3), ("v", "v", 2), ("v", "q", 3)], "src string, dst string, overlap int")
    nodes, links = bridging.bridge_all(nodes, links, spark.createDataFrame([("TTACACACGG",)], "seq string"), 4)
    assert [r.seq for r in nodes.collect()] == ["TTACACACGG"] and links.count() == 0
