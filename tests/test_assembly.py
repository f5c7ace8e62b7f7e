"""Graph core and flow on planted truth, and their invariants."""

import itertools
import random

import numpy as np
import pytest

from readloom.operators import assembly as A, flow, variants as V


def seq(rnd, n):
    return "".join(rnd.choice("ACGT") for _ in range(n))


def kmers(ts, k=25):
    out = {}
    for t, c in ts:
        for i in range(len(t) - k + 1):
            out[t[i : i + k]] = out.get(t[i : i + k], 0) + c
    return out


@pytest.fixture
def exons():
    rnd = random.Random(4)
    return [seq(rnd, 150) for _ in range(5)] + [seq(rnd, 60)]


@pytest.mark.parametrize("case", range(4))
def test_planted_isoforms_are_recovered(exons, case):
    a, b, c, d, e, s = exons
    ts = [[(a + s + b, 5), (c + s + d, 9)], [(a + s + b, 3), (c + s + d, 3)], [(a + b + c, 4), (a + c, 8)], [(a + b + c + d + e, 7), (a + c + e, 3)]][case]
    out = A.transcripts(kmers(ts), kmers(ts, 100))
    assert sorted(s for s, _, _ in out) == sorted(t for t, _ in ts)
    assert all(w > 0 for _, w, _ in out)


def test_tip_and_bubble_are_removed(exons):
    a, b, c, *_ = exons
    t = a + b + c
    snp = t[:200] + ("A" if t[200] != "A" else "C") + t[201:]
    tip = t[100:130] + seq(random.Random(9), 20)
    ts = [(t, 20), (tip, 1)]
    g = A.clean(kmers(ts), kmers([(t, 20)], 100), 24, 100)
    assert sorted(g.seq.values()) == [t]
    g = A.Graph.from_kmers(kmers([(t, 20), (snp, 2)]), 24)
    g.condense()
    g.collapse()
    g.condense()
    assert sorted(g.seq.values()) == [t]


def test_cycles_are_broken_and_loops_dropped():
    for s in ("ACGTTGCATTAGGCATCCAGTTACG" * 4, "A" * 60):
        g = A.Graph.from_kmers(kmers([(s, 2)], 25), 24)
        g.condense()
        g.break_cycles()
        assert g.find_cycle() is None
    g = A.Graph.from_kmers(kmers([("ACGTTGCATTAGGCATCCAGTTACG" * 4, 2)]), 24)
    c = g.find_cycle()
    assert V.short_cycle(g, c[0])


def test_greedy_contigs_use_each_kmer_once(exons):
    k1 = kmers([(exons[0] + exons[1], 4), (exons[2] + exons[5] + exons[3], 7)])
    made = A.extend_contigs(k1, 3)
    used = [m for s, *_ in made for m in (s[i : i + 25] for i in range(len(s) - 24))]
    assert len(used) == len(set(used)) and set(used) <= set(k1)
    assert sorted(s for s, *_ in made) == sorted([exons[0] + exons[1], exons[2] + exons[5] + exons[3]])
    assert A.suppress_duplicates([(1, made[0][0]), (2, made[0][0][20:]), (3, made[1][0])]) == {2}


def test_partition_is_balanced_and_cuts_little():
    rnd = random.Random(1)
    nodes = list(range(120))
    edges = [(a, b, 5.0) for g in range(4) for a, b in itertools.combinations(range(g * 30, g * 30 + 30), 2) if rnd.random() < 0.3]
    edges += [(g * 30, g * 30 + 30, 1.0) for g in range(3)]
    label = A.partition_graph(nodes, edges, 4)
    sizes = [list(label.values()).count(p) for p in range(4)]
    assert len(label) == 120 and max(sizes) <= 2 * 30
    assert sum(w for a, b, w in edges if label[a] != label[b]) < 0.25 * sum(w for *_, w in edges)


def test_transport_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        m, n = rng.integers(2, 4, 2)
        a, b = rng.integers(1, 5, m).astype(float), rng.integers(1, 5, n).astype(float)
        b[-1] += max(a.sum() - b.sum(), 0)
        a[-1] += max(b.sum() - a.sum(), 0)
        cost = rng.random((m, n))
        x = flow.transport(a, b, cost)
        assert np.allclose(x.sum(1), a) and np.allclose(x.sum(0), b) and (x >= -1e-9).all()
        best = min(_all_costs(a.astype(int).tolist(), b.astype(int).tolist(), cost))
        assert (x * cost).sum() == pytest.approx(best)


def _all_costs(a, b, cost, i=0):
    if i == len(a):
        yield 0.0
        return
    for row in itertools.product(*(range(min(a[i], y) + 1) for y in b)):
        if sum(row) == a[i]:
            for rest in _all_costs(a, [y - r for y, r in zip(b, row)], cost, i + 1):
                if i + 1 < len(a) or all(y == r for y, r in zip(b, row)):
                    yield rest + float((np.array(row) * cost[i]).sum())


def test_node_decomposition_limits():
    a, b = [5, 7, 9], [5, 16]
    x = flow.decompose_node(a, b, np.ones((3, 2)), 0, sparsity=3)
    assert (x > 0).sum() <= 3 and x.sum() <= 21 + 1e-9
    known = np.array([[1, 0], [0, 1], [0, 1]])
    x = V.decompose_on_known_paths(a, b, known)
    assert (x[known == 0] == 0).all() and x[0, 0] == pytest.approx(5)
    assert flow.decompose_node([0, 0], [1, 2], np.ones((2, 2)), 0).sum() == 0
    many = flow.decompose_node(np.ones(6), np.ones(6), np.zeros((6, 6)), 1)
    assert (many > 0).sum() <= 10


def test_smoothing_is_optimal_on_small_graphs():
    rnd = random.Random(3)
    for _ in range(25):
        e = {p: float(rnd.randint(0, 4)) for p in [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (3, 4)] if rnd.random() < 0.9}
        inner = {u for u, _ in e} & {v for _, v in e}
        fits = lambda x: all(abs(sum(f for (_, b), f in x.items() if b == v) - sum(f for (a, _), f in x.items() if a == v)) < 1e-6 for v in inner)  # noqa: E731, B023
        flows = [dict(zip(e, f)) for f in itertools.product(range(6), repeat=len(e))]
        flows = [x for x in flows if fits(x)]
        got = V.smooth_copy_counts(e, 1)
        assert fits(got) and min(got.values()) >= 0
        assert sum(abs(got[k] - e[k]) for k in e) == pytest.approx(min(sum(abs(x[k] - e[k]) for k in e) for x in flows), abs=1e-6)
        got = V.smooth_copy_counts(e, 2)
        cost = sum((got[k] - e[k]) ** 2 for k in e)
        assert fits(got) and min(got.values()) >= 0
        assert cost <= min(sum((x[k] - e[k]) ** 2 for k in e) for x in flows) + 1e-6
        # no point on the way to a whole-number flow is better
        for x in rnd.sample(flows, min(len(flows), 30)):
            near = {k: got[k] + 0.01 * (x[k] - got[k]) for k in e}
            assert sum((near[k] - e[k]) ** 2 for k in e) >= cost - 1e-7


def test_smoothing_conserves_flow():
    e = {(0, 1): 5.0, (2, 1): 4.0, (1, 3): 6.0, (3, 4): 8.0}
    for norm in (1, 2):
        x = V.smooth_copy_counts(e, norm)
        assert x[0, 1] + x[2, 1] == pytest.approx(x[1, 3], abs=1e-3) and x[1, 3] == pytest.approx(x[3, 4], abs=1e-3)


def test_small_variants(exons):
    assert V.fragments([(1, 5), (10, 20)], [(4, 8), (30, 40)]) == [(1, 8)]
    assert V.eulerian_walk([(1, 2), (2, 3), (3, 1), (1, 4)]) == [1, 2, 3, 1, 4]
    assert V.eulerian_walk([(1, 2), (3, 4)]) is None
    g = A.Graph.from_kmers(kmers([(exons[0] + exons[5] + exons[1], 1), (exons[2] + exons[5] + exons[3], 1)]), 24)
    g.condense()
    assert exons[0] + exons[5] + exons[3] in V.all_sequences(g)


def test_edges_cut_from_cycles_are_the_lightest_and_leave_none():
    rnd = random.Random(5)
    for n in (2, 3, 5, 9, 30):
        for _ in range(40):
            edges = {(a, b): float(rnd.randint(1, 9)) for a, b in itertools.permutations(range(n), 2) if rnd.random() < 2 / n}
            left, cut = flow.acyclic(edges)
            out = {v: [b for a, b in left if a == v] for v in range(n)}
            assert len(flow.topological(range(n), out)) == n
            assert left | cut == edges and not left.keys() & cut.keys()
    assert flow.acyclic({(1, 2): 5.0, (2, 3): 1.0, (3, 1): 4.0})[1] == {(2, 3): 1.0}


def test_component_paths_with_a_cycle_a_ring_and_a_large_component(spark):
    from readloom.plans.assembly import component_paths

    cycle = [(1, 2, 9.0), (2, 3, 9.0), (3, 4, 9.0), (3, 2, 1.0)]  # source 1, sink 4
    ring = [(11, 12, 3.0), (12, 13, 2.0), (13, 11, 4.0)]
    star = [(100 + i, 50_000, 1.0) for i in range(10_001)]  # more partial paths than the default limit
    d = spark.createDataFrame(cycle + ring + star, "a long, b long, w double")
    got = {}
    for r in component_paths(d).collect():
        got.setdefault(r.component, {})[tuple(r.path)] = r.weight
    assert got[1] == {(1, 2, 3, 4): 9.0, (3, 2): 1.0}
    assert got[11] == {(13, 11, 12): 3.0, (12, 13): 2.0}
    assert got[100] == {(100 + i, 50_000): 1.0 for i in range(10_001)}


def test_all_sequences_gives_more_than_a_thousand_walks():
    from types import SimpleNamespace

    n = 33  # eleven bubbles: 0 to 1 or 2 to 3, and so on
    out = {v: [v + 1, v + 2] if v % 3 == 0 else [v - v % 3 + 3] for v in range(n)} | {n: []}
    inn = {v: [u for u in out if v in out[u]] for v in out}
    got = V.all_sequences(SimpleNamespace(seq=dict.fromkeys(out, ""), out=out, inn=inn, spell=lambda p: "-".join(map(str, p))))
    assert len(got) == len(set(got)) == 2**11


def mates(t, c, apart=200, n=100):
    return [(t[i : i + n], t[i + apart : i + apart + n]) for i in range(len(t) - apart - n + 1) for _ in range(c)]


def test_mates_tell_isoforms_apart_that_reads_cannot():
    rnd = random.Random(11)
    a, b, c, d = (seq(rnd, 220) for _ in range(4))
    s = seq(rnd, 130)  # longer than a read: k-mers and reads are the same for both cases
    right = []
    for ts in ([(a + s + b, 6), (c + s + d, 6)], [(a + s + d, 6), (c + s + b, 6)]):
        k1, reads = kmers(ts), kmers(ts, 100)
        pairs = [p for t, w in ts for p in mates(t, w)]
        want = sorted(t for t, _ in ts)
        assert sorted(x for x, _, _ in A.transcripts(k1, reads, pairs)) == want
        right.append(sorted(x for x, _, _ in A.transcripts(k1, reads)) == want)
    assert not all(right)


def test_path_weight_is_summed_weight_over_summed_length():
    nodes, edges = {0: 6.0, 1: 6.0, 2: 4.0, 3: 2.0}, {(0, 1): 6.0, (1, 2): 4.0, (1, 3): 2.0}
    size = {0: 10, 1: 20, 2: 30, 3: 40}
    got = dict(flow.paths(nodes, edges, [], lengths=size))
    assert got == {(0, 1, 2): pytest.approx(16 / 60), (0, 1, 3): pytest.approx(14 / 70)}
    got = dict(flow.paths(nodes, edges, [], lengths=size, with_start=True))
    assert got[0, 1, 2] == pytest.approx(22 / 60)


def test_paths_conserve_flow_of_balanced_graphs():
    rnd = random.Random(2)
    for _ in range(20):
        true = [((0, m, 3 + k), float(rnd.randint(20, 60))) for k, m in enumerate((1, 2))]
        edges: dict = {}
        for p, w in true:
            for e in zip(p, p[1:]):
                edges[e] = edges.get(e, 0) + w
        nodes = {v: sum(w for p, w in true if v in p) for p, _ in true for v in p}
        assert dict(flow.paths(nodes, edges, [p for p, _ in true])) == pytest.approx(dict(true))


def test_chains_and_feedback_edges():
    assert flow.chains({1: 2.0, 2: 2.0, 3: 2.0, 9: 5.0}, {(1, 2): 2.0, (2, 3): 2.0}) == [((1, 2, 3), 2.0), ((9,), 5.0)]
    with pytest.raises(ValueError):
        flow.chains({1: 1.0, 2: 1.0, 3: 1.0}, {(1, 2): 1.0, (1, 3): 1.0})
    rnd = random.Random(8)
    for n in (2, 4, 9, 25):
        for _ in range(30):
            edges = [(a, b) for a in range(n) for b in range(n) if rnd.random() < 1.8 / n]
            gone = flow.feedback_edges(dict.fromkeys(edges))
            out = {v: [b for a, b in edges if a == v and (a, b) not in gone] for v in range(n)}
            assert len(flow.topological(range(n), out)) == n and gone <= set(edges)
            assert {(v, v) for v in range(n) if (v, v) in edges} <= gone and 2 * len(gone) <= len(edges) + n
    assert flow.feedback_edges({(1, 2): 1, (2, 3): 1}) == set()


def test_a_node_with_an_edge_to_itself_is_bridged():
    g = A.Graph(4)
    p, v, q = g.add("TTACA", 2), g.add("ACAC", 4), g.add("CACGG", 2)
    g.link(p, v, 3)
    g.link(v, v, 2)
    g.link(v, q, 3)
    g.bridge_all(["TTACACACGG"])
    assert list(g.seq.values()) == ["TTACACACGG"]


def test_expected_counts():
    x = A.expected_counts([([0], 30), ([1], 10), ([0, 1], 40)], [100.0, 100.0, 50.0])
    assert x == pytest.approx([60, 20, 0], abs=1e-4)
    assert A.expected_counts([([0, 1], 30)], [100.0, 200.0])[0] == pytest.approx(30, abs=1e-2)
    assert A.expected_counts([], [1.0]) == [0.0]


def test_random_order_partition_is_balanced():
    edges = [(i, i + 1, 1.0) for i in range(99)]
    for s in (1, 2):
        label = A.partition_graph(list(range(100)), edges, 5, seed=s)
        assert len(label) == 100 and max(list(label.values()).count(p) for p in range(5)) <= 40


def test_components_are_worked_on_in_pieces_of_whole_groups():
    import pandas as pd

    from readloom.plans.assembly import whole_groups

    keys = [1, 1, 2, 3, 3, 3, 3, 3, 3, 3, 4, 5, 5]
    frames = [pd.DataFrame({"comp": keys[i : i + 2], "x": range(i, min(i + 2, 13))}) for i in range(0, 13, 2)]
    got = [(first, pdf.comp.tolist(), pdf.x.tolist()) for first, pdf in whole_groups(iter(frames), "comp", rows=3)]
    assert sum((x for *_, x in got), []) == list(range(13)) and len(got) > 2
    assert all(first == c[0] for first, c, _ in got)
    assert sum(len(set(c)) for _, c, _ in got) == len(set(keys))  # no group in two pieces
    assert list(whole_groups(iter([]), "comp")) == []


def test_reads_are_indexed_only_where_a_node_is_ambiguous(monkeypatch):
    g = A.Graph.from_kmers({"ACGTA": 1.0, "CGTAC": 1.0}, 4)
    monkeypatch.setattr(A.Graph, "read_index", None)
    g.bridge_all(["ACGTAC"])
