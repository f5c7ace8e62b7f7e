"""Nodes with all of their edges in a bin against plain Python."""

import random
from collections import Counter

import pytest

from readloom.functions import sequence as S
from readloom.operators import graph as G
from readloom.operators import kmers as K
from readloom.operators import laying as L
from readloom.operators import nodebins as N
from readloom.operators import superkmers as X

_RC = str.maketrans("ACGT", "TGCA")


def _reads():
    rnd = random.Random(8)
    base = ["".join(rnd.choices("ACGT", k=rnd.randint(0, 260))) for _ in range(12)]
    out = [b[i:] + b[:i] for b in base for i in (0, 40, 90)] + [b[:70] + c[70:] for b, c in zip(base, base[1:])] * 2
    ring = "ACGGTCATTGCAAGCTTAGGCCATACCGATTGACA"
    out += ["A" * 90, "AC" * 60, ring * 4, ring[:7] * 9, None, "", "ACGT" * 6, base[0][:60] + "N" + base[0][60:], "É" + base[1]]
    return out


def _edges(reads, k, hard):
    n = Counter(s[i : i + k + 1] for s in reads for i in range(len(s or "") - k) if set(s[i : i + k + 1]) <= set("ACGT"))
    return {e: c for e, c in n.items() if c >= hard}


@pytest.fixture(params=[1, 7, 40])
def bins(request, monkeypatch):
    monkeypatch.setattr(X, "bins_for", lambda df: request.param)


@pytest.mark.parametrize("k", [16, 24, 30])
@pytest.mark.parametrize("hard", [1, 3])
def test_nodes_equal_plain_ones(spark, bins, k, hard):
    edges = _edges(_reads(), k, hard)
    want = {}
    for e, c in edges.items():
        for node, i, o in ((e[:-1], 0, 1), (e[1:], 1, 0)):
            x = want.setdefault(node, [0, 0, 0, 0, None, None])
            want[node] = [x[0] + i, x[1] + o, x[2] + i * c, x[3] + o * c, *x[4:]]
    for e, c in sorted(edges.items(), key=lambda x: (x[1], -"AGCT".index(x[0][-1]))):
        want[e[:-1]][4:] = [e[1:], c]
    got = N.nodes(spark.createDataFrame([(s,) for s in _reads()], "seq string"), k, hard).collect()
    assert len(got) == len(want) and {r.node: list(r)[1:] for r in got} == want


@pytest.mark.parametrize("k", [16, 25])
def test_both_strands_equal_plain_ones(spark, bins, k):
    reads = spark.createDataFrame([(s,) for s in _reads()], "seq string")
    want = Counter()
    for x, c in _edges(_reads(), k - 1, 2).items():
        want[x] += c
        want[x[::-1].translate(_RC)] += c
    assert {r.kmer: r.cnt for r in N.both_strands(reads, k, 2).collect()} == dict(want)
    assert {r.kmer: r.cnt for r in K.double_strandify(K.count_kmers(reads, k, 2)).collect()} == dict(want)


def test_nodes_are_shuffled_once(spark):
    """A row an edge, grouped by node, was a second shuffle of some 50 bytes an edge."""
    reads = spark.createDataFrame([(s,) for s in _reads()], "seq string")
    for df in (N.nodes(reads, 24, 3), N.both_strands(reads, 25, 3)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_condensed_graph_equals_that_of_edges(spark, bins):
    """Chains and rings that lie in one bin or go through many."""
    from readloom.operators import graph as G

    k, hard = 24, 1
    rows = [(s,) for s in _reads()]
    reads = spark.createDataFrame(rows, "seq string")
    edges = spark.createDataFrame([(e[:-1], e[1:], c) for e, c in _edges(_reads(), k, hard).items()], "src string, dst string, cnt long")
    old = K.unitigs(edges)
    want = {r.first_kmer: (r.n_nodes, r.seq) for r in old.collect()}
    weight = {r.first_kmer: (r.prevalence, r.n) for r in G.prevalences(old, edges, k).collect()}
    u, links = N.condensed(reads, k, hard)
    got = u.collect()
    assert len(got) == len(want) and {r.first_kmer: (r.n_nodes, r.seq) for r in got} == want
    assert {r.first_kmer: (r.prevalence, r.n_nodes) for r in got} == weight
    columns = ["src", "dst", "cnt", "kmer"]
    assert sorted(map(tuple, links.select(columns).collect())) == sorted(map(tuple, G.unitig_graph(old, edges, k).select(columns).collect()))
    assert any(r.src == r.dst and len(r.kmer) == k + 1 for r in links.collect())


def test_support_equals_a_plain_count(spark, bins):
    from readloom.operators import graph as G

    rows = [(i, s) for i, s in enumerate(_reads()) if s and set(s) <= set("ACGT") and len(s) > 24]
    reads = spark.createDataFrame(rows, "read_id long, seq string")
    edges = _edges([s for _, s in rows], 24, 3)
    laid = [(i, s) for i, s in rows if all(s[j : j + 25] in edges for j in range(len(s) - 24))]
    got = G.laid_reads(reads, 3)
    assert laid and sorted(map(tuple, got.select("read_id", "seq").collect())) == sorted(laid)
    asked = sorted(edges)[::3] + ["ACGT" * 6 + "T"]
    n = _edges([s for _, s in laid], 24, 1)
    links = spark.createDataFrame([(e[:-1], e[1:], e) for e in asked], "src string, dst string, kmer string")
    assert {r.src + r.dst[-1]: r.support for r in G.edge_support(got, links).collect()} == {e: n.get(e, 0) for e in asked}


def test_bridges_equal_those_by_joins_and_no_kmer_is_exploded(spark):
    """Every k-mer of every read was a row, with the whole read beside it."""
    rnd = random.Random(12)
    line = "".join(rnd.choices("ACGT", k=70))
    other = "".join(rnd.choices("ACGT", k=70))
    seqs = [line, other, line[:40] + other[40:], other[:35] + line[35:], line[10:50], line[20:60] + "N" + other[20:60], "ACG", line[15:39]] * 3
    seqs += ["".join(rnd.choices("ACGT", k=60)) for _ in range(10)] + [line[5:45][::-1]]
    reads = spark.createDataFrame(list(enumerate(seqs, 7)), "read_id long, seq string")
    for k, hard in ((12, 3), (6, 2)):
        whole = reads.where("seq not like '%N%'")
        n = K.degrees(K.dbg_edges(counts(whole, k + 1, hard), k)).where("indeg >= 2 or outdeg >= 2")
        old, new = G.bridging_reads(n, whole, k), N.bridging_reads(whole, k, hard)
        assert "Generate" not in new._jdf.queryExecution().optimizedPlan().toString()
        want = sorted(map(tuple, old.collect()))
        assert want and sorted(map(tuple, new.collect())) == want
        assert sorted(map(tuple, N.bridged(whole, k, hard).collect())) == sorted(map(tuple, G.bridged(n, old).collect()))


def counts(reads, k, hard):
    return S.explode_kmers(reads, [], "seq", k).groupBy("kmer").count().where(f"count >= {hard}").withColumnRenamed("count", "cnt")


def test_registered_bridges_and_paths_explode_no_kmers(spark, tmp_path):
    import __spark_entry__ as entry

    rnd = random.Random(2)
    texts = ["".join(rnd.choices("abcdefgh", k=420)) for _ in range(4)]
    texts = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts * 3 + [texts[0][:150] + texts[1][150:]] * 3)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("bridging_reads", "bridged_xnodes", "read_paths"):
        out = entry.queries()[name](spark, str(tmp_path))
        assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count()


def test_laid_paths_equal_those_by_joins(spark):
    rnd = random.Random(8)
    a, b = ("".join(rnd.choices("ACGT", k=300)) for _ in range(2))
    texts = [a, b, a[:150] + b[150:], b[:90] + a[90:], (a[:37] * 9)[:300]] * 2
    seqs = [t[i : i + 60] for t in texts for i in range(0, 240, 7)] + ["".join(rnd.choices("ACGT", k=60)) for _ in range(5)] + ["ACGT"]
    reads = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    u, links = N.condensed(reads, 24, 3)
    want = sorted(map(tuple, L.read_paths(reads, u, links).collect()))
    assert max(x[1] for x in want) > 1 and sorted(map(tuple, L.laid_paths(reads, u, 3).collect())) == want
