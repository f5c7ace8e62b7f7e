"""Connected components and helpers on graphs with known answers."""

import random

import pytest

from readloom.operators import components
from readloom.operators.components import connected_components
from readloom.operators.kmers import unitigs
from readloom.operators.numbering import row_numbers


def test_components_of_chain_star_ring_and_random(spark):
    rnd = random.Random(7)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 80)] + [(2000, 2001), (2001, 2002), (2002, 2000)]
    edges += [(rnd.randrange(3000, 3200), rnd.randrange(3000, 3200)) for _ in range(90)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == {v: find(v) for v in parent}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_row_numbers(spark):
    d = spark.range(0, 50).selectExpr("id * 7919 as k")
    got = sorted(map(tuple, row_numbers(d, "k", "n", block=10_000).collect()))
    assert [n for _, n in got] == list(range(1, 51))


def test_unitigs_with_rings(spark):
    e = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "w"), ("w", "x")]
    got = unitigs(spark.createDataFrame([(*p, 1) for p in e], "src string, dst string, cnt long"))
    assert sorted(map(tuple, got.collect())) == [("a", 4, "abcd"), ("w", 3, "wxy")]


def test_too_few_rounds_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long")
    with pytest.raises(RuntimeError):
        connected_components(chain, max_rounds=1).count()


def test_written_minima_change_nothing(spark, monkeypatch):
    e = spark.createDataFrame([(i, i * 7 % 50) for i in range(90)], "src long, dst long")
    want = sorted(map(tuple, connected_components(e).collect()))
    monkeypatch.setattr(components, "MANY", 1)
    assert sorted(map(tuple, connected_components(e).collect())) == want


def test_shared_folder_is_wanted_on_a_cluster():
    from types import SimpleNamespace

    from readloom.session import shared_dir

    unset = SimpleNamespace(get=lambda k, d: d)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="yarn")))


def test_finished_components_take_no_part_in_later_rounds(spark, monkeypatch):
    from readloom.session import Tables

    seen, save = [], Tables.save

    def counted(self, df, name="t"):
        out = save(self, df, name)
        seen.extend([out.count()] if name == "round" else [])
        return out

    monkeypatch.setattr(Tables, "save", counted)
    pairs = [(10_000 + 2 * i, 10_001 + 2 * i) for i in range(500)]
    comb = [(i, i + 1) if i % 2 else (i + 1, 2000 + i) for i in range(60)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(pairs + comb, "src long, dst long")).collect()))
    assert all(got[a] == got[b] == a for a, b in pairs) and len(seen) > 0
    assert max(seen) < len(comb)


def test_few_edges_are_finished_at_once(spark, monkeypatch):
    from readloom.session import Tables

    seen, save = [], Tables.save
    monkeypatch.setattr(Tables, "save", lambda self, df, name="t": seen.append(name) or save(self, df, name))
    rnd = random.Random(3)
    e = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(300)]
    for kind, cast in (("long", int), ("string", "n{:03d}".format)):
        df = spark.createDataFrame([(cast(a), cast(b)) for a, b in e], f"src {kind}, dst {kind}")
        seen.clear()
        got = sorted(map(tuple, connected_components(df).collect()))
        assert seen.count("round") == 1
        monkeypatch.setattr(components, "FEW", 0)
        assert sorted(map(tuple, connected_components(df).collect())) == got
        monkeypatch.setattr(components, "FEW", 300_000)


def test_links_of_a_bin_by_repeated_kmers_alone(spark):
    import numpy as np

    from readloom.operators import superkmers as X

    rng = np.random.default_rng(3)
    x, ids = rng.integers(0, 4000, 5000).astype(np.uint64), rng.integers(0, 900, 5000)
    at = X.repeated(x)
    values, n = np.unique(x, return_counts=True)
    assert set(np.flatnonzero(np.isin(x, values[n > 1]))) <= set(at.tolist()) and len(at) < len(x)
    pairs = lambda made: {p for b in made for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    assert pairs(X.links_of_bin(iter([(x, ids)]))) == pairs(X.link_blocks(iter([(x, ids)])))


def test_windows_of_long_odd_and_missing_texts(spark, tmp_path):
    from readloom.functions import sequence as S
    from readloom.sources import dna

    texts = [(1, "aB-cé\n" * 700), (2, None), (3, ""), (None, "xyz" * 50), (5, "ßſ𝔞 7"), (6, "a" * 400), (7, "Ab" * 12345)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    to = str.maketrans(S.LETTERS, S.BASES)
    seqs = [(d, "".join(c for c in t if c in S.LETTERS).translate(to)) for d, t in texts if t is not None]
    name = lambda d, j: None if d is None else d * dna.SPAN + j
    order = lambda rows: sorted(rows, key=str)
    cut = lambda width, stride, whole: [(name(d, j), s[j * stride : j * stride + width]) for d, s in seqs for j in range((len(s) - width) // stride + 1 if whole else -(-len(s) // stride)) if len(s) >= (width if whole else 1)]
    got = lambda df: order(map(tuple, df.collect()))
    assert got(dna.sequences(spark, str(tmp_path))) == order(seqs)
    assert got(dna.contigs(spark, str(tmp_path)).select("contig_id", "seq")) == order(cut(400, 400, False))
    assert got(dna.reads(spark, str(tmp_path)).select("read_id", "seq")) == order(cut(100, 100, True))
    assert got(dna.overlapping_reads(spark, str(tmp_path))) == order(cut(100, 25, True))
    pairs = [(i, s[:100], s[200:][::-1].translate(str.maketrans("ACGT", "TGCA"))) for i, s in cut(300, 25, True)]
    assert got(dna.overlapping_pairs(spark, str(tmp_path))) == order(pairs)
    assert "MapInArrow" in dna.contigs(spark, str(tmp_path))._jdf.queryExecution().toString()


def test_pairs_are_counted_without_listing_those_of_frequent_kmers(spark, monkeypatch):
    from readloom.operators import contigs as C
    from readloom.operators import superkmers as X

    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choices("ACGT", k=n))
    phrases, near = [word(60) for _ in range(3)], [word(80) for _ in range(6)]
    rows = [word(rnd.randint(0, 30)) + (rnd.choice(phrases)[rnd.randint(0, 30) :] if i % 2 else "") + (rnd.choice(near) if i % 5 == 0 else "") for i in range(150)]
    rows += [word(20) + phrases[0] + phrases[1]] * 30 + ["ACGT", ""]
    c = spark.createDataFrame(list(enumerate(rows)), "contig_id long, seq string").repartition(3)
    kmers = [{s[i : i + 24] for i in range(len(s) - 23)} for s in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if kmers[a] & kmers[b]]
    got = C.pair_counts(c, most=8).join(C.contig_components(c, C.contig_links(c)), "contig_id").groupBy("comp").sum("n")
    comp = dict(map(tuple, C.contig_components(c, C.contig_links(c)).collect()))
    want = {}
    for a, _ in pairs:
        want[comp[a]] = want.get(comp[a], 0) + 1
    assert dict(map(tuple, got.collect())) == want
    listed = X.sharing(c, 24, "contig_id", 8).where("kind = 'pair'").select("src", "dst").distinct().count()
    assert listed < len(pairs) // 4


def test_long_sides_are_not_broadcast_by_the_bytes_of_their_files(spark, monkeypatch):
    """Files of packed ids below Spark's limit of 10 MB were hash tables of some hundred MB in the driver."""
    from readloom import session
    from readloom.operators import components

    monkeypatch.setattr(session, "DEALT", 100)
    monkeypatch.setattr(components, "FEW", 0)
    plans = []
    save = session.Tables.save
    monkeypatch.setattr(session.Tables, "save", lambda self, df, name="t": plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or save(self, df, name))
    e = spark.range(2000).selectExpr("id src", "id + 1 + id % 3 * 7 dst")
    want = components.connected_components(e).groupBy("component").count().collect()
    assert sum(r["count"] for r in want) == 2000 + len({i + 1 + i % 3 * 7 for i in range(2000)} - set(range(2000)))
    assert any("SortMergeJoin" in p for _, p in plans) and not [n for n, p in plans[:4] if "BroadcastHashJoin" in p]
