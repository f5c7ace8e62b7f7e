"""k-mers dealt in runs against plain Python."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readloom.operators import contigs as C
from readloom.operators import kmers as K
from readloom.operators import superkmers as X

_RC = str.maketrans("ACGT", "TGCA")


def _reads():
    rnd = random.Random(5)
    out = ["".join(rnd.choices("ACGT", k=rnd.randint(0, 300))) for _ in range(60)]
    out += ["A" * 200, "AC" * 100, out[0], out[0][::-1].translate(_RC), None, "", "ACGT" * 6, "AAAAAAAAAAAACTTTTTTTTTTTT"]
    return out + ["".join(rnd.choices("ACGTN", weights=(30, 30, 30, 30, 1), k=250)) for _ in range(20)] + ["É" + out[1]]


def _kmers(seq, k):
    return [seq[i : i + k] for i in range(len(seq or "") - k + 1) if set(seq[i : i + k]) <= set("ACGT")]


@pytest.mark.parametrize("k", [16, 24, 25, 31])
@pytest.mark.parametrize("is_canonical", [False, True])
def test_counts_equal_plain_ones(spark, monkeypatch, k, is_canonical):
    reads = _reads()
    one = (lambda x: min(x, x[::-1].translate(_RC))) if is_canonical else (lambda x: x)
    want = Counter(one(x) for s in reads for x in _kmers(s, k))
    got = K.count_kmers(spark.createDataFrame([(s,) for s in reads], "seq string"), k, is_canonical=is_canonical)
    assert {r.kmer: r.cnt for r in got.collect()} == dict(want)


def test_tally_settles_in_between(monkeypatch):
    monkeypatch.setattr(X, "SORTED", 50)
    rnd, t, want = np.random.default_rng(1), X.Tally(), Counter()
    for _ in range(40):
        x = rnd.integers(0, 200, 17).astype(np.uint64)
        t.add(x)
        want.update(x.tolist())
    keys, counts = t.settle()
    assert dict(zip(keys.tolist(), counts.tolist())) == want and (np.diff(keys.astype(np.int64)) > 0).all()


def test_a_kmer_costs_less_than_three_bytes_to_deal(spark):
    """A row a k-mer, as before, was some 30 bytes and more."""
    rnd = random.Random(3)
    reads = spark.createDataFrame([("".join(rnd.choices("ACGT", k=100)),) for _ in range(2000)], "seq string")
    size = X.deal(reads, 25, 8).agg(F.sum(F.length("bases"))).first()[0]
    assert size < 3 * 76 * 2000


def _contigs():
    rnd = random.Random(9)
    base = ["".join(rnd.choices("ACGT", k=400)) for _ in range(5)]
    out = [b[i : i + 200] for b in base for i in (0, 90, 200)] + ["A" * 60, "A" * 40 + "C" * 40, base[0], base[0], "ACG", base[1][:150] + "N" + base[2][:150]]
    out += ["".join(rnd.choices("ACGT", k=rnd.randint(20, 80))) for _ in range(20)]
    return list(enumerate(out, 100))


def test_contig_edges_and_links_equal_plain_ones(spark, monkeypatch):
    rows, k = _contigs(), 24
    at, want = {}, Counter()
    for c, s in rows:
        for x in _kmers(s, k):
            at.setdefault(x, Counter())[c] += 1
    for n in at.values():
        for a in n:
            for b in n:
                if a < b:
                    want[a, b] += n[a] * n[b]
    df = spark.createDataFrame(rows, "contig_id long, seq string")
    assert {(r.src, r.dst): r.w for r in C.contig_edges(df, k).collect()} == dict(want)
    # a few pairs at once give the same sums
    assert {(r.src, r.dst): r.w for r in X.shared(df, k, "contig_id", 10).collect()} == dict(want)
    root = {c: c for c, _ in rows}

    def find(c):
        return c if root[c] == c else find(root[c])

    for a, b in want:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    links = C.contig_links(df, k)
    assert {(r.src, r.dst) for r in links.collect()} <= set(want)
    assert {r.contig_id: r.comp for r in C.contig_components(df, links).collect()} == {c: find(c) for c in root}


def test_links_over_several_blocks(spark):
    """The least key of a k-mer comes last: links to what was least before join them all."""
    rows = [(9 - i, "ACGTTGCAAGCTTACGGATCCATGCA" + "ACGT"[i % 4] * i) for i in range(9)]
    batches = [pa.RecordBatch.from_arrays([_part(s), pa.array([np.int64(c).tobytes()])], ["bases", "keys"]) for c, s in rows]
    pairs = [p for b in X.link_blocks(iter([(x, i) for b in batches for x, i in X.keyed([b], 24, 1)])) for p in zip(*b.to_pydict().values())]
    assert all(a < b for a, b in pairs) and {b for _, b in pairs} == set(range(2, 10))


def _part(s):
    codes = X._CODE[np.frombuffer(s.encode() + b"\n", np.uint8)]
    return pa.array([X._packed(codes, np.array([0]), np.array([len(s)]), np.array([0]))[0].tobytes()])


def test_contig_weights_equal_plain_ones(spark):
    rows, k = _contigs(), 25
    k1 = {x: i for i, x in enumerate(sorted({x for _, s in rows for x in _kmers(s, k)})) if i % 3}
    got = C.contig_weights(spark.createDataFrame(rows, "contig_id long, seq string"), spark.createDataFrame(list(k1.items()), "kmer string, cnt long"), k)
    want = {c: (len(s) - k + 1, sum(k1.get(x, 0) for x in _kmers(s, k)) / (len(s) - k + 1)) for c, s in rows if len(s) >= k}
    assert {r.contig_id: (r.n_kmers, r.avg_wt) for r in got.collect()} == want


def test_routes_equal_those_by_a_table_of_kmers(spark, monkeypatch):
    rows = _contigs()
    contigs = spark.createDataFrame(rows, "contig_id long, seq string")
    comps = spark.createDataFrame([(c, c % 4) for c, _ in rows], "contig_id long, comp long")
    want = {(x, c % 4) for c, s in rows for x in _kmers(s, 25)}
    table = C.kmer_components(contigs, comps)
    got = [tuple(r) for r in table.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    reads = spark.createDataFrame([(-i, s[:100]) for i, s in rows], "read_id long, seq string")
    old = C.route(reads, "read_id", ["seq"], table)
    new = C.route_over(reads, "read_id", ["seq"], contigs, comps)
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect()))


def test_places_equal_plain_ones(spark):
    rows, k = _contigs(), 24
    ends = sorted({s[:k] for _, s in rows if len(s) >= k and "N" not in s[:k]})
    got = X.places_of(spark.createDataFrame(rows, "contig_id long, seq string"), spark.createDataFrame([(e,) for e in ends], "kmer string"), k, "contig_id")
    want = [(s[i : i + k], c, i + 1) for c, s in rows for i in range(len(s) - k + 1) if s[i : i + k] in ends]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("k", [8, 33])
def test_edges_of_other_widths_equal_plain_ones(spark, k):
    rows, want = _contigs()[:12], Counter()
    for a, s in rows:
        for b, t in rows:
            if a < b:
                x, y = Counter(_kmers(s, k)), Counter(_kmers(t, k))
                if n := sum(x[z] * y[z] for z in x):
                    want[a, b] = n
    df = spark.createDataFrame(rows, "contig_id long, seq string")
    assert {(r.src, r.dst): r.w for r in C.contig_edges(df, k).collect()} == dict(want)
    low = {r.contig_id: r.comp for r in C.contig_components(df, C.contig_links(df, k)).collect()}
    assert low == {r.contig_id: r.comp for r in C.contig_components(df, C.contig_edges(df, k)).collect()}
    k1 = spark.createDataFrame([(z, 2) for z in {z for _, s in rows for z in _kmers(s, k)}], "kmer string, cnt long")
    assert {r.avg_wt for r in C.contig_weights(df.where("not seq like '%N%'"), k1, k).collect()} == {2.0}
    assert C.kmer_components(df, df.selectExpr("contig_id", "1L comp"), k).count() == k1.count()


def test_common_words_equal_plain_ones_and_stay_out_of_lambdas(spark):
    """Lists of substrings were made and hashed row by row, each of them several times."""
    rnd = random.Random(6)
    rows = [(i, "".join(rnd.choices("ACGT", k=rnd.randint(0, 100))), "".join(rnd.choices("ACGT", k=rnd.randint(0, 100)))) for i in range(200)]
    rows += [(-1, "A" * 50, "A" * 50), (-2, "", "ACG"), (-3, "AC", "ACGTNACGT"), (-4, "ACGTACGT" * 9, "ACGTACGT" * 9)]
    words = lambda s: set(_kmers(s, 3))
    comp = str.maketrans("ACGT", "TGCA")
    want = {}
    for i, a, b in rows:
        three = words(a) & words(b) & words(a[::-1])
        want[i] = (len(three), len(three & words(b[::-1]) & words(a.translate(comp))))
    got = X.common_words(spark.createDataFrame(rows, "pair_id long, seq1 string, seq2 string"), "pair_id")
    assert {r.pair_id: (r.n_common, r.n_common5) for r in got.collect()} == want
    assert "array_intersect" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("share,strict,shortest", [(0.99, False, 0), (0.9, True, 70), (0.5, True, 0)])
def test_contigs_covered_by_greater_ones_equal_plain_ones_without_all_pairs(spark, monkeypatch, share, strict, shortest):
    """Every pair of contigs was listed for each 18-mer that it shares: 30 copies of a line were 30 x 29 rows a place."""
    rnd, r = random.Random(4), 18
    rows = [(c, s) for c, s in _contigs() if "N" not in s]
    line = "".join(rnd.choices("ACGT", k=60))
    rows += [(500 + i, line * 3 + line[: rnd.randint(0, 59)]) for i in range(15)] + [(600 + i, line) for i in range(15)]
    for i, (_, s) in enumerate(rows[:12]):  # copies with errors, cut and whole
        p = rnd.randrange(len(s))
        rows += [(700 + i, s[:p] + rnd.choice("ACGT") + s[p + 1 :]), (800 - i, s[rnd.randint(0, 30) : 380])]
    words = {c: set(_kmers(s, r)) for c, s in rows}
    want = set()
    for q, a in rows:
        for t, b in rows:
            at = [i for i in range(len(a) - r + 1) if a[i : i + r] in words[t]] if q != t else []
            m = len({j for i in at for j in range(i, i + r)})
            enough = m > share * len(a) if strict else m >= share * len(a)
            if m and (len(a) < shortest or enough and (len(a), q) < (len(b), t)):
                want.add(q)
    df = spark.createDataFrame(rows, "contig_id long, seq string")
    listed = []
    greater = X.greater_holders
    monkeypatch.setattr(X, "greater_holders", lambda *a: listed.append(greater(*a)) or listed[-1])
    assert {x.contig_id for x in C.covered_by_greater(df, share, r, strict, shortest).collect()} == want
    assert 0 < len(want) < len(rows) and sum(x.count() for x in listed) < len(rows) ** 2 / 8


def test_near_keys_equal_plain_ones_and_meet_by_twelve_bases(spark):
    """Slices of eight bases have 65,536 values: a bucket, and pairs in it, grew with the square of the input."""
    rnd = random.Random(11)
    keys = ["".join(rnd.choices("ACGT", k=24)) for _ in range(40)] + ["ACGTACGT" + "".join(rnd.choices("ACGT", k=16)) for _ in range(40)]
    queries = keys[::3] + ["".join(rnd.choices("ACGT", k=24)) for _ in range(9)]
    for s in keys[:30] * 3:
        for _ in range(rnd.randint(1, 3)):
            p = rnd.randrange(24)
            s = s[:p] + rnd.choice("ACGT") + s[p + 1 :]
        queries.append(s)
    queries = sorted(set(queries))
    want = sorted((q, k, n) for q in queries for k in keys if (n := sum(a != b for a, b in zip(q, k))) <= 2)
    q, k = (spark.createDataFrame([(x,) for x in v], f"{n} string") for v, n in ((queries, "query"), (keys, "key")))
    got = C.near_keys(q, k, "query", "key")
    assert sorted(map(tuple, got.collect())) == want and {n for *_, n in want} == {0, 1, 2}


def test_counts_of_components_equal_those_by_a_join(spark):
    rows = _contigs()
    contigs = spark.createDataFrame(rows, "contig_id long, seq string")
    comps = spark.createDataFrame([(c, c % 4) for c, _ in rows], "contig_id long, comp long")
    reads = spark.createDataFrame([(s,) for _, s in rows[::2] * 2] + [("N",), (None,)], "seq string")
    want = Counter(x for _, s in rows[::2] * 2 for x in _kmers(s, 25))
    want = {(x, c % 4, want[x] if want[x] >= 3 else 0) for c, s in rows for x in _kmers(s, 25)}
    got = C.kmer_counts_of_components(contigs, comps, reads, 25, 3)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and {n > 0 for *_, n in want} == {True, False}


def test_pairs_are_cut_without_a_join(spark, tmp_path):
    from readloom.sources import dna

    texts = ["abcd" * 80 + "xyz" * 30, "abc" * 33, "q" * 200, "ab" * 150, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dna.pairs(spark, str(tmp_path))
    reads = {r.read_id: r.seq for r in dna.reads(spark, str(tmp_path)).collect()}
    want = {(i, s, reads[i + 1][::-1].translate(_RC)) for i, s in reads.items() if i + 1 in reads}
    assert {tuple(r) for r in got.collect()} == want and len(want) == 6
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_places_without_equal_plain_ones(spark):
    from readloom.operators import correction

    rows, k = _contigs(), 24
    known = sorted({x for _, s in rows[::2] for x in _kmers(s, k)})
    df = spark.createDataFrame(rows, "read_id long, seq string")
    for good in (known, []):
        table = spark.createDataFrame([(x,) for x in good], "kmer string")
        want = {c: [i + 1 for i in range(len(s) - k + 1) if s[i : i + k] not in set(good)] for c, s in rows}
        got = correction.untrusted(df, table, k)
        assert {r.read_id: r.bad for r in got.collect()} == {c: bad for c, bad in want.items() if bad}
    # a row a stretch, not one a k-mer
    assert X.places_without(df, spark.createDataFrame([(x,) for x in known], "kmer string"), k, "read_id").count() < sum(map(len, want.values())) / 3


def test_small_components_are_solved_together(spark):
    """A grouped map called Python once a component, most of which are an edge or two."""
    from readloom.plans.assembly import component_paths

    df = spark.createDataFrame([(10 * i, 10 * i + 1, 2.0) for i in range(300)], "a long, b long, w double")
    got = component_paths(df)
    assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.component, r.path, r.weight) for r in got.collect()) == [(10 * i, [10 * i, 10 * i + 1], 2.0) for i in range(300)]
