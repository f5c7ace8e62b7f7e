"""Gapped alignment against the whole matrix."""

import random

import numpy as np
import pytest

from readloom.operators import alignment


def whole_matrix(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def mutated(s, rnd):
    out = ""
    for c in s:
        x = rnd.random()
        out += "" if x < 0.02 else c + rnd.choice("ACGT") if x < 0.04 else rnd.choice("ACGT") if x < 0.08 else c
    return out


def test_the_band_holds_the_best_alignment():
    rnd = random.Random(3)
    for _ in range(25):
        core = "".join(rnd.choices("ACGT", k=90))
        a = "".join(rnd.choices("ACGT", k=20)) + core + "".join(rnd.choices("ACGT", k=15))
        b = "".join(rnd.choices("ACGT", k=35)) + mutated(core, rnd)
        score, match, miss, q_gap, t_gap, q0, q1, t0, t1 = alignment.local_alignment(a, b, 15)
        assert score == whole_matrix(a, b) == match - miss - q_gap - t_gap
        assert q1 - q0 == match + miss + t_gap and t1 - t0 == match + miss + q_gap
    assert alignment.local_alignment("AAAA", "", 0)[0] == 0 and alignment.local_alignment("", "ACGT", 0)[0] == 0
    assert alignment.local_alignment("ACGTA", "ACGTA", 0) == (5, 5, 0, 0, 0, 0, 5, 0, 5)


def test_alignments_on_both_strands(spark):
    rnd = random.Random(9)
    refs = ["".join(rnd.choices("ACGT", k=300)) for _ in range(6)]
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = [(i, mutated(r[40:240], rnd)) for i, r in enumerate(refs)] + [(10 + i, flip(mutated(r[:150], rnd))) for i, r in enumerate(refs)]
    reads += [(50, "".join(rnd.choices("ACGT", k=200))), (51, "ACGT"), (52, "")]
    q = spark.createDataFrame(reads, "name long, seq string")
    t = spark.createDataFrame(list(enumerate(refs)), "name long, seq string")
    got = {(int(r.q), int(r.t)): r for r in alignment.align(q, t).collect()}
    for i, ref in enumerate(refs):
        for name, strand in ((i, "+"), (10 + i, "-")):
            r, s = got[name, i], dict(reads)[name]
            assert r.strand == strand and r.score == pytest.approx(whole_matrix(s if strand == "+" else flip(s), ref), abs=0)
    assert not {n for n, _ in got} & {50, 51, 52}
    assert alignment.align(q.limit(0), t).count() == 0


def test_many_pairs_align_as_each_alone_and_seeds_are_those_of_the_hash(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(5)
    a = ["".join(rnd.choices("ACGT", k=rnd.randint(0, 90))) for _ in range(40)]
    b = [mutated(x, rnd) if i % 3 else "".join(rnd.choices("ACGT", k=rnd.randint(0, 60))) for i, x in enumerate(a)]
    d = [rnd.randint(-20, 20) for _ in a]
    rows = alignment.local_alignments([x.encode() for x in a], [x.encode() for x in b], d)
    assert [tuple(map(int, r)) for r in rows] == [alignment.local_alignment(*p) for p in zip(a, b, d)]
    own, code, pos = alignment.minimisers([x.encode() for x in a] + [b"ACGTNNNNNNACGT"])
    k, w = alignment.SEED, alignment.WINDOW
    kmers = sorted({x[i : i + k] for x in a for i in range(len(x) - k + 1)})
    h = dict(map(tuple, spark.createDataFrame([(x,) for x in kmers], "s string").select("s", F.xxhash64("s")).collect()))
    want = set()
    for o, x in enumerate(a):
        at = [(h[x[i : i + k]], i + 1) for i in range(len(x) - k + 1)]
        want |= {(o, min(at[i : i + w])[1]) for i in range(max(len(at) - w + 1, 1)) if at}
    plain = own < len(a)
    assert set(zip(own[plain].tolist(), pos[plain].tolist())) == want
    letters = ["".join("ACGT"[c >> 2 * i & 3] for i in range(k - 1, -1, -1)) for c in code[plain].tolist()]
    assert all(a[o][p - 1 : p - 1 + k] == s for o, p, s in zip(own[plain], pos[plain], letters)) and (code[~plain] < 0).all()
