"""Quality rules, mixing and sharding against brute force, and their edge cases."""

import collections
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from readloom.llm import mixing, quality, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_stats(text):
    text = text or ""
    w = WORD.findall(text)
    windows = collections.defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    hit = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(w),
        sum(map(len, w)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(hit),
    )


def docs(spark):
    base = " ".join(f"w{i}" for i in range(30))
    rows = [
        (1, base, "en", "a", 1),
        (2, base + " " + base + "\n" + base, "en", "a", 1),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (4, "", "en", "b", 0),
        (5, "x\n\nx\n \nx\ty\x0bz # | *$", "de", None, 3),
        (None, "a b c d e f g h " * 40, "de", "b", 3),
        (7, " ".join(["q"] * 9), "fr", "c", 3),
        (8, " word x " + "é" * 5, "fr", "c", 3),
        (9, "long " * 20000, "en", "b", 3),
    ]
    rows += [(100 + i, " ".join(f"t{(i * j) % 97}" for j in range(5 + i)), "en", f"s{i % 4}", 1) for i in range(60)]
    return spark.createDataFrame(rows, SCHEMA)


def test_statistics_match_brute_force(spark):
    got = quality.quality_rules(docs(spark), carry=["doc_id", "text"]).collect()
    assert len(got) == docs(spark).count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_stats(r.text), r.doc_id
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_outliers_are_rejected_and_the_rest_kept(spark):
    import random

    rnd = random.Random(1)
    text = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(60, 400)))
    odd = lambda: " ".join("a#$%" * 9 for _ in range(20)).replace("a", "bq", 3) + " " + text()[:60]
    rows = [(i, text(), "en", "s", 1) for i in range(400)] + [(1000 + i, " ".join(f"{i}{k}#$%&||" for k in range(60)), "en", "s", 1) for i in range(40)]
    got = quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [c for c in got[0].asDict() if c in ("text", "lang")]
    assert all(r.kept for r in got if r.doc_id < 1000)
    assert not any(r.kept for r in got if r.doc_id >= 1000)


def test_texts_with_an_eighth_of_symbols_are_rejected(spark):
    """Symbol shares of 11 to 14 %, and none in the rest of the group."""
    import random

    rnd = random.Random(2)
    word = lambda i, mark: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(4, 9) - (i % 6 < mark))) + "|" * (i % 6 < mark)
    text = lambda mark: " ".join(word(i, mark) for i in range(rnd.randint(60, 400)))
    rows = [(i, text(0), "en", "s", 1) for i in range(400)] + [(1000 + i, text(5), "en", "s", 1) for i in range(20)]
    got = quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(0.11 < r.n_symbols / r.word_chars < 0.15 for r in got if r.doc_id >= 1000)
    assert all(r.kept == (r.doc_id < 1000) for r in got)
    assert not any(r.base_failed for r in got)


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest, weight = total - sum(fixed.values()), sum(w[s] for s in free)
        t = {s: rest * w[s] / weight for s in free}
        over = [s for s in free if t[s] > most * sizes[s]]
        if not over:
            return fixed | t
        fixed |= {s: most * sizes[s] for s in over}


def test_mix_hits_targets(spark):
    got = mixing.mix(docs(spark), seed=3).collect()
    sizes = collections.Counter()
    for r in got:
        assert r.size == len(WORD.findall(r.text or ""))
        sizes[r.source] += r.size
    want = brute_targets(sizes)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3 * largest[s] + 1e-6
    again = mixing.mix(docs(spark).repartition(7), seed=3)
    assert sorted((str(r.doc_id), r.copies) for r in again.collect()) == sorted((str(r.doc_id), r.copies) for r in got)
    emitted = mixing.emit(again, ["doc_id", "text"]).count()
    assert emitted == sum(r.copies for r in got)


def test_shards_are_exact_and_gapless(spark):
    d = spark.range(5003).withColumnRenamed("id", "doc_id").withColumn("text", F.col("doc_id").cast("string"))
    got = sharding.shuffle_into_shards(d, 24, seed=1).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(24)) and len(got) == 5003
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shuffle_into_shards(d.repartition(9), 24, seed=1).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}
    # neighbours do not stay together
    near = sum(a.shard == b.shard for a, b in zip(sorted(got), sorted(got)[1:]))
    assert near < 0.1 * len(got)


def test_hypergeometric_law(spark):
    w, o, n = 30, 50, 20
    u = (F.col("id") + 0.5) / 4000.0
    got = spark.range(4000).select(sharding.hypergeometric(F.lit(w).cast("long"), F.lit(o).cast("long"), F.lit(n).cast("long"), u).alias("k"))
    counts = dict(got.groupBy("k").count().collect())
    for k in range(21):
        want = 4000 * math.comb(w, k) * math.comb(o, n - k) / math.comb(w + o, n)
        assert abs(counts.get(k, 0) - want) <= 1.01


#: Names that operators give to columns of their own, or may come to give.
CLASH = (
    *("size", "kept", "shard", "part", "n_words", "slot", "_g", "h1", "held", "src", "id", "range", "before", "cells", "sub", "k", "_k", "_b"),
    *("g", "x0", "f00", "m0", "n", "b", "d2", "o0", "_text", "_t", "start", "s", "z", "lo", "copies", "_r", "t"),
)


@pytest.mark.parametrize("op", ["quality", "mix", "shard"])
def test_empty_and_clashing_columns(spark, op):
    run = {
        "quality": lambda d: quality.quality_rules(d),
        "mix": lambda d: mixing.mix(d),
        "shard": lambda d: sharding.shuffle_into_shards(d, 3),
    }[op]
    d = docs(spark).withColumns({c: F.lit("clash") for c in CLASH})
    d = d.withColumnRenamed("n_chars", "odd.name")
    assert run(d.limit(0)).count() == 0
    got = run(d)
    assert len(got.columns) == len({c.lower() for c in got.columns})
    assert got.count() == d.count()
    out = {"quality": quality.OUT, "mix": mixing.OUT, "shard": sharding.OUT}[op]
    for c in {*CLASH} - {*out}:
        assert got.where(F.col(c).eqNullSafe("clash")).count() == d.count(), c


def test_one_size_in_ranges_of_ids(spark, monkeypatch):
    rows = [(None if i % 10 == 0 else i * i * 7919 % 10007, "a b" if i % 3 else None, "en", "s", 1) for i in range(300)]
    d = spark.createDataFrame(rows, SCHEMA)
    whole = mixing.mix(d, seed=2).collect()
    monkeypatch.setattr(mixing, "BLOCK", 16)
    split = mixing.mix(d.repartition(5), seed=2).collect()
    key = lambda out: sorted((str(r.doc_id), r.size, r.copies) for r in out if r.doc_id is not None)
    assert key(whole) == key(split) and len(split) == 300
    assert sum(r.copies for r in split) == sum(r.copies for r in whole)


def test_repeated_rows_stay(spark):
    d = spark.createDataFrame([(1, "a b", "en", "s", 3)] * 50, SCHEMA)
    assert sharding.shuffle_into_shards(d, 4).groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 1
    assert mixing.mix(d).agg(F.sum("copies")).first()[0] == 50
    assert zlib.crc32(b"") == 0
