"""Decontamination, centroid clustering and source divergence against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import centroids, decontam, divergence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
LONG = " ".join(f"w{i % 37}" for i in range(400_000))  # more than one piece of bytes
DOCS = [(1, "The quick, brown a b c d e f g h i j k"), (2, None), (3, ""), (4, "x" * 50 + " Solo! é ÀB 1"), (8, LONG)]
DOCS += [(None, "a b c d e f g h i j a b c d e f g h i j"), (6, "b c d e f g h i j"), (7, "solo solo, SOLO"), (7, "solo solo, SOLO")]
ITEMS = [(1, "a b c d e f g h i j"), (2, "SOLO"), (3, "é àb"), (None, "b c d e f g h i j k"), (5, None), (6, ".. --"), (7, LONG[:200]), (1, "f g h")]


def brute_hits(docs, items):
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                of = windows.get(tuple(w[k : k + n]))
                if of:
                    hit.update(range(k, k + n))
                    found |= of
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    clash = {c: F.lit("clash") for c in ("held", "t", "spans", "items", "window", "odd.name", "_r")}
    return docs.withColumns(clash), spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({"item": F.lit(1), "w": F.lit(1)})


def hits(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in df.collect()), key=str)


@pytest.mark.parametrize("rows", [400_000, 3])
def test_contamination(tables, monkeypatch, rows):
    """Three rows a block make a dozen passes."""
    monkeypatch.setattr(decontam, "ROWS", rows)
    found = decontam.find_contamination(*tables)
    assert hits(found) == brute_hits(DOCS, ITEMS)
    assert found.columns == ["doc_id", "text", "held", "t", "window", "odd.name", "_r", "n_words", "n_hit", "items", "spans", "contaminated"]
    assert all(r.contaminated == (r.n_hit > 0) for r in found.collect())


def test_spans_and_documents_are_removed(spark, tables):
    docs, items = tables
    out = {r.doc_id: r.text for r in decontam.decontaminate(docs, items).collect()}
    assert out[1] == "The quick, brown " and out[2] is None and out[4].endswith("x ! é ÀB 1") and out[7] == "" and out[6] == "b c d e  i j"
    left = decontam.decontaminate(docs, items, "documents")
    assert {r.doc_id for r in left.collect()} == {2, 3} and "n_hit" not in left.columns
    with pytest.raises(ValueError):
        decontam.decontaminate(docs, items, "words")


def test_contamination_of_empty_tables(tables):
    docs, items = tables
    assert decontam.find_contamination(docs.limit(0), items).count() == 0
    none = decontam.find_contamination(docs, items.limit(0))
    assert none.count() == len(DOCS) and none.where("contaminated").count() == 0


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    """With one hash for all windows, only the exact check decides."""
    monkeypatch.setattr(decontam.Text, "windows", lambda self, n: np.zeros(max(0, len(self.hash) - n + 1), np.uint64))
    import pyarrow as pa

    made = decontam.WindowSet(pa.array(["a b", "a c", "a", "c d"]), pa.array(["1", "2", "3", "3"]))
    got = decontam._scan(made, pa.array(["a b a c", "b, A"]), pa.array([[], []], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array([[], []], pa.list_(pa.string())))
    assert got[1].to_pylist() == [4, 1] and got[2].to_pylist() == [["1", "2", "3"], ["3"]]


def brute_clusters(rows, width, k=16, rounds=3):
    good = lambda v: v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, tuple(math.floor(64 * float(x)) for x in v)) for i, v in rows if good(v)]
    if not kept:
        return []
    first = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    z, v = np.array([v for _, v in first]), np.array([v for _, v in kept])
    for r in range(rounds + 1):
        d = ((v[:, None, :] - z[None]) ** 2).sum(2)
        a = d.argmin(1)
        if r < rounds:
            z = np.array([v[a == c].sum(0) // (a == c).sum() if (a == c).any() else z[c] for c in range(len(z))])
    d = d[np.arange(len(v)), a]
    return sorted(((i, int(c), int(x), int(d[a == c].sum()), int(d.sum()), z[c].tolist()) for (i, _), c, x in zip(kept, a, d)), key=str)


def clusters(df, width):
    out = centroids.cluster(df, width=width).collect()
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid)) for r in out), key=str)


@pytest.mark.parametrize("tree", [4096, 50])
def test_clusters(spark, monkeypatch, tree):
    """Repeated ids and rows, ties, a hot vector, and what is left out."""
    monkeypatch.setattr(centroids, "TREE", tree)
    rng = np.random.default_rng(3)
    rows = [(i % 90, [float(x) for x in rng.normal(0, 1, 4).round(1)]) for i in range(700)] + [(1000 + i, [0.5] * 4) for i in range(300)]
    rows += [(None, [1.0, 2.0, 3.0, 4.0]), (5, None), (5, []), (6, [math.nan, 1.0, 1.0, 1.0]), (7, [None, 1.0, 1.0, 1.0]), (8, [1.0] * 5), (9, [math.inf] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(3), "cluster": F.lit(3), "v": F.lit(1)})
    assert clusters(df, 4) == brute_clusters(rows, 4)
    assert clusters(df.limit(0), 4) == [] and clusters(df.limit(5), 4) == brute_clusters(rows[:5], 4)


def test_clusters_of_large_numbers(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 200_000, 3)]) for i in range(300)]
    assert clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3) == brute_clusters(rows, 3)


def test_pruning_leaves_few_rows_to_leaves(monkeypatch):
    """Clusters far apart are given as whole nodes."""
    rng = np.random.default_rng(5)
    z = rng.integers(-10_000, 10_000, (8, 6))
    v = (z[rng.integers(0, 8, 4000)] + rng.integers(-40, 40, (4000, 6))).astype(np.int32)
    seen = []
    exact = centroids._square_distances
    monkeypatch.setattr(centroids, "_square_distances", lambda a, b: seen.append(len(a)) or exact(a, b))
    tree, order = centroids.Tree.over(v)
    won, count, total = tree.filtered(z)
    want = ((v[order][:, None, :].astype(np.int64) - z) ** 2).sum(2).argmin(1)
    assert (won == want).all() and (count == np.bincount(want, minlength=8)).all() and sum(seen) < 400
    assert all((total[c] == v[order][want == c].sum(0)).all() for c in range(8))


def brute_audit(docs, top=200):
    df, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for row in docs:
        t, lang, source = (x or "" for x in row)
        groups.add((lang, source))
        w = TERM.findall(t.translate(LOWER))
        n[lang, source].update(w)
        df[lang].update(set(w))
    out = []
    for lang in {g[0] for g in groups}:
        keep = [t for t, k in df[lang].items() if k >= 3]
        own = [s for a, s in groups if a == lang]
        size = {s: sum(n[lang, s][t] for t in keep) for s in own}
        share = lambda k, of: 1 + 10**9 * (k + 1) // (of + len(keep))
        far = lambda p, q: (p - q) ** 2 // q
        for s in own:
            value = lambda o: sum(far(share(n[lang, s][t], size[s]), share(n[lang, o][t], size[o])) for t in keep)
            rows = sorted((-value(o), o.encode()) for o in own if o != s)
            out += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(rows)]
            both = [(share(n[lang, s][t], size[s]), share(sum(n[lang, o][t] for o in own), sum(size.values())), t) for t in keep if n[lang, s][t]]
            rows = sorted((-far(p, q), t.encode()) for p, q, t in both if p > q)[:top]
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(rows)]
    return sorted(out)


SAID = [("Ab ab c'd É é", "x", "s1"), ("ab cd é É x", "x", "s2"), ("AB d c é", "x", "s1"), (None, "x", "s3"), ("ab ab ab", "x", None), ("zz", None, None)]
SAID += [("q", "y", "s1"), ("q", "y", "s2"), ("w w w " * 100_000, "x", "s2"), ("w", "x", "s1"), ("w é", "x", "é"), ("", "z", "s1"), ("", "z", "s2")]


def audited(df, **names):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in divergence.audit(df, **names).collect())


def test_divergence(spark, monkeypatch):
    df = spark.createDataFrame(SAID * 2, "text string, lang string, source string").withColumns({c: F.lit(1) for c in ("term", "n", "m", "odd.name", "id")})
    want = brute_audit(SAID * 2)
    assert audited(df) == want and audited(df.limit(0)) == []
    for name, small in (("PAIRS", 3), ("HELD", 2), ("PIECE", 7)):
        monkeypatch.setattr(divergence, name, small)
    assert audited(df.drop("n")) == want


def test_divergence_ranks_only_so_many_terms(spark):
    rows = [(" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}" * (1 + i % 3) for i in range(300)), "x", s) for s in "aab"] * 2
    rows += [("only here", "x", "b")] * 3
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert audited(df, top=50) == brute_audit(rows, top=50)


def test_shares_are_exact(spark):
    rnd = np.random.default_rng(6)
    rows = [(int(a), int(a + b), int(c)) for a, b, c in rnd.integers(1, 10**15, (200, 3))]
    df = spark.createDataFrame(rows, "c long, n long, v long").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.c + 1) // (r.n + r.v) for r in df.collect())


def test_training_beats_its_start(monkeypatch):
    """Held-out rows of the labelled documents: more toxic ones found than by log-odds alone, few clean ones flagged."""
    import os
    import zlib

    import pyarrow.parquet as pq

    from readloom.llm import toxicity

    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{path}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    rows = sorted({(r["doc_id"], r["toxic"]) for r in pq.read_table(f"{path}/labels.parquet").to_pylist() if r["toxic"] is not None})
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    known = [r for r in known if r[1]] + [r for r in known if not r[1]][: toxicity.MOST_CLEAN]

    def measured():
        table, bias = toxicity.train((toxicity.counted(texts[i]) for i, _ in known), [y for _, y in known])
        scorer = toxicity.Scorer(table, bias)
        said = [(y, scorer.score(texts[i]) >= 0.5) for i, y in held]
        return sum(p for y, p in said if y) / sum(y for y, _ in said), sum(p for y, p in said if not y) / sum(not y for y, _ in said)

    found, flagged = measured()
    monkeypatch.setattr(toxicity, "EPOCHS", 0)
    start, start_flagged = measured()
    assert found >= 0.85 and found > start + 0.2 and flagged <= 0.02 and flagged <= start_flagged + 0.01
