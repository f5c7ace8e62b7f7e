"""Nulls, empty and very long texts, ties, repeats, empty tables and clashing names for the operators with Python kernels."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from readloom.llm import bpe, chat, embedding, minhash, tokenids, toxicity

P = pytest.importorskip("public_tokenizers")
RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
RND = random.Random(8)
LONG = " ".join(f"{RND.choice(['ba', 'lo', 'ti'])}{RND.randrange(5000)}" for _ in range(150_000))  # about 1 MB
ROWS = [(1, LONG), (2, LONG), (3, None), (4, ""), (None, "x y z"), (None, "x y z"), (6, "a b c d e f"), (6, "a b c d e f"), (7, "<|endoftext|> b"), (8, LONG[:-9])]
CLASH = ("_t", "_text", "_i", "held", "id", "t", "d", "h", "n", "key", "score", "ids", "decoded", "a", "b", "part", "i", "y", "k", "g")


@pytest.fixture(scope="module")
def table(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string")
    return d.withColumns({c: F.lit("clash") for c in CLASH}).withColumn("odd.name", F.lit("clash")).cache()


def test_every_clashing_column_stays(table):
    import numpy as np

    model = (np.zeros(toxicity.BUCKETS, np.float32), 0.5)
    scored = toxicity.score(table, model)
    coded = bpe.decode(bpe.encode(table, RANKS, P.PATTERN), RANKS, P.PATTERN)
    for out, new in ((scored, {"score", "predicted"}), (coded, {"ids", "decoded"})):
        assert len(out.columns) == len(set(out.columns)) and out.count() == len(ROWS)
        for c in {*CLASH} - new:
            assert out.where(F.col(c) == "clash").count() == len(ROWS), c
    assert {r.score for r in scored.collect()} == {1 / (1 + math.exp(-0.5))}


def test_token_ids(spark, table, tmp_path):
    from tokenizers import Tokenizer

    tokenids.write_ids(table, f"file://{tmp_path}/ids", WORDS, end_id=2)
    got = tokenids.read_ids(spark, f"file://{tmp_path}/ids", digest=True).orderBy("start").collect()
    tool = Tokenizer.from_file(WORDS)
    want = []
    for d, t in ROWS:
        ids = tool.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    assert want[8][1] == 3  # a special token in a text is one id


def test_other_tokenizers_are_not_split_by_hand(tmp_path):
    import json

    spec = json.load(open(WORDS, encoding="utf-8"))
    assert tokenids.words_apart(WORDS)
    spec["normalizer"]["normalizers"].pop()
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    assert not tokenids.words_apart(str(path))
    other = tokenids.WordEncoder(str(path))
    assert other.encode(["Some Text"]) == [b"".join(i.to_bytes(2, "little") for i in other.tool.encode("Some Text", add_special_tokens=False).ids)]


def test_minhash(spark, table):
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(table).collect()), key=str)
    want = [(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (None, None, True), (None, None, True)]
    want += [(6, 6, True), (6, 6, False), (7, 7, True), (8, 1, False)]
    assert got == sorted(want, key=str)
    assert minhash.near_duplicates(table.limit(0)).count() == 0


def test_an_id_of_several_texts_brings_the_partners_of_each(spark):
    """Each text of the repeated id has a near copy; all are one document's class."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, a + " x"), (3, b + " x"), (0, c), (1, c), (9, c + " x"), (5, "not like them at all, five words")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, True), *[(1, 0, False)] * 4, (2, 0, False), (3, 0, False), (5, 5, True), (9, 0, False)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows[:5], "doc_id long, text string")).collect())
    assert got == [(1, 1, False), (1, 1, False), (1, 1, True), (2, 1, False), (3, 1, False)]


def test_short_texts_are_cut_into_slices_by_darts():
    sizes = [b - a for a, b in minhash._slices([6] * 10_000)]
    assert sum(sizes) == 10_000 and max(sizes) * 2 * minhash.DARTS <= minhash.SLICE
    assert list(minhash._slices([5_000_000, 3])) == [(0, 1), (1, 2)]


def test_a_text_with_many_partners(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PARTNERS", 4)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:i], "other", *base[i + 1 :]])) for i in range(0, 200, 5)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_buckets_of_several_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[: 9 * i], "other", *base[9 * i + 1 :]]) for i in range(20)]
    texts += [" ".join(f"x{k}y{i}" for i in range(60)) for k in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    rows = docs.select(F.lit(7).cast("long").alias("key"), F.lit(len(texts)).cast("long").alias("size"), F.col("id").alias("rep"))
    links = [(r.a, r.b) for r in minhash._linked_in_blocks(rows, lambda ids: docs.join(ids, "id", "left_semi"), minhash.Tables(spark, "blocks")).collect()]
    label = list(range(len(texts)))
    for _ in texts:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert label == [0] * 20 + list(range(20, 30))


def test_chats(spark):
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", None), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (2, None, None, "x"), (2, 0, "assistant", "y")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("c", F.lit(1)).withColumn("formatted", F.lit(2))
    got = sorted((str(r.conv_id), r.n_turns, r.loss_chars) for r in chat.read_back(chat.format_chats(d)).collect())
    assert got == [("1", 2, 0), ("2", 2, 1), ("None", 1, 0), ("None", 1, 1)]
    assert {r.loss_lost for r in chat.format_chats(d).collect()} == {0}


class LastOnly:
    """A template that blanks all turns but the last."""

    def render(self, turns):
        return "".join(f"[{t if i == len(turns) - 1 else '..'}]" for i, (_, t) in enumerate(turns))


def test_lost_loss_spans_are_counted(spark):
    d = spark.createDataFrame([(1, 0, "assistant", "abc"), (1, 1, "user", "d")], "conv_id long, turn long, role string, text string")
    (r,) = chat.format_chats(d, LastOnly()).collect()
    assert (r.rewritten_at, r.loss_lost, r.loss_spans) == (1, 1, [])


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0])]
    rows += [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [0.0, 2.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(3)).withColumn("v", F.lit(4))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding.near_duplicates(d).collect()), key=str)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8)]
    want = [*alone, (1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (9, 1, 1, False), (None, 0, None, True), (None, 0, None, True)]
    assert got == sorted(want, key=str)
    assert embedding.near_duplicates(d.limit(0)).count() == 0


def test_toxicity_without_words_and_with_repeats(spark):
    rows = [(i, "!!" if i % 2 else None) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 3, "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    assert {r.score for r in toxicity.score(d, model).collect()} == {1 / (1 + math.exp(50))}
    words = d.union(d).withColumn("text", F.when(F.col("doc_id") % 2 == 1, "vile words").otherwise("fine words"))
    model = toxicity.fit(words, labels)
    assert all(r.predicted == r.doc_id % 2 for r in toxicity.score(words, model).collect())


def test_scores_are_the_mean_of_words_of_the_mean_of_ngrams():
    import numpy as np

    table = np.random.default_rng(1).normal(0, 1, toxicity.BUCKETS).astype(np.float32)
    scorer = toxicity.Scorer(table, 0.3)
    for text in ("One two, ONE déjà_vu x", LONG[:5000]):
        means = []
        for w in "".join(c.lower() if c.isalnum() else " " for c in text).split():
            w = f"<{w}>"
            grams = [w[i : i + n] for n in toxicity.NGRAMS for i in range(max(1, len(w) - n + 1))]
            means.append(sum(float(table[zlib.crc32(g.encode()) % toxicity.BUCKETS]) for g in grams) / len(grams))
        assert scorer.score(text) == pytest.approx(1 / (1 + math.exp(-0.3 - sum(means) / len(means))))
