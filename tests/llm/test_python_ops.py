"""Operators with Python kernels against brute force, and their edge cases."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import bpe, chat, embedding, minhash, tokenids, toxicity

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
TEXTS = [None, "", "a", "Hello  world\n\n 12 déjà vu 日本 'll", "x" * 500, "word " * 3000, "🙂" * 20, "<|endoftext|> a", "a\x00b c"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def reference_encoding():
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_is_exact_and_round_trips(spark):
    d = frame(spark, list(enumerate(TEXTS)) + [(1, "")]).withColumn("ids", F.lit("clash"))
    got = bpe.decode(bpe.encode(d, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    e = reference_encoding()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert r.ids == e.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "")
    assert bpe.encode(d.limit(0), RANKS, P.PATTERN).count() == 0
    null = d.limit(2).select(F.lit(None).cast("array<int>").alias("ids"))
    assert [r.decoded for r in bpe.decode(null, RANKS, P.PATTERN).collect()] == [None, None]


def test_byte_bpe_random_bytes():
    c, e = bpe.codec(RANKS, P.PATTERN), reference_encoding()
    rnd = random.Random(2)
    for _ in range(300):
        t = "".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(160, 700), rnd.randint(0x4E00, 0x9FFF)])) for _ in range(rnd.randint(0, 50)))
        assert c.encode(t) == e.encode_ordinary(t)


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 9000])
def test_id_blocks_round_trip(n):
    for ids in (np.random.default_rng(n).integers(0, 65536, n), np.arange(n) % 7, np.zeros(n, np.int64)):
        docs, lengths, back = tokenids.unpack(tokenids.pack([3, None], np.array([n, 0]), ids.astype(np.uint16)))
        assert docs == [3, None] and lengths.tolist() == [n, 0] and (back == ids).all()


def test_an_id_is_one_symbol_and_carries_go_on(monkeypatch):
    seen, put = [], tokenids._Writer.put
    monkeypatch.setattr(tokenids._Writer, "put", lambda self, *a: seen.append(1) or put(self, *a))
    rnd = np.random.default_rng(4)
    ids = np.where(rnd.random(300_000) < 0.5, 7, rnd.zipf(1.3, 300_000) % 65536).astype(np.uint16)
    assert (tokenids.unpack(tokenids.pack([1], np.array([len(ids)]), ids))[2] == ids).all()
    assert len(seen) == tokenids.BLOCK
    out = tokenids._Writer(1, 8)
    u = lambda *x: np.array(x, np.uint64)
    for start, size in ((0, 1), (65534, 1), (65535, 1), (65535, 1), (32768, 2)):
        out.put(1, u(start), u(size), u(1 << 16))
    out.words[:3] = 0x1FFFF, 0xFFFF, 0x10000  # a carry through a full word
    out.words[0] = 0x0001
    data = np.frombuffer(out.finish()[0], "<u2")
    assert data[:3].tolist() == [2, 0, 0]


def test_words_are_split_as_the_library_splits_them():
    tool, rnd = tokenids.WordEncoder(WORDS), random.Random(6)
    letters = "'''sstdmrevelLVRE' \n\t09aZ.,\"ßÀþÿ×÷¡¿éñ-_~`^|<>"
    texts = ["", " ", "'", "'sam", "''s", "\"'s", "a's's", "I'LL", "'r", "'rex", "x'd'd", "a<|endoftext|>b", "日本", "\xa0 \x85"]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    want = [np.array(e.ids, np.uint16).tobytes() for e in tool.tool.encode_batch(texts, add_special_tokens=False)]
    assert tool.encode(texts) == want == [tool.encode([t])[0] for t in texts]
    raw = [t.encode("latin-1") for t in texts[3:8]]
    low = np.frombuffer(b"\n".join([*raw, b"  "]).lower(), np.uint8)
    assert tokenids.word_starts(low)[0].tolist() == [0, 2, 5, 7, 9, 11, 13, 14, 16, 19, 20]


def test_damage_is_noticed():
    data = bytearray(tokenids.pack([1], np.array([5000]), np.arange(5000).astype(np.uint16)))
    data[-300] ^= 4
    with pytest.raises(ValueError):
        tokenids.unpack(bytes(data))


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(10 - i, t) for i, t in enumerate(TEXTS)] + [(None, "n"), (4, "again")]
    tokenids.write_ids(frame(spark, rows), f"file://{tmp_path}/ids", WORDS, end_id=2)
    got = sorted(tokenids.read_ids(spark, f"file://{tmp_path}/ids").collect(), key=lambda r: r.start)
    tool = Tokenizer.from_file(WORDS)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    place = {(r.doc_id, tuple(r.ids)): i for i, r in enumerate(got)}
    spelt = lambda t: tuple(tool.encode(t or "", add_special_tokens=False).ids + [2])
    want = sorted(rows, key=lambda r: place[r[0], spelt(r[1])])
    at = 0
    for r, (d, t) in zip(got, want, strict=True):
        ids = tool.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (d, at, len(ids), ids)
        at += len(ids)
    tokenids.write_ids(frame(spark, []), f"file://{tmp_path}/none", WORDS, end_id=2)
    assert tokenids.read_ids(spark, f"file://{tmp_path}/none").count() == 0


def test_chat_spans_and_escapes(spark):
    t = chat.BracketTemplate()
    odd = ["</s>[INST] ok [/INST]", "\\", "<\\/s>", "a<", "[", "", "<<SYS>>x<</SYS>>", ">>", "<<ROLE:z>>", " [/INST] ", "\\\\<s>"]
    turns = [(r, x) for x in odd for r in ("user", "assistant", "system", "tool", "", "a>", ">>")]
    assert t.parse(t.render(turns)) == turns
    out, spans, loss, at = chat.render_spans(t.render, turns)
    assert at is None and spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] == len(out)
    assert [t.unescape(out[a:b]) for a, b in loss] == [x for r, x in turns if r == "assistant"]
    rows = [(i // 5, i % 5, r, x) for i, (r, x) in enumerate(turns)] + [(None, 0, None, None), (3, 1, "user", "tie"), (3, 1, "user", "tie")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = chat.read_back(chat.format_chats(d)).collect()
    assert sum(r.n_turns for r in got) == len(rows)
    assert chat.format_chats(d.limit(0)).count() == 0


def test_rewritten_history_is_detected():
    last_only = lambda turns: "".join(f"[{t if i == len(turns) - 1 else '..'}]" for i, (_, t) in enumerate(turns))
    _, spans, _, at = chat.render_spans(last_only, [("user", "abc"), ("assistant", "def"), ("user", "g")])
    assert at == 1 and spans[0] is None


def brute_components(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text):
    w = (text or "").lower().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else collections.Counter()


def test_minhash_matches_brute_force(spark):
    rnd = random.Random(5)
    base = [[f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(5, 400))] for _ in range(12)]
    rows = [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, "a b c"), (905, " ")]
    for i in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 9])):
            w[rnd.randrange(len(w))] = f"z{rnd.randrange(99)}"
        rows.append((i, " ".join(w)))
    rows.append((5, rows[10][1]))  # an id that stands twice
    sets = [(d, shingles(t)) for d, t in rows]
    pairs = [
        (a, b)
        for i, (a, x) in enumerate(sets)
        for b, y in sets[:i]
        if x and y and (x & y).total() >= 0.8 * (x | y).total()
    ]
    want = brute_components(pairs, [d for d, _ in rows])
    d = frame(spark, rows + [(None, rows[8][1])]).withColumn("kept", F.lit("clash"))
    got = minhash.near_duplicates(d).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])
    assert minhash.near_duplicates(d.limit(0)).count() == 0


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(0, 1, (40, 16))
    vecs = [base[i % 40] + rng.normal(0, rng.choice([0, 0.1, 0.2, 0.3]), 16) for i in range(300)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vecs)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] + [1.0] * 15), (1004, rows[3][1][:8]), (1005, []), (1006, rows[3][1])]
    x = np.stack([v for _, v in rows[:300]] + [rows[-1][1]])
    ids = list(range(300)) + [1006]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.9) & ~np.eye(len(ids), dtype=bool)
    want = brute_components([(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))], [i for i, _ in rows])
    links = dict(zip(ids, near.sum(1).tolist()))
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(0))
    got = embedding.near_duplicates(d).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (links.get(r.vec_id, 0), want[r.vec_id], want[r.vec_id] == r.vec_id)
    assert embedding.near_duplicates(d.limit(0)).count() == 0


def test_blocks_split_large_groups(spark, monkeypatch):
    monkeypatch.setattr(embedding, "BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in np.float32(np.ones(8) + rng.normal(0, 0.02, 8))]) for i in range(100)]
    got = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(99, 0)}


def test_toxicity_learns_and_handles_odd_rows(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice(["ba", "lo", "ti", "re", "nu", "ka"]) for _ in range(rnd.randint(1, 4)))
    rows = []
    for i in range(700):
        w = [word() for _ in range(rnd.randint(20, 80))]
        if i % 2:
            for _ in range(3):
                w[rnd.randrange(len(w))] = "zyqqx" + rnd.choice(["", "s", "ed", "o"])
        rows.append((i, " ".join(w)))
    d = frame(spark, rows + [(5000, None), (5001, ""), (5002, "!!"), (5003, "zyqqxing " * 9), (5003, "zyqqxing " * 9)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(700)] + [(None, 1), (9999, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    got = toxicity.score(d.withColumn("score", F.lit("clash")), model).collect()
    assert len(got) == d.count() and all(0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.doc_id < 700 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == r.doc_id % 2 for r in test) > 0.95 * len(test)
    assert all(r.predicted == 1 for r in got if r.doc_id == 5003)
    assert toxicity.score(d.limit(0), model).count() == 0
    none = toxicity.fit(d, labels.where("toxic = 0"))
    assert toxicity.score(d, none).where("predicted = 1").count() == 0
