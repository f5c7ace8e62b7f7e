"""The registered queries over whole small tables against brute force."""

import collections
import hashlib
import os
import re
import zlib

import numpy as np
import pytest

from readloom.llm import licenses, registry
from tests.llm.test_native import brute_stats, brute_targets
from tests.llm.test_python_ops import brute_components, reference_encoding, shingles

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def run(spark, n):
    (name,) = [q for q in registry.queries() if q.startswith(f"op{n}_")]
    return registry.queries()[name](spark, DATA).collect()


def test_op1(spark, docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in run(spark, 1)}
    at = 0
    for d in sorted(docs):
        ids = tool.encode(docs[d].text or "", add_special_tokens=False).ids + [2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(docs)


def test_op2(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text or "") for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()]
    odd = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", odd), (-7, 1, "assistant", odd)]
    turns = collections.defaultdict(list)
    for c, _, r, t in sorted(rows):
        turns[c].append((r, t))
    got = run(spark, 2)
    assert len(got) == len(turns)
    for r in got:
        loss = "".join(t for role, t in turns[r.conv_id] if role == "assistant")
        assert r.n_turns == len(turns[r.conv_id])
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns[r.conv_id]).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars > 0


def test_op3(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    v = np.array([r.embedding for r in rows], float)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = (u @ u.T >= 0.9) & ~np.eye(len(rows), dtype=bool)
    ids = [r.vec_id for r in rows]
    want = brute_components([(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))], ids)
    links = dict(zip(ids, near.sum(1)))
    got = run(spark, 3)
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(i, links[i], want[i], want[i] == i) for i in ids}


def test_op4(spark, docs):
    got = run(spark, 4)
    assert len(got) == len(docs)
    slots = collections.defaultdict(list)
    for r in got:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op5(spark, docs):
    got = run(spark, 5)
    sizes = collections.Counter()
    for d in docs.values():
        sizes[d.source] += len(WORD.findall(d.text or ""))
    want = brute_targets(sizes)
    taken = collections.Counter()
    for r in got:
        s = docs[r.doc_id].source
        assert r.size == len(WORD.findall(docs[r.doc_id].text or "")) and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        largest = max(len(WORD.findall(d.text or "")) for d in docs.values() if d.source == s)
        assert abs(taken[s] - want[s]) <= 2 * largest


def test_op6(spark, docs):
    got = run(spark, 6)
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op7(spark, docs):
    e = reference_encoding()
    got = run(spark, 7)
    assert len(got) == len(docs)
    for r in got:
        text = docs[r.doc_id].text or ""
        ids = e.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_op8(spark, docs):
    from tests.llm.test_licenses import brute

    for r in run(spark, 8):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(docs[r.doc_id].text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(","))))) and 0 <= r.score <= 1
    assert licenses.BASE[0][1] == "mit"


def test_op9(spark, docs):
    got = run(spark, 9)
    assert len(got) == len(docs)
    for r in got:
        n = brute_stats(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (r.base_failed and r.kept)


def test_op10(spark, docs):
    sets = [(d, shingles(r.text)) for d, r in sorted(docs.items())]
    pairs = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and (x & y).total() >= 0.8 * (x | y).total()]
    want = brute_components(pairs, list(docs))
    assert {(r.doc_id, r.component_id, r.kept) for r in run(spark, 10)} == {(d, want[d], want[d] == d) for d in docs}
