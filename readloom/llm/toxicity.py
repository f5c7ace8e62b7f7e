"""Toxicity scores from averaged subword-bag embeddings and a linear softmax.

A word is the mean of the vectors of its character n-grams (with word marks), a
text the mean of its words, and a linear softmax reads the text's vector. All
vectors and the softmax are trained jointly by numpy on a bounded sample of
labelled rows. Words never seen share n-grams with seen ones, so misspellings
and new inflections get the right side. Only n-grams whose share of texts differs
between the classes by ``LEAST_Z`` standard errors have vectors that are not 0: the many
rare ones would be learnt by heart instead. Training starts with their log-odds as
first coordinate and draws whole vectors towards 0 (group lasso), so that what
doesn't earn its place drops out.

Every text is scored whole. Because everything before the softmax is linear,
vectors and softmax are folded into one number per n-gram bucket: that table,
of a fixed size, is all that executors get.

Defined results: null and empty texts, and texts without letters or digits,
get the score of the bias alone; a very long text is scored word by word, and
trained on by its distinct words; labels that are null, of unknown ids or of a
null id are not used; an id that repeats counts once, with its greatest label
and its least text; ties of the sample's order go by id; rows with a null id are
scored like others (and held out); repeated rows are scored each; an empty table
gives an empty result; without labels of both classes on texts with words, or where
no n-gram tells them apart, every score is 0; input columns named like an output column are replaced by it, no
other name clashes.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from readloom.llm.common import drop_names, numbered, quoted, release, small_batches

#: Labelled rows that training takes of each class, at most: the lowest by a hash of the id.
MOST_TOXIC, MOST_CLEAN = 1200, 1800
NGRAMS, BUCKETS, DIM = (3, 4, 5), 1 << 18, 8
#: Passes, step width, factor on the mean of a text, in which one of a hundred words has to show; pull of vectors towards 0.
EPOCHS, RATE, GAIN, PULL = 40, 0.2, 1000.0, 0.02
#: Least standard errors between the classes, smoothing of the starting log-odds and their factor.
LEAST_Z, SMOOTH, START = 5.0, 0.5, 0.1
#: Words whose score a worker remembers.
CACHE = 120_000

_WORD = re.compile(r"[^\W_]+")


def buckets(word: str) -> list[int]:
    """Buckets of a word's n-grams."""
    w = f"<{word}>"
    return [zlib.crc32(w[i : i + n].encode()) & (BUCKETS - 1) for n in NGRAMS for i in range(max(1, len(w) - n + 1))]


class _Sparse:
    """Rows of weighted column indices, with products in both directions."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, w: np.ndarray, n_rows: int, n_cols: int):
        self.shape = (n_rows, n_cols)
        self.by = []
        for key, other, n in ((rows, cols, n_rows), (cols, rows, n_cols)):
            order = np.argsort(key, kind="stable")
            at, first = np.unique(key[order], return_index=True)
            self.by.append((other[order].astype(np.int32), w[order].astype(np.float32), at, first, n))

    def dot(self, x: np.ndarray, transposed: bool = False) -> np.ndarray:
        other, w, at, first, n = self.by[transposed]
        out = np.zeros((n, x.shape[1]), np.float32)
        if len(at):
            for k in range(x.shape[1]):  # a column at a time, so that little memory is needed
                out[at, k] = np.add.reduceat(np.ascontiguousarray(x[:, k])[other] * w, first)
        return out


def _log_odds(doc, word, sizes, col, y, n_buckets) -> np.ndarray:
    """Smoothed log-odds of each bucket to occur in a text of class 1 against class 0; 0 where the difference may be chance."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    n = np.zeros(2 * n_buckets, np.int64)
    edges = np.flatnonzero(np.diff(doc, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(doc)]):
        inside = np.unique(np.concatenate([col[first[w] : first[w + 1]] for w in word[a:b]]))
        n[inside + y[doc[a]] * n_buckets] += 1
    size = np.bincount(y, minlength=2)
    one, zero = n[n_buckets:], n[:n_buckets]
    odds = np.log((one + SMOOTH) / (size[1] + 2 * SMOOTH)) - np.log((zero + SMOOTH) / (size[0] + 2 * SMOOTH))
    both = (one + zero) / size.sum()
    error = np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / size[1] + 1 / size[0]))
    return np.where(np.abs(one / size[1] - zero / size[0]) > LEAST_Z * error, odds, 0)


def _least_errors(margin: np.ndarray, y: np.ndarray) -> float:
    """The cut between two margins at which fewest labels are on the wrong side."""
    order = np.argsort(margin, kind="stable")
    wrong = (y == 0).sum() + np.cumsum(np.where(y[order] == 1, 1, -1))
    k = int(np.argmin(wrong))
    return float(margin[order[k]] + margin[order[min(k + 1, len(y) - 1)]]) / 2


def counted(text: str | None) -> tuple[list[str], list[int]]:
    """Distinct words of a text, in order of first sight, and how often each stands."""
    n = Counter(_WORD.findall((text or "").lower()))
    return list(n), list(n.values())


def train(texts: Iterable[tuple[list[str], list[int]]], labels: list[int], seed: int = 0) -> tuple[np.ndarray, float]:
    """The folded model of counted texts, which are gone through once: a number for each bucket, and the bias."""
    ids: dict[str, int] = {}
    doc, word, weight = [], [], []
    for k, (found, times) in enumerate(texts):
        got = np.array([ids.setdefault(x, len(ids)) for x in found], np.int64)
        order = np.argsort(got)
        doc.append(np.full(len(got), k))
        word.append(got[order])
        weight.append(np.array(times, np.float64)[order] / max(sum(times), 1))
    y = np.asarray(labels, np.int64)
    if len(set(labels)) < 2 or not ids:
        return np.zeros(BUCKETS, np.float32), -50.0
    doc, word, weight = (np.concatenate(x) for x in (doc, word, weight))
    names = list(ids)
    used, word = np.unique(word, return_inverse=True)
    flat, sizes = array("i"), np.zeros(len(used), np.int64)
    for i, name in enumerate(used):
        got = buckets(names[name])
        flat.extend(got)
        sizes[i] = len(got)
    del names, ids
    p = _Sparse(doc, word, weight, len(y), len(used))
    seen, col = np.unique(np.frombuffer(flat, np.int32), return_inverse=True)
    col = col.astype(np.int32)
    odds = _log_odds(doc, word, sizes, col, y, len(seen))
    told = np.flatnonzero(odds)  # no other n-gram has a vector
    if not len(told):
        return np.zeros(BUCKETS, np.float32), -50.0
    place = np.full(len(seen), -1, np.int32)
    place[told] = np.arange(len(told))
    holder, share = np.repeat(np.arange(len(used), dtype=np.int32), sizes), np.repeat((1 / sizes).astype(np.float32), sizes)
    mine = place[col] >= 0
    q = _Sparse(holder[mine], place[col[mine]], share[mine], len(used), len(told))
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 1e-3, (len(told), DIM)).astype(np.float32)
    e[:, 0] = odds[told] * START
    w = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    w[0] = (-0.5, 0.5)
    z = p.dot(q.dot(e)) @ w * GAIN
    cut = _least_errors(z[:, 1] - z[:, 0], y)
    b = np.array([cut / 2, -cut / 2], np.float32)
    params = [e, w, b]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for step in range(1, EPOCHS + 1):
        h = p.dot(q.dot(e)) * GAIN
        z = h @ w + b
        z -= z.max(1, keepdims=True)
        prob = np.exp(z)
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(len(y)), y] -= 1
        dz = prob / len(y)
        grads = [q.dot(p.dot((dz @ w.T) * GAIN, True), True), h.T @ dz, dz.sum(0)]
        for x, g, m, v, rate in zip(params, grads, first, second, (RATE, RATE, 5 * RATE)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            scale = np.sqrt(v / (1 - 0.99**step))
            if x is e:  # rare n-grams take small steps
                scale += 0.05 * scale.max()
            x -= rate * (m / (1 - 0.9**step)) / (scale + 1e-9)
        e *= np.maximum(0, 1 - PULL * RATE / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-9))
    table = np.zeros(BUCKETS, np.float32)
    table[seen[told]] = e @ (w[:, 1] - w[:, 0]) * GAIN
    return table, float(b[1] - b[0])


class Scorer:
    """Scores texts with a folded model."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias, self.memo = table.tolist(), bias, {}

    def word(self, w: str) -> float:
        got = buckets(w)
        t = self.table
        s = sum([t[b] for b in got]) / len(got)
        if len(self.memo) >= CACHE:
            self.memo.clear()
        self.memo[w] = s
        return s

    def score(self, text: str | None) -> float:
        found = _WORD.findall(text.lower()) if text else []
        memo, word = self.memo, self.word
        total = 0.0
        for w in found:
            s = memo.get(w)
            total += word(w) if s is None else s
        z = self.bias + (total / len(found) if found else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


_COUNTED = StructType([StructField("words", ArrayType(StringType())), StructField("times", ArrayType(IntegerType()))])


def held_out(doc_id):
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> tuple[np.ndarray, float]:
    """Train on a bounded sample of the labelled rows that are not held out.

    One task gets the distinct words, with counts, of ``MOST_TOXIC + MOST_CLEAN`` texts at most and trains; the
    driver gets the folded model, ``BUCKETS`` numbers.
    """
    own = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and i is not null")
    own = own.where(~held_out(F.col("i"))).groupBy("i").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("i"))
    part = [own.where(f"y = {y}").orderBy("h", "i").limit(most) for y, most in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    picked = part[0].unionByName(part[1])  # at most MOST_TOXIC + MOST_CLEAN rows, so it may be broadcast
    rows = docs.select(F.col(doc_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(picked), "i")
    rows = rows.groupBy("i").agg(F.max("y").alias("y"), F.min("t").alias("t")).select("i", "y", "t")

    def count(batches):
        for batch in batches:
            found = [counted(t) for t in batch.column(2).to_pylist()]
            made = [pa.array([f[k] for f in found], pa.list_(kind)) for k, kind in enumerate((pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["i", "y", "words", "times"])

    def learn(batches):
        y: list[int] = []

        def texts():
            for batch in batches:
                for k in range(batch.num_rows):
                    y.append(batch.column(1)[k].as_py())
                    yield batch.column(2)[k].as_py(), batch.column(3)[k].as_py()

        table, bias = train(texts(), y)
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["numbers", "bias"])
        del table
        release()

    small_batches(docs.sparkSession)
    found = rows.mapInArrow(count, StructType([rows.schema["i"], rows.schema["y"], *_COUNTED.fields]))
    model = found.repartition(1).sortWithinPartitions("i").mapInArrow(learn, "numbers binary, bias double").collect()
    if not model:  # no partition at all: nothing to learn from
        return train([], [])
    return np.frombuffer(model[0].numbers, np.float32), model[0].bias


def score(df: DataFrame, model: tuple[np.ndarray, float], text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` (columns ``carry``, all by default) with ``score`` and ``predicted``."""
    small_batches(df.sparkSession)
    keep = drop_names(df.select(*map(quoted, df.columns if carry is None else carry)), ("score", "predicted"))
    rows, fields = numbered(df, keep, F.col(text))
    schema = StructType([*fields, StructField("score", DoubleType())])
    table, bias = model

    def run(batches):
        scorer = Scorer(table, bias)
        for batch in batches:
            t = batch.column(len(keep))
            s = pa.array([scorer.score(x.as_py()) for x in t], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], s], [*keep, "score"])
        del scorer
        release()

    return rows.mapInArrow(run, schema).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
