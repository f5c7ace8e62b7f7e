"""Near-duplicate texts by weighted minwise signatures of thrown darts (DartMinHash).

A text is the multiset of its five-word shingles. The n-th occurrence of a
shingle is a region of weight one; every region has darts at random heights,
one for each unit of height on average, which depend on the region alone. A
text needs the darts of its own regions up to a height that makes about
``k ln k + 2k`` of them; each dart falls on one of ``k`` coordinates, and the
lowest dart of a coordinate is its signature value. Two texts agree in a
coordinate with a chance equal to their weighted Jaccard similarity. The work
is proportional to the shingles plus ``k log k``, not to their product.

Texts of equal multisets are one class, found by a 128-bit fingerprint, and
only the class, with the text of its smallest id, goes on. Signatures are cut into bands; a band value
is a bucket. Each member of a bucket is compared to the bucket's smallest id
first. What is confirmed is joined into components, and buckets that still span
several are gone through in full: small ones pair by pair, large ones in blocks
of rows whose common regions are counted by a product of incidence matrices, of
which only a spanning set of links leaves the block. So no candidate is left
out, and pairs that are rows are at most ``SMALL`` for each member of a bucket.
Comparisons are exact, on whole texts.

Defined results: null texts and texts without words link with nothing; texts of
fewer than five words are one shingle; letters A-Z count as a-z; rows with a
null id get a null component and are kept; rows of equal id are one document, to
which the near copies of each of its texts belong, and of which one row is kept; ties (equal texts) go to the smallest id; a very long
text is worked on alone, in memory of some hundred bytes a word; an empty table
gives an empty result; input columns beside id and text are not returned, so
none can clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F, Window as W
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from readloom.llm.common import in_blocks, quoted, release, small_batches
from readloom.operators.components import connected_components
from readloom.session import Tables

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 26, 5
K = BANDS * ROWS
#: Bytes of text that are worked on together. However short a text is, it takes about ``K ln K + 2 K`` darts, which
#: weigh as much as so many bytes.
SLICE = 1 << 19
DARTS = math.ceil(K * math.log(K) + 2 * K)
#: Partners of a text that are compared to it in one group; a text with more of them has several groups.
PARTNERS = 256
#: Buckets up to this size are compared pair by pair, larger ones as blocks of so many rows.
SMALL, BLOCK = 32, 512
#: Columns of an incidence matrix that are multiplied at once.
COLUMNS = 4096
#: Candidate ids that are few enough to send to every task (16 MB of ids at most).
FEW_IDS = 1_000_000

_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD1B54A32D192ED03)
_SHINGLE = np.array([0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Cumulated Poisson(1) law, scaled to 32 bits.
_POISSON = np.array([int(math.exp(-1) * sum(1 / math.factorial(i) for i in range(n + 1)) * 2**32) for n in range(12)], np.uint64)
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        _powers[:] = []
        for base in (_B, _B_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p))
    return _powers[0], _powers[1]


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def regions(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all regions (shingle and number of the occurrence) and the text of each, in order of texts."""
    n_docs = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = _LOWER[data]
    space = _SPACE[data]
    starts_text = np.zeros(len(data) + 1, bool)
    starts_text[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    start = np.flatnonzero(~space & (before | starts_text[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = space[1:]
    end = np.flatnonzero(~space & (after | starts_text[1:])) + 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    word = _mix((total[end] - total[start]) * down[start])
    doc = np.searchsorted(offsets, start, side="right") - 1
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count)])
    place = np.arange(len(word)) - first[doc]
    head = (place + WORDS <= count[doc]) | (place == 0)
    at = np.flatnonzero(head)
    key = np.zeros(len(at), np.uint64)
    padded = np.concatenate([word, np.zeros(WORDS, np.uint64)])
    room = count[doc[at]] - place[at]
    for i in range(WORDS):
        key += np.where(i < room, padded[at + i] * _SHINGLE[i], np.uint64(i + 1))
    key, doc = _mix(key), doc[at]
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    run = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    return _mix(k + (np.arange(len(k)) - run).astype(np.uint64) * _STEP), d


def _throw(key: np.ndarray, doc: np.ndarray, height: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest dart of each coordinate up to a text's height: values and which coordinates have one."""
    floors = np.ceil(height).astype(np.int64)[doc]
    at = np.repeat(np.arange(len(key)), floors)
    level = np.arange(len(at)) - np.repeat(np.cumsum(floors) - floors, floors)
    cell = _mix(key[at] + (level.astype(np.uint64) + np.uint64(1)) * _SHINGLE[0])
    n = np.searchsorted(_POISSON, cell >> np.uint64(32), side="right")
    dart = np.repeat(np.arange(len(cell)), n)
    number = np.arange(len(dart)) - np.repeat(np.cumsum(n) - n, n)
    value = _mix(cell[dart] + (number.astype(np.uint64) + np.uint64(1)) * _SHINGLE[1])
    rank = level[dart] + (value >> np.uint64(11)).astype(np.float64) / 2.0**53
    owner = doc[at[dart]]
    low = rank <= height[owner]
    value, rank, owner = value[low], rank[low], owner[low]
    name = _mix(value ^ _SHINGLE[2])
    slot = owner * K + (name % np.uint64(K)).astype(np.int64)
    order = np.lexsort((rank, slot))
    slot = slot[order]
    lead = np.ones(len(slot), bool)
    lead[1:] = slot[1:] != slot[:-1]
    out, has = np.zeros(n_docs * K, np.uint64), np.zeros(n_docs * K, bool)
    out[slot[lead]] = name[order][lead]
    has[slot[lead]] = True
    return out.reshape(n_docs, K), has.reshape(n_docs, K)


def signatures(key: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Signatures of the texts that have regions; rows of others are zero."""
    size = np.bincount(doc, minlength=n_docs)
    height = (K * math.log(K) + 2 * K) / np.maximum(size, 1)
    out = np.zeros((n_docs, K), np.uint64)
    todo = np.flatnonzero(size > 0)
    while len(todo):
        local = np.full(n_docs, -1)
        local[todo] = np.arange(len(todo))
        mine = local[doc] >= 0
        got, has = _throw(key[mine], local[doc[mine]], height[todo], len(todo))
        out[todo] = got
        todo = todo[~has.all(1)]
        height[todo] *= 2
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), BANDS, ROWS)
    key = np.zeros((len(sig), BANDS), np.uint64)
    for i in range(ROWS):
        key += parts[:, :, i] * _SHINGLE[i]
    return _mix(key + np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP)


def _slices(lengths: np.ndarray):
    """Ranges of texts of so many bytes whose bytes and darts stay below ``SLICE``; a longer text is alone."""
    first = total = 0
    for i, n in enumerate(lengths):
        n += 2 * DARTS
        if total and total + n > SLICE:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(lengths):
        yield first, len(lengths)


SIGNED = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("h", LongType()),
        StructField("n", LongType()),
        StructField("f1", LongType()),
        StructField("f2", LongType()),
        StructField("bands", ArrayType(LongType(), False)),
    ]
)


def _sign(batches):
    for batch in batches:
        ids, hashes, texts = batch.column(0), batch.column(1), batch.column(2).cast(pa.large_string())
        _, offsets = _buffers(texts)
        for a, b in _slices(np.diff(offsets)):
            key, doc = regions(*_buffers(texts.slice(a, b - a)))
            n = np.bincount(doc, minlength=b - a)
            prints = []
            for salt in (_SHINGLE[3], _SHINGLE[4]):
                total = np.concatenate([[np.uint64(0)], np.cumsum(_mix(key ^ salt), dtype=np.uint64)])
                upto = np.concatenate([[0], np.cumsum(n)])
                prints.append((total[upto[1:]] - total[upto[:-1]]).view(np.int64))
            bands = _bands(signatures(key, doc, b - a)).view(np.int64)
            sizes = np.where(n > 0, BANDS, 0)
            flat = pa.array(bands[n > 0].reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), hashes.slice(a, b - a), pa.array(n), pa.array(prints[0]), pa.array(prints[1]), lists], SIGNED.names)
    release()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts' region keys (each key stands once)."""
    if not len(a) or not len(b):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _compare(batches):
    """Groups of (a, part, b, text), each led by the text of ``a`` itself (null ``b``), to the pairs that reach the threshold."""
    own, centre = None, None
    for batch in batches:
        texts = batch.column(3).cast(pa.large_string())
        _, offsets = _buffers(texts)
        keys = []
        for x, y in _slices(np.diff(offsets)):
            key, doc = regions(*_buffers(texts.slice(x, y - x)))
            keys += np.split(key, np.cumsum(np.bincount(doc, minlength=y - x))[:-1])
        out_a, out_b = [], []
        for a, b, part, key in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1).to_pylist(), keys):
            if b is None:
                own, centre = (a, part), key.copy()
            elif own == (a, part) and similarity(centre, key) >= THRESHOLD:
                out_a.append(a)
                out_b.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
    release()


def _confirmed(pairs: DataFrame, texts_of, tables: Tables, name: str) -> DataFrame:
    """The pairs of a written table ``(a, b)`` whose texts reach the threshold.

    Pairs of one ``a`` are groups of about ``PARTNERS``, and the text of ``a``
    goes once to each group. So a text with very many partners is many groups in
    many tasks, and is not copied to each of its pairs.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    ids = tables.save(ids, name + "-ids")
    texts = tables.save(texts_of(ids), name + "-texts")
    hubs = tables.save(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts")).where("parts > 1"), name + "-hubs")
    slim = F.broadcast(hubs) if hubs.count() <= FEW_IDS else hubs
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(slim, "a", "left").select("a", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"), "b")
    groups = pairs.select("a").distinct().join(slim, "a", "left").select("a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    lead = groups.join(texts.select(F.col("id").alias("a"), "t"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "t")
    rows = lead.union(dealt.join(texts.select(F.col("id").alias("b"), "t"), "b").select("a", "part", "b", "t"))
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    out = tables.save(rows.mapInArrow(_compare, "a long, b long"), name + "-ok")
    tables.drop(texts)
    return out


def _texts_by_class(docs: DataFrame, classes: DataFrame, again: DataFrame):
    """A function from class numbers ``(id)`` to ``(id, t)``: the text that stands for each.

    It is found by the id and the hash of the document that stands for the class; few numbers go to every task, many
    are shuffled like the texts. Rows that repeat an id and its text give it once.
    """
    once = docs.join(again, docs.id == again.node, "left_anti")
    if not again.isEmpty():
        many = docs.join(again, docs.id == again.node, "left_semi")
        once = once.unionByName(many.groupBy("id", "h").agg(F.first("t").alias("t")))
    once = once.select(F.col("id").alias("doc"), "h", "t")

    def of(ids: DataFrame) -> DataFrame:
        need = ids.join(classes.select(F.col("rep").alias("id"), "doc", "h"), "id")
        return once.join(F.broadcast(need) if ids.count() <= FEW_IDS else need, ["doc", "h"]).select("id", "t")

    return of


def _keys(batches):
    """(id, text) to (id, region keys)."""
    for batch in batches:
        texts = batch.column(1).cast(pa.large_string())
        _, offsets = _buffers(texts)
        for a, b in _slices(np.diff(offsets)):
            key, doc = regions(*_buffers(texts.slice(a, b - a)))
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b - a))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(key.view(np.int64)))], ["id", "keys"])


def common_counts(lists: pa.Array) -> np.ndarray:
    """Number of common keys of each two rows; a row holds a key once."""
    n = len(lists)
    flat = lists.flatten().to_numpy()
    row = np.repeat(np.arange(n), pa.compute.list_value_length(lists).to_numpy())
    _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
    many = times[col] > 1  # a key of one row is common to none
    new = np.cumsum(times > 1) - 1
    row, col = row[many], new[col[many]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((n, n), np.float32)
    for first in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        a, b = np.searchsorted(col, [first, first + COLUMNS])
        x = np.zeros((n, COLUMNS), np.float32)
        x[row[a:b], col[a:b] - first] = 1
        out += x @ x.T
    return out


def _spanning(batches):
    """Rows of (bucket, block i, block j, id, keys) in order to links that connect what is linked in a group."""
    from readloom.llm.embedding import _whole

    for t, at in _whole(batches, 3):
        ids, lists = t.column("id").to_numpy(), t.column("keys").chunk(0)
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(at, np.append(at[1:], len(ids))):
            if b - a < 2:
                continue
            part = lists.slice(a, b - a)
            common = common_counts(part)
            size = pa.compute.list_value_length(part).to_numpy()
            near = common >= THRESHOLD * (size[:, None] + size[None, :] - common)
            label = np.arange(b - a)
            while True:
                low = np.minimum(np.where(near, label[None, :], b - a).min(1), label)
                low = low[low]
                if (low == label).all():
                    break
                label = low
            moved = np.flatnonzero(label != np.arange(b - a))
            out_a.append(ids[a + label[moved]])
            out_b.append(ids[a + moved])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])


def _linked_in_blocks(rows: DataFrame, texts_of, tables: Tables) -> DataFrame:
    """Links ``(a, b)`` that connect what is similar in each bucket of ``rows (key, size, rep)``, ``size`` rows."""
    ids = tables.save(rows.select(F.col("rep").alias("id")).distinct(), "block-ids")
    keys = tables.save(texts_of(ids).select("id", "t").mapInArrow(_keys, "id long, keys array<long>"), "block-keys")
    n = in_blocks(rows.select("key", "size", F.col("rep").alias("id")), "size", BLOCK, "id").join(keys, "id")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = n.select("key", "i", "j", "id", "keys").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    return tables.save(n.mapInArrow(_spanning, "a long, b long").distinct(), "block-links")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, component_id, kept)``: a document's class of near copies is named by its smallest id."""
    tables = Tables(df.sparkSession, "minhash")
    small_batches(df.sparkSession)
    docs = df.select(F.col(quoted(doc_id)).cast("long").alias("id"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("t"))
    docs = docs.select("id", F.xxhash64("t").alias("h"), "t")
    signed = tables.save(docs.mapInArrow(_sign, SIGNED), "signed")
    print_of = ["f1", "f2", "n"]
    worded = signed.where("n > 0 and doc_id is not null")
    # a class has a number of its own, as an id with several texts stands for several classes
    classes = worded.groupBy(*print_of).agg(F.min(F.struct("doc_id", "h", "bands")).alias("s"), F.count(F.lit(1)).alias("copies"))
    number = F.monotonically_increasing_id().alias("rep")
    classes = tables.save(classes.select(number, *print_of, F.col("s.doc_id").alias("doc"), F.col("s.h").alias("h"), F.col("s.bands").alias("bands"), "copies"), "classes")
    again = signed.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = tables.save(again.select(F.col("doc_id").alias("node")), "again")
    members = classes.select("rep", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    shared = tables.save(members.join(buckets, "key"), "buckets")
    star = shared.where("rep != low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
    texts = _texts_by_class(docs.where("id is not null"), classes, again)
    star = tables.save(star, "stars")
    first = _confirmed(star, texts, tables, "star")
    near = first
    part = tables.save(connected_components(near, "a", "b"), "parts")
    placed = shared.join(part, shared.rep == part.node, "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    open_keys = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
    rest = tables.save(placed.join(open_keys.select("key", "size"), "key"), "open")
    few = rest.where(F.col("size") <= SMALL)
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.c") < F.col("y.c")))
    pairs = pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    second = _confirmed(tables.save(pairs.join(star, ["a", "b"], "left_anti"), "pairs"), texts, tables, "rest")
    links = near.union(second).union(_linked_in_blocks(rest.where(F.col("size") > SMALL), texts, tables))
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("doc").alias("doc_" + c))
    links = links.join(side("a"), "a").join(side("b"), "b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
    # equal ids with different texts are one document: their classes belong together
    same = worded.join(classes.where("copies > 0").select(*print_of, F.col("doc").alias("a")), print_of).select("a", F.col("doc_id").alias("b"))
    same = same.where("a != b").distinct()
    whole = tables.save(connected_components(links.union(same), "a", "b"), "whole")
    out = signed.select("doc_id").join(whole, signed.doc_id == whole.node, "left")
    component = F.coalesce("component", "doc_id")
    # of rows that repeat an id one is kept; rows without an id are apart from each other
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    out = out.select("doc_id", component.alias("component_id"), kept.alias("kept"))
    if again.isEmpty():
        return out
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("component_id"))
    many = out.join(again, out.doc_id == again.node, "left_semi").withColumn("kept", F.col("kept") & (place == 1))
    return out.join(again, out.doc_id == again.node, "left_anti").union(many)
