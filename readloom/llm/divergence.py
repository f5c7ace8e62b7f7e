"""Source divergence audit: how far the sources of a language lie apart, and by which terms.

Terms are runs of ASCII letters and bytes above ASCII after A-Z are lowered; a
language keeps those of at least ``LEAST`` of its documents. With one count added to
each, a kept term of a source, or of a language, has the share p = 1 + floor(10^9 *
(count + 1) / (N + V)), N the counts' sum and V the number of kept terms. Two shares
diverge by f(p, q) = floor((p - q)^2 / q), all in exact integers.

Terms of a language with the same sparse vector of (source, count) are one vector with
a multiplicity. The sum of f over all terms is that over vectors:

* all terms as if both counts were none: V * f(z, z');
* for a nonzero count, what it adds beside a partner without any: it depends on
  source and count alone, so vectors are first summed by these;
* where both counts are nonzero, what is left to the value of the pair: evaluated once
  for each distinct vector, times its multiplicity.

So the work follows the nonzero entries of the distinct vectors, not the square of the
number of sources, and no pair of rows is ever emitted: a task adds a batch's values up
by pair of sources first. The terms of a source are ranked as they are.

Documents are counted in tasks: runs of a batch by language and source, no more
than ``HELD`` terms at a time. A term's vector has as many entries as its language
has sources at most. Shares are taken digit by digit in longs, exact up to 9 * 10^15
words of a language.

Defined results: null text, language and source are empty strings; a group without
terms has its rows against the others; a language without a kept term has pairs of
value 0 and no term; texts may have any length (words are cut out of pieces of ``PIECE``
bytes); equal values rank by the item's UTF-8 bytes; repeated rows are documents of
their own; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from readloom.llm.common import quoted, release, small_batches
from readloom.session import Tables, broadcast_if_small

LEAST, TOP = 3, 200
HELD, PIECE, PAIRS = 300_000, 1 << 20, 500_000

_BYTES = np.arange(256)
_LETTER = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) & (_BYTES < 128)
#: Terms in lower case, spaces for all between them.
_CLEAN = bytes(np.where(_LETTER, _BYTES | 32, np.where(_BYTES >= 128, _BYTES, 32)).astype(np.uint8))


def _pieces(text: bytes):
    """Terms of a text, in lists of about ``PIECE`` bytes."""
    clean, a = text.translate(_CLEAN), 0
    while a < len(clean):
        b = clean.find(b" ", a + PIECE)
        b = len(clean) if b < 0 else b
        yield clean[a:b].split()
        a = b


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, term, n, df)``: occurrences and documents of each term of a group."""
    small_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(quoted(c)), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, raw in enumerate(batch.column(2).cast(pa.binary())):
                n, df = held.setdefault((langs[i], sources[i]), (Counter(), Counter()))
                seen: set[bytes] = set()
                for terms in _pieces(raw.as_py()):
                    n.update(terms)
                    seen.update(terms)
                df.update(seen)
                if i % 64 == 63 and sum(len(x) for x, _ in held.values()) > HELD:
                    yield from flush(held)
            if sum(len(x) for x, _ in held.values()) > HELD:
                yield from flush(held)
        yield from flush(held)
        release()

    def flush(held):
        for (a, b), (n, df) in held.items():
            if n:
                terms = list(n)
                same = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(terms), np.int32))) for x in (a, b)]
                counts = [pa.array(list(map(c.__getitem__, terms)), pa.int64()) for c in (n, df)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(terms, pa.binary()).cast(pa.string()), *counts], ["lang", "source", "term", "n", "df"])
        held.clear()

    counted = rows.mapInArrow(run, "lang string, source string, term string, n long, df long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def kept_terms(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """``(lang, term, total, entries)`` of kept terms; ``entries`` is the sparse vector of ``(source, n)``."""
    entries = F.sort_array(F.collect_list(F.struct("source", "n"))).alias("entries")
    return counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("total"), entries).where(F.col("df") >= least).drop("df")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / (total + kept)), three digits at a time."""
    rest, out = count + 1, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, total + kept)
        rest = (rest * 1000) % (total + kept)
    return out + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _beyond(p, z, q, y):
    """What a pair of nonzero counts adds to the values of each beside none."""
    return (p - q) ** 2 // q - (p - y) ** 2 // y - (z - q) ** 2 // q + (z - y) ** 2 // y


def _met(vectors: DataFrame) -> DataFrame:
    """``(lang, source, item, v)``: sums over vectors ``(lang, m, entries)`` of what pairs of their entries add."""

    def run(batches):
        for batch in batches:
            langs, entries = batch.column(0).dictionary_encode(), batch.column(2)
            flat = entries.flatten()
            names, p, z = flat.field(0).dictionary_encode(), flat.field(1).to_numpy(), flat.field(2).to_numpy()
            size = pa.compute.list_value_length(entries).to_numpy().astype(np.int64)
            vector = np.repeat(np.arange(len(size)), size)
            many, first = size[vector], (np.cumsum(size) - size)[vector]
            m, lang, name = batch.column(1).to_numpy()[vector], langs.indices.to_numpy()[vector].astype(np.int64), names.indices.to_numpy().astype(np.int64)
            ends, a, of = np.cumsum(many), 0, len(names.dictionary)
            keys, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            while a < len(many):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
                left = np.repeat(np.arange(a, b), many[a:b])
                right = first[left] + np.arange(len(left)) - np.repeat(np.cumsum(many[a:b]) - many[a:b], many[a:b])
                apart = left != right
                left, right = left[apart], right[apart]
                value = m[left] * _beyond(p[left], z[left], p[right], z[right])
                key, at = np.unique((lang[left] * of + name[left]) * of + name[right], return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, at, value)
                keys.append(key)
                sums.append(total)
                a = b
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, at, np.concatenate(sums))
            part = [langs.dictionary.take(pa.array(key // of // of)), names.dictionary.take(pa.array(key // of % of)), names.dictionary.take(pa.array(key % of))] if of else [pa.array([], pa.string())] * 3
            yield pa.RecordBatch.from_arrays([*part, pa.array(total)], ["lang", "source", "item", "v"])
        release()

    return vectors.select("lang", "m", "entries").mapInArrow(run, "lang string, source string, item string, v long")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` against each other source of the language, part ``term``
    the ``top`` terms of which a source has a larger share than its language."""
    tables = Tables(docs.sparkSession, "divergence")
    terms = tables.save(kept_terms(count_terms(docs, text, lang, source), least), "terms")
    vectors = terms.groupBy("lang", "entries").agg(F.count(F.lit(1)).alias("m")).withColumn("id", F.monotonically_increasing_id())
    vectors = tables.save(vectors, "vectors")
    entries = vectors.select("id", "lang", "m", F.explode("entries").alias("e")).select("id", "lang", "m", "e.source", "e.n")

    of = lambda c, n: F.coalesce(F.col(quoted(c)), F.lit("")).alias(n)
    words = entries.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("total"))
    whole = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_total"))
    groups = docs.select(of(lang, "lang"), of(source, "source")).distinct().join(words, ["lang", "source"], "left").join(whole, "lang", "left")
    groups = groups.fillna(0, ["total", "kept", "lang_total"])
    z = F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))).otherwise(1)
    groups = broadcast_if_small(tables.save(groups.withColumn("z", z), "groups"))

    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("y"))
    base = groups.join(other, "lang").where("source != item").select("lang", "source", "item", (F.col("kept") * divergence(F.col("z"), F.col("y"))).alias("v"))
    counts = entries.groupBy("lang", "source", "n").agg(F.sum("m").alias("m")).join(groups, ["lang", "source"])
    counts = counts.select("lang", "source", "m", "z", share(F.col("n"), F.col("total"), F.col("kept")).alias("p")).join(other, "lang").where("source != item")
    p, z, y, m = (F.col(c) for c in "pzym")
    alone = F.array(
        F.struct("source", "item", (m * (divergence(p, y) - divergence(z, y))).alias("v")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (m * (divergence(y, p) - divergence(y, z))).alias("v")),
    )
    alone = counts.select("lang", F.explode(alone).alias("e")).select("lang", "e.source", "e.item", "e.v")
    met = entries.join(groups, ["lang", "source"]).select("id", "lang", "m", "source", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), "z")
    met = met.groupBy("id", "lang", "m").agg(F.collect_list(F.struct("source", "p", "z")).alias("entries")).where(F.size("entries") > 1)
    value = F.sum(F.col("v").cast("decimal(38,0)")).cast("long").alias("value")
    pairs = base.union(alone).union(_met(met)).groupBy("lang", "source", "item").agg(value)

    own = terms.select("lang", "term", F.col("total").alias("n_lang"), F.explode("entries").alias("e")).join(groups.withColumnRenamed("source", "s"), [F.col("e.source") == F.col("s"), terms["lang"] == groups["lang"]])
    own = own.select(terms["lang"], F.col("s").alias("source"), F.col("term").alias("item"), share(F.col("e.n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("n_lang"), F.col("lang_total"), F.col("kept")).alias("q"))
    own = own.where("p > q").select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))

    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank)
    return ranked(pairs, "pair").union(ranked(own, "term").where(F.col("rank") <= top))
