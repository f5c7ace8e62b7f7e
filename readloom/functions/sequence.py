"""Column functions on DNA strings; all run inside the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

LETTERS = string.ascii_lowercase + string.ascii_uppercase
#: Fixed values of the DNA view: what each letter of a text becomes.
BASES = ("ACGT" * 6 + "AC") * 2
#: The same with the letter x as an unread base.
BASES_N = "".join("N" if a in "xX" else b for a, b in zip(LETTERS, BASES))


def reverse_complement(seq: Column) -> Column:
    """Bases in reverse order, each replaced by its partner; N stays."""
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def kmers(seq: Column, k: int) -> Column:
    """All overlapping windows of ``k`` bases as an array; shorter sequences have none."""
    n = F.length(seq) - (k - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(
        F.array().cast("array<string>")
    )


def explode_kmers(df, keep: list[str], seq: str, k: int):
    """``(keep, pos, kmer)``: a row for every window of ``k`` bases, positions from 1.

    Positions are exploded, not an array of windows, so that cutting them out
    stays in generated code.
    """
    at = F.explode(F.sequence(F.lit(1), F.length(seq) - (k - 1))).alias("pos")
    rows = df.where(F.length(seq) >= k).select(*keep, F.col(seq).alias("_s"), at)
    return rows.select(*keep, "pos", F.substring(F.col("_s"), F.col("pos"), F.lit(k)).alias("kmer"))


def kmers_at(seq: Column, k: int) -> Column:
    """Windows with their positions from 1, as an array of ``(pos, kmer)``."""
    return F.transform(kmers(seq, k), lambda x, i: F.struct((i + 1).cast("int").alias("pos"), x.alias("kmer")))


def tiles(seq: Column, r: int) -> Column:
    """Windows at multiples of ``r`` that start before the last window, and the last window."""
    n = F.length(seq) - r
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(r))).otherwise(F.array().cast("array<int>"))
    return F.when(n >= 0, F.transform(F.array_union(starts, F.array(n)), lambda i: F.substring(seq, i + 1, F.lit(r)))).otherwise(
        F.array().cast("array<string>")
    )


def top_base_count(seq: Column) -> Column:
    """Occurrences of the most frequent base."""
    return F.greatest(*(F.length(seq) - F.length(F.replace(seq, F.lit(b), F.lit(""))) for b in "ACGT"))


def low_complexity(seq: Column) -> Column:
    """Whether all but at most two bases are the same."""
    return top_base_count(seq) >= F.length(seq) - 2


def has_unread(seq: Column) -> Column:
    """Whether a character other than A, C, G, T occurs."""
    return seq.rlike("[^ACGT]")


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def code(kmer: Column) -> Column:
    """A k-mer of at most 31 bases as a number, two bits a base."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def mismatches(a: Column, b: Column) -> Column:
    """Positions at which two strings of equal length differ."""
    return F.aggregate(
        F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x
    )


def same_prefix(a: Column, b: Column) -> Column:
    """Whether the shorter string is a prefix of the longer."""
    return F.startswith(a, b) | F.startswith(b, a)


def key_part(key: Column, part: int, parts: int) -> Column:
    """The ``part``-th of ``parts`` slices of a key, cut at whole positions."""
    n = F.length(key)
    lo = F.floor(n * part / F.lit(parts)).cast("int")
    hi = F.floor(n * (part + 1) / F.lit(parts)).cast("int")
    return F.substring(key, lo + 1, hi - lo)


def hyperbola_score(length: Column, weight: Column) -> Column:
    """Length times the fourth root of the mean weight."""
    return length * F.pow(weight, F.lit(0.25))


def accepted(length: Column, weight: Column, min_length: int = 75, min_weight: float = 3.0) -> Column:
    """Long and heavy enough: twice the hyperbola of the limits, and the length itself."""
    return (length >= min_length) & (hyperbola_score(length, weight) >= 2 * min_length * min_weight**0.25)


def common_string(a: Column, b: Column) -> Column:
    """Characters that are equal at the same position."""
    pairs = F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    return F.array_join(F.transform(F.filter(pairs, lambda p: p["x"] == p["y"]), lambda p: p["x"]), "")


def trim_homopolymer_ends(seq: Column, shortest: int = 13) -> Column:
    """The sequence without runs of A or T of at least ``shortest`` at either end."""
    run = f"(?:A{{{shortest},}}|T{{{shortest},}})"
    return F.regexp_replace(F.regexp_replace(seq, f"^{run}", ""), f"{run}$", "")


#: A start of T and an end of A, each with one other base at most, that begins and ends as told.
TAIL_START, TAIL_END = "^(?:T*[^T])?T+", "A+(?:[^A]A*)?$"


def trim_tails(seq: Column) -> Column:
    """The sequence without a start of T and an end of A, one other base allowed in each; short ones go as well."""
    cut = [F.length(F.regexp_extract(seq, x, 0)) for x in (TAIL_START, TAIL_END)]
    return F.substring(seq, cut[0] + 1, F.greatest(F.length(seq) - cut[0] - cut[1], F.lit(0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nth_largest(values: Column, n: int) -> Column:
    """The ``n``-th largest value, from 1; null beyond the end."""
    return F.get(F.sort_array(values, asc=False), F.lit(n - 1))


def is_number(text: Column) -> Column:
    return F.expr("false") if text is None else text.try_cast("double").isNotNull()
