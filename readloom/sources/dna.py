"""The DNA view: reads, pairs and contigs that both engines derive alike from ``documents``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from readloom.functions import sequence as S
from readloom.session import spread, table

READ, CONTIG = 100, 400
#: Windows a document can have at most.
SPAN = 1_000_000
#: Bases that are cut into pieces at once, about, and pieces of a batch.
AT_ONCE, PIECES = 8_000_000, 20_000


def _letters(bases: str):
    """The table that turns letters into bases and the bytes that it leaves out: all others, those of longer characters too."""
    table_ = bytes.maketrans(S.LETTERS.encode(), bases.encode())
    return table_, bytes(sorted(set(range(256)) - set(S.LETTERS.encode())))


def sequences(spark: SparkSession, sf_dir: str, bases: str = S.BASES, source: str = "documents", key: str = "doc_id") -> DataFrame:
    """``(doc_id, seq)``: a text's letters as bases."""
    texts = spread(table(spark, sf_dir, source).where("text is not null").select(key, "text"))
    to, gone = _letters(bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = [t.encode("utf-8", "surrogatepass").translate(to, gone) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _strings(seqs)], [key, "seq"])

    return texts.mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, seq string")


def _strings(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) for p in parts])
    return pa.LargeStringArray.from_buffers(len(parts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(b"".join(parts))).cast(pa.string())


def _cut(seqs: DataFrame, width: int, stride: int, whole: bool, name: str) -> DataFrame:
    """``(name, doc_id, j, seq)``: pieces of ``width`` bases at every ``stride``; without ``whole`` shorter ones at the end too.

    They are cut in Arrow batches, so that a piece costs its own bases wherever it stands in a long text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, seqs_ = b.column(0), [(s or "").encode() for s in b.column(1).to_pylist()]
            lo = size = 0
            for hi, s in enumerate(seqs_ + [None]):
                if s is None or size and size + len(s) * width // stride > AT_ONCE:
                    yield from some(docs.slice(lo, hi - lo), seqs_[lo:hi])
                    lo, size = hi, 0
                size += len(s or "") * width // stride

    def some(docs: pa.Array, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        length = np.array([len(p) for p in parts], np.int64)
        n = np.maximum((length - width) // stride + 1, 0) if whole else -(-length // stride)
        own = np.repeat(np.arange(len(parts)), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text = np.frombuffer(b"".join(parts), np.uint8)
        start = (np.cumsum(length) - length)[own] + j * stride
        wide = np.minimum(width, length[own] - j * stride)
        docs = docs.take(pa.array(own))
        for lo in range(0, len(j), PIECES):
            part = slice(lo, lo + PIECES)
            ends = np.cumsum(wide[part])
            if whole:  # rows of one width are copied as such
                bases = np.lib.stride_tricks.sliding_window_view(text, width)[start[part]]
            else:
                bases = text[np.arange(ends[-1]) + np.repeat(start[part] - (ends - wide[part]), wide[part])]
            seq = pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(bases))
            yield pa.RecordBatch.from_arrays([docs.slice(lo, PIECES), pa.array(j[part]), seq], ["doc_id", "j", "seq"])

    kind = seqs.schema["doc_id"].dataType.simpleString()
    out = seqs.select("doc_id", "seq").mapInArrow(run, f"doc_id {kind}, j long, seq string")
    return out.select((F.col("doc_id") * SPAN + F.col("j")).alias(name), "doc_id", "j", "seq")


def windows(seqs: DataFrame, width: int, whole: bool, name: str) -> DataFrame:
    """Non-overlapping windows; ``whole`` leaves out a shorter last one."""
    return _cut(seqs, width, width, whole, name)


def reads(spark: SparkSession, sf_dir: str, bases: str = S.BASES) -> DataFrame:
    """``(read_id, doc_id, j, seq)``: windows of 100 bases."""
    return windows(sequences(spark, sf_dir, bases), READ, True, "read_id")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(contig_id, doc_id, j, seq)``: windows of up to 400 bases."""
    return windows(sequences(spark, sf_dir), CONTIG, False, "contig_id")


def overlapping_reads(spark: SparkSession, sf_dir: str, stride: int = 25) -> DataFrame:
    """``(read_id, seq)``: windows of 100 bases at every ``stride``, so that reads overlap as sequenced ones do."""
    return _cut(sequences(spark, sf_dir), READ, stride, True, "read_id").select("read_id", "seq")


def overlapping_pairs(spark: SparkSession, sf_dir: str, stride: int = 25, apart: int = 200) -> DataFrame:
    """``(pair_id, seq1, seq2)``: the ends of pieces of ``apart + 100`` bases at every ``stride``, facing each other."""
    pieces = _cut(sequences(spark, sf_dir), READ + apart, stride, True, "pair_id")
    ends = F.substring("seq", 1, READ), F.substring("seq", apart + 1, READ)
    return pieces.select("pair_id", ends[0].alias("seq1"), S.reverse_complement(ends[1]).alias("seq2"))


def pairs(spark: SparkSession, sf_dir: str, bases: str = S.BASES) -> DataFrame:
    """``(pair_id, seq1, seq2)``: a read and the reverse complement of the next one of its document."""
    both = _cut(sequences(spark, sf_dir, bases), 2 * READ, READ, True, "pair_id")  # a read and the next lie beside each other
    return both.select("pair_id", F.substring("seq", 1, READ).alias("seq1"), S.reverse_complement(F.substring("seq", READ + 1, READ)).alias("seq2"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(t_id, seq)``: the benchmark passages as reference transcripts."""
    return sequences(spark, sf_dir, source="benchmark", key="item_id").withColumnRenamed("item_id", "t_id")


_DNA = f"translate(regexp_replace(text, '[^a-zA-Z]', '', 'g'), '{S.LETTERS}', '{S.BASES}')"

#: The same relations as common table expressions for the SQL oracles.
SQL = {
    "seqs": f"seqs AS (SELECT doc_id, {_DNA} AS seq FROM documents WHERE text IS NOT NULL)",
    "seqs_n": f"seqs AS (SELECT doc_id, {_DNA.replace(S.BASES, S.BASES_N)} AS seq FROM documents WHERE text IS NOT NULL)",
    "reads": "reads AS (SELECT doc_id * 1000000 + j AS read_id, doc_id, j, substr(seq, 1 + 100 * j, 100) AS seq FROM seqs, unnest(range(0, length(seq) // 100)) t(j))",
    "contigs": "contigs AS (SELECT doc_id * 1000000 + j AS contig_id, doc_id, j, substr(seq, 1 + 400 * j, 400) AS seq FROM seqs, unnest(range(0, (length(seq) + 399) // 400)) t(j))",
    "pairs": "pairs AS (SELECT a.read_id AS pair_id, a.seq AS seq1, translate(reverse(b.seq), 'ACGT', 'TGCA') AS seq2 FROM reads a JOIN reads b ON a.doc_id = b.doc_id AND a.j + 1 = b.j)",
    "k1": "k1 AS (SELECT kmer, count(*) AS cnt FROM (SELECT substr(seq, i, 25) AS kmer FROM reads, unnest(range(1, 77)) t(i)) GROUP BY kmer HAVING count(*) >= 3)",
    "edges": "edges AS (SELECT substr(kmer, 1, 24) AS src, substr(kmer, 2, 24) AS dst, cnt FROM k1)",
    "nodes": "nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)",
    "c24": "c24 AS (SELECT contig_id, i AS pos, substr(seq, i, 24) AS kmer FROM contigs, unnest(range(1, length(seq) - 22)) t(i))",
    "cedges": "cedges AS (SELECT a.contig_id AS src, b.contig_id AS dst, count(*) AS w FROM c24 a JOIN c24 b ON a.kmer = b.kmer AND a.contig_id < b.contig_id GROUP BY ALL)",
    "truth": f"truth AS (SELECT item_id AS t_id, {_DNA} AS seq FROM benchmark WHERE text IS NOT NULL)",
}


def sql(*names: str, body: str) -> str:
    """A statement over the named relations."""
    return "WITH " + ", ".join(SQL.get(n, n) for n in names) + " " + body
