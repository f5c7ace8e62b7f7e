"""Queries that lay reads and mates on the graph, and that correct reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.catalog import register
from readloom.operators import bridging as B
from readloom.operators import cleanup as CU
from readloom.operators import correction as X
from readloom.operators import graph as G
from readloom.operators import kmers as K
from readloom.operators import laying as L
from readloom.operators import nodebins as N
from readloom.operators import order as O
from readloom.plans.graph import _LAID, _UNITIGS, LENGTH, RARE, _unitigs
from readloom.session import Tables
from readloom.sources import dna
from readloom.sources.dna import sql

#: Windows between the mates of a query: 200 bases.
APART = 3
#: Bases from one noisy read to the next: a base is read ten times.
STRIDE = 10

#: A laid read's steps begin at its own start and wherever a unitig starts.
_PATHS = (
    ", ux AS (SELECT first_kmer AS unitig, i AS off, substr(seq, i, 24) AS kmer FROM u, unnest(range(1, length(seq) - 22)) t(i)),"
    " steps AS (SELECT read_id, row_number() OVER (PARTITION BY read_id ORDER BY i) - 1 AS step, unitig FROM"
    " (SELECT read_id, i, substr(seq, i, 24) AS kmer FROM reads SEMI JOIN laid USING (read_id), unnest(range(1, 78)) t(i)) JOIN ux USING (kmer) WHERE i = 1 OR off = 1)"
)
_KNOWN = "SELECT path, count(*) AS n FROM (SELECT string_agg(unitig, '>' ORDER BY step) AS path FROM steps GROUP BY read_id HAVING count(*) >= 3) GROUP BY path"
_MATES = (
    _PATHS + ", paths AS (SELECT read_id, list(unitig ORDER BY step) AS p FROM steps GROUP BY read_id),"
    f" mates AS (SELECT p.p, q.p AS q, p.p[-1] AS a, q.p[1] AS b FROM reads r JOIN reads s ON r.doc_id = s.doc_id AND r.j + {APART} = s.j JOIN paths p ON p.read_id = r.read_id JOIN paths q ON q.read_id = s.read_id),"
    " link AS (SELECT DISTINCT src, dst, length(seq) - 23 AS adds FROM ue JOIN u ON first_kmer = dst),"
    " goal AS (SELECT DISTINCT a, b FROM mates WHERE a <> b AND NOT EXISTS (SELECT 1 FROM ue WHERE src = a AND dst = b)),"
    " walk AS (SELECT a, b, a AS at_node, 0 AS n, [a] AS path FROM goal UNION ALL SELECT w.a, w.b, l.dst, w.n + CASE WHEN l.dst = w.b THEN 0 ELSE l.adds END, list_append(w.path, l.dst)"
    " FROM walk w JOIN link l ON l.src = w.at_node WHERE w.at_node <> w.b AND len(w.path) <= 7 AND w.n + CASE WHEN l.dst = w.b THEN 0 ELSE l.adds END <= 300),"
    " ways AS (SELECT a, b, any_value(path) AS w, CAST(any_value(n) AS BIGINT) AS n_bases FROM walk WHERE at_node = b GROUP BY a, b HAVING count(*) = 1)"
)
# a name is free only once in a statement
_MATES = _MATES.replace(" link AS", " hop AS").replace("JOIN link l", "JOIN hop l")


@register("read_paths", _UNITIGS + _LAID + _PATHS + " SELECT read_id, CAST(step AS INT) AS step, unitig FROM steps")
def read_paths(spark, d):
    return L.laid_paths(dna.reads(spark, d), _unitigs(spark, d)[0], 3)


@register("known_paths", _UNITIGS + _LAID + _PATHS + " " + _KNOWN)
def known_paths(spark, d):
    """Paths of three nodes or more that reads follow."""
    return L.known_paths(read_paths(spark, d))


@register("path_edges", _UNITIGS + _LAID + " SELECT src, dst, support FROM sup WHERE support > 0")
def path_edges(spark, d):
    """Support of the graph's edges by consecutive steps; the SQL counts k-mers instead."""
    return L.path_edges(read_paths(spark, d))


def _mates(spark, d):
    """Laid left and right mates: windows of a document with ``APART - 1`` windows between them."""
    u, links = _unitigs(spark, d)
    steps = Tables(spark, "paths").save(L.laid_paths(dna.reads(spark, d), u, 3), "steps")
    left = steps.select(F.col("read_id").alias("pair_id"), "step", "unitig")
    # windows are numbered within a document, so the right mate is the read some numbers on
    right = steps.select((F.col("read_id") - APART).alias("pair_id"), "step", "unitig")
    return u, links, left, right


@register("mate_ways")
def mate_ways(spark, d):
    """The ways between mates of which there is only one, on the graph of overlapping reads: mates lie 200 bases apart.
    Unlike the other graphs here it has whole documents, whose chains no recursive SQL walks."""
    t = Tables(spark, "mate-ways")
    reads = dna.overlapping_reads(spark, d)
    u, links = N.condensed(reads, K.K, 3)
    steps = t.save(L.laid_paths(reads, u, 3), "steps")
    left = steps.withColumnRenamed("read_id", "pair_id")
    right = steps.select((F.col("read_id") - 8).alias("pair_id"), "step", "unitig")
    return L.unique_ways(L.mate_goals(left, right, links), u, links)


@register(
    "mate_paths",
    _UNITIGS + _LAID + _MATES + ", ends AS (SELECT p[1:len(p) - 1] AS x, w, q[2:] AS y FROM mates JOIN ways USING (a, b) UNION ALL SELECT p[1:len(p) - 1], [a], q[2:] FROM mates WHERE a = b)"
    " SELECT path, count(*) AS n FROM (SELECT array_to_string(list_concat(x, w, y), '>') AS path FROM ends WHERE len(x) + len(w) + len(y) >= 3) GROUP BY path",
)
def mate_paths(spark, d):
    """Known paths along both mates and the only way between them."""
    u, links, left, right = _mates(spark, d)
    ways = L.unique_ways(L.mate_goals(left, right, links), u, links)
    return L.mate_paths(left, right, ways)


def _cleaned(spark, d):
    u, links = _unitigs(spark, d)
    nodes, links = CU.condensed(u, G.prevalences(u), links)
    return CU.clean(nodes, links, LENGTH, RARE)


@register("cleaned_nodes")
def cleaned_nodes(spark, d):
    """Nodes of the graph after suspicious ones are removed, similar ones collapsed and chains condensed."""
    return _cleaned(spark, d)[0]


@register("bridged_nodes")
def bridged_nodes(spark, d):
    """Nodes of the cleaned graph after ambiguous ones are split along the reads that bridge them."""
    nodes, links = _cleaned(spark, d)
    return B.bridge_all(nodes, links, dna.reads(spark, d))[0]


#: Nodes of the graph of frequent edges have so many bases; an edge is frequent from this share of all on.
SHORT, FREQUENT = 11, 1e-5

_FREQUENT = (
    f"fc AS (SELECT substr(seq, i, {SHORT + 1}) AS kmer, count(*) AS cnt FROM reads, unnest(range(1, {101 - SHORT})) t(i) GROUP BY kmer)",
    f"fe AS (SELECT left(kmer, {SHORT}) AS src, right(kmer, {SHORT}) AS dst FROM fc WHERE cnt >= {FREQUENT}::DOUBLE * (SELECT sum(cnt) FROM fc))",
    "reach AS (SELECT src AS a, dst AS b FROM fe UNION SELECT r.a, e.dst FROM reach r JOIN fe e ON e.src = r.b)",
    "strong AS (SELECT x.a AS node, max(x.b) AS component, count(*) AS size FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)",
)


def _recursive(*names: str, body: str) -> str:
    return sql(*names, body=body).replace("WITH ", "WITH RECURSIVE ", 1)


def frequent_edges(spark, d):
    """Edges of the short graph that many reads hold: it has cycles, unlike that of long k-mers."""
    t = Tables(spark, "frequent")
    counts = t.save(K.count_kmers(dna.reads(spark, d), SHORT + 1), "counts")
    every = counts.agg(F.sum("cnt").alias("every"))  # one row
    return t.save(K.dbg_edges(counts.join(F.broadcast(every)).where(F.col("cnt") >= F.lit(FREQUENT) * F.col("every")), SHORT).select("src", "dst"), "edges")


@register("strong_components", _recursive("seqs", "reads", *_FREQUENT, body="SELECT node, component, size FROM strong"))
def strong_components(spark, d):
    """Nodes of frequent edges that lie on cycles."""
    return O.strong_components(frequent_edges(spark, d))


@register(
    "topological_levels",
    _recursive(
        "seqs", "reads", *_FREQUENT,
        "de AS (SELECT src, dst FROM fe LEFT JOIN strong a ON a.node = src LEFT JOIN strong b ON b.node = dst WHERE a.component IS DISTINCT FROM b.component OR a.component IS NULL)",
        "fn AS (SELECT src AS node FROM fe UNION SELECT dst FROM fe)",
        "walk AS (SELECT node, 0 AS level, 0 AS before FROM fn WHERE node NOT IN (SELECT dst FROM de) UNION ALL SELECT e.dst, w.level + 1, w.before + 1 + ascii(right(w.node, 1)) FROM walk w JOIN de e ON e.src = w.node)",
        body="SELECT node, CAST(max(level) AS BIGINT) AS level, CAST(max(before) AS BIGINT) AS longest, count(*) AS walks FROM walk GROUP BY node",
    ),
)
def topological_levels(spark, d):
    """Levels, heaviest ways and numbers of walks on the frequent edges between strong components; a node weighs one more
    than the code of its last base."""
    e = frequent_edges(spark, d)
    strong = Tables(spark, "strong").save(O.strong_components(e), "strong")
    side = lambda end: strong.select(F.col("node").alias(end), F.col("component").alias("c_" + end))
    apart = e.join(side("src"), "src", "left").join(side("dst"), "dst", "left").where("c_src is null or c_dst is null or c_src != c_dst")
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("size", F.ascii(F.substring("node", -1, 1)) + 1)
    return O.peel(nodes, apart.select("src", "dst")).withColumn("walks", F.col("walks").cast("long"))


@register("level_flow")
def level_flow(spark, d):
    """Paths of the unitig graph by sparse flow, a level at a time; edges inside a strong component are left out."""
    from readloom.operators.levelflow import flow_paths

    t = Tables(spark, "flow")
    links = t.save(_unitigs(spark, d)[1].select("src", "dst", F.col("cnt").cast("double").alias("w")), "links")
    strong = t.save(O.strong_components(links), "strong")
    side = lambda end: strong.select(F.col("node").alias(end), F.col("component").alias("c_" + end))
    links = t.save(links.join(side("src"), "src", "left").join(side("dst"), "dst", "left").where("c_src is null or c_dst is null or c_src != c_dst").select("src", "dst", "w"), "acyclic")
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("w").alias("weight")), F.struct(F.col("dst").alias("node"), F.lit(0.0).alias("weight")))).alias("x")
    nodes = links.select(ends).groupBy("x.node").agg(F.sum("x.weight").alias("weight"))
    return flow_paths(nodes, links).select(F.array_join("path", ">").alias("path"), F.round("flow", 6).alias("flow"))


def noisy_reads(spark, d):
    """``(read_id, true_seq, seq, qual)``: overlapping reads, a base replaced in every fifth and a second one in every
    thirty-fifth; every second of the former has a low quality there."""
    r = dna.overlapping_reads(spark, d, STRIDE).withColumn("h", F.col("read_id") % 1_000_000 * 17 + F.floor(F.col("read_id") / 1_000_000) * 31)
    places = [((F.col("h") * m + a) % dna.READ + 1).cast("int") for m, a in ((37, 0), (11, 50))]
    swap = lambda s, p: F.overlay(s, F.translate(F.substring(s, p, F.lit(1)), "ACGT", "CGTA"), p)
    once = F.when(F.col("h") % 5 == 0, swap(F.col("seq"), places[0])).otherwise(F.col("seq"))
    twice = F.when(F.col("h") % 35 == 0, swap(F.col("one"), places[1])).otherwise(F.col("one"))
    plain = F.repeat(F.lit("I"), dna.READ)
    qual = F.when((F.col("h") % 10 == 0), F.overlay(plain, F.lit("#"), places[0])).otherwise(plain)
    return r.withColumn("one", once).select("read_id", F.col("seq").alias("true_seq"), twice.alias("seq"), qual.alias("qual"))


_SWAP = "substr({0}, 1, {1} - 1) || translate(substr({0}, {1}, 1), 'ACGT', 'CGTA') || substr({0}, {1} + 1)"
_NOISY = (
    "r0 AS (SELECT doc_id * 31 + j * 17 AS h, substr(seq, 10 * j + 1, 100) AS s FROM seqs, unnest(range(0, (length(seq) - 100) // 10 + 1)) t(j) WHERE length(seq) >= 100)",
    "r1 AS (SELECT *, CAST(h * 37 % 100 + 1 AS INT) AS p, CAST((h * 11 + 50) % 100 + 1 AS INT) AS q FROM r0)",
    f"r2 AS (SELECT h, p, q, CASE WHEN h % 5 = 0 THEN {_SWAP.format('s', 'p')} ELSE s END AS s FROM r1)",
    f"r3 AS (SELECT h, p, CASE WHEN h % 35 = 0 THEN {_SWAP.format('s', 'q')} ELSE s END AS s FROM r2)",
    # a base of low quality is in no k-mer that counts
    "kc AS (SELECT substr(s, i, 25) AS kmer, count(*) AS cnt FROM r3, unnest(range(1, 77)) t(i) WHERE NOT (h % 10 = 0 AND p BETWEEN i AND i + 24) GROUP BY kmer)",
    "hist AS (SELECT cnt, count(*) AS n FROM kc GROUP BY cnt)",
    "low AS (SELECT coalesce(min(CASE WHEN b.n >= a.n THEN a.cnt WHEN b.n IS NULL AND a.cnt < (SELECT max(cnt) FROM hist) THEN a.cnt + 1 END), 1) AS c FROM hist a LEFT JOIN hist b ON b.cnt = a.cnt + 1)",
)


@register("kmer_spectrum", sql("seqs", *_NOISY, body="SELECT cnt, n, cnt >= (SELECT c FROM low) AS is_trusted FROM hist"))
def kmer_spectrum(spark, d):
    """The spectrum of noisy reads, parted at its valley."""
    r = noisy_reads(spark, d)
    counts = K.count_kmers(r.select(X.masked(F.col("seq"), F.col("qual"), 5).alias("seq")), 25)
    hist = Tables(spark, "spectrum").save(X.spectrum(counts), "hist")
    return hist.withColumn("is_trusted", F.col("cnt") >= X.valley(hist))


@register("untrusted_kmers", sql("seqs", *_NOISY, body="SELECT read_id, count(*) AS n_untrusted, CAST(min(i) AS INT) AS first, CAST(max(i) AS INT) AS last FROM (SELECT doc_id * 1000000 + j AS read_id, i, substr(s, i, 25) AS kmer FROM (SELECT doc_id, j, h, p, " + "CASE WHEN h % 35 = 0 THEN " + _SWAP.format("s", "q") + " ELSE s END AS s FROM (SELECT doc_id, j, h, p, q, CASE WHEN h % 5 = 0 THEN " + _SWAP.format("s", "p") + " ELSE s END AS s FROM (SELECT doc_id, j, h, s, CAST(h * 37 % 100 + 1 AS INT) AS p, CAST((h * 11 + 50) % 100 + 1 AS INT) AS q FROM (SELECT doc_id, j, doc_id * 31 + j * 17 AS h, substr(seq, 10 * j + 1, 100) AS s FROM seqs, unnest(range(0, (length(seq) - 100) // 10 + 1)) t(j) WHERE length(seq) >= 100)))), unnest(range(1, 77)) t(i)) ANTI JOIN (SELECT kmer FROM kc WHERE cnt >= (SELECT c FROM low)) USING (kmer) GROUP BY read_id"))
def untrusted_kmers(spark, d):
    """How many k-mers of a noisy read are untrusted, and where."""
    # reads, ten for each base, and the k-mers of errors are more than the input: neither is written, k-mers are counted twice
    r = noisy_reads(spark, d).select("read_id", "seq", "qual")
    seen = r.select(X.masked(F.col("seq"), F.col("qual"), 5).alias("seq"))
    cutoff = X.valley(Tables(spark, "untrusted").save(X.spectrum(K.count_kmers(seen, 25)), "hist"))
    bad = X.untrusted(r, K.count_kmers(seen, 25, cutoff), 25)
    return bad.select("read_id", F.size("bad").cast("long").alias("n_untrusted"), F.col("bad")[0].alias("first"), F.element_at("bad", -1).alias("last"))


@register("read_correction")
def read_correction(spark, d):
    """Noisy reads corrected; ``is_true``: equal to what was written before bases were replaced."""
    r = Tables(spark, "noisy").save(noisy_reads(spark, d), "reads")
    out = X.correct(r.drop("true_seq")).join(r.select("read_id", "true_seq"), "read_id")
    return out.select("read_id", "status", "n_replaced", "cost", "seq", (F.col("seq") == F.col("true_seq")).alias("is_true"))


@register("pair_correction")
def pair_correction(spark, d):
    """Noisy reads 200 bases apart as mates, by what correction leaves of them."""
    r = Tables(spark, "noisy").save(noisy_reads(spark, d).drop("true_seq"), "reads")
    mates = r.select(F.col("read_id").alias("pair_id"), F.col("read_id").alias("left_id"), (F.col("read_id") + 200 // STRIDE).alias("right_id"))
    mates = mates.join(r.select(F.col("read_id").alias("right_id")), "right_id", "left_semi")
    return X.part_mates(mates, X.correct(r))


@register("gapped_alignments")
def gapped_alignments(spark, d):
    """Contigs against the reference transcripts, with gaps and on both strands."""
    from readloom.operators.alignment import align

    q = dna.contigs(spark, d).select(F.col("contig_id").alias("name"), "seq")
    return align(q, dna.truth(spark, d).select(F.col("t_id").alias("name"), "seq"))


@register("eulerian_walks")
def eulerian_walks(spark, d):
    """Circuits through all 8-mers of the reference transcripts, each closed to a ring: every node is balanced."""
    from readloom.operators.circuits import eulerian_walks as walks

    ring = dna.truth(spark, d).where("length(seq) >= 8").select(F.concat("seq", F.substring("seq", 1, 8)).alias("s"), F.length("seq").alias("n"))
    at = ring.select("s", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    e = at.select(F.monotonically_increasing_id().alias("edge"), F.substring("s", F.col("i"), F.lit(8)).alias("src"), F.substring("s", F.col("i") + 1, F.lit(8)).alias("dst"))
    return walks(Tables(spark, "rings").save(e, "edges"))
