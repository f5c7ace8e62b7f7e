"""Queries on contigs: graph, routing, redundancy, evaluation, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from readloom.catalog import register
from readloom.functions import sequence as S
from readloom.operators import contigs as C
from readloom.operators.kmers import count_kmers
from readloom.operators.numbering import row_numbers_within
from readloom.session import Tables
from readloom.sources import dna
from readloom.sources.dna import SQL, sql

RC = "translate(reverse({0}), 'ACGT', 'TGCA')"
SIZE = 5


def _edges(spark, d):
    return C.contig_edges(dna.contigs(spark, d))


def _components(spark, d):
    c = dna.contigs(spark, d)
    return C.contig_components(c, C.contig_links(c))


@register("contig_edges", sql("seqs", "contigs", "c24", "cedges", body="SELECT src, dst, w FROM cedges"))
def contig_edges(spark, d):
    return _edges(spark, d)


# components by label spreading: each round every node takes the least label around it
_COMP = (
    "WITH RECURSIVE " + ", ".join(SQL[n] for n in ("seqs", "contigs", "c24", "cedges"))
    + ", both_ends AS (SELECT src, dst FROM cedges UNION SELECT dst, src FROM cedges),"
    " reach AS (SELECT DISTINCT src AS contig_id, src AS root FROM both_ends UNION SELECT b.dst, r.root FROM reach r JOIN both_ends b ON b.src = r.contig_id WHERE b.dst > r.root),"
    " comps AS (SELECT c.contig_id, coalesce(min(r.root), c.contig_id) AS comp FROM contigs c LEFT JOIN reach r USING (contig_id) GROUP BY c.contig_id)"
)


@register("contig_components", _COMP + " SELECT * FROM comps")
def contig_components(spark, d):
    return _components(spark, d)


@register("component_stats", _COMP + ", s AS (SELECT comp, count(*) AS n FROM comps GROUP BY comp) SELECT s.comp, s.n, (SELECT count(*) FROM cedges JOIN comps ON contig_id = src WHERE comps.comp = s.comp) AS connections FROM s")
def component_stats(spark, d):
    c = dna.contigs(spark, d)
    m = Tables(spark, "component-stats").save(C.contig_components(c, C.contig_links(c)), "comps")
    n = m.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    k = C.pair_counts(c).join(m, "contig_id").groupBy("comp").agg(F.sum("n").alias("connections"))
    return n.join(k, "comp", "left").select("comp", "n", F.coalesce("connections", F.lit(0)).alias("connections"))


_ROUTE = f", n AS (SELECT comp, count(*) AS n FROM comps GROUP BY comp), r AS (SELECT *, CASE WHEN n = 1 THEN 'single' WHEN n > {SIZE} THEN 'big' ELSE 'small' END AS route FROM n)"


_BINS = (
    f", o AS (SELECT comp, n, row_number() OVER (ORDER BY comp) AS i FROM r WHERE route = 'small'),"
    f" pack AS (SELECT comp, i, CAST(0 AS BIGINT) AS bin, CASE WHEN n > {SIZE} THEN 0 ELSE n END AS size, n > {SIZE} AS closed FROM o WHERE i = 1"
    f" UNION ALL SELECT o.comp, o.i, p.bin + CASE WHEN p.closed THEN 1 ELSE 0 END, CASE WHEN p.size + o.n > {SIZE} THEN 0 ELSE p.size + o.n END, p.size + o.n > {SIZE} FROM pack p JOIN o ON o.i = p.i + 1)"
)


@register("component_routing", _COMP + _ROUTE + _BINS + f" SELECT r.comp, r.n, route, CASE WHEN route = 'big' THEN least((r.n + {SIZE - 1}) // {SIZE}, 100) END AS parts, bin FROM r LEFT JOIN pack ON pack.comp = r.comp")
def component_routing(spark, d):
    return C.component_routing(_components(spark, d), SIZE)


@register("assignment_counts", _COMP + _ROUTE + " SELECT count(*) FILTER (route = 'single') AS singles, count(*) FILTER (route = 'small') AS simple, count(*) FILTER (route = 'big') AS complex, CAST(coalesce(sum(n) FILTER (route = 'big'), 0) AS BIGINT) AS complex_contigs FROM r")
def assignment_counts(spark, d):
    r = _components(spark, d).groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    r = r.withColumn("route", F.when(F.col("n") == 1, "single").when(F.col("n") > SIZE, "big").otherwise("small"))
    n = lambda x: F.count(F.when(F.col("route") == x, 1))
    return r.agg(n("single").alias("singles"), n("small").alias("simple"), n("big").alias("complex"), F.coalesce(F.sum(F.when(F.col("route") == "big", F.col("n"))), F.lit(0)).alias("complex_contigs"))


@register("single_contigs", _COMP + _ROUTE + " SELECT 'Single_' || row_number() OVER (ORDER BY contig_id) AS name, seq FROM contigs JOIN r ON comp = contig_id WHERE route = 'single'")
def single_contigs(spark, d):
    from readloom.operators.numbering import row_numbers

    c = dna.contigs(spark, d)
    n = C.contig_components(c, C.contig_links(c)).groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    single = n.where("n = 1").select(F.col("comp").alias("contig_id"))
    out = row_numbers(c.join(single, "contig_id", "left_semi").select("contig_id", "seq"), "contig_id", "n")
    return out.select(F.concat(F.lit("Single_"), "n").alias("name"), "seq")


@register("repartition_weights", sql("seqs", "contigs", "c24", "cedges", body="SELECT e.src, e.dst, CASE WHEN a.j % 2 <> b.j % 2 THEN 5 * w ELSE w END AS w FROM cedges e JOIN contigs a ON a.contig_id = e.src JOIN contigs b ON b.contig_id = e.dst"))
def repartition_weights(spark, d):
    c = dna.contigs(spark, d)
    return C.penalised(C.contig_edges(c), c.select("contig_id", (F.col("j") % 2).alias("part")))


_K25 = "c25 AS (SELECT contig_id, substr(seq, i, 25) AS kmer FROM contigs, unnest(range(1, length(seq) - 23)) t(i))"
_KCOMP = ", " + _K25 + ", kcomp AS (SELECT DISTINCT kmer, comp FROM c25 JOIN comps USING (contig_id))"


@register("k1mer_to_comp", _COMP + _KCOMP + " SELECT kmer, comp FROM kcomp")
def k1mer_to_comp(spark, d):
    return C.kmer_components(dna.contigs(spark, d), _components(spark, d))


@register("kmer_emission", _COMP + _KCOMP + f", {SQL['reads']}, {SQL['k1']} SELECT comp, kmer, coalesce(cnt, 0) AS cnt FROM kcomp LEFT JOIN k1 USING (kmer)")
def kmer_emission(spark, d):
    out = C.kmer_counts_of_components(dna.contigs(spark, d), _components(spark, d), dna.reads(spark, d), 25, 3)
    return out.select("comp", "kmer", "cnt")


def _tiles(seq: str) -> str:
    """The tiles of a sequence of 100 bases: starts 0, 25, 50 and the last, 75."""
    return ", ".join(f"substr({seq}, {s + 1}, 25)" for s in (0, 25, 50, 75))


@register("route_reads", _COMP + _KCOMP + f", {SQL['reads']} SELECT DISTINCT read_id, comp FROM (SELECT read_id, unnest([{_tiles('seq')}]) AS kmer FROM reads) JOIN kcomp USING (kmer)")
def route_reads(spark, d):
    return C.route_over(dna.reads(spark, d), "read_id", ["seq"], dna.contigs(spark, d), _components(spark, d))


@register("route_pairs", _COMP + _KCOMP + f", {SQL['reads']}, {SQL['pairs']} SELECT DISTINCT pair_id, comp FROM (SELECT pair_id, unnest([{_tiles('seq1')}, {_tiles('seq2')}]) AS kmer FROM pairs) JOIN kcomp USING (kmer)")
def route_pairs(spark, d):
    return C.route_over(dna.pairs(spark, d), "pair_id", ["seq1", "seq2"], dna.contigs(spark, d), _components(spark, d))


@register("route_pairs_both", _COMP + _KCOMP + f", {SQL['reads']}, {SQL['pairs']}, o AS (SELECT pair_id, 0 AS strand, seq1 AS a, {RC.format('seq2')} AS b FROM pairs UNION ALL SELECT pair_id, 1, seq2, {RC.format('seq1')} FROM pairs) SELECT DISTINCT pair_id, strand, comp FROM (SELECT pair_id, strand, unnest([{_tiles('a')}, {_tiles('b')}]) AS kmer FROM o) JOIN kcomp USING (kmer)")
def route_pairs_both(spark, d):
    """Pairs routed in both orders: the left mate with the right one turned, and the right mate with the left one turned."""
    rc = S.reverse_complement
    both = F.array(F.struct(F.col("seq1").alias("a"), rc(F.col("seq2")).alias("b")), F.struct(F.col("seq2").alias("a"), rc(F.col("seq1")).alias("b")))
    p = dna.pairs(spark, d).select("pair_id", F.posexplode(both).alias("strand", "m"))
    p = p.select((F.col("pair_id") * 2 + F.col("strand")).alias("key"), F.col("m.a").alias("a"), F.col("m.b").alias("b"))
    out = C.route_over(p, "key", ["a", "b"], dna.contigs(spark, d), _components(spark, d))
    return out.select(F.shiftright("key", 1).alias("pair_id"), F.col("key").bitwiseAND(1).cast("int").alias("strand"), "comp")


@register("read_cap", _COMP + ", own AS (SELECT c.doc_id, min(m.comp) AS comp FROM contigs c JOIN comps m USING (contig_id) GROUP BY 1), " + SQL["reads"] + ", cap AS (SELECT comp, 2 * count(*) AS cap FROM comps GROUP BY comp), r AS (SELECT read_id, comp, row_number() OVER (PARTITION BY comp ORDER BY read_id) AS read_no FROM reads JOIN own USING (doc_id)) SELECT read_id, comp, read_no FROM r JOIN cap USING (comp) WHERE read_no <= cap")
def read_cap(spark, d):
    """The first reads of each component, as many as twice its contigs."""
    c = dna.contigs(spark, d)
    m = C.contig_components(c, C.contig_links(c))
    own = c.join(m, "contig_id").groupBy("doc_id").agg(F.min("comp").alias("comp"))
    cap = m.groupBy("comp").agg((2 * F.count(F.lit(1))).alias("cap"))
    r = row_numbers_within(dna.reads(spark, d).join(own, "doc_id").select("read_id", "comp"), "comp", "read_id", "read_no")
    return r.join(cap, "comp").where("read_no <= cap").select("read_id", "comp", "read_no")


@register("contig_weights", sql("seqs", "reads", "k1", "contigs", _K25, body="SELECT contig_id, count(*) AS n_kmers, sum(coalesce(cnt, 0)) / greatest(count(*), 1)::DOUBLE AS avg_wt FROM c25 LEFT JOIN k1 USING (kmer) GROUP BY contig_id"))
def contig_weights(spark, d):
    return C.contig_weights(dna.contigs(spark, d), count_kmers(dna.reads(spark, d), hard=3))


@register("hyperbola_filter", sql("seqs", "reads", "k1", "contigs", _K25, "w AS (SELECT contig_id, sum(coalesce(cnt, 0)) / count(*)::DOUBLE AS avg_wt FROM c25 LEFT JOIN k1 USING (kmer) GROUP BY contig_id)", body="SELECT contig_id, round(length(seq) * pow(avg_wt, 0.25), 6) AS score FROM contigs JOIN w USING (contig_id) WHERE length(seq) >= 75 AND length(seq) * pow(avg_wt, 0.25) >= 2 * 75 * pow(3.0, 0.25)"))
def hyperbola_filter(spark, d):
    c = dna.contigs(spark, d)
    w = C.contig_weights(c, count_kmers(dna.reads(spark, d), hard=3))
    n = F.length("seq")
    return c.join(w, "contig_id").where(S.accepted(n, F.col("avg_wt"))).select("contig_id", F.round(S.hyperbola_score(n, F.col("avg_wt")), 6).alias("score"))


@register("uniquify_names", sql("seqs", "contigs", body="SELECT contig_id, CASE WHEN n > 0 THEN name || '_' || n ELSE name END AS unique_name FROM (SELECT contig_id, 'd' || doc_id AS name, row_number() OVER (PARTITION BY doc_id ORDER BY contig_id) - 1 AS n FROM contigs)"))
def uniquify_names(spark, d):
    c = dna.contigs(spark, d).select("contig_id", F.concat(F.lit("d"), "doc_id").alias("name"))
    return C.uniquify(c, "name", "contig_id").select("contig_id", "unique_name")


@register("dedup_len_rc", sql("seqs", "contigs", body=f"SELECT min(contig_id) AS contig_id FROM contigs WHERE length(seq) >= 200 GROUP BY least(seq, {RC.format('seq')})"))
def dedup_len_rc(spark, d):
    return C.dedup_both_strands(dna.contigs(spark, d)).select("contig_id")


@register("filter_duplicates", sql("seqs", "contigs", body="SELECT doc_id AS name, min(contig_id) AS contig_id FROM contigs GROUP BY doc_id"))
def filter_duplicates(spark, d):
    return dna.contigs(spark, d).groupBy(F.col("doc_id").alias("name")).agg(F.min("contig_id").alias("contig_id"))


@register("filter_trans", sql("seqs", "contigs", body="SELECT contig_id FROM contigs WHERE length(seq) + 1 >= 300"))
def filter_trans(spark, d):
    return dna.contigs(spark, d).where(F.length("seq") + 1 >= 300).select("contig_id")


@register(
    "representatives_ends",
    sql("seqs", "contigs", "c24", "idx AS (SELECT kmer, contig_id AS t, max(pos) AS pos FROM c24 GROUP BY ALL)",
        f"q AS (SELECT contig_id, length(seq) AS n, unnest([seq, {RC.format('seq')}]) AS s FROM contigs WHERE length(seq) >= 24)",
        "gone AS (SELECT DISTINCT q.contig_id FROM q JOIN idx h ON h.kmer = substr(s, 1, 24) JOIN idx e ON e.kmer = right(s, 24) AND e.t = h.t JOIN contigs c ON c.contig_id = h.t WHERE h.t <> q.contig_id AND abs(e.pos - h.pos - (n - 24)) < 3 AND (n < length(c.seq) OR n = length(c.seq) AND q.contig_id > h.t))",
        body="SELECT contig_id FROM contigs WHERE contig_id NOT IN (SELECT contig_id FROM gone)"),
)
def representatives_ends(spark, d):
    c = dna.contigs(spark, d)
    return c.join(C.contained_by_ends(c), "contig_id", "left_anti").select("contig_id")


@register(
    "representatives_cover",
    sql("seqs", "contigs", "c18 AS (SELECT contig_id, i AS pos, substr(seq, i, 18) AS kmer FROM contigs, unnest(range(1, length(seq) - 16)) t(i))",
        "h AS (SELECT DISTINCT a.contig_id AS q, b.contig_id AS t, a.pos FROM c18 a JOIN c18 b ON a.kmer = b.kmer AND a.contig_id <> b.contig_id)",
        "m AS (SELECT q, t, sum(g) AS m FROM (SELECT q, t, least(18, coalesce(lead(pos) OVER (PARTITION BY q, t ORDER BY pos) - pos, 18)) AS g FROM h) GROUP BY q, t)",
        "gone AS (SELECT DISTINCT q FROM m JOIN contigs a ON a.contig_id = q JOIN contigs b ON b.contig_id = t WHERE m >= 0.99 * length(a.seq) AND (length(a.seq) < length(b.seq) OR length(a.seq) = length(b.seq) AND q < t))",
        body="SELECT contig_id FROM contigs WHERE contig_id NOT IN (SELECT q FROM gone)"),
)
def representatives_cover(spark, d):
    c = dna.contigs(spark, d)
    return c.join(C.covered_by_greater(c, 0.99), "contig_id", "left_anti").select("contig_id")


def _selfalign(share: float) -> str:
    return sql(
        "seqs", "contigs", "c18 AS (SELECT contig_id, i AS pos, substr(seq, i, 18) AS kmer FROM contigs, unnest(range(1, length(seq) - 16)) t(i))",
        "h AS (SELECT DISTINCT a.contig_id AS q, b.contig_id AS t, a.pos FROM c18 a JOIN c18 b ON a.kmer = b.kmer AND a.contig_id <> b.contig_id)",
        "m AS (SELECT q, t, sum(g) AS m FROM (SELECT q, t, least(18, coalesce(lead(pos) OVER (PARTITION BY q, t ORDER BY pos) - pos, 18)) AS g FROM h) GROUP BY q, t)",
        f"gone AS (SELECT DISTINCT q FROM m JOIN contigs a ON a.contig_id = q JOIN contigs b ON b.contig_id = t WHERE length(a.seq) < 200 OR (m > {share} * length(a.seq) AND (length(b.seq) > length(a.seq) OR length(b.seq) = length(a.seq) AND t > q)))",
        body="SELECT contig_id FROM contigs WHERE contig_id NOT IN (SELECT q FROM gone)",
    )


def _by_alignment(spark, d, share: float):
    c = dna.contigs(spark, d)
    return c.join(C.covered_by_greater(c, share, strict=True, shortest=200), "contig_id", "left_anti").select("contig_id")


@register("representatives_alignment", _selfalign(0.99))
def representatives_alignment(spark, d):
    return _by_alignment(spark, d, 0.99)


@register("representatives_alignment_90", _selfalign(0.9))
def representatives_alignment_90(spark, d):
    """The looser variant."""
    return _by_alignment(spark, d, 0.9)


_PSL = (
    "seqs", "contigs", "truth", "c24",
    "t24 AS (SELECT t_id, i AS pos, substr(seq, i, 24) AS kmer FROM truth, unnest(range(1, length(seq) - 22)) t(i))",
    "h AS (SELECT DISTINCT a.contig_id AS q_name, b.t_id AS t_name, a.pos FROM c24 a JOIN t24 b ON a.kmer = b.kmer)",
    "psl AS (SELECT CAST(sum(g) AS BIGINT) AS match, q_name, length(any_value(c.seq)) AS q_size, t_name, length(any_value(t.seq)) AS t_size FROM (SELECT *, least(24, coalesce(lead(pos) OVER (PARTITION BY q_name, t_name ORDER BY pos) - pos, 24)) AS g FROM h) JOIN contigs c ON contig_id = q_name JOIN truth t ON t_id = t_name GROUP BY q_name, t_name)",
    "best AS (SELECT t_name, t_size, q_name, match, match / t_size::DOUBLE AS fraction, match / t_size::DOUBLE >= 0.9 AS recovered FROM psl QUALIFY row_number() OVER (PARTITION BY t_name ORDER BY match DESC, q_name) = 1)",
)


def _psl(spark, d):
    return C.psl(dna.contigs(spark, d), dna.truth(spark, d))


@register("alignment_rows", sql(*_PSL, body="SELECT * FROM psl"))
def alignment_rows(spark, d):
    return _psl(spark, d)


@register("best_hit", sql(*_PSL, body="SELECT * FROM best"))
def best_hit(spark, d):
    return C.best_hit(_psl(spark, d))


@register("recall90", sql(*_PSL, body="SELECT count(*) AS n_hit, count(*) FILTER (recovered) AS n_recovered, round(avg(fraction), 9) AS mean_fraction FROM best"))
def recall90(spark, d):
    b = C.best_hit(_psl(spark, d))
    return b.agg(F.count(F.lit(1)).alias("n_hit"), F.count(F.when(F.col("recovered"), 1)).alias("n_recovered"), F.round(F.avg("fraction"), 9).alias("mean_fraction"))


_ABUND = "ab AS (SELECT t_id AS t_name, 1.5 * (t_id % 97) + 0.5 AS abundance FROM truth)"


def _abundance(spark, d):
    return dna.truth(spark, d).select(F.col("t_id").alias("t_name"), (1.5 * (F.col("t_id") % 97) + 0.5).alias("abundance"))


@register("best_hit_abundance", sql(*_PSL, _ABUND, body="SELECT t_name, abundance, coalesce(fraction, 0) AS fraction FROM ab LEFT JOIN best USING (t_name)"))
def best_hit_abundance(spark, d):
    b = C.best_hit(_psl(spark, d)).select("t_name", "fraction")
    return _abundance(spark, d).join(b, "t_name", "left").select("t_name", "abundance", F.coalesce("fraction", F.lit(0.0)).alias("fraction"))


_MEM = "mem AS (SELECT q_name, t_name, CAST(sum(g) AS BIGINT) AS n FROM (SELECT a.contig_id AS q_name, t_id AS t_name, CASE WHEN a.pos - lag(a.pos) OVER (PARTITION BY a.contig_id, t_id, a.pos - b.pos ORDER BY a.pos) = 1 THEN 1 ELSE 24 END AS g FROM c24 a JOIN t24 b ON a.kmer = b.kmer) GROUP BY ALL)"


@register("exact_match_abundance", sql(*_PSL[:5], _MEM, _ABUND, body="SELECT t_name, abundance, coalesce(max(n), 0) AS best FROM ab LEFT JOIN mem USING (t_name) GROUP BY t_name, abundance"))
def exact_match_abundance(spark, d):
    """The best query of a target by the sum of its maximal exact matches, beside the target's abundance."""
    best = C.exact_matches(dna.contigs(spark, d), dna.truth(spark, d)).groupBy("t_name").agg(F.max("n").alias("best"))
    return _abundance(spark, d).join(best, "t_name", "left").select("t_name", "abundance", F.coalesce("best", F.lit(0)).alias("best"))


#: Limits of the coverage bins (fixed values); read length and number of reads of the coverage query.
_LIMITS, _L, _N = (1, 10, 25, 50, 100, 1e10), 100, 20_000


@register("coverage_bins", sql(*_PSL, _ABUND, "x AS (SELECT t_name, abundance, match, t_size FROM ab JOIN best USING (t_name))", "c AS (SELECT *, abundance * 100 / (SELECT sum(abundance * match) FROM x) * 20000 AS cov FROM x)", "l AS (SELECT * FROM (VALUES (1.0, 10.0), (10, 25), (25, 50), (50, 100), (100, 1e10)) v(lo, hi))", body="SELECT lo::DOUBLE AS bin, count(*) AS n, count(*) FILTER (match > 0.95 * t_size) AS n_reconstructed, CAST(sum(least(match, t_size)) AS BIGINT) AS bases_found, CAST(sum(t_size) AS BIGINT) AS bases FROM c JOIN l ON cov > lo AND cov <= hi GROUP BY lo"))
def coverage_bins(spark, d):
    """Recovered targets and bases by expected coverage: abundance as a share of all matched bases."""
    x = C.best_hit(_psl(spark, d)).join(_abundance(spark, d), "t_name")
    norm = x.agg(F.sum(F.col("abundance") * F.col("match")).alias("norm"))  # one row
    cov = F.col("abundance") * _L / F.col("norm") * _N
    lo = F.coalesce(*(F.when((cov > a) & (cov <= b), float(a)) for a, b in zip(_LIMITS, _LIMITS[1:])))
    c = x.join(F.broadcast(norm)).withColumn("bin", lo).where("bin is not null").groupBy("bin")
    found = F.sum(F.least("match", "t_size")).cast("long")
    return c.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("match") > 0.95 * F.col("t_size"), 1)).alias("n_reconstructed"), found.alias("bases_found"), F.sum("t_size").cast("long").alias("bases"))


@register("ab_fraction", sql(*_PSL, _ABUND, body="SELECT round(sum(abundance) FILTER (fraction > 0.9) / sum(abundance), 9) AS share FROM ab LEFT JOIN best USING (t_name)"))
def ab_fraction(spark, d):
    x = best_hit_abundance(spark, d)
    return x.agg(F.round(F.sum(F.when(F.col("fraction") > 0.9, F.col("abundance"))) / F.sum("abundance"), 9).alias("share"))


@register("abundance_bins", sql(*_PSL, _ABUND, body="SELECT CASE WHEN abundance <= 1 THEN 1.0 WHEN abundance <= 10 THEN 10 WHEN abundance <= 25 THEN 25 WHEN abundance <= 50 THEN 50 WHEN abundance <= 100 THEN 100 ELSE 1e10 END::DOUBLE AS bin, count(*) AS n, count(*) FILTER (fraction > 0.95) AS n_reconstructed FROM ab LEFT JOIN best USING (t_name) GROUP BY 1"))
def abundance_bins(spark, d):
    x = best_hit_abundance(spark, d)
    return x.groupBy(C.abundance_bin(F.col("abundance")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("fraction") > 0.95, 1)).alias("n_reconstructed"))


@register("false_positive_codes", sql(*_PSL, body="SELECT q_name, max(match) AS match, max(match / q_size::DOUBLE) AS fraction, CAST(max(CASE WHEN match >= 0.9 * t_size THEN 2 WHEN match >= 0.9 * least(q_size, t_size) THEN 1 ELSE 0 END) AS INT) AS code FROM psl GROUP BY q_name"))
def false_positive_codes(spark, d):
    m = F.col("match")
    code = F.when(m >= 0.9 * F.col("t_size"), 2).when(m >= 0.9 * F.least("q_size", "t_size"), 1).otherwise(0)
    return _psl(spark, d).groupBy("q_name").agg(F.max(m).alias("match"), F.max(m / F.col("q_size")).alias("fraction"), F.max(code).alias("code"))


@register("rev_fp", sql(*_PSL, body="SELECT count(*) AS n, count(*) FILTER (f > 0.95) AS n_true FROM (SELECT q_name, max(match / q_size::DOUBLE) AS f FROM psl GROUP BY q_name)"))
def rev_fp(spark, d):
    f = _psl(spark, d).groupBy("q_name").agg(F.max(F.col("match") / F.col("q_size")).alias("f"))
    return f.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("f") > 0.95, 1)).alias("n_true"))


@register("quantile_cutoffs", sql(*_PSL, "v AS (SELECT q_name, t_name, match::DOUBLE AS weight, match / t_size::DOUBLE AS fraction FROM psl)", "o AS (SELECT weight, row_number() OVER (ORDER BY weight) - 1 AS i, count(*) OVER () AS n FROM v)", "cut AS (SELECT c, o.weight AS cutoff FROM (SELECT DISTINCT n FROM o) z, unnest(range(0, 20)) t(c) JOIN o ON o.i = c * z.n // 20)", body="SELECT c, cutoff, count(DISTINCT CASE WHEN fraction >= 0.9 THEN t_name END) AS recalled, count(*) AS total FROM cut JOIN v ON v.weight >= cutoff GROUP BY c, cutoff"))
def quantile_cutoffs(spark, d):
    """Recall and size of the output at twenty cutoffs of the weight.

    The cutoffs are weights at ranks ``c n / 20``: counts by weight give them
    without sorting rows, and each row belongs to a prefix of the cutoffs.
    """
    v = _psl(spark, d).select("q_name", "t_name", F.col("match").cast("double").alias("weight"), (F.col("match") / F.col("t_size")).alias("fraction"))
    w = W.orderBy("weight")
    n = v.groupBy("weight").agg(F.count(F.lit(1)).alias("k")).withColumn("hi", F.sum("k").over(w))
    n = n.withColumn("n", F.sum("k").over(W.orderBy("weight").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    c = F.explode(F.sequence(F.lit(0), F.lit(19)))
    cut = n.select("weight", (F.col("hi") - F.col("k")).alias("lo"), "hi", "n", c.alias("c")).where("floor(c * n / 20) >= lo and floor(c * n / 20) < hi").select(F.col("c").cast("long").alias("c"), F.col("weight").alias("cutoff"))
    j = v.join(F.broadcast(cut), F.col("weight") >= F.col("cutoff"))  # twenty rows
    return j.groupBy("c", "cutoff").agg(F.countDistinct(F.when(F.col("fraction") >= 0.9, F.col("t_name"))).alias("recalled"), F.count(F.lit(1)).alias("total"))


@register("isoform_groups", _COMP + " SELECT comp AS isoform_group, count(*) AS n_isoforms FROM comps GROUP BY comp HAVING count(*) BETWEEN 2 AND 5")
def isoform_groups(spark, d):
    return _components(spark, d).groupBy(F.col("comp").alias("isoform_group")).agg(F.count(F.lit(1)).alias("n_isoforms")).where("n_isoforms between 2 and 5")


_DEPTH = (*_PSL[:5], "dep AS (SELECT t_id AS name, pos + o AS pos, CAST(sum(n) AS BIGINT) AS depth FROM t24 JOIN (SELECT kmer, count(*) AS n FROM c24 GROUP BY kmer) USING (kmer), unnest(range(0, 24)) t(o) GROUP BY 1, 2)")
_ISLAND = "(SELECT name, min(pos) AS lo, max(pos) AS hi FROM (SELECT name, pos, pos - row_number() OVER (PARTITION BY name ORDER BY pos) AS g FROM {0}) GROUP BY name, g)"


def _depth(spark, d):
    return C.depth(dna.contigs(spark, d), dna.truth(spark, d))


@register("coverage_depth", sql(*_DEPTH, body="SELECT * FROM dep"))
def coverage_depth(spark, d):
    return _depth(spark, d)


@register("coverage_islands", sql(*_DEPTH, body="SELECT * FROM " + _ISLAND.format("dep")))
def coverage_islands(spark, d):
    return C.islands(_depth(spark, d))


@register("breadth_filter", sql(*_DEPTH, body="SELECT t_id AS name, count(pos) AS n_covered FROM truth LEFT JOIN dep ON name = t_id GROUP BY t_id HAVING count(pos) >= 0.9 * length(any_value(seq))"))
def breadth_filter(spark, d):
    n = _depth(spark, d).groupBy("name").agg(F.count("pos").alias("n_covered"))
    t = dna.truth(spark, d).select(F.col("t_id").alias("name"), F.length("seq").alias("n"))
    return t.join(n, "name", "left").where("n_covered >= 0.9 * n").select("name", "n_covered")


_SIDES = (
    "seqs", "reads", "pairs", "truth",
    "t24 AS (SELECT t_id AS name, i AS pos, substr(seq, i, 24) AS kmer, seq AS whole FROM truth, unnest(range(1, length(seq) - 22)) t(i))",
    f"m AS (SELECT pair_id, 1 AS mate, true AS forward, seq1 AS s FROM pairs UNION ALL SELECT pair_id, 1, false, {RC.format('seq1')} FROM pairs UNION ALL SELECT pair_id, 2, true, seq2 FROM pairs UNION ALL SELECT pair_id, 2, false, {RC.format('seq2')} FROM pairs)",
    "hit AS (SELECT pair_id, mate, forward, name, pos FROM m JOIN t24 ON kmer = left(s, 24) AND substr(whole, pos, 100) = s)",
    "con AS (SELECT a.name, a.pos AS l, b.pos AS r FROM hit a JOIN hit b ON a.pair_id = b.pair_id AND a.name = b.name AND a.mate <> b.mate AND a.forward AND NOT b.forward AND b.pos >= a.pos AND b.pos + 100 - a.pos <= 500)",
    "cov AS (SELECT DISTINCT name, 'left' AS side, unnest(range(l, l + 100)) AS pos FROM con UNION SELECT DISTINCT name, 'right', unnest(range(r, r + 100)) FROM con)",
    "isl AS (SELECT name, side, min(pos) AS lo, max(pos) AS hi FROM (SELECT *, pos - row_number() OVER (PARTITION BY name, side ORDER BY pos) AS g FROM cov) GROUP BY name, side, g)",
)
_BUFFERED = (
    *_SIDES,
    "num AS (SELECT i.*, length(seq) AS n, row_number() OVER (PARTITION BY name, side ORDER BY lo) AS a, row_number() OVER (PARTITION BY name, side ORDER BY lo DESC) AS z FROM isl i JOIN truth ON t_id = name WHERE name IN (SELECT name FROM isl GROUP BY name HAVING count(DISTINCT side) = 2))",
    "buf AS (SELECT name, side, CASE WHEN a = 1 AND lo < CASE side WHEN 'left' THEN 25 ELSE 200 END THEN 1 ELSE lo END AS lo, CASE WHEN z = 1 AND CASE side WHEN 'left' THEN hi > n - 200 ELSE hi < 25 END THEN n ELSE hi END AS hi, n FROM num)",
)


def _buffered(spark, d):
    t = dna.truth(spark, d)
    i = C.side_islands(C.mate_places(dna.pairs(spark, d), t))
    return C.buffered(i, t.select(F.col("t_id").alias("name"), F.length("seq").alias("n")))


@register("mate_intervals", sql(*_SIDES, body="SELECT * FROM isl"))
def mate_intervals(spark, d):
    """What the forward and the backward mates of pairs cover, apart."""
    return C.side_islands(C.mate_places(dna.pairs(spark, d), dna.truth(spark, d)))


@register("interval_edges", sql(*_BUFFERED, body="SELECT name, side, lo, hi FROM buf"))
def interval_edges(spark, d):
    return _buffered(spark, d).select("name", "side", "lo", "hi")


@register("interval_intersection", sql(*_BUFFERED, body="SELECT x.name, greatest(x.lo, y.lo) AS lo, least(x.hi, y.hi) AS hi FROM buf x JOIN buf y ON x.name = y.name AND x.side = 'left' AND y.side = 'right' WHERE greatest(x.lo, y.lo) + 200 <= least(x.hi, y.hi)"))
def interval_intersection(spark, d):
    from readloom.session import Tables

    b = Tables(spark, "intervals").save(_buffered(spark, d), "buffered")
    return C.intersect_intervals(b.where("side = 'left'"), b.where("side = 'right'"))


_SWEEP = (
    "lf AS (SELECT name, lo, hi, n, row_number() OVER (PARTITION BY name ORDER BY lo) AS i FROM buf WHERE side = 'left')",
    "rt AS (SELECT name, lo, hi, row_number() OVER (PARTITION BY name ORDER BY lo) AS j FROM buf WHERE side = 'right')",
    "ptr AS (SELECT DISTINCT name, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, 0 AS step FROM lf UNION ALL SELECT p.name,"
    " p.i + CASE WHEN greatest(l.lo, r.lo) <= least(l.hi, r.hi) OR l.lo < greatest(l.lo, r.lo) THEN 1 ELSE 0 END,"
    " p.j + CASE WHEN greatest(l.lo, r.lo) <= least(l.hi, r.hi) OR r.lo < least(l.hi, r.hi) THEN 1 ELSE 0 END, p.step + 1 FROM ptr p JOIN lf l ON l.name = p.name AND l.i = p.i JOIN rt r ON r.name = p.name AND r.j = p.j)",
    "fr AS (SELECT p.name, p.step, least(l.lo, r.lo) AS lo, greatest(l.hi, r.hi) AS hi, l.n FROM ptr p JOIN lf l ON l.name = p.name AND l.i = p.i JOIN rt r ON r.name = p.name AND r.j = p.j WHERE greatest(l.lo, r.lo) <= least(l.hi, r.hi) AND least(l.lo, r.lo) + 200 <= greatest(l.hi, r.hi))",
)


@register("fragment_intervals", "WITH RECURSIVE " + sql(*_BUFFERED, *_SWEEP, body="SELECT name || CASE WHEN lo = 1 AND hi = n THEN '' ELSE '_frag_' || (row_number() OVER (PARTITION BY name ORDER BY step) - 1) END AS fragment, lo, hi, substr(seq, lo, hi - lo + 1) AS seq FROM fr JOIN truth ON t_id = name")[5:])
def fragment_intervals(spark, d):
    """References cut to the unions of left and right intervals that overlap; each interval is used once."""
    import pandas as pd

    from readloom.operators.variants import fragments

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lo")
        a, b = (list(zip(x.lo, x.hi)) for x in (pdf[pdf.side == "left"], pdf[pdf.side == "right"]))
        made = [(lo, hi) for lo, hi in fragments(a, b) if lo + C.LEAST <= hi]
        rows = [(pdf.ref.iloc[0], i, lo, hi, pdf.n.iloc[0]) for i, (lo, hi) in enumerate(made)]
        return pd.DataFrame(rows, columns=["ref", "i", "lo", "hi", "n"])

    sides = _buffered(spark, d).withColumnRenamed("name", "ref")
    f = sides.groupBy("ref").applyInPandas(merge, "ref long, i long, lo long, hi long, n long")
    f = f.join(dna.truth(spark, d), F.col("ref") == F.col("t_id"))
    whole = (F.col("lo") == 1) & (F.col("hi") == F.col("n"))
    name = F.concat(F.col("ref").cast("string"), F.when(whole, "").otherwise(F.concat(F.lit("_frag_"), "i")))
    return f.select(name.alias("fragment"), "lo", "hi", F.substring("seq", F.col("lo").cast("int"), (F.col("hi") - F.col("lo") + 1).cast("int")).alias("seq"))


@register("abundance_filter", sql(*_DEPTH, body="SELECT name FROM (SELECT t_id AS name, sum(depth) / 24.0 AS est_counts, length(any_value(seq)) - 99 AS eff_length FROM truth JOIN dep ON name = t_id GROUP BY t_id) WHERE est_counts / greatest(eff_length, 1) * 100 >= 50"))
def abundance_filter(spark, d):
    """References whose estimated depth, from counts and effective length, reaches a cutoff."""
    t = dna.truth(spark, d).select(F.col("t_id").alias("name"), F.greatest(F.length("seq") - 99, F.lit(1)).alias("eff_length"))
    n = _depth(spark, d).groupBy("name").agg((F.sum("depth") / 24.0).alias("est_counts"))
    return t.join(n.join(t, "name").where("est_counts / eff_length * 100 >= 50"), "name", "left_semi").select("name")


@register("mate_repair", sql("seqs_n", "reads", "pairs", body="SELECT coalesce(l.pair_id, r.pair_id) AS pair_id, coalesce(l.seq1, repeat('T', 28)) AS seq1, coalesce(r.seq2, repeat('A', 28)) AS seq2 FROM (SELECT * FROM pairs WHERE NOT contains(seq1, 'N')) l FULL JOIN (SELECT * FROM pairs WHERE NOT contains(seq2, 'N')) r ON l.pair_id = r.pair_id"))
def mate_repair(spark, d):
    """Mates that correction dropped are replaced by a run of A (right) or T (left)."""
    p = dna.pairs(spark, d, S.BASES_N)
    bad = {c: S.has_unread(F.col(c)) for c in ("seq1", "seq2")}
    p = p.where(~(bad["seq1"] & bad["seq2"]))  # both mates are in the row: no join is needed
    return p.select("pair_id", *(F.when(bad[c], F.lit(x * 28)).otherwise(F.col(c)).alias(c) for c, x in (("seq1", "T"), ("seq2", "A"))))


@register("fuzzy_lookup", sql("seqs", "contigs", "k AS (SELECT DISTINCT left(seq, 24) AS key FROM contigs WHERE length(seq) = 400)", "q AS (SELECT DISTINCT right(seq, 24) AS query FROM contigs WHERE length(seq) = 400 UNION SELECT DISTINCT substr(seq, 1, 11) || 'A' || substr(seq, 13, 12) FROM contigs WHERE length(seq) = 400)", body="SELECT query, key, CAST(hamming(query, key) AS INT) AS n FROM q JOIN k ON hamming(query, key) <= 2"))
def fuzzy_lookup(spark, d):
    """Keys within two substitutions: two of four slices must be equal, 12 bases, so that few other keys share them."""
    c = dna.contigs(spark, d).where(F.length("seq") == 400)
    k = c.select(F.substring("seq", 1, 24).alias("key")).distinct()
    bent = F.concat(F.substring("seq", 1, 11), F.lit("A"), F.substring("seq", 13, 12))
    q = c.select(F.explode(F.array(F.substring("seq", -24, 24), bent)).alias("query")).distinct()
    return C.near_keys(q, k, "query", "key")


@register("filter_reverse_records", sql("seqs", "contigs", body=f"SELECT contig_id FROM (SELECT contig_id, CASE WHEN seq > {RC.format('seq')} THEN '> c Reverse' ELSE '> c' END AS head FROM contigs) WHERE NOT contains(head, 'Reverse')"))
def filter_reverse_records(spark, d):
    c = dna.contigs(spark, d)
    head = F.when(F.col("seq") > S.reverse_complement(F.col("seq")), "> c Reverse").otherwise("> c")
    return c.select("contig_id", head.alias("head")).where(~F.contains("head", F.lit("Reverse"))).select("contig_id")
