"""Queries opN_<name> of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from readloom.session import table

_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        _Q[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@_query("op4_hypergeometric_shards")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.sharding import shuffle_into_shards

    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    out = shuffle_into_shards(docs, 24, ties=("text_crc32", "size"), seed=4)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src
), w AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3) + 1]::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s
), o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
    sum(w) OVER (ORDER BY cap / w, src NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest,
    CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM w
), l AS (
  SELECT *, (total - stopped) / w_rest AS lvl FROM o
), t AS (
  SELECT src, source_size, CASE WHEN (SELECT count(*) FROM l WHERE lvl * w < cap) = 0 THEN cap
    ELSE least((SELECT lvl FROM l WHERE lvl * w < cap ORDER BY cap / w LIMIT 1) * w, cap) END AS target FROM l
), k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, row_number() OVER (PARTITION BY d.src ORDER BY d.size, d.doc_id NULLS LAST) AS k,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST(CAST('0x' || substr(md5('5:' || coalesce('s' || d.src, 'null')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.src IS NOT DISTINCT FROM t.src
), c AS (
  SELECT *, CAST(floor(u + k * rate) - floor(u + (k - 1) * rate) AS BIGINT) AS copies FROM k
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""


@_query("op5_systematic_mix", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.mixing import mix

    out = mix(table(spark, sf_dir, "documents"), seed=5, carry=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


@_query("op9_robust_outliers")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.quality import STATS, quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", *STATS, "base_failed", "kept", "distance2")


@_query("op6_subword_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model, carry=["doc_id"])
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@_query("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from readloom.llm import bpe

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents"), path, P.PATTERN, carry=["doc_id"])
    out = bpe.decode(ids, path, P.PATTERN)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query("op8_license_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"), carry=["doc_id"])


@_query("op10_dart_minhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@_query("op3_p_stable_vectors")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.embedding import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@_query("op1_range_coded_ids")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from readloom.llm.tokenids import read_ids, write_ids
    from readloom.session import Tables

    folder = Tables(spark, "token-ids").root
    write_ids(table(spark, sf_dir, "documents"), folder, P.path("word_bpe_49k.json"), end_id=2)
    return read_ids(spark, folder, digest=True)


@_query("op2_prefix_rendering")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.chat import format_chats, read_back

    odd = spark.sql(
        "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(odd)
    return read_back(format_chats(chats))


_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format('text')} AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS.format('text')} AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS x
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(i) WHERE len(w) > 0
), dw AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) t(i)
), hit AS (
  SELECT rid, i, n, item FROM dw JOIN win USING (n, x)
), h AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) t(p) GROUP BY rid
), m AS (
  SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN m USING (rid)
"""


@_query("op11_ngram_hits", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.decontam import find_contamination

    out = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    sha = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha, "contaminated")


def _op12_sql(k: int = 16, rounds: int = 3) -> str:
    """Lloyd's rounds over one row for each component."""
    near = (
        "a{r} AS (SELECT rid, c, d FROM (SELECT v.rid, z.c, CAST(sum((v.x - z.x) * (v.x - z.x)) AS BIGINT) AS d FROM v JOIN z{r} z USING (i) GROUP BY v.rid, z.c)"
        " QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)"
    )
    move = (
        "m{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{p} USING (rid) GROUP BY c, i),"
        " z{r} AS (SELECT c, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM z{p} LEFT JOIN m{r} USING (c, i))"
    )
    steps = [near.format(r=0)]
    for r in range(1, rounds + 1):
        steps += [move.format(r=r, p=r - 1), near.format(r=r)]
    return (
        "WITH e AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = 64"
        " AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),"
        " v AS (SELECT rid, i, CAST(floor(64 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM e, unnest(range(1, 65)) t(i)),"
        f" f AS (SELECT rid, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), ''))) - 1 AS c FROM e QUALIFY c < {k}),"
        f" z0 AS (SELECT c, i, x FROM f JOIN v USING (rid)), {', '.join(steps)},"
        f" s AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM z{rounds} GROUP BY c)"
        " SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM e JOIN a{rounds} USING (rid) JOIN s USING (c)"
    )


@_query("op12_kd_filtering", _op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.centroids import cluster

    out = cluster(table(spark, sf_dir, "embeddings"))
    sha = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", sha)


OP13_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOW.format('text')}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
), g AS (
  SELECT DISTINCT lang, source FROM d
), o AS (
  SELECT rid, lang, source, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS total FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 3
), n AS (
  SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL
), s AS (
  SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS big FROM kept GROUP BY lang
), gs AS (
  SELECT lang, source, CAST(coalesce(sum(n), 0) AS BIGINT) AS big FROM g LEFT JOIN n USING (lang, source) GROUP BY ALL
), p AS (
  SELECT lang, gs.source, term, coalesce(n, 0) AS n, 1 + CAST(1000000000 * (coalesce(n, 0) + 1) // (gs.big + s.v) AS BIGINT) AS p,
    1 + CAST(1000000000 * (total + 1) // (s.big + s.v) AS BIGINT) AS ql
  FROM gs JOIN kept USING (lang) JOIN s USING (lang) LEFT JOIN n USING (lang, source, term)
), f AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - ql) * (p - ql) // ql AS value FROM p WHERE n > 0 AND p > ql
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200
"""


@_query("op13_vector_groups", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents"))
