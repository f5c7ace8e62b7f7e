"""Quality rules: base rules plus robust multivariate outliers, in SQL functions only.

Every text gets a vector of transformed statistics. For each language and
source, a minimum-covariance-determinant (MCD) estimate of centre and
covariance is found by concentration steps: from three starts (coordinate
medians and quartile widths; mean and covariance of all rows; spatial signs
about the medians) take the fraction ``SUPPORT`` of rows with the least
Mahalanobis distance, re-estimate from those, and repeat. After ``TRIAL`` steps
the start of least determinant goes on until centres stand still.

The subset's covariance is multiplied by its consistency factor, the squared
distance at ``SUPPORT`` over the chi-square quantile there, between 1 and
``MOST_SCALE``, and the squared ``FLOOR`` is added to its diagonal. An estimate
from n rows weighs n against ``PRIOR`` rows of the mean estimate over all
groups, in which a group weighs n / (n + PRIOR): large groups stand for
themselves, tiny ones are judged by the others, without a limit between them. A
row whose final distance exceeds ``CUTOFF`` goes.

Each concentration step is one map-side aggregation: rows are binned by
distance on a fixed logarithmic grid and every bin of a group carries count,
sums and cross products, so the least-distance part is a prefix of its bins.
Bins are dealt by group and bin, so no group is sorted or gathered in one task,
and results do not depend on how the rows are dealt.

Defined results: a null text has no words and fails the base rules; null
language or source is a group value of its own; ids are not looked at; repeated
rows count as often as they occur; rows at equal distance are in one bin and
taken together; a very long text is worked on within its row; an empty table
gives an empty result; input columns named like an output column are replaced
by it, no other name clashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from readloom.llm.common import SPACE, drop_names, hold, let, let_go, quoted, words
from readloom.session import Tables, broadcast_if_small

#: Smallest number of words, and largest share of repeated words, of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Words in a repeated window.
WINDOW = 8
#: Share of a group's rows that the estimate rests on.
SUPPORT = 0.75
#: Steps of every start, steps in all at most, and movement of a centre (in floors) that counts as none.
TRIAL, STEPS, STILL = 2, 12, 1e-3
#: Rows that the mean estimate over all groups weighs against a group's own; most of a consistency factor.
PRIOR, MOST_SCALE = 50.0, 4.0
#: Chi-square quantiles of 5 degrees of freedom: at SUPPORT, and at 1 - 1e-5 as the rejection limit
#: (a clean normal row lies beyond it with a chance of 1e-5).
CHI2_SUPPORT, CUTOFF = 6.6257, 30.856
#: Least standard deviation of each coordinate: log words, log letters a word,
#: root of symbol share, log repeated lines, root of repeated-word share.
FLOOR = (0.5, 0.05, 0.06, 0.35, 0.12)
#: Bins of the logarithmic distance grid and of each coordinate's median grid.
PER_OCTAVE, MEDIAN_GRID = 32, 128

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OUT = (*STATS, "base_failed", "distance2", "kept")
_D = range(5)
_PAIRS = [(i, j) for i in _D for j in range(i + 1)]


def _repeat_words(w: Column) -> Column:
    """Words lying in an 8-word window that occurs at least twice in the text.

    Windows are compared by 64-bit hashes. Only a text whose windows are not
    all different is looked at closer: its hashes are sorted with their places,
    equal neighbours marked, and the marked windows' union measured.
    """
    n = F.size(w)
    hashes = F.when(
        n > WINDOW,
        F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, WINDOW))),
    )

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            at = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
            return F.sort_array(F.transform(at, lambda x: x["i"]))

        def length(p: Column) -> Column:
            gaps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        return let(let(ordered, marked), length)

    zero = F.lit(0).cast("long")
    return let(
        hashes,
        lambda h: F.when(h.isNull() | (F.size(F.array_distinct(h)) == F.size(h)), zero).otherwise(covered(h)),
    )


def text_stats(text: Column) -> dict[str, Column]:
    """The five statistics of a text as columns."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    both = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n"),
            F.length(F.array_join(w, "")).cast("long").alias("c"),
            _repeat_words(w).alias("r"),
        ),
    )
    return {
        "_w": both,
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    }


def _vector() -> list[Column]:
    """The transformed statistics of a row."""
    n, c = (F.greatest(F.col(x), F.lit(1)).cast("double") for x in ("n_words", "word_chars"))
    return [
        F.log1p(F.col("n_words").cast("double")),
        F.log(c / n),
        F.sqrt(F.col("n_symbols") / c),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def _group(lang: str, source: str) -> Column:
    return F.to_json(F.struct(F.col(lang).alias("l"), F.col(source).alias("s")))


def _distance2() -> Column:
    """Squared distance from a row's x0..x4 to its group's centre under the inverse factor."""
    z = [reduce(lambda a, b: a + b, [F.col(f"f{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)]) for i in _D]
    return reduce(lambda a, b: a + b, [v * v for v in z])


_CENTRE = [f"m{i}" for i in _D]
_COV = [f"c{i}{j}" for i, j in _PAIRS]


def _inverse_factor(p: DataFrame) -> DataFrame:
    """``p`` with the inverse f* of the Cholesky factor of its covariance c*, and the covariance's log determinant."""
    have = p.columns
    for i, j in _PAIRS:
        s = F.col(f"c{i}{j}")
        for k in range(j):
            s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        p = p.withColumn(f"l{i}{j}", F.sqrt(s) if i == j else s / F.col(f"l{j}{j}"))
    for j in _D:
        for i in range(j, 5):
            if i == j:
                p = p.withColumn(f"f{i}{j}", 1 / F.col(f"l{i}{i}"))
            else:
                s = reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * F.col(f"f{k}{j}") for k in range(j, i)])
                p = p.withColumn(f"f{i}{j}", -s / F.col(f"l{i}{i}"))
    det = 2 * reduce(lambda a, b: a + b, [F.log(f"l{i}{i}") for i in _D])
    return p.select(*have, det.alias("det"), *(f"f{i}{j}" for i, j in _PAIRS))


def _sums(of: list[Column]) -> list[Column]:
    """Sums and cross products of a vector."""
    return [F.sum(v).alias(f"s{i}") for i, v in enumerate(of)] + [F.sum(of[i] * of[j]).alias(f"q{i}{j}") for i, j in _PAIRS]


def _covariance(i: int, j: int, scale: Column | None = None) -> Column:
    """An entry of the covariance that sums of ``k`` rows give."""
    cov = F.col(f"q{i}{j}") / F.col("k") - F.col(f"s{i}") * F.col(f"s{j}") / (F.col("k") * F.col("k"))
    cov = cov if scale is None else cov * scale
    return (cov + (FLOOR[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}")


def _starts(x: DataFrame, tables: Tables) -> DataFrame:
    """Three starts of each group: ``(g, start, m*, f*)``."""
    long = x.select("g", F.posexplode(F.array(*(F.floor(F.col(f"x{i}") * MEDIAN_GRID).cast("long") for i in _D))).alias("k", "b"))
    n = tables.save(long.groupBy("g", "k", "b").agg(F.count(F.lit(1)).alias("count")), "grid")
    w = W.partitionBy("g", "k")
    n = n.withColumn("upto", F.sum("count").over(w.orderBy("b"))).withColumn("all", F.sum("count").over(w))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("b"))) / F.lit(float(MEDIAN_GRID))
    q = n.groupBy("g", "k").agg(at(0.5).alias("m"), at(0.25).alias("lo"), at(0.75).alias("hi"))
    p = q.groupBy("g").agg(
        *(F.max(F.when(F.col("k") == i, F.col("m"))).alias(f"m{i}") for i in _D),
        *(F.max(F.when(F.col("k") == i, (F.col("hi") - F.col("lo")) / 1.349)).alias(f"w{i}") for i in _D),
    )
    wide = [(F.pow(f"w{i}", F.lit(2.0)) + FLOOR[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS]
    middle = tables.save(p.select("g", *_CENTRE, *wide), "middle")
    out = [middle.withColumn("start", F.lit(0))]
    every = x.groupBy("g").agg(F.count(F.lit(1)).alias("k"), *_sums([F.col(f"x{i}") for i in _D]))
    out.append(every.select("g", *((F.col(f"s{i}") / F.col("k")).alias(f"m{i}") for i in _D), *(_covariance(i, j) for i, j in _PAIRS), F.lit(1).alias("start")))
    # the mean product of directions from the middle, in units of the quartile widths, tells the shape
    d = x.join(broadcast_if_small(middle), "g")
    y = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.sqrt(F.col(f"c{i}{i}")) for i in _D]
    d = d.select("g", *_CENTRE, *_COV, *(v.alias(f"y{i}") for i, v in enumerate(y)))
    size = F.sqrt(reduce(lambda a, b: a + b, [F.pow(f"y{i}", F.lit(2.0)) for i in _D]) + 1e-12)
    unit = [F.col(f"y{i}") / size for i in _D]
    first = [F.max(c).alias(c) for c in (*_CENTRE, *(f"c{i}{i}" for i in _D))]
    signs = d.groupBy("g").agg(F.count(F.lit(1)).alias("k"), *first, *_sums(unit)[5:])
    shape = [
        (5 * F.col(f"q{i}{j}") / F.col("k") * F.sqrt(F.col(f"c{i}{i}") * F.col(f"c{j}{j}")) + (FLOOR[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}")
        for i, j in _PAIRS
    ]
    out.append(signs.select("g", *_CENTRE, *shape, F.lit(2).alias("start")))
    both = reduce(lambda a, b: a.unionByName(b), out)
    return _inverse_factor(both.select("g", "start", *_CENTRE, *_COV))


def _step(x: DataFrame, p: DataFrame, tables: Tables) -> DataFrame:
    """One concentration step for every group and start."""
    own = [f"x{i}" for i in _D]
    d = x.join(broadcast_if_small(p.drop("det", *_COV)), "g").select("g", "start", *own, *_CENTRE, _distance2().alias("d2"))
    d = d.withColumn("b", F.floor(F.log2(F.col("d2") + 1e-6) * PER_OCTAVE).cast("long"))
    near = [F.col(f"x{i}") - F.col(f"m{i}") for i in _D]  # moments about the last centre, so that nothing large cancels
    bins = d.groupBy("g", "start", "b").agg(F.count(F.lit(1)).alias("k"), *(F.max(c).alias(c) for c in _CENTRE), *_sums(near))
    bins = tables.save(bins, "bins")  # dealt by group, start and bin
    w = W.partitionBy("g", "start")
    bins = bins.withColumn("before", F.sum("k").over(w.orderBy("b")) - F.col("k")).withColumn("n", F.sum("k").over(w))
    bins = bins.where(F.col("before") < SUPPORT * F.col("n"))
    names = [f"s{i}" for i in _D] + [f"q{i}{j}" for i, j in _PAIRS]
    p = bins.groupBy("g", "start").agg(
        F.max("n").alias("n"), F.max("b").alias("b"), *(F.max(c).alias(c) for c in _CENTRE), *(F.sum(c).alias(c) for c in ("k", *names))
    )
    scale = F.greatest(F.pow(F.lit(2.0), (F.col("b") + 1) / F.lit(float(PER_OCTAVE))) / CHI2_SUPPORT, F.lit(1.0))
    move = [F.col(f"s{i}") / F.col("k") for i in _D]
    p = p.select(
        "g",
        "start",
        "n",
        F.greatest(*(F.abs(v) / FLOOR[i] for i, v in enumerate(move))).alias("moved"),
        *((F.col(f"m{i}") + v).alias(f"m{i}") for i, v in enumerate(move)),
        *(_covariance(i, j, F.least(scale, F.lit(MOST_SCALE))) for i, j in _PAIRS),
    )
    return tables.save(_inverse_factor(p), "step")


def _shrunk(p: DataFrame) -> DataFrame:
    """Estimates drawn towards their mean over all groups, by rows: ``(g, m*, f*)``."""
    w = F.col("n") / (F.col("n") + PRIOR)
    mean = lambda c: (F.sum(w * c) / F.sum(w))
    products = [mean(F.col(f"c{i}{j}") + F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c{i}{j}") for i, j in _PAIRS]
    every = p.agg(*(mean(F.col(c)).alias(c) for c in _CENTRE), *products).first()  # one row
    if every[0] is None:
        return p.select("g", *_CENTRE, *(f"f{i}{j}" for i, j in _PAIRS))
    own = lambda c, pooled: ((F.col("n") * F.col(c) + PRIOR * pooled) / (F.col("n") + PRIOR)).alias(c)
    cov = [own(f"c{i}{j}", every[f"c{i}{j}"] - every[f"m{i}"] * every[f"m{j}"]) for i, j in _PAIRS]
    return _inverse_factor(p.select("g", *(own(c, every[c]) for c in _CENTRE), *cov)).drop("det", *_COV)


def robust_estimates(x: DataFrame, tables: Tables) -> DataFrame:
    """Centre and inverse factor of each group of rows ``(g, x0 to x4)``."""
    p = tables.save(_starts(x, tables), "starts")
    for _ in range(TRIAL):
        p = _step(x, p, tables)
    inner = [c for c in p.columns if c not in ("g", "det", "start")]
    p = p.groupBy("g").agg(F.min(F.struct("det", "start", *inner)).alias("best")).select("g", "best.*")
    p = tables.save(p, "best")
    for _ in range(STEPS - TRIAL):
        if not p.where(F.col("moved") > STILL).limit(1).count():
            break
        p = _step(x, p, tables)
    return tables.save(_shrunk(p), "estimates")


def quality_rules(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None
) -> DataFrame:
    """Rows of ``df`` (columns ``carry``, all by default) with statistics and verdict.

    Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, distance2, kept``. Statistics are written once to the shared
    folder and every later pass reads only the columns it needs.
    """
    tables = Tables(df.sparkSession, "quality")
    keep = drop_names(df.select(*map(quoted, df.columns if carry is None else carry)), OUT)
    stats = df.select(hold(df, keep), _group(lang, source).alias("g"), *(c.alias(n) for n, c in text_stats(F.col(text)).items()))
    stats = stats.select(
        "held",
        "g",
        F.col("_w.n").alias("n_words"),
        F.col("_w.c").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        F.col("_w.r").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    stats = tables.save(stats.withColumn("base_failed", failed), "stats")
    x = [v.alias(f"x{i}") for i, v in enumerate(_vector())]
    estimates = robust_estimates(stats.where(~F.col("base_failed")).select("g", *x), tables)
    judged = stats.select("held", "g", *STATS, "base_failed", *x).join(broadcast_if_small(estimates), "g", "left")
    far = F.coalesce(_distance2(), F.lit(0.0))
    judged = judged.select(*let_go(keep), *STATS, "base_failed", F.when(F.col("base_failed"), None).otherwise(far).alias("distance2"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= CUTOFF))
