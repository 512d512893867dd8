"""Quality rules: text statistics, plain rules, and robust multivariate outliers for each language and source.

Everything is DataFrame and SQL functions. The statistics of a text become a vector of transformed rates. For each
(language, source), each language, and all documents, the minimum covariance determinant estimate of centre and scatter is
searched: from `STARTS` starts (medians with quartile ranges; the scatter of a few documents picked by hash), concentration
steps keep the share `H` of documents with the smallest Mahalanobis distances and re-estimate from those; after `FIRST`
steps the start with the smallest determinant goes on for at most `STEPS` more, until the determinant falls no further. A
scatter is multiplied by the factor that makes it consistent at the normal distribution.

Texts hardly ever repeat lines or hold signs, so the scatter of most documents is singular; `FLOORS` (a standard deviation
for each statistic, as a target that is added, in the search as well) keep it regular and say how far a statistic that
doesn't vary may go.

The estimate of a small group is shrunk towards its language's, and that one towards all documents': with n documents it has
the weight n / (n + `PRIOR`), at every size alike. A document is rejected if its squared distance is beyond the chi-squared
quantile `LEVEL`. Every step is one partial aggregation over the vectors, so a group that holds a third of all rows is
summed where its rows lie.

Null text has no words and fails; a null language or source is one of its own; the distance is null only if no document at
all passes the plain rules; repeated rows count each; ties of distances are kept or left together; very long texts are read
whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.llm.common import Written, table

WS = r"[\x20\x09-\x0D]+"
#: Share of a group that concentration keeps, starts, steps of all starts and of the best one, weight of what a group is shrunk to, chi-squared level that rejects.
H, STARTS, FIRST, STEPS, PRIOR, LEVEL = 0.75, 4, 2, 4, 50, 0.999
#: Standard deviation of the target of each statistic.
FLOORS = [0.1, 0.05, 0.5, 0.5, 1.0]
#: Documents that a random start is made of, about.
PICKED = 12
#: A group table of up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 20_000


def statistics(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source) -> with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("t"))
    two = one.select("doc_id", "lang", "source", "t", F.array_remove(F.split("t", WS), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    three = two.select(
        "doc_id", "lang", "source", "t", "lines",
        F.size("w").cast("long").alias("n_words"),
        # Each window of three words as (fingerprint, place), sorted: equal windows become neighbours.
        F.expr("CASE WHEN size(w) < 3 THEN CAST(array() AS array<struct<h:bigint,i:int>>) ELSE sort_array(transform(sequence(0, size(w) - 3), i -> struct(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)) AS h, i AS i))) END").alias("s"),
    )
    four = three.select(
        "doc_id", "lang", "source", "n_words",
        F.length(F.regexp_replace("t", WS, "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("sort_array(transform(filter(s, (x, k) -> coalesce(get(s, k - 1).h = x.h, false) OR coalesce(get(s, k + 1).h = x.h, false)), x -> x.i))").alias("p"),
    )
    covered = F.expr("CASE WHEN size(p) = 0 THEN 0L ELSE 3L + aggregate(zip_with(slice(p, 1, size(p) - 1), slice(p, 2, size(p) - 1), (a, b) -> least(3, b - a)), 0L, (a, x) -> a + x) END")
    five = four.withColumn("n_repeat_words", covered).drop("p")
    return five.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector() -> list[Column]:
    """Length (beyond the least one, twice logarithmic: long texts are no outliers), word length, and signs, repeated lines and repeated words for 100 words."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    rate = lambda c: F.log1p(100.0 * F.col(c) / n)
    return [F.log1p(F.log(F.greatest(n, F.lit(50)) / 50.0)), F.log((F.col("word_chars") + 1.0) / n), rate("n_symbols"), rate("n_dup_lines"), rate("n_repeat_words")]


D = len(FLOORS)
X, M = [f"x{i}" for i in range(D)], [f"m{i}" for i in range(D)]
C = [f"c_{i}_{j}" for i in range(D) for j in range(i + 1)]
L = [f"l_{i}_{j}" for i in range(D) for j in range(i + 1)]


def chi2(x: float, k: int) -> float:
    """Chi-squared distribution function of an odd number k of degrees."""
    term, total = math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 0.0
    for j in range(3, k + 2, 2):
        total += term
        term *= x / j
    return math.erf(math.sqrt(x / 2)) - total


def quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2(middle, k) < p else (low, middle)
    return high


#: Factor of the scatter of the share H; squared distance that rejects.
CONSISTENT, CUTOFF = H / chi2(quantile(H, D), D + 2), quantile(LEVEL, D)


def _cholesky(rows: DataFrame) -> DataFrame:
    """rows with the factor (L) of scatter and target, and the logarithm of its determinant (ld)."""
    for j in range(D):
        for i in range(j, D):
            rest = F.col(f"c_{i}_{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            rows = rows.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return rows.withColumn("ld", sum((F.log(f"l_{i}_{i}") for i in range(1, D)), F.log("l_0_0")))


def _moments(factor: float) -> list[Column]:
    return [*[F.avg(x).alias(m) for x, m in zip(X, M, strict=True)], *[(F.covar_pop(X[i], X[j]) * factor).alias(f"c_{i}_{j}") for i in range(D) for j in range(i + 1)]]


def _distance(rows: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance d2, by forward substitution."""
    for i in range(D):
        rest = F.col(X[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"z{k}")
        rows = rows.withColumn(f"z{i}", rest / F.col(f"l_{i}_{i}"))
    return rows.withColumn("d2", sum((F.col(f"z{i}") ** 2 for i in range(1, D)), F.col("z0") ** 2))


def _joined(rows: DataFrame, right: DataFrame, few: bool, on: list[str], how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(right) if few else right, on, how)


def _starts(rows: DataFrame, counts: DataFrame, few: bool) -> DataFrame:
    """g, start, M, C: medians with quartile ranges (start 0), and documents picked by hash."""
    found = rows.groupBy("g").agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 10000).alias(f"q{i}") for i, x in enumerate(X)])
    middle = [F.col(f"q{i}")[1].alias(f"m{i}") for i in range(D)]
    apart = [(((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349) ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i in range(D) for j in range(i + 1)]
    out = found.select("g", F.lit(0).alias("start"), *middle, *apart)
    some = _joined(rows, counts, few, ["g"]).withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(STARTS - 1))))
    share = F.xxhash64("row", "start").cast("double") / 2.0**64 + 0.5
    return out.unionByName(some.where(share * F.col("n") < PICKED).groupBy("g", "start").agg(*_moments(1.0)))


def estimates(rows: DataFrame, store: Written) -> DataFrame:
    """rows (g, row, X) -> g, n, M, C: the minimum covariance determinant estimate of each group g."""
    counts = store.write(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "counts")
    few = counts.count() * STARTS <= BROADCAST_ROWS

    def step(model: DataFrame, name: str) -> DataFrame:
        """The estimates of the share H of each group that is nearest by model (g, start, M, C)."""
        near = _distance(_joined(rows, _cholesky(model).select("g", "start", *M, *L), few, ["g"])).select("g", "start", *X, "d2")
        limits = near.groupBy("g", "start").agg(F.percentile_approx("d2", H, 10000).alias("limit"))
        inner = _joined(near, limits, few, ["g", "start"]).where(F.col("d2") <= F.col("limit"))
        return store.write(_cholesky(inner.groupBy("g", "start").agg(*_moments(CONSISTENT))).select("g", "start", *M, *C, "ld"), name)

    model = store.write(_starts(rows, counts, few), "starts")
    for k in range(FIRST):
        model = step(model, f"first{k}")
    model = model.groupBy("g").agg(F.min_by(F.struct("start", *M, *C, "ld"), F.struct("ld", "start")).alias("b")).select("g", "b.*")
    model = store.write(model, "best")
    for k in range(STEPS):
        after = step(model, f"step{k}")
        falls = after.select("g", F.col("ld").alias("now")).join(model.select("g", "ld"), "g").where(F.col("now") < F.col("ld") - 1e-3)
        model = after
        if falls.isEmpty():
            break
    return model.join(counts, "g").select("g", "n", *M, *C)


def _key(level: int) -> Column:
    """Number of the group of a row at a level: its language and source, its language, all."""
    marks = [F.lit(level)]
    for c in ("lang", "source")[: 2 - level]:
        marks += [F.col(c).isNull(), F.col(c)]
    return F.xxhash64(*marks)


def judge(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source) -> statistics, base_failed, distance (squared), kept."""
    store = Written(docs.sparkSession)
    stats = store.write(statistics(docs), "statistics")
    passed = stats.where(~F.col("base_failed")).select(F.xxhash64("doc_id", "word_chars", "n_words", "n_repeat_words").alias("row"), F.array(*[_key(k) for k in range(3)]).alias("keys"), *[v.alias(x) for v, x in zip(vector(), X, strict=True)])
    found = store.write(estimates(passed.select(F.explode("keys").alias("g"), "row", *X), store), "estimates")
    groups = stats.select("lang", "source").distinct().select(*[_key(k).alias(f"g{k}") for k in range(3)])
    # From all documents to the language to the group: each estimate is mixed with what is above it.
    values = [*M, *C]
    above = groups.join(found.withColumnsRenamed({v: f"up_{v}" for v in values}).select(F.col("g").alias("g2"), *[f"up_{v}" for v in values]), "g2")
    for k in (1, 0):
        own = F.coalesce(F.col("n") / (F.col("n") + PRIOR), F.lit(0.0))
        mixed = [(own * F.coalesce(v, F.lit(0.0)) + (1 - own) * F.col(f"up_{v}")).alias(f"up_{v}") for v in values]
        above = above.join(found.select(F.col("g").alias(f"g{k}"), "n", *values), f"g{k}", "left").select("g0", "g1", *mixed)
    model = store.write(_cholesky(above.withColumnsRenamed({f"up_{v}": v for v in values})).select("g0", *M, *L), "model")
    few = model.count() <= BROADCAST_ROWS
    vectors = stats.select("*", _key(0).alias("g0"), *[v.alias(x) for v, x in zip(vector(), X, strict=True)])
    scored = _distance(_joined(vectors, model, few, ["g0"], "left"))
    return scored.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("d2").alias("distance"),
        (~F.col("base_failed") & ~F.coalesce(F.col("d2") > CUTOFF, F.lit(False))).alias("kept"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


QUERIES = {"op6_quality": op6_quality}
ORACLES: dict[str, str] = {}
