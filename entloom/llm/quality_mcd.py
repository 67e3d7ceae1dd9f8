"""Quality rules: robust multivariate outliers per language and source.

Each text's statistics are transformed to a short vector. For every (language, source)
the centre and scatter of the bulk of its vectors are estimated by the minimum
covariance determinant: from deterministic starts, concentration steps keep the share `core` of
the rows that lie nearest and estimate anew; the start whose scatter has the smallest determinant wins; one
reweighting step follows. Rows beyond `cutoff` (in squared Mahalanobis distance) are rejected.

All of it is DataFrame operations. A concentration step needs no sort of a group: rows are
summed into (group, distance bin) moments with partial sums before the shuffle, and the bins up to the core's
share are added up; so a group of any size costs a few hundred rows of shuffle for each task.

Rows that fail the base rules (under `min_words` words, or more than half of the words in
repeated windows) are rejected without a verdict and stay out of the estimates. Groups
of fewer than `min_group` rows are judged by the estimate over all rows of their language, languages of
fewer by that over all rows, and a table of fewer not at all (kept). Null language and source are values of their own.
Null and empty texts have zero statistics and fail the base rule. Equal rows get equal
verdicts. An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entloom.llm.common import id_name, stored, word_array

WORD = "[^\\x20\\x09-\\x0D]"
BLANK = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
DIM = 5
#: The smallest standard deviation of a dimension that counts: statistics that are equal in nearly all clean
#: texts would otherwise reject any other value.
FLOOR = (0.12, 0.045, 0.16, 0.2, 0.06)
STARTS = 2


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, in place of the text.

    A window of three words is known by a 64-bit hash. Texts without a repeated window, most of them, end after one pass.
    """
    keep = [c for c in docs.columns if c != text]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    one = docs.select(*keep, body.alias("__t")).select(*keep, "__t", word_array(F.col("__t")).alias("__w"), F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(WORD)).alias("__l"))
    windows = F.transform(F.slice("__w", 1, F.greatest(F.size("__w") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2)))
    two = one.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate("__t", BLANK, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        windows.alias("__h"),
    )
    twice = F.size(F.array_distinct("__h")) < F.size("__h")
    three = two.select("*", F.when(twice, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__s")).drop("__h")
    same = F.filter("__s", lambda e, i: (e["h"] == F.get("__s", i - 1)["h"]) | (e["h"] == F.get("__s", i + 1)["h"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(same, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))
    return three.select(*[c for c in three.columns if c != "__s"], F.when(F.col("__s").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"))


def vector(df: DataFrame) -> list[Column]:
    """The transformed statistics: shares by their square roots, which evens out their variance, and logarithms."""
    n, c = F.greatest("n_words", F.lit(1)).cast("double"), F.greatest("word_chars", F.lit(1)).cast("double")
    return [
        F.log(c / n),
        F.sqrt(F.col("n_symbols") / c),
        F.sqrt(F.col("n_repeat_words") / n),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        F.sqrt(F.col("n_lines") / n),
    ]


def chi2_cdf(x: float, k: int) -> float:
    """The chi-square distribution with k degrees of freedom, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / (k / 2)
    n = k / 2
    while term > total * 1e-15:
        n += 1
        term *= (x / 2) / n
        total += term
    return total * math.exp(-x / 2 + (k / 2) * math.log(x / 2) - math.lgamma(k / 2))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return (lo + hi) / 2


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(DIM) for j in range(i + 1)]


def _moments() -> list[Column]:
    x = [F.col(f"x{i}") for i in range(DIM)]
    return [F.count(F.lit(1)).alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(DIM)), *(F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i, j in _pairs())]


def _estimate(sums: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Centre m, Cholesky factor l (lower, scatter = l l') and log determinant from moments; `factor` makes the scatter consistent."""
    df = sums.select(*keys, *(F.col(f"s{i}") / F.col("n") for i in range(DIM)), *((F.col(f"q{i}_{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * (F.col(f"s{j}") / F.col("n"))) * factor + (FLOOR[i] ** 2 if i == j else 0.0) for i, j in _pairs()))
    return _cholesky(df.toDF(*keys, *(f"m{i}" for i in range(DIM)), *(f"c{i}_{j}" for i, j in _pairs())), keys)


def _cholesky(df: DataFrame, keys: list[str]) -> DataFrame:
    for j in range(DIM):
        col = F.col(f"c{j}_{j}")
        for k in range(j):
            col = col - F.col(f"l{j}_{k}") * F.col(f"l{j}_{k}")
        df = df.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(col, F.lit(1e-12))))
        for i in range(j + 1, DIM):
            col = F.col(f"c{i}_{j}")
            for k in range(j):
                col = col - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            df = df.withColumn(f"l{i}_{j}", col / F.col(f"l{j}_{j}"))
    det = sum((F.log(f"l{j}_{j}") for j in range(1, DIM)), F.log("l0_0"))
    return df.select(*keys, *(f"m{i}" for i in range(DIM)), *(f"l{i}_{j}" for i, j in _pairs()), det.alias("logdet"))


def _distance(df: DataFrame) -> DataFrame:
    """`df` (vectors beside their group's estimate) with d2: forward substitution through the Cholesky factor."""
    for i in range(DIM):
        z = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            z = z - F.col(f"l{i}_{j}") * F.col(f"z{j}")
        df = df.withColumn(f"z{i}", z / F.col(f"l{i}_{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, DIM)), F.col("z0") * F.col("z0"))
    return df.withColumn("d2", d2).drop(*(f"z{i}" for i in range(DIM)))


def _concentrate(rows: DataFrame, est: DataFrame, keys: list[str], core: float, factor: float) -> DataFrame:
    """One step: the moments of the `core` share nearest to the estimate, by bins of the distance; then the next estimate."""
    near = _distance(rows.join(est, keys)).withColumn("bin", F.least(F.lit(800), F.floor(F.log1p("d2") * 64)).cast("int"))
    bins = near.groupBy(*keys, "bin").agg(*_moments())
    w = Window.partitionBy(*keys)
    kept = bins.withColumn("before", F.sum("n").over(w.orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(w)).where(F.col("before") < F.col("all") * core)
    sums = kept.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(DIM)), *(F.sum(f"q{i}_{j}").alias(f"q{i}_{j}") for i, j in _pairs()))
    return _estimate(sums, keys, factor)


def mcd(rows: DataFrame, core: float = 0.75, steps: int = 4) -> DataFrame:
    """The estimate of each group: rows (g, x0..) to (g, m.., l..)."""
    # Start 0: medians and median absolute deviations; start 1: mean and scatter of all rows.
    x = [f"x{i}" for i in range(DIM)]
    med = rows.groupBy("g").agg(*(F.percentile_approx(c, 0.5, 2000).alias(f"m{i}") for i, c in enumerate(x)))
    mad = rows.join(med, "g").groupBy("g").agg(*(F.first(f"m{i}").alias(f"m{i}") for i in range(DIM)), *(F.percentile_approx(F.abs(F.col(c) - F.col(f"m{i}")), 0.5, 2000).alias(f"a{i}") for i, c in enumerate(x)))
    diag = mad.select("g", F.lit(0).alias("start"), *(f"m{i}" for i in range(DIM)), *((F.pow(F.col(f"a{i}") * 1.4826, 2) + FLOOR[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i, j in _pairs()))
    keys = ["g", "start"]
    est = _cholesky(diag, keys).unionByName(_estimate(rows.groupBy("g").agg(*_moments()).withColumn("start", F.lit(1)), keys, 1.0))
    q = chi2_quantile(core, DIM)
    factor = core / chi2_cdf(q, DIM + 2)
    twice = rows.withColumn("start", F.explode(F.array(*(F.lit(s) for s in range(STARTS)))))
    for _ in range(steps):
        est = _concentrate(twice, est, keys, core, factor)
    cols = [c for c in est.columns if c not in keys]
    best = est.groupBy("g").agg(F.min_by(F.struct(*cols), F.struct("logdet", "start")).alias("e")).select("g", "e.*")
    # Reweighting: all rows within the 97.5 % ellipsoid of the raw estimate.
    near = _distance(rows.join(best, "g")).where(F.col("d2") <= chi2_quantile(0.975, DIM))
    return _estimate(near.groupBy("g").agg(*_moments()), ["g"], 1.0)


def judge(docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text", min_words: int = 50, min_group: int = 60, cutoff: float | None = None) -> DataFrame:
    """`docs` without the text, with its statistics, base_failed, distance2 (null without a verdict) and kept."""
    cutoff = chi2_quantile(0.9999, DIM) if cutoff is None else cutoff
    stats = text_statistics(docs.select(F.struct(*(c for c in docs.columns if c != text)).alias("__row"), F.col(text)), text)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    named = F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col(f"__row.{lang}").cast("string")), F.lit("-")), F.coalesce(F.concat(F.lit("="), F.col(f"__row.{source}").cast("string")), F.lit("-")))
    small = F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col(f"__row.{lang}").cast("string")), F.lit("-")))
    rows = stats.withColumn("base_failed", failed).withColumn("g0", named).withColumn("g1", small)
    # Numbers only from here on: every pass below reads this small table, not the texts.
    rows = stored(rows.select("*", *(v.cast("double").alias(f"x{i}") for i, v in enumerate(vector(rows)))), "mcd")
    fit = rows.where(~F.col("base_failed"))
    sizes = fit.groupBy("g0", "g1").agg(F.count(F.lit(1)).alias("n0"))
    one, every = Window.partitionBy("g1"), Window.partitionBy(F.lit(0))
    sizes = sizes.withColumn("n1", F.sum("n0").over(one)).withColumn("n", F.sum("n0").over(every))
    level = F.when(F.col("n0") >= min_group, 0).when(F.col("n1") >= min_group, 1).when(F.col("n") >= min_group, 2)
    sizes = sizes.withColumn("level", level)
    ids = [F.col("g0"), F.col("g1"), F.lit(0).cast("long")]
    asked = [F.col("level") == 0, F.max(F.col("level") == 1).over(one), F.max(F.col("level") == 2).over(every)]
    groups = sizes.select("g0", F.element_at(F.array(*ids), F.col("level") + 1).alias("g"), F.array_compact(F.array(*(F.when(a, i) for a, i in zip(asked, ids, strict=True)))).alias("into"))
    vectors = fit.join(groups, "g0").select(F.explode("into").alias("g"), *(f"x{i}" for i in range(DIM)))
    best = groups.drop("into").join(mcd(vectors), "g").drop("logdet", "g")
    seen = _distance(rows.join(best, "g0", "left"))
    verdict = ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= cutoff))
    return seen.select("__row.*", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", F.when(~F.col("base_failed"), F.col("d2")).alias("distance2"), verdict.alias("kept"), *(f"x{i}" for i in range(DIM)))


def keep_clean(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` that `judge` keeps."""
    named = docs.withColumn("__name", id_name(F.col("doc_id"))).withColumn("__hash", F.xxhash64("text"))
    out = judge(named.select("__name", "__hash", "doc_id", "lang", "source", "text"), **how).where("not kept").select("__name", "__hash").distinct()
    return named.join(out.hint("merge"), ["__name", "__hash"], "left_anti").select(*docs.columns)
