"""Scores of forecasts and paired statistics of variants, as aggregations; only p-values leave the JVM."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def regression_score(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, mse, mae, r2 of true and pred; r2 is null where the truth doesn't vary."""
    e = F.col("true") - F.col("pred")
    return rows.groupBy(*keys).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / F.nullif(F.var_pop("true") * F.count("true"), F.lit(0.0))).alias("r2"))


def ranked_auc(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, auc of score against label 0/1 by average ranks; null with one class only.

    Ranks are taken over the distinct scores with their counts, so ties don't multiply rows.
    """
    by_score = rows.groupBy(*keys, "score").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    w = W.partitionBy(*keys).orderBy("score")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = by_score.withColumn("rank", before + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("pos"), F.sum(F.col("n") - F.col("p")).alias("neg"))
    return sums.select(*keys, ((F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2) / F.nullif(F.col("pos") * F.col("neg"), F.lit(0))).alias("auc"))


def paired(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """n, mean, sd, t, wins of the differences b - a of two variants joined by their keys (value columns ``value``)."""
    d = a.select(*keys, F.col("value").alias("a")).join(b.select(*keys, F.col("value").alias("b")), [*keys]).withColumn("d", F.col("b") - F.col("a"))
    return d.agg(
        F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"),
        (F.avg("d") / F.nullif(F.stddev_samp("d") / F.sqrt(F.count("*")), F.lit(0.0))).alias("t"), F.count_if(F.col("d") < 0).alias("wins"),
    )


def cross_pair_wins(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, pairs, wins: of all pairs of an a and a b of one key, those in which b is smaller; by sums of ranks, no pairs are made.

    Values of both sides are sorted per key; an equal value is no win.
    """
    both = a.select(key, F.col("value"), F.lit(1).alias("is_a")).unionByName(b.select(key, F.col("value"), F.lit(0).alias("is_a")))
    by_value = both.groupBy(key, "value").agg(F.sum("is_a").alias("na"), F.sum(1 - F.col("is_a")).alias("nb"))
    w = W.partitionBy(key).orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    ranked = by_value.withColumn("below", F.coalesce(F.sum("nb").over(w), F.lit(0)))
    return ranked.groupBy(key).agg((F.sum("na") * F.sum("nb")).alias("pairs"), F.sum(F.col("na") * F.col("below")).alias("wins"))


def dm_statistic(losses: DataFrame, lags: int) -> DataFrame:
    """n, mean, lrv, dm, lag1: mean loss difference over its Bartlett-weighted long-run variance, and the first autocorrelation. losses: i, d."""
    w = W.orderBy("i")
    mean = losses.agg(F.avg("d").alias("m"))
    c = losses.crossJoin(F.broadcast(mean)).withColumn("c", F.col("d") - F.col("m"))
    for k in range(1, lags + 1):
        c = c.withColumn(f"c{k}", F.lag("c", k).over(w))
    n = F.count("*")
    gamma = [F.sum(F.col("c") * F.col("c")) / n] + [F.coalesce(F.sum(F.col("c") * F.col(f"c{k}")), F.lit(0.0)) / n for k in range(1, lags + 1)]
    lrv = gamma[0]
    for k in range(1, lags + 1):
        lrv = lrv + 2 * (1 - k / (lags + 1)) * gamma[k]
    return c.agg(n.alias("n"), F.max("m").alias("mean"), lrv.alias("lrv"), (F.max("m") / F.sqrt(lrv / n)).alias("dm"), (gamma[1] / F.nullif(gamma[0], F.lit(0.0))).alias("lag1"))


def dm_bandwidth(n: int) -> int:
    """The number of lags of the long-run variance for a series of n."""
    return math.floor(4 * (n / 100) ** (2 / 9))


def hln_corrected(rows: DataFrame, h: int = 1) -> DataFrame:
    """rows (n, dm) with ``hln``: the statistic corrected for a small sample and a horizon of h."""
    n = F.col("n")
    return rows.withColumn("hln", F.col("dm") * F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n))


def ljung_box(losses: DataFrame, lags: int = 10) -> DataFrame:
    """n, q: the Ljung-Box statistic of the correlations of a series with itself. losses: i, d; the series is one of forecasts, ordered in one task."""
    w = W.orderBy("i")
    led = losses.select("d", *[F.lag("d", k).over(w).alias(f"d{k}") for k in range(1, lags + 1)])
    rows = led.agg(F.count("d").alias("n"), *[F.corr("d", f"d{k}").alias(f"r{k}") for k in range(1, lags + 1)])
    n = F.col("n")
    total = sum((F.col(f"r{k}") * F.col(f"r{k}") / (n - k) for k in range(1, lags + 1)), F.lit(0.0))
    return rows.select("n", (n * (n + 2) * total).alias("q"))


def welch(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """keys, t, df: Welch's statistic of two independent samples (column ``value``) and its degrees of freedom; null where neither varies."""
    side = lambda x, s: x.groupBy(*keys).agg(F.avg("value").alias(f"m{s}"), (F.var_samp("value") / F.count("value")).alias(f"v{s}"), F.count("value").alias(f"n{s}"))
    both = side(a, "a").join(side(b, "b"), [*keys])
    v = F.col("va") + F.col("vb")
    df = v * v / F.nullif(F.col("va") * F.col("va") / (F.col("na") - 1) + F.col("vb") * F.col("vb") / (F.col("nb") - 1), F.lit(0.0))
    return both.select(*keys, ((F.col("ma") - F.col("mb")) / F.nullif(F.sqrt(v), F.lit(0.0))).alias("t"), df.alias("df"))


def direction_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, n, accuracy, balanced, recall_up, recall_down, rate: of probabilities ``p`` at 0.5 against labels ``label`` 0/1; recalls of an absent class are null."""
    said, up = F.col("p") >= 0.5, F.col("label") == 1
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((said == up).cast("double")).alias("accuracy"), F.avg(F.when(up, said.cast("double"))).alias("recall_up"), F.avg(F.when(~up, (~said).cast("double"))).alias("recall_down"), F.avg(said.cast("double")).alias("rate"))
    return out.withColumn("balanced", (F.col("recall_up") + F.col("recall_down")) / 2)


def arm_gains(rows: DataFrame, base: str) -> DataFrame:
    """arm, gain, spread, wins: pooled change in percent of each arm's values against the base's with the same unit and draw, its range over the draws, and lower values.

    rows: arm, unit, draw, value. Units and draws that the base lacks are left out.
    """
    b = rows.where(F.col("arm") == base).select("unit", "draw", F.col("value").alias("b"))
    j = rows.where(F.col("arm") != base).join(b, ["unit", "draw"])
    pct = lambda d: 100 * F.sum(d) / F.sum("b")
    d = F.col("value") - F.col("b")
    draws = j.groupBy("arm", "draw").agg(pct(d).alias("g")).groupBy("arm").agg((F.max("g") - F.min("g")).alias("spread"), F.stddev_samp("g").alias("sd"))
    return j.groupBy("arm").agg(pct(d).alias("gain"), F.count_if(d < 0).alias("wins")).join(draws, "arm")


def percent_of_means(rows: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """keys, pct, wins, n, t: difference of the mean of a against that of b in percent, rows in which a is lower, and the paired statistic, null where differences don't vary."""
    d = F.col(a) - F.col(b)
    t = F.avg(d) / F.nullif(F.stddev_samp(d) / F.sqrt(F.count(d)), F.lit(0.0))
    return rows.groupBy(*keys).agg((100 * (F.avg(a) - F.avg(b)) / F.avg(b)).alias("pct"), F.count_if(d < 0).alias("wins"), F.count(d).alias("n"), t.alias("t"))


def scaled_error(rows: DataFrame, ranges: DataFrame, *keys: str) -> DataFrame:
    """keys, mse, mae: errors of true and pred on the scale from least to greatest value (ranges: keys, lo, hi); null where that is one point."""
    span = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    e = (F.col("true") - F.col("pred")) / span
    return rows.join(ranges, [*keys]).groupBy(*keys).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))


def mean_if_complete(rows: DataFrame, unit: str, units: list[str], *keys: str) -> DataFrame:
    """keys, value: the mean of ``value`` over the units, for keys that have them all."""
    own = rows.where(F.col(unit).isin(units)).groupBy(*keys).agg(F.avg("value").alias("value"), F.count_distinct(unit).alias("_n"))
    return own.where(F.col("_n") == len(units)).drop("_n")


def factor_effects(rows: DataFrame, *factors: str) -> DataFrame:
    """factor, effect: mean value with the factor (0/1) on minus off; all factors from one grouping of the rows."""
    grouped = rows.groupBy(*factors).agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    each = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("on")) for f in factors])
    long = grouped.select("s", "n", F.inline(each))
    side = lambda v: F.sum(F.when(F.col("on") == v, F.col("s"))) / F.sum(F.when(F.col("on") == v, F.col("n")))
    return long.groupBy("factor").agg((side(1) - side(0)).alias("effect"))


def t_two_sided(t: float, df: int) -> float:
    """p of a t statistic by the continued fraction of the incomplete beta function."""
    if df <= 0 or t != t:
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d or 1e-300)
                c = 1 + num / c or 1e-300
                h *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return h

    if x >= 1:
        return 1.0
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def rank_sum_p(wins: int, n: int, m: int) -> float:
    """Two-sided exact p of a Mann-Whitney count of wins among n * m pairs without ties."""
    ways = [1] + [0] * (n * m)
    for i in range(1, n + 1):
        for u in range(n * m, m + i - 1, -1):
            ways[u] -= ways[u - m - i]
        for u in range(i, n * m + 1):
            ways[u] += ways[u - i]
    tail = sum(ways[: min(wins, n * m - wins) + 1]) / sum(ways)
    return min(1.0, 2 * tail)


def with_p(rows: DataFrame) -> DataFrame:
    """rows (n, t) with p, the two-sided p-value."""
    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield x.assign(p=[t_two_sided(t, int(n) - 1) if t == t and t is not None else None for t, n in zip(x["t"], x["n"])])

    return rows.mapInPandas(f, ", ".join(f"{c} {k}" for c, k in rows.dtypes) + ", p double")
