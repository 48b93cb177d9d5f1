"""Ordered series per entity: returns, medians, splits, lead joins, windows, repairs.

Every function partitions by the entity, so entities are processed side by side; rows of one
entity are ordered by ``date``. Nulls in a price or value drop the row unless stated; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def by_entity(entity: str = "ticker", order: str = "date"):
    return W.partitionBy(entity).orderBy(order)


def usable_prices(prices: DataFrame, column: str = "close", fallback: str = "close") -> DataFrame:
    """ticker, date, price: the column, where null or not positive the fallback; rows without either are left out."""
    good = lambda c: F.when(F.col(c) > 0, F.col(c))
    p = F.coalesce(good(column), good(fallback))
    return prices.select("ticker", "date", p.alias("price")).where(F.col("price").isNotNull() & ~F.isnan("price") & F.col("date").isNotNull())


def same_day_return(prices: DataFrame) -> DataFrame:
    """ticker, date, ret: change from the row before; the first row of a ticker has none."""
    prev = F.lag("price").over(by_entity())
    return prices.withColumn("ret", F.when(prev > 0, F.col("price") / prev - 1)).where("ret is not null").select("ticker", "date", "ret")


def forward_return(prices: DataFrame, h: int) -> DataFrame:
    """ticker, date, ret: change over the next ``h`` rows; the last ``h`` rows have none."""
    ahead = F.lead("price", h).over(by_entity())
    return prices.withColumn("ret", ahead / F.col("price") - 1).where("ret is not null").select("ticker", "date", "ret")


def trailing_median(returns: DataFrame, lookback: int = 60, least: int = 20) -> DataFrame:
    """ticker, date, median of absolute returns over the last ``lookback`` observations, null under ``least``."""
    w = by_entity().rowsBetween(-(lookback - 1), 0)
    a = F.abs("ret")
    return returns.select("ticker", "date", F.when(F.count(a).over(w) >= least, F.percentile(a, F.lit(0.5)).over(w)).alias("median"))


def split_bounds(dates: DataFrame, train: float = 0.7, val: float = 0.1) -> DataFrame:
    """train_end, val_end: boundaries by position among the distinct dates, in double arithmetic."""
    days = dates.select("date").distinct()
    n = days.count()
    ranked = days.withColumn("i", F.row_number().over(W.orderBy("date")) - 1)
    at = lambda f: max(0, int(n * f) - 1)
    return ranked.agg(F.max(F.when(F.col("i") == at(train), F.col("date"))).alias("train_end"), F.max(F.when(F.col("i") == at(train + val), F.col("date"))).alias("val_end"))


def assign_splits(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """rows with split: train up to train_end, val up to val_end, test after it."""
    s = F.when(F.col("date") <= F.col("train_end"), "train").when(F.col("date") <= F.col("val_end"), "val").otherwise("test")
    return rows.crossJoin(F.broadcast(bounds)).withColumn("split", s).drop("train_end", "val_end")


def window_sum(keys: DataFrame, daily: DataFrame, days: int, value: str, out: str) -> DataFrame:
    """keys with the sum of the daily values in [date - days, date], 0 where there are none.

    The interval join is an equi-join on the exploded days, so it hashes by entity and day.
    """
    offsets = keys.select("ticker", "date").distinct().withColumn("day", F.explode(F.sequence(F.date_sub("date", days), F.col("date"))))
    sums = offsets.join(daily.select("ticker", F.col("date").alias("day"), F.col(value).alias("_v")), ["ticker", "day"]).groupBy("ticker", "date").agg(F.sum("_v").alias(out))
    return keys.join(sums, ["ticker", "date"], "left").withColumn(out, F.coalesce(out, F.lit(0)))


def decayed_window_sum(keys: DataFrame, daily: DataFrame, days: int, value: str, rate: float) -> DataFrame:
    """ticker, date, total: daily values in [date - days, date], weighted by exp(-rate * days ago); keys without any are left out."""
    offsets = keys.select("ticker", "date").distinct().withColumn("ago", F.explode(F.sequence(F.lit(0), F.lit(days)))).withColumn("day", F.expr("date_sub(date, ago)"))
    joined = offsets.join(daily.select("ticker", F.col("date").alias("day"), F.col(value).alias("_v")), ["ticker", "day"])
    return joined.groupBy("ticker", "date").agg(F.sum(F.col("_v") * F.exp(-rate * F.col("ago"))).alias("total"))


def lead_join(prices: DataFrame, vectors: DataFrame, lead: int, *values: str) -> DataFrame:
    """Prices within the vectors' overall first and last date, each with the vector of the row ``lead`` rows ahead, 0 where there is none.

    The clipping is by the bounds over all tickers and comes before the lead.
    """
    bounds = vectors.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    clipped = prices.crossJoin(F.broadcast(bounds)).where("date between lo and hi").drop("lo", "hi")
    keyed = clipped.withColumn("_at", F.lead("date", lead).over(by_entity()) if lead else F.col("date"))
    joined = keyed.join(vectors.select("ticker", F.col("date").alias("_at"), *values), ["ticker", "_at"], "left").drop("_at")
    return joined.withColumns({v: F.coalesce(v, F.lit(0.0)) for v in values})


def market_excess(returns: DataFrame, market: DataFrame) -> DataFrame:
    """ticker, date, ret, market, excess: a missing benchmark counts as 0. The benchmark has a row per date and is joined by date."""
    return returns.join(market.select("date", F.col("ret").alias("market")), "date", "left").withColumn("market", F.coalesce("market", F.lit(0.0))).withColumn("excess", F.col("ret") - F.col("market")).select("ticker", "date", "ret", "market", "excess")


def splice_factors(prices: DataFrame, before: str, on: str, limit: float = 0.10) -> DataFrame:
    """ticker, factor: what values before a break are multiplied by so that the break shows the ticker's own return.

    The return is that of the price over the break; where it is beyond ``limit`` the market's median is taken instead.
    """
    ends = prices.groupBy("ticker").agg(F.max(F.when(F.col("date") == F.lit(before).cast("date"), F.col("price"))).alias("v0"), F.max(F.when(F.col("date") == F.lit(on).cast("date"), F.col("price"))).alias("v1")).dropna()
    ends = ends.withColumn("r", F.col("v1") / F.col("v0") - 1)
    market = ends.agg(F.percentile("r", F.lit(0.5)).alias("m"))
    own = F.when(F.abs("r") > limit, F.col("m")).otherwise(F.col("r"))
    return ends.crossJoin(F.broadcast(market)).select("ticker", (F.col("v1") / F.col("v0") / (1 + own)).alias("factor"))


def splice_repaired(prices: DataFrame, factors: DataFrame, on: str) -> DataFrame:
    """Prices times the factor and volumes divided by it before the break; factors within 1e-6 of 1 are dropped."""
    f = factors.where(F.abs(F.col("factor") - 1) >= 1e-6)
    early = (F.col("date") < F.lit(on).cast("date")) & F.col("factor").isNotNull()
    joined = prices.join(f, "ticker", "left")
    return joined.withColumns({"price": F.when(early, F.col("price") * F.col("factor")).otherwise(F.col("price")), "volume": F.when(early, F.col("volume") / F.col("factor")).otherwise(F.col("volume").cast("double"))}).drop("factor")


def decay_to_neutral(dates: DataFrame, scores: DataFrame, neutral: float = 3.0, rate: float = 0.03) -> DataFrame:
    """ticker, date, score: a scored day's score; other days neutral + (last score - neutral) * exp(-rate * listed days after the last scored day).

    A day before the last scored one but without a score has a gap of 0 and so the last score.
    """
    last = scores.groupBy("ticker").agg(F.max("date").alias("last"), F.max_by("score", "date").alias("last_score"))
    w = by_entity().rowsBetween(W.unboundedPreceding, 0)
    base = dates.join(last, "ticker").join(scores, ["ticker", "date"], "left")
    gap = F.sum((F.col("date") > F.col("last")).cast("int")).over(w)
    return base.select("ticker", "date", F.coalesce("score", neutral + (F.col("last_score") - neutral) * F.exp(-rate * gap)).alias("score"))


def sliding_windows(series: DataFrame, size: int, ahead: int = 0, step: int = 1) -> DataFrame:
    """ticker, start, x (``size`` prices), y (the next ``ahead``) for each full window, every ``step`` rows."""
    w = by_entity()
    x = F.collect_list("price").over(w.rowsBetween(0, size - 1))
    y = F.collect_list("price").over(w.rowsBetween(size, size + ahead - 1)) if ahead else F.array().cast("array<double>")
    rows = series.select("ticker", (F.row_number().over(w) - 1).alias("start"), x.alias("x"), y.alias("y"))
    return rows.where((F.size("x") == size) & (F.size("y") == ahead) & (F.col("start") % step == 0))


def instance_normed(windows: DataFrame) -> DataFrame:
    """ticker, start, mean, scale, x: each window by its own mean and population deviation (of variance + 1e-5)."""
    n = F.size("x")
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / n
    var = F.aggregate("x", F.lit(0.0), lambda s, v: s + (v - F.col("mean")) * (v - F.col("mean"))) / n
    return windows.withColumn("mean", mean).withColumn("scale", F.sqrt(var + 1e-5)).withColumn("x", F.transform("x", lambda v: (v - F.col("mean")) / F.col("scale"))).select("ticker", "start", "mean", "scale", "x")


def minmax_scaled(series: DataFrame, train: Column | None = None) -> DataFrame:
    """ticker, date, price scaled by least and greatest price of all rows, or of the training rows; a range of 0 counts as 1."""
    seen = F.col("price") if train is None else F.when(train, F.col("price"))
    w = W.partitionBy("ticker")
    lo, hi = F.min(seen).over(w), F.max(seen).over(w)
    return series.select("ticker", "date", ((F.col("price") - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo)).alias("price"))


def random_walk(series: DataFrame, steps: int) -> DataFrame:
    """ticker, date, step, true, pred: the last known price as forecast for each of the next ``steps`` rows."""
    w = by_entity()
    rows = series.select("ticker", "date", F.col("price").alias("pred"), F.array(*[F.lead("price", k).over(w) for k in range(1, steps + 1)]).alias("ys"))
    return rows.where(F.col("ys")[steps - 1].isNotNull()).select("ticker", "date", "pred", F.posexplode("ys").alias("step", "true")).select("ticker", "date", (F.col("step") + 1).alias("step"), "true", "pred")


def adjusted_detection(rows: DataFrame) -> DataFrame:
    """ticker, date, pred: within each run of true rows, all are detected if any is (gaps and islands)."""
    w = by_entity()
    change = (F.col("label") != F.lag("label", 1, 0).over(w)).cast("int")
    isled = rows.withColumn("change", change).withColumn("island", F.sum("change").over(w))
    whole = W.partitionBy("ticker", "island")
    return isled.select("ticker", "date", F.when(F.col("label") == 1, F.max("pred").over(whole)).otherwise(F.col("pred")).alias("pred"))


def last_values(series: DataFrame, n: int) -> DataFrame:
    """ticker, vals, mask: the last ``n`` prices of each ticker, padded with 0 on the left."""
    ranked = series.withColumn("r", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("date")))).where(F.col("r") <= n)
    own = ranked.groupBy("ticker").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("r")).alias("r"), "price"))), lambda s: s["price"]).alias("v"))
    pad = F.array_repeat(F.lit(0.0), (n - F.size("v")).cast("int"))
    return own.select("ticker", F.concat(pad, "v").alias("vals"), F.concat(F.array_repeat(F.lit(0), (n - F.size("v")).cast("int")), F.array_repeat(F.lit(1), F.size("v"))).alias("mask"))


def ranked(rows: DataFrame, part: str, *order: str) -> DataFrame:
    """rows with i: their rank from 0 on by part, then by the order; counts of the parts before plus the rank within the part."""
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    base = rows.groupBy(part).agg(F.count("*").alias("_n")).select(F.col(part).alias("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = rows.withColumn("_i", F.row_number().over(W.partitionBy(part).orderBy(*order)) - 1)
    return own.join(base, F.col(part).eqNullSafe(F.col("_part"))).withColumn("i", F.col("_base") + F.col("_i")).drop("_part", "_base", "_i")
