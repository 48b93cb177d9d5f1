"""First-writer-wins deduplication and its kin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def keep_first(df: DataFrame, keys: list[str | Column], *order: str | Column) -> DataFrame:
    """The first row of each key in the given total order; null keys are a key of their own."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, without sorting: the row is carried as one value through a combinable maximum."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def union_all(*parts: DataFrame) -> DataFrame:
    """Parts one below the other with missing columns as null, each row tagged by its part."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def merged_mirrors(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Events of one key as the first of them, with the union of their lists and the greatest importance and confidence."""
    rest = [c for c in events.columns if c not in (*keys, "mentions", "importance", "confidence", order)]
    first = F.min_by(F.struct(*rest), order).alias("_f")
    lists = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "mentions"))), lambda s: s["mentions"])))
    return events.groupBy(*keys).agg(first, lists.alias("mentions"), F.max("importance").alias("importance"), F.max("confidence").alias("confidence")).select(*keys, "_f.*", "mentions", "importance", "confidence")


def compatible(a: str, b: str, days: int) -> Column:
    """Whether two events of a ticker and type may be one: dates within ``days``, figures not disjoint, not up against down; what is missing doesn't conflict.

    a, b: the aliases of structs event_date_start, event_date_end, metrics, impact (1 up, -1 down).
    """
    at = lambda c: (F.col(a)[c], F.col(b)[c])
    near = lambda c: F.coalesce(F.abs(F.datediff(*at(c))) <= days, F.lit(True))
    x, y = at("metrics")
    none = lambda m: F.coalesce(F.size(m) <= 0, F.lit(True))
    opposed = F.coalesce(F.signum(at("impact")[0].cast("int")) * F.signum(at("impact")[1].cast("int")) < 0, F.lit(False))
    return near("event_date_start") & near("event_date_end") & (none(x) | none(y) | F.arrays_overlap(x, y)) & ~opposed


def compatible_pairs(events: DataFrame, days: int = 7) -> DataFrame:
    """ticker, a, b: pairs of events (the smaller id first) of one ticker and type that are ``compatible``.

    Events with a start and figures meet on ticker, type, figure and start day, one side exploded to the days within reach; where either
    has no figures, on ticker, type and start day; where either has no start, on ticker and type. Events without a ticker are a group of their own.
    """
    kept = F.struct("event_id", "event_date_start", "event_date_end", "metrics", "impact")
    some = F.coalesce(F.size("metrics") > 0, F.lit(False))
    e = events.where("event_id is not null").select(F.coalesce("ticker", F.lit("")).alias("ticker"), F.coalesce("event_type", F.lit("")).alias("kind"), F.col("event_date_start").alias("day"), some.alias("some"), kept.alias("x"))
    right = e.withColumnRenamed("x", "y")
    reach = lambda df: df.withColumn("day", F.explode(F.sequence(F.date_sub("day", days), F.date_add("day", days))))
    dated, right_dated, group = e.where("day is not null"), right.where("day is not null"), ["ticker", "kind"]
    figured = lambda df, c: df.where("some").withColumn("figure", F.explode(F.array_distinct(f"{c}.metrics")))
    parts = [
        reach(figured(dated, "x")).join(figured(right_dated, "y").drop("some"), [*group, "figure", "day"]),
        reach(dated.where("not some")).join(right_dated.drop("some"), [*group, "day"]),
        reach(dated.where("some")).join(right_dated.where("not some").drop("some"), [*group, "day"]),
        e.where("day is null").join(right.drop("some", "day"), group),
        dated.join(right.where("day is null").drop("some", "day"), group),
    ]
    chosen = (F.col("x.event_id") < F.col("y.event_id")) & compatible("x", "y", days)
    return reduce(DataFrame.union, [p.where(chosen).select("ticker", F.col("x.event_id").alias("a"), F.col("y.event_id").alias("b")) for p in parts]).distinct()
