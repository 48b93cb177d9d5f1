"""Queries that score forecasts and compare variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import series as S
from loomgraph.operators import stats
from loomgraph.plans import tables as T


def _walk(spark, d):
    return S.random_walk(T.prices(spark, d), 3)


def _runs(spark, d):
    """run, seed, value: mean order totals by priority and month, as stand-ins for scored runs."""
    o = T.table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("arm"), F.concat(F.lit("_seed"), F.month("o_orderdate").cast("string")).alias("s")).agg(F.round(F.avg("o_totalprice"), 2).alias("value")).withColumn("run", F.concat("arm", "s"))


def regression_score(spark, d):
    return stats.regression_score(_walk(spark, d), "ticker", "step").select("ticker", "step", F.round("mse", 0).alias("mse"), F.round("mae", 2).alias("mae"), F.round("r2", 6).alias("r2"))


def auc_rank(spark, d):
    t = T.tasks(spark, d).where("trailing_abs_median is not null")
    return stats.ranked_auc(t.select("split", F.round("trailing_abs_median", 4).alias("score"), F.col("label_abs_move").alias("label")), "split").select("split", F.round("auc", 6).alias("auc"))


def evaluate_rows(spark, d):
    t = T.tasks(spark, d).where("raw_return is not null").select("split", (1 / (1 + F.exp(-50 * F.col("raw_return")))).alias("p"), F.col("label_direction").alias("y"))
    return t.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")), 6).alias("accuracy"), F.round(F.min("p"), 6).alias("least"), F.round(F.max("p"), 6).alias("most"), F.round(F.stddev_pop("p"), 6).alias("sd"))


def seed_summary(spark, d):
    r = _runs(spark, d).select(F.regexp_replace("run", r"_seed\d+$", "").alias("arm"), "value")
    return r.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("value"), 2).alias("mean"), F.round(F.stddev_pop("value"), 2).alias("sd"))


def best_checkpoint(spark, d):
    return _runs(spark, d).groupBy("arm").agg(F.max_by("run", F.struct("value", "run")).alias("run"), F.max("value").alias("value"))


def paired_t(spark, d):
    r = _runs(spark, d)
    a, b = (r.where(F.col("arm") == x).select("s", "value") for x in ("1-URGENT", "5-LOW"))
    return stats.paired(a, b, "s").select("n", F.round("mean", 2).alias("mean"), F.round("sd", 2).alias("sd"), F.round("t", 4).alias("t"), "wins")


def paired_p(spark, d):
    r = _runs(spark, d)
    a, b = (r.where(F.col("arm") == x).select("s", "value") for x in ("1-URGENT", "5-LOW"))
    return stats.with_p(stats.paired(a, b, "s").select("n", "t"))


def cross_pair_wins(spark, d):
    o = T.table(spark, d, "orders").select(F.month("o_orderdate").alias("m"), "o_orderpriority", F.col("o_totalprice").alias("value"))
    return stats.cross_pair_wins(o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderpriority = '5-LOW'"), "m")


def ablation_table(spark, d):
    r = _runs(spark, d)
    base = r.where("arm = '5-LOW'").select("s", F.col("value").alias("b"))
    j = r.join(base, "s")
    return j.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("value"), 2).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 2).alias("sd"), F.round(100 * (F.sum("value") - F.sum("b")) / F.sum("b"), 4).alias("pct"), F.count_if(F.col("value") < F.col("b")).alias("wins"))


def factor_effects(spark, d):
    o = T.table(spark, d, "orders").select((F.month("o_orderdate") % 2).alias("odd"), (F.col("o_orderstatus") == "F").cast("int").alias("done"), (F.col("o_orderpriority") < "3").cast("int").alias("urgent"), F.col("o_totalprice").alias("value"))
    return stats.factor_effects(o, "odd", "done", "urgent").select("factor", F.round("effect", 3).alias("effect"))


def grid_pool(spark, d):
    r = stats.regression_score(_walk(spark, d), "ticker", "step")
    return r.groupBy("step").agg(F.count("*").alias("companies"), F.round(F.avg("r2"), 6).alias("r2"), F.round(F.avg("mae"), 2).alias("mae"))


def gate_check(spark, d):
    r = _runs(spark, d)
    a, b = r.where("arm = '1-URGENT'").select("s", F.col("value").alias("a")), r.where("arm = '2-HIGH'").select("s", F.col("value").alias("b"))
    return a.join(b, "s").agg(F.round(F.max(F.abs(F.col("a") - F.col("b"))), 2).alias("worst"), F.round(F.max(F.abs(F.col("a") - F.col("b")) / F.abs("b")), 6).alias("relative"))


def dm_statistic(spark, d):
    o = T.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("i")).agg(F.max_by("o_totalprice", "o_orderkey").alias("x"), F.min_by("o_totalprice", "o_orderkey").alias("y"))
    return stats.dm_statistic(o.select("i", ((F.col("x") - F.col("y")) / 1000).alias("d")), 5).select("n", F.round("mean", 4).alias("mean"), F.round("lrv", 2).alias("lrv"), F.round("dm", 4).alias("dm"), F.round("lag1", 4).alias("lag1"))


def dm_corrected(spark, d):
    o = T.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("i")).agg(F.max_by("o_totalprice", "o_orderkey").alias("x"), F.min_by("o_totalprice", "o_orderkey").alias("y")).where("i < date '1996-01-01'")
    losses = o.select("i", ((F.col("x") - F.col("y")) / 1000).alias("d"))
    return stats.hln_corrected(stats.dm_statistic(losses, 5), 3).select("n", F.round("dm", 4).alias("dm"), F.round("hln", 4).alias("hln"))


def ljung_box(spark, d):
    o = T.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("i")).agg(F.sum("o_totalprice").alias("d"))
    return stats.ljung_box(o).select("n", F.round("q", 3).alias("q"))


def welch(spark, d):
    o = T.table(spark, d, "orders").select(F.month("o_orderdate").alias("m"), "o_orderpriority", F.col("o_totalprice").alias("value"))
    return stats.welch(o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderpriority = '5-LOW'"), "m").select("m", F.round("t", 4).alias("t"), F.round("df", 2).alias("df"))


def direction_metrics(spark, d):
    t = T.tasks(spark, d).where("raw_return is not null").select("split", (1 / (1 + F.exp(-50 * F.col("raw_return")))).alias("p"), F.col("label_direction").alias("label"))
    return stats.direction_metrics(t, "split").select("split", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "recall_up", "recall_down", "rate", "balanced")])


def arm_gains(spark, d):
    o = T.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("arm"), F.col("o_orderstatus").alias("unit"), F.month("o_orderdate").alias("draw")).agg(F.avg("o_totalprice").alias("value"))
    return stats.arm_gains(o, "5-LOW").select("arm", F.round("gain", 4).alias("gain"), "wins", F.round("spread", 4).alias("spread"), F.round("sd", 4).alias("sd"))


def percent_of_means(spark, d):
    """Persistence of the day before beside that of two days before, by nation."""
    w = _walk(spark, d).where("step <= 2").groupBy("ticker", F.col("date")).pivot("step", [1, 2]).agg(F.first(F.abs(F.col("true") - F.col("pred"))))
    return stats.percent_of_means(w.toDF("ticker", "date", "a", "b"), "a", "b", "ticker").select("ticker", F.round("pct", 4).alias("pct"), "wins", "n", F.round("t", 4).alias("t"))


def scaled_error(spark, d):
    p = T.prices(spark, d).groupBy("ticker").agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    return stats.scaled_error(_walk(spark, d).where("step = 1"), p, "ticker").select("ticker", F.round("mse", 6).alias("mse"), F.round("mae", 6).alias("mae"))


def mean_if_complete(spark, d):
    r = _runs(spark, d)
    return stats.mean_if_complete(r, "arm", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"], "s").select("s", F.round("value", 2).alias("value"))


_NAMES = "regression_score auc_rank evaluate_rows seed_summary best_checkpoint paired_t paired_p cross_pair_wins ablation_table factor_effects grid_pool gate_check dm_statistic dm_corrected ljung_box welch direction_metrics arm_gains percent_of_means scaled_error mean_if_complete".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_WALK = f"""{T.PRICES}, w AS (SELECT ticker, price, [lead(price, 1) OVER w, lead(price, 2) OVER w, lead(price, 3) OVER w] AS y FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)),
walk AS (SELECT ticker, step, y[step] AS y, price AS p FROM (SELECT *, unnest([1, 2, 3])::INT AS step FROM w WHERE y[3] IS NOT NULL)), score AS (SELECT ticker, step, avg((y - p) ** 2) AS mse, avg(abs(y - p)) AS mae, 1 - sum((y - p) ** 2) / (var_pop(y) * count(y)) AS r2 FROM walk GROUP BY 1, 2)"""
_RUNS = "runs AS (SELECT o_orderpriority AS arm, '_seed' || month(o_orderdate) AS s, round(avg(o_totalprice), 2) AS value, o_orderpriority || '_seed' || month(o_orderdate) AS run FROM orders GROUP BY ALL)"
ORACLE = {
    "regression_score": f"WITH {_WALK} SELECT ticker, step, round(mse, 0) AS mse, round(mae, 2) AS mae, round(r2, 6) AS r2 FROM score",
    "auc_rank": f"WITH {T.TASKS}, x AS (SELECT split, round(trailing_abs_median, 4) AS s, label_abs_move AS y FROM tasks WHERE trailing_abs_median IS NOT NULL), r AS (SELECT *, avg(rn) OVER (PARTITION BY split, s) AS k FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY s) AS rn FROM x)) SELECT split, round((sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc FROM r GROUP BY 1",
    "evaluate_rows": f"WITH {T.TASKS}, x AS (SELECT split, 1 / (1 + exp(-50 * raw_return)) AS p, label_direction AS y FROM tasks WHERE raw_return IS NOT NULL) SELECT split, count(*) AS n, round(avg(CAST(CAST(p >= 0.5 AS INT) = y AS DOUBLE)), 6) AS accuracy, round(min(p), 6) AS least, round(max(p), 6) AS most, round(stddev_pop(p), 6) AS sd FROM x GROUP BY 1",
    "seed_summary": f"WITH {_RUNS} SELECT arm, count(*) AS n, round(avg(value), 2) AS mean, round(stddev_pop(value), 2) AS sd FROM runs GROUP BY 1",
    "best_checkpoint": f"WITH {_RUNS} SELECT arm, arg_max(run, {{'v': value, 'r': run}}) AS run, max(value) AS value FROM runs GROUP BY 1",
    "paired_t": f"WITH {_RUNS}, x AS (SELECT b.value - a.value AS d FROM runs a JOIN runs b USING (s) WHERE a.arm = '1-URGENT' AND b.arm = '5-LOW') SELECT count(*) AS n, round(avg(d), 2) AS mean, round(stddev_samp(d), 2) AS sd, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t, count(*) FILTER (d < 0) AS wins FROM x",
    "cross_pair_wins": "SELECT CAST(month(a.o_orderdate) AS INT) AS m, count(*) AS pairs, count(*) FILTER (b.o_totalprice < a.o_totalprice) AS wins FROM orders a JOIN orders b ON a.o_orderpriority = '1-URGENT' AND b.o_orderpriority = '5-LOW' AND month(a.o_orderdate) = month(b.o_orderdate) GROUP BY 1",
    "ablation_table": f"WITH {_RUNS} SELECT r.arm, count(*) AS n, round(avg(r.value), 2) AS mean, round(coalesce(stddev_samp(r.value), 0), 2) AS sd, round(100 * (sum(r.value) - sum(b.value)) / sum(b.value), 4) AS pct, count(*) FILTER (r.value < b.value) AS wins FROM runs r JOIN runs b ON b.arm = '5-LOW' AND b.s = r.s GROUP BY 1",
    "factor_effects": "WITH o AS (SELECT month(o_orderdate) % 2 AS odd, CAST(o_orderstatus = 'F' AS INT) AS done, CAST(o_orderpriority < '3' AS INT) AS urgent, o_totalprice AS v FROM orders), l AS (SELECT 'odd' AS factor, odd AS f, v FROM o UNION ALL SELECT 'done', done, v FROM o UNION ALL SELECT 'urgent', urgent, v FROM o) SELECT factor, round(avg(v) FILTER (f = 1) - avg(v) FILTER (f = 0), 3) AS effect FROM l GROUP BY 1",
    "grid_pool": f"WITH {_WALK} SELECT step, count(*) AS companies, round(avg(r2), 6) AS r2, round(avg(mae), 2) AS mae FROM score GROUP BY 1",
    "gate_check": f"WITH {_RUNS} SELECT round(max(abs(a.value - b.value)), 2) AS worst, round(max(abs(a.value - b.value) / abs(b.value)), 6) AS relative FROM runs a JOIN runs b USING (s) WHERE a.arm = '1-URGENT' AND b.arm = '2-HIGH'",
    "dm_statistic": """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS i, (arg_max(o_totalprice, o_orderkey) - arg_min(o_totalprice, o_orderkey)) / 1000 AS d FROM orders GROUP BY 1), c AS (SELECT i, d - avg(d) OVER () AS c, avg(d) OVER () AS m FROM o),
l AS (SELECT *, lag(c, 1) OVER w AS c1, lag(c, 2) OVER w AS c2, lag(c, 3) OVER w AS c3, lag(c, 4) OVER w AS c4, lag(c, 5) OVER w AS c5 FROM c WINDOW w AS (ORDER BY i)),
g AS (SELECT count(*) AS n, any_value(m) AS m, sum(c * c) / count(*) AS g0, sum(c * c1) / count(*) AS g1, sum(c * c2) / count(*) AS g2, sum(c * c3) / count(*) AS g3, sum(c * c4) / count(*) AS g4, sum(c * c5) / count(*) AS g5 FROM l),
v AS (SELECT *, g0 + 2 * (5 / 6.0::DOUBLE * g1 + 4 / 6.0::DOUBLE * g2 + 3 / 6.0::DOUBLE * g3 + 2 / 6.0::DOUBLE * g4 + 1 / 6.0::DOUBLE * g5) AS lrv FROM g) SELECT n, round(m, 4) AS mean, round(lrv, 2) AS lrv, round(m / sqrt(lrv / n), 4) AS dm, round(g1 / g0, 4) AS lag1 FROM v""",
    "dm_corrected": """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS i, (arg_max(o_totalprice, o_orderkey) - arg_min(o_totalprice, o_orderkey)) / 1000 AS d FROM orders WHERE o_orderdate < DATE '1996-01-01' GROUP BY 1), c AS (SELECT i, d - avg(d) OVER () AS c, avg(d) OVER () AS m FROM o),
l AS (SELECT *, lag(c, 1) OVER w AS c1, lag(c, 2) OVER w AS c2, lag(c, 3) OVER w AS c3, lag(c, 4) OVER w AS c4, lag(c, 5) OVER w AS c5 FROM c WINDOW w AS (ORDER BY i)),
v AS (SELECT count(*) AS n, any_value(m) AS m, (sum(c * c) + 2 * (5 / 6.0::DOUBLE * sum(c * c1) + 4 / 6.0::DOUBLE * sum(c * c2) + 3 / 6.0::DOUBLE * sum(c * c3) + 2 / 6.0::DOUBLE * sum(c * c4) + 1 / 6.0::DOUBLE * sum(c * c5))) / count(*) AS lrv FROM l)
SELECT n, round(m / sqrt(lrv / n), 4) AS dm, round(m / sqrt(lrv / n) * sqrt((n - 5 + 6 / n) / n), 4) AS hln FROM v""",
    "ljung_box": f"""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS i, sum(o_totalprice) AS d FROM orders GROUP BY 1), l AS (SELECT d, {', '.join(f'lag(d, {k}) OVER (ORDER BY i) AS d{k}' for k in range(1, 11))} FROM o)
SELECT count(*) AS n, round(count(*) * (count(*) + 2) * ({' + '.join(f'corr(d, d{k}) ** 2 / (count(*) - {k})' for k in range(1, 11))}), 3) AS q FROM l""",
    "welch": """WITH s AS (SELECT month(o_orderdate) AS m, o_orderpriority AS p, avg(o_totalprice) AS a, var_samp(o_totalprice) / count(*) AS v, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1, 2)
SELECT CAST(x.m AS INT) AS m, round((x.a - y.a) / sqrt(x.v + y.v), 4) AS t, round((x.v + y.v) ** 2 / (x.v ** 2 / (x.n - 1) + y.v ** 2 / (y.n - 1)), 2) AS df FROM s x JOIN s y ON x.m = y.m AND x.p = '1-URGENT' AND y.p = '5-LOW'""",
    "direction_metrics": f"""WITH {T.TASKS}, x AS (SELECT split, 1 / (1 + exp(-50 * raw_return)) >= 0.5 AS s, label_direction = 1 AS y FROM tasks WHERE raw_return IS NOT NULL), g AS (SELECT split, count(*) AS n, avg(CAST(s = y AS DOUBLE)) AS a, avg(CAST(s AS DOUBLE)) FILTER (y) AS u, avg(CAST(NOT s AS DOUBLE)) FILTER (NOT y) AS w, avg(CAST(s AS DOUBLE)) AS r FROM x GROUP BY 1)
SELECT split, n, round(a, 6) AS accuracy, round(u, 6) AS recall_up, round(w, 6) AS recall_down, round(r, 6) AS rate, round((u + w) / 2, 6) AS balanced FROM g""",
    "arm_gains": """WITH r AS (SELECT o_orderpriority AS arm, o_orderstatus AS unit, month(o_orderdate) AS draw, avg(o_totalprice) AS v FROM orders GROUP BY ALL), j AS (SELECT r.arm, r.draw, r.v, b.v AS b FROM r JOIN r b ON b.arm = '5-LOW' AND b.unit = r.unit AND b.draw = r.draw WHERE r.arm <> '5-LOW'),
g AS (SELECT arm, max(g) - min(g) AS spread, stddev_samp(g) AS sd FROM (SELECT arm, draw, 100 * sum(v - b) / sum(b) AS g FROM j GROUP BY 1, 2) GROUP BY 1), p AS (SELECT arm, 100 * sum(v - b) / sum(b) AS gain, count(*) FILTER (v < b) AS wins FROM j GROUP BY 1)
SELECT arm, round(gain, 4) AS gain, wins, round(spread, 4) AS spread, round(sd, 4) AS sd FROM p JOIN g USING (arm)""",
    "percent_of_means": f"""WITH {T.PRICES}, w AS (SELECT ticker, abs(lead(price, 1) OVER w - price) AS a, abs(lead(price, 2) OVER w - price) AS b, lead(price, 3) OVER w AS z FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)), x AS (SELECT ticker, a, b FROM w WHERE z IS NOT NULL)
SELECT ticker, round(100 * (avg(a) - avg(b)) / avg(b), 4) AS pct, count(*) FILTER (a < b) AS wins, count(*) AS n, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 4) AS t FROM x GROUP BY 1""",
    "scaled_error": f"WITH {_WALK}, g AS (SELECT ticker, max(price) - min(price) AS r FROM prices GROUP BY 1) SELECT ticker, round(avg(((y - p) / r) ** 2), 6) AS mse, round(avg(abs(y - p) / r), 6) AS mae FROM walk JOIN g USING (ticker) WHERE step = 1 GROUP BY 1",
    "mean_if_complete": f"WITH {_RUNS} SELECT s, round(avg(value), 2) AS value FROM runs WHERE arm IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') GROUP BY 1 HAVING count(DISTINCT arm) = 4",
}
