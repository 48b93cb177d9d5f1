"""Queries over ordered series, tasks and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomgraph.functions import text as X
from loomgraph.functions import vectors as V
from loomgraph.operators import series as S
from loomgraph.plans import tables as T

R6 = lambda c: F.round(c, 6).alias(c)
FIRST, BREAK = "1996-07-01", "1996-07-02"


def lead_join(spark, d):
    out = S.lead_join(T.prices(spark, d).select("ticker", "date", "price"), T.shipments(spark, d), 1, "n", "qty")
    return out.select("ticker", "date", R6("price"), "n", R6("qty"))


def lead_join_same_day(spark, d):
    out = S.lead_join(T.prices(spark, d).select("ticker", "date", "price"), T.shipments(spark, d), 0, "n")
    return out.select("ticker", "date", "n")


def same_day_return(spark, d):
    return S.same_day_return(T.prices(spark, d)).select("ticker", "date", R6("ret"))


def forward_return(spark, d):
    return S.forward_return(T.prices(spark, d), 2).select("ticker", "date", R6("ret"))


def trailing_median(spark, d):
    return S.trailing_median(S.same_day_return(T.prices(spark, d))).select("ticker", "date", R6("median"))


def assign_splits(spark, d):
    p = T.prices(spark, d).select("ticker", "date")
    return S.assign_splits(p, S.split_bounds(p)).groupBy("split").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


def market_excess(spark, d):
    p = T.prices(spark, d)
    market = S.same_day_return(T.table(spark, d, "orders").groupBy(F.lit("ALL").alias("ticker"), F.to_date("o_orderdate").alias("date")).agg(F.max_by("o_totalprice", "o_orderkey").alias("price")))
    return S.market_excess(S.same_day_return(p), market).select("ticker", "date", R6("ret"), R6("market"), R6("excess"))


def news_days(spark, d):
    return T.dated_articles(spark, d).groupBy("ticker", "date").agg(F.count("*").alias("event_count"))


def news_in_window(spark, d):
    t = T.tasks(spark, d).select("task_id", "ticker", F.col("cutoff_date").alias("date"))
    return S.window_sum(t, news_days(spark, d), 1, "event_count", "news").select("task_id", "news")


def decayed_news(spark, d):
    t = T.tasks(spark, d).select("ticker", F.col("cutoff_date").alias("date"))
    return S.decayed_window_sum(t, news_days(spark, d), 5, "event_count", 0.3).select("ticker", "date", R6("total"))


def date_span(spark, d):
    return T.dated_articles(spark, d).groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"))


def universe(spark, d):
    n = T.dated_articles(spark, d).groupBy("ticker").agg(F.count_distinct("date").alias("days")).where("days >= 3")
    known = T.table(spark, d, "companies").select(F.upper(F.trim("ticker")).alias("ticker")).distinct()
    return n.join(known, "ticker", "left_semi")


def in_bounds_tasks(spark, d):
    spans = date_span(spark, d)
    return T.tasks(spark, d).join(spans, "ticker").where("cutoff_date between first and last").select("task_id", "ticker", "cutoff_date")


def return_sanity(spark, d):
    t = T.tasks(spark, d)
    return t.where("label_return is not null and not isnan(label_return) and abs(raw_return) <= 0.25").select("task_id", R6("label_return"), R6("raw_return"))


def load_tasks(spark, d):
    t = T.tasks(spark, d).where("split in ('train', 'val', 'test') and horizon_trading_days = 1 and cutoff_date is not null")
    return t.select("task_id", "ticker", "cutoff_date", "split", (F.col("label_return") > 0.01).cast("int").alias("direction"))


def train_count_filter(spark, d):
    t = T.tasks(spark, d)
    enough = t.where("split = 'train'").groupBy("ticker").agg(F.count("*").alias("n")).where("n >= 150").select("ticker", F.lit(True).alias("ok"))
    return t.join(enough, "ticker", "left").where("split = 'train' or ok").groupBy("ticker", "split").agg(F.count("*").alias("n"))


def split_counts(spark, d):
    t = T.tasks(spark, d)
    return t.groupBy("split").agg(
        F.count("*").alias("n"), F.min("cutoff_date").alias("first"), F.max("cutoff_date").alias("last"), F.count_distinct("ticker").alias("tickers"), F.round(F.avg(F.col("label_direction").cast("double")), 6).alias("positive")
    )


def split_boundaries(spark, d):
    t = T.tasks(spark, d).groupBy("split").agg(F.min("cutoff_date").alias("first"), F.max("cutoff_date").alias("last"))
    w = W.orderBy("last")
    return t.select("split", "last", F.coalesce(F.col("first") > F.lag("last").over(w), F.lit(True)).alias("ordered"))


def task_numbering(spark, d):
    p = T.prices(spark, d).select("ticker", "date")
    n = S.ranked(p, "date", "ticker")
    return n.select("ticker", "date", F.concat(F.lit("TASK_"), F.lpad(F.col("i").cast("string"), 8, "0")).alias("task_id"))


def forecast_tasks_build(spark, d):
    p = T.prices(spark, d)
    usable = S.usable_prices(p.withColumnRenamed("price", "close"))
    returns = S.same_day_return(usable)
    market = S.same_day_return(T.table(spark, d, "orders").groupBy(F.lit("ALL").alias("ticker"), F.to_date("o_orderdate").alias("date")).agg(F.max_by("o_totalprice", "o_orderkey").alias("price")))
    excess = S.market_excess(returns, market).where("abs(ret) <= 0.25")
    median = S.trailing_median(returns)
    news = S.window_sum(excess, T.shipments(spark, d), 1, "n", "news").where("news > 0")
    rows = news.join(median, ["ticker", "date"])
    done = S.assign_splits(rows, S.split_bounds(rows))
    return done.select("ticker", "date", R6("ret"), R6("excess"), R6("median"), F.col("news").cast("long").alias("news"), (F.col("excess") > 0).cast("int").alias("direction"), "split")


def scan_prices_label(spark, d):
    p = T.prices(spark, d).select("ticker", "date", (F.col("price") - 150000).alias("adj"), F.col("price").alias("close"))
    return S.usable_prices(p, "adj").select("ticker", "date", R6("price"))


def price_projection(spark, d):
    return T.prices(spark, d).select("date", "open", "high", "low", F.col("price").alias("adj_close"), "volume", F.col("price").alias("close"))


def splice_repair(spark, d):
    p = T.prices(spark, d).select("ticker", "date", "price", "volume")
    return S.splice_repaired(p, S.splice_factors(p, FIRST, BREAK), BREAK).select("ticker", "date", R6("price"), R6("volume"))


def sentiment_decay(spark, d):
    """Scores of all articles with a title, carried on over the days on which tasks ask for them."""
    a = T.table(spark, d, "articles").where(F.col("article_id").isNotNull() & F.col("_title").isNotNull() & F.col("_date").isNotNull() & (X.ticker_plain("_ticker") != ""))
    a = a.select("article_id", X.ticker_plain("_ticker").alias("ticker"), F.to_date("_date").alias("date"), (F.length("_title") % 5 + 1).cast("double").alias("score")).distinct()
    scores = a.groupBy("ticker", "date").agg(F.avg("score").alias("score"))
    dates = T.tasks(spark, d).select("ticker", F.col("cutoff_date").alias("date")).distinct()
    return S.decay_to_neutral(dates, scores).select("ticker", "date", R6("score"))


def weighted_vector_pool(spark, d):
    v = T.vectors(spark, d)
    return V.pooled(v, "v", F.exp(-(F.col("id") % 7) / F.lit(3.0)), "grp").select("grp", "pos", R6("x"))


def zscore_train(spark, d):
    v = T.vectors(spark, d)
    return V.zscored(v, "v", F.col("id") % 10 < 7, "id").select("id", "pos", R6("x"))


def unit_chunk_mean(spark, d):
    v = V.packed(V.pooled(T.vectors(spark, d), "v", F.lit(1.0), "grp"), "grp", name="v")
    return V.elements(v.select("grp", V.unit(F.col("v")).alias("v")), "v", "grp").select("grp", "pos", R6("x"))


def vector_prefix_roundtrip(spark, d):
    w = V.wide(T.vectors(spark, d).select("id", V.fit_dim(F.col("v"), 16).alias("v")), "v", "gnn", 16)
    n = V.narrow(w, "gnn", "v")
    return n.select("id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def series_vector_join(spark, d):
    p, n = T.prices(spark, d), T.shipments(spark, d)
    first = n.groupBy("ticker").agg(F.min("date").alias("first"))
    return p.join(first, "ticker").where("date >= first").join(n.select("ticker", "date", "qty"), ["ticker", "date"], "left").select("ticker", "date", R6("price"), F.round(F.coalesce("qty", F.lit(0.0)), 6).alias("qty"))


def sliding_windows(spark, d):
    x = S.sliding_windows(T.prices(spark, d), 8, 3)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, v: s + v), 4)
    return x.select("ticker", "start", total("x").alias("x"), total("y").alias("y"))


def strided_windows(spark, d):
    x = S.sliding_windows(T.prices(spark, d), 10, 0, 5)
    return x.select("ticker", "start", F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 4).alias("x"))


def window_copy_target(spark, d):
    """Each window's last price and the one before it, as the two copying forecasts of the last row inside it."""
    x = S.sliding_windows(T.prices(spark, d), 6)
    return x.select("ticker", "start", F.element_at("x", 6).alias("target"), F.element_at("x", 5).alias("previous"))


def forecast_samples(spark, d):
    p = T.prices(spark, d)
    s = S.minmax_scaled(p, F.col("date") < F.lit("2000-01-01").cast("date"))
    x = S.sliding_windows(s, 5, 3).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return x.select("ticker", F.col("start").alias("sample"), "step", F.round(F.element_at("x", 5), 6).alias("pred"), F.round(F.expr("element_at(y, step)"), 6).alias("true"))


def instance_norm(spark, d):
    x = S.instance_normed(S.sliding_windows(T.prices(spark, d), 8))
    return x.select("ticker", "start", F.round("mean", 4).alias("mean"), F.round("scale", 4).alias("scale"), F.round(F.element_at("x", 8), 5).alias("last"))


def minmax_series(spark, d):
    return S.minmax_scaled(T.prices(spark, d)).select("ticker", "date", R6("price"))


def random_walk(spark, d):
    return S.random_walk(T.prices(spark, d), 3).select("ticker", "date", "step", R6("true"), R6("pred"))


def split_summary(spark, d):
    p = T.prices(spark, d)
    r = p.withColumn("lr", F.log(F.col("price") / F.lag("price").over(S.by_entity())))
    s = S.assign_splits(r, S.split_bounds(p))
    return s.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("mean"), F.round(F.min("price"), 4).alias("least"), F.round(F.max("price"), 4).alias("most"), R6_of(F.avg("lr"), "log_mean"), R6_of(F.stddev_pop("lr"), "log_sd"), F.round(F.avg((F.col("lr") > 0).cast("double")), 6).alias("rising"))


def R6_of(c, name):
    return F.round(c, 6).alias(name)


def calendar_marks(spark, d):
    e = T.table(spark, d, "events")
    return e.select("event_id", F.month("ts").alias("m"), F.dayofmonth("ts").alias("dd"), F.weekday("ts").alias("wd"), F.hour("ts").alias("h"), F.floor(F.minute("ts") / 15).cast("int").alias("q"))


def last_insample(spark, d):
    p = T.dated_articles(spark, d).groupBy("ticker", "date").agg(F.count("*").cast("double").alias("price"))
    x = S.last_values(p, 12)
    return x.select("ticker", F.expr("aggregate(vals, 0D, (s, v) -> s * 2 + v)").alias("code"), F.expr("aggregate(mask, 0, (s, v) -> s + v)").alias("own"))


def anomaly_adjustment(spark, d):
    p = T.prices(spark, d).select("ticker", "date", (F.col("price") > 150000).cast("int").alias("label"), (F.col("volume") % 2).cast("int").alias("pred"))
    return S.adjusted_detection(p)


def lead_parity(spark, d):
    """Row i of the join without a lead beside row i - 1 of the join with one: the rows where they differ."""
    p, v = T.prices(spark, d).select("ticker", "date"), T.shipments(spark, d)
    a = S.lead_join(p, v, 0, "n").withColumn("i", F.row_number().over(S.by_entity()))
    b = S.lead_join(p, v, 1, "n").withColumn("i", F.row_number().over(S.by_entity()) + 1)
    return a.select("ticker", "i", "n").join(b.select("ticker", "i", F.col("n").alias("m")), ["ticker", "i"]).agg(F.count("*").alias("rows"), F.count_if(F.col("n") != F.col("m")).alias("differ"))


_NAMES = """lead_join lead_join_same_day same_day_return forward_return trailing_median assign_splits market_excess news_days news_in_window decayed_news date_span universe in_bounds_tasks
return_sanity load_tasks train_count_filter split_counts split_boundaries task_numbering forecast_tasks_build scan_prices_label price_projection splice_repair sentiment_decay weighted_vector_pool
zscore_train unit_chunk_mean vector_prefix_roundtrip series_vector_join sliding_windows strided_windows window_copy_target forecast_samples instance_norm minmax_series random_walk split_summary
calendar_marks last_insample anomaly_adjustment lead_parity""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_LEAD = lambda k: f"""bounds AS (SELECT min(date) AS lo, max(date) AS hi FROM shipments),
led AS (SELECT p.*, {'lead(date, %d) OVER (PARTITION BY ticker ORDER BY date)' % k if k else 'date'} AS at FROM prices p, bounds WHERE date BETWEEN lo AND hi)"""  # noqa: E731
_RET = "rets AS (SELECT ticker, date, price / prev - 1 AS ret FROM (SELECT ticker, date, price, lag(price) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM prices) WHERE prev > 0)"
_MARKET = """market AS (SELECT date, price / lag(price) OVER (ORDER BY date) - 1 AS ret FROM (SELECT CAST(o_orderdate AS DATE) AS date, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1))"""
_EXCESS = "excess AS (SELECT r.ticker, r.date, r.ret, coalesce(m.ret, 0) AS market, r.ret - coalesce(m.ret, 0) AS excess FROM rets r LEFT JOIN market m USING (date))"
_MEDIAN = """med AS (SELECT ticker, date, CASE WHEN count(*) OVER w >= 20 THEN median(abs(ret)) OVER w END AS median FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""
_SPLIT = lambda t: f"""days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM {t})),
ends AS (SELECT max(CASE WHEN i = greatest(0, CAST(floor(n * 0.7::DOUBLE) AS BIGINT) - 1) THEN date END) AS te, max(CASE WHEN i = greatest(0, CAST(floor(n * (0.7::DOUBLE + 0.1::DOUBLE)) AS BIGINT) - 1) THEN date END) AS ve FROM days)"""  # noqa: E731
_CASE = "CASE WHEN date <= te THEN 'train' WHEN date <= ve THEN 'val' ELSE 'test' END"
_NEWS = "news AS (SELECT ticker, date, count(*) AS event_count FROM arts GROUP BY 1, 2)"
P = T.PRICES
ORACLE = {
    "lead_join": f"WITH {P}, {T.SHIPMENTS}, {_LEAD(1)} SELECT l.ticker, l.date, round(l.price, 6) AS price, coalesce(s.n, 0) AS n, round(coalesce(s.qty, 0), 6) AS qty FROM led l LEFT JOIN shipments s ON s.ticker = l.ticker AND s.date = l.at",
    "lead_join_same_day": f"WITH {P}, {T.SHIPMENTS}, {_LEAD(0)} SELECT l.ticker, l.date, coalesce(s.n, 0) AS n FROM led l LEFT JOIN shipments s ON s.ticker = l.ticker AND s.date = l.at",
    "same_day_return": f"WITH {P}, {_RET} SELECT ticker, date, round(ret, 6) AS ret FROM rets",
    "forward_return": f"WITH {P} SELECT ticker, date, round(ahead / price - 1, 6) AS ret FROM (SELECT *, lead(price, 2) OVER (PARTITION BY ticker ORDER BY date) AS ahead FROM prices) WHERE ahead IS NOT NULL",
    "trailing_median": f"WITH {P}, {_RET}, {_MEDIAN} SELECT ticker, date, round(median, 6) AS median FROM med",
    "assign_splits": f"WITH {P}, {_SPLIT('prices')} SELECT {_CASE} AS split, count(*) AS n, min(date) AS first, max(date) AS last FROM prices, ends GROUP BY 1",
    "market_excess": f"WITH {P}, {_RET}, {_MARKET}, {_EXCESS} SELECT ticker, date, round(ret, 6) AS ret, round(market, 6) AS market, round(excess, 6) AS excess FROM excess",
    "news_days": f"WITH {T.DATED_ARTICLES}, {_NEWS} SELECT * FROM news",
    "news_in_window": f"WITH {T.DATED_ARTICLES}, {_NEWS}, {T.TASKS} SELECT t.task_id, CAST(coalesce(sum(n.event_count), 0) AS BIGINT) AS news FROM tasks t LEFT JOIN news n ON n.ticker = t.ticker AND n.date BETWEEN t.cutoff_date - 1 AND t.cutoff_date GROUP BY t.task_id, t.ticker, t.cutoff_date",
    "decayed_news": f"WITH {T.DATED_ARTICLES}, {_NEWS} SELECT t.ticker, t.cutoff_date AS date, round(sum(n.event_count * exp(-0.3 * (t.cutoff_date - n.date))), 6) AS total FROM (SELECT DISTINCT ticker, cutoff_date FROM forecast_tasks) t JOIN news n ON n.ticker = t.ticker AND n.date BETWEEN t.cutoff_date - 5 AND t.cutoff_date GROUP BY 1, 2",
    "date_span": f"WITH {T.DATED_ARTICLES} SELECT ticker, min(date) AS first, max(date) AS last FROM arts GROUP BY 1",
    "universe": f"WITH {T.DATED_ARTICLES} SELECT ticker, count(DISTINCT date) AS days FROM arts WHERE ticker IN (SELECT upper(trim(ticker)) FROM companies) GROUP BY 1 HAVING count(DISTINCT date) >= 3",
    "in_bounds_tasks": f"WITH {T.DATED_ARTICLES}, {T.TASKS}, span AS (SELECT ticker, min(date) AS a, max(date) AS b FROM arts GROUP BY 1) SELECT task_id, ticker, cutoff_date FROM tasks JOIN span USING (ticker) WHERE cutoff_date BETWEEN a AND b",
    "return_sanity": f"WITH {T.TASKS} SELECT task_id, round(label_return, 6) AS label_return, round(raw_return, 6) AS raw_return FROM tasks WHERE label_return IS NOT NULL AND NOT isnan(label_return) AND abs(raw_return) <= 0.25",
    "load_tasks": f"WITH {T.TASKS} SELECT task_id, ticker, cutoff_date, split, CAST(label_return > 0.01 AS INT) AS direction FROM tasks WHERE split IN ('train', 'val', 'test') AND horizon_trading_days = 1 AND cutoff_date IS NOT NULL",
    "train_count_filter": f"WITH {T.TASKS} SELECT ticker, split, count(*) AS n FROM tasks t WHERE split = 'train' OR (SELECT count(*) FROM tasks u WHERE u.ticker = t.ticker AND u.split = 'train') >= 150 GROUP BY 1, 2",
    "split_counts": f"WITH {T.TASKS} SELECT split, count(*) AS n, min(cutoff_date) AS first, max(cutoff_date) AS last, count(DISTINCT ticker) AS tickers, round(avg(CAST(label_direction AS DOUBLE)), 6) AS positive FROM tasks GROUP BY 1",
    "split_boundaries": f"WITH {T.TASKS}, s AS (SELECT split, min(cutoff_date) AS first, max(cutoff_date) AS last FROM tasks GROUP BY 1) SELECT split, last, coalesce(first > lag(last) OVER (ORDER BY last), true) AS ordered FROM s",
    "task_numbering": f"WITH {P} SELECT ticker, date, 'TASK_' || lpad(CAST(row_number() OVER (ORDER BY date, ticker) - 1 AS VARCHAR), 8, '0') AS task_id FROM prices",
    "forecast_tasks_build": f"""WITH {P}, {T.SHIPMENTS}, {_RET}, {_MARKET}, {_EXCESS}, {_MEDIAN},
kept AS (SELECT e.ticker, e.date, e.ret, e.excess, m.median, sum(s.n) AS news FROM excess e JOIN med m USING (ticker, date) JOIN shipments s ON s.ticker = e.ticker AND s.date BETWEEN e.date - 1 AND e.date WHERE abs(e.ret) <= 0.25 GROUP BY ALL),
{_SPLIT('kept')} SELECT ticker, date, round(ret, 6) AS ret, round(excess, 6) AS excess, round(median, 6) AS median, CAST(news AS BIGINT) AS news, CAST(excess > 0 AS INT) AS direction, {_CASE} AS split FROM kept, ends""",
    "scan_prices_label": f"WITH {P} SELECT ticker, date, round(CASE WHEN price - 150000 > 0 THEN price - 150000 ELSE price END, 6) AS price FROM prices",
    "price_projection": f"WITH {P} SELECT date, open, high, low, price AS adj_close, volume, price AS close FROM prices",
    "splice_repair": f"""WITH {P}, two AS (SELECT ticker, max(CASE WHEN date = DATE '{FIRST}' THEN price END) AS v0, max(CASE WHEN date = DATE '{BREAK}' THEN price END) AS v1 FROM prices GROUP BY 1),
r AS (SELECT ticker, v1 / v0 AS q, v1 / v0 - 1 AS r FROM two WHERE v0 IS NOT NULL AND v1 IS NOT NULL),
f AS (SELECT ticker, q / (1 + CASE WHEN abs(r) > 0.1 THEN (SELECT median(r) FROM r) ELSE r END) AS k FROM r)
SELECT p.ticker, p.date, round(CASE WHEN p.date < DATE '{BREAK}' AND abs(k - 1) >= 1e-6 THEN price * k ELSE price END, 6) AS price, round(CASE WHEN p.date < DATE '{BREAK}' AND abs(k - 1) >= 1e-6 THEN volume / k ELSE CAST(volume AS DOUBLE) END, 6) AS volume FROM prices p LEFT JOIN f USING (ticker)""",
    "sentiment_decay": rf"""WITH sc AS (SELECT ticker, date, avg(score) AS score FROM (SELECT DISTINCT article_id, upper(trim(regexp_replace(_ticker, '[\s\x{{A0}}]+', ' ', 'g'))) AS ticker, CAST(_date AS DATE) AS date, CAST(length(_title) % 5 + 1 AS DOUBLE) AS score
  FROM articles WHERE article_id IS NOT NULL AND _title IS NOT NULL AND _date IS NOT NULL AND trim(regexp_replace(coalesce(_ticker, ''), '[\s\x{{A0}}]+', ' ', 'g')) <> '') GROUP BY 1, 2),
l AS (SELECT ticker, max(date) AS last, arg_max(score, date) AS ls FROM sc GROUP BY 1), dd AS (SELECT DISTINCT ticker, cutoff_date AS date FROM forecast_tasks)
SELECT dd.ticker, dd.date, round(coalesce(sc.score, 3 + (ls - 3) * exp(-0.03 * sum(CAST(dd.date > last AS INT)) OVER (PARTITION BY dd.ticker ORDER BY dd.date))), 6) AS score FROM dd JOIN l USING (ticker) LEFT JOIN sc ON sc.ticker = dd.ticker AND sc.date = dd.date""",
    "weighted_vector_pool": f"WITH {T.VECTORS}, e AS (SELECT grp, exp(-(id % 7) / 3.0) AS w, unnest(v) AS x, unnest(range(0, len(v))) AS pos FROM vecs) SELECT grp, CAST(pos AS INT) AS pos, round(sum(w * x) / sum(w), 6) AS x FROM e GROUP BY 1, 2",
    "zscore_train": f"WITH {T.VECTORS}, e AS (SELECT id, unnest(v) AS x, unnest(range(0, len(v))) AS pos FROM vecs), s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM e WHERE id % 10 < 7 GROUP BY 1) SELECT id, CAST(pos AS INT) AS pos, round((x - m) / CASE WHEN s < 1e-8 THEN 1 ELSE s END, 6) AS x FROM e JOIN s USING (pos)",
    "unit_chunk_mean": f"WITH {T.VECTORS}, e AS (SELECT grp, unnest(v) AS x, unnest(range(0, len(v))) AS pos FROM vecs), m AS (SELECT grp, pos, avg(x) AS x FROM e GROUP BY 1, 2) SELECT grp, CAST(pos AS INT) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY grp)), 6) AS x FROM m",
    "vector_prefix_roundtrip": f"WITH {T.VECTORS} SELECT id, 16 AS dim, round(list_sum(v[1:16]), 6) AS total FROM vecs",
    "series_vector_join": f"WITH {P}, {T.SHIPMENTS}, f AS (SELECT ticker, min(date) AS first FROM shipments GROUP BY 1) SELECT p.ticker, p.date, round(p.price, 6) AS price, round(coalesce(s.qty, 0), 6) AS qty FROM prices p JOIN f USING (ticker) LEFT JOIN shipments s ON s.ticker = p.ticker AND s.date = p.date WHERE p.date >= first",
    "sliding_windows": f"WITH {P} SELECT ticker, start, round(x, 4) AS x, round(y, 4) AS y FROM (SELECT ticker, row_number() OVER w - 1 AS start, sum(price) OVER (w ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS x, sum(price) OVER (w ROWS BETWEEN 8 FOLLOWING AND 10 FOLLOWING) AS y, lead(price, 10) OVER w AS e FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE e IS NOT NULL",
    "strided_windows": f"WITH {P} SELECT ticker, start, round(x, 4) AS x FROM (SELECT ticker, row_number() OVER w - 1 AS start, sum(price) OVER (w ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS x, lead(price, 9) OVER w AS e FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE e IS NOT NULL AND start % 5 = 0",
    "window_copy_target": f"WITH {P} SELECT ticker, start, target, previous FROM (SELECT ticker, row_number() OVER w - 1 AS start, lead(price, 5) OVER w AS target, lead(price, 4) OVER w AS previous FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE target IS NOT NULL",
    "forecast_samples": f"""WITH {P}, m AS (SELECT ticker, min(price) AS lo, max(price) AS hi FROM prices WHERE date < DATE '2000-01-01' GROUP BY 1),
s AS (SELECT ticker, date, (price - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END AS price FROM prices JOIN m USING (ticker)),
w AS (SELECT ticker, row_number() OVER w - 1 AS sample, lead(price, 4) OVER w AS pred, [lead(price, 5) OVER w, lead(price, 6) OVER w, lead(price, 7) OVER w] AS y FROM s WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT ticker, sample, step, round(pred, 6) AS pred, round(y[step], 6) AS true FROM (SELECT *, unnest([1, 2, 3])::INT AS step FROM w WHERE y[3] IS NOT NULL)""",
    "instance_norm": f"WITH {P}, w AS (SELECT ticker, row_number() OVER w - 1 AS start, avg(price) OVER f AS mean, sqrt(var_pop(price) OVER f + 1e-5) AS scale, lead(price, 7) OVER w AS l FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date), f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) SELECT ticker, start, round(mean, 4) AS mean, round(scale, 4) AS scale, round((l - mean) / scale, 5) AS last FROM w WHERE l IS NOT NULL",
    "minmax_series": f"WITH {P} SELECT ticker, date, round((price - min(price) OVER w) / CASE WHEN max(price) OVER w = min(price) OVER w THEN 1 ELSE max(price) OVER w - min(price) OVER w END, 6) AS price FROM prices WINDOW w AS (PARTITION BY ticker)",
    "random_walk": f"WITH {P}, w AS (SELECT ticker, date, price, [lead(price, 1) OVER w, lead(price, 2) OVER w, lead(price, 3) OVER w] AS y FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)) SELECT ticker, date, step, round(y[step], 6) AS true, round(price, 6) AS pred FROM (SELECT *, unnest([1, 2, 3])::INT AS step FROM w WHERE y[3] IS NOT NULL)",
    "split_summary": f"WITH {P}, {_SPLIT('prices')}, r AS (SELECT *, ln(price / lag(price) OVER (PARTITION BY ticker ORDER BY date)) AS lr FROM prices) SELECT {_CASE} AS split, count(*) AS n, round(avg(price), 4) AS mean, round(min(price), 4) AS least, round(max(price), 4) AS most, round(avg(lr), 6) AS log_mean, round(stddev_pop(lr), 6) AS log_sd, round(avg(CAST(lr > 0 AS DOUBLE)), 6) AS rising FROM r, ends GROUP BY 1",
    "calendar_marks": "SELECT event_id, CAST(month(ts) AS INT) AS m, CAST(day(ts) AS INT) AS dd, CAST(isodow(ts) - 1 AS INT) AS wd, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) // 15 AS INT) AS q FROM events",
    "last_insample": f"WITH {T.DATED_ARTICLES}, s AS (SELECT ticker, date, count(*)::DOUBLE AS c, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) - 1 AS r FROM arts GROUP BY 1, 2) SELECT ticker, sum(c * pow(2, r)) AS code, CAST(count(*) AS INT) AS own FROM s WHERE r < 12 GROUP BY 1",
    "anomaly_adjustment": f"""WITH {P}, l AS (SELECT ticker, date, CAST(price > 150000 AS INT) AS label, CAST(volume % 2 AS INT) AS pred FROM prices),
c AS (SELECT *, CAST(label <> lag(label, 1, 0) OVER (PARTITION BY ticker ORDER BY date) AS INT) AS ch FROM l), i AS (SELECT *, sum(ch) OVER (PARTITION BY ticker ORDER BY date) AS isl FROM c)
SELECT ticker, date, CASE WHEN label = 1 THEN max(pred) OVER (PARTITION BY ticker, isl) ELSE pred END AS pred FROM i""",
    "lead_parity": f"""WITH {P}, {T.SHIPMENTS}, bounds AS (SELECT min(date) AS lo, max(date) AS hi FROM shipments), led AS (SELECT ticker, date, lead(date) OVER w AS at, row_number() OVER w AS i FROM prices, bounds WHERE date BETWEEN lo AND hi WINDOW w AS (PARTITION BY ticker ORDER BY date)),
a AS (SELECT led.ticker, i, coalesce(s.n, 0) AS n FROM led LEFT JOIN shipments s ON s.ticker = led.ticker AND s.date = led.date), b AS (SELECT led.ticker, i + 1 AS i, coalesce(s.n, 0) AS m FROM led LEFT JOIN shipments s ON s.ticker = led.ticker AND s.date = led.at)
SELECT count(*) AS rows, count(*) FILTER (n <> m) AS differ FROM a JOIN b USING (ticker, i)""",
}
