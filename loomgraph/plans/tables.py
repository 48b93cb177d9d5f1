"""Test tables as the shapes that operators take, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import direction_signature, event_type, metric_values, ticker_plain, ticker_symbol


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def prices(spark: SparkSession, d: str) -> DataFrame:
    """ticker, date, open, high, low, price, volume: daily order totals of each nation."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    joined = o.join(c, o.o_custkey == c.c_custkey).select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("ticker"), F.to_date("o_orderdate").alias("date"), "o_totalprice", "o_orderkey")
    return joined.groupBy("ticker", "date").agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("price"), F.count("*").alias("volume"),
    )


PRICES = """prices AS (
  SELECT 'N' || c_nationkey AS ticker, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
         arg_max(o_totalprice, o_orderkey) AS price, count(*) AS volume
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def shipments(spark: SparkSession, d: str) -> DataFrame:
    """ticker, date, n, qty: shipped lines of each supplier nation per day."""
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    joined = li.join(s, li.l_suppkey == s.s_suppkey)
    return joined.groupBy(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(F.count("*").cast("double").alias("n"), F.sum("l_quantity").alias("qty"))


SHIPMENTS = """shipments AS (
  SELECT 'N' || s_nationkey AS ticker, CAST(l_shipdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS n, sum(l_quantity) AS qty
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def articles(spark: SparkSession, d: str) -> DataFrame:
    """article_id, source_row, ticker, date, title, body, url of the articles with ticker, date and body, each once.

    Ids are keys, so repeated rows are told by them alone, and a query reads and shuffles only the columns it uses.
    """
    a = table(spark, d, "articles").where(F.col("article_id").isNotNull() & F.col("_date").isNotNull() & F.col("_article").isNotNull() & (ticker_plain("_ticker") != ""))
    one = a.dropDuplicates(["article_id"])
    return one.select("article_id", F.col("_source_row").alias("source_row"), ticker_plain("_ticker").alias("ticker"), F.to_date("_date").alias("date"), F.col("_title").alias("title"), F.col("_article").alias("body"), F.col("_url").alias("url"))


def dated_articles(spark: SparkSession, d: str) -> DataFrame:
    """article_id, ticker, date of the articles with a ticker and a date, each once; no texts are read."""
    a = table(spark, d, "articles").where(F.col("article_id").isNotNull() & F.col("_date").isNotNull() & (ticker_plain("_ticker") != ""))
    return a.select("article_id", ticker_plain("_ticker").alias("ticker"), F.to_date("_date").alias("date")).distinct()


DATED_ARTICLES = r"""arts AS (
  SELECT DISTINCT article_id, upper(trim(regexp_replace(_ticker, '[\s\x{A0}]+', ' ', 'g'))) AS ticker, CAST(_date AS DATE) AS date
  FROM articles WHERE article_id IS NOT NULL AND trim(regexp_replace(coalesce(_ticker, ''), '[\s\x{A0}]+', ' ', 'g')) <> '' AND _date IS NOT NULL)"""
ARTICLES = r"""arts AS (
  SELECT article_id, _source_row AS source_row, upper(trim(regexp_replace(coalesce(_ticker, ''), '[\s\x{A0}]+', ' ', 'g'))) AS ticker, CAST(_date AS DATE) AS date, _title AS title, _article AS body, _url AS url
  FROM (SELECT DISTINCT * FROM articles)
  WHERE article_id IS NOT NULL AND trim(regexp_replace(coalesce(_ticker, ''), '[\s\x{A0}]+', ' ', 'g')) <> '' AND _date IS NOT NULL AND _article IS NOT NULL)"""


def tasks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "forecast_tasks").distinct()


TASKS = "tasks AS (SELECT DISTINCT * FROM forecast_tasks)"


def events(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in event table: ids, ticker, type, dates, importance, confidence and figures (those of props, its only text) of the events stream."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    day = F.to_date("ts")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit("ART_"), F.col("event_id").cast("string")).alias("article_id"),
        F.concat(F.lit("U"), (F.col("user_id") % 20).cast("string")).alias("ticker"), "event_type", day.alias("available_date"),
        F.date_add(day, k % 21 - 10).alias("event_date_start"), F.date_add(day, k % 21 - 10 + k % 3).alias("event_date_end"),
        (1 + k % 3).alias("importance"), F.least(F.lit(1.0), F.col("value") / 500).alias("confidence"), F.when(F.col("event_type").isin("purchase", "signup"), 1.0).when(F.col("event_type") == "error", -1.0).otherwise(0.1).alias("impact"),
        metric_values("props").alias("metrics"),
    )


EVENTS = """ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, 'ART_' || event_id AS article_id, 'U' || (user_id % 20) AS ticker, event_type, CAST(ts AS DATE) AS available_date,
         CAST(ts AS DATE) + (k % 21 - 10) AS event_date_start, CAST(ts AS DATE) + (k % 21 - 10 + k % 3) AS event_date_end, 1 + k % 3 AS importance, least(1.0, value / 500) AS confidence,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 1.0::DOUBLE WHEN event_type = 'error' THEN -1.0::DOUBLE ELSE 0.1::DOUBLE END AS impact
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def event_articles(spark: SparkSession, d: str) -> DataFrame:
    """event_id, article_id: the first article that reports an event."""
    return table(spark, d, "graph_edges").where("edge_type = 'REPORTS' and target like 'event:%'").groupBy(F.substring("target", 7, 1000).alias("event_id")).agg(F.min("article_id").alias("article_id"))


def graph_events(spark: SparkSession, d: str) -> DataFrame:
    """The events of the graph: event_id, article_id (the first that reports it), ticker, event_type, event_description, date, confidence, importance, metrics, impact.

    Of several rows of one event the one that comes first by name, ticker, date and attributes; what broken attributes say is null.
    """
    n = table(spark, d, "graph_nodes").where("node_type = 'Event' and node_id like 'event:%'")
    row = F.min(F.struct(F.coalesce("name", F.lit("")).alias("name"), ticker_symbol(F.coalesce("ticker", F.lit(""))).alias("ticker"), F.coalesce("date", F.lit("9999-01-01").cast("date")).alias("date"), F.coalesce("attributes_json", F.lit("")).alias("a")))
    told = lambda path, kind: F.try_variant_get(F.try_parse_json("r.a"), path, kind)
    one = n.groupBy(F.substring("node_id", 7, 1000).alias("event_id")).agg(row.alias("r"))
    direction = direction_signature("r.name")
    return one.join(event_articles(spark, d), "event_id", "left").select(
        "event_id", "article_id", "r.ticker", event_type(F.coalesce(told("$.event_type", "string"), F.lit(""))).alias("event_type"), F.col("r.name").alias("event_description"), F.nullif("r.date", F.lit("9999-01-01").cast("date")).alias("date"),
        told("$.confidence", "double").alias("confidence"), told("$.importance_score", "int").alias("importance"), metric_values("r.name").alias("metrics"), F.when(direction == "positive", 1.0).when(direction == "negative", -1.0).otherwise(0.1).alias("impact"),
    )


GRAPH_EVENTS = r"""gev AS (
  SELECT event_id, article_id, r.t AS ticker, coalesce(CASE WHEN ok THEN json_extract_string(r.a, '$.event_type') END, '') AS event_type, r.n AS event_description, nullif(r.d, DATE '9999-01-01') AS date,
         CASE WHEN ok THEN CAST(json_extract_string(r.a, '$.confidence') AS DOUBLE) END AS confidence, CASE WHEN ok THEN CAST(json_extract_string(r.a, '$.importance_score') AS INT) END AS importance,
         list_sort(list_distinct(list_transform(regexp_extract_all(trim(regexp_replace(r.n, '[\s\x{A0}]+', ' ', 'g')), '(?i)[-+]?\$?\d[\d,]*(?:\.\d+)?\s*(?:%|percent|million|billion|trillion|x|times|shares?)?'), lambda x: replace(regexp_replace(lower(x), '[\s,]+', '', 'g'), 'percent', '%')))) AS metrics,
         regexp_matches(lower(r.n), '\b(up|rose|risen|rise|gain|gained|gains|growth|grew|soared|jumped|climbed|increased|higher|bullish|outperform)\b') AS gu,
         regexp_matches(lower(r.n), '\b(down|fell|fall|fallen|decline|declined|loss|lost|off|dropped|plunged|decreased|lower|bearish|underperform)\b') AS gl
  FROM (SELECT event_id, r, json_valid(r.a) AS ok FROM (SELECT substr(node_id, 7) AS event_id, min({'n': coalesce(name, ''), 't': regexp_replace(upper(coalesce(ticker, '')), '[^A-Z0-9.\-]', '', 'g'), 'd': coalesce(date, DATE '9999-01-01'), 'a': coalesce(attributes_json, '')}) AS r
        FROM graph_nodes WHERE node_type = 'Event' AND node_id LIKE 'event:%' GROUP BY 1))
  LEFT JOIN (SELECT substr(target, 7) AS event_id, min(article_id) AS article_id FROM graph_edges WHERE edge_type = 'REPORTS' AND target LIKE 'event:%' GROUP BY 1) USING (event_id))"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """One row per node: of several the one that comes first by type and name."""
    n = table(spark, d, "graph_nodes").where("node_id is not null")
    row = F.min(F.struct("node_type", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("ticker", F.lit("")).alias("ticker"), F.coalesce("date", F.lit("9999-01-01").cast("date")).alias("date")))
    return n.groupBy("node_id").agg(row.alias("r")).select("node_id", "r.node_type", "r.name", "r.ticker", F.nullif("r.date", F.lit("9999-01-01").cast("date")).alias("date"))


NODES = """nodes AS (
  SELECT node_id, r.node_type AS node_type, r.name AS name, r.ticker AS ticker, nullif(r.date, DATE '9999-01-01') AS date
  FROM (SELECT node_id, min({'node_type': node_type, 'name': coalesce(name, ''), 'ticker': coalesce(ticker, ''), 'date': coalesce(date, DATE '9999-01-01')}) AS r FROM graph_nodes WHERE node_id IS NOT NULL GROUP BY node_id))"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """The distinct edges."""
    return table(spark, d, "graph_edges").select("source", "target", "edge_type", "weight", "article_id", "event_id").where("source is not null and target is not null").distinct()


EDGES = "edges AS (SELECT DISTINCT source, target, edge_type, weight, article_id, event_id FROM graph_edges WHERE source IS NOT NULL AND target IS NOT NULL)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


VECTORS = "vecs AS (SELECT vec_id AS id, label AS grp, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
