"""The event graph: producers of nodes and edges, chronology, checks, tensors and numeric kernels.

Edges are ``source, target, edge_type, weight, article_id, event_id``; nodes ``node_id, node_type, name, ticker, date``. Nulls in
an id drop the edge. Kernels combine before the shuffle, so a hot target is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomgraph.operators.series import ranked


def edge(source: Column, target: Column, kind: Column | str, article: Column, event: Column, weight: Column | float = 1.0) -> Column:
    return F.struct(source.alias("source"), target.alias("target"), F.lit(kind).alias("edge_type"), F.lit(weight).alias("weight"), article.alias("article_id"), event.alias("event_id"))


def article_edges(articles: DataFrame) -> DataFrame:
    """ABOUT_TICKER and PUBLISHED_ON edges of articles (article_id, ticker, date)."""
    a = F.concat(F.lit("article:"), "article_id")
    none = F.lit(None).cast("string")
    edges = F.array(
        edge(a, F.concat(F.lit("ticker:"), "ticker"), "ABOUT_TICKER", F.col("article_id"), none),
        edge(a, F.concat(F.lit("date:"), F.col("date").cast("string")), "PUBLISHED_ON", F.col("article_id"), none),
    )
    return articles.select(F.inline(edges)).where("source is not null and target is not null")


def event_edges(events: DataFrame) -> DataFrame:
    """REPORTS, INVOLVES_TICKER, OCCURRED_ON, PERIOD_START, PERIOD_END, AVAILABLE_ON and HAS_TYPE edges, one pass over the events."""
    e = F.concat(F.lit("event:"), F.col("event_id").cast("string"))
    day = lambda c: F.concat(F.lit("date:"), F.col(c).cast("string"))
    own = F.col("event_id").cast("string")
    edges = F.array(
        edge(F.concat(F.lit("article:"), "article_id"), e, "REPORTS", F.col("article_id"), own),
        edge(e, F.concat(F.lit("ticker:"), "ticker"), "INVOLVES_TICKER", F.col("article_id"), own),
        edge(e, day("event_date_start"), "OCCURRED_ON", F.col("article_id"), own),
        edge(e, F.when(F.col("event_date_end") != F.col("event_date_start"), day("event_date_start")), "PERIOD_START", F.col("article_id"), own),
        edge(e, F.when(F.col("event_date_end") != F.col("event_date_start"), day("event_date_end")), "PERIOD_END", F.col("article_id"), own),
        edge(e, day("available_date"), "AVAILABLE_ON", F.col("article_id"), own),
        edge(e, F.concat(F.lit("event_type:"), "event_type"), "HAS_TYPE", F.col("article_id"), own),
    )
    return events.select(F.inline(edges)).where("source is not null and target is not null")


def event_nodes(events: DataFrame) -> DataFrame:
    """node_id, node_type of the events and of all they point at, each once."""
    day = lambda c: F.concat(F.lit("date:"), F.col(c).cast("string"))
    node = lambda i, t: F.struct(i.alias("node_id"), F.lit(t).alias("node_type"))
    nodes = F.array(
        node(F.concat(F.lit("event:"), F.col("event_id").cast("string")), "Event"), node(F.concat(F.lit("ticker:"), "ticker"), "Ticker"),
        *(node(day(c), "Date") for c in ("event_date_start", "event_date_end", "available_date")), node(F.concat(F.lit("event_type:"), "event_type"), "EventType"),
    )
    return events.select(F.inline(nodes)).where("node_id is not null").distinct()


def followers(events: DataFrame, day: str, kind: str) -> DataFrame:
    """Each event of a ticker with the next one by (day, event_id).

    Within a day by a window of the ticker's day, from a day's last event to the first one of the ticker's next day; so the windows over a ticker hold a row a day.
    """
    e = events.where("event_id is not null and ticker is not null").select("ticker", F.coalesce(day, F.lit("0001-01-01").cast("date")).alias("day"), "event_id")
    within = e.withColumn("next", F.lead("event_id").over(W.partitionBy("ticker", "day").orderBy("event_id")))
    days = e.groupBy("ticker", "day").agg(F.min("event_id").alias("first"))
    onward = days.select("ticker", "day", F.lead("first").over(W.partitionBy("ticker").orderBy("day")).alias("first"))
    return within.join(onward, ["ticker", "day"]).select(F.col("event_id").alias("source"), F.coalesce("next", "first").alias("target"), F.lit(kind).alias("edge_type")).where("target is not null")


def chronology_edges(events: DataFrame) -> DataFrame:
    """source, target, edge_type: consecutive events of a ticker by (event_date_start, event_id), and by (available_date, event_id); a missing date counts as the earliest."""
    return followers(events, "event_date_start", "EVENT_PRECEDES").unionByName(followers(events, "available_date", "REPORT_PRECEDES"))


def cluster_chronology(members: DataFrame) -> DataFrame:
    """ticker, source, target: clusters of a ticker in the order in which they first occur (ticker, cluster, date)."""
    first = members.dropna(subset=["ticker", "cluster"]).groupBy("ticker", "cluster").agg(F.min("date").alias("date"))
    w = W.partitionBy("ticker").orderBy("date", "cluster")
    return first.select("ticker", F.col("cluster").alias("source"), F.lead("cluster").over(w).alias("target")).where("target is not null")


def reverse_synthesis(edges: DataFrame) -> DataFrame:
    """source, target, edge_type: the edges and their reversals as REV_ types.

    A type is reversed only where neither it nor its counterpart is a reversal that stands in the table: of A, REV_A and B only B is.
    """
    types = edges.select("edge_type").distinct()
    stripped = types.select(F.regexp_replace("edge_type", "^REV_", "").alias("base"), F.col("edge_type").startswith("REV_").alias("rev"))
    open_types = stripped.groupBy("base").agg(F.bool_or("rev").alias("has")).where("not has").select(F.col("base").alias("edge_type"))
    back = edges.join(F.broadcast(open_types), "edge_type", "left_semi").select(F.col("target").alias("source"), F.col("source").alias("target"), F.concat(F.lit("REV_"), "edge_type").alias("edge_type"))
    return edges.select("source", "target", "edge_type").unionByName(back)


def typed_index(nodes: DataFrame) -> DataFrame:
    """node_id, node_type, idx: dense ids per type from 0 on, by node_id.

    Ranks within a type are sums of counts per range of ids before, plus the rank within the range, so the type with most nodes is
    not sorted in one task.
    """
    ranged = nodes.withColumn("r", F.substring(F.md5(F.col("node_id").cast("binary")), 1, 3))
    w = W.partitionBy("node_type", "r").orderBy("node_id")
    counts = ranged.groupBy("node_type", "r").agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("node_type").orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return ranged.withColumn("i", F.row_number().over(w) - 1).join(before, ["node_type", "r"]).select("node_id", "node_type", (F.col("base") + F.col("i")).alias("idx"))


def typed_edges(edges: DataFrame, index: DataFrame) -> DataFrame:
    """source_type, edge_type, target_type, edges, weight: sizes of the typed edge lists."""
    s = index.select(F.col("node_id").alias("source"), F.col("node_type").alias("source_type"), F.col("idx").alias("s"))
    t = index.select(F.col("node_id").alias("target"), F.col("node_type").alias("target_type"), F.col("idx").alias("t"))
    return edges.join(s, "source").join(t, "target").groupBy("source_type", "edge_type", "target_type").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, target, side of the edges one of whose ends is no node."""
    ids = nodes.select("node_id").distinct()
    miss = lambda c: edges.select("source", "target").join(ids.withColumnRenamed("node_id", c), c, "left_anti").select("source", "target", F.lit(c).alias("side"))
    return miss("source").unionByName(miss("target"))


def dated_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with ``known``: the latest of the known dates of their two ends, null if neither has one."""
    days = nodes.groupBy("node_id").agg(F.min("date").alias("date"))
    return (
        edges.join(days.toDF("source", "ds"), "source", "left").join(days.toDF("target", "dt"), "target", "left")
        .withColumn("known", F.greatest("ds", "dt")).drop("ds", "dt")
    )


def strongest_weight(edges: DataFrame, *keys: str, order: str | None = None) -> DataFrame:
    """keys, weight: the weight of largest magnitude, of equal ones the first by the order column if one is named, then the positive; zeros and nulls are ignored."""
    first = F.struct((-F.abs("weight")).alias("a"), (F.col(order) if order else F.lit(0)).alias("o"), (-F.col("weight")).alias("w"))
    return edges.where("weight <> 0").groupBy(*keys).agg(F.min_by("weight", first).alias("weight"))


def message_passing(edges: DataFrame, features: DataFrame) -> DataFrame:
    """dst, pos, x: weighted sums of the sources' vectors, over the root of the sum of absolute weights (1 at least). features: node, pos, x."""
    scale = edges.groupBy("dst").agg(F.sqrt(F.greatest(F.lit(1.0), F.sum(F.abs("w")))).alias("scale"))
    sums = edges.join(features.withColumnRenamed("node", "src"), "src").groupBy("dst", "pos").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    return sums.join(scale, "dst").select("dst", "pos", (F.col("x") / F.col("scale")).alias("x"))


def segment_softmax(rows: DataFrame, group: str, score: str) -> DataFrame:
    """rows with p: the softmax of the score within its group.

    Maximum and sum are aggregated and joined back rather than taken over a window, so a hot group isn't one task.
    """
    top = rows.groupBy(group).agg(F.max(score).alias("_m"))
    shifted = rows.join(top, group).withColumn("_e", F.exp(F.col(score) - F.col("_m"))).drop("_m")
    sums = shifted.groupBy(group).agg(F.sum("_e").alias("_s"))
    return shifted.join(sums, group).withColumn("p", F.col("_e") / F.greatest("_s", F.lit(1e-12))).drop("_e", "_s")


def block_offsets(sizes: DataFrame, order: str, n: str) -> DataFrame:
    """order, n, first: where each block starts when blocks stand one after the other."""
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return sizes.select(order, n, F.coalesce(F.sum(n).over(w), F.lit(0)).alias("first"))


def shuffled_relations(edges: DataFrame, seed: int) -> DataFrame:
    """source, target, edge_type: the types dealt anew among the edges, their counts unchanged.

    Two orders that have nothing to do with each other, by hashes, each ranked by ranges of its hash; the type of a rank in one goes to the edge of that rank in the other.
    """
    def rank(n: int) -> DataFrame:
        h = F.md5(F.concat_ws("|", "source", "target", "edge_type", F.lit(str(n))).cast("binary"))
        return ranked(edges.withColumn("h", h).withColumn("r", F.substring("h", 1, 3)), "r", "h", "source", "target", "edge_type")

    return rank(seed + 1).select("source", "target", "i").join(rank(seed).select("edge_type", "i"), "i").drop("i")
