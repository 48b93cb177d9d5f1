"""Leakage-free temporal subgraphs: what of the graph is visible to a task at its cutoff.

A dated node is visible to a task if its date lies in [cutoff - days, cutoff]. An edge is visible if both its ends are and the
latest date at which any part of it was known lies there too. Theta joins of tasks with dates are equi-joins on the exploded days, as windows
are short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import vocabulary as V
from loomgraph.scratch import written

DATED = ("Event", "Article")
FUSED = ("EventCluster", "EntityCluster")
MOST_HOT, SALT = 1000, 16
DIRECTIONAL = [*(r for k, r in V.IMPACT_RELATIONS.items() if k != "mentioned"), "RELATED_TO_ANCHOR"]


def visible_nodes(tasks: DataFrame, nodes: DataFrame, days: int) -> DataFrame:
    """task_id, node_id of the dated nodes in each task's window (tasks: task_id, cutoff)."""
    slots = tasks.select("task_id", F.explode(F.sequence(F.date_sub("cutoff", days), F.col("cutoff"))).alias("date"))
    return slots.join(nodes.where("date is not null").select("node_id", "date"), "date").select("task_id", "node_id").distinct()


def about_ticker(edges: DataFrame, anchors: bool = True) -> DataFrame:
    """ticker, node_id, impact: events that are about a ticker or, with ``anchors``, have a directional impact on its company; impact: their strongest weight.

    Of weights of equal size that of the first edge type counts, then the positive one.
    """
    own = edges.where((F.col("edge_type") == "INVOLVES_TICKER") & F.col("target").startswith("ticker:")).select(F.upper(F.substring_index("target", ":", -1)).alias("ticker"), F.col("source").alias("node_id"), F.lit(None).cast("double").alias("weight"), F.lit("").alias("kind"))
    hit = edges.where(F.col("edge_type").isin(DIRECTIONAL) & F.col("target").rlike("^(company_)?ticker:")).select(F.upper(F.substring_index("target", ":", -1)), "source", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), "edge_type")
    rows = own.union(hit) if anchors else own
    strongest = F.min_by("weight", F.when(F.col("weight") != 0, F.struct((-F.abs("weight")).alias("a"), "kind", (-F.col("weight")).alias("w"))))
    return rows.groupBy("ticker", "node_id").agg(F.coalesce(strongest, F.lit(0.0)).alias("impact"))


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, target, edge_type, weight, known, source_day, source_type of the edges: known is the latest date of the edge's event, its article and its dated ends, null without any.

    nodes: node_id, node_type, date; the date of nodes that are neither events nor articles isn't one at which something was known.
    """
    dated = nodes.select("node_id", "node_type", F.when(F.col("node_type").isin(*DATED), F.col("date")).alias("day"))
    days = dated.where("day is not null").select("node_id", "day")
    key = lambda prefix, c: F.concat(F.lit(prefix), F.trim(c))
    ends = edges.join(dated.toDF("source", "source_type", "source_day"), "source").join(dated.toDF("target", "target_type", "target_day"), "target")
    ends = ends.withColumns({"_e": key("event:", "event_id"), "_a": key("article:", "article_id")})
    ends = ends.join(days.toDF("_e", "event_day"), "_e", "left").join(days.toDF("_a", "article_day"), "_a", "left")
    known = F.greatest("source_day", "target_day", "event_day", "article_day")
    return ends.select("source", "target", "edge_type", F.coalesce("weight", F.lit(1.0)).alias("weight"), known.alias("known"), "source_day", "source_type")


def _joined(frontier: DataFrame, edges: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """The frontier with the inbound edges; those of hot targets are spread over ``SALT`` parts by their source."""
    f = frontier.join(F.broadcast(hot), "target", "left").withColumn("salt", F.explode(F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0))))).drop("is_hot")
    e = edges.join(F.broadcast(hot), "target", "left").withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.xxhash64("source"), F.lit(SALT)).cast("int")).otherwise(F.lit(0))).drop("is_hot")
    return f.join(e, [*keys, "salt"])


def task_subgraph(tasks: DataFrame, nodes: DataFrame, edges: DataFrame, days: int = 2, hops: int = 3, scope: str = "target_or_anchor", fused: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """task_id, ticker, cutoff, node_id, hop: inbound breadth-first search from the ticker's node over what is visible; and the known edges.

    tasks: task_id, ticker, cutoff; nodes: node_id, node_type, date; edges: source, target, edge_type, weight, article_id, event_id. Events and articles without a date
    are never visible, other nodes always are but clusters, which are if a visible member (fused: node_id, cluster) points at them. scope: ``all`` events, those about
    the ``target``, or those and the ones with an impact on it (``target_or_anchor``).

    Each hop is an equi-join of the frontier with the inbound edges, on target and day for those with a date and on the target for the others, and a written
    table. Targets with a thousandth of all edges or more, at most ``MOST_HOT``, are salted. Reached nodes are anti-joined away.
    """
    known = written(known_edges(edges, nodes).distinct(), "known")
    total = known.count()
    hot = known.groupBy("target").count().where(F.col("count") * MOST_HOT >= total).select("target", F.lit(True).alias("is_hot"))
    may = known.where(~F.col("source_type").isin(*DATED) | F.col("source_day").isNotNull())
    dated = may.where("known is not null").select("source", "target", F.col("known").alias("day"), "source_day", "source_type").distinct()
    undated = may.where("known is null").select("source", "target", "source_type").distinct()
    wanted = None if scope == "all" else about_ticker(edges, scope == "target_or_anchor").select("ticker", "node_id", F.lit(True).alias("about"))
    own = ["task_id", "ticker", "cutoff"]
    start = tasks.select(*own, F.concat(F.lit("ticker:"), "ticker").alias("node_id")).join(nodes.select("node_id").distinct(), "node_id", "left_semi").select(*own, "node_id")

    def in_scope(rows: DataFrame) -> DataFrame:
        if wanted is None:
            return rows
        return rows.join(wanted.withColumnRenamed("node_id", "source"), ["ticker", "source"], "left").where("source_type <> 'Event' or about").drop("about")

    awake = None
    if fused is not None:
        events = nodes.where("node_type = 'Event' and date is not null").select(F.col("node_id").alias("source"), F.col("date").alias("day"), F.lit("Event").alias("source_type"))
        seen = in_scope(tasks.select(*own, F.explode(F.sequence(F.date_sub("cutoff", days), F.col("cutoff"))).alias("day")).join(events, "day"))
        awake = written(seen.join(fused.toDF("source", "cluster"), "source").select("task_id", F.col("cluster").alias("source"), F.lit(True).alias("awake")).distinct(), "awake")

    frontier = start.withColumn("hop", F.lit(0))
    tables = [frontier]
    for hop in range(1, hops + 1):
        here = frontier.select(*own, F.col("node_id").alias("target"))
        slots = here.withColumn("day", F.explode(F.sequence(F.date_sub("cutoff", days), F.col("cutoff"))))
        found = _joined(slots, dated, ["target", "day"], hot).where("source_day is null or source_day >= date_sub(cutoff, %d)" % days).select(*own, "source", "source_type")
        found = in_scope(found.unionByName(_joined(here, undated, ["target"], hot).select(*own, "source", "source_type")).distinct())
        if awake is not None:
            found = found.join(awake, ["task_id", "source"], "left").where(~F.col("source_type").isin(*FUSED) | F.col("awake"))
        else:
            found = found.where(~F.col("source_type").isin(*FUSED))
        fresh = found.select(*own, F.col("source").alias("node_id")).distinct()
        for t in tables:
            fresh = fresh.join(t.select("task_id", "node_id"), ["task_id", "node_id"], "left_anti")
        frontier = written(fresh.select(*own, "node_id", F.lit(hop).alias("hop")), "hop")
        tables.append(frontier)
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out, known


def window_subgraph(tasks: DataFrame, nodes: DataFrame, edges: DataFrame, days: int = 2, hops: int = 3, scope: str = "target_or_anchor") -> DataFrame:
    """task_id, node_id, hop of ``task_subgraph``."""
    return task_subgraph(tasks, nodes, edges, days, hops, scope)[0].select("task_id", "node_id", "hop")


def subgraph_edges(subgraph: DataFrame, known: DataFrame, days: int = 2, rate: float = 0.1) -> DataFrame:
    """task_id, source, target, edge_type, weight of the visible edges between two nodes of one task's subgraph, the weight decayed by the age of what is known.

    subgraph, known: as ``task_subgraph`` returns them.
    """
    ends = subgraph.select("task_id", "node_id", "cutoff")
    out = ends.withColumnRenamed("node_id", "target").join(known, "target").where(f"known is null or known between date_sub(cutoff, {days}) and cutoff")
    both = out.join(ends.select("task_id", F.col("node_id").alias("source")), ["task_id", "source"], "left_semi")
    return both.select("task_id", "source", "target", "edge_type", decayed_weight(F.col("weight"), F.datediff("cutoff", "known"), rate).alias("weight"))


def decayed_weight(weight: Column, age: Column, rate: float) -> Column:
    """weight * exp(-rate * age), an unknown or negative age as 0."""
    return weight * F.exp(-rate * F.greatest(F.lit(0), F.coalesce(age, F.lit(0))))


FEATURES = [f"f{i}" for i in range(16)]


def temporal_features(rows: DataFrame, window: int = 2, hops: int = 3, tau: float = 30.0) -> DataFrame:
    """task_id, node_id and features f0 ... f15 of the nodes of subgraphs.

    rows: task_id, node_id, cutoff, hop, available, start_date, end_date, time_confidence, confidence, importance, polarity, in_degree,
    impact. A node without a known date, or with a later one, has age 0; without both ends of a period the distance feature is 1 and those of the missing end are 0.
    """
    c = F.col
    w = float(max(1, window))
    clip = lambda x, lo, hi: F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    # Greatest and least pass over nulls, so a missing date is told before.
    years = lambda a, b, lo: F.when(a.isNotNull() & b.isNotNull(), clip(F.datediff(a, b) / 365.0, lo, 5)).otherwise(0.0)
    age = F.greatest(F.lit(0), F.coalesce(F.datediff("cutoff", "available"), F.lit(0)))
    start, end, cut = c("start_date"), c("end_date"), c("cutoff")
    away = F.when(cut < start, F.datediff(start, cut)).when(cut > end, F.datediff(cut, end)).otherwise(0)
    return rows.select(
        "task_id", "node_id",
        F.exp(-age / F.lit(w)).alias("f0"), clip(age / F.lit(w), 0, 10).alias("f1"), years(start, cut, -5).alias("f2"), years(end, cut, -5).alias("f3"), years(end, start, 0).alias("f4"),
        clip(zero(c("time_confidence")), 0, 1).alias("f5"), clip(zero(c("confidence")), 0, 1).alias("f6"), zero(clip(c("importance") / 3.0, 0, 1)).alias("f7"),
        F.coalesce((start > cut).cast("double"), F.lit(0.0)).alias("f8"), c("available").isNotNull().cast("double").alias("f9"), zero(c("polarity")).alias("f10"), (c("hop") == 1).cast("double").alias("f11"),
        clip(c("hop") / float(max(1, hops)), 0, 1).alias("f12"), clip(F.log1p(F.coalesce("in_degree", F.lit(0)).cast("double")) / 5.0, 0, 2).alias("f13"),
        zero(c("impact")).alias("f14"), F.when(start.isNotNull() & end.isNotNull(), F.exp(-away / float(max(1.0, tau)))).otherwise(1.0).alias("f15"),
    )


def cluster_features(features: DataFrame, fused: DataFrame) -> DataFrame:
    """The features, those of clusters replaced by the mean of their members' in the same subgraph (fused: node_id, cluster); clusters without any keep theirs."""
    members = features.join(fused.select("node_id", "cluster"), "node_id").groupBy("task_id", F.col("cluster").alias("node_id")).agg(*[F.avg(f).alias(f"m{f}") for f in FEATURES])
    return features.join(members, ["task_id", "node_id"], "left").select("task_id", "node_id", *[F.coalesce(f"m{f}", f).alias(f) for f in FEATURES])


def subgraph_features(subgraph: DataFrame, edges: DataFrame, facts: DataFrame, about: DataFrame, window: int = 2, hops: int = 3, tau: float = 30.0) -> DataFrame:
    """``temporal_features`` of every node of the subgraphs.

    edges: those of ``subgraph_edges``; facts: node_id, available, start_date, end_date, time_confidence, confidence, importance, polarity; about: as of ``about_ticker``.
    """
    degree = edges.groupBy("task_id", F.col("target").alias("node_id")).agg(F.count("*").alias("in_degree"))
    rows = subgraph.join(degree, ["task_id", "node_id"], "left").join(facts, "node_id", "left").join(about.select("ticker", "node_id", "impact"), ["ticker", "node_id"], "left")
    return temporal_features(rows, window, hops, tau)
