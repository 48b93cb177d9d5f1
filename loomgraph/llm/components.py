"""Consolidating pairwise matches into groups: events tied by SAME_AS rows, as connected components.

The giant component is peeled first: frontier breadth-first joins from the vertex of highest degree, each of which
anti-joins the vertices reached already, until a frontier is empty. What was reached is anti-joined away, and the remaining small
components are labelled by minimum propagation. A component of great diameter (a chain) isn't followed link by link
for more than ``MOST_PEELS`` rounds: edges that lead out of what was reached by then go on from its root, so none is lost.

Minimum propagation goes in pairs of steps: every vertex hands the smallest vertex of its neighbourhood to its larger neighbours,
then to its smaller ones; links so become links to ever smaller vertices, until all of a component's vertices hang on its smallest.
The rounds number about the logarithm of the longest path; if they haven't ended after ``MOST_ROUNDS`` an error is raised.

Each round is a written table, counted while it is written; nothing is collected but counts. Minima are combined before the shuffle. Null
ends and ties of a vertex to itself are left out; repeated rows count once. Group ids are the smallest vertex of the component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.scratch import drop_written, written

MOST_PEELS, MOST_ROUNDS = 20, 100


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("b", "a"))


def _seen(df: DataFrame, name: str) -> tuple[DataFrame, tuple[int, int]]:
    """The written table with its number of rows and a sum of their hashes."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")), name)
    return out, (seen.get["n"], seen.get["h"])


def peel_giant(edges: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """reached (v, root) and the edges (a, b) left when what was reached is anti-joined away."""
    both = _both(edges)
    top = both.groupBy("a").count().orderBy(F.desc("count"), "a").limit(1).collect()
    if not top:
        return None, edges
    root = F.lit(top[0]["a"]).cast(edges.schema["a"].dataType)
    # The first frontier is the neighbourhood of the root, a filter rather than a join on the hottest key.
    near = both.where(F.col("a") == root).select(F.col("b").alias("v")).distinct()
    tables = []
    for _ in range(MOST_PEELS):
        frontier, (n, _h) = _seen(near, "frontier")
        tables.append(frontier)
        if not n:
            break
        near = both.join(frontier.withColumnRenamed("v", "a"), "a", "left_semi").select(F.col("b").alias("v")).where(F.col("v") != root).distinct()
        # Neighbours of a frontier lie in it, in the one before it or in the next one.
        for earlier in tables[-2:]:
            near = near.join(earlier, "v", "left_anti")
    reached = tables[0].select("v", root.alias("root"))
    for t in tables[1:]:
        reached = reached.union(t.select("v", root.alias("root")))
    reached = written(reached.union(edges.sparkSession.range(1).select(root.alias("v"), root.alias("root"))), "reached")
    ids = reached.select("v")
    inside = lambda c: ids.withColumnRenamed("v", c)
    left = edges.join(inside("a"), "a", "left_anti").join(inside("b"), "b", "left_anti").select("a", "b")
    if n:
        # Not exhausted: the edges from reached vertices to others start at the root.
        out = both.join(inside("a"), "a", "left_semi").join(inside("b"), "b", "left_anti").select(F.least(root, "b").alias("a"), F.greatest(root, "b").alias("b"))
        left = left.union(out.distinct())
    for t in tables:
        drop_written(t)
    return reached, left


def propagated_minima(edges: DataFrame) -> DataFrame:
    """v, label of each vertex of the edges (a < b): the smallest vertex of its component, by minimum propagation."""
    # Links point from the larger vertex to the smaller one.
    links, now = _seen(edges.select(F.col("b").alias("v"), F.col("a").alias("u")), "links")
    for _ in range(MOST_ROUNDS):
        both = links.union(links.select("u", "v"))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        large = both.join(least, "v").where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").union(down.select("v", "m")).distinct()
        before, old = now, links
        links, now = _seen(small, "links")
        drop_written(old)
        if now == before:
            return links.select("v", F.col("u").alias("label")).union(links.select("u", "u").distinct())
    raise RuntimeError(f"components not found in {MOST_ROUNDS} rounds")


def connected_components(pairs: DataFrame) -> DataFrame:
    """v, component for each vertex of the pairs (first two columns, of one type); component: its smallest vertex."""
    edges = written(pairs.toDF("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    reached, left = peel_giant(edges)
    labels = propagated_minima(left).toDF("v", "label")
    if reached is None:
        return labels.toDF("v", "component")
    # The root may have gone on as a vertex of the rest; then its label there holds for all it reached.
    onward = reached.join(labels.toDF("root", "label"), "root", "left").select("v", F.coalesce("label", "root").alias("label"))
    whole = onward.union(labels.join(reached.select("v"), "v", "left_anti"))
    smallest = onward.groupBy("label").agg(F.min("v").alias("least"))
    return whole.join(smallest, "label", "left").select("v", F.least("label", "least").alias("component"))


def event_pairs(nodes: DataFrame, edges: DataFrame, edge_type: str = "SAME_AS") -> DataFrame:
    """a, b: the pairs of two different Event nodes that rows of this type tie; left: ``event:`` + trimmed event_id, else source."""
    events = nodes.where("node_type = 'Event' and node_id is not null").select("node_id").distinct()
    left = F.coalesce(F.concat(F.lit("event:"), F.regexp_replace("event_id", r"(?U)^\s+|\s+$", "")), "source")
    rows = edges.where(F.col("edge_type") == edge_type).select(left.alias("a"), F.col("target").alias("b")).where("a <> b").distinct()
    return rows.join(events.toDF("a"), "a", "left_semi").join(events.toDF("b"), "b", "left_semi")


def event_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, group_id of each Event node tied to another one, directly or indirectly."""
    return connected_components(event_pairs(nodes, edges)).toDF("node_id", "group_id")
