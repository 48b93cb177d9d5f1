"""Similarity joins of vectors within groups, and nearest entries of a small registry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomgraph.functions.vectors import dot, unit


def _nearest(f: pd.DataFrame, k: int) -> pd.DataFrame:
    """left, right, sim: the k nearest of a block for each vector of another one, as a product of two matrices; vectors of unlike length count as far as the shorter goes."""
    mine, others = f[f["side"] == 0], f[f["side"] == 1]
    if mine.empty or others.empty:
        return pd.DataFrame({"left": f["id"].iloc[:0], "right": f["id"].iloc[:0], "sim": np.empty(0)})
    size = max(map(len, f["v"]))
    a, b = (np.array([np.pad(np.asarray(v, dtype=float), (0, size - len(v))) for v in x["v"]]) for x in (mine, others))
    b, ids = (x[np.argsort(others["id"].to_numpy(), kind="stable")] for x in (b, others["id"].to_numpy()))
    parts = []
    for at in range(0, len(a), 512):
        sim = np.round(a[at : at + 512] @ b.T, 6)
        # Of equal ones the smaller id, which stands first.
        best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        parts.append(pd.DataFrame({"left": np.repeat(mine["id"].to_numpy()[at : at + 512], best.shape[1]), "right": ids[best].ravel(), "sim": np.take_along_axis(sim, best, axis=1).ravel()}))
    return pd.concat(parts)


def knn_lower_side(vectors: DataFrame, k: int, least: float, block: int = 2000) -> DataFrame:
    """left, right, sim: pairs within a group of which the higher id is among the ``k`` nearest (itself included) of the lower one.

    vectors: id, grp, v. Cosines are rounded to 6 digits before they are ranked, ties by id. A group is split into blocks of about ``block`` vectors, and
    every two blocks meet in a task of their own that keeps the k nearest of each vector, so a group of any size is spread and no pair but those leaves a task.
    """
    u = vectors.where("v is not null and grp is not null").select("id", "grp", unit(F.col("v")).alias("v"))
    sizes = u.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = u.join(sizes, "grp").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = own.select("id", "grp", "v", F.lit(0).alias("side"), F.col("b").alias("x"), each.alias("y"))
    right = own.select("id", "grp", "v", F.lit(1).alias("side"), each.alias("x"), F.col("b").alias("y"))
    kind = dict(u.dtypes)["id"]
    near = left.unionByName(right).groupBy("grp", "x", "y").applyInPandas(lambda f: _nearest(f, k), f"left {kind}, right {kind}, sim double")
    w = W.partitionBy("left").orderBy(F.desc("sim"), "right")
    return near.withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= k) & (F.col("left") < F.col("right")) & (F.col("sim") >= least)).drop("_n")


def semantic_edges(pairs: DataFrame, same: float, related: float) -> DataFrame:
    """source, target, edge_type, weight: SAME_AS from ``same`` on, RELATED_TO from ``related`` on."""
    kind = F.when(F.col("sim") >= same, "SAME_AS").otherwise("RELATED_TO")
    return pairs.where(F.col("sim") >= related).select(F.col("left").alias("source"), F.col("right").alias("target"), kind.alias("edge_type"), F.col("sim").alias("weight"))


def nearest_entry(vectors: DataFrame, registry: DataFrame, least: float, most_entries: int = 50_000) -> DataFrame:
    """id, entry, sim: the registry entry of highest cosine, the smaller id among equals. registry: entry, v.

    The registry is a stated query set that is held by every task; its size is checked, and beyond ``most_entries`` it is joined by
    hash ranges of its ids, one after the other.
    """
    v = vectors.where("v is not null").select("id", unit(F.col("v")).alias("a"))
    r = registry.where("v is not null").select("entry", unit(F.col("v")).alias("b"))
    blocks = max(1, -(-r.count() // most_entries))
    out = None
    for i in range(blocks):
        part = r.where(F.pmod(F.xxhash64("entry"), F.lit(blocks)) == i) if blocks > 1 else r
        sims = v.crossJoin(F.broadcast(part)).select("id", "entry", F.round(dot(F.col("a"), F.col("b")), 6).alias("sim"))
        best = sims.groupBy("id").agg(F.min(F.struct((-F.col("sim")).alias("m"), "entry")).alias("x"))
        out = best if out is None else out.unionByName(best)
    out = out if blocks == 1 else out.groupBy("id").agg(F.min("x").alias("x"))
    return out.select("id", F.col("x.entry").alias("entry"), (-F.col("x.m")).alias("sim")).where(F.col("sim") >= least)
