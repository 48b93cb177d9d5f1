"""Connected components of pairs, by minimum labels.

In each round every vertex takes the smallest of the labels of itself and its neighbours (in an order that is drawn
anew each round, so that no numbering of a chain is slow), and the edges are rewritten to the labels. Vertices fall by a
constant factor a round, so the rounds number the logarithm of the longest path, and all rounds together cost a few passes
over the edges. Labels are carried back through the rounds' tables, largest last.

Once at most ``SMALL_EDGES`` edges are left, a single task solves them, as a round costs more than so few edges.

Each round is a written table; nothing is collected but counts. A hot vertex is pre-aggregated: minima are combined
before the shuffle. Null ends and loops are left out. Group ids are the smallest vertex of the component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.scratch import drop_written, written

MOST_ROUNDS = 200
SMALL_EDGES = 200_000


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """v, label of all edges of a partition, by minima that are passed on to the labels themselves."""
    e = pd.concat([pd.DataFrame({"a": [], "b": []}, dtype=object), *batches])
    codes, values = pd.factorize(pd.concat([e["a"], e["b"]]).to_numpy())
    a, b = codes[: len(e)], codes[len(e) :]
    label = np.arange(len(values))
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
    if len(values):
        yield pd.DataFrame({"v": values, "label": values[label]})


def connected_components(pairs: DataFrame) -> DataFrame:
    """v, component for each vertex of the pairs (first two columns, of one type); component: its smallest vertex."""
    edges = pairs.toDF("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = edges = written(edges, "edges")
    maps = []
    for step in range(1, MOST_ROUNDS):
        if edges.isEmpty():
            break
        if edges.count() <= SMALL_EDGES:
            kind = edges.schema["a"].dataType.simpleString()
            maps.append(written(edges.coalesce(1).mapInPandas(_solved, f"v {kind}, label {kind}"), "labels"))
            if edges is not first:
                drop_written(edges)
            break
        both = edges.union(edges.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(step)).alias("h"), F.col(c).alias("v"))
        label = both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("v"), F.least("m", order("a"))["v"].alias("label"))
        label = written(label, "labels")
        maps.append(label)
        ends = edges.join(label.toDF("a", "la"), "a").join(label.toDF("b", "lb"), "b")
        last, edges = edges, written(ends.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).where("a <> b").distinct(), "edges")
        drop_written(last)
    else:
        raise RuntimeError(f"components not found in {MOST_ROUNDS} rounds")
    # From the last round back to the first: the label of a round's label.
    if not maps:
        return first.select(F.col("a").alias("v"), F.col("b").alias("component"))
    final = maps[-1]
    for table in reversed(maps[:-1]):
        last, final = (table, final), written(table.join(final.toDF("label", "to"), "label", "left").select("v", F.coalesce("to", "label").alias("label")), "resolved")
        for t in last:
            drop_written(t)
    smallest = final.groupBy("label").agg(F.min("v").alias("component"))
    return final.join(smallest, "label").select("v", "component")
