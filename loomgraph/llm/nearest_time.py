"""Matching records by nearest time: a two-pointer merge over both tables, sorted within partitions.

Both tables are repartitioned by entity and a slot of time, so that an entity with a
third of all rows is spread over many tasks; a right record goes to each slot that has an
instant within the tolerance of it (two or three, whatever the data). Within a
partition rows come sorted by entity, slot and time, and one pass pairs each left
record with its neighbours on the right: the last one before it and the first one after
it. The pass holds a batch, the last right record, and the left ones still waiting for the
next right record, which is no further off than the tolerance.

Null or blank entities and null times match nothing. Distances equal to the tolerance
count; of two equally near records the earlier wins, of several at one instant the smallest
id. Repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NONE = np.iinfo(np.int64).min // 4


def _merged(frames: Iterator[pd.DataFrame], tolerance: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by slot group, time, side (right first), id. Yields id, match, micros."""
    waiting = pd.DataFrame()
    last = None  # group, time and id of the last right record
    for f in frames:
        f = pd.concat([waiting, f], ignore_index=True) if len(waiting) else f.reset_index(drop=True)
        yield from _pass(f, last, tolerance, False)
        waiting, last = _carried(f, last, tolerance)
    if len(waiting):
        yield from _pass(waiting, last, tolerance, True)


def _groups(f: pd.DataFrame) -> np.ndarray:
    return (f["entity"] + "\0" + f["slot"].astype(str)).to_numpy()


def _resolved(f: pd.DataFrame, tolerance: int) -> np.ndarray:
    """Left rows whose next right record is known or out of reach: a later row of the batch is of another group, or further off, or a right record."""
    group, t, right = _groups(f), f["t"].to_numpy(), f["right"].to_numpy()
    over = (group != group[-1]) | (t[-1] - t > tolerance)
    later_right = np.flatnonzero(right & (group == group[-1]))
    if len(later_right):
        over |= np.arange(len(f)) < later_right[-1]
    return over


def _carried(f: pd.DataFrame, last, tolerance: int):
    wait = ~_resolved(f, tolerance) & ~f["right"].to_numpy()
    rights = np.flatnonzero(f["right"].to_numpy())
    if len(rights):
        row = f.iloc[rights[-1]]
        group = _groups(f.iloc[[rights[-1]]])[0]
        # Several right records at one instant: the smallest id comes first and counts.
        same = rights[(f["t"].to_numpy()[rights] == row["t"]) & (_groups(f.iloc[rights]) == group)]
        before = last if last is not None and last[0] == group and last[1] == row["t"] else None
        last = before or (group, row["t"], f["id"].iat[same[0]])
    return f[wait], last


def _pass(f: pd.DataFrame, last, tolerance: int, ended: bool) -> Iterator[pd.DataFrame]:
    n = len(f)
    if not n:
        return
    group, t, right, ids = _groups(f), f["t"].to_numpy(), f["right"].to_numpy(), f["id"].to_numpy()
    code = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])])
    # Of right records at one instant only the first counts.
    first_at = np.ones(n, dtype=bool)
    first_at[1:] = ~(right[1:] & right[:-1] & (t[1:] == t[:-1]) & (code[1:] == code[:-1]))
    at = np.arange(n)
    usable = right & first_at
    if last is not None:
        usable &= ~((t == last[1]) & (group == last[0]))
    before = np.maximum.accumulate(np.where(usable, at, -1))
    after = np.minimum.accumulate(np.where(usable, at, n)[::-1])[::-1]
    left = ~right & (np.ones(n, dtype=bool) if ended else _resolved(f, tolerance))
    rows = np.flatnonzero(left)
    if not len(rows):
        return
    b, a = before[rows], after[rows]
    has_b = (b >= 0) & (code[b] == code[rows])
    has_a = (a < n) & (code[np.minimum(a, n - 1)] == code[rows])
    tb = np.where(has_b, t[b], _NONE)
    tb_id = np.where(has_b, ids[b], None)
    if last is not None:
        carried = ~has_b & (group[rows] == last[0])
        tb = np.where(carried, last[1], tb)
        tb_id = np.where(carried, last[2], tb_id)
    ta = np.where(has_a, t[np.minimum(a, n - 1)], -_NONE)
    d_b, d_a = t[rows] - tb, ta - t[rows]
    earlier = d_b <= d_a
    d = np.where(earlier, d_b, d_a)
    match = np.where(earlier, tb_id, ids[np.minimum(a, n - 1)])
    keep = d <= tolerance
    yield pd.DataFrame({"id": ids[rows][keep], "match": match[keep], "micros": d[keep]})


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance_seconds: int) -> DataFrame:
    """id, match, micros: each left record with the nearest right one of its entity within the tolerance.

    left and right: id string, entity string, t (timestamp), other columns are ignored. Left records without a match are left out.
    """
    tolerance = tolerance_seconds * 1_000_000
    width = 16 * tolerance or 1
    micros = lambda df: df.select("id", "entity", F.unix_micros(F.col("t").cast("timestamp")).alias("t")).dropna().where("entity <> ''").distinct()
    slot = lambda t: F.floor(t / F.lit(float(width))).cast("long")
    lefts = micros(left).withColumn("slot", slot(F.col("t"))).withColumn("right", F.lit(False))
    rights = micros(right).withColumn("slot", F.explode(F.sequence(slot(F.col("t") - tolerance), slot(F.col("t") + tolerance)))).withColumn("right", F.lit(True))
    rows = lefts.unionByName(rights).repartition("entity", "slot").sortWithinPartitions("entity", "slot", "t", F.desc("right"), "id")
    return rows.select("entity", "slot", "t", "right", "id").mapInPandas(lambda fs: _merged(fs, tolerance), "id string, match string, micros long")
