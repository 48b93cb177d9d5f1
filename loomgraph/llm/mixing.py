"""Mixing sources to target weights by iterative proportional fitting.

Token weights are raked to the marginals of source (their target shares), language and
topic (their shares in the documents of these sources, unless given), over the cells of the three;
a weight is the number of times a document of the cell is used, at most its source's
``max_repeats``. What the cap takes from a cell goes to the other cells of its source, so
the source shares hold exactly. The total is the largest that the scarcest source allows, unless
a smaller one is given. Documents are then chosen by the calibrated weights: the whole
part of a weight always, its fraction for those documents of the cell whose hash comes first,
until the cell's tokens are reached; the largest cell of a source takes up what the others'
last documents missed, so that a source is off by less than a document.

Cells number the sources times languages times topics, whatever the rows; that
is checked (``MOST_CELLS``), and only they are fitted on the driver. A cell's running sums are
taken over ``BUCKETS`` ranges of the hash, and only one range of each is sorted, so
a source with a third of all rows is spread like any other.

Null and empty texts have no tokens and aren't used, nor are documents of a null or untargeted source. Null
languages and topics are cells of their own. Repeated rows count once. A targeted source without
documents gets nothing, and the others' shares are in proportion.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomgraph.scratch import written

MOST_CELLS = 200_000
BUCKETS = 4096


@cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    """The byte-level BPE of 50,256 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _count(frames: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    encode = _encoding(path).encode_ordinary
    for f in frames:
        f["tokens"] = [len(encode(t)) for t in f.pop("text")]
        yield f


def token_counts(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens of each document with a source and a text."""
    path = vocabulary or default_vocabulary()
    known = documents.where("text <> '' and source is not null and doc_id is not null").select("doc_id", "source", "lang", F.col("doc_kind").alias("topic"), "text")
    return known.mapInPandas(lambda fs: _count(fs, path), "doc_id long, source string, lang string, topic string, tokens long").where("tokens > 0")


def _group_shares(cells: pd.DataFrame, by: str, mass: np.ndarray, given: dict | None) -> np.ndarray:
    """For each cell the share of the total that its group is to have."""
    if given is None:
        own = pd.Series(mass).groupby(cells[by].to_numpy()).transform("sum").to_numpy()
        return own / mass.sum()
    return np.array([given.get(x, 0.0) for x in cells[by]])


def rake(cells: pd.DataFrame, shares: dict[str, float], caps: dict[str, int], total: float | None = None, languages: dict | None = None, topics: dict | None = None, rounds: int = 60) -> pd.DataFrame:
    """cells (source, lang, topic, tokens) with weight: uses of each of the cell's documents, raked to the three marginals."""
    c = cells.assign(lang=cells["lang"].fillna(""), topic=cells["topic"].fillna(""), cap=[float(caps[s]) for s in cells["source"]])
    t, cap = c["tokens"].to_numpy(dtype=float), c["cap"].to_numpy()
    have = c.groupby("source")["tokens"].sum()
    share = {s: shares[s] for s in have.index if shares[s] > 0 and caps[s] > 0}
    scale = sum(share.values())
    if not share:
        return c.assign(weight=0.0)
    most = min(caps[s] * have[s] / (share[s] / scale) for s in share)
    total = min(total or most, most)
    goal = {s: share.get(s, 0.0) / scale * total for s in have.index}
    use = np.array([s in share for s in c["source"]])
    source = c["source"].to_numpy()
    by_lang, by_topic = (_group_shares(c, k, np.where(use, t, 0.0), given) for k, given in (("lang", languages), ("topic", topics)))
    w = np.where(use, np.array([goal[s] / have[s] for s in source]), 0.0)

    def to_sources(w: np.ndarray) -> np.ndarray:
        w = np.minimum(w, cap)
        for _ in range(len(c) + 1):
            got = pd.Series(w * t).groupby(source).sum()
            free = use & (w < cap)
            room = pd.Series(np.where(free, w * t, 0.0)).groupby(source).sum()
            f = np.array([1 + (goal[s] - got[s]) / room[s] if room[s] > 0 else 1.0 for s in source])
            after = np.minimum(np.where(free, w * np.maximum(f, 0), w), cap)
            if np.allclose(after, w, rtol=1e-12, atol=0):
                return after
            w = after
        return w

    for _ in range(rounds):
        before = w
        for key, part in (("lang", by_lang), ("topic", by_topic)):
            got = pd.Series(w * t).groupby(c[key].to_numpy()).transform("sum").to_numpy()
            # A zero weight can't grow back, so a group that is to have nothing keeps a trace.
            w = np.where((got > 0) & use, w * np.maximum(part * total / np.where(got > 0, got, 1), 1e-9), w)
        w = to_sources(w)
        if np.abs(w - before).max() < 1e-9:
            break
    return c.assign(weight=w)


def _chosen(sums: DataFrame, goals: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each cell the range its goal ends in, with the tokens before it; and that range's documents with their running sums."""
    run = W.partitionBy("cell").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("tokens").over(run), F.lit(0)))
    end = before.join(goals, "cell").where("before < goal and goal <= before + tokens").select("cell", "range", "before", "goal")
    inside = docs.join(end, ["cell", "range"])
    one = W.partitionBy("cell").orderBy("u", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    # A document is taken if more than half of it lies before the goal.
    inside = inside.withColumn("taken", F.col("before") + F.sum("tokens").over(one) - F.col("tokens") / 2 <= F.col("goal"))
    return end, inside


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None, total_tokens: float | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, tokens, repeats) of every document of a targeted source, repeats 0 if it isn't used, and the report (source, target_share, share, tokens, documents, most_repeats)."""
    spark = documents.sparkSession
    counted = written(token_counts(documents, vocabulary), "tokens")
    wanted = targets.select("source", "target_share", "max_repeats").dropna().distinct().limit(MOST_CELLS + 1).collect()
    if len(wanted) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} target shares")
    aims = {r["source"]: (r["target_share"], r["max_repeats"]) for r in wanted}
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40))
    docs = counted.where(F.col("source").isin([*aims])).distinct().withColumn("u", u).withColumn("range", F.floor(F.col("u") / ((1 << 40) // BUCKETS)).cast("int"))
    rows = docs.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).limit(MOST_CELLS + 1).toPandas()
    if len(rows) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of source, language and topic")
    fitted = rake(rows, {s: a for s, (a, _) in aims.items()}, {s: m for s, (_, m) in aims.items()}, total_tokens) if len(rows) else rows.assign(weight=[])
    fitted["cell"] = range(len(fitted))
    fitted["whole"] = np.floor(fitted["weight"].to_numpy(dtype=float) + 1e-9).astype(int)
    fitted["goal"] = np.maximum(fitted["weight"] - fitted["whole"], 0) * fitted["tokens"]
    fitted["largest"] = fitted.groupby("source")["goal"].transform("max").eq(fitted["goal"]) & ~fitted[fitted["goal"] > 0].duplicated(["source", "goal"]).reindex(fitted.index, fill_value=True)
    columns = ["cell", "source", "lang", "topic", "whole", "goal", "largest"]
    table = spark.createDataFrame([tuple(x) for x in fitted[columns].itertuples(index=False)] or [], "cell int, source string, lang string, topic string, whole int, goal double, largest boolean")
    # Bounded by MOST_CELLS rows.
    cells = F.broadcast(table)
    keyed = docs.withColumns({"lang": F.coalesce("lang", F.lit("")), "topic": F.coalesce("topic", F.lit(""))}).join(cells, ["source", "lang", "topic"]).select("doc_id", "source", "tokens", "u", "range", "cell", "whole")
    sums = written(keyed.groupBy("cell", "range").agg(F.sum("tokens").alias("tokens")), "ranges")
    goals = table.select("cell", "source", "goal", "largest").where("goal > 0")
    _, first = _chosen(sums, goals.where("not largest").select("cell", "goal"), keyed)
    got = first.groupBy("cell").agg((F.max("before") + F.sum(F.when(F.col("taken"), F.col("tokens")).otherwise(0))).alias("got"), F.max("goal").alias("was"))
    missed = goals.join(got, "cell").groupBy("source").agg(F.sum(F.col("was") - F.col("got")).alias("missed"))
    own = sums.groupBy("cell").agg(F.sum("tokens").alias("size"))
    settled = goals.join(missed, "source", "left").join(own, "cell").select(
        "cell", F.when(F.col("largest"), F.greatest(F.lit(0.0), F.least(F.col("size").cast("double"), F.col("goal") + F.coalesce("missed", F.lit(0.0))))).otherwise(F.col("goal")).alias("goal")
    ).where("goal > 0")
    settled = written(settled, "goals")
    end, inside = _chosen(sums, settled, keyed)
    extra = inside.where("taken").select("doc_id", F.lit(1).alias("one"))
    ends = F.broadcast(end.select("cell", F.col("range").alias("end")))
    used = keyed.join(ends, "cell", "left").join(extra, "doc_id", "left")
    used = used.withColumn("repeats", F.col("whole") + F.coalesce((F.col("range") < F.col("end")).cast("int"), F.lit(0)) + F.coalesce("one", F.lit(0)))
    used = written(used.select("doc_id", "source", "tokens", "repeats"), "mix")
    sizes = used.where("repeats > 0").groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    whole = sizes.agg(F.sum("tokens").alias("all"))
    report = targets.select("source", "target_share", "max_repeats").dropna().distinct().join(sizes, "source", "left").crossJoin(F.broadcast(whole)).select(
        "source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.greatest(F.coalesce("all", F.lit(0)), F.lit(1))).alias("share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats",
    )
    return used, report
