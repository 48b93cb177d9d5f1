"""Same or near-same records across splits.

Records are canonicalised (case, punctuation and white space gone) and hashed;
evaluation hashes are joined with training hashes: first those of whole records, which gives
the exact overlaps, then those of the chunks of their signatures (``near``), which gives
the candidates for near-same ones, verified on the whole texts. Only evaluation
records meet training records, so the join's work is that of the two sides, not of all pairs.

A record without a split, or with a null or blank key of its split, takes part on neither side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.near import article_records, candidate_pairs, class_pairs, content_classes


def ticker_key(c: str) -> Column:
    """A ticker as it is compared: without outer white space, in upper case; null if blank."""
    return F.nullif(F.upper(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(""))


def article_splits(articles: DataFrame, tasks: DataFrame) -> DataFrame:
    """id, split: the split of the task with the article's ticker and day. Articles without such a task are left out."""
    by = tasks.select(ticker_key("ticker").alias("ticker"), F.col("cutoff_date").alias("day"), "split").dropna().distinct()
    return articles.select(F.col("article_id").alias("id"), ticker_key("_ticker").alias("ticker"), F.to_date("_date").alias("day")).dropna().join(by, ["ticker", "day"]).select("id", "split").distinct()


def cross_split_overlaps(records: DataFrame, splits: DataFrame, run: int = 3, least: float = 0.5, train: str = "train") -> DataFrame:
    """id, split, exact of each evaluation record that stands, exactly or nearly, among the training records.

    records: id, text; splits: id, split. exact: a training record has the very same words.
    """
    wanted = records.join(splits.select("id").distinct(), "id", "left_semi")
    members, classes = content_classes(wanted, run)
    sided = members.join(splits, "id").select("id", "split", "cid", (F.col("split") == train).alias("is_train"))
    sides = sided.groupBy("cid").agg(F.bool_or("is_train").alias("trains"), F.bool_or(~F.col("is_train")).alias("tests"))
    known = classes.join(sides, "cid")
    exact = known.where("trains and tests").select("cid", F.lit(True).alias("exact"))
    side = F.col("tests").cast("int") + 2 * F.col("trains").cast("int")
    # A class on both sides is found as exact already, so a pair of two of them adds nothing.
    pairs = class_pairs(wanted, classes, candidate_pairs(known, least, side), run, least)
    found = exact.union(pairs.select("a", F.lit(False))).groupBy("cid").agg(F.bool_or("exact").alias("exact"))
    return sided.where("not is_train").join(found, "cid").select("id", "split", "exact").distinct()


def article_overlaps(articles: DataFrame, tasks: DataFrame) -> DataFrame:
    """id, split, exact for articles of an evaluation split whose like stands among those of the training split."""
    return cross_split_overlaps(article_records(articles), article_splits(articles, tasks))
