"""Lines repeated across one site's documents.

A weighted graph for each site: its nodes are normalised lines with the number of
different articles they stand in, its edges pairs of lines that directly follow each other (empty lines aside).
Nodes and edges of high support are kept, the connected components over the kept edges are the
boilerplate blocks (a node without such an edge is a block of one line), and the occurrences of the blocks' lines are
what is found and deleted.

Each line is counted once an article, and counts are summed before the shuffle. Occurrences meet
nodes and blocks in two ways: lines that make up 1 / ``MOST_HOT`` of all repeated occurrences or more, of which there
can't be more than ``MOST_HOT``, are broadcast; of the others none has a larger share, and they are joined by
hash. So a line that stands in a third of all articles isn't one task's work.

Articles with a null or blank URL have no site, null bodies no lines; neither has a
case, and both keep their text. Empty lines are never boilerplate. Repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomgraph.llm.components import connected_components
from loomgraph.scratch import written

LEAST_ARTICLES = 8
MOST_HOT = 10_000
BREAKS = r"\r\n|\n|\r"


def site_of(url: str) -> Column:
    """The host of a URL in lower case, without scheme, user, port and a leading www., m. or amp.; null if there is none."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(url, r"(?U)^\s+|\s+$", "")), r"^(?:[a-z][a-z0-9+.\-]*:)?//", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/?#\\]*", 0), r"^.*@|:\d*$", ""), r"^(?:www|m|amp)\.", "")
    return F.nullif(host, F.lit(""))


def line_key(line: Column) -> Column:
    """A line as it is compared: lower case, # for each run of digits, white space made single blanks and trimmed."""
    one = F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "#"), r"(?U)[\s\x{1C}-\x{1F}]+", " ")
    return F.trim(one)


def _hashes(articles: DataFrame) -> DataFrame:
    """article_id, keys: 64-bit hashes of site and line for each line in order, null for empty ones."""
    lines = F.transform(F.split("_article", BREAKS), line_key)
    return (
        articles.select("article_id", site_of("_url").alias("site"), lines.alias("lines"))
        .where("site is not null and lines is not null and article_id is not null")
        .select("article_id", F.transform("lines", lambda x: F.when(x != "", F.xxhash64("site", x))).alias("keys"))
        .distinct()
    )


def _nodes(keys: DataFrame, least: int) -> DataFrame:
    """key, n, hot: lines with the number of their articles, and whether there are so few of their size that they may be broadcast."""
    once = keys.select("article_id", F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))).alias("key"))
    # An id may stand in the table with more than one text; its lines count once all the same.
    several = keys.groupBy("article_id").count().where("count > 1").select("article_id")
    support = once.join(several, "article_id", "left_anti").groupBy("key").agg(F.count("*").alias("n"))
    again = once.join(several, "article_id", "left_semi").distinct().groupBy("key").agg(F.count("*").alias("n"))
    nodes = written(support.union(again).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "nodes")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    return nodes.withColumn("hot", F.col("n") * MOST_HOT >= total)


def _met(places: DataFrame, table: DataFrame) -> DataFrame:
    """The places (with key) joined with a table of key, hot and more: hot keys by broadcast, the others by hash."""
    hot = F.broadcast(table.where("hot").drop("hot"))
    cold = places.join(F.broadcast(table.where("hot").select("key")), "key", "left_anti")
    return places.join(hot, "key").unionByName(cold.join(table.where("not hot").drop("hot"), "key"))


class LineGraph:
    """nodes (key, n, hot), hits (article_id, text, seq, line_no, key: occurrences of nodes) and blocks (key, hot, block: the smallest key of the component)."""

    def __init__(self, articles: DataFrame, least: int):
        keys = written(_hashes(articles), "lines")
        self.nodes = _nodes(keys, least)
        numbered = F.filter(F.transform("keys", lambda k, i: F.struct((i + 1).cast("int").alias("line_no"), k.alias("key"))), lambda x: x["key"].isNotNull())
        places = keys.select("article_id", F.xxhash64("keys").alias("text"), F.posexplode(numbered).alias("seq", "x")).select("article_id", "text", "seq", "x.line_no", "x.key")
        self.hits = written(_met(places, self.nodes.select("key", "hot")), "hits")
        self.blocks = self._blocks(least)

    def _blocks(self, least: int) -> DataFrame:
        w = W.partitionBy("article_id", "text").orderBy("seq")
        ahead = lambda c: F.lead(c).over(w)
        steps = self.hits.select("article_id", F.col("key").alias("a"), F.when(ahead("seq") == F.col("seq") + 1, ahead("key")).alias("b")).where("a <> b")
        edges = steps.distinct().groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        parts = connected_components(edges.select("a", "b")).toDF("key", "block")
        return written(self.nodes.join(parts, "key", "left").select("key", "hot", F.coalesce("block", "key").alias("block")), "blocks")

    def occurrences(self) -> DataFrame:
        """article_id, line_no, block of each occurrence of a block's line."""
        return _met(self.hits.select("article_id", "line_no", "key"), self.blocks).select("article_id", "line_no", "block").distinct()


def repeated_lines(articles: DataFrame, least: int = LEAST_ARTICLES) -> DataFrame:
    """article_id, line_no of each occurrence of a line of a boilerplate block; its lines stand in at least ``least`` different articles of their site."""
    return LineGraph(articles, least).occurrences().select("article_id", "line_no").distinct()


def boilerplate_blocks(articles: DataFrame, least: int = LEAST_ARTICLES) -> DataFrame:
    """site, line, articles, block: each boilerplate line with its support and its block, named by the first of its lines."""
    g = LineGraph(articles, least)
    # The text of a node is read where it stands first.
    first = g.hits.groupBy("key").agg(F.min(F.struct("article_id", "line_no")).alias("x")).select("key", "x.article_id", "x.line_no")
    texts = articles.select("article_id", site_of("_url").alias("site"), F.split("_article", BREAKS).alias("lines")).where("site is not null and lines is not null")
    named = texts.join(first, "article_id").where(F.col("line_no") <= F.size("lines")).select("key", "site", line_key(F.element_at("lines", F.col("line_no"))).alias("line"))
    named = named.where(F.xxhash64("site", "line") == F.col("key")).distinct()
    whole = named.join(g.nodes.select("key", F.col("n").alias("articles")), "key").join(g.blocks.select("key", F.col("block").alias("part")), "key")
    names = whole.groupBy("part").agg(F.min("line").alias("block"))
    return whole.join(names, "part").select("site", "line", "articles", "block")


def without_repeated_lines(articles: DataFrame, least: int = LEAST_ARTICLES) -> DataFrame:
    """article_id, text, removed: every article without the lines of ``repeated_lines``; the others keep their order and line breaks become LF.

    Bodies are shuffled once, by id; rows repeated in full are told by the body's hash there.
    """
    gone = repeated_lines(articles, least).groupBy("article_id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split("_article", BREAKS), lambda x, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), (i + 1).cast("int")))
    rows = articles.select("article_id", "_article").join(gone, "article_id", "left").withColumn("body", F.xxhash64("_article"))
    return rows.dropDuplicates(["article_id", "body"]).select("article_id", F.array_join(kept, "\n").alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
