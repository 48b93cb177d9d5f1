"""Queries over extracted records: deduplication, compatibility, merges, roll-ups, controls and fitted features."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomgraph.functions import text as X
from loomgraph.operators import dedup, documents, graph, learning
from loomgraph.operators import series as S
from loomgraph.plans import tables as T
from loomgraph.plans.graph_queries import _NAME


def mention_dedupe(spark, d):
    e = T.table(spark, d, "graph_edges").where("edge_type = 'MENTIONS_ENTITY' and event_id is not null").select("event_id", "target", "article_id")
    return e.groupBy(F.trim("event_id").alias("event_id"), F.lower("target").alias("target")).agg(F.min("article_id").alias("article_id"))


def event_like_dedupe(spark, d):
    e = T.events(spark, d).withColumn("seq", F.col("event_id").cast("long"))
    return dedup.keep_first(e, ["ticker", "event_type", "available_date", "importance"], "seq").select("event_id")


def pair_compatible(spark, d):
    return dedup.compatible_pairs(T.events(spark, d)).groupBy("ticker").agg(F.count("*").alias("pairs"))


def fusion_feature_mean(spark, d):
    e = T.events(spark, d)
    return e.groupBy("ticker", "event_type").agg(*[F.round(F.avg(F.col(c).cast("double")), 6).alias(c) for c in ("importance", "confidence", "impact")])


def quality_summary(spark, d):
    n = T.table(spark, d, "graph_nodes").distinct()
    ok = F.try_parse_json("attributes_json").isNotNull() & F.col("attributes_json").isNotNull()
    return n.groupBy("node_type").agg(F.count("*").alias("n"), F.count_if(F.col("name").isNull()).alias("nameless"), F.count_if(F.trim("ticker") == "").alias("blank"), F.count_if(ok).alias("parsed"))


def company_lookup(spark, d):
    n = T.table(spark, d, "graph_nodes").where("node_type in ('Entity', 'EntityRawMention') and name is not null and trim(ticker) <> ''")
    return n.groupBy(F.lower("name").alias("name")).agg(F.min_by(F.upper(F.trim("ticker")), F.struct("node_id", F.upper(F.trim("ticker")))).alias("ticker"))


def ordinal_refs(spark, d):
    e = T.events(spark, d).withColumn("seq", F.col("event_id").cast("long"))
    n = F.row_number().over(W.partitionBy("ticker", "available_date").orderBy("seq"))
    return e.select("event_id", F.when(F.col("importance") == 3, F.concat(F.lit("kept"), "event_id")).otherwise(F.concat(F.lit("E"), n.cast("string"))).alias("ref"))


def list_union_merge(spark, d):
    e = T.table(spark, d, "graph_edges").where("edge_type = 'RELATED_TO' and source is not null and target is not null")
    return e.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("target")), "|").alias("targets"))


def span_attach(spark, d):
    ids = T.table(spark, d, "temporal_examples").distinct().where("task_id is not null").select("task_id", F.posexplode("node_indices").alias("pos", "i"))
    labels = T.vectors(spark, d).select((F.col("id") * 100).alias("i"), "grp")
    return ids.join(labels, "i").groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "grp"))), lambda s: s["grp"]).alias("g")).select("task_id", F.array_join(F.col("g").cast("array<string>"), "|").alias("g"))


def portfolio_expand(spark, d):
    """Each article of a ticker again for every other firm whose name, whole or without its legal form, or alias stands in its title or body."""
    c = T.table(spark, d, "companies")
    aliases = F.from_json(F.coalesce("aliases_json", F.lit("[]")), "array<string>")
    names = c.select("ticker", F.explode(F.concat(F.array("company", X.entity_name("company")), F.coalesce(aliases, F.array().cast("array<string>")))).alias("alias")).where("ticker is not null and alias is not null")
    a = T.articles(spark, d).select(F.col("article_id").alias("doc_id"), F.col("ticker").alias("own"), "title", "body")
    # Title and body are texts of their own, so that no name spans the two.
    texts = a.select("doc_id", F.explode(F.array("title", "body")).alias("text")).where("text is not null")
    found = documents.alias_mentions(texts, names)
    return found.join(a.select("doc_id", "own").distinct(), "doc_id").where("own <> ticker").select(F.col("doc_id").alias("article_id"), "ticker").distinct()


def relation_shuffle(spark, d):
    e = T.edges(spark, d).select("source", "target", "edge_type").distinct()
    return graph.shuffled_relations(e, 5)


def node_feature_text(spark, d):
    return T.nodes(spark, d).select("node_id", F.md5(X.joined_text(F.col("node_type"), F.col("name"), F.col("ticker")).cast("binary")).alias("h"))


def embed_eligible(spark, d):
    n = T.nodes(spark, d).where("node_type in ('Entity', 'EntityRawMention')")
    return n.where((F.trim("ticker") == "") & (F.length(X.clean("name")) >= 4) & ~F.col("name").rlike(r"^[A-Z0-9.\-]{1,4}$")).select("node_id")


def magnitude_weight(spark, d):
    t = T.tasks(spark, d).where("label_return is not null")
    return t.select("task_id", F.round(F.least(F.greatest(F.abs("label_return") / 0.02, F.lit(0.2)), F.lit(3.0)), 6).alias("w"))


def interpolated_series(spark, d):
    """Days without an order get the value on the line between their neighbours."""
    p = T.prices(spark, d).select("ticker", "date", "price")
    nxt = F.lead(F.struct("date", "price")).over(S.by_entity())
    g = p.withColumn("n", nxt).where("n is not null").select("ticker", "date", "price", "n.date", "n.price").toDF("ticker", "a", "pa", "b", "pb")
    days = g.withColumn("date", F.explode(F.sequence("a", F.date_sub("b", 1))))
    return days.select("ticker", "date", F.round(F.col("pa") + (F.col("pb") - F.col("pa")) * F.datediff("date", "a") / F.datediff("b", "a"), 4).alias("price"))


def pca_explained(spark, d):
    rows, explained = learning.pca_projection(T.vectors(spark, d), "v", F.col("id") % 10 < 7, 4)
    return rows.select("id", F.round(F.aggregate("projection", F.lit(0.0), lambda s, x: s + x * x), 4).alias("energy"))


def tfidf_norms(spark, d):
    return learning.tfidf_vectors(T.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("n"))


_NAMES = """mention_dedupe event_like_dedupe pair_compatible fusion_feature_mean quality_summary company_lookup ordinal_refs list_union_merge span_attach portfolio_expand relation_shuffle
node_feature_text embed_eligible magnitude_weight interpolated_series pca_explained tfidf_norms""".split()
QUERIES = {n: globals()[n] for n in _NAMES}
_CLEAN = r"trim(regexp_replace({}, '[\s\x{{A0}}]+', ' ', 'g'))"
ORACLE = {
    "mention_dedupe": "SELECT trim(event_id) AS event_id, lower(target) AS target, min(article_id) AS article_id FROM graph_edges WHERE edge_type = 'MENTIONS_ENTITY' AND event_id IS NOT NULL GROUP BY 1, 2",
    "event_like_dedupe": f"WITH {T.EVENTS} SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY ticker, event_type, available_date, importance ORDER BY CAST(event_id AS BIGINT)) AS r FROM ev) WHERE r = 1",
    "pair_compatible": f"WITH {T.EVENTS}, e AS (SELECT ev.*, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM ev JOIN events o ON CAST(o.event_id AS VARCHAR) = ev.event_id) SELECT a.ticker, count(*) AS pairs FROM e a JOIN e b ON a.ticker = b.ticker AND a.event_type = b.event_type AND a.event_id < b.event_id AND abs(a.event_date_start - b.event_date_start) <= 7 AND abs(a.event_date_end - b.event_date_end) <= 7 AND a.k = b.k GROUP BY 1",
    "fusion_feature_mean": f"WITH {T.EVENTS} SELECT ticker, event_type, round(avg(importance::DOUBLE), 6) AS importance, round(avg(confidence), 6) AS confidence, round(avg(impact), 6) AS impact FROM ev GROUP BY 1, 2",
    "quality_summary": "SELECT node_type, count(*) AS n, count(*) FILTER (name IS NULL) AS nameless, count(*) FILTER (trim(ticker) = '') AS blank, count(*) FILTER (json_valid(attributes_json)) AS parsed FROM (SELECT DISTINCT * FROM graph_nodes) GROUP BY 1",
    "company_lookup": "SELECT lower(name) AS name, arg_min(upper(trim(ticker)), {'n': node_id, 't': upper(trim(ticker))}) AS ticker FROM graph_nodes WHERE node_type IN ('Entity', 'EntityRawMention') AND name IS NOT NULL AND trim(ticker) <> '' GROUP BY 1",
    "ordinal_refs": f"WITH {T.EVENTS} SELECT event_id, CASE WHEN importance = 3 THEN 'kept' || event_id ELSE 'E' || row_number() OVER (PARTITION BY ticker, available_date ORDER BY CAST(event_id AS BIGINT)) END AS ref FROM ev",
    "list_union_merge": "SELECT source, string_agg(DISTINCT target, '|' ORDER BY target) AS targets FROM graph_edges WHERE edge_type = 'RELATED_TO' AND source IS NOT NULL AND target IS NOT NULL GROUP BY 1",
    "span_attach": f"WITH {T.VECTORS}, i AS (SELECT task_id, unnest(node_indices) AS i, unnest(range(0, len(node_indices))) AS pos FROM (SELECT DISTINCT * FROM temporal_examples WHERE task_id IS NOT NULL)) SELECT task_id, string_agg(grp, '|' ORDER BY pos) AS g FROM i JOIN vecs ON vecs.id * 100 = i.i GROUP BY 1",
    "portfolio_expand": rf"""WITH {T.ARTICLES}, c AS (SELECT ticker, unnest([company, {_NAME.format(c='company')}]) AS a FROM companies UNION SELECT ticker, unnest(CAST(from_json(coalesce(aliases_json, '[]'), '["VARCHAR"]') AS VARCHAR[])) FROM companies),
w AS (SELECT DISTINCT ticker, ' ' || trim(regexp_replace(lower(a), '[^a-z0-9]+', ' ', 'g')) || ' ' AS a FROM c WHERE a IS NOT NULL), t AS (SELECT article_id, ticker AS own, unnest([title, body]) AS t FROM arts),
p AS (SELECT article_id, own, ' ' || regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g') || ' ' AS t FROM t WHERE t IS NOT NULL) SELECT DISTINCT article_id, ticker FROM p JOIN w ON own <> ticker AND a <> '  ' AND contains(t, a)""",
    "relation_shuffle": f"""WITH {T.EDGES}, e AS (SELECT DISTINCT source, target, edge_type FROM edges), r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', source, target, edge_type, '6')), source, target, edge_type) AS i, row_number() OVER (ORDER BY md5(concat_ws('|', source, target, edge_type, '5')), source, target, edge_type) AS j FROM e)
SELECT a.source, a.target, b.edge_type FROM r a JOIN r b ON a.i = b.j""",
    "node_feature_text": f"WITH {T.NODES} SELECT node_id, md5(concat_ws(' | ', nullif({_CLEAN.format('node_type')}, ''), nullif({_CLEAN.format('name')}, ''), nullif({_CLEAN.format('ticker')}, ''))) AS h FROM nodes",
    "embed_eligible": rf"WITH {T.NODES} SELECT node_id FROM nodes WHERE node_type IN ('Entity', 'EntityRawMention') AND trim(ticker) = '' AND length({_CLEAN.format('name')}) >= 4 AND NOT regexp_matches(name, '^[A-Z0-9.\-]{{1,4}}$')",
    "magnitude_weight": f"WITH {T.TASKS} SELECT task_id, round(least(greatest(abs(label_return) / 0.02, 0.2), 3.0), 6) AS w FROM tasks WHERE label_return IS NOT NULL",
    "interpolated_series": f"WITH {T.PRICES}, g AS (SELECT ticker, date AS a, price AS pa, lead(date) OVER w AS b, lead(price) OVER w AS pb FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)) SELECT ticker, d AS date, round(pa + (pb - pa) * (d - a) / (b - a), 4) AS price FROM (SELECT *, CAST(unnest(generate_series(a, b - 1, INTERVAL 1 DAY)) AS DATE) AS d FROM g WHERE b IS NOT NULL)",
}
