"""Queries over the event graph, its similarity joins, fusion and temporal subgraphs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomgraph.functions import text as X
from loomgraph.functions import vocabulary as V
from loomgraph.operators import components, dedup, fusion, graph, similarity, temporal
from loomgraph.plans import tables as T
from loomgraph.scratch import drop_written, written, written_by

DAYS, HOPS = 2, 3


def _tasks(spark, d):
    return T.tasks(spark, d).select("task_id", "ticker", F.col("cutoff_date").alias("cutoff")).distinct()


def keep_first_articles(spark, d):
    a = T.table(spark, d, "articles").distinct().where("_title is not null and _ticker is not null")
    return dedup.keep_first(a, [X.ticker_plain("_ticker"), F.to_date("_date")], "_source_row", "article_id").select("article_id", "_source_row")


def article_ids(spark, d):
    a = T.articles(spark, d)
    base = F.concat_ws("|", F.col("date").cast("string"), "ticker", F.coalesce("title", F.lit("")), F.coalesce("url", F.lit("")))
    key = F.concat_ws("|", base, F.col("source_row").cast("string"))
    return a.select("article_id", F.concat(F.lit("ART_"), X.short_sha1(key, 14)).alias("made"))


def union_partitions(spark, d):
    t = T.table(spark, d, "forecast_tasks")
    parts = dedup.union_all(t.where("split = 'train'").select("task_id", "ticker", "label_return"), t.select("task_id", "ticker"))
    return dedup.keep_first(parts, ["task_id"], "_part", F.col("label_return").asc_nulls_last()).select("task_id", "ticker", F.round("label_return", 6).alias("label_return"))


def resume_anti(spark, d):
    done = T.table(spark, d, "graph_edges").where("edge_type = 'REPORTS'").select("article_id").distinct()
    return T.articles(spark, d).join(done, "article_id", "left_anti").select("article_id").distinct()


def event_edges(spark, d):
    return graph.event_edges(T.events(spark, d)).groupBy("edge_type", "target").agg(F.count("*").alias("n"))


def event_nodes(spark, d):
    return graph.event_nodes(T.events(spark, d))


def article_edges(spark, d):
    return graph.article_edges(T.articles(spark, d)).select("source", "target", "edge_type").distinct()


def chronology_edges(spark, d):
    return graph.chronology_edges(T.events(spark, d))


def cluster_chronology(spark, d):
    m = T.events(spark, d).select("ticker", F.concat("event_type", F.lit("_"), F.col("importance").cast("string")).alias("cluster"), F.col("event_date_start").alias("date"))
    return graph.cluster_chronology(m)


def reverse_synthesis(spark, d):
    e = T.edges(spark, d).select("source", "target", F.when(F.col("edge_type") == "REPORTS", "REV_REPORTED").otherwise(F.col("edge_type")).alias("edge_type"))
    return graph.reverse_synthesis(e).groupBy("edge_type").agg(F.count("*").alias("n"), F.count_distinct("target").alias("targets"))


def typed_tensor_index(spark, d):
    return graph.typed_index(T.nodes(spark, d).select("node_id", "node_type")).groupBy("node_type").agg(F.count("*").alias("n"), F.min("idx").alias("least"), F.max("idx").alias("most"), F.count_distinct("idx").alias("different"))


def typed_edge_lists(spark, d):
    return graph.typed_edges(T.edges(spark, d), graph.typed_index(T.nodes(spark, d).select("node_id", "node_type"))).select("source_type", "edge_type", "target_type", "edges", F.round("weight", 4).alias("weight"))


def dangling_edges(spark, d):
    return graph.dangling_edges(T.edges(spark, d), T.nodes(spark, d)).distinct()


def duplicate_nodes(spark, d):
    return T.table(spark, d, "graph_nodes").groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1")


def edge_availability(spark, d):
    return graph.dated_edges(T.edges(spark, d), T.nodes(spark, d)).groupBy("edge_type", "known").agg(F.count("*").alias("n"))


def edge_type_lookup(spark, d):
    n = T.nodes(spark, d).select("node_id", "node_type")
    e = T.edges(spark, d).join(n.toDF("source", "s"), "source", "left").join(n.toDF("target", "t"), "target", "left")
    return e.groupBy(F.coalesce("s", F.lit("")).alias("source_type"), F.coalesce("t", F.lit("")).alias("target_type")).agg(F.count("*").alias("n"))


def visible_nodes(spark, d):
    return temporal.visible_nodes(_tasks(spark, d), T.nodes(spark, d), DAYS).groupBy("task_id").agg(F.count("*").alias("n"))


def window_subgraph(spark, d):
    return temporal.window_subgraph(_tasks(spark, d), T.nodes(spark, d), T.edges(spark, d), DAYS, HOPS)


def _subgraph(spark, d):
    sub, known = temporal.task_subgraph(_tasks(spark, d), T.nodes(spark, d), T.edges(spark, d), DAYS, HOPS)
    return sub, temporal.subgraph_edges(sub, known, DAYS)


def subgraph_edges(spark, d):
    return _subgraph(spark, d)[1].groupBy("task_id").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


def all_events_subgraph(spark, d):
    """The subgraphs without a scope: how many nodes of each hop."""
    sub = temporal.window_subgraph(_tasks(spark, d), T.nodes(spark, d), T.edges(spark, d), DAYS, HOPS, "all")
    return sub.groupBy("task_id", "hop").agg(F.count("*").alias("n"))


def temporal_features(spark, d):
    sub, edges = _subgraph(spark, d)
    e = T.graph_events(spark, d)
    when = F.col("date")
    told = e.select(F.concat(F.lit("event:"), "event_id").alias("node_id"), when.alias("available"), when.alias("start_date"), when.alias("end_date"), "confidence", "importance", X.event_polarity(F.col("event_type")).alias("polarity"))
    rest = T.nodes(spark, d).where("node_type <> 'Event'").select("node_id", F.when(F.col("node_type") == "Article", when).alias("available"), when.alias("start_date"), when.alias("end_date"))
    facts = told.unionByName(rest, allowMissingColumns=True).withColumn("time_confidence", F.lit(None).cast("double"))
    f = temporal.subgraph_features(sub, edges, facts, temporal.about_ticker(T.edges(spark, d)), DAYS, HOPS)
    return f.select("task_id", "node_id", *[F.round(c, 6).alias(c) for c in temporal.FEATURES])


def in_degree(spark, d):
    return T.edges(spark, d).groupBy("target").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


def anchor_strongest(spark, d):
    return graph.strongest_weight(T.edges(spark, d).where("target like 'ticker:%' and weight is not null"), "source", "target", order="edge_type").select("source", "target", F.round("weight", 6).alias("weight"))


def decayed_edges(spark, d):
    e = graph.dated_edges(T.edges(spark, d).where("edge_type = 'INVOLVES_TICKER' and weight is not null"), T.nodes(spark, d))
    age = F.datediff(F.lit("2020-01-01").cast("date"), F.col("known"))
    return e.groupBy("target").agg(F.round(F.sum(temporal.decayed_weight(F.col("weight"), age, 0.01)), 4).alias("weight"))


def message_passing(spark, d):
    f = T.vectors(spark, d).select(F.col("id").alias("node"), F.posexplode("v").alias("pos", "x"))
    e = T.vectors(spark, d).select(F.col("id").alias("src"), (F.col("id") % 17).alias("dst"), (1 + F.col("id") % 3).cast("double").alias("w"))
    return graph.message_passing(e, f).select("dst", "pos", F.round("x", 6).alias("x"))


def segment_softmax(spark, d):
    e = T.events(spark, d).select("event_id", "ticker", (F.col("confidence") * 5).alias("s"))
    return graph.segment_softmax(e, "ticker", "s").select("event_id", F.round("p", 8).alias("p"))


def attention_pool(spark, d):
    e = graph.segment_softmax(T.events(spark, d).withColumn("s", F.col("confidence") * 5), "ticker", "s")
    return e.groupBy("ticker").agg(F.round(F.sum(F.col("p") * F.col("importance")), 6).alias("pooled"), F.round(F.log1p(F.count("*")) / 5, 6).alias("volume"))


def block_offsets(spark, d):
    sizes = T.tasks(spark, d).groupBy(F.col("cutoff_date").alias("day")).agg(F.count("*").alias("n"))
    return graph.block_offsets(sizes, "day", "n")


def knn_lower_side(spark, d):
    return similarity.knn_lower_side(T.vectors(spark, d), 21, 0.3)


def semantic_edges(spark, d):
    return similarity.semantic_edges(similarity.knn_lower_side(T.vectors(spark, d), 21, 0.3), 0.4, 0.3)


def nearest_company(spark, d):
    v = T.vectors(spark, d)
    return similarity.nearest_entry(v.where("id % 2 = 0").select("id", "v"), v.where("id % 2 = 1").select(F.col("id").alias("entry"), "v"), 0.3)


def similar_components(spark, d):
    p = similarity.knn_lower_side(T.vectors(spark, d), 21, 0.3)
    return components.connected_components(p.select("left", "right")).toDF("id", "component")


def entity_key_clusters(spark, d):
    """Names of mentions that share a resolution key, as components of mentions and keys."""
    n = T.nodes(spark, d).where("node_type in ('Entity', 'EntityRawMention') and name <> ''")
    keyed = n.select("node_id", F.explode(F.array(F.lower(X.entity_name("name")), F.regexp_replace(F.lower(X.entity_name("name")), " ", ""))).alias("k")).where("k <> ''").distinct()
    parts = components.connected_components(keyed.select("node_id", F.concat(F.lit("~key:"), "k").alias("k")))
    return parts.where(~F.col("v").startswith("~key:")).groupBy("component").agg(F.count("*").alias("n"))


def _registry(spark, d):
    return T.table(spark, d, "companies").select("ticker", "company", F.from_json("aliases_json", "array<string>").alias("aliases"))


def _mentions(spark, d, events=None):
    e = T.graph_events(spark, d) if events is None else events
    main = e.where("ticker <> ''").join(F.broadcast(_registry(spark, d).select("ticker", "company")), "ticker").select("event_id", F.col("company").alias("text"), "ticker", F.lit("main_company").alias("source"))
    links = written(T.edges(spark, d).where("edge_type = 'MENTIONS_ENTITY' and event_id is not null").select("event_id", "target").distinct(), "links")
    # Nodes whose ids begin as no target does are left out before they are shuffled.
    starts = written(links.select(F.substring("target", 1, 6).alias("start")).distinct(), "starts")
    named = T.nodes(spark, d).join(starts, F.substring("node_id", 1, 6) == F.col("start"), "left_semi").select(F.col("node_id").alias("target"), "name", F.col("ticker").alias("hint"))
    typed = links.join(named, "target").select("event_id", F.col("name").alias("text"), F.col("hint").alias("ticker"), F.lit("mentioned_entity").alias("source"))
    mentions = fusion.entity_mentions(main.union(typed), _registry(spark, d))
    for t in (links, starts):
        drop_written(t)
    return mentions


def entity_mentions(spark, d):
    return _mentions(spark, d).select("mention_id", "event_id", "text", "name", "ticker", "source", F.array_join("keys", ";").alias("keys"))


def entity_fusion(spark, d):
    return fusion.entity_clusters(_mentions(spark, d), _registry(spark, d))[0]


def _fused(spark, d):
    """Entity clusters and members, event clusters, members, accepted pairs, similar pairs, and the events with their primary clusters."""
    told = written(T.graph_events(spark, d).drop("article_id"), "told")
    rows = told.count()
    entities = fusion.entity_clusters(_mentions(spark, d, told), _registry(spark, d), rows=rows)
    primary = fusion.primary_clusters(entities[1])

    def grouped(part):
        e = part(told).join(part(primary), "event_id", "left").withColumns({"grp": F.coalesce("primary", "ticker"), "event_date_start": F.col("date"), "event_date_end": F.col("date")})
        return fusion.with_exact(e.drop("date"))

    e = written_by(rows, ["event_id"], grouped, "graph_events")
    drop_written(told)
    pairs = fusion.similar_pairs(e, 0.75, 7)
    clusters, members, accepted = fusion.event_clusters(e, pairs)
    return entities, (clusters, members), accepted, pairs, e


def event_fusion(spark, d):
    return _fused(spark, d)[1][0]


def fused_members(spark, d):
    return _fused(spark, d)[1][1].drop("described")


def fusion_report(spark, d):
    entities, events, accepted, pairs, _ = _fused(spark, d)
    return fusion.fusion_report(entities, events, pairs, accepted)


def cluster_edges(spark, d):
    """All edges of the clusters; the impacts are the edges from events to the firms they bear on."""
    (_, mentions), (_, members), accepted, pairs, e = _fused(spark, d)
    for t in (accepted, pairs):
        drop_written(t)
    hit = T.table(spark, d, "graph_edges").where(F.col("edge_type").isin(*V.IMPACT_RELATIONS.values(), "RELATED_TO_ANCHOR") & F.col("source").startswith("event:") & F.col("target").rlike("^(company_)?ticker:."))
    impacts = hit.select(F.substring("source", 7, 1000).alias("event_id"), F.upper(F.substring_index("target", ":", -1)).alias("anchor"), F.col("edge_type").alias("relation"), F.coalesce("weight", X.impact_score(F.lit("neutral"))).alias("weight"))
    return fusion.cluster_edges(mentions, members, e, T.event_articles(spark, d), impacts)


def event_duplicates(spark, d):
    """Events of the same ticker, type, start and importance, with a representative: highest confidence, then smallest id."""
    e = T.events(spark, d)
    g = e.groupBy("ticker", "event_type", "event_date_start", "importance").agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("confidence", F.col("event_id"))).alias("representative"))
    return g.where("n > 1")


def majority_name(spark, d):
    n = T.table(spark, d, "graph_nodes").where("node_type = 'Event' and name is not null and date is not null").groupBy("date", "name").agg(F.count("*").alias("n"))
    w = W.partitionBy("date").orderBy(F.desc("n"), F.desc(F.length("name")), F.lower("name"), "name")
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").select("date", "name", "n")


def cluster_rollup(spark, d):
    e = T.events(spark, d)
    members = F.array_sort(F.collect_list("event_id"))
    g = e.groupBy("ticker", "event_type", "event_date_start").agg(F.count("*").alias("size"), members.alias("m"))
    return g.where("size > 1").select("ticker", "event_type", "event_date_start", "size", F.concat(F.lit("EVTC_"), X.short_sha1(F.concat_ws("|", "m"), 14)).alias("cluster_id"))


def mirrored_dedupe(spark, d):
    e = T.events(spark, d).select("event_type", "ticker", "importance", "confidence", F.array("article_id").alias("mentions"), F.col("event_id").cast("long").alias("seq"), "event_date_start")
    m = dedup.merged_mirrors(e, ["event_type", "event_date_start"], "seq")
    return m.select("event_type", "event_date_start", "ticker", F.size("mentions").alias("mentions"), "importance", F.round("confidence", 6).alias("confidence"))


def company_registry(spark, d):
    c = T.table(spark, d, "companies").select(F.lit(0).alias("phase"), F.col("ticker").alias("seq"), F.lower(X.entity_name("company")).alias("k"), F.concat(F.lit("company_ticker:"), "ticker").alias("node_id"))
    n = T.nodes(spark, d).where("node_type = 'Entity' and name <> ''").select(F.lit(1).alias("phase"), F.col("node_id").alias("seq"), F.lower(X.entity_name("name")).alias("k"), F.concat(F.lit("company:"), X.short_sha1(F.lower(X.entity_name("name")), 14)).alias("node_id"))
    return dedup.keep_first(c.unionByName(n).where("k <> ''"), ["k"], "phase", "seq").select("k", "node_id")


_NAMES = """keep_first_articles article_ids union_partitions resume_anti event_edges event_nodes article_edges chronology_edges cluster_chronology reverse_synthesis typed_tensor_index typed_edge_lists
dangling_edges duplicate_nodes edge_availability edge_type_lookup visible_nodes window_subgraph subgraph_edges all_events_subgraph in_degree anchor_strongest decayed_edges temporal_features message_passing segment_softmax
attention_pool block_offsets knn_lower_side semantic_edges nearest_company similar_components entity_key_clusters entity_mentions entity_fusion event_fusion fused_members fusion_report cluster_edges event_duplicates majority_name cluster_rollup mirrored_dedupe company_registry""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_HOP = lambda i, scope: f"""h{i} AS (SELECT DISTINCT r.task_id, r.ticker, r.cutoff, e.source AS node_id FROM h{i - 1} r JOIN inb e ON e.target = r.node_id AND (e.known IS NULL OR e.known BETWEEN r.cutoff - {DAYS} AND r.cutoff) AND (e.sd IS NULL OR e.sd >= r.cutoff - {DAYS})
  WHERE {scope} NOT EXISTS (SELECT 1 FROM ({' UNION ALL '.join(f'SELECT task_id, node_id FROM h{j}' for j in range(i))}) x WHERE x.task_id = r.task_id AND x.node_id = e.source))"""  # noqa: E731
_ABOUT = """about AS (SELECT ticker, node_id, coalesce(arg_min(w, {'a': -abs(w), 'k': kind, 'w': -w}) FILTER (w <> 0), 0) AS impact FROM (
  SELECT upper(regexp_replace(target, '^.*:', '')) AS ticker, source AS node_id, NULL::DOUBLE AS w, '' AS kind FROM edges WHERE edge_type = 'INVOLVES_TICKER' AND target LIKE 'ticker:%' UNION ALL
  SELECT upper(regexp_replace(target, '^.*:', '')), source, coalesce(weight, 0), edge_type FROM edges WHERE regexp_matches(target, '^(company_)?ticker:') AND edge_type IN ('DIRECTLY_IMPACTS_ANCHOR', 'COMPETES_WITH_ANCHOR', 'SUPPLY_CUSTOMER_IMPACT_ON_ANCHOR',
    'PARTNERS_WITH_ANCHOR', 'PEER_COMPARED_WITH_ANCHOR', 'ECOSYSTEM_IMPACT_ON_ANCHOR', 'PORTFOLIO_EXPOSURE_TO_ANCHOR', 'MACRO_IMPACT_ON_ANCHOR', 'REGULATORY_IMPACT_ON_ANCHOR', 'MARKET_SENTIMENT_IMPACT_ON_ANCHOR', 'RELATED_TO_ANCHOR')) GROUP BY 1, 2)"""
_IN_SCOPE = "(e.st <> 'Event' OR EXISTS (SELECT 1 FROM about b WHERE b.ticker = r.ticker AND b.node_id = e.source)) AND"
_SUBGRAPH = lambda scope: f"""{T.NODES}, {T.EDGES}, {T.TASKS}, {_ABOUT}, days AS (SELECT node_id, date FROM nodes WHERE node_type IN ('Event', 'Article') AND date IS NOT NULL),
known_edges AS (SELECT DISTINCT e.source, e.target, e.edge_type, coalesce(e.weight, 1) AS weight, a.node_type AS st, s.date AS sd, greatest(s.date, t.date, v.date, r.date) AS known FROM edges e JOIN nodes a ON a.node_id = e.source JOIN nodes b ON b.node_id = e.target
  LEFT JOIN days s ON s.node_id = e.source LEFT JOIN days t ON t.node_id = e.target LEFT JOIN days v ON v.node_id = 'event:' || trim(e.event_id, ' ') LEFT JOIN days r ON r.node_id = 'article:' || trim(e.article_id, ' ')),
inb AS (SELECT DISTINCT source, target, known, sd, st FROM known_edges WHERE st NOT IN ('Event', 'Article') OR sd IS NOT NULL),
h0 AS (SELECT DISTINCT task_id, ticker, cutoff_date AS cutoff, 'ticker:' || ticker AS node_id FROM tasks WHERE 'ticker:' || ticker IN (SELECT node_id FROM nodes)), {_HOP(1, scope)}, {_HOP(2, scope)}, {_HOP(3, scope)},
sub AS (SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3)"""  # noqa: E731
_SUB = _SUBGRAPH(_IN_SCOPE)
_SUBEDGES = f"""subedges AS (SELECT s.task_id, e.source, e.target, e.edge_type, e.weight * exp(-0.1::DOUBLE * greatest(0, coalesce(s.cutoff - e.known, 0))) AS weight FROM sub s JOIN known_edges e ON e.target = s.node_id AND (e.known IS NULL OR e.known BETWEEN s.cutoff - {DAYS} AND s.cutoff)
  JOIN sub t ON t.task_id = s.task_id AND t.node_id = e.source)"""
_DATED = "known AS (SELECT e.*, greatest(a.date, b.date) AS known FROM edges e LEFT JOIN nodes a ON a.node_id = e.source LEFT JOIN nodes b ON b.node_id = e.target)"
_NAME_STEPS = [
    ('["“”‘’]+', ""), (r"(?i)\s*\((?:NASDAQ|NYSE|AMEX|OTC|OTCMKTS|NYSEARCA)\s*:\s*[A-Z0-9.\-]+\)\s*", " "), (r"(?i)\s*\b(?:NASDAQ|NYSE|AMEX|OTC|OTCMKTS|NYSEARCA)\s*:\s*[A-Z0-9.\-]+\b\s*", " "), (r"[\s\x{A0}]+", " "), (r"(?i)''s\b", ""),
    (r"(?i)(?:(?:,\s*)?\b(?:incorporated|corporation|company|limited|holdings|holding|inc|corp|co|ltd|plc|llc|lp|sa|ag|nv)\.?\s*)+$", ""), (r"(?i)\b(?:Class A|Class B)\b", ""), (r"[^A-Za-z0-9&.\- ]+", " "), (r"^\s+|\s+$", ""), (r"\s+", " "), (r"[\s.,-]+$", ""),
]
_NAME = r"regexp_replace(coalesce({c}, ''), '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g')"
for _pattern, _by in _NAME_STEPS:
    _NAME = "regexp_replace(" + _NAME + ", '" + _pattern.replace("{", "{{").replace("}", "}}") + f"', '{_by}', 'g')"
_NAME = "trim(" + _NAME + ")"
_KEYS = lambda n, *more: rf"list_filter(list_transform([{', '.join([n, "regexp_replace(" + n + r", '(?i)\.com$', '')", "regexp_replace(" + n + r", '\s+', '', 'g')", *more])}], lambda x: regexp_replace(lower(trim(x)), '[\s.,-]+$', '')), lambda x: x <> '')"
_ONE = lambda l: f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"
_TIDY = r"trim(regexp_replace(coalesce({c}, ''), '[\s\x{{A0}}]+', ' ', 'g'))"
_SYM = r"regexp_replace(upper({c}), '[^A-Z0-9.\-]', '', 'g')"
_MENTIONED = f"""firm_names AS (SELECT ticker, unnest(list_concat([company, ticker], coalesce(CAST(from_json(aliases_json, '["VARCHAR"]') AS VARCHAR[]), []))) AS n FROM companies WHERE ticker IS NOT NULL),
firm_keys AS (SELECT key, min(ticker) AS anchor FROM (SELECT ticker, unnest({_KEYS('n')}) AS key FROM (SELECT ticker, {_NAME.format(c='n')} AS n FROM firm_names)) GROUP BY 1),
said AS (SELECT event_id, company AS t, gev.ticker AS k, 'main_company' AS source FROM gev JOIN companies c ON c.ticker = gev.ticker WHERE gev.ticker <> '' UNION ALL
  SELECT event_id, name, nodes.ticker, 'mentioned_entity' FROM (SELECT DISTINCT event_id, target FROM edges WHERE edge_type = 'MENTIONS_ENTITY' AND event_id IS NOT NULL) JOIN nodes ON node_id = target),
base AS (SELECT DISTINCT trim(event_id, ' ') AS event_id, {_TIDY.format(c='t')} AS text, {_SYM.format(c=_TIDY.format(c='k'))} AS given, source FROM said WHERE {_TIDY.format(c='t')} <> ''),
texts AS (SELECT text, {_NAME.format(c='text')} AS name FROM (SELECT DISTINCT text FROM base)),
anchors AS (SELECT text, arg_min(anchor, pos) AS anchor FROM (SELECT text, k[pos] AS key, pos FROM (SELECT text, k, unnest(range(1, len(k) + 1)) AS pos FROM (SELECT text, {_ONE('k')} AS k FROM (SELECT text, {_KEYS('name')} AS k FROM texts)))) JOIN firm_keys USING (key) GROUP BY 1),
resolved AS (SELECT event_id, text, name, coalesce(anchor, given) AS ticker, source FROM base JOIN texts USING (text) LEFT JOIN anchors USING (text) WHERE name <> '' OR coalesce(anchor, given) <> ''),
once AS (SELECT event_id, x.text AS text, x.name AS name, ticker, source FROM (SELECT event_id, lower(text) AS low, ticker, source, min({{'text': text, 'name': name}}) AS x FROM resolved GROUP BY 1, 2, 3, 4)),
mentioned AS (SELECT 'ENTM_' || sha1(concat_ws('|', event_id, lower(text), ticker, source))[1:18] AS mention_id, event_id, text, name, ticker, source,
  list_concat(CASE WHEN ticker <> '' THEN ['ticker:' || ticker] ELSE [] END, list_transform(list_filter({_ONE('k')}, lambda x: length(x) > 1), lambda x: 'name:' || x)) AS keys
  FROM (SELECT *, {_KEYS('name', _SYM.format(c='ticker'))} AS k FROM once))"""
_ENTITIES = """keyed AS (SELECT mention_id AS a, unnest(keys) AS b FROM mentioned), ends AS (SELECT a, b FROM keyed UNION SELECT b, a FROM keyed), reach AS (SELECT DISTINCT a AS v, a AS r FROM keyed UNION SELECT reach.v, ends.b FROM reach JOIN ends ON ends.a = reach.r),
own AS (SELECT mentioned.*, part FROM mentioned JOIN (SELECT v, min(r) AS part FROM reach GROUP BY v) ON v = mention_id),
tick AS (SELECT part, arg_min(ticker, {'n': -n, 't': ticker}) AS tk FROM (SELECT part, ticker, count(*) AS n FROM own WHERE ticker <> '' GROUP BY 1, 2) GROUP BY 1),
called AS (SELECT part, CASE WHEN name <> '' THEN name ELSE text END AS name FROM own LEFT JOIN tick USING (part) WHERE tk IS NULL OR tk = ticker),
named AS (SELECT part, arg_min(name, {'n': -n, 'l': -length(name), 'w': lower(name), 'x': name}) AS called FROM (SELECT part, name, count(*) AS n FROM called WHERE name <> '' GROUP BY 1, 2) GROUP BY 1),
seeds AS (SELECT part, count(*) AS mentions, count(DISTINCT event_id) AS events, list_sort(list(DISTINCT lower(CASE WHEN ticker <> '' THEN ticker ELSE name END))) AS s FROM own GROUP BY 1),
firms AS (SELECT ticker AS tk, min(company) AS company FROM companies GROUP BY 1),
ents AS (SELECT part, 'ENTC_' || sha1(concat_ws('|', ticker, lower(name), array_to_string(s[1:12], '|')))[1:18] AS cluster_id, name, ticker, mentions, events
  FROM (SELECT part, coalesce(company, called, tk, '') AS name, coalesce(tk, '') AS ticker, mentions, events, s FROM seeds LEFT JOIN tick USING (part) LEFT JOIN named USING (part) LEFT JOIN firms USING (tk)))"""
_EVENTED = r"""prim AS (SELECT event_id, min(cluster_id) AS p FROM own JOIN ents USING (part) WHERE source = 'main_company' GROUP BY 1),
fe AS (SELECT gev.*, coalesce(p, gev.ticker) AS grp, list_distinct(regexp_extract_all(lower(event_description), '[a-z0-9]+')) AS w FROM gev LEFT JOIN prim USING (event_id)),
sims AS (SELECT x.event_id AS l, y.event_id AS r FROM fe x JOIN fe y ON x.grp = y.grp AND x.event_type = y.event_type AND x.event_id < y.event_id AND abs(x.date - y.date) <= 7
  WHERE len(list_intersect(x.w, y.w)) > 0 AND round(len(list_intersect(x.w, y.w)) / sqrt(len(x.w)::DOUBLE * len(y.w)), 6) >= 0.75),
acc AS (SELECT l, r FROM sims JOIN fe x ON x.event_id = l JOIN fe y ON y.event_id = r WHERE (x.ticker = '' OR y.ticker = '' OR x.ticker = y.ticker) AND (len(x.metrics) = 0 OR len(y.metrics) = 0 OR list_has_any(x.metrics, y.metrics))
  AND NOT ((x.gu AND NOT x.gl AND y.gl AND NOT y.gu) OR (y.gu AND NOT y.gl AND x.gl AND NOT x.gu))),
exact_id AS (SELECT event_id, '!' || md5(concat_ws(chr(1), grp, event_type, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(event_description, '[\s\x{A0}]+', ' ', 'g'))), '\.+$', ''), '[^a-z0-9%$., ]+', ' ', 'g'), '\s+', ' ', 'g')), array_to_string(metrics, '|'), coalesce(date::VARCHAR, ''))) AS k FROM fe),
tied AS (SELECT l AS a, r AS b FROM acc UNION SELECT event_id, k FROM exact_id), two AS (SELECT a, b FROM tied UNION SELECT b, a FROM tied), near AS (SELECT event_id AS v, event_id AS r FROM fe UNION SELECT near.v, two.b FROM near JOIN two ON two.a = near.r),
inside AS (SELECT v AS event_id, min(r) FILTER (r NOT LIKE '!%') AS part FROM near GROUP BY v),
ranked_events AS (SELECT fe.*, part, row_number() OVER (PARTITION BY part ORDER BY coalesce(confidence, 0) DESC, coalesce(importance, 1) DESC, length(trim(regexp_replace(event_description, '[\s\x{A0}]+', ' ', 'g'))) DESC, event_id) AS n FROM fe JOIN inside USING (event_id)),
sized AS (SELECT part, count(*) AS size, 'EVTC_' || sha1(array_to_string(list_sort(list(event_id)), '|'))[1:18] AS cluster_id FROM inside GROUP BY part)"""
_KNN = "u AS (SELECT id, grp, v, sqrt(list_dot_product(v, v)) AS l FROM vecs), pairs AS (SELECT a.id AS \"left\", b.id AS \"right\", round(list_dot_product(a.v, b.v) / (a.l * b.l), 6) AS sim FROM u a JOIN u b USING (grp)), knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY \"left\" ORDER BY sim DESC, \"right\") AS r FROM pairs) WHERE r <= 21 AND \"left\" < \"right\" AND sim >= 0.3)"
_EVEDGES = """ee AS (SELECT 'article:' || article_id AS source, 'event:' || event_id AS target, 'REPORTS' AS edge_type FROM ev UNION ALL SELECT 'event:' || event_id, 'ticker:' || ticker, 'INVOLVES_TICKER' FROM ev
UNION ALL SELECT 'event:' || event_id, 'date:' || event_date_start, 'OCCURRED_ON' FROM ev UNION ALL SELECT 'event:' || event_id, 'date:' || event_date_start, 'PERIOD_START' FROM ev WHERE event_date_end <> event_date_start
UNION ALL SELECT 'event:' || event_id, 'date:' || event_date_end, 'PERIOD_END' FROM ev WHERE event_date_end <> event_date_start UNION ALL SELECT 'event:' || event_id, 'date:' || available_date, 'AVAILABLE_ON' FROM ev
UNION ALL SELECT 'event:' || event_id, 'event_type:' || event_type, 'HAS_TYPE' FROM ev)"""
ORACLE = {
    "keep_first_articles": r"SELECT article_id, _source_row FROM (SELECT *, row_number() OVER (PARTITION BY upper(trim(regexp_replace(_ticker, '[\s\x{A0}]+', ' ', 'g'))), CAST(_date AS DATE) ORDER BY _source_row, article_id) AS r FROM (SELECT DISTINCT * FROM articles WHERE _title IS NOT NULL AND _ticker IS NOT NULL)) WHERE r = 1",
    "article_ids": f"WITH {T.ARTICLES} SELECT article_id, 'ART_' || sha1(date || '|' || ticker || '|' || coalesce(title, '') || '|' || coalesce(url, '') || '|' || source_row)[1:14] AS made FROM arts",
    "union_partitions": "SELECT task_id, any_value(ticker) AS ticker, round(min(CASE WHEN split = 'train' THEN label_return END), 6) AS label_return FROM forecast_tasks GROUP BY 1",
    "resume_anti": f"WITH {T.ARTICLES} SELECT DISTINCT article_id FROM arts WHERE article_id NOT IN (SELECT article_id FROM graph_edges WHERE edge_type = 'REPORTS' AND article_id IS NOT NULL)",
    "event_edges": f"WITH {T.EVENTS}, {_EVEDGES} SELECT edge_type, target, count(*) AS n FROM ee GROUP BY 1, 2",
    "event_nodes": f"""WITH {T.EVENTS} SELECT 'event:' || event_id AS node_id, 'Event' AS node_type FROM ev UNION SELECT 'ticker:' || ticker, 'Ticker' FROM ev UNION SELECT 'date:' || event_date_start, 'Date' FROM ev
UNION SELECT 'date:' || event_date_end, 'Date' FROM ev UNION SELECT 'date:' || available_date, 'Date' FROM ev UNION SELECT 'event_type:' || event_type, 'EventType' FROM ev""",
    "article_edges": f"WITH {T.ARTICLES} SELECT 'article:' || article_id AS source, 'ticker:' || ticker AS target, 'ABOUT_TICKER' AS edge_type FROM arts UNION SELECT 'article:' || article_id, 'date:' || date, 'PUBLISHED_ON' FROM arts",
    "chronology_edges": f"""WITH {T.EVENTS}, c AS (SELECT event_id, lead(event_id) OVER (PARTITION BY ticker ORDER BY event_date_start, event_id) AS a, lead(event_id) OVER (PARTITION BY ticker ORDER BY available_date, event_id) AS b FROM ev)
SELECT event_id AS source, a AS target, 'EVENT_PRECEDES' AS edge_type FROM c WHERE a IS NOT NULL UNION ALL SELECT event_id, b, 'REPORT_PRECEDES' FROM c WHERE b IS NOT NULL""",
    "cluster_chronology": f"WITH {T.EVENTS}, f AS (SELECT ticker, event_type || '_' || importance AS c, min(event_date_start) AS d FROM ev GROUP BY 1, 2), l AS (SELECT ticker, c AS source, lead(c) OVER (PARTITION BY ticker ORDER BY d, c) AS target FROM f) SELECT * FROM l WHERE target IS NOT NULL",
    "reverse_synthesis": f"""WITH {T.EDGES}, e AS (SELECT source, target, CASE WHEN edge_type = 'REPORTS' THEN 'REV_REPORTED' ELSE edge_type END AS edge_type FROM edges),
o AS (SELECT DISTINCT edge_type FROM e WHERE edge_type NOT LIKE 'REV!_%' ESCAPE '!' AND 'REV_' || edge_type NOT IN (SELECT edge_type FROM e)),
a AS (SELECT * FROM e UNION ALL SELECT target, source, 'REV_' || edge_type FROM e WHERE edge_type IN (SELECT edge_type FROM o)) SELECT edge_type, count(*) AS n, count(DISTINCT target) AS targets FROM a GROUP BY 1""",
    "typed_tensor_index": f"WITH {T.NODES} SELECT node_type, count(*) AS n, CAST(0 AS BIGINT) AS least, count(*) - 1 AS most, count(DISTINCT node_id) AS different FROM nodes GROUP BY 1",
    "typed_edge_lists": f"WITH {T.NODES}, {T.EDGES} SELECT a.node_type AS source_type, e.edge_type, b.node_type AS target_type, count(*) AS edges, round(sum(e.weight), 4) AS weight FROM edges e JOIN nodes a ON a.node_id = e.source JOIN nodes b ON b.node_id = e.target GROUP BY 1, 2, 3",
    "dangling_edges": f"WITH {T.NODES}, {T.EDGES} SELECT DISTINCT source, target, 'source' AS side FROM edges WHERE source NOT IN (SELECT node_id FROM nodes) UNION ALL SELECT DISTINCT source, target, 'target' FROM edges WHERE target NOT IN (SELECT node_id FROM nodes)",
    "duplicate_nodes": "SELECT node_id, count(*) AS n FROM graph_nodes GROUP BY 1 HAVING count(*) > 1",
    "edge_availability": f"WITH {T.NODES}, {T.EDGES}, {_DATED} SELECT edge_type, known, count(*) AS n FROM known GROUP BY 1, 2",
    "edge_type_lookup": f"WITH {T.NODES}, {T.EDGES} SELECT coalesce(a.node_type, '') AS source_type, coalesce(b.node_type, '') AS target_type, count(*) AS n FROM edges e LEFT JOIN nodes a ON a.node_id = e.source LEFT JOIN nodes b ON b.node_id = e.target GROUP BY 1, 2",
    "visible_nodes": f"WITH {T.NODES}, {T.TASKS} SELECT task_id, count(DISTINCT node_id) AS n FROM tasks JOIN nodes ON date BETWEEN cutoff_date - {DAYS} AND cutoff_date GROUP BY 1",
    "window_subgraph": f"WITH {_SUB} SELECT task_id, node_id, hop FROM sub",
    "all_events_subgraph": f"WITH {_SUBGRAPH('')} SELECT task_id, hop, count(*) AS n FROM sub GROUP BY 1, 2",
    "subgraph_edges": f"WITH {_SUB}, {_SUBEDGES} SELECT task_id, count(*) AS n, round(sum(weight), 4) AS weight FROM subedges GROUP BY 1",
    "temporal_features": f"""WITH {_SUB}, {_SUBEDGES}, {T.GRAPH_EVENTS}, deg AS (SELECT task_id, target AS node_id, count(*) AS n FROM subedges GROUP BY 1, 2),
x AS (SELECT s.task_id, s.node_id, s.hop, s.cutoff, CASE WHEN n.node_type IN ('Event', 'Article') THEN n.date END AS av, n.date AS d, e.confidence AS c, e.importance AS i, e.event_type AS k, coalesce(deg.n, 0) AS n, coalesce(b.impact, 0) AS impact
  FROM sub s JOIN nodes n USING (node_id) LEFT JOIN gev e ON 'event:' || e.event_id = s.node_id LEFT JOIN deg ON deg.task_id = s.task_id AND deg.node_id = s.node_id LEFT JOIN about b ON b.ticker = s.ticker AND b.node_id = s.node_id),
y AS (SELECT *, greatest(0, coalesce(cutoff - av, 0)) AS age FROM x)
SELECT task_id, node_id, round(exp(-age / 2.0::DOUBLE), 6) AS f0, round(least(age / 2.0::DOUBLE, 10), 6) AS f1, round(CASE WHEN d IS NULL THEN 0 ELSE least(greatest((d - cutoff) / 365.0::DOUBLE, -5), 5) END, 6) AS f2, round(CASE WHEN d IS NULL THEN 0 ELSE least(greatest((d - cutoff) / 365.0::DOUBLE, -5), 5) END, 6) AS f3,
0.0::DOUBLE AS f4, 0.0::DOUBLE AS f5, round(least(greatest(coalesce(c, 0), 0), 1), 6) AS f6, round(CASE WHEN i IS NULL THEN 0 ELSE least(greatest(i / 3.0::DOUBLE, 0), 1) END, 6) AS f7, CAST(coalesce(d > cutoff, false) AS INT)::DOUBLE AS f8, CAST(av IS NOT NULL AS INT)::DOUBLE AS f9,
CASE WHEN k IN ('revenue_growth', 'profit_growth', 'analyst_upgrade', 'product_launch', 'partnership', 'dividend_announcement', 'share_buyback', 'market_cap_milestone', 'market_share') THEN 1.0::DOUBLE
WHEN k IN ('revenue_decline', 'profit_decline', 'analyst_downgrade', 'lawsuit', 'regulatory_investigation', 'layoffs', 'debt_financing', 'supply_chain_event') THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS f10,
CAST(hop = 1 AS INT)::DOUBLE AS f11, round(hop / 3.0::DOUBLE, 6) AS f12, round(least(ln(1 + n) / 5, 2), 6) AS f13, round(impact, 6) AS f14, round(CASE WHEN d IS NULL THEN 1 ELSE exp(-abs(d - cutoff) / 30.0::DOUBLE) END, 6) AS f15 FROM y""",
    "in_degree": f"WITH {T.EDGES} SELECT target, count(*) AS n, count(DISTINCT source) AS sources FROM edges GROUP BY 1",
    "anchor_strongest": f"WITH {T.EDGES} SELECT source, target, round(arg_min(weight, {{'a': -abs(weight), 'o': edge_type, 'b': -weight}}), 6) AS weight FROM edges WHERE target LIKE 'ticker:%' AND weight <> 0 GROUP BY 1, 2",
    "decayed_edges": f"WITH {T.NODES}, {T.EDGES}, {_DATED} SELECT target, round(sum(weight * exp(-0.01 * greatest(0, coalesce(DATE '2020-01-01' - known, 0)))), 4) AS weight FROM known WHERE edge_type = 'INVOLVES_TICKER' AND weight IS NOT NULL GROUP BY 1",
    "message_passing": f"""WITH {T.VECTORS}, f AS (SELECT id, unnest(v) AS x, unnest(range(0, len(v))) AS pos FROM vecs), e AS (SELECT id, id % 17 AS dst, (1 + id % 3)::DOUBLE AS w FROM vecs), s AS (SELECT dst, sqrt(greatest(1, sum(abs(w)))) AS scale FROM e GROUP BY 1)
SELECT dst, CAST(pos AS INT) AS pos, round(sum(w * x) / any_value(scale), 6) AS x FROM e JOIN f USING (id) JOIN s USING (dst) GROUP BY 1, 2""",
    "segment_softmax": f"WITH {T.EVENTS}, x AS (SELECT event_id, ticker, exp(confidence * 5 - max(confidence * 5) OVER (PARTITION BY ticker)) AS e FROM ev) SELECT event_id, round(e / sum(e) OVER (PARTITION BY ticker), 8) AS p FROM x",
    "attention_pool": f"WITH {T.EVENTS}, x AS (SELECT ticker, importance, exp(confidence * 5 - max(confidence * 5) OVER (PARTITION BY ticker)) AS e FROM ev) SELECT ticker, round(sum(e * importance) / sum(e), 6) AS pooled, round(ln(1 + count(*)) / 5, 6) AS volume FROM x GROUP BY 1",
    "block_offsets": f"WITH {T.TASKS}, s AS (SELECT cutoff_date AS day, count(*) AS n FROM tasks GROUP BY 1) SELECT day, n, CAST(coalesce(sum(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM s",
    "knn_lower_side": f"WITH {T.VECTORS}, {_KNN} SELECT \"left\", \"right\", sim FROM knn",
    "semantic_edges": f"WITH {T.VECTORS}, {_KNN} SELECT \"left\" AS source, \"right\" AS target, CASE WHEN sim >= 0.4 THEN 'SAME_AS' ELSE 'RELATED_TO' END AS edge_type, sim AS weight FROM knn",
    "nearest_company": f"WITH {T.VECTORS}, u AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS l FROM vecs), s AS (SELECT a.id, b.id AS entry, round(list_dot_product(a.v, b.v) / (a.l * b.l), 6) AS sim FROM u a JOIN u b ON a.id % 2 = 0 AND b.id % 2 = 1) SELECT id, entry, sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, entry) AS r FROM s) WHERE r = 1 AND sim >= 0.3",
    "similar_components": f"WITH RECURSIVE {T.VECTORS}, {_KNN}, b AS (SELECT \"left\" AS a, \"right\" AS b FROM knn UNION SELECT \"right\", \"left\" FROM knn), r AS (SELECT a AS v, a AS w FROM b UNION SELECT r.v, b.b FROM r JOIN b ON b.a = r.w) SELECT v AS id, min(w) AS component FROM r GROUP BY 1",
    "entity_key_clusters": f"""WITH RECURSIVE {T.NODES}, n AS (SELECT node_id, lower({_NAME.format(c='name')}) AS k FROM nodes WHERE node_type IN ('Entity', 'EntityRawMention') AND name <> ''), keyed AS (SELECT node_id, k FROM n WHERE k <> '' UNION SELECT node_id, replace(k, ' ', '') FROM n WHERE k <> ''),
least AS (SELECT k, min(node_id) AS hub FROM keyed GROUP BY k), e AS (SELECT node_id AS a, hub AS b FROM keyed JOIN least USING (k) UNION SELECT hub, node_id FROM keyed JOIN least USING (k)), r AS (SELECT a AS v, a AS w FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.w)
SELECT component, count(*) AS n FROM (SELECT v, min(w) AS component FROM r GROUP BY 1) GROUP BY 1""",
    "entity_mentions": f"WITH {T.NODES}, {T.EDGES}, {T.GRAPH_EVENTS}, {_MENTIONED} SELECT mention_id, event_id, text, name, ticker, source, array_to_string(keys, ';') AS keys FROM mentioned",
    "entity_fusion": f"WITH RECURSIVE {T.NODES}, {T.EDGES}, {T.GRAPH_EVENTS}, {_MENTIONED}, {_ENTITIES} SELECT cluster_id, name, ticker, mentions, events FROM ents",
    "event_fusion": f"WITH RECURSIVE {T.NODES}, {T.EDGES}, {T.GRAPH_EVENTS}, {_MENTIONED}, {_ENTITIES}, {_EVENTED} SELECT cluster_id, event_id AS representative, size, ticker, event_type, date AS event_date_start, date AS event_date_end, event_description AS description FROM ranked_events JOIN sized USING (part) WHERE n = 1",
    "fused_members": f"WITH RECURSIVE {T.NODES}, {T.EDGES}, {T.GRAPH_EVENTS}, {_MENTIONED}, {_ENTITIES}, {_EVENTED} SELECT cluster_id, event_id, n = 1 AS is_representative, size FROM ranked_events JOIN sized USING (part)",
    "fusion_report": f"""WITH RECURSIVE {T.NODES}, {T.EDGES}, {T.GRAPH_EVENTS}, {_MENTIONED}, {_ENTITIES}, {_EVENTED} SELECT (SELECT count(*) FROM fe) AS event_count, (SELECT count(*) FROM sized) AS event_cluster_count, (SELECT count(*) FROM sized WHERE size > 1) AS event_multi_member_cluster_count,
(SELECT count(*) FROM inside JOIN sized USING (part) WHERE size > 1) AS event_fused_member_count, (SELECT count(*) FROM mentioned) AS entity_mention_count, (SELECT count(*) FROM ents) AS entity_cluster_count, (SELECT count(*) FROM ents WHERE mentions > 1) AS entity_multi_member_cluster_count,
(SELECT count(*) FROM sims) AS event_pairs_considered, (SELECT count(*) FROM acc) AS event_pairs_accepted""",
    "event_duplicates": f"WITH {T.EVENTS} SELECT ticker, event_type, event_date_start, importance, count(*) AS n, arg_max(event_id, {{'c': confidence, 'e': event_id}}) AS representative FROM ev GROUP BY 1, 2, 3, 4 HAVING count(*) > 1",
    "majority_name": "SELECT date, name, n FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY n DESC, length(name) DESC, lower(name), name) AS r FROM (SELECT date, name, count(*) AS n FROM graph_nodes WHERE node_type = 'Event' AND name IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2)) WHERE r = 1",
    "cluster_rollup": f"WITH {T.EVENTS} SELECT ticker, event_type, event_date_start, count(*) AS size, 'EVTC_' || sha1(array_to_string(list_sort(list(event_id)), '|'))[1:14] AS cluster_id FROM ev GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "mirrored_dedupe": f"WITH {T.EVENTS} SELECT event_type, event_date_start, arg_min(ticker, CAST(event_id AS BIGINT)) AS ticker, CAST(count(DISTINCT article_id) AS INT) AS mentions, max(importance) AS importance, round(max(confidence), 6) AS confidence FROM ev GROUP BY 1, 2",
    "company_registry": f"""WITH {T.NODES}, c AS (SELECT 0 AS phase, ticker AS seq, lower({_NAME.format(c='company')}) AS k, 'company_ticker:' || ticker AS node_id FROM companies
UNION ALL SELECT 1, node_id, lower({_NAME.format(c='name')}), 'company:' || sha1(lower({_NAME.format(c='name')}))[1:14] FROM nodes WHERE node_type = 'Entity' AND name <> '')
SELECT k, node_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY phase, seq) AS r FROM c WHERE k <> '') WHERE r = 1""",
}
