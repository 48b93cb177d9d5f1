"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import components, cross_split, leakage, mixing, names, near, nearest_time, residue, site_lines
from loomgraph.llm.cross_split import ticker_key

SIX_HOURS = 6 * 3600


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark, d):
    return cross_split.article_overlaps(_t(spark, d, "articles"), _t(spark, d, "forecast_tasks")).select(F.col("id").alias("article_id"), "split")


def p1_overlap_report(spark, d):
    """split, site, overlaps, exact: how many evaluation articles of each split and site stand in the training split."""
    articles = _t(spark, d, "articles")
    found = cross_split.article_overlaps(articles, _t(spark, d, "forecast_tasks"))
    sites = articles.select(F.col("article_id").alias("id"), F.coalesce(site_lines.site_of("_url"), F.lit("")).alias("site")).distinct()
    return found.join(sites, "id").groupBy("split", "site").agg(F.count("*").alias("overlaps"), F.count_if("exact").alias("exact"))


def p2_found(spark, d):
    return site_lines.repeated_lines(_t(spark, d, "articles"))


def p2_blocks(spark, d):
    return site_lines.boilerplate_blocks(_t(spark, d, "articles"))


def p2_cleaned(spark, d):
    return site_lines.without_repeated_lines(_t(spark, d, "articles"))


def p3_found(spark, d):
    articles = _t(spark, d, "articles").select(F.col("article_id").alias("id"), ticker_key("_ticker").alias("entity"), F.col("_date").alias("t"))
    examples = _t(spark, d, "temporal_examples").select(F.col("task_id").alias("id"), ticker_key("ticker").alias("entity"), F.col("current_date").alias("t"))
    return nearest_time.nearest_in_time(articles, examples, SIX_HOURS).select(F.col("id").alias("article_id"), F.col("match").alias("task_id"))


def p4_found(spark, d):
    return near.near_pairs(near.article_records(_t(spark, d, "articles"))).select(F.col("id_a").alias("article_id_a"), F.col("id_b").alias("article_id_b"))


def p4_classes(spark, d):
    return near.near_duplicate_classes(near.article_records(_t(spark, d, "articles")))


def p4_groups(spark, d):
    return near.near_duplicate_groups(near.article_records(_t(spark, d, "articles")))


def p5_found(spark, d):
    return components.event_groups(_t(spark, d, "graph_nodes"), _t(spark, d, "graph_edges"))


def p5_group_sizes(spark, d):
    """group_id, nodes: the size of each group of tied events."""
    return p5_found(spark, d).groupBy("group_id").agg(F.count("*").alias("nodes"))


def p7_found(spark, d):
    return leakage.shared_runs(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p7_passages(spark, d):
    return leakage.leaked_passages(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p7_leaked_items(spark, d):
    return leakage.leaked_items(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_overlap_report, p2_found, p2_blocks, p2_cleaned, p3_found, p4_found, p4_classes, p4_groups, p5_found, p5_group_sizes, p7_found, p7_passages, p7_leaked_items)
}

_SITE = r"""nullif(regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower(trim(_url, E' \t\n\r ')), '^([a-z][a-z0-9+.\-]*:)?//', ''), '^[^/?#\\]*'), '^.*@|:\d*$', '', 'g'), '^(www|m|amp)\.', ''), '')"""
_LINES = rf"""
places AS (
  SELECT DISTINCT article_id, site, line_no, trim(regexp_replace(regexp_replace(lower(lines[line_no]), '[0-9]+', '#', 'g'), '[\s\x{{A0}}]+', ' ', 'g')) AS line
  FROM (SELECT article_id, site, lines, unnest(range(1, len(lines) + 1))::INT AS line_no
        FROM (SELECT article_id, {_SITE} AS site, string_split(replace(_article, chr(13), ''), chr(10)) AS lines FROM articles WHERE _article IS NOT NULL))
  WHERE site IS NOT NULL),
common AS (SELECT site, line FROM places WHERE line <> '' GROUP BY site, line HAVING count(DISTINCT article_id) >= 8)"""
_RUNS = """
runs AS (
  SELECT DISTINCT article_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS run
  FROM (SELECT article_id, w, unnest(range(1, len(w) - 1)) AS i
        FROM (SELECT DISTINCT article_id, regexp_extract_all(lower(coalesce(_title, '') || chr(10) || _article), '[a-z0-9]+') AS w
              FROM articles WHERE regexp_matches(_article, '[^\\s\\x{A0}]')))),
sizes AS (SELECT article_id, count(*) AS n FROM runs GROUP BY article_id),
alike AS (
  SELECT a AS article_id_a, b AS article_id_b
  FROM (SELECT x.article_id AS a, y.article_id AS b, count(*) AS k FROM runs x JOIN runs y ON x.run = y.run AND x.article_id < y.article_id GROUP BY 1, 2)
  JOIN sizes p ON p.article_id = a JOIN sizes q ON q.article_id = b WHERE 2 * k >= p.n + q.n - k)""".replace("\\\\", "\\")
_CLASSES = r"""
arts AS (SELECT DISTINCT article_id, regexp_extract_all(lower(coalesce(_title, '') || chr(10) || _article), '[a-z0-9]+') AS w FROM articles WHERE regexp_matches(_article, '[^\s\x{A0}]')),
members AS (SELECT article_id AS id, min(article_id) OVER (PARTITION BY CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE '!' || article_id END) AS class_id, w FROM arts),
fives AS (
  SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS run
  FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM members WHERE id = class_id)),
counts AS (SELECT id, count(*) AS n FROM fives GROUP BY id),
linked AS (
  SELECT a, b FROM (SELECT x.id AS a, y.id AS b, count(*) AS k FROM fives x JOIN fives y ON x.run = y.run AND x.id <> y.id GROUP BY 1, 2)
  JOIN counts p ON p.id = a JOIN counts q ON q.id = b WHERE k >= 0.8::DOUBLE * (p.n + q.n - k))"""
_KEY = r"nullif(upper(regexp_replace({}, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g')), '')"
_SPLITS = f"""
splits AS (
  SELECT DISTINCT article_id, split FROM articles JOIN forecast_tasks
  ON {_KEY.format('_ticker')} = {_KEY.format('ticker')} AND CAST(_date AS DATE) = cutoff_date)"""
_TIED = r"""
events AS (SELECT DISTINCT node_id FROM graph_nodes WHERE node_type = 'Event'),
pairs AS (
  SELECT DISTINCT coalesce('event:' || trim(event_id, E' \t\n\r'), source) AS a, target AS b FROM graph_edges WHERE edge_type = 'SAME_AS'),
ties AS (SELECT a, b FROM pairs WHERE a <> b AND a IN (SELECT node_id FROM events) AND b IN (SELECT node_id FROM events)),
both_ways AS (SELECT a, b FROM ties UNION SELECT b, a FROM ties),
reach AS (SELECT a AS v, a AS r FROM both_ways UNION SELECT reach.v, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r),
groups AS (SELECT v AS node_id, min(r) AS group_id FROM reach GROUP BY v)"""
_LEAKS = """
docs AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
items AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items WHERE text IS NOT NULL),
leaks AS (
  SELECT DISTINCT doc_id, item_id
  FROM (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM docs))
  JOIN (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM items)) USING (run))"""

ORACLE: dict[str, str] = {
    "p1_found": f"""WITH {_RUNS}, {_SPLITS}
SELECT DISTINCT e.article_id, e.split FROM splits e JOIN (SELECT article_id_a AS a, article_id_b AS b FROM alike UNION SELECT article_id_b, article_id_a FROM alike) p ON p.a = e.article_id
JOIN splits t ON t.article_id = p.b AND t.split = 'train' WHERE e.split IN ('val', 'test')""",
    "p2_found": f"WITH {_LINES} SELECT DISTINCT article_id, line_no FROM places JOIN common USING (site, line)",
    "p2_cleaned": f"""WITH {_LINES}, gone AS (SELECT article_id, list(DISTINCT line_no) AS g FROM places JOIN common USING (site, line) GROUP BY 1)
SELECT a.article_id, CASE WHEN _article IS NOT NULL THEN array_to_string(list_filter(string_split(replace(_article, chr(13), ''), chr(10)), lambda x, i: NOT list_contains(coalesce(g, []), i)), chr(10)) END AS text, CAST(coalesce(len(g), 0) AS INT) AS removed
FROM (SELECT DISTINCT article_id, _article FROM articles) a LEFT JOIN gone USING (article_id)""",
    "p2_blocks": f"""WITH RECURSIVE {_LINES}, nodes AS (SELECT site, line, count(DISTINCT article_id) AS articles FROM places JOIN common USING (site, line) GROUP BY 1, 2),
seqd AS (SELECT *, row_number() OVER (PARTITION BY article_id, site ORDER BY line_no) AS seq FROM places WHERE line <> ''),
steps AS (SELECT DISTINCT x.article_id, x.site, x.line AS p, y.line AS q FROM seqd x JOIN seqd y ON y.article_id = x.article_id AND y.site = x.site AND y.seq = x.seq + 1 WHERE x.line <> y.line),
kept AS (SELECT site, p, q FROM steps GROUP BY ALL HAVING count(*) >= 8), ends AS (SELECT site, p, q FROM kept UNION SELECT site, q, p FROM kept),
reach AS (SELECT site, line AS v, line AS r FROM nodes UNION SELECT reach.site, v, q FROM reach JOIN ends ON ends.site = reach.site AND ends.p = reach.r),
names AS (SELECT site, v AS line, min(r) AS block FROM reach GROUP BY 1, 2)
SELECT site, line, articles, block FROM nodes JOIN names USING (site, line)""",
    "p3_found": f"""WITH a AS (SELECT DISTINCT article_id, {_KEY.format('_ticker')} AS k, _date AS t FROM articles WHERE _date IS NOT NULL),
e AS (SELECT DISTINCT task_id, {_KEY.format('ticker')} AS k, "current_date" AS t FROM temporal_examples WHERE "current_date" IS NOT NULL),
near AS (SELECT article_id, task_id, row_number() OVER (PARTITION BY article_id, a.t ORDER BY abs(epoch_us(a.t) - epoch_us(e.t)), e.t, task_id) AS n
FROM a JOIN e ON a.k = e.k AND e.t BETWEEN a.t - INTERVAL 6 HOUR AND a.t + INTERVAL 6 HOUR)
SELECT article_id, task_id FROM near WHERE n = 1""",
    "p4_found": f"WITH {_RUNS} SELECT article_id_a, article_id_b FROM alike",
    "p1_overlap_report": f"""WITH {_RUNS}, {_SPLITS},
twins AS (SELECT DISTINCT article_id, array_to_string(regexp_extract_all(lower(coalesce(_title, '') || chr(10) || _article), '[a-z0-9]+'), ' ') AS w FROM articles WHERE _article IS NOT NULL),
found AS (SELECT DISTINCT e.article_id, e.split FROM splits e JOIN (SELECT article_id_a AS a, article_id_b AS b FROM alike UNION SELECT article_id_b, article_id_a FROM alike) p ON p.a = e.article_id
  JOIN splits t ON t.article_id = p.b AND t.split = 'train' WHERE e.split IN ('val', 'test')),
same AS (SELECT DISTINCT x.article_id FROM twins x JOIN twins y ON x.w = y.w AND x.article_id <> y.article_id JOIN splits t ON t.article_id = y.article_id AND t.split = 'train'),
sites AS (SELECT DISTINCT article_id, coalesce({_SITE}, '') AS site FROM articles)
SELECT split, site, count(*) AS overlaps, count(*) FILTER (article_id IN (SELECT article_id FROM same)) AS exact FROM found JOIN sites USING (article_id) GROUP BY 1, 2""",
    "p4_classes": f"WITH {_CLASSES} SELECT m.id, m.class_id, count(l.b) AS links FROM members m LEFT JOIN linked l ON l.a = m.class_id GROUP BY 1, 2",
    "p4_groups": f"""WITH RECURSIVE {_RUNS}, ends AS (SELECT article_id_a AS a, article_id_b AS b FROM alike UNION SELECT article_id_b, article_id_a FROM alike),
reach AS (SELECT a AS v, a AS r FROM ends UNION SELECT reach.v, ends.b FROM reach JOIN ends ON ends.a = reach.r)
SELECT v AS id, min(r) AS group_id FROM reach GROUP BY v""",
    "p5_found": f"WITH RECURSIVE {_TIED} SELECT node_id, group_id FROM groups",
    "p5_group_sizes": f"WITH RECURSIVE {_TIED} SELECT group_id, count(*) AS nodes FROM groups GROUP BY group_id",
    "p7_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM leaks",
    "p7_leaked_items": f"""WITH {_LEAKS} SELECT i.item_id, i.category, count(leaks.doc_id) AS documents
FROM (SELECT DISTINCT item_id, category FROM eval_items) i LEFT JOIN leaks USING (item_id) GROUP BY i.item_id, i.category""",
}


def p8_mix(spark, d):
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[0]


def p8_shares(spark, d):
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[1]


def p9_found(spark, d):
    return residue.residue_documents(_t(spark, d, "documents"))


def p9_coverage(spark, d):
    return residue.residue_coverage(_t(spark, d, "documents"))


def p6_found(spark, d):
    return names.linked_nodes(_t(spark, d, "graph_nodes"), _t(spark, d, "companies"))


def p6_variants(spark, d):
    return names.variant_counts(_t(spark, d, "graph_nodes"), _t(spark, d, "companies"))


QUERIES |= {f.__name__: f for f in (p6_found, p6_variants, p8_mix, p8_shares, p9_found, p9_coverage)}
