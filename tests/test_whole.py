"""Queries and operators over the whole of what they stand for, where they once left some of it out."""

import datetime as dt
import time

from pyspark.sql import functions as F

from loomgraph import scratch
from loomgraph.operators import components, dedup, fusion, graph
from loomgraph.plans import graph_queries, record_queries, series_queries
from loomgraph.streaming import news


def test_backfill_of_years_over_more_files_than_a_trigger_takes(spark, tmp_path):
    day = lambda n: dt.datetime(2010, 1, 1) + dt.timedelta(days=n)
    rows = spark.createDataFrame([(f"a{i % 500}", day(37 * i % 4000)) for i in range(600)], "article_id string, _date timestamp")
    rows.repartition(12).write.parquet(str(tmp_path / "src"))
    got = news.arrivals(spark, str(tmp_path / "src"), rows.schema, files=2)
    query = news.ingest(got, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(300)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("batch").distinct().count() > 2
    assert sorted(r.article_id for r in out.collect()) == sorted({f"a{i}" for i in range(500)})


def test_portfolio_expand_finds_banks_bodies_and_whole_names(spark, tmp_path):
    spark.createDataFrame([("BKA", "Bank of Alder Corp.", "[]"), ("BKB", "Bank of Birch plc", '["Old Birch"]'), ("ALM", "Alder Mining Group", None), ("ALT", "Alder Timber Group", None)], "ticker string, company string, aliases_json string").write.parquet(str(tmp_path / "companies.parquet"))
    day = dt.datetime(2020, 1, 1)
    rows = [("a1", 1, "ALM", day, "Alder Mining meets the Bank of Alder", "Nothing.", "u"), ("a2", 2, "ALM", day, None, "It owes old birch.", "u"), ("a3", 3, "ALM", day, "Bank", "of Birch", "u")]
    spark.createDataFrame(rows, "article_id string, _source_row long, _ticker string, _date timestamp, _title string, _article string, _url string").write.parquet(str(tmp_path / "articles.parquet"))
    got = {tuple(r) for r in record_queries.portfolio_expand(spark, str(tmp_path)).collect()}
    assert got == {("a1", "BKA"), ("a2", "BKB")}


def test_compatible_pairs_follow_the_whole_predicate(spark):
    day = lambda n: None if n is None else dt.date(2020, 1, 1) + dt.timedelta(days=n)
    rows = [("1", "A", "view", 0, 0, ["5"], 0.1), ("2", "A", "view", 7, 7, ["5", "6"], 1.0), ("3", "A", "view", 8, 8, ["5"], 0.1), ("4", "A", "view", 1, 1, ["9"], 0.1), ("5", "A", "view", 0, 0, [], -1.0),
            ("6", "A", "click", 0, 0, ["5"], 0.1), ("7", "B", "view", 0, 0, ["5"], 0.1), ("8", "A", "view", None, None, ["9"], 0.1), ("9", None, "view", 0, 0, ["5"], 0.1)]
    e = spark.createDataFrame([(i, t, k, day(s), day(x), m, p) for i, t, k, s, x, m, p in rows], "event_id string, ticker string, event_type string, event_date_start date, event_date_end date, metrics array<string>, impact double")
    got = {(r.a, r.b) for r in dedup.compatible_pairs(e).collect()}
    assert got == {("1", "2"), ("1", "5"), ("2", "3"), ("4", "5"), ("4", "8"), ("5", "8")}


def test_pair_compatible_takes_all_types(spark):
    d = "/root/testdata/sf0.001"
    e = record_queries.T.events(spark, d).toPandas()
    e["at"] = e["event_date_start"].map(lambda x: x.toordinal())
    e["to"] = e["event_date_end"].map(lambda x: x.toordinal())
    want = {}
    for (ticker, _), g in e.groupby(["ticker", "event_type"]):
        v = list(zip(g["at"], g["to"], g["metrics"].map(set)))
        n = sum(abs(x[0] - y[0]) <= 7 and abs(x[1] - y[1]) <= 7 and bool(x[2] & y[2]) for i, x in enumerate(v) for y in v[:i])
        want[ticker] = want.get(ticker, 0) + n
    assert {r.ticker: r.pairs for r in record_queries.pair_compatible(spark, d).collect()} == {t: n for t, n in want.items() if n}


def test_numbering_shuffle_and_interpolation_take_all_rows(spark):
    d = "/root/testdata/sf0.001"
    p = record_queries.T.prices(spark, d).select("ticker", "date").collect()
    want = {(r.ticker, r.date): f"TASK_{i:08}" for i, r in enumerate(sorted(p, key=lambda r: (r.date, r.ticker)))}
    assert {(r.ticker, r.date): r.task_id for r in series_queries.task_numbering(spark, d).collect()} == want
    assert max(r.date for r in record_queries.interpolated_series(spark, d).collect()).year > 1996
    e = record_queries.T.edges(spark, d).select("source", "target", "edge_type").distinct()
    count = lambda df: {r.edge_type: r["count"] for r in df.groupBy("edge_type").count().collect()}
    assert count(record_queries.relation_shuffle(spark, d)) == count(e)
    dealt = graph.shuffled_relations(e, 5)
    assert count(dealt) == count(e) and dealt.exceptAll(e).count() > e.count() / 4


def test_message_passing_sums_every_position(spark):
    d = "/root/testdata/sf0.001"
    v = record_queries.T.vectors(spark, d).collect()
    want = {}
    for dst in {r.id % 17 for r in v}:
        own = [r for r in v if r.id % 17 == dst]
        scale = max(1.0, sum(1 + r.id % 3 for r in own)) ** 0.5
        want |= {(dst, k): sum((1 + r.id % 3) * r.v[k] for r in own) / scale for k in range(len(own[0].v))}
    got = {(r.dst, r.pos): r.x for r in graph_queries.message_passing(spark, d).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def _events(spark, rows):
    day = lambda n: None if n is None else dt.date(2020, 1, 1) + dt.timedelta(days=n)
    kind = "event_id string, grp string, ticker string, event_type string, event_date_start date, event_date_end date, event_description string, metrics array<string>, impact double, importance int, confidence double"
    return spark.createDataFrame([(i, "G", t, k, day(d), day(d), text, [], 0.1, 1, 0.5) for i, t, k, d, text in rows], kind)


def test_copies_of_an_event_are_a_pair_that_stands_for_all(spark):
    rows = [(f"c{i:03}", "A", "view", 0, "Sales of the unit rose.") for i in range(300)] + [("d", "B", "view", 7, "sales of the unit rose today"), ("e", "A", "view", 15, "sales of the unit rose"), ("f", "A", "view", None, "sales of the unit rose"), ("g", "A", "view", 0, "!")]
    e = _events(spark, rows)
    pairs = fusion.similar_pairs(e, 0.75, 7)
    got = {(r.left, r.right): (r.n, r.sim) for r in pairs.collect()}
    assert got == {("c000", "c000"): (300 * 299 // 2, 1.0), ("c000", "d"): (300, 0.912871)}


def test_blocks_of_a_slot_find_the_pairs_of_brute_force(spark):
    import itertools
    import random

    r = random.Random(5)
    rows = [(f"e{i:03}", "A", r.choice(["view", "click"]), r.randrange(40), " ".join(r.sample(["up", "by", "rate", "loss", "gain", "unit"], r.randrange(1, 6)))) for i in range(150)]
    want = 0
    for x, y in itertools.combinations(rows, 2):
        a, b = set(x[4].split()), set(y[4].split())
        want += x[2] == y[2] and abs(x[3] - y[3]) <= 7 and round(len(a & b) / (len(a) * len(b)) ** 0.5, 6) >= 0.75
    for block in (4, 3000):
        assert fusion.similar_pairs(_events(spark, rows), 0.75, 7, block).agg(F.sum("n")).first()[0] == want


def test_clusters_and_members_of_copies_and_near_events(spark):
    rows = [(f"c{i:03}", "A", "view", 0, "Sales of the unit rose.") for i in range(300)] + [("d", "A", "view", 7, "sales of the unit rose today"), ("e", "A", "view", 15, "sales of the unit rose"), ("f", "B", "view", 0, "sales of the unit rose today")]
    e = _events(spark, rows)
    clusters, members, accepted = fusion.event_clusters(e, fusion.similar_pairs(e, 0.75, 7))
    assert {(r.representative, r.size) for r in clusters.collect()} == {("d", 301), ("e", 1), ("f", 1)}
    assert members.count() == 303 and {r.event_id for r in members.where("is_representative").collect()} == {"d", "e", "f"}
    assert {(r.left, r.right): r.n for r in accepted.collect()} == {("c000", "c000"): 44850, ("c000", "d"): 300}


def test_small_components_end_in_one_task(spark, monkeypatch):
    pairs = spark.createDataFrame([(f"v{i:04}", f"v{i + 1:04}") for i in range(400) if i != 200], "a string, b string")
    names = []
    real = components.written
    monkeypatch.setattr(components, "written", lambda df, name: names.append(name) or real(df, name))
    got = components.connected_components(pairs).groupBy("component").count().collect()
    assert {(r.component, r["count"]) for r in got} == {("v0000", 201), ("v0201", 200)} and len(names) == 2


def test_shuffles_of_a_written_table_go_with_it(spark):
    def files():
        every = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (every.apply(i).getName() for i in range(every.size())) if n.endswith(".data")}

    before = files()
    table = scratch.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and table.count() == 7


def test_events_compared_and_joined_in_parts_are_those_of_the_whole(spark, monkeypatch):
    rows = [(f"e{i:03}", "A", ["view", "click"][i % 2], 5 * i % 400, f"sales of unit {i % 9} rose today") for i in range(240)]
    e = _events(spark, rows)

    def found():
        pairs = fusion.similar_pairs(e, 0.75, 7)
        clusters, members, accepted = fusion.event_clusters(e, pairs)
        return [sorted(map(str, df.collect())) for df in (pairs, clusters, members, accepted)], len({f.rsplit("/", 1)[0] for f in pairs.inputFiles()})

    whole, one = found()
    monkeypatch.setattr(scratch, "PART_ROWS", 10)
    parts, four = found()
    assert parts == whole and (one, four) == (1, 4) and len(whole[0]) > 100


def test_fusion_report_counts_members_and_mentions_by_clusters(spark):
    sizes = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} long")
    pairs = lambda *n: sizes("n", n)
    got = fusion.fusion_report((sizes("mentions", [4, 1]), None), (sizes("size", [3, 2, 1, 1]), None), pairs(3, 2), pairs()).first()
    assert got.asDict() == {"event_count": 7, "event_cluster_count": 4, "event_multi_member_cluster_count": 2, "event_fused_member_count": 5, "entity_mention_count": 5, "entity_cluster_count": 2, "entity_multi_member_cluster_count": 1, "event_pairs_considered": 5, "event_pairs_accepted": 0}


def test_cluster_edges_are_all_edges_of_the_clusters(spark, tmp_path):
    import hashlib

    short = lambda s, n=18: hashlib.sha1(s.encode()).hexdigest()[:n]
    told = lambda kind, c: f'{{"event_type": "{kind}", "confidence": {c}, "importance_score": 1}}'
    day = lambda m, n: dt.date(2020, m, n)
    sales = "Sales of Alder rose 5% to 3 million"
    nodes = [("event:e1", "Event", sales, "AAA", day(1, 1), told("revenue_growth", 0.5)), ("event:e2", "Event", sales + " today", "AAA", day(1, 3), told("revenue_growth", 0.9)), ("event:e3", "Event", "A plant burned.", "AAA", day(2, 1), told("lawsuit", 0.5)),
             ("event:e4", "Event", "Rates went up 2%", None, None, told("macroeconomic_event", 0.5)), ("entity:x", "Entity", "Cedar Works", None, None, "{}"), ("entity_raw:y", "EntityRawMention", "CEDAR WORKS", None, None, "{}")]
    hit = lambda e, t, kind, w: (f"event:{e}", t, kind, w, "a1", e, "{}")
    edges = [(f"article:{a}", f"event:{e}", "REPORTS", 1.0, a, e, "{}") for a, e in [("a2", "e1"), ("a1", "e1"), ("a2", "e2"), ("a3", "e3")]] + [hit("e1", "entity:x", "MENTIONS_ENTITY", 1.0), hit("e3", "entity:x", "MENTIONS_ENTITY", 1.0), hit("e3", "entity_raw:y", "MENTIONS_ENTITY", 1.0)]
    edges += [hit("e2", "ticker:BBB", "PEER_COMPARED_WITH_ANCHOR", 1.0), hit("e1", "company_ticker:bbb", "PEER_COMPARED_WITH_ANCHOR", -1.0), hit("e1", "ticker:BBB", "PEER_COMPARED_WITH_ANCHOR", -1.0), hit("e3", "ticker:BBB", "MENTIONS_ANCHOR_COMPANY", None), hit("e3", "date:2020-02-01", "MACRO_IMPACT_ON_ANCHOR", 1.0), hit("zz", "ticker:BBB", "MACRO_IMPACT_ON_ANCHOR", 1.0)]
    for name, rows, kind in [("graph_nodes", nodes, "node_id string, node_type string, name string, ticker string, date date, attributes_json string"), ("graph_edges", edges, "source string, target string, edge_type string, weight double, article_id string, event_id string, attributes_json string"),
                             ("companies", [("AAA", "Alder Mining Inc", None), ("BBB", "Birch Timber", None)], "ticker string, company string, aliases_json string")]:
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    alder, cedar = (f"entity_cluster:ENTC_{short(s)}" for s in ("AAA|alder mining inc|aaa", "|cedar works|cedar works"))
    c12, c3, c4 = (f"event_cluster:EVTC_{short(s)}" for s in ("e1|e2", "e3", "e4"))
    firm, works, fused, said = "company_ticker:AAA", f"entity:{short('cedar works')}", "FUSED_INTO_EVENT_CLUSTER", "MENTIONS_ENTITY_CLUSTER"
    want = [(c12, "date:2020-01-03", "CLUSTER_OCCURRED_ON"), (c3, "date:2020-02-01", "CLUSTER_OCCURRED_ON"), (c12, firm, "CLUSTER_REVENUE_GROWTH_FOR"), (c3, firm, "CLUSTER_LEGAL_RISK_FOR"), (c12, c3, "EVENT_CLUSTER_PRECEDES")]
    want += [e for c in (c12, c3) for e in [(c, "ticker:AAA", "CLUSTER_INVOLVES_TICKER"), (c, alder, "CLUSTER_INVOLVES_ENTITY_CLUSTER")]] + [(c, f"event_type:{t}", "CLUSTER_HAS_TYPE") for c, t in [(c12, "revenue_growth"), (c3, "lawsuit"), (c4, "macroeconomic_event")]]
    want += [(c, f"metric_mention:{short(m)}", "CLUSTER_MENTIONS_METRIC") for c, m in [(c12, "5%"), (c12, "3million"), (c4, "2%")]] + [e for n, c in [(firm, alder), (works, cedar)] for e in [(n, c, "FUSED_INTO_ENTITY_CLUSTER"), (c, n, "CANONICAL_ENTITY_REPRESENTS")]]
    want = [(*e, 1.0, None, None) for e in want] + [(c12, "company_ticker:BBB", "CLUSTER_PEER_COMPARED_WITH_ANCHOR", -1.0, None, None), (c3, "company_ticker:BBB", "CLUSTER_MENTIONS_ANCHOR_COMPANY", 0.1, None, None)]
    want += [(f"event:{e}", c, fused, w, a, e) for e, c, w, a in [("e1", c12, 0.942809, "a1"), ("e2", c12, 1.0, "a2"), ("e3", c3, 1.0, "a3"), ("e4", c4, 1.0, None)]] + [(c, f"event:{e}", "CANONICAL_EVENT_REPRESENTS", 1.0, None, e) for c, e in [(c12, "e2"), (c3, "e3"), (c4, "e4")]]
    want += [(f"event:{e}", c, said, 1.0, a, e) for e, c, a in [("e1", alder, "a1"), ("e2", alder, "a2"), ("e3", alder, "a3"), ("e1", cedar, "a1"), ("e3", cedar, "a3")]]
    got = graph_queries.cluster_edges(spark, str(tmp_path)).select("source", "target", "edge_type", "weight", "article_id", "event_id")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
