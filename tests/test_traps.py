"""Literal fixtures for the rules that are easy to get wrong."""

import datetime as dt
import math

from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.functions import vectors as V
from loomgraph.operators import components, dedup, documents, graph, similarity, stats
from loomgraph.operators import series as S

DAY = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)


def prices(spark, values, ticker="A"):
    return spark.createDataFrame([(ticker, DAY(i), float(v)) for i, v in enumerate(values)], "ticker string, date date, price double")


def test_splits_by_double_arithmetic(spark):
    for n, train, val in ((10, 6, 6), (20, 13, 14)):
        b = S.split_bounds(spark.createDataFrame([(DAY(i),) for i in range(n)], "date date")).first()
        assert (b.train_end, b.val_end) == (DAY(train), DAY(val))


def test_returns(spark):
    assert [round(r.ret, 2) for r in S.same_day_return(prices(spark, [10, 11, 9.9])).orderBy("date").collect()] == [0.1, -0.1]
    got = S.forward_return(prices(spark, [10, 11, 12, 6]), 2).orderBy("date").collect()
    assert [round(r.ret, 4) for r in got] == [0.2, -0.4545]


def test_trailing_median_needs_twenty(spark):
    r = S.same_day_return(prices(spark, [100 + (i % 2) for i in range(30)]))
    got = [x.median for x in S.trailing_median(r).orderBy("date").collect()]
    assert got[:19] == [None] * 19 and got[19] is not None


def test_lead_join_clips_by_all_tickers_first(spark):
    p = prices(spark, [1, 2, 3, 4])
    v = spark.createDataFrame([("A", DAY(2), 1.0), ("B", DAY(3), 9.0)], "ticker string, date date, n double")
    assert {(r.date, r.n) for r in S.lead_join(p, v, 1, "n").collect()} == {(DAY(2), 0.0), (DAY(3), 0.0)}
    assert {(r.date, r.n) for r in S.lead_join(p, v, 0, "n").collect()} == {(DAY(2), 1.0), (DAY(3), 0.0)}


def test_decay_before_the_last_score(spark):
    dates = spark.createDataFrame([("A", DAY(i)) for i in (1, 2, 3, 4)], "ticker string, date date")
    scores = spark.createDataFrame([("A", DAY(1), 2.0), ("A", DAY(3), 4.0)], "ticker string, date date, score double")
    got = {r.date: r.score for r in S.decay_to_neutral(dates, scores).collect()}
    assert got[DAY(2)] == 4.0 and math.isclose(got[DAY(4)], 3 + math.exp(-0.03))


def test_splice(spark):
    p = prices(spark, [30.08, 23.03]).unionByName(prices(spark, [10, 10.0889], "B")).unionByName(prices(spark, [10, 10.0890], "C"))
    f = {r.ticker: r.factor for r in S.splice_factors(p, str(DAY(0)), str(DAY(1))).collect()}
    assert math.isclose(f["A"], 23.03 / 30.08 / 1.00889, rel_tol=1e-6) and math.isclose(f["B"], 1.0)


def test_keep_first_and_reversal(spark):
    df = spark.createDataFrame([("k", 2, "late"), ("k", 1, "early"), (None, 1, "x"), (None, 2, "y")], "k string, i int, v string")
    assert {r.v for r in dedup.keep_first(df, ["k"], "i").collect()} == {"early", "x"}
    e = spark.createDataFrame([("a", "b", "A"), ("b", "a", "REV_A"), ("c", "d", "B")], "source string, target string, edge_type string")
    assert {r.edge_type for r in graph.reverse_synthesis(e).collect()} == {"A", "REV_A", "B", "REV_B"}


def test_knn_from_the_lower_side_only(spark):
    v = spark.createDataFrame([(0, "g", [1.0, 0.0]), (1, "g", [0.0, 1.0]), (2, "g", [0.9, 0.5]), (3, "g", None)], "id long, grp string, v array<double>")
    assert {(r.left, r.right) for r in similarity.knn_lower_side(v, 2, 0.0).collect()} == {(0, 2), (1, 2)}


def test_strongest_and_softmax(spark):
    e = spark.createDataFrame([("s", 0.1), ("s", -1.0), ("s", 0.5), ("s", 0.0), ("s", None)], "source string, weight double")
    assert graph.strongest_weight(e, "source").first().weight == -1.0
    x = spark.createDataFrame([("g", math.log(1)), ("g", math.log(3))], "g string, s double")
    assert sorted(round(r.p, 6) for r in graph.segment_softmax(x, "g", "s").collect()) == [0.25, 0.75]


def test_names_and_directions(spark):
    row = spark.range(1).select(
        X.entity_name(F.lit("Foo Holdings, Inc. (NASDAQ: FOO)")).alias("name"), X.impact_direction(F.lit("supply")).alias("supply"), X.impact_type(F.lit("indirect"), F.lit("")).alias("kind"),
        X.clean(F.lit("a  b\n")).alias("clean"), X.clean(F.lit(None).cast("string")).alias("none"), F.size(X.chunks(F.lit("aa bb cc"), 5)).alias("chunks"), V.unit(F.array(F.lit(0.0), F.lit(0.0))).alias("zero"),
    ).first()
    assert row.name == "Foo" and row.supply == "positive" and row.kind == "direct" and row.clean == "a b" and row.none == "" and row.chunks == 2 and row.zero == [0.0, 0.0]


def test_scores(spark):
    a = spark.createDataFrame([("x", 0.1, 0), ("x", 0.4, 0), ("x", 0.4, 1), ("x", 0.8, 1)], "k string, score double, label int")
    assert stats.ranked_auc(a, "k").first().auc == 0.875
    assert round(stats.rank_sum_p(25, 5, 5), 4) == 0.0079 and round(stats.t_two_sided(2.776, 4), 3) == 0.05
    left = spark.createDataFrame([("k", v) for v in (1.0, 3.0, 3.0)], "k string, value double")
    right = spark.createDataFrame([("k", v) for v in (0.5, 3.0)], "k string, value double")
    r = stats.cross_pair_wins(left, right, "k").first()
    assert (r.pairs, r.wins) == (6, 3)


def test_components(spark):
    got = dict(map(tuple, components.connected_components(spark.createDataFrame([(1, 2), (2, 3), (5, 6), (7, 7)], "a int, b int")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}


def test_json_repair():
    f = documents.repair_json
    assert f('<think>no</think>```json {"a": [1, 2,], "b": "x') == '{"a": [1, 2], "b": "x"}' and f('{"a": 1} tail') == '{"a": 1}' and f("none") is None and f(None) is None


def test_empty_tables(spark):
    p = spark.createDataFrame([], "ticker string, date date, price double")
    for df in (S.same_day_return(p), S.trailing_median(S.same_day_return(p)), S.sliding_windows(p, 3, 1), S.random_walk(p, 2), S.minmax_scaled(p), S.last_values(p, 3)):
        assert df.count() == 0


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


def test_names_lose_legal_forms_tags_and_marks(spark):
    for name, want in [("Foo Holdings, Inc. (NASDAQ: FOO)", "Foo"), ("“Bar” Co., Ltd.", "Bar"), ("NYSE: ABC Acme's Class A", "Acme"), ("Texaco", "Texaco"), ("Größe AG", "Gr e"), ("  ", ""), ("Acme Group", "Acme Group"), ("A.B. & C., Inc", "A.B. & C")]:
        assert one(spark, X.entity_name("n"), n=name) == want
    assert one(spark, X.resolution_keys(F.col("n"), F.col("t")), n="Foo.com Inc.", t=" foo ") == ["foo.com", "foo"]


def test_tickers_sentences_and_figures(spark):
    assert one(spark, X.tagged_tickers("t", F.col("s")), t="OTCMKTS: abcd, then (NYSEARCA: XYZ) and (NASDAQ: Q.B).", s="own") == ["OWN", "XYZ", "Q.B", "ABCD"]
    assert one(spark, X.sentences("t"), t="Acme Inc. rose. The U.S. fell!  No. 5 held?") == ["Acme Inc. rose.", "The U.S. fell!", "No. 5 held?"]
    assert one(spark, X.metric_mentions("t"), t="about €5 million, Q3 2021, No. 7, the largest half and 5 percent or €5 million") == ["€5 million", "Q3 2021", "No. 7", "largest", "half", "5 percent"]
    assert one(spark, X.metric_values("t"), t="-$1,200 million and 5 percent, 5% or 3 x") == ["-$1200million", "3x", "5%"]
    assert one(spark, X.direction_signature("t"), t="Shares rose off the lows") == "neutral" and one(spark, X.direction_signature("t"), t="Supply grew") == "positive"
    assert one(spark, X.compared_text("t"), t=" Costs (net) fell 3%.. ") == "costs net fell 3%"


def test_impacts(spark):
    def kind(label, event=""):
        return one(spark, X.impact_type(F.col("a"), F.col("b")), a=label, b=event)

    assert [kind("indirect"), kind("peer rival"), kind("rival"), kind("mentioned", "partnership"), kind("Supply chain"), kind("odd")] == ["direct", "peer_comparison", "competitor", "partner", "supplier_customer", "other"]
    way = lambda label: one(spark, X.impact_direction(F.col("a")), a=label)
    assert [way("supply"), way("Indirect gain"), way("no clear effect"), way("Headwind"), way(""), way("unfavorable")] == ["positive", "neutral", "neutral", "negative", "neutral", "positive"]
    assert one(spark, X.company_relation(F.col("a")), a="Price target") == "PRICE_TARGET_CHANGE_FOR" and one(spark, X.event_type("a"), a="52-week range") == "price_level_range" and one(spark, X.event_type("a"), a=" New kind ") == "New kind"


def test_demand_beats_shortage(spark):
    from loomgraph.plans import text_queries

    got = [r.direction for r in text_queries.demand_context(spark, "").collect()]
    assert got == ["positive", "negative", "negative", "positive", "negative", "negative", "positive"]


def test_promotion(spark):
    assert one(spark, X.promotional("t"), t="Jane owns positions in Acme.") and one(spark, X.promotional("t"), t="The Stock Advisor newsletter") and not one(spark, X.promotional("t"), t="Acme holds a dominant position.")


def test_dates_and_numbers(spark):
    assert [one(spark, X.parsed_date("t"), t=t) for t in ("2020-02-03T23:30:00-05:00", "March 4, 2021", "03/04/2021", "2020-02-30", "soon", "2021")] == ["2020-02-04", "2021-03-04", "2021-03-04", "", "", ""]
    assert one(spark, X.finite(F.col("t"), 9.0), t="1e999") == 9.0 and one(spark, X.finite(F.col("t"), 9.0), t="-2.5") == -2.5
    assert one(spark, X.mentions_entity(F.col("t"), F.col("n")), t="Shares of foo rose", n="Foo, Inc.") and not one(spark, X.mentions_entity(F.col("t"), F.col("n")), t="Food rose", n="Foo")


def test_features_of_nodes_without_a_period(spark):
    from loomgraph.operators import temporal

    schema = "task_id string, node_id string, cutoff date, hop int, available date, start_date date, end_date date, time_confidence double, confidence double, importance int, polarity double, in_degree int, impact double"
    rows = [("t", "later", DAY(0), 1, DAY(5), DAY(3), None, 2.0, -1.0, 3, 1.0, 0, None), ("t", "none", DAY(0), 2, None, None, None, None, None, None, None, None, None), ("t", "period", DAY(10), 3, DAY(10), DAY(13), DAY(15), 0.5, 0.5, 9, 0.0, 3, -1.0)]
    f = {r.node_id: r for r in temporal.temporal_features(spark.createDataFrame(rows, schema)).collect()}
    assert (f["later"].f0, f["later"].f3, f["later"].f15, f["later"].f5, f["later"].f6, f["later"].f8) == (1.0, 0.0, 1.0, 1.0, 0.0, 1.0)
    assert (f["none"].f0, f["none"].f9, f["none"].f15) == (1.0, 0.0, 1.0) and math.isclose(f["period"].f15, math.exp(-0.1)) and f["period"].f7 == 1.0


def test_subgraph_scope_edges_and_clusters(spark):
    from loomgraph.operators import temporal

    nodes = spark.createDataFrame([("ticker:A", "Ticker", None), ("event:1", "Event", DAY(9)), ("event:2", "Event", DAY(9)), ("event:3", "Event", None), ("event:4", "Event", DAY(2)), ("article:x", "Article", DAY(9)), ("article:y", "Article", DAY(30)), ("c", "EventCluster", None), ("d", "EventCluster", None), ("date:9", "Date", DAY(9))], "node_id string, node_type string, date date")
    edge = lambda s, t, k, w=1.0, a=None, e=None: (s, t, k, w, a, e)
    rows = [edge("event:1", "ticker:A", "INVOLVES_TICKER", e="1"), edge("event:2", "ticker:A", "RELATED"), edge("event:3", "ticker:A", "INVOLVES_TICKER"), edge("event:4", "ticker:A", "INVOLVES_TICKER"), edge("article:x", "event:1", "REPORTS"), edge("article:y", "event:1", "REPORTS"),
            edge("event:1", "c", "FUSED"), edge("c", "ticker:A", "ABOUT"), edge("event:4", "d", "FUSED"), edge("d", "ticker:A", "ABOUT"), edge("date:9", "ticker:A", "LATE", a="y"), edge("event:2", "ticker:B", "PEER_COMPARED_WITH_ANCHOR", -1.0)]
    edges = spark.createDataFrame(rows, "source string, target string, edge_type string, weight double, article_id string, event_id string")
    tasks = spark.createDataFrame([("t", "A", DAY(10))], "task_id string, ticker string, cutoff date")
    fused = spark.createDataFrame([("event:1", "c"), ("event:4", "d")], "node_id string, cluster string")
    sub, known = temporal.task_subgraph(tasks, nodes, edges, fused=fused)
    assert {(r.node_id, r.hop) for r in sub.collect()} == {("ticker:A", 0), ("event:1", 1), ("c", 1), ("article:x", 2)}
    assert {r.node_id for r in temporal.task_subgraph(tasks, nodes, edges, scope="all")[0].collect()} == {"ticker:A", "event:1", "event:2", "article:x"}
    got = {(r.source, r.target): round(r.weight, 4) for r in temporal.subgraph_edges(sub, known).collect()}
    assert got == {("event:1", "ticker:A"): 0.9048, ("article:x", "event:1"): 0.9048, ("event:1", "c"): 0.9048, ("c", "ticker:A"): 1.0}


def test_news_days_read_no_texts(spark):
    from loomgraph.plans import series_queries

    plan = series_queries.news_days(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "_article" not in plan and "_title" not in plan


def test_json_is_read_tolerantly():
    from loomgraph.functions import jsontext as J

    assert J.first_object('<think>{"x": 1}</think>```json\n{"a": "he said "yes", and left", "b": [1, 2,], }\n``` {"c": 1}') == {"a": 'he said "yes", and left', "b": [1, 2]}
    assert J.first_object('{"a": 1 "b": {"c": "line\nbreak" "d": null}') == {"a": 1, "b": {"c": "line\nbreak", "d": None}}
    assert J.first_object('{"a": [{"k": 1}, {"k": "cut o') == {"a": [{"k": 1}, {"k": "cut o"}]} and J.first_object('{"a": 1, "b"') == {"a": 1}
    assert J.first_object("no object") is None and J.first_object(None) is None and J.first_object("{}") is None
    assert J.array_objects('{"e": [{"k": 1}, {"k": [2]} {"k": 3, "t', "e") == [{"k": 1}, {"k": [2]}] and J.array_objects("{}", "e") == []
    assert J.dumped({"b": float("nan"), "a": [None, "ü"]}) == '{"a": ["", "ü"], "b": ""}'
    assert J.list_texts([{"metric": "sales", "value": " 3 ", "evidence": "x"}, "a  b", {"company": "Acme"}, {"z": 1}, None, 5], "financial_metric_mentions") == ["sales | 3 | x", "a b", "Acme", '{"z": 1}', '""', "5"]
    assert J.list_texts("one", "participants") == ["one"] and J.list_texts({"a": 1}, "participants") == []


def test_sections_by_quotes(spark):
    text = "Start here with news. " + "x" * 5000 + " the end of it"
    df = spark.createDataFrame([(text, a, b) for a, b in [("Start here", "the end"), ("Start here", ""), ("", "end of it"), ("no", "none"), ("", "")]], "t string, a string, b string")
    got = [r[0] and tuple(r[0]) for r in df.select(documents.quote_bounds(F.col("t"), F.col("a"), F.col("b"))).collect()]
    assert got == [(0, 5030), (0, 4000), (1036, 5036), None, None]
    a = spark.createDataFrame([("d", "Revenue rose 3%. Subscribe now. Tail text.")], "doc_id string, text string")
    s = spark.createDataFrame([("d", "S1", "core_article_body", None, "Revenue", "3%."), ("d", "S2", "publisher_promotion", "true", "Subscribe", "now."), ("d", "S3", "unheard", "no", "nowhere", "")], "doc_id string, section string, kind string, flag string, start_quote string, end_quote string")
    p = spark.createDataFrame([("d", 1, "Revenue rose 3%.", "yes"), ("d", 2, "Subscribe now.", "TRUE"), ("d", 3, "Not in the text", "1"), ("d", 4, "Revenue", "no"), ("d", 5, " ", "yes"), ("d", 6, "is nowhere at all", "yes")], "doc_id string, span int, text string, contains_financial_fact string")
    assert {tuple(r)[1:] for r in documents.annotated_spans(a, s, p).collect()} == {(1, "S1", "core_article_body", True), (2, "S2", "publisher_promotion", False), (3, "UNKNOWN", "unknown", True), (6, "S3", "unknown", False)}


def test_hooks(spark):
    from loomgraph import hooks

    a = spark.createDataFrame([("1", "alpha beta " * 400), ("2", "alpha beta"), ("3", ""), ("4", None)], "article_id string, text string")
    got = {r.article_id: r.vector for r in hooks.article_vectors(a, hooks.hashing_encoder(16)).collect()}
    assert got.keys() == {"1", "2"} and math.isclose(sum(x * y for x, y in zip(got["1"], got["2"])), 1.0, abs_tol=1e-6)
    out = hooks.extracted(a, "text", lambda: lambda texts: [{"n": len(t)} for t in texts], "n long, kind string").collect()
    assert {r.article_id: (r.n, r.kind) for r in out}["2"] == (10, None)
