"""Queries over texts, names and extracted records."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import jsontext
from loomgraph.functions import text as X
from loomgraph.operators import documents as D
from loomgraph.plans import tables as T


def _docs(spark, d):
    return T.table(spark, d, "documents").where("text is not null").select("doc_id", "text")


def clean_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.clean("text").cast("binary")).alias("h"), F.length(X.clean("text")).alias("n"), F.length(X.strip_only("text")).alias("stripped"))


def ticker_forms(spark, d):
    n = T.table(spark, d, "graph_nodes").where("ticker is not null").select("ticker").distinct()
    return n.select("ticker", X.ticker_symbol("ticker").alias("symbol"), X.ticker_plain("ticker").alias("plain"))


def entity_name_norm(spark, d):
    return T.table(spark, d, "companies").select("ticker", X.entity_name("company").alias("name"))


def resolution_keys(spark, d):
    c = T.table(spark, d, "companies")
    return c.select("ticker", F.posexplode(X.resolution_keys(F.col("company"), F.col("ticker"))).alias("pos", "k"))


def sentence_split(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(X.sentences("text")).alias("pos", "s")).select("doc_id", "pos", F.md5(F.col("s").cast("binary")).alias("h"))


def rule_spans(spark, d):
    docs = T.table(spark, d, "documents").where("text is not null").select("doc_id", "text", "ticker").distinct()
    return D.evidence_sentences(docs).select("doc_id", "pos", F.array_join("tickers", "|").alias("tickers"), F.array_join("figures", "|").alias("figures"), "temporal", "causal")


def metric_mentions(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(X.metric_mentions("text"), "|").alias("m"))


def metric_values(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(X.metric_values("text"), "|").alias("m"))


def direction_signature(spark, d):
    return T.articles(spark, d).select("article_id", X.direction_signature("body").alias("direction"))


def _labels(spark, d):
    """Words of titles and types of edges and events, as labels that a rule has to place."""
    words = T.table(spark, d, "articles").where("_title is not null").select(F.explode(F.split(F.lower("_title"), "[^a-z]+")).alias("label"))
    types = T.edges(spark, d).select(F.lower("edge_type").alias("label")).union(T.table(spark, d, "graph_nodes").where("node_type = 'EventType' and name is not null").select("name"))
    pairs = spark.createDataFrame([(x,) for x in LABELS], "label string")
    return words.union(types).union(pairs).where("label <> ''").distinct()


LABELS = ["Direct", "indirect effect", "market share loss", "Peer", "rival", "supply chain", "a client", "Partnership", "platform", "Holding", "inflation", "legal", "options", "related", "No clear effect", "Upward", "Tail-wind", "harmful", "supply", "mentioned", "negative", "Price Target", "P/E ratio", "52-week range", "FCF", "Share repurchase", "net-debt", "odd label"]
EVENTS_TRIED = ["", "partnership", "lawsuit", "stock return", "supply_chain_event"]


def impact_cascade(spark, d):
    kinds = spark.createDataFrame([(x,) for x in EVENTS_TRIED], "event string")
    # Five event types, a stated set.
    pairs = _labels(spark, d).crossJoin(F.broadcast(kinds))
    t, r = X.impact_type(F.col("label"), F.col("event")), X.impact_direction(F.col("label"))
    return pairs.select("label", "event", t.alias("kind"), r.alias("direction"), X.impact_score(r).alias("score"))


def event_types(spark, d):
    kind = X.event_type("label")
    return _labels(spark, d).select("label", kind.alias("kind"), X.event_polarity(kind).alias("polarity"), X.company_relation(F.col("label")).alias("relation"), X.inferred_impact(kind).alias("inferred"), X.impact_relation(F.col("label")).alias("impact_relation"), X.reverse_relation(F.col("label")).alias("reverse"))


def ticker_tags(spark, d):
    n = T.table(spark, d, "graph_nodes").where("name is not null and node_type in ('Entity', 'EntityRawMention')").select("node_id", "name", "ticker").distinct()
    return n.select("node_id", "name", "ticker", F.array_join(X.tagged_tickers("name", F.col("ticker")), "|").alias("tags"))


def compared_text(spark, d):
    return T.table(spark, d, "graph_nodes").where("name is not null").select("name").distinct().select("name", X.compared_text("name").alias("compared"))


def span_metrics(spark, d):
    a = T.table(spark, d, "articles").where("_article is not null").select("article_id", "_title", "_article").distinct()
    return a.select("article_id", F.array_join(X.span_metrics(F.array("_title"), F.col("_article")), "|").alias("m"))


def parsed_dates(spark, d):
    """Dates of articles written in several ways, one by the day of the month, and read again."""
    a = T.table(spark, d, "articles").where("_date is not null").select("article_id", "_date").distinct()
    ways = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss'Z'", "MMMM d, yyyy", "MM/dd/yyyy", "d MMM yyyy", "'unknown' d"]
    n, text = F.dayofmonth("_date") % len(ways), F.lit(None).cast("string")
    for i, way in enumerate(ways):
        text = F.when(n == i, F.date_format("_date", way)).otherwise(text)
    return a.select("article_id", X.parsed_date(text).alias("day"))


def finite_numbers(spark, d):
    a = T.table(spark, d, "articles").where("_title is not null").select(F.explode(F.split("_title", r"\s+")).alias("w")).distinct()
    return a.select("w", X.finite(F.col("w"), -1.0).alias("x"))


def named_entities(spark, d):
    """Articles that name the firm of their own ticker."""
    c = T.table(spark, d, "companies").select("ticker", "company")
    a = T.articles(spark, d).select("article_id", "ticker", "title", "body").join(F.broadcast(c), "ticker")
    return a.where(X.mentions_entity(F.concat_ws(" ", "title", "body"), F.col("company"))).select("article_id", "ticker").distinct()


def demand_context(spark, d):
    """Directions of labels in the light of what is said of a supplier that can't keep up with demand."""
    cases = spark.createDataFrame(DEMAND_CASES, "label string, company string, kind string, evidence string")
    return cases.select("label", "company", "kind", "evidence", X.impact_direction_in_context("label", "company", F.col("kind"), F.col("evidence")).alias("direction"))


DEMAND_CASES = [
    ("negative", "Acme Chips", "supplier", "Acme Chips cannot supply enough parts amid strong demand."), ("negative", "Acme Chips", "competitor", "Acme Chips cannot supply enough parts amid strong demand."),
    ("negative", "Acme Chips", "customer", "Acme Chips can't keep up with demand and lost sales."), ("negative", "Acme Chips", "vendor", "Backlog grows. Acme Chips was not being able to get enough wafers."),
    ("negative", "Acme Chips", "vendor", "Others cannot keep up with demand from Acme Chips."), ("down", "", "supplier", "cannot keep up with demand"), ("up", "Acme (A) Inc.", "supply chain", "Acme (A) Inc. reported strong demand."),
]


def safe_keys(spark, d):
    return T.edges(spark, d).select("edge_type", "source").distinct().select(X.safe_key(F.col("source"), F.col("edge_type"), F.lit("")).alias("k")).distinct()


def chunk_text(spark, d):
    c = X.chunks("text", 300, 12)
    return _docs(spark, d).select("doc_id", F.size(c).alias("chunks"), F.aggregate(c, F.lit(0), lambda s, x: s + F.length(x)).alias("chars"))


def cache_keys(spark, d):
    return _docs(spark, d).select("doc_id", X.cache_key("encoder", "1800x12", F.col("text")).alias("k"))


def article_text(spark, d):
    return T.articles(spark, d).select("article_id", F.md5(F.concat_ws("\n\n", F.nullif("title", F.lit("")), "body").cast("binary")).alias("h"))


def alias_mentions(spark, d):
    c = T.table(spark, d, "companies").select("ticker", F.col("company").alias("alias"))
    return D.alias_mentions(_docs(spark, d), c)


def alias_dictionary(spark, d):
    c = T.table(spark, d, "companies")
    listed = c.select("ticker", F.explode(F.from_json("aliases_json", "array<string>")).alias("alias"))
    rows = c.select("ticker", F.col("company").alias("alias")).union(listed).union(c.select("ticker", "ticker"))
    return rows.groupBy(F.lower("alias").alias("k")).agg(F.min("ticker").alias("ticker"))


def key_resolution(spark, d):
    reg = alias_dictionary(spark, d).select(F.col("k").alias("key"), F.col("ticker").alias("target"))
    n = T.nodes(spark, d).where("node_type in ('Entity', 'EntityRawMention')")
    items = n.select(F.col("node_id").alias("id"), F.array(F.lower("name"), F.lower(F.trim("name")), F.lower(F.trim("ticker"))).alias("keys"))
    return D.resolved_keys(items, reg)


def section_overlap(spark, d):
    docs = _docs(spark, d).select("doc_id", F.length("text").alias("n")).distinct()
    spans = docs.select("doc_id", F.posexplode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - 50), F.lit(70))).alias("span", "s")).withColumn("e", F.col("s") + 50)
    sections = docs.select("doc_id", F.posexplode(F.sequence(F.lit(20), F.greatest(F.lit(20), F.col("n")), F.lit(90))).alias("section", "s")).select("doc_id", F.concat(F.lit("sec"), F.col("section").cast("string")).alias("section"), "s", (F.col("s") + 80).alias("e"))
    return D.section_of_spans(spans, sections)


def promo_filter(spark, d):
    a = T.articles(spark, d)
    return a.where(X.promotional(F.concat_ws(" ", "title", "body"))).select("article_id").distinct()


def participant_support(spark, d):
    c = T.table(spark, d, "companies").select("ticker", F.split_part(F.col("company"), F.lit(" "), F.lit(1)).alias("w"))
    named = c.groupBy("ticker").agg(F.array_sort(F.collect_set("w")).alias("ws"))
    a = T.articles(spark, d).select("article_id", "ticker", "body").join(F.broadcast(named), "ticker")
    return a.select("article_id", F.array_join(F.filter("ws", lambda w: F.contains(F.col("body"), w)), "|").alias("named"))


def event_time(spark, d):
    e = T.events(spark, d).select("event_id", F.when(F.col("importance") == 2, F.col("event_date_end")).otherwise(F.col("event_date_start")).alias("s"), F.when(F.col("importance") == 2, F.col("event_date_start")).when(F.col("importance") == 3, F.col("event_date_end")).alias("e"))
    return D.normalised_period(e, "s", "e")


def decision_join(spark, d):
    c = T.tasks(spark, d).select(F.col("task_id").alias("ref"))
    x = T.table(spark, d, "temporal_examples").select(F.col("task_id").alias("ref"), F.when(F.col("label") == 1, "ACCEPT").otherwise("reject").alias("decision"), F.coalesce("label", F.lit(-1)).alias("seq")).where("ref is not null")
    return D.decisions_applied(c, x)


def span_dedupe(spark, d):
    return _docs(spark, d).select("doc_id", F.size(D.disjoint_spans(X.sentences("text"))).alias("kept"))


def evidence_blocks(spark, d):
    return _docs(spark, d).select("doc_id", F.size(D.packed_blocks(X.sentences("text"), 1500)).alias("blocks"))


def json_repair(spark, d):
    e = T.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Reply: "), F.expr("substr(props, 1, length(props) - 1)"))).when(F.col("event_id") % 3 == 1, F.regexp_replace("props", "}$", ",}")).otherwise(F.col("props")).alias("props"))
    return D.repaired(e, "props").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def recovered_arrays(spark, d):
    """Arrays of a reply that breaks off within their last object."""
    e = T.table(spark, d, "events").select("event_id", F.concat(F.lit('<think>{"items": [1]</think>Here: {"items": ['), "props", F.lit(" "), "props", F.lit(', {"k": 1, "te')).alias("reply"))
    return jsontext.recovered_objects(e, "reply", "items", "event_id").select("event_id", "pos", F.get_json_object("object", "$.k").cast("int").alias("k"))


def stable_attributes(spark, d):
    n = T.table(spark, d, "graph_nodes").where("node_type = 'Event'").select("node_id", "attributes_json").distinct()
    return jsontext.stable_json(n, "attributes_json").select("node_id", "attributes_json")


def alias_lists(spark, d):
    c = T.table(spark, d, "companies").select("ticker", "aliases_json")
    return jsontext.extracted_lists(c, "aliases_json", "participants").select("ticker", F.array_join("aliases_json", "|").alias("aliases"))


def span_sections(spark, d):
    """Sentences of articles as spans, in sections told by the first and last words of its lines."""
    a = T.articles(spark, d).select(F.col("article_id").alias("doc_id"), F.col("body").alias("text"))
    lines = a.select("doc_id", F.posexplode(F.filter(F.split("text", r"\r\n|\n"), lambda x: X.clean(x) != "")).alias("pos", "line"))
    head = F.substring(X.clean("line"), 1, 30)
    tail = F.expr("right(line, 20)")
    sections = lines.select("doc_id", F.format_string("SEC%03d", F.col("pos") + 1).alias("section"), F.when(F.col("pos") == 0, "Core_Article_Body").when(F.col("line").rlike("(?i)copyright|staff|share"), "legal_disclaimer").otherwise("financial_analysis").alias("kind"), F.lit(None).cast("string").alias("flag"), head.alias("start_quote"), tail.alias("end_quote"))
    spans = a.select("doc_id", F.posexplode(X.sentences("text")).alias("span", "text")).withColumn("contains_financial_fact", F.when(F.col("text").rlike("[0-9]"), "Yes").otherwise("no"))
    return D.annotated_spans(a, sections, spans).groupBy("kind", "allowed").agg(F.count("*").alias("n"))


def checksum_manifest(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("sha256"), F.length(F.encode("text", "UTF-8")).cast("long").alias("bytes"))


_NAMES = """clean_text ticker_forms entity_name_norm resolution_keys sentence_split rule_spans metric_mentions metric_values direction_signature impact_cascade event_types compared_text span_metrics parsed_dates finite_numbers named_entities demand_context ticker_tags safe_keys chunk_text cache_keys
article_text alias_mentions alias_dictionary key_resolution section_overlap promo_filter participant_support event_time decision_join span_dedupe evidence_blocks json_repair recovered_arrays stable_attributes alias_lists span_sections checksum_manifest""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

from loomgraph.plans.graph_queries import _NAME  # noqa: E402

_C = r"trim(regexp_replace({}, '[\s\x{{A0}}]+', ' ', 'g'))"
_DOCS = rf"docs AS (SELECT DISTINCT doc_id, text, ticker, {_C.format('text')} AS c FROM documents WHERE text IS NOT NULL)"
_ABBREVIATED = r"replace(replace(regexp_replace(c, '(Prof|Corp|Sept|Mrs|Inc|Ltd|LLC|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec|Mr|Ms|Dr|Co|No)\.', '\1' || chr(1), 'g'), 'U.S.', 'U' || chr(1) || 'S' || chr(1)), 'U.K.', 'U' || chr(1) || 'K' || chr(1))"
_SENT = rf"""sent AS (SELECT doc_id, c, ticker, list_filter(list_transform(string_split(regexp_replace({_ABBREVIATED}, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)), lambda x: trim(replace(x, chr(1), '.'))), lambda x: x <> '') AS s FROM docs)"""
_MENTIONS = r"(?i)(?:[$€£]\s*)?\d[\d,]*(?:\.\d+)?\s*(?:%|percent|million|billion|trillion|x|times|shares?|subscribers?|users?|customers?)?|\b(?:fiscal|FY|Q[1-4]|quarter|year|month)\s+20\d{2}\b|\b(?:20\d{2}|19\d{2})\b|\b(?:No\.?\s*\d+|#\d+)\b|\b(?:first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|largest|top\s+\d+)\b|\b(?:double|doubled|triple|tripled|twice|half)\b"
_FOUND = lambda c: f"list_transform(regexp_extract_all({c}, '{_MENTIONS}'), lambda x: trim(x))"
_SAME = lambda x: rf"trim(regexp_replace(replace(regexp_replace(lower({x}), '\b(more than|roughly|nearly|about|approximately|around|over|under|at least|as of)\b', '', 'g'), ',', ''), '\s+', ' ', 'g'))"
_ONCE = lambda f: f"array_to_string(list_filter({f}, lambda x, i: {_SAME('x')} <> '' AND list_position(list_transform({f}, lambda y: {_SAME('y')}), {_SAME('x')}) = i), '|')"
_TAGS = lambda c: r"list_transform(list_concat(regexp_extract_all({c}, '(?i)\((?:NASDAQ|NYSE|AMEX|OTC|OTCMKTS|NYSEARCA)\s*:\s*([A-Z][A-Z0-9.\-]{{0,9}})\)', 1), regexp_extract_all({c}, '(?i)\b(?:NASDAQ|NYSE|AMEX|OTC|OTCMKTS|NYSEARCA)\s*:\s*([A-Z][A-Z0-9.\-]{{0,9}})\b', 1)), lambda x: upper(x))".format(c=c)
_UNIQUE = lambda f: f"list_filter({f}, lambda x, i: list_position({f}, x) = i)"
_SYMBOL = r"regexp_replace(upper(coalesce({}, '')), '[^A-Z0-9.\-]', '', 'g')"
_WITH_OWN = lambda tags, own: f"CASE WHEN {own} = '' OR list_contains({tags}, {own}) THEN {_UNIQUE(tags)} ELSE list_concat([{own}], {_UNIQUE(tags)}) END"
_QUOTED = lambda words: ", ".join("('" + w.replace("'", "''") + "')" for w in words)
_LABELS = rf"""labels AS (SELECT unnest(regexp_split_to_array(lower(_title), '[^a-z]+')) AS label FROM articles WHERE _title IS NOT NULL UNION SELECT lower(edge_type) FROM graph_edges WHERE source IS NOT NULL AND target IS NOT NULL
UNION SELECT name FROM graph_nodes WHERE node_type = 'EventType' AND name IS NOT NULL UNION SELECT * FROM (VALUES {_QUOTED(LABELS)})),
keyed AS (SELECT label, trim(label, E' \t\n') AS bare, trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_') AS key FROM labels WHERE label <> '')"""
_EVENT_TYPE = lambda key, bare: f"""CASE WHEN {key} IN ('stock_return', 'stock_price_return', 'share_price_return', 'share_return') THEN 'stock_performance' WHEN {key} IN ('market_cap', 'market_cap_growth', 'market_cap_grow', 'market_cap_increase') THEN 'market_cap_milestone'
WHEN {key} IN ('geographic_expansion', 'geographic_scale') THEN 'business_segment_performance' WHEN {key} IN ('price_target', 'price_targets', 'analyst_price_target', 'target_price', 'consensus_price_target', 'average_price_target', 'upside_target') THEN 'price_target_change'
WHEN {key} IN ('capital_spending', 'capital_expenditure', 'capital_expenditures', 'investment_spending', 'cost_reduction', 'cost_savings') THEN 'capital_allocation' WHEN {key} = 'share_repurchase' THEN 'share_buyback'
WHEN {key} IN ('pe_ratio', 'p_e_ratio', 'price_to_earnings', 'forward_pe', 'valuation', 'valuation_ratio', 'price_to_book', 'ev_ebitda') THEN 'valuation_multiple' WHEN {key} IN ('free_cash_flow', 'fcf', 'operating_cash_flow', 'cash_burn') THEN 'cash_flow'
WHEN {key} IN ('debt', 'debt_level', 'long_term_debt', 'net_debt', 'cash_position', 'leverage', 'liquidity') THEN 'balance_sheet' WHEN {key} IN ('earnings_estimate', 'consensus_estimate', 'eps_estimate', 'estimate_revision') THEN 'analyst_estimate'
WHEN {key} IN ('52_week_range', 'price_range', 'stock_price_level') THEN 'price_level_range'
WHEN {key} IN ('earnings_report', 'revenue_growth', 'revenue_decline', 'profit_growth', 'profit_decline', 'guidance_update', 'analyst_upgrade', 'analyst_downgrade', 'price_target_change', 'product_launch', 'partnership', 'merger_acquisition', 'lawsuit', 'regulatory_investigation',
'executive_change', 'layoffs', 'dividend_announcement', 'share_buyback', 'debt_financing', 'stock_split', 'macroeconomic_event', 'supply_chain_event', 'recession_inflation_interest_rate', 'options_activity', 'portfolio_holding', 'stock_performance', 'market_cap_milestone',
'business_segment_performance', 'market_share', 'competitive_position', 'market_commentary', 'valuation_multiple', 'balance_sheet', 'cash_flow', 'analyst_estimate', 'capital_allocation', 'price_level_range', 'other') THEN {key} ELSE {bare} END"""  # noqa: E731
_IMPACT = lambda t: f"""CASE WHEN regexp_matches({t}, 'direct|involves_ticker|same_company') THEN 'direct' WHEN regexp_matches({t}, 'market_share|peer') THEN 'peer_comparison' WHEN regexp_matches({t}, 'compet|rival') THEN 'competitor'
WHEN regexp_matches({t}, 'supplier|customer|supply_chain|vendor|client') THEN 'supplier_customer' WHEN contains({t}, 'partner') THEN 'partner' WHEN regexp_matches({t}, 'ecosystem|platform|segment|product') THEN 'ecosystem' WHEN regexp_matches({t}, 'portfolio|holding|weight') THEN 'portfolio'
WHEN regexp_matches({t}, 'macro|inflation|interest|recession|market_commentary') THEN 'macro' WHEN regexp_matches({t}, 'regulatory|lawsuit|legal') THEN 'regulatory' WHEN regexp_matches({t}, 'sentiment|stock_performance|options') THEN 'market_sentiment'
WHEN regexp_matches({t}, 'mention|related') THEN 'mentioned' ELSE 'other' END"""  # noqa: E731
_DIRECTION = lambda k: f"""CASE WHEN {k} IN ('positive', 'negative', 'neutral') THEN {k} WHEN regexp_matches({k}, 'neutral|mixed|uncertain|unknown|unclear|ambiguous|indirect|none|no_clear') THEN 'neutral'
WHEN regexp_matches({k}, 'positive|up|increase|benefit|beneficial|good|favorable|favourable|tailwind|bullish|opportunity|gain|growth|improve') THEN 'positive'
WHEN regexp_matches({k}, 'negative|down|decrease|bad|harm|adverse|unfavorable|unfavourable|headwind|bearish|risk|pressure|decline|loss') THEN 'negative' ELSE 'neutral' END"""  # noqa: E731
ORACLE = {
    "clean_text": rf"WITH docs AS (SELECT doc_id, text, {_C.format('text')} AS c FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(c) AS h, CAST(length(c) AS INT) AS n, CAST(length(regexp_replace(text, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g')) AS INT) AS stripped FROM docs",
    "ticker_forms": r"SELECT DISTINCT ticker, regexp_replace(upper(trim(regexp_replace(ticker, '[\s\x{A0}]+', ' ', 'g'))), '[^A-Z0-9.\-]', '', 'g') AS symbol, upper(trim(regexp_replace(ticker, '[\s\x{A0}]+', ' ', 'g'))) AS plain FROM graph_nodes WHERE ticker IS NOT NULL",
    "entity_name_norm": f"SELECT ticker, {_NAME.format(c='company')} AS name FROM companies",
    "sentence_split": f"WITH {_DOCS}, {_SENT} SELECT doc_id, CAST(pos - 1 AS INT) AS pos, md5(s[pos]) AS h FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS pos FROM sent)",
    "resolution_keys": rf"""WITH n AS (SELECT ticker, {_NAME.format(c='company')} AS n FROM companies), k AS (SELECT ticker, list_filter(list_transform([n, regexp_replace(n, '(?i)\.com$', ''), regexp_replace(n, '\s+', '', 'g'), {_SYMBOL.format('ticker')}], lambda x: regexp_replace(lower(trim(x)), '[\s.,-]+$', '')), lambda x: x <> '') AS k FROM n),
u AS (SELECT ticker, {_UNIQUE('k')} AS k FROM k) SELECT ticker, CAST(pos - 1 AS INT) AS pos, k[pos] AS k FROM (SELECT ticker, k, unnest(range(1, len(k) + 1)) AS pos FROM u)""",
    "rule_spans": rf"""WITH {_DOCS}, {_SENT}, t AS (SELECT doc_id, s, {_WITH_OWN('tags', 'own')} AS known FROM (SELECT doc_id, s, {_TAGS('d.text')} AS tags, {_SYMBOL.format('d.ticker')} AS own FROM docs d JOIN sent USING (doc_id))),
x AS (SELECT doc_id, pos, known, s[pos] AS s FROM (SELECT *, unnest(range(1, len(s) + 1)) AS pos FROM t)),
y AS (SELECT doc_id, CAST(pos - 1 AS INT) AS pos, s, list_filter(known, lambda t: regexp_matches(s, '\b' || replace(replace(t, '.', '\.'), '-', '\-') || '\b')) AS tickers,
  list_transform(regexp_extract_all(s, '(?i)(?:\$?\d[\d,]*(?:\.\d+)?\s*(?:%|percent|million|billion|trillion|x)?|\b(?:twice|double|triple|half)\b)'), lambda x: trim(x))[1:12] AS figures FROM x
  WHERE regexp_matches(s, '(?i)\b(?:stock|share|market|revenue|profit|income|earnings|sales|cash|valuation|market cap|return|gained|rose|grew|growth|declined|fell|portfolio|holding|rank|weight|customers|subscribers|users|margin|guidance|target|dividend|buyback|acquisition|merger|lawsuit|regulatory|inflation|interest rate)\b'))
SELECT doc_id, pos, array_to_string(tickers, '|') AS tickers, array_to_string(figures, '|') AS figures, regexp_matches(s, '(?i)\b(?:20\d{{2}}|19\d{{2}}|Q[1-4]|quarter|fiscal|year|month|week|today|yesterday)\b') AS temporal,
regexp_matches(s, '(?i)\b(?:because|due to|driven by|as a result|therefore|despite|led to|resulting in)\b') AS causal FROM y WHERE len(tickers) > 0 OR len(figures) > 0""",
    "metric_mentions": f"WITH docs AS (SELECT doc_id, {_C.format('text')} AS c FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, {_FOUND('c')} AS f FROM docs) SELECT doc_id, {_ONCE('f')} AS m FROM f",
    "span_metrics": f"WITH a AS (SELECT DISTINCT article_id, _title, _article FROM articles WHERE _article IS NOT NULL), f AS (SELECT article_id, list_concat(list_filter([{_C.format('coalesce(_title, chr(32))')}], lambda x: x <> ''), {_FOUND(_C.format('_article'))}) AS f FROM a) SELECT article_id, {_ONCE('f')} AS m FROM f",
    "metric_values": rf"""WITH docs AS (SELECT doc_id, {_C.format('text')} AS c FROM documents WHERE text IS NOT NULL) SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(c, '(?i)[-+]?\$?\d[\d,]*(?:\.\d+)?\s*(?:%|percent|million|billion|trillion|x|times|shares?)?'),
lambda x: replace(regexp_replace(lower(x), '[\s,]+', '', 'g'), 'percent', '%')))), '|') AS m FROM docs""",
    "direction_signature": rf"""WITH {T.ARTICLES}, x AS (SELECT article_id, regexp_matches(lower(body), '\b(up|rose|risen|rise|gain|gained|gains|growth|grew|soared|jumped|climbed|increased|higher|bullish|outperform)\b') AS u,
regexp_matches(lower(body), '\b(down|fell|fall|fallen|decline|declined|loss|lost|off|dropped|plunged|decreased|lower|bearish|underperform)\b') AS n FROM arts)
SELECT article_id, CASE WHEN u AND NOT n THEN 'positive' WHEN n AND NOT u THEN 'negative' ELSE 'neutral' END AS direction FROM x""",
    "impact_cascade": f"""WITH {_LABELS}, e AS (SELECT * FROM (VALUES ('', ''), ('partnership', 'partnership'), ('lawsuit', 'lawsuit'), ('stock return', 'stock_performance'), ('supply_chain_event', 'supply_chain_event')) v(event, as_type)),
x AS (SELECT label, event, key, key || ' ' || as_type AS t FROM keyed, e), y AS (SELECT label, event, {_IMPACT('t')} AS kind, {_DIRECTION('key')} AS direction FROM x)
SELECT *, CASE direction WHEN 'positive' THEN 1.0::DOUBLE WHEN 'negative' THEN -1.0::DOUBLE ELSE 0.1::DOUBLE END AS score FROM y""",
    "event_types": f"""WITH {_LABELS}, k AS (SELECT label, key, {_EVENT_TYPE('key', 'bare')} AS kind FROM keyed), i AS (SELECT *, {_IMPACT("key || ' '")} AS impact FROM k)
SELECT label, kind, CASE WHEN kind IN ('revenue_growth', 'profit_growth', 'analyst_upgrade', 'product_launch', 'partnership', 'dividend_announcement', 'share_buyback', 'market_cap_milestone', 'market_share') THEN 1.0::DOUBLE
WHEN kind IN ('revenue_decline', 'profit_decline', 'analyst_downgrade', 'lawsuit', 'regulatory_investigation', 'layoffs', 'debt_financing', 'supply_chain_event') THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS polarity,
coalesce(map {{'earnings_report': 'REPORTS_EARNINGS_FOR', 'revenue_growth': 'REVENUE_GROWTH_FOR', 'revenue_decline': 'REVENUE_DECLINE_FOR', 'profit_growth': 'PROFIT_GROWTH_FOR', 'profit_decline': 'PROFIT_DECLINE_FOR', 'guidance_update': 'UPDATES_GUIDANCE_FOR',
'analyst_upgrade': 'ANALYST_UPGRADE_FOR', 'analyst_downgrade': 'ANALYST_DOWNGRADE_FOR', 'price_target_change': 'PRICE_TARGET_CHANGE_FOR', 'product_launch': 'PRODUCT_LAUNCH_BY', 'partnership': 'PARTNERSHIP_INVOLVES', 'merger_acquisition': 'MERGER_ACQUISITION_INVOLVES',
'lawsuit': 'LEGAL_RISK_FOR', 'regulatory_investigation': 'REGULATORY_RISK_FOR', 'executive_change': 'EXECUTIVE_CHANGE_AT', 'layoffs': 'LAYOFFS_AT', 'dividend_announcement': 'DIVIDEND_ANNOUNCEMENT_FOR', 'share_buyback': 'SHARE_BUYBACK_FOR', 'debt_financing': 'DEBT_FINANCING_FOR',
'stock_split': 'STOCK_SPLIT_FOR', 'macroeconomic_event': 'MACRO_IMPACT_ON', 'supply_chain_event': 'SUPPLY_CHAIN_IMPACT_ON', 'recession_inflation_interest_rate': 'MACRO_RATE_IMPACT_ON', 'options_activity': 'OPTIONS_ACTIVITY_FOR', 'portfolio_holding': 'PORTFOLIO_HOLDING_OF',
'stock_performance': 'STOCK_PERFORMANCE_FOR', 'market_cap_milestone': 'MARKET_CAP_MILESTONE_FOR', 'business_segment_performance': 'BUSINESS_SEGMENT_PERFORMANCE_FOR', 'market_share': 'MARKET_SHARE_CHANGE_FOR', 'competitive_position': 'COMPETITIVE_POSITION_FOR',
'market_commentary': 'MARKET_COMMENTARY_MENTIONS', 'valuation_multiple': 'VALUATION_MULTIPLE_FOR', 'balance_sheet': 'BALANCE_SHEET_FOR', 'cash_flow': 'CASH_FLOW_FOR', 'analyst_estimate': 'ANALYST_ESTIMATE_FOR', 'capital_allocation': 'CAPITAL_ALLOCATION_BY',
'price_level_range': 'PRICE_LEVEL_FOR'}}[kind], 'EVENT_INVOLVES_COMPANY') AS relation,
CASE WHEN kind = 'supply_chain_event' THEN 'supplier_customer' WHEN kind IN ('competitive_position', 'market_share') THEN 'peer_comparison' WHEN kind = 'partnership' THEN 'partner' WHEN kind IN ('macroeconomic_event', 'recession_inflation_interest_rate') THEN 'macro'
WHEN kind IN ('lawsuit', 'regulatory_investigation') THEN 'regulatory' WHEN kind = 'portfolio_holding' THEN 'portfolio' WHEN kind IN ('stock_performance', 'options_activity', 'analyst_upgrade', 'analyst_downgrade', 'price_target_change') THEN 'market_sentiment'
WHEN kind IN ('product_launch', 'business_segment_performance') THEN 'ecosystem' ELSE 'mentioned' END AS inferred,
CASE impact WHEN 'direct' THEN 'DIRECTLY_IMPACTS_ANCHOR' WHEN 'competitor' THEN 'COMPETES_WITH_ANCHOR' WHEN 'supplier_customer' THEN 'SUPPLY_CUSTOMER_IMPACT_ON_ANCHOR' WHEN 'partner' THEN 'PARTNERS_WITH_ANCHOR' WHEN 'peer_comparison' THEN 'PEER_COMPARED_WITH_ANCHOR'
WHEN 'ecosystem' THEN 'ECOSYSTEM_IMPACT_ON_ANCHOR' WHEN 'portfolio' THEN 'PORTFOLIO_EXPOSURE_TO_ANCHOR' WHEN 'macro' THEN 'MACRO_IMPACT_ON_ANCHOR' WHEN 'regulatory' THEN 'REGULATORY_IMPACT_ON_ANCHOR' WHEN 'market_sentiment' THEN 'MARKET_SENTIMENT_IMPACT_ON_ANCHOR'
WHEN 'mentioned' THEN 'MENTIONS_ANCHOR_COMPANY' ELSE 'RELATED_TO_ANCHOR' END AS impact_relation, 'REV_' || trim(regexp_replace(upper(label), '[^A-Z0-9_]+', '_', 'g'), '_') AS reverse FROM i""",
    "ticker_tags": f"WITH n AS (SELECT DISTINCT node_id, name, ticker FROM graph_nodes WHERE name IS NOT NULL AND node_type IN ('Entity', 'EntityRawMention')), t AS (SELECT *, {_TAGS('name')} AS tags, {_SYMBOL.format('ticker')} AS own FROM n) SELECT node_id, name, ticker, array_to_string({_WITH_OWN('tags', 'own')}, '|') AS tags FROM t",
    "compared_text": rf"SELECT DISTINCT name, trim(regexp_replace(regexp_replace(regexp_replace(lower({_C.format('name')}), '\.+$', ''), '[^a-z0-9%$., ]+', ' ', 'g'), '\s+', ' ', 'g')) AS compared FROM graph_nodes WHERE name IS NOT NULL",
    "parsed_dates": "SELECT DISTINCT article_id, CASE WHEN day(_date) % 6 = 5 THEN '' ELSE strftime(_date, '%Y-%m-%d') END AS day FROM articles WHERE _date IS NOT NULL",
    "finite_numbers": r"SELECT DISTINCT w, CASE WHEN isfinite(x) THEN x ELSE -1.0::DOUBLE END AS x FROM (SELECT w, CASE WHEN regexp_matches(w, '^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?[dDfF]?$') THEN TRY_CAST(regexp_replace(w, '[dDfF]$', '') AS DOUBLE) END AS x FROM (SELECT unnest(regexp_split_to_array(_title, '\s+')) AS w FROM articles WHERE _title IS NOT NULL))",
    "named_entities": rf"""WITH {T.ARTICLES}, c AS (SELECT ticker, lower({_C.format('company')}) AS a, lower({_NAME.format(c='company')}) AS b FROM companies), x AS (SELECT article_id, ticker, a, b, lower({_C.format("concat_ws(' ', title, body)")}) AS t FROM arts JOIN c USING (ticker))
SELECT DISTINCT article_id, ticker FROM x WHERE regexp_matches(t, '(^|[^a-z0-9])\Q' || a || '\E($|[^a-z0-9])') OR regexp_matches(t, '(^|[^a-z0-9])\Q' || b || '\E($|[^a-z0-9])')""",
    "safe_keys": f"WITH {T.EDGES} SELECT DISTINCT regexp_replace(source, '[^A-Za-z0-9_]+', '_', 'g') || '__' || regexp_replace(edge_type, '[^A-Za-z0-9_]+', '_', 'g') || '__UNKNOWN' AS k FROM edges",
    "cache_keys": f"WITH docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL) SELECT doc_id, sha256('encoder|1800x12|' || text) AS k FROM docs",
    "article_text": f"WITH {T.ARTICLES} SELECT article_id, md5(CASE WHEN coalesce(title, '') = '' THEN body ELSE title || chr(10) || chr(10) || body END) AS h FROM arts",
    "alias_mentions": f"WITH {_DOCS}, t AS (SELECT doc_id, ' ' || regexp_replace(lower(c), '[^a-z0-9]+', ' ', 'g') || ' ' AS t FROM docs) SELECT DISTINCT doc_id, ticker FROM t JOIN companies ON contains(t, ' ' || trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')) || ' ')",
    "alias_dictionary": "WITH r AS (SELECT ticker, company AS alias FROM companies UNION ALL SELECT ticker, unnest(CAST(aliases_json AS VARCHAR[])) FROM (SELECT ticker, from_json(aliases_json, '[\"VARCHAR\"]') AS aliases_json FROM companies) UNION ALL SELECT ticker, ticker FROM companies) SELECT lower(alias) AS k, min(ticker) AS ticker FROM r GROUP BY 1",
    "promo_filter": rf"""WITH {T.ARTICLES}, x AS (SELECT DISTINCT article_id, lower({_C.format("concat_ws(' ', title, body)")}) AS t FROM arts)
SELECT DISTINCT article_id FROM x WHERE regexp_matches(t, 'before you buy|see the 10 stocks|top stock picks|stock advisor returns|affiliate compensation|board of directors')
OR contains(t, 'stock advisor') AND regexp_matches(t, 'top stock pick|best stocks|10 stocks|ten stocks|wasn''t one of them|was not one of them|newsletter|market returns|tripled') OR contains(t, 'stock advisor service') AND regexp_matches(t, 'return|tripled|outperformed')
OR regexp_matches(t, '\b(has|have|holds?|held|owns?|owned)\s+positions?\s+in\b|\bholds?\s+positions?\s+in\s+and\s+recommends\b|\brecommends?\s+(long|short)\b.*\b(calls?|puts?)\b|\b(former|current)\s+ceo\b.*\bmember\b.*\bboard of directors\b')""",
    "participant_support": f"WITH {T.ARTICLES}, c AS (SELECT ticker, split_part(company, ' ', 1) AS w FROM companies) SELECT article_id, coalesce(string_agg(w, '|' ORDER BY w) FILTER (contains(body, w)), '') AS named FROM (SELECT DISTINCT article_id, body, w FROM arts JOIN c USING (ticker)) GROUP BY article_id, body",
    "section_overlap": """WITH n AS (SELECT DISTINCT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL),
sp AS (SELECT doc_id, unnest(range(0, greatest(0, n - 50) // 70 + 1)) AS span FROM n), se AS (SELECT doc_id, unnest(range(0, (greatest(20, n) - 20) // 90 + 1)) AS k FROM n),
o AS (SELECT sp.doc_id, span, k, least(span * 70 + 50, k * 90 + 100) - greatest(span * 70, k * 90 + 20) AS o FROM sp JOIN se USING (doc_id)),
b AS (SELECT doc_id, span, k FROM o WHERE o > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, span ORDER BY o DESC, k) = 1)
SELECT doc_id, CAST(span AS INT) AS span, coalesce('sec' || k, 'UNKNOWN') AS section FROM sp LEFT JOIN b USING (doc_id, span)""",
    "key_resolution": r"""WITH r AS (SELECT ticker, company AS alias FROM companies UNION ALL SELECT ticker, unnest(CAST(aliases_json AS VARCHAR[])) FROM (SELECT ticker, from_json(aliases_json, '["VARCHAR"]') AS aliases_json FROM companies) UNION ALL SELECT ticker, ticker FROM companies),
reg AS (SELECT lower(alias) AS k, min(ticker) AS target FROM r GROUP BY 1), """ + T.NODES + r""", i AS (SELECT node_id AS id, unnest([lower(name), lower(trim(name, ' ')), lower(trim(ticker, ' '))]) AS k, unnest([1, 2, 3]) AS pos FROM nodes WHERE node_type IN ('Entity', 'EntityRawMention'))
SELECT id, arg_min(target, pos) AS target FROM i JOIN reg USING (k) GROUP BY 1""",
    "event_time": f"WITH {T.EVENTS}, x AS (SELECT event_id, CASE WHEN importance = 2 THEN event_date_end ELSE event_date_start END AS s, CASE WHEN importance = 2 THEN event_date_start WHEN importance = 3 THEN event_date_end END AS e FROM ev) SELECT event_id, least(coalesce(s, e), coalesce(e, s)) AS s, greatest(coalesce(s, e), coalesce(e, s)) AS e FROM x",
    "decision_join": f"WITH {T.TASKS}, l AS (SELECT task_id, max(coalesce(label, -1)) AS m FROM temporal_examples GROUP BY 1) SELECT t.task_id AS ref, CASE WHEN m IS NULL THEN 'missing' WHEN m = 1 THEN 'accepted' ELSE 'rejected' END AS outcome FROM tasks t LEFT JOIN l USING (task_id)",
    "json_repair": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "recovered_arrays": "SELECT event_id, CAST(pos AS INT) AS pos, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events, (VALUES (0), (1)) v(pos)",
    "stable_attributes": "SELECT DISTINCT node_id, CASE WHEN json_valid(attributes_json) THEN '{' || array_to_string(list_transform(list_sort(json_keys(attributes_json)), lambda k: chr(34) || k || chr(34) || ': ' || CASE WHEN json_type(attributes_json, '$.' || k) = 'DOUBLE' THEN CAST(CAST(json_extract_string(attributes_json, '$.' || k) AS DOUBLE) AS VARCHAR) ELSE CAST(json_extract(attributes_json, '$.' || k) AS VARCHAR) END), ', ') || '}' END AS attributes_json FROM graph_nodes WHERE node_type = 'Event'",
    "alias_lists": """SELECT ticker, coalesce(array_to_string(CAST(from_json(aliases_json, '["VARCHAR"]') AS VARCHAR[]), '|'), '') AS aliases FROM companies""",
    "checksum_manifest": f"WITH docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL) SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM docs",
}
