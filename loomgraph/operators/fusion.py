"""Fusion of repeated entities and events into clusters, and the edges of the clusters.

Mentions that share a lookup key are tied through the key, and events that repeat each other exactly through the group they are in, so
no pairs within a group are made; similar ones come as pairs of a similarity join and count if they are compatible. Clusters are
connected components, of keys and of groups rather than of mentions and events, of which there are many more. Nulls count as empty text;
a mention without text or key, and an event without an id, is left out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators.components import connected_components
from loomgraph.operators.dedup import compatible
from loomgraph.operators.graph import edge, followers
from loomgraph.scratch import drop_written, written, written_by


def registry_keys(registry: DataFrame) -> DataFrame:
    """key, anchor: the lookup keys of firms (ticker, company, aliases), of several firms with one key the first ticker's."""
    names = F.concat(F.array("company", "ticker"), F.coalesce("aliases", F.array().cast("array<string>")))
    keys = registry.where("ticker is not null").select("ticker", F.explode(names).alias("name")).select("ticker", F.explode(X.resolution_keys(F.col("name"), F.lit(""))).alias("key"))
    return keys.groupBy("key").agg(F.min("ticker").alias("anchor"))


def entity_mentions(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """mention_id, event_id, text, name, ticker, source, keys: distinct mentions (rows: event_id, text, ticker, source) with the ticker they resolve to.

    The ticker is that of the first of the name's keys that the registry knows, else the given one.
    """
    base = written(rows.select(F.trim("event_id").alias("event_id"), X.clean("text").alias("text"), X.ticker_symbol("ticker").alias("given"), "source").where("text <> '' and event_id is not null"), "said")
    texts = base.select("text").distinct().select("text", X.entity_name("text").alias("name"), X.resolution_keys(F.col("text"), F.lit("")).alias("names"))
    texts = written(texts, "texts")
    anchors = texts.select("text", F.posexplode("names").alias("pos", "key")).join(registry_keys(registry), "key").groupBy("text").agg(F.min_by("anchor", "pos").alias("anchor"))
    known = written(texts.join(anchors, "text", "left"), "known_texts")
    drop_written(texts)
    out = base.join(known, "text").withColumn("ticker", F.coalesce("anchor", "given")).where("name <> '' or ticker <> ''")
    one = out.groupBy("event_id", F.lower("text").alias("low"), "ticker", "source").agg(F.min(F.struct("text", "name", "names")).alias("x")).select("event_id", "x.text", "x.name", "x.names", "ticker", "source")
    names = F.filter(F.array_distinct(F.concat("names", X.resolution_keys(F.lit(""), F.col("ticker")))), lambda k: F.length(k) > 1)
    keys = F.concat(F.when(F.col("ticker") != "", F.array(F.concat(F.lit("ticker:"), "ticker"))).otherwise(F.array().cast("array<string>")), F.transform(names, lambda k: F.concat(F.lit("name:"), k)))
    seed = F.concat_ws("|", "event_id", F.lower("text"), "ticker", "source")
    return one.select(F.concat(F.lit("ENTM_"), X.short_sha1(seed, 18)).alias("mention_id"), "event_id", "text", "name", "ticker", "source", keys.alias("keys")).where(F.size("keys") > 0)


def embedding_eligible(text: Column, name: Column, ticker: Column) -> Column:
    """Whether a mention without a ticker is long enough, and no symbol, to be compared by its text."""
    return (ticker == "") & (F.length(name) >= 4) & ~text.rlike(r"^[A-Z0-9.\-]{1,4}$")


def _majority(values: DataFrame, *by: str) -> DataFrame:
    """by, name: the most frequent name (values: by, name, n times), of equally frequent ones the longest, then the first."""
    n = values.where("name <> ''").groupBy(*by, "name").agg(F.sum("n").alias("n"))
    return n.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.length("name")).alias("l"), F.lower("name").alias("low"), "name"))["name"].alias("name"))


def entity_clusters(mentions: DataFrame, registry: DataFrame, pairs: DataFrame | None = None, rows: int = 0) -> tuple[DataFrame, DataFrame]:
    """clusters (cluster_id, name, ticker, mentions, events) and members (cluster_id, mention_id, event_id, source, ticker, name, is_representative, size).

    Mentions are one cluster if they share a key or a ticker, or are tied by compatible pairs (left, right: mention ids).
    The name is that of the commonest ticker's firm, else the commonest one among the mentions. ``rows``: about how many mentions there
    are, if it is known; many are written in parts.
    """
    every = mentions.withColumn("key", F.get("keys", F.lit(0))).where("key is not null")
    mentions = written_by(rows, ["event_id"], lambda part: part(every), "mentions")
    kinds = written(mentions.groupBy("keys", "key", "ticker", "name", "text").agg(F.count("*").alias("n")), "kinds")
    ties = kinds.select("key", F.explode("keys"))
    if pairs is not None:
        t = mentions.select("mention_id", "ticker", "key")
        near = pairs.select("left", "right").join(t.toDF("left", "lt", "lk"), "left").join(t.toDF("right", "rt", "rk"), "right").where("lt = '' or rt = '' or lt = rt")
        ties = ties.union(near.select("lk", "rk"))
    parts = connected_components(ties).toDF("key", "part")
    own = written(kinds.join(parts, "key", "left").withColumn("part", F.coalesce("part", "key")).drop("keys"), "mention_kinds")
    drop_written(kinds)
    tickers = own.where("ticker <> ''").groupBy("part", "ticker").agg(F.sum("n").alias("n")).groupBy("part").agg(F.min(F.struct((-F.col("n")).alias("n"), "ticker"))["ticker"].alias("ticker"))
    firms = registry.where("ticker is not null").groupBy("ticker").agg(F.min("company").alias("company"))
    called = own.select("part", F.col("ticker").alias("own"), F.when(F.col("name") != "", F.col("name")).otherwise(F.col("text")).alias("name"), "n").join(tickers, "part", "left").where("ticker is null or own = ticker")
    named = _majority(called, "part")
    counts = own.groupBy("part").agg(F.sum("n").alias("mentions"), F.array_sort(F.collect_set(F.lower(F.when(F.col("ticker") != "", F.col("ticker")).otherwise(F.col("name"))))).alias("seeds"))
    whole = counts.join(tickers, "part", "left").join(named, "part", "left").join(firms, "ticker", "left")
    name, ticker = F.coalesce("company", "name", "ticker", F.lit("")), F.coalesce("ticker", F.lit(""))
    seed = F.concat_ws("|", ticker, F.lower(name), F.concat_ws("|", F.slice("seeds", 1, 12)))
    heads = written(whole.select("part", F.concat(F.lit("ENTC_"), X.short_sha1(seed, 18)).alias("cluster_id"), name.alias("name"), ticker.alias("ticker"), "mentions"), "entity_clusters")
    keyed = written(own.select("key", "part").distinct().join(heads.toDF("part", "cluster_id", "head", "head_ticker", "size"), "part"), "keys")
    joined = mentions.join(keyed, "key")
    events = joined.groupBy("part").agg(F.count_distinct("event_id").alias("events"))
    # Left joins on unique keys go from the plan where their columns aren't used.
    clusters = heads.join(events, "part", "left").select("cluster_id", "name", "ticker", "mentions", "events")
    fits = ((F.col("head_ticker") != "") & (F.col("ticker") == F.col("head_ticker"))) | (F.lower("name") == F.lower(X.entity_name("head")))
    first = joined.where(fits).groupBy("part").agg(F.min("mention_id").alias("first"))
    members = joined.join(first, "part", "left").select("cluster_id", "mention_id", "event_id", "source", "ticker", "name", F.coalesce(F.col("mention_id") == F.col("first"), F.lit(False)).alias("is_representative"), "size")
    return clusters, members


def primary_clusters(members: DataFrame) -> DataFrame:
    """event_id, primary: the cluster of each event's main company."""
    return members.where("source = 'main_company'").groupBy("event_id").agg(F.min("cluster_id").alias("primary"))


def _similar(f: pd.DataFrame, least: float, days: int) -> pd.DataFrame:
    """left, right, shared, ls, rs, n: pairs of a block of events with another one (or itself) whose cosine may be ``least``, by shared words and numbers of words, as products of matrices.

    Events alike in all are one, ``n`` counts the pairs of events that a pair stands for.
    """
    x, y = f["x"].iloc[0], f["y"].iloc[0]
    f = f.sort_values("event_id")
    # Grouping by texts takes longer than all else where a slot has few events.
    alike = np.arange(len(f)) if f["like"].is_unique else f.groupby(["words", "like", "day"], sort=False).ngroup().to_numpy()
    f, n = f[~pd.Series(alike, index=f.index).duplicated()], np.bincount(alike)
    words = f["words"].str.split(" ").to_numpy()
    size = np.array([len(w) for w in words])
    code = pd.factorize(np.concatenate(words))[0]
    # Words of one event only are in no pair.
    kept = np.bincount(code)[code] > 1
    used, at = np.unique(code[kept], return_inverse=True)
    a = np.zeros((len(f), len(used)), dtype=np.float32)
    a[np.repeat(np.arange(len(f)), size)[kept], at] = 1
    guest, b, day, ids = (f[c].to_numpy() for c in ("guest", "b", "day", "event_id"))
    root = np.sqrt(size).astype(np.float32)
    meetings = [(np.flatnonzero(~guest), np.arange(len(f)))] if x == y else [(np.flatnonzero(~guest & (b == x)), np.flatnonzero(b == y)), (np.flatnonzero(~guest & (b == y)), np.flatnonzero(guest & (b == x)))]
    parts = [(np.flatnonzero(~guest & (n > 1) & (x == y)),) * 2]
    for mine, others in meetings:
        other = a[others].T
        for k in range(0, len(mine), 512):
            some = mine[k : k + 512]
            i, j = np.nonzero(a[some] @ other >= np.maximum(np.float32(least - 1e-4) * root[some, None] * root[None, others], np.float32(0.5)))
            i, j = some[i], others[j]
            ok = (np.abs(day[i] - day[j]) <= days) & (guest[j] | (i < j) | (x != y))
            parts.append((i[ok], j[ok]))
    i, j = (np.concatenate([p[s] for p in parts]) for s in (0, 1))
    shared = np.array([size[p] if p == q else (a[p] * a[q]).sum() for p, q in zip(i, j)])
    swap = ids[i] > ids[j]
    return pd.DataFrame({"left": np.where(swap, ids[j], ids[i]), "right": np.where(swap, ids[i], ids[j]), "shared": shared.astype("int64"), "ls": size[i], "rs": size[j], "n": np.where(i == j, n[i] * (n[i] - 1) // 2, n[i] * n[j])})


def with_exact(events: DataFrame) -> DataFrame:
    """events with the digest that is the same for those of one group, type, description, figures and start, unless they have it already."""
    if "exact" in events.columns:
        return events
    told = F.struct("grp", "event_type", X.compared_text("event_description").alias("d"), F.array_join("metrics", "|").alias("m"), F.coalesce(F.col("event_date_start").cast("string"), F.lit("")).alias("s"))
    return events.withColumn("exact", F.unhex(F.md5(F.to_json(told).cast("binary"))))


def similar_pairs(events: DataFrame, least: float, days: int, block: int = 3000) -> DataFrame:
    """left, right, sim, n: events of one group and type that start within ``days`` of each other and whose descriptions have a cosine of words of at least ``least``.

    events: event_id, grp, ticker, event_type, event_date_start, event_date_end, event_description, metrics, impact. Events alike in all of these and in their words
    are stood for by the first id, a pair of them by that id on both sides; ``n`` is the number of pairs of events. An event goes to its slot of days and to the
    next one. A slot of a group and type is compared in a task, as matrices of words, or in blocks of about ``block`` events, every two of which meet in a task.
    """
    e = with_exact(events).where("event_date_start is not null and event_id is not null and grp is not null and event_type is not null")
    width = days + 1
    day = F.datediff("event_date_start", F.lit("1970-01-01").cast("date"))
    slot = F.explode(F.array(F.floor(day / width), F.floor(day / width) + 1)).alias("slot")
    sizes = written(e.select("grp", "event_type", slot).groupBy("grp", "event_type", "slot").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("size")).where("size > 1").drop("size"), "slots")
    words = F.array_join(F.array_distinct(F.regexp_extract_all(F.lower("event_description"), F.lit("[a-z0-9]+"), F.lit(0))), " ")
    by = ["grp", "event_type", "slot"]
    # Parts are stretches of slots, so that the words of few events are made for two of them.
    stretch = lambda c: F.floor(c / 16)
    first = F.floor(day / width)
    like = F.xxhash64("event_date_end", "ticker", "metrics", "impact", "exact").alias("like")
    placed = e.withColumn("stretch", F.explode(F.array_distinct(F.array(stretch(first), stretch(first + 1))))).where(F.lower("event_description").rlike("[a-z0-9]"))

    def near(part):
        told = part(placed).select("event_id", "grp", "event_type", "stretch", day.alias("day"), words.alias("words"), like, slot).where(stretch(F.col("slot")) == F.col("stretch")).drop("stretch")
        own = told.join(sizes, by).withColumns({"guest": F.floor(F.col("day") / width) < F.col("slot"), "b": F.pmod("like", F.col("blocks")).cast("int")})
        met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"x": F.least("b", "other"), "y": F.greatest("b", "other")})
        found = met.select(*by, "x", "y", "event_id", "day", "words", "like", "guest", "b").groupBy(*by, "x", "y").applyInPandas(lambda f: _similar(f, least, days), "left string, right string, shared long, ls long, rs long, n long")
        return found.select("left", "right", F.round(F.col("shared") / F.sqrt(F.col("ls").cast("double") * F.col("rs")), 6).alias("sim"), "n").where(F.col("sim") >= least)

    return written_by(2 * events.count(), ["grp", "event_type", "stretch"], near, "similar")


def event_clusters(events: DataFrame, pairs: DataFrame, days: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """clusters (cluster_id, representative, size, ticker, event_type, event_date_start, event_date_end, description), members (cluster_id, event_id, is_representative, size, described: the representative's description where there are several) and the accepted pairs.

    events: event_id, grp, ticker, event_type, event_date_start, event_date_end, event_description, metrics (array), impact, importance, confidence.
    Similar pairs (left, right, and n if a pair stands for n pairs of events alike) count if they are compatible; besides, events of one group, type, description, figures and start are one.
    The representative is the one of greatest confidence, importance and length of description, then of the first id.
    """
    e = with_exact(events).where("event_id is not null")
    facts = F.struct("event_date_start", "event_date_end", "metrics", "impact", "ticker", "grp", "event_type", "exact")
    rows = events.count()
    ids = written(pairs.select("left").union(pairs.select("right")).distinct().toDF("event_id"), "similar_ids")
    met_facts = written_by(rows, ["event_id"], lambda part: part(e).join(part(ids), "event_id", "left_semi").select("event_id", facts.alias("x")), "similar_facts")
    side = lambda c, s: met_facts.toDF(c, s)
    met = pairs.select("left", "right", *(["n"] if "n" in pairs.columns else [F.lit(1).cast("long").alias("n")])).join(side("left", "x"), "left").join(side("right", "y"), "right")
    same = lambda c: (F.col(f"x.{c}") == "") | (F.col(f"y.{c}") == "") | (F.col(f"x.{c}") == F.col(f"y.{c}"))
    accepted = met.where((F.col("x.event_type") == F.col("y.event_type")) & same("ticker") & same("grp") & compatible("x", "y", days)).select("left", "right", "n", F.col("x.exact").alias("le"), F.col("y.exact").alias("re"))
    accepted = written(accepted, "accepted")
    drop_written(met_facts)
    tied = connected_components(accepted.select("le", "re")).toDF("exact", "part")
    repeated = e.groupBy("exact").agg(F.count("*").alias("copies")).where("copies > 1")
    linked = written(repeated.join(tied, "exact", "full").select("exact", F.coalesce("part", "exact").alias("part")), "linked")
    own = e.join(linked, "exact", "left")
    order = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), (-F.coalesce("importance", F.lit(1))).alias("i"), (-F.length(X.clean("event_description"))).alias("l"), F.col("event_id").alias("e"))
    kept_columns = ["event_id", "ticker", "event_type", "event_date_start", "event_date_end", "event_description"]
    kept = F.struct(*kept_columns)
    tied_events = written_by(rows, ["event_id"], lambda part: part(e).join(linked, "exact").select("part", *kept_columns, "confidence", "importance"), "tied_events")
    grouped = written(tied_events.groupBy("part").agg(F.min_by(kept, order).alias("r"), F.count("*").alias("size"), F.array_sort(F.collect_list("event_id")).alias("ids")), "event_clusters")
    drop_written(tied_events)
    # An event that nothing is tied to is a cluster as it stands.
    single = own.where("part is null").select(kept.alias("r"), F.lit(1).cast("long").alias("size"), F.array("event_id").alias("ids"))
    whole = grouped.drop("part").unionByName(single).select("size", "r", "ids", F.concat(F.lit("EVTC_"), X.short_sha1(F.concat_ws("|", "ids"), 18)).alias("cluster_id"))
    clusters = whole.select("cluster_id", F.col("r.event_id").alias("representative"), "size", "r.ticker", "r.event_type", "r.event_date_start", "r.event_date_end", F.col("r.event_description").alias("description"))
    members = whole.select("cluster_id", F.explode("ids").alias("event_id"), F.col("r.event_id").alias("first"), "size", F.when(F.col("size") > 1, F.col("r.event_description")).alias("described")).select("cluster_id", "event_id", (F.col("event_id") == F.col("first")).alias("is_representative"), "size", "described")
    return clusters, members, accepted.select("left", "right", "n")


def _words(c: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def cluster_edges(mentions: DataFrame, members: DataFrame, events: DataFrame, articles: DataFrame, impacts: DataFrame) -> DataFrame:
    """source, target, edge_type, weight, article_id, event_id of the clusters: what is fused into them, what stands for them, what they are about, and which of a ticker's follows which.

    mentions, members: those of ``entity_clusters`` and ``event_clusters``. events: event_id, ticker, event_type, event_date_start, event_date_end, event_description, metrics and primary (its entity
    cluster). articles: event_id, article_id. impacts: event_id, anchor, relation, weight; they and the metrics hold for the cluster of their event, of several weights that of the first event.
    An event is fused with the cosine of its words and the representative's as weight, with 1 if they share none.
    """
    none = F.lit(None).cast("string")
    told = ["ticker", "event_type", "event_date_start", "event_date_end", "metrics", "primary"]
    told_impacts = impacts.groupBy("event_id").agg(F.collect_set(F.struct("anchor", "relation", "weight")).alias("impacts"))
    x, y = _words("event_description"), _words("described")
    cosine = F.round(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.sqrt(F.size(x).cast("double") * F.size(y))), 6)
    similarity = F.when((F.col("size") == 1) | F.col("is_representative"), 1.0).otherwise(F.coalesce(F.nullif(cosine, F.lit(0.0)), F.lit(1.0)))
    every = written(members, "members")

    def known(part):
        own = part(every).join(part(events), "event_id").join(part(articles), "event_id", "left").join(part(told_impacts), "event_id", "left")
        return own.select("cluster_id", "event_id", "is_representative", "size", *told, "article_id", "impacts", similarity.alias("similarity"))

    k = written_by(every.count(), ["event_id"], known, "cluster_events")
    drop_written(every)
    node_of = lambda prefix, c: F.when(F.col(c) != "", F.concat(F.lit(prefix), c))
    e, ec, vc = node_of("event:", "event_id"), F.concat(F.lit("entity_cluster:"), "cluster_id"), F.concat(F.lit("event_cluster:"), "cluster_id")
    day = lambda c: F.concat(F.lit("date:"), F.col(c).cast("string"))
    about = [
        edge(vc, node_of("ticker:", "ticker"), "CLUSTER_INVOLVES_TICKER", none, none), edge(vc, node_of("event_type:", "event_type"), "CLUSTER_HAS_TYPE", none, none),
        edge(vc, day("event_date_start"), "CLUSTER_OCCURRED_ON", none, none), edge(vc, F.when(F.col("event_date_end") != F.col("event_date_start"), day("event_date_end")), "CLUSTER_PERIOD_END", none, none),
        edge(vc, node_of("company_ticker:", "ticker"), F.concat(F.lit("CLUSTER_"), X.company_relation(F.col("event_type"))), none, none), edge(vc, node_of("entity_cluster:", "primary"), "CLUSTER_INVOLVES_ENTITY_CLUSTER", none, none),
    ]
    fused = [edge(e, vc, "FUSED_INTO_EVENT_CLUSTER", F.col("article_id"), F.col("event_id"), F.col("similarity")), edge(F.when(F.col("is_representative"), vc), e, "CANONICAL_EVENT_REPRESENTS", none, F.col("event_id"))]
    low = k.select("cluster_id", "size", F.explode(F.array_distinct(F.transform("metrics", F.lower))).alias("metric"))
    metric = low.select("size", F.inline(F.array(edge(vc, F.concat(F.lit("metric_mention:"), X.short_sha1(F.nullif("metric", F.lit("")), 18)), "CLUSTER_MENTIONS_METRIC", none, none))))
    one = F.col("size") == 1
    named = F.when(F.col("source").isin("main_company", "anchor_impact") & (F.col("name") != ""), F.concat(F.lit("company:"), X.short_sha1(F.lower("name"), 16))).otherwise(F.concat(F.lit("entity:"), X.short_sha1(F.lower("name"), 18)))
    node = F.coalesce(node_of("company_ticker:", "ticker"), named)
    mentioned = [edge(node, ec, "FUSED_INTO_ENTITY_CLUSTER", none, none), edge(F.when(F.col("is_representative"), ec), node, "CANONICAL_ENTITY_REPRESENTS", none, none), edge(e, ec, "MENTIONS_ENTITY_CLUSTER", F.col("article_id"), F.col("event_id"))]
    first = k.where("ticker <> ''").dropna(subset=["event_date_start"]).groupBy("ticker", "cluster_id").agg(F.min("event_date_start").alias("day")).withColumnRenamed("cluster_id", "event_id")
    after = followers(first, "day", "").select(F.inline(F.array(edge(F.concat(F.lit("event_cluster:"), "source"), F.concat(F.lit("event_cluster:"), "target"), "EVENT_CLUSTER_PRECEDES", none, none))))
    hit = k.select("cluster_id", "event_id", F.inline("impacts")).select(vc.alias("source"), F.concat(F.lit("company_ticker:"), "anchor").alias("target"), F.concat(F.lit("CLUSTER_"), "relation").alias("edge_type"), "weight", "event_id")
    order = F.struct("event_id", (-F.abs("weight")).alias("a"), (-F.col("weight")).alias("w"))
    hits = hit.groupBy("source", "target", "edge_type").agg(F.min_by("weight", order).alias("weight")).select("*", none.alias("article_id"), none.alias("event_id"))
    # Edges of a cluster and its own members, and of a cluster of one, are there once; only the others are made distinct.
    once = [k.select(F.inline(F.array(*fused))), k.where("is_representative").select(F.inline(F.array(*about))), metric.where(one).drop("size"), hits]
    repeated = [mentions.join(articles, "event_id", "left").select(F.inline(F.array(*mentioned))), metric.where(~one).drop("size"), after]
    whole = "source is not null and target is not null"
    return reduce(DataFrame.unionByName, [*[p.where(whole) for p in once], reduce(DataFrame.unionByName, [p.where(whole) for p in repeated]).distinct()])


def fusion_report(entities: tuple[DataFrame, DataFrame], events: tuple[DataFrame, DataFrame], considered: DataFrame, accepted: DataFrame) -> DataFrame:
    """One row of counters of events, clusters, members, mentions and pairs (a row of which stands for n).

    Members and mentions are summed up from the sizes of their clusters, so they aren't shuffled again.
    """
    c, k = events[0], entities[0]
    total = lambda column: F.coalesce(F.sum(column), F.lit(0))
    one = [
        c.agg(total("size").alias("event_count"), F.count("*").alias("event_cluster_count"), F.count_if(F.col("size") > 1).alias("event_multi_member_cluster_count"), total(F.when(F.col("size") > 1, F.col("size"))).alias("event_fused_member_count")),
        k.agg(total("mentions").alias("entity_mention_count"), F.count("*").alias("entity_cluster_count"), F.count_if(F.col("mentions") > 1).alias("entity_multi_member_cluster_count")),
        considered.agg(total("n").alias("event_pairs_considered")), accepted.agg(total("n").alias("event_pairs_accepted")),
    ]
    # Rows of one, each.
    return reduce(lambda x, y: x.crossJoin(F.broadcast(y)), one)
