"""Operators over texts, spans, sections, aliases and extracted records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import jsontext
from loomgraph.functions import text as X
from loomgraph.functions import vocabulary as V


def evidence_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, pos, sentence, tickers, figures, temporal, causal of each sentence with a word of finance and a figure or one of the text's tickers, in order.

    docs: doc_id, text, ticker (the source's own, may be null). At most 12 figures a sentence, as they stand there.
    """
    s = docs.select("doc_id", X.tagged_tickers("text", F.col("ticker")).alias("known"), F.posexplode(X.sentences("text")).alias("pos", "sentence"))
    named = F.filter("known", lambda t: F.regexp_like(F.col("sentence"), F.concat(F.lit(r"\b\Q"), t, F.lit(r"\E\b"))))
    figures = F.transform(F.regexp_extract_all("sentence", F.lit(V.EVIDENCE_FIGURES), F.lit(0)), X.clean)
    found = s.where(F.col("sentence").rlike(V.FINANCE)).select("doc_id", "pos", "sentence", named.alias("tickers"), F.slice(figures, 1, 12).alias("figures"))
    c = F.col("sentence")
    return found.where((F.size("tickers") > 0) | (F.size("figures") > 0)).withColumns({"temporal": c.rlike(V.PERIODS), "causal": c.rlike(V.CAUSES)})


def alias_mentions(docs: DataFrame, aliases: DataFrame, most: int = 20_000) -> DataFrame:
    """doc_id, ticker of each alias that stands in a text with no letter or digit beside it (aliases: ticker, alias).

    Texts and aliases meet on the alias's first word, an equi-join; the boundary test follows. The number of aliases doesn't matter.
    """
    a = aliases.select("ticker", F.lower(X.clean("alias")).alias("alias")).where("alias <> ''").distinct().withColumn("head", F.regexp_extract("alias", "[a-z0-9]+", 0))
    a = a.withColumn("wanted", F.concat(F.lit(" "), F.trim(F.regexp_replace("alias", "[^a-z0-9]+", " ")), F.lit(" ")))
    w = docs.select("doc_id", F.lower(X.clean("text")).alias("t"))
    heads = w.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit("[a-z0-9]+"), F.lit(0)))).alias("head"))
    hits = heads.join(F.broadcast(a) if a.limit(most + 1).count() <= most else a, "head").select("doc_id", "ticker", "wanted")
    # The text is brought to words once, before the join, not once a hit.
    padded = w.select("doc_id", F.concat(F.lit(" "), F.regexp_replace("t", "[^a-z0-9]+", " "), F.lit(" ")).alias("padded"))
    return hits.join(padded, "doc_id").where(F.contains(F.col("padded"), F.col("wanted"))).select("doc_id", "ticker").distinct()


def resolved_keys(items: DataFrame, registry: DataFrame) -> DataFrame:
    """id, target: for each item the target of its first key that the registry knows (items: id, keys; registry: key, target)."""
    k = items.select("id", F.posexplode("keys").alias("pos", "key"))
    return k.join(registry, "key").groupBy("id").agg(F.min_by("target", "pos").alias("target"))


def section_of_spans(spans: DataFrame, sections: DataFrame, slot: int = 500) -> DataFrame:
    """doc_id, span, section: the section with most overlap, of equal ones the first; UNKNOWN without any (spans: doc_id, span, s, e).

    Both are exploded to slots of ``slot`` characters and meet on document and slot, so only neighbours are compared.
    """
    slots = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / slot), F.greatest(F.floor(F.col(a) / slot), F.floor((F.col(b) - 1) / slot))))
    left = spans.where("e > s").select("doc_id", "span", "s", "e", slots("s", "e").alias("slot"))
    right = sections.where("e > s").select("doc_id", "section", F.col("s").alias("a"), F.col("e").alias("b"), slots("s", "e").alias("slot"))
    met = left.join(right, ["doc_id", "slot"]).select("doc_id", "span", "section", "a", (F.least("e", "b") - F.greatest("s", "a")).alias("o")).where("o > 0")
    best = met.groupBy("doc_id", "span").agg(F.max_by("section", F.struct("o", (-F.col("a")).alias("a"))).alias("section"))
    return spans.select("doc_id", "span").join(best, ["doc_id", "span"], "left").select("doc_id", "span", F.coalesce("section", F.lit("UNKNOWN")).alias("section"))


def normalised_period(df: DataFrame, start: str, end: str) -> DataFrame:
    """start and end put in order, a missing one mirrored from the other."""
    a, b = F.coalesce(start, end), F.coalesce(end, start)
    return df.withColumns({start: F.least(a, b), end: F.greatest(a, b)})


def decisions_applied(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """candidates with outcome accepted, rejected or missing (decisions: ref, decision; the last of a ref by seq counts)."""
    last = decisions.groupBy("ref").agg(F.max_by("decision", "seq").alias("decision"))
    o = F.when(F.col("decision").isNull(), "missing").when(F.lower("decision") == "accept", "accepted").otherwise("rejected")
    return candidates.join(last, "ref", "left").withColumn("outcome", o).drop("decision")


def disjoint_spans(spans: Column) -> Column:
    """Texts of a list without those that equal, contain or are contained in an earlier kept one."""
    return F.aggregate(spans, F.array().cast("array<string>"), lambda acc, s: F.when(F.exists(acc, lambda k: F.contains(k, s) | F.contains(s, k)), acc).otherwise(F.concat(acc, F.array(s))))


def packed_blocks(items: Column, size: int) -> Column:
    """Texts packed greedily, in order, into blocks of at most ``size`` characters."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def step(acc, s):
        fits = (acc["n"] == 0) | (acc["n"] + F.length(s) <= size)
        return F.when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(s)).alias("open"), (acc["n"] + F.length(s)).alias("n"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), F.array(s).alias("open"), F.length(s).alias("n"))
        )

    return F.aggregate(items, start, step, lambda acc: F.when(F.size(acc["open"]) == 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def truthy(c: Column) -> Column:
    """Whether a flag, as text, number or boolean, says yes."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "yes", "1"), F.lit(False))


def useful_spans(spans: DataFrame) -> DataFrame:
    """The spans with a text that are marked as a financial fact (columns text, contains_financial_fact)."""
    return spans.where((X.clean("text") != "") & truthy(F.col("contains_financial_fact")))


def section_type(c: Column) -> Column:
    """A known section type, else unknown."""
    kind = F.lower(X.clean(c))
    return F.when(kind.isin(V.SECTION_TYPES), kind).otherwise("unknown")


def section_allowed(kind: Column, flag: Column) -> Column:
    """Whether a section may support an event: of an allowed type, and not marked as disallowed."""
    allowed = section_type(kind).isin(V.ALLOWED_SECTION_TYPES)
    return allowed & F.when(flag.isNull(), allowed).otherwise(truthy(flag))


def quote_bounds(article: Column, start: Column, end: Column, reach: int = 4000) -> Column:
    """first, last: where a section lies by its first and last words; with only one of the two found, ``reach`` characters from it; null with neither."""
    return _bounds(X.clean(article), X.clean(start), X.clean(end), reach)


def _bounds(t: Column, a: Column, b: Column, reach: int) -> Column:
    s = F.when(a != "", F.position(a, t) - 1).otherwise(-1)
    e0 = F.when(b != "", F.position(b, t, F.greatest(s, F.lit(0)) + 1) - 1).otherwise(-1)
    e = F.when(e0 >= 0, e0 + F.length(b)).otherwise(-1)
    pair = lambda x, y: F.struct(x.cast("int").alias("first"), y.cast("int").alias("last"))
    return F.when((s >= 0) & (e >= s), pair(s, e)).when(s >= 0, pair(s, F.least(F.length(t), s + reach))).when(e >= 0, pair(F.greatest(F.lit(0), e - reach), e))


def annotated_spans(articles: DataFrame, sections: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, span, section, kind, allowed of each useful span: the section that overlaps it most, else the first whose quote and the span contain one another, else UNKNOWN.

    articles: doc_id, text; sections: doc_id, section, kind, flag, start_quote, end_quote; spans: doc_id, span, text, contains_financial_fact. A span that isn't found word for word is
    looked for by its first 160 characters, if it has 40.
    """
    # Texts are tidied once, before the joins, not once a section or span.
    texts = articles.select("doc_id", X.clean("text").alias("body"))
    quoted = sections.select("doc_id", "section", X.clean("start_quote").alias("a"), X.clean("end_quote").alias("b"))
    bound = quoted.join(texts, "doc_id").select("doc_id", "section", _bounds(F.col("body"), F.col("a"), F.col("b"), 4000).alias("at"))
    said = F.col("said")
    here = F.position(said, F.col("body"))
    near = F.when(F.length(said) >= 40, F.position(F.substring(said, 1, 160), F.col("body"))).otherwise(0)
    useful = useful_spans(spans).select("doc_id", "span", X.clean("text").alias("said"))
    placed = useful.join(texts, "doc_id").select("doc_id", "span", "said", F.when(here > 0, here - 1).when(near > 0, near - 1).alias("s")).withColumn("e", F.col("s") + F.length("said"))
    over = section_of_spans(placed.where("s is not null").select("doc_id", "span", "s", "e"), bound.where("at is not null").select("doc_id", "section", F.col("at.first").alias("s"), F.col("at.last").alias("e")))
    quotes = sections.select("doc_id", F.col("section").alias("quoted"), F.lower(X.clean("start_quote")).alias("a"), F.lower(X.clean("end_quote")).alias("b"))
    low = F.lower("said")
    told = lambda q: (F.col(q) != "") & (F.contains(low, F.col(q)) | F.contains(F.col(q), low))
    by_quote = placed.join(quotes, "doc_id").where(told("a") | told("b")).groupBy("doc_id", "span").agg(F.min("quoted").alias("quoted"))
    found = placed.select("doc_id", "span").join(over, ["doc_id", "span"], "left").join(by_quote, ["doc_id", "span"], "left")
    named = found.select("doc_id", "span", F.coalesce(F.nullif("section", F.lit("UNKNOWN")), "quoted", F.lit("UNKNOWN")).alias("section"))
    kinds = sections.select("doc_id", "section", section_type(F.col("kind")).alias("kind"), section_allowed(F.col("kind"), F.col("flag")).alias("allowed"))
    return named.join(kinds, ["doc_id", "section"], "left").select("doc_id", "span", "section", F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("allowed", F.lit(True)).alias("allowed"))


def non_empty_or(preferred: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """The preferred rows, and for keys without any those of the fallback."""
    return preferred.unionByName(fallback.join(preferred.select(key).distinct(), key, "left_anti"))


def repair_json(text: str | None) -> str | None:
    """The first JSON object of a model's reply, mended and written in one stable way; null if there is none."""
    found = jsontext.first_object(text)
    return None if found is None else jsontext.dumped(found)


def repaired(df: DataFrame, column: str) -> DataFrame:
    """df with the column's JSON repaired, in batches."""
    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            x[column] = [repair_json(t) for t in x[column]]
            yield x

    return df.mapInPandas(f, df.schema)
