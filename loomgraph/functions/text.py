"""Text rules as column expressions: cleaning, tickers, names, tags, figures and event vocabulary.

Nulls count as empty text unless a function says otherwise; every function returns a column that is null-free
for a null-free rule, so that results don't depend on how empty values were read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions import vocabulary as V

def clean(c: Column | str) -> Column:
    """Null as empty, runs of white space (also beyond ASCII) as one blank, trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def strip_only(c: Column | str) -> Column:
    """Null as empty, outer white space gone; inner line breaks survive."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def ticker_symbol(c: Column | str) -> Column:
    """Upper case, nothing but letters, digits, points and hyphens."""
    return F.regexp_replace(F.upper(clean(c)), r"[^A-Z0-9.\-]", "")


def ticker_plain(c: Column | str) -> Column:
    return F.upper(clean(c))


def _replaced(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return c


def entity_name(c: Column | str) -> Column:
    """A company name without quotes, exchange tags, possessive, any number of legal suffixes at its end, share class and foreign characters."""
    tag = rf"(?:{V.EXCHANGES})\s*:\s*[A-Z0-9.\-]+"
    return F.trim(_replaced(
        strip_only(c), ("[\"“”‘’]+", ""), (rf"(?i)\s*\({tag}\)\s*", " "), (rf"(?i)\s*\b{tag}\b\s*", " "), (r"(?U)\s+", " "), (r"(?i)'s\b", ""),
        (rf"(?i)(?:(?:,\s*)?\b(?:{V.LEGAL_SUFFIXES})\.?\s*)+$", ""), (r"(?i)\b(?:Class A|Class B)\b", ""), (r"[^A-Za-z0-9&.\- ]+", " "), (r"^\s+|\s+$", ""), (r"\s+", " "), (r"[\s.,-]+$", ""),
    ))


def resolution_keys(name: Column, ticker: Column) -> Column:
    """Ordered distinct non-empty keys of an entity: name, name without .com, name without blanks, ticker; lower case, without marks at the end."""
    n = entity_name(name)
    keys = F.array(n, F.regexp_replace(n, r"(?i)\.com$", ""), F.regexp_replace(n, r"\s+", ""), ticker_symbol(ticker))
    return F.array_distinct(F.filter(F.transform(keys, lambda k: F.regexp_replace(F.lower(F.trim(k)), r"[\s.,-]+$", "")), lambda k: k != ""))


def short_sha1(c: Column, length: int) -> Column:
    return F.substring(F.sha1(c.cast("binary")), 1, length)


def iso_date(c: Column | str) -> Column:
    """The date in the first ten characters, null if there is none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(F.substring(F.trim(c), 1, 10), F.lit("yyyy-MM-dd")).cast("date")


DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss z", "yyyy/MM/dd", "MM/dd/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyyMMdd", "yyyy-MM"]


def parsed_date(c: Column | str) -> Column:
    """The UTC date, as text, of a time in ISO notation or one of ``DATE_FORMATS``; empty if it can't be read."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    # A bare number isn't a year here.
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ].*)?$"), c.try_cast("timestamp"))
    times = [iso, *(F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS)]
    return F.coalesce(F.date_format(F.coalesce(*times), "yyyy-MM-dd"), F.lit(""))


def event_type(c: Column | str) -> Column:
    """The event type that a label stands for by itself or as an alias; another label comes out as it is, trimmed."""
    label = strip_only(c)
    key = _replaced(F.lower(label), ("[^a-z0-9]+", "_"), ("^_+|_+$", ""))
    known = F.when(key.isin(V.EVENT_TYPES), key)
    for kind, aliases in V.EVENT_TYPE_ALIASES.items():
        known = known.when(key.isin(aliases.split()), kind)
    return F.coalesce(known, label)


def event_polarity(kind: Column) -> Column:
    """1 for event types that are good news by themselves, -1 for bad, else 0."""
    return F.when(kind.isin(V.POSITIVE_EVENT_TYPES), 1.0).when(kind.isin(V.NEGATIVE_EVENT_TYPES), -1.0).otherwise(0.0)


def _mapped(c: Column, pairs: dict[str, str], default: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), F.lit(default))


def company_relation(kind: Column) -> Column:
    """The relation of an event of this type to its company."""
    return _mapped(event_type(kind), V.COMPANY_RELATIONS, "EVENT_INVOLVES_COMPANY")


def impact_relation(kind: Column) -> Column:
    """The relation of an event to a company that it has this impact on."""
    return _mapped(impact_type(kind, F.lit("")), V.IMPACT_RELATIONS, "RELATED_TO_ANCHOR")


def reverse_relation(kind: Column) -> Column:
    clean_ = _replaced(F.upper(F.coalesce(kind, F.lit(""))), ("[^A-Z0-9_]+", "_"), ("^_+|_+$", ""))
    return F.when(clean_ == "", "REV_RELATED_TO").otherwise(F.concat(F.lit("REV_"), clean_))


def inferred_impact(kind: Column) -> Column:
    """The impact that an event of this type has on a company it only names."""
    return _mapped(kind, {event: impact for impact, events in V.INFERRED_IMPACTS.items() for event in events.split()}, "mentioned")


def tagged_tickers(c: Column | str, source: Column | None = None) -> Column:
    """Distinct tickers of exchange tags, first those in brackets such as (NASDAQ: X), then any; before them the source's own if it isn't among them."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    tag = rf"(?:{V.EXCHANGES})\s*:\s*([A-Z][A-Z0-9.\-]{{0,9}})"
    found = F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in (rf"(?i)\({tag}\)", rf"(?i)\b{tag}\b")])
    out = F.array_distinct(F.transform(found, F.upper))
    if source is None:
        return out
    own = ticker_symbol(source)
    return F.when((own == "") | F.array_contains(out, own), out).otherwise(F.concat(F.array(own), out))


def sentences(c: Column | str) -> Column:
    """Sentences of a text: parted after . ! ? and white space, but not after common abbreviations."""
    dotted, plain = [a for a in V.ABBREVIATIONS if "." in a], [a for a in V.ABBREVIATIONS if "." not in a]
    s = F.regexp_replace(clean(c), rf"({'|'.join(sorted(plain, key=len, reverse=True))})\.", "$1\u0001")
    for a in dotted:
        s = F.replace(s, F.lit(a + "."), F.lit(a.replace(".", "\u0001") + "\u0001"))
    parts = F.split(s, r"(?U)(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda x: F.trim(F.replace(x, F.lit("\u0001"), F.lit(".")))), lambda x: x != "")


def metric_key(c: Column) -> Column:
    """A figure as it is compared: lower case, without words like "about", commas and extra blanks."""
    return F.trim(_replaced(F.lower(clean(c)), (V.APPROXIMATORS, ""), (",", ""), (r"\s+", " ")))


def distinct_by(items: Column, key) -> Column:
    """The first item of each key that isn't empty, in order; each key is computed once."""
    pairs = F.transform(items, lambda x: F.struct(key(x).alias("k"), x.alias("v")))
    none = F.array().cast("array<string>")

    def step(acc, x):
        more = F.struct(F.concat(acc["ks"], F.array(x["k"])).alias("ks"), F.concat(acc["vs"], F.array(x["v"])).alias("vs"))
        return F.when((x["k"] == "") | F.array_contains(acc["ks"], x["k"]), acc).otherwise(more)

    return F.aggregate(pairs, F.struct(none.alias("ks"), none.alias("vs")), step, lambda acc: acc["vs"])


def metric_mentions(c: Column | str) -> Column:
    """Figures with their units, periods, ranks and multiples as they stand in the text, the first of each that is compared alike."""
    return distinct_by(F.transform(F.regexp_extract_all(clean(c), F.lit(V.MENTIONS), F.lit(0)), clean), metric_key)


def span_metrics(declared: Column, text: Column) -> Column:
    """Declared figures and those of the text, the first of each that is compared alike."""
    given = F.filter(F.transform(F.coalesce(declared, F.array().cast("array<string>")), clean), lambda x: x != "")
    return distinct_by(F.concat(given, metric_mentions(text)), metric_key)


def metric_values(c: Column | str) -> Column:
    """Sorted distinct figures without commas and blanks; percent as %."""
    found = F.regexp_extract_all(clean(c), F.lit(V.VALUES), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.replace(_replaced(F.lower(x), (",", ""), (r"(?U)\s+", "")), F.lit("percent"), F.lit("%")))))


def has_word(c: Column, words: list[str]) -> Column:
    return F.lower(c).rlike(r"\b(?:" + "|".join(words) + r")\b")


def direction_signature(c: Column | str) -> Column:
    """positive or negative if the text has words of one of the two only, else neutral."""
    c = clean(c)
    up, down = has_word(c, V.POSITIVE_WORDS), has_word(c, V.NEGATIVE_WORDS)
    return F.when(up & ~down, "positive").when(down & ~up, "negative").otherwise("neutral")


def compared_text(c: Column | str) -> Column:
    """A description as it is compared: lower case, without full stops at the end, letters, digits and % $ . , only."""
    return F.trim(_replaced(F.lower(clean(c)), (r"\.+$", ""), (r"[^a-z0-9%$., ]+", " "), (r"\s+", " ")))


def _key(c: Column) -> Column:
    return _replaced(F.lower(clean(c)), ("[^a-z0-9]+", "_"), ("^_+|_+$", ""))


def _any_of(c: Column, marks: list[str]) -> Column:
    return c.rlike("|".join(marks))


def impact_direction(label: Column) -> Column:
    """Neutral marks are tested before positive ones, which are tested as substrings: "up" also matches inside "supply"."""
    key = _key(label)
    return (
        F.when(key.isin("positive", "negative", "neutral"), key).when(_any_of(key, V.NEUTRAL_MARKS), "neutral").when(_any_of(key, V.POSITIVE_MARKS), "positive")
        .when(_any_of(key, V.NEGATIVE_MARKS), "negative").otherwise("neutral")
    )


def impact_direction_in_context(label: Column, company: Column, kind: Column, evidence: Column) -> Column:
    """The direction, but positive for a supplier or customer whose evidence tells of demand that it can't meet and of no harm to it."""
    said, name = F.lower(clean(evidence)), F.lower(clean(company))
    signs = lambda x: F.exists(F.array(*map(F.lit, x)), lambda p: F.contains(said, p))
    unable = r"\b[^.]*\b(?:cannot|can't|can not|not able to|isn't able to|unable to|not being able to)\b[^.]*\b(?:supply|deliver|keep up|get enough|meet)"
    subject = F.regexp_like(said, F.concat(F.lit(r"\b\Q"), name, F.lit(r"\E" + unable)))
    short = (impact_type(kind, F.lit("")) == "supplier_customer") & (name != "") & F.contains(said, name) & subject & signs(V.DEMAND_SIGNS) & signs(V.SHORTAGE_SIGNS) & ~signs(V.HARM_SIGNS)
    return F.when(short, "positive").otherwise(impact_direction(label))


def impact_score(direction: Column) -> Column:
    return F.when(direction == "positive", 1.0).when(direction == "negative", -1.0).otherwise(0.1)


def impact_type(label: Column, kind: Column) -> Column:
    """An ordered cascade of substrings over label and event type; "direct" also matches inside "indirect"."""
    key = _key(label)
    s = F.lower(F.concat(key, F.lit(" "), event_type(kind)))
    out = F.lit("other")
    for impact, marks in reversed(V.IMPACT_MARKS):
        out = F.when(s.rlike(marks), impact).otherwise(out)
    return out


def promotional(c: Column | str) -> Column:
    """Whether a text is a promotion or a disclosure of the publisher rather than news."""
    t = F.lower(clean(c))
    named = lambda marks: F.exists(F.array(*map(F.lit, marks)), lambda p: F.contains(t, p))
    out = named(V.PROMOTION)
    for service, marks in V.PROMOTED.items():
        out = out | (F.contains(t, F.lit(service)) & named(marks))
    for pattern in V.DISCLOSURES:
        out = out | t.rlike(pattern)
    return out


def safe_key(*parts: Column) -> Column:
    """Parts with non-word characters as _, empty ones as UNKNOWN, joined by __."""
    one = lambda p: F.coalesce(F.nullif(F.regexp_replace(F.coalesce(p, F.lit("")), "[^A-Za-z0-9_]+", "_"), F.lit("")), F.lit("UNKNOWN"))
    return F.concat_ws("__", *map(one, parts))


def joined_text(*parts: Column, sep: str = " | ") -> Column:
    return F.concat_ws(sep, *(F.nullif(clean(p), F.lit("")) for p in parts))


def chunks(c: Column | str, size: int = 1800, most: int = 12) -> Column:
    """Words packed greedily into chunks of at most ``size`` characters; a longer word stands alone. At most ``most`` chunks."""
    words = F.filter(F.split(clean(c), " "), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, w):
        fits = F.length(acc["open"]) + 1 + F.length(w) <= size
        return F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), w.alias("open"))).when(
            fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(" "), w).alias("open"))
        ).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), w.alias("open")))

    packed = F.aggregate(words, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    return F.slice(packed, 1, most)


def cache_key(model: str, limits: str, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(model), F.lit(limits), F.coalesce(text, F.lit(""))), 256)


def finite(c: Column, default: float) -> Column:
    """A parsed number; null, NaN and infinities as the default."""
    x = F.expr("1").cast("double") * c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def mentions_entity(text: Column, name: Column) -> Column:
    """Whether the name, as typed or without its legal form, stands in the text with no letter or digit beside it, whatever the case."""
    t = clean(text)
    one = lambda n: (n != "") & F.regexp_like(t, F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])\Q"), n, F.lit(r"\E(?![A-Za-z0-9])")))
    return one(clean(name)) | one(entity_name(name))
