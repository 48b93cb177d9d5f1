"""Variant spellings of names typed by people, linked to the firms of a registry.

Distinct names and the registry's spellings (full names without legal form, aliases, initials) are brought to vectors of
character trigrams, weighted by their rarity among the registry's spellings, and joined on the trigrams: the ``TOP`` spellings of highest cosine
of each name, from ``LEAST_COSINE`` and from ``NEAR`` of its highest one on. Names are spread by name before their trigrams are exploded, so products are
summed where they arise. The registry's postings are broadcast if they are few (``MOST_POSTINGS``, checked), else joined by hash.

A joined pair is kept if it stands the test of words: a name's own words must agree with the firm's but for slips of the keyboard, and its
words of the trade (those that several firms of the registry share, also shortened, misspelt or joined) must all be the firm's.
Left-out words are allowed, other ones aren't.

Names and spellings are then clustered by average linkage. The spellings of a firm are a cluster from the start; a name joins the
cluster with which its mean cosine over all the cluster's spellings is highest, ``LEAST_LINK`` at least. A name whose words agree equally well with two firms joins
none, as it is no spelling of exactly one.

Words of the trade, nicknames and rarities are counted over the whole registry whatever its size. Names are counted once however often they are typed, so a
firm with a third of all mentions is no hot spot. Null and blank names link to nothing; repeated rows count once. The node's own ticker isn't used.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomgraph.scratch import written

TOP, LEAST_COSINE, NEAR, LEAST_LINK = 20, 0.2, 0.5, 0.05
MOST_POSTINGS, MOST_WORDS = 2_000_000, 1_000_000
#: Legal forms and titles of companies.
LEGAL = set("inc incorporated corp corporation co company companies ltd limited plc ag nv sa llc lp llp gmbh se spa bv oyj ab group grp holdings holding hldgs hldg the".split())
#: Sequences of single letters that are legal forms when dotted.
_DOTTED = re.compile(r"\b(n\.? ?v|s\.? ?a|a\.? ?g|p\.? ?l\.? ?c|l\.? ?l\.? ?c|l\.? ?p|b\.? ?v)\.?(?=$|[\s,'\"])")
_TAG = re.compile(r"[(\[][^()\[\]]{0,30}:[^()\[\]]{0,20}[)\]]|[(\[](?:nyse|nasdaq|amex|lse|otc)[^()\[\]]{0,20}[)\]]", re.I)
_FORM = re.compile(r",?\s+(?:inc|corp|co|ltd|llc|plc|ag|nv|sa|group|grp|holdings?)\.?$", re.I)
_INITIALS = re.compile(r"^(?:[A-Z]\.? ?){2,5}$")


def fold(name: str) -> str:
    """Without accents, marks, exchange tags, quotes and possessives."""
    s = unicodedata.normalize("NFKD", _TAG.sub(" ", name).replace("’", "'").replace("‘", "'"))
    s = "".join(c for c in s if not unicodedata.combining(c))
    s = re.sub(r"[®™©]|\((?:r|tm|c)\)|\b(?:TM)\b", " ", s)
    s = re.sub(r"'s\b|'(?=\s|$)|(?<=s)'(?=\W|$)", "", s, flags=re.I)
    return s.replace('"', " ").replace("&", " and ").strip()


def tokens(name: str) -> list[str]:
    """Lower-case words without legal forms; words run together in capitals are parted."""
    s = re.sub(r"(?<=[a-z]{2})(?=[A-Z])", " ", fold(name))
    return [w for w in re.findall(r"[a-z0-9]+", _DOTTED.sub(" ", s.lower())) if w not in LEGAL]


def initials(name: str) -> str | None:
    """The letters of a name that is nothing but two to five capitals, with or without points and a legal form."""
    bare = fold(name)
    without = _FORM.sub("", bare).strip()
    return re.sub(r"[^a-z]", "", without.lower()) if _INITIALS.match(without) and re.sub(r"[^A-Za-z]", "", bare).isupper() else None


@lru_cache(maxsize=1_000_000)
def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours from a to b; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before2, before = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if before2 is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before2[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before2, before = before, row
    return min(before[-1], most + 1)


def slips(word: str) -> int:
    """Slips that a word of this length may have."""
    return 0 if len(word) < 4 else 1 if len(word) < 6 else 2 if len(word) < 10 else 3


def _subsequence(short: str, word: str) -> bool:
    it = iter(word)
    return all(c in it for c in short)


def grams(words: list[str]) -> Counter:
    """Character trigrams of each word with its ends, so that the order of words doesn't matter."""
    return Counter(f"^{w}$"[i : i + 3] for w in words for i in range(max(1, len(w))))


class Lexicon:
    """Words of trade and place, and nicknames, of a whole registry."""

    def __init__(self, trade: set[str], nick: set[str], of: set[str]):
        self.trade, self.nick, self.of = trade, nick, of
        self.heads = {t[:k] for t in self.trade for k in range(4, len(t))}
        self._trades: dict[str, tuple[set[str], int]] = {}

    def trades(self, word: str) -> tuple[set[str], int]:
        """The words of trade that a typed word may stand for, and the slips it then has."""
        if word not in self._trades:
            if len(self._trades) > 100_000:
                self._trades.clear()
            self._trades[word] = self._trade(word)
        return self._trades[word]

    def _trade(self, word: str) -> tuple[set[str], int]:
        if word in self.trade:
            return {word}, 0
        if len(word) < 2:
            return set(), 0
        starts = {t for t in self.trade if t.startswith(word) or word.endswith("s") and len(word) > 3 and t.startswith(word[:-1])}
        if starts or len(word) == 2:
            return starts, 0
        near = {t: edits(word, t, min(2, slips(t))) for t in self.trade if abs(len(t) - len(word)) <= 2}
        near = {t: d for t, d in near.items() if d <= min(2, slips(t))}
        if near:
            least = min(near.values())
            return {t for t, d in near.items() if d == least}, least
        return {t for t in self.trade if len(word) < len(t) and len(word) <= 8 and word[0] == t[0] and _subsequence(word, t)}, 0

    def parted(self, words: list[str]) -> list[str]:
        """Words with those of trade cut from the ends of longer ones they are joined to."""
        out = []
        for w in words:
            if w.endswith("of") and w[:-2] in self.of:
                w = w[:-2]
            for _ in range(3):
                if w in self.trade or len(w) < 9:
                    break
                cut = None
                for t in self.of:
                    if w.startswith(t + "of") and len(w) > len(t) + 3:
                        cut = (t, w[len(t) + 2 :])
                # The longest end of the word that is a word of trade, else its beginning, else one with slips.
                for k in range(min(16, len(w) - 3), 3, -1):
                    if cut:
                        break
                    if w[:k] in self.trade:
                        cut = (w[:k], w[k:])
                    elif w[-k:] in self.trade:
                        cut = (w[-k:], w[:-k])
                for k in range(min(16, len(w) - 3), 3, -1):
                    if cut:
                        break
                    if w[-k:] in self.heads:
                        cut = (w[-k:], w[:-k])
                    elif k > 5 and self.trades(w[-k:])[1]:
                        cut = (w[-k:], w[:-k])
                    elif k > 5 and self.trades(w[:k])[1]:
                        cut = (w[:k], w[k:])
                if not cut:
                    break
                out.append(cut[0])
                w = cut[1]
            out.append(w)
        return out

    def fits(self, words: list[str], spelling: list[str]) -> tuple[int, int] | None:
        """Slips and left-out words with which the words are this spelling; None if they aren't."""
        own = [w for w in spelling if w not in self.trade and w not in self.nick and w not in ("of", "and")]
        trade = [w for w in spelling if w in self.trade or w in self.nick]
        left, slip = [*trade], 0
        rest = []
        for w in words:
            if w in ("of", "and"):
                continue
            may, d = (set(), 0) if any(edits(w, o, slips(o)) <= slips(o) for o in own) else self.trades(w)
            nick = [t for t in left if t in self.nick and edits(w, t, slips(t)) <= slips(t)]
            hit = [t for t in left if t in may] or nick
            if hit:
                left.remove(hit[0])
                slip += d if hit[0] in may else edits(w, hit[0], 2)
            elif may:
                return None
            else:
                rest.append(w)
        if not own:
            return None if rest or left else (slip, 0)
        if not rest:
            return None
        mine, theirs = "".join(rest), "".join(own)
        d = edits(mine, theirs, slips(theirs))
        if d > slips(theirs):
            mine, theirs = "".join(sorted(rest)), "".join(sorted(own))
            d = edits(mine, theirs, slips(theirs))
            if d > slips(theirs):
                return None
        return slip + d, len(left)


def _spelled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for t, n, a in zip(f["ticker"], f["company"], f["aliases_json"]):
            try:
                aliases = json.loads(a) if a else []
            except ValueError:
                aliases = []
            out.append((t, "name", tokens(n)))
            full = [x for x in re.findall(r"[a-z]+", _DOTTED.sub(" ", fold(n).lower())) if x not in LEGAL]
            short = {"".join(y[0] for y in full), "".join(y[0] for y in full if y not in ("of", "and"))}
            out += [(t, "initials", [x]) for x in sorted(short) if len(x) > 1]
            out += [(t, "alias", tokens(str(x))) for x in (aliases if isinstance(aliases, list) else [])]
        yield pd.DataFrame([x for x in out if x[2]], columns=["ticker", "kind", "words"])


def spellings(companies: DataFrame) -> DataFrame:
    """sid, ticker, kind (name, alias, initials), words of each spelling of each firm."""
    rows = companies.select("ticker", "company", "aliases_json").where("ticker is not null and company is not null").distinct()
    found = rows.mapInPandas(_spelled, "ticker string, kind string, words array<string>").distinct()
    return written(found.withColumn("sid", F.monotonically_increasing_id()), "spellings")


def lexicon(spelled: DataFrame) -> Lexicon:
    """Words of trade: second or later words that several firms have in their names, and first ones that "of" follows in several; nicknames: other words of more than two aliases."""
    names = spelled.where("kind = 'name'")
    later = names.select("ticker", F.explode(F.expr("slice(words, 2, size(words))")).alias("w")).distinct().groupBy("w").count().where("count > 1 and w not in ('of', 'and')").select("w")
    aliases = spelled.where("kind = 'alias'").select("sid", F.explode("words").alias("w")).distinct().groupBy("w").count().where("count > 2").select("w")
    sets = []
    of = names.where("size(words) > 2 and words[1] = 'of'").select("ticker", F.col("words")[0].alias("w")).distinct().groupBy("w").count().where("count > 1").select("w")
    for words in (later, aliases, of):
        found = [r["w"] for r in words.limit(MOST_WORDS + 1).collect()]
        if len(found) > MOST_WORDS:
            raise ValueError(f"more than {MOST_WORDS} words that firms share")
        sets.append(set(found))
    trade, nick, of = sets[0] | sets[2], sets[1] - sets[0] - sets[2], sets[2]
    return Lexicon(trade, nick, of)


def _counts(words: list[str]) -> list[tuple[str, int]]:
    return list(grams(words).items())


def _forms(frames: Iterator[pd.DataFrame], lex: Lexicon) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for nid, n in zip(f["nid"], f["name"]):
            if short := initials(n):
                out.append((nid, 2, [short]))
                continue
            plain = tokens(n)
            parted = lex.parted(plain)
            out.append((nid, 0, plain))
            if parted != plain:
                out.append((nid, 1, parted))
        yield pd.DataFrame([(*x, _counts(x[2])) for x in out if x[2]], columns=["nid", "form", "words", "grams"])


def _grammed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"sid": f["sid"], "grams": [_counts(list(w)) for w in f["words"]]})


def cosine_pairs(forms: DataFrame, spelled: DataFrame, postings: DataFrame) -> DataFrame:
    """nid, form, words, sid, cosine of the ``TOP`` nearest spellings of each form of a name. postings: sid, gram, n; forms: nid, form, words, grams."""
    n = spelled.count()
    idf = written(postings.groupBy("gram").agg(F.log(1 + F.lit(n) / F.count_distinct("sid")).alias("idf")), "idf")
    few = postings.count() <= MOST_POSTINGS
    near = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    weighed = postings.join(near(idf), "gram").withColumn("w", F.col("n") * F.col("idf"))
    norms = weighed.groupBy("sid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    theirs = written(weighed.join(norms, "sid").select("gram", "sid", (F.col("w") / F.col("norm")).alias("v")), "postings")
    key = F.col("nid") * 4 + F.col("form")
    spark = forms.sparkSession
    # Few bytes but much work: by number, or they would be put together into a task or two.
    parts = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = forms.withColumn("key", key).repartition(parts, "key").select("key", F.inline("grams")).join(near(idf), "gram", "left")
    own = own.withColumn("w", F.col("n") * F.coalesce("idf", F.lit(1.0) * F.log(F.lit(1.0 + n))))
    scale = own.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    sums = own.join(near(theirs), "gram").groupBy("key", "sid").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosines = sums.join(scale, "key").withColumn("cosine", F.col("dot") / F.col("norm")).where(F.col("cosine") >= LEAST_COSINE)
    w = W.partitionBy("key").orderBy(F.desc("cosine"), "sid")
    top = cosines.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP).withColumn("best", F.max("cosine").over(W.partitionBy("key")))
    return top.where(F.col("cosine") >= NEAR * F.col("best")).select("key", "sid", "cosine")


def _fitting(frames: Iterator[pd.DataFrame], lex: Lexicon) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for i, (form, mine, kind, theirs) in enumerate(zip(f["form"], f["words"], f["kind"], f["spelling"])):
            if form == 2 or kind == "initials":
                fit = (0, 0) if form == 2 and kind == "initials" and mine[0] == theirs[0] else None
            else:
                fit = lex.fits(list(mine), list(theirs))
            if fit is not None:
                out.append((i, *fit))
        at = [x[0] for x in out]
        yield f.iloc[at][["nid", "form", "sid", "ticker", "cosine"]].assign(slips=[x[1] for x in out], left_out=[x[2] for x in out])


def linked_names(names: DataFrame, companies: DataFrame) -> DataFrame:
    """name, ticker, linkage, slips, left_out of each distinct name that is a spelling of exactly one firm."""
    spelled = spellings(companies)
    lex = names.sparkSession.sparkContext.broadcast(lexicon(spelled))
    distinct = written(names.select("name").where(r"name rlike '(?U)\\w'").distinct().withColumn("nid", F.monotonically_increasing_id()), "names")
    spread = distinct.repartition(max(3 * names.sparkSession.sparkContext.defaultParallelism, int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "nid")
    forms = written(spread.mapInPandas(lambda fs: _forms(fs, lex.value), "nid long, form int, words array<string>, grams array<struct<gram:string,n:int>>"), "forms")
    postings = written(spelled.select("sid", "words").mapInPandas(_grammed, "sid long, grams array<struct<gram:string,n:int>>").select("sid", F.inline("grams")), "grams")
    pairs = cosine_pairs(forms, spelled, postings)
    told = forms.select((F.col("nid") * 4 + F.col("form")).alias("key"), "nid", "form", "words")
    few = F.broadcast(spelled) if spelled.count() <= MOST_POSTINGS // 20 else spelled
    met = pairs.join(told, "key").join(few.select("sid", "ticker", "kind", F.col("words").alias("spelling")), "sid")
    kept = met.select("nid", "form", "words", "sid", "ticker", "kind", "spelling", "cosine").mapInPandas(lambda fs: _fitting(fs, lex.value), "nid long, form int, sid long, ticker string, cosine double, slips int, left_out int")
    kept = written(kept, "fitting")
    # Parted words count only where the name as it is typed fits nothing.
    typed = kept.where("form <> 1").select("nid").distinct()
    kept = kept.where("form <> 1").unionByName(kept.where("form = 1").join(typed, "nid", "left_anti"))
    return _grouped(kept, spelled).join(distinct, "nid").select("name", "ticker", "linkage", "slips", "left_out")


def _grouped(kept: DataFrame, spelled: DataFrame) -> DataFrame:
    """nid, ticker, linkage, slips, left_out: the cluster that each name joins by average linkage, if it is a spelling of one firm only."""
    sizes = spelled.where("kind <> 'initials'").groupBy("ticker").agg(F.count("*").alias("size"))
    firm = kept.groupBy("nid", "ticker").agg(F.sum("cosine").alias("sum"), F.min(F.struct("slips", "left_out")).alias("fit")).join(F.broadcast(sizes), "ticker", "left")
    firm = firm.withColumn("linkage", F.col("sum") / F.greatest(F.coalesce("size", F.lit(1)), F.lit(1)))
    order = W.partitionBy("nid").orderBy("fit", F.desc("linkage"), "ticker")
    ranked = firm.withColumns({"n": F.row_number().over(order), "other": F.lead("fit").over(order)})
    other, own = F.col("other"), F.col("fit")
    doubtful = (other == own) | ((own["left_out"] > 0) & (own["slips"] > 0) & (other["slips"] <= own["slips"] + 1) & (other["left_out"] <= own["left_out"]))
    sure = ranked.where("n = 1").where(other.isNull() | ~doubtful).where(F.col("linkage") >= LEAST_LINK)
    return sure.select("nid", "ticker", "linkage", F.col("fit.slips").alias("slips"), F.col("fit.left_out").alias("left_out"))


def mentions(nodes: DataFrame) -> DataFrame:
    return nodes.where("node_type in ('Entity', 'EntityRawMention') and name is not null and node_id is not null").select("node_id", "name").distinct()


def linked_nodes(nodes: DataFrame, companies: DataFrame) -> DataFrame:
    """node_id, ticker of each Entity and EntityRawMention node whose name is a spelling of exactly one firm."""
    typed = mentions(nodes)
    return typed.join(linked_names(typed, companies).select("name", "ticker"), "name").select("node_id", "ticker").distinct()


def variant_counts(nodes: DataFrame, companies: DataFrame) -> DataFrame:
    """ticker, spelling, mentions: every way a firm's name is typed, and how often."""
    typed = mentions(nodes).groupBy("name").agg(F.count("*").alias("mentions"))
    return linked_names(typed, companies).join(typed, "name").select("ticker", F.col("name").alias("spelling"), "mentions")
