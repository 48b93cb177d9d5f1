"""Near-duplicate records with small edits: a Hamming join of b-bit signatures by several indexes.

A record's set of word runs is drawn into ``SYMBOLS`` minwise symbols of ``BITS`` bits. Two records agree in a symbol with
the probability of their similarity (+ 2**-BITS). The signature is split into chunks, and each chunk is indexed once for each
symbol that may be wrong, that symbol left out. The join on these keys returns every pair under a distance (number of differing
symbols) by the pigeonhole principle, and of the pairs further apart those that share as many keys all the same.

There are two signatures. ``sig`` draws runs by weight: a run that stands in more than ``FREE`` records (or several times the mean of
its bucket) has the inverse of its frequency as its weight, so furniture and stock phrases, whose keys select nothing, seldom make a symbol.
It has chunks of 3, and a pair must share two keys: all pairs at a distance of at most ``GUARANTEED`` do, for with fewer shared keys
all chunks but one have two errors or more and that one has one. ``flat`` draws all runs alike, for records of whose different runs
half or more have a weight of an eighth or less; it has chunks of 4, and one key is enough. A pair alike by half or more whose common runs are
all of such a weight has ``flat`` in common, as they are half of the runs of either; the more of the other runs it shares, the closer it
is in ``sig``. Candidates are verified on the whole sets of runs, all alike.

Occurrences of runs are counted in ``BUCKETS`` buckets of the run's hash, over all records and exactly, so neither the order nor the batches
of the rows matter, and what every task holds is a byte a bucket, whatever the data. Records of the same words are one class
beforehand, so that a group of copies, however large, is one signature.

The keys are sorted by key, and neighbours are paired in one pass. A key of more than ``HOT`` records is split into blocks of about that
many; every two blocks meet in a task of their own, which compares signatures and emits only pairs that are close.

Null or blank bodies take no part. A null title counts as empty. Ids are keys: repeated rows count once. Records with fewer words
than a run have no run and no pair; copies of them are a class all the same, but records without any word are each a class of their own.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.components import connected_components
from loomgraph.llm.words import WordHashes, run_hashes, words
from loomgraph.scratch import written

SYMBOLS, BITS = 96, 16
KINDS = ("sig", "flat")
CHUNK = {"sig": 3, "flat": 4}
GUARANTEED = {"sig": 2 * SYMBOLS // 3 - 2, "flat": 2 * SYMBOLS // 4 - 1}
BUCKETS, _SHIFT = 1 << 20, np.uint64(44)
#: Weights are powers of two down to 2**-_LEAST; from 2**-_SMALL on a run counts as popular.
FREE, _LEAST, _SMALL = 30, 10, 3
HOT = 2000
_KIND = 60
_RNG = np.random.RandomState(20240229)
_A = (_RNG.randint(0, 2**31, SYMBOLS).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.randint(0, 2**32, SYMBOLS, dtype=np.uint64).astype(np.uint32)


def _slices(texts: pd.Series, records: int = 512, chars: int = 2_000_000) -> Iterator[slice]:
    """Ranges of at most so many texts and, but for a single longer text, characters."""
    at = size = 0
    for i, n in enumerate(texts.str.len()):
        if i > at and (i - at >= records or size + n > chars):
            yield slice(at, i)
            at, size = i, 0
        size += n
    if at < len(texts):
        yield slice(at, len(texts))


def _minima(h: np.ndarray, light: np.ndarray, runs: np.ndarray) -> list[bytes | None]:
    """The signature of each list of runs, None for an empty one; h: 32-bit hashes of all lists, light: by what power of two their weights fall, runs: how many each has.

    A run with a weight of 2**-k draws numbers 2**k times as large.
    """
    have = np.flatnonzero(runs)
    out: list[bytes | None] = [None] * len(runs)
    if len(have):
        sig, down = np.empty((len(have), SYMBOLS), dtype=np.uint16), (_LEAST - light).astype(np.uint32)
        starts = (np.cumsum(runs) - runs)[have]
        for i in range(SYMBOLS):
            least = np.minimum.reduceat((h * _A[i] + _B[i]) >> down, starts)
            sig[:, i] = (least * np.uint32(2654435769)) >> np.uint32(16)
        for i, row in zip(have, sig):
            out[i] = row.tobytes()
    return out


def _symbols(sigs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), dtype=np.uint16).reshape(-1, SYMBOLS)


def _counted(frames: Iterator[pd.DataFrame], run: int) -> Iterator[pd.DataFrame]:
    cache, total = WordHashes(), np.zeros(BUCKETS, dtype=np.int64)
    for f in frames:
        for at in _slices(f["text"]):
            h, _ = run_hashes([words(t) for t in f["text"].iloc[at]], run, cache)
            total += np.bincount((h >> _SHIFT).astype(np.int64), minlength=BUCKETS)
    have = np.flatnonzero(total)
    yield pd.DataFrame({"bucket": have, "n": total[have]})


def bucket_weights(records: DataFrame, run: int) -> bytes:
    """For each bucket of runs the power of two by which its weight falls, a byte each, compressed."""
    counts = written(records.select("text").mapInPandas(lambda fs: _counted(fs, run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "runs")
    total = counts.agg(F.sum("n")).first()[0] or 0
    free = max(FREE, 8 * total / BUCKETS)
    light = F.least(F.lit(_LEAST), F.floor(F.log2(F.col("n") / F.lit(free)))).cast("int")
    # At most an eighth of the buckets, as each of these holds eight times the mean or more.
    rows = counts.where(F.col("n") >= 2 * free).select("bucket", light.alias("light")).toPandas()
    out = np.zeros(BUCKETS, dtype=np.uint8)
    out[rows["bucket"].to_numpy(dtype=np.int64)] = rows["light"].to_numpy(dtype=np.uint8)
    return zlib.compress(out.tobytes())


def _signed(frames: Iterator[pd.DataFrame], weights: bytes, run: int) -> Iterator[pd.DataFrame]:
    cache, lightness = WordHashes(), np.frombuffer(zlib.decompress(weights), dtype=np.uint8)
    nine, place = np.uint64(9), np.uint64(55)
    for f in frames:
        for at in _slices(f["text"]):
            ids, lists = f["id"].iloc[at].to_numpy(), [words(t) for t in f["text"].iloc[at]]
            h, runs = run_hashes(lists, run, cache)
            # Record and hash, sorted, each once.
            each = np.unique((np.repeat(np.arange(len(lists), dtype=np.uint64), runs) << place) | (h >> nine))
            own, h = (each >> place).astype(np.int64), each << nine
            light, h = lightness[(h >> _SHIFT).astype(np.int64)], (h >> np.uint64(12)).astype(np.uint32)
            runs, some = (np.bincount(x, minlength=len(lists)) for x in (own, own[light >= _SMALL]))
            most = 2 * some >= np.maximum(runs, 1)
            inside = most[own]
            content = [xxhash.xxh3_128_digest(b" ".join(x) if x else b" " + i.encode()) for x, i in zip(lists, ids)]
            yield pd.DataFrame({"id": ids, "content": content, "sig": _minima(h, light, runs), "flat": _minima(h[inside], np.zeros(inside.sum(), dtype=np.uint8), np.where(most, runs, 0))})


def canonical_signatures(records: DataFrame, run: int) -> DataFrame:
    """id, content (128-bit hash of the words: what is left of a record without case, punctuation and white space), sig, flat."""
    weights = bucket_weights(records, run)
    return records.select("id", "text").mapInPandas(lambda fs: _signed(fs, weights, run), "id string, content binary, sig binary, flat binary")


def _keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for kind, name in enumerate(KINDS):
            own, chunk = f[f[name].notna()], CHUNK[name]
            for at in range(0, len(own), 4096):
                part = own.iloc[at : at + 4096]
                sig = _symbols(part[name]).reshape(-1, SYMBOLS // chunk, chunk).astype(np.int64)
                out = []
                for wrong in range(chunk):
                    key = np.full(sig.shape[:2], 0, dtype=np.int64)
                    for k in range(chunk):
                        if k != wrong:
                            key = (key << BITS) | sig[:, :, k]
                    out.append((key << 7) | (np.arange(SYMBOLS // chunk) * chunk + wrong) | (kind << _KIND))
                keys = np.concatenate(out, axis=1)
                yield pd.DataFrame({"key": keys.ravel(), "who": np.repeat(part["who"].to_numpy(), keys.shape[1])})


#: ``who`` is a class number and, in the lowest two bits, whether the class is on the left and on the right side of the join.
_LEFT, _RIGHT = 1, 2


def _sided(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs with one class of the left and one of the right, left first; where both are on both sides the smaller number first."""
    both = (x & 3 == 3) & (y & 3 == 3)
    there = ~both & ((x & _LEFT) > 0) & ((y & _RIGHT) > 0)
    back = ~both & ((y & _LEFT) > 0) & ((x & _RIGHT) > 0)
    a = np.concatenate([np.minimum(x, y)[both], x[there], y[back]])
    b = np.concatenate([np.maximum(x, y)[both], y[there], x[back]])
    return a, b


def _neighbours(frames: Iterator[pd.DataFrame], hot: int) -> Iterator[pd.DataFrame]:
    """a, b and 1 (2 where one key is enough) for each pair that shares a key; key, who, 0 for the rows of a key with more than ``hot`` of them.

    The rows come sorted by key.
    """
    key, who, left = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), None
    for f in frames:
        key, who = np.concatenate([key, f["key"].to_numpy()]), np.concatenate([who, f["who"].to_numpy()])
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, dtype=np.int64)
        size = np.diff(np.append(start, len(key)))
        many = np.repeat((size > hot) | (key[start] == left if left is not None else False), size)
        # The last key may go on in the next rows; if it is hot, they needn't be kept for that.
        open_ = 0 if not len(size) or many[-1] else int(size[-1])
        left = key[-1] if len(size) and many[-1] else None
        keep = ~many
        keep[len(key) - open_ :] = False
        hot_rows = (key[many], who[many], np.zeros(many.sum(), dtype=np.int32))
        yield _table([hot_rows, *_paired(key[keep], who[keep])])
        key, who = (x[len(x) - open_ :] for x in (key, who))
    yield _table(list(_paired(key, who)))


def _table(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    columns = zip(*parts) if parts else ((np.empty(0, dtype=np.int64),),) * 3
    return pd.DataFrame(dict(zip("abn", map(np.concatenate, columns))))


def _paired(key: np.ndarray, who: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    at, d = np.arange(len(key)), 1
    while len(at):
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        for kind in range(len(KINDS)) if len(at) else ():
            own = at[key[at] >> _KIND == kind]
            a, b = _sided(who[own], who[own + d])
            yield a >> 2, b >> 2, np.full(len(a), 1 + kind, dtype=np.int32)
        d += 1


def _shared_keys(sigs: np.ndarray, one: np.ndarray) -> np.ndarray:
    """How many keys of kind sig each signature shares with one."""
    equal = (sigs == one).reshape(len(sigs), SYMBOLS // CHUNK["sig"], CHUNK["sig"]).sum(axis=2)
    return np.where(equal == 3, 3, equal == 2).sum(axis=1)


def _blocks_met(f: pd.DataFrame, least: float) -> pd.DataFrame:
    """The close pairs of two blocks of a hot key, or of one block with itself.

    Of kind sig those are the pairs that share two keys, of kind flat those that agree in as many symbols as a pair of the similarity does, but for four deviations.
    """
    name = KINDS[int(f["key"].iloc[0]) >> _KIND]
    bound = SYMBOLS * least - 4 * math.sqrt(SYMBOLS * least * (1 - least))
    sig, who, mine = _symbols(f[name]), f["who"].to_numpy(), f["block"].to_numpy()
    one, other = (np.flatnonzero(mine == f[c].iloc[0]) for c in ("lo", "hi"))
    found = [(np.empty(0, dtype=np.int64),) * 2]
    for i in one:
        others = other[other > i] if f["lo"].iloc[0] == f["hi"].iloc[0] else other
        near = others[_shared_keys(sig[others], sig[i]) >= 2 if name == "sig" else (sig[others] == sig[i]).sum(axis=1) >= bound]
        found.append(_sided(np.full(len(near), who[i]), who[near]))
    a, b = (np.concatenate(x) >> 2 for x in zip(*found))
    return pd.DataFrame({"a": a, "b": b, "n": np.full(len(a), 2, dtype=np.int32)})


def _hot_pairs(rows: DataFrame, sided: DataFrame, least: float) -> DataFrame:
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / HOT).cast("int").alias("blocks"))
    spread = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("who"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = spread.select("key", "who", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).join(sided.select("who", *KINDS), "who")
    return met.groupBy("key", "lo", "hi").applyInPandas(lambda f: _blocks_met(f, least), "a long, b long, n int")


def candidate_pairs(classes: DataFrame, least: float, side: Column | None = None) -> DataFrame:
    """a, b: the pairs of classes that share enough keys. side: 1 for a class of the left, 2 of the right, 3 of both; a is of the left then."""
    sided = classes.withColumn("who", F.col("cid") * 4 + (F.lit(3) if side is None else side))
    keys, hot = sided.select(*KINDS, "who").mapInPandas(_keys, "key long, who long"), HOT
    found = keys.repartition("key").sortWithinPartitions("key").mapInPandas(lambda fs: _neighbours(fs, hot), "a long, b long, n int")
    found = written(found, "neighbours")
    met = _hot_pairs(found.where("n = 0").select(F.col("a").alias("key"), F.col("b").alias("who")), sided, least)
    return found.where("n > 0").union(met).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1").select("a", "b")


def _alike(frames: Iterator[pd.DataFrame], run: int, least: float) -> Iterator[pd.DataFrame]:
    cache = WordHashes()
    for f in frames:
        known: dict[int, np.ndarray] = {}

        def runs(cid: int, text: str) -> np.ndarray:
            if cid not in known:
                known[cid] = np.unique(run_hashes([words(text)], run, cache)[0])
            return known[cid]

        found = []
        for a, b, text_a, text_b in zip(f["a"], f["b"], f["text_a"], f["text_b"]):
            x, y = runs(a, text_a), runs(b, text_b)
            both = len(np.intersect1d(x, y, assume_unique=True))
            either = len(x) + len(y) - both
            if both and both >= least * either:
                found.append((a, b, both / either))
        yield pd.DataFrame(found, columns=["a", "b", "similarity"])


def verified_pairs(pairs: DataFrame, texts: DataFrame, run: int, least: float) -> DataFrame:
    """a, b, similarity of the pairs whose whole sets of runs have at least that similarity; texts: cid, text."""
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInPandas(lambda fs: _alike(fs, run, least), "a long, b long, similarity double")


def article_records(articles: DataFrame) -> DataFrame:
    """id, text: title, line break, body, of articles with an id and a body that isn't blank."""
    return articles.where(F.col("article_id").isNotNull() & F.col("_article").rlike(r"(?U)\S")).select(
        F.col("article_id").alias("id"), F.concat(F.coalesce("_title", F.lit("")), F.lit("\n"), F.col("_article")).alias("text")
    )


def content_classes(records: DataFrame, run: int = 3) -> tuple[DataFrame, DataFrame]:
    """members (id, cid, rep, runs) and classes (cid, rep, sig, flat): records of the same words share a class; rep is its smallest id.

    runs: whether the class has any run of words.
    """
    kept = records.where("id is not null and text is not null")
    found = written(canonical_signatures(kept, run), "signatures")
    grouped = found.groupBy("content").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in KINDS])
    classes = written(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    known = classes.select("content", "cid", "rep", F.col("sig").isNotNull().alias("runs"))
    members = found.select("id", "content").distinct().join(known, "content").select("id", "cid", "rep", "runs")
    return members, classes.drop("content")


def class_pairs(records: DataFrame, classes: DataFrame, candidates: DataFrame, run: int = 3, least: float = 0.5) -> DataFrame:
    """a, b, rep_a, rep_b, similarity: the candidates whose representatives' sets of runs are alike enough."""
    close = written(candidates, "candidates")
    needed = close.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes.select("cid", "rep"), "cid")

    texts = written(records.join(needed.withColumnRenamed("rep", "id"), "id").groupBy("cid").agg(F.first("text").alias("text")), "texts")
    alike = verified_pairs(close, texts, run, least)
    reps = needed.select("cid", "rep")
    return alike.join(reps.toDF("a", "rep_a"), "a").join(reps.toDF("b", "rep_b"), "b")


def near_pairs(records: DataFrame, run: int = 3, least: float = 0.5) -> DataFrame:
    """id_a, id_b (the smaller first), similarity: alike classes by their representatives, and each copy with its representative.

    Copies of the same words aren't expanded into all pairs of the group. ``least`` may be any similarity above 0.
    """
    members, classes = content_classes(records, run)
    pairs = class_pairs(records, classes, candidate_pairs(classes, least), run, least)
    copies = members.where("runs and id <> rep").select("rep", "id", F.lit(1.0))
    return pairs.select(F.least("rep_a", "rep_b").alias("id_a"), F.greatest("rep_a", "rep_b").alias("id_b"), "similarity").union(copies)


def near_duplicate_classes(records: DataFrame, run: int = 5, least: float = 0.8) -> DataFrame:
    """One row per record: id, class_id (smallest id of the records of the same words), links (number of other classes that are alike)."""
    members, classes = content_classes(records, run)
    pairs = class_pairs(records, classes, candidate_pairs(classes, least), run, least)
    links = pairs.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("links"))
    return members.join(links, "cid", "left").select("id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicate_groups(records: DataFrame, run: int = 3, least: float = 0.5) -> DataFrame:
    """id, group_id (smallest id of the group) of each record that is alike another one, directly or through others."""
    return connected_components(near_pairs(records, run, least).select("id_a", "id_b")).toDF("id", "group_id")
