"""Evaluation texts leaking into training text, by the q-gram lemma.

Texts are brought to words parted by single blanks. A passage of ``window`` characters that
stands in a document with at most ``edits`` edits shares at least
``window + 1 - q * (edits + 1)`` character q-grams with it, all of them on
``edits + 1`` neighbouring diagonals. The q-grams of a document are looked up among those
of the items, hits are counted in overlapping bands of diagonals, and only regions that reach
the bound within a window are kept and verified by an alignment within the band. ``shared_runs`` is the case of no edits: one
diagonal, an alignment in a band of width 0, and then a count of the whole words that are aligned.

The items are a stated query set: they are held by every task, in blocks of at most
``BLOCK_CHARS`` characters, one pass over the documents for each block, so a set of any size
works. Documents are read once a block, in whole, and nothing of them is shuffled but the matches.

Null and empty texts match nothing. Repeated rows count once. An item shorter than the window
can't be found; neither can one be found in its own absence of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.words import bare, words

Q = 12
BLOCK_CHARS = 4_000_000
_BATCH = 256
_SLOTS = 22
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _grams(buffer: np.ndarray) -> np.ndarray:
    """A hash of the Q bytes from each position on."""
    n = len(buffer) - Q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    wide = buffer.astype(np.uint64)
    two = wide[:-1] | (wide[1:] << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    eight = four[:-4] | (four[4:] << np.uint64(32))
    h = eight[:n] * _M1 + four[8 : 8 + n] * _M2
    return h ^ (h >> np.uint64(31))


class Index:
    """Q-grams of a block of items: sorted, with the places (item, offset) they stand at."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        self.ids = ids
        self.bytes = [b" ".join(words(t)) for t in texts]
        grams = [_grams(np.frombuffer(x, dtype=np.uint8)) for x in self.bytes]
        flat = np.concatenate([*grams, np.empty(0, dtype=np.uint64)])
        item = np.repeat(np.arange(len(grams)), np.array([len(g) for g in grams], dtype=np.int64))
        offset = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, dtype=np.int64)]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        self.item, self.offset = item[order], offset[order]
        self.gram, self.start, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.slot = np.zeros(1 << _SLOTS, dtype=bool)
        self.slot[self.gram >> np.uint64(64 - _SLOTS)] = True

    def hits(self, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position in the buffer, item and offset in it of each shared q-gram."""
        g = _grams(buffer)
        at = np.flatnonzero(self.slot[g >> np.uint64(64 - _SLOTS)])
        where = np.minimum(np.searchsorted(self.gram, g[at]), max(len(self.gram) - 1, 0))
        same = self.gram[where] == g[at] if len(self.gram) else np.zeros(len(at), dtype=bool)
        at, where = at[same], where[same]
        n = self.count[where]
        place = np.repeat(self.start[where] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(at, n), self.item[place], self.offset[place]


def _regions(doc: np.ndarray, position: np.ndarray, item: np.ndarray, offset: np.ndarray, window: int, edits: int) -> tuple[np.ndarray, ...]:
    """Document, first and last position, item and diagonal of each region of hits that reaches the bound within a window.

    A passage of ``window`` characters of the item is one of up to ``window + edits`` in the document. Windows that don't touch are
    regions of their own, however they follow each other on a band.
    """
    least = max(1, window + 1 - Q * (edits + 1))
    diagonal = position - offset
    width = 2 * (edits + 1) if edits else 1
    found = []
    for shift in (0, edits + 1) if edits else (0,):
        band = (diagonal + shift) // width
        order = np.lexsort((position, band, item, doc))
        d, i, b, p = doc[order], item[order], band[order], position[order]
        n = len(p) - least + 1
        if n <= 0:
            continue
        end = p[least - 1 :] + Q
        head = np.flatnonzero((d[least - 1 :] == d[:n]) & (i[least - 1 :] == i[:n]) & (b[least - 1 :] == b[:n]) & (end - p[:n] <= window + edits))
        if not len(head):
            continue
        new = np.ones(len(head), dtype=bool)
        x, y = head[:-1], head[1:]
        new[1:] = (d[y] != d[x]) | (i[y] != i[x]) | (b[y] != b[x]) | (p[y] > end[x])
        first = head[new]
        last = np.append(head[np.flatnonzero(new)[1:] - 1], head[-1])
        found.append((d[first], p[first], end[last], i[first], diagonal[order][first]))
    if not found:
        return (np.empty(0, dtype=np.int64),) * 5
    return tuple(np.concatenate(x) for x in zip(*found))


def banded_edits(pairs: list[tuple[bytes, bytes]], band: int) -> np.ndarray:
    """Edits between the two byte strings of each pair, along paths at most ``band`` beside the diagonal; more than ``band`` count as ``band + 1``.

    All pairs are aligned side by side, a row of the band for each at a time.
    """
    far = band + 1
    out = np.full(len(pairs), far)
    if not pairs:
        return out
    la, lb = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    most = int(max(la.max(), lb.max()))
    a = np.zeros((len(pairs), most + 1), dtype=np.uint8)
    b = np.zeros((len(pairs), most + 2 * band + 2), dtype=np.uint8)
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)] = np.frombuffer(x, dtype=np.uint8)
        b[i, band : band + len(y)] = np.frombuffer(y, dtype=np.uint8)
    shift = np.arange(2 * band + 1, dtype=np.int16)
    row = np.where(shift >= band, np.minimum(shift - band, far), far).astype(np.int16)[None, :].repeat(len(pairs), axis=0)
    row = np.where(shift - band > lb[:, None], np.int16(far), row)
    ended = (la == 0) & (lb <= band)
    out[ended] = np.minimum(lb[ended], far)
    for i in range(1, most + 1):
        j = i + shift - band
        best = row + (b[:, i - 1 : i + 2 * band] != a[:, i - 1 : i])
        best[:, :-1] = np.minimum(best[:, :-1], row[:, 1:] + 1)
        best[(j < 0)[None, :] | (j[None, :] > lb[:, None])] = far
        if i <= band:
            best[:, band - i] = i
        # Insertions run along the band.
        row = np.minimum(np.minimum.accumulate(best - shift, axis=1) + shift, far)
        done = np.flatnonzero((la == i) & (np.abs(lb - la) <= band))
        if len(done):
            out[done] = row[done, lb[done] - i + band]
        if (row > band).all():
            break
    return np.minimum(out, far)


def _buffers(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """ids, bare texts, buffer and starts for some documents at a time; a line break parts two documents, as no item has one."""
    ids, texts = frame["doc_id"].to_numpy(), frame["text"].to_numpy()
    at = 0
    while at < len(ids):
        parts, size, to = [], 0, at
        while to < len(ids) and to - at < _BATCH and size < 400_000:
            parts.append(bare(texts[to]))
            size += len(parts[-1])
            to += 1
        starts = np.cumsum([0, *(len(x) + 1 for x in parts[:-1])])
        yield ids[at:to], parts, np.frombuffer(b"\n".join(parts), dtype=np.uint8), starts
        at = to


def _whole_words(text: bytes, start: int, end: int) -> tuple[int, int]:
    """The stretch of the text without words that it has only a part of."""
    while start < end and start and text[start - 1 : start] not in (b" ", b"\n"):
        start += 1
    while end > start and end < len(text) and text[end : end + 1] not in (b" ", b"\n"):
        end -= 1
    return start, end


def _runs(frames: Iterator[pd.DataFrame], index: Index, run: int) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for ids, _, buffer, starts in _buffers(f):
            position, item, offset = index.hits(buffer)
            doc, first, last, item, diagonal = _regions(np.searchsorted(starts, position, side="right") - 1, position, item, offset, max(2 * run - 1, Q), 0)
            # A run of n words has n - 1 blanks, all of them in one region.
            blanks = np.append(0, np.cumsum(buffer == 32))
            wide = blanks[last] - blanks[first] >= run - 1
            regions = list(zip(*(x[wide].tolist() for x in (doc, first, last, item, diagonal))))
            text = buffer.tobytes() if regions else b""
            equal = banded_edits([(index.bytes[i][p - g : e - g], text[p:e]) for _, p, e, i, g in regions], 0) == 0
            for (d, p, e, i, g), same in zip(regions, equal):
                if same:
                    # Whole in the document and in the item.
                    a, z = _whole_words(text, p, e)
                    a, z = _whole_words(index.bytes[i], a - g, z - g)
                    if len(index.bytes[i][a:z].split()) >= run:
                        out.append((ids[d], index.ids[i]))
        yield pd.DataFrame(sorted({*out}), columns=["doc_id", "item_id"])


def _passages(frames: Iterator[pd.DataFrame], index: Index, window: int, edits: int) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for ids, _, buffer, starts in _buffers(f):
            ends = np.append(starts[1:] - 1, len(buffer))
            position, item, offset = index.hits(buffer)
            regions = _regions(np.searchsorted(starts, position, side="right") - 1, position, item, offset, window, edits)
            spans, pairs, budgets = [], [], []
            for d, p, e, i, g in zip(*(x.tolist() for x in regions)):
                # A region starts and ends with a hit; what an edit near the passage's end cut off is put back, after it or before it.
                ahead = min(int(ends[d]) - e, len(index.bytes[i]) - (e - g))
                behind = min(p - int(starts[d]), p - g)
                lack = max(0, window - (e - p))
                for z in {max(0, min(lack, ahead)), max(0, lack - max(0, min(lack, behind)))}:
                    a = lack - z
                    own = index.bytes[i][max(p - a - g, 0) : max(e + z - g, 0)]
                    if a <= behind and z <= max(0, ahead) and len(own) >= window:
                        spans.append((d, i, p - a - int(starts[d]), e + z - int(starts[d])))
                        pairs.append((own, buffer[p - a : e + z].tobytes()))
                        budgets.append(2 * max(edits, edits * len(own) // window))
            best: dict[tuple[int, int], tuple] = {}
            order = sorted(range(len(pairs)), key=lambda k: len(pairs[k][0]))
            for at in range(0, len(pairs), 256):
                part = order[at : at + 256]
                counts = banded_edits([pairs[k] for k in part], max(budgets[k] for k in part) + 1)
                for (d, i, p, e), n, most in zip((spans[k] for k in part), counts, (budgets[k] for k in part)):
                    if n <= most and ((d, i) not in best or (best[d, i][1] - best[d, i][0], -best[d, i][2]) < (e - p, -n)):
                        best[d, i] = (p, e, int(n))
            out += [(ids[d], index.ids[i], *x) for (d, i), x in best.items()]
        yield pd.DataFrame(out, columns=["doc_id", "item_id", "start", "end", "edits"])


def _blocks(items: DataFrame) -> Iterator[Index]:
    ids, texts, size = [], [], 0
    for row in items.select("item_id", "text").where("item_id is not null and text is not null").distinct().toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"])
        if size > BLOCK_CHARS:
            yield Index(ids, texts)
            ids, texts, size = [], [], 0
    yield Index(ids, texts)


def _over_blocks(documents: DataFrame, items: DataFrame, f, schema: str) -> DataFrame:
    docs = documents.select("doc_id", "text").where("text <> '' and doc_id is not null")

    def one(index: Index) -> DataFrame:
        held = documents.sparkSession.sparkContext.broadcast(index)
        return docs.mapInPandas(lambda fs: f(fs, held.value), schema)

    return reduce(DataFrame.union, [one(x) for x in _blocks(items)])


def shared_runs(documents: DataFrame, items: DataFrame, run: int = 12) -> DataFrame:
    """doc_id, item_id of each document and item that share ``run`` consecutive words, at least 7.

    Such a run is a passage without edits of at least 2 * run - 1 characters, so none is lost by the filter.
    """
    return _over_blocks(documents, items, lambda fs, index: _runs(fs, index, run), "doc_id long, item_id long").distinct()


def leaked_passages(documents: DataFrame, items: DataFrame, window: int = 80, edits: int = 4) -> DataFrame:
    """doc_id, item_id, start, end, edits: the longest passage of each item in each document, in characters of its words.

    A passage has at least ``window`` characters, of which any window with at most ``edits`` edits is found; it may have up to twice
    ``edits`` for each window, as it is cut at positions rather than at edits.
    """
    schema = "doc_id long, item_id long, start long, end long, edits long"
    found = _over_blocks(documents, items, lambda fs, index: _passages(fs, index, window, edits), schema)
    longest = F.max_by(F.struct("start", "end", "edits"), F.struct(F.col("end") - F.col("start"), -F.col("edits"), -F.col("start")))
    return found.groupBy("doc_id", "item_id").agg(longest.alias("p")).select("doc_id", "item_id", "p.start", "p.end", "p.edits")


def leaked_items(documents: DataFrame, items: DataFrame, run: int = 12) -> DataFrame:
    """item_id, category, documents: every item with the number of documents it leaked into, 0 included."""
    n = shared_runs(documents, items, run).groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select("item_id", "category").distinct().join(n, "item_id", "left").select("item_id", "category", F.coalesce("documents", F.lit(0)).alias("documents"))
