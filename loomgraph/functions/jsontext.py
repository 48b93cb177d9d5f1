"""JSON as models write it: read tolerantly, recovered where it breaks off, written in one stable way.

The reader is one pass over the text. It takes what stands between commas that are missing or too many, quotes within strings that aren't
escaped, line breaks in strings, and an end that comes too early: what is open there is closed, a key without a value is dropped.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Marks that decoders leave in a reply, and the fields that name an item best, in order.
ARTEFACTS = {"Ċ": "\n", "Ġ": " ", "ĉ": "\t", " ": " "}
_ENDS = re.compile(r"<\|endoftext\|>|<｜end of sentence｜>|<｜end▁of▁sentence｜>")
NAME_FIELDS = ["name", "entity", "company", "person", "organization", "text", "statement", "value"]
FIGURE_FIELDS = [("metric",), ("value",), ("time_period",), ("context", "evidence", "text")]
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?")
_WORDS = {"true": True, "false": False, "null": None, "NaN": None, "None": None, "True": True, "False": False}
_KEY = re.compile(r'\s*"[^"\n]{0,80}"\s*:')
_VALUE = re.compile(r'\s*(?:["{\[\]}]|-?\d|true\b|false\b|null\b|$)')
_GAP = re.compile(r"[\s,]*")


def answer(text: str | None) -> str:
    """A reply without decoding marks and whatever comes before the end of its reasoning."""
    text = text or ""
    for mark, plain in ARTEFACTS.items():
        text = text.replace(mark, plain)
    return _ENDS.sub("", text).rsplit("</think>", 1)[-1].strip()


class _Reader:
    def __init__(self, text: str, at: int):
        self.text, self.at, self.whole = text, at, True

    def skip(self) -> str:
        self.at = _GAP.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def value(self):
        c = self.skip()
        if c == "{":
            return self.object()
        if c == "[":
            return self.array()
        if c == '"':
            return self.string(False)
        m = _NUMBER.match(self.text, self.at)
        if m:
            self.at = m.end()
            return float(m[0]) if re.search("[.eE]", m[0]) else int(m[0])
        for word, what in _WORDS.items():
            if self.text.startswith(word, self.at):
                self.at += len(word)
                return what
        raise ValueError("no value")

    def closes(self, at: int, key: bool) -> bool:
        """Whether the quote before this place ends its string."""
        m = re.compile(r"\s*").match(self.text, at).end()
        c = self.text[m : m + 1]
        if key:
            return c == ":"
        if c == ",":
            return bool(_VALUE.match(self.text, m + 1))
        return c in ("", "}", "]") or bool(_KEY.match(self.text, at))

    def string(self, key: bool) -> str:
        self.at += 1
        out = []
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "\\" and self.at + 1 < len(self.text):
                try:
                    size = 6 if self.text[self.at + 1] == "u" else 2
                    out.append(json.loads(f'"{self.text[self.at : self.at + size]}"'))
                    self.at += size
                except ValueError:
                    out.append(self.text[self.at + 1])
                    self.at += 2
                continue
            self.at += 1
            if c == '"' and self.closes(self.at, key):
                return "".join(out)
            out.append(c)
        self.whole = False
        return "".join(out)

    def object(self) -> dict:
        self.at += 1
        out = {}
        while True:
            c = self.skip()
            if c == "}":
                self.at += 1
                return out
            if c != '"':
                self.whole = False
                return out
            key = self.string(True)
            if self.skip() != ":" or not self.text[self.at + 1 :].strip():
                self.whole = False
                return out
            self.at += 1
            try:
                out[key] = self.value()
            except ValueError:
                self.whole = False
                return out

    def array(self) -> list:
        self.at += 1
        out = []
        while True:
            c = self.skip()
            if c == "]":
                self.at += 1
                return out
            try:
                out.append(self.value())
            except ValueError:
                self.whole = False
                return out


def first_object(text: str | None) -> dict | None:
    """The first object of a reply that is whole, in a fence if there is one, else the first as far as it goes; None without any field."""
    said = answer(text)
    fenced = re.findall(r"```(?:json)?\s*(.*?)```", said, flags=re.S | re.I)
    partial = None
    for part in [*fenced, said]:
        at = part.find("{")
        while at >= 0:
            reader = _Reader(part, at)
            found = reader.object()
            if reader.whole and found:
                return found
            partial = partial or found or None
            at = part.find("{", max(reader.at, at + 1))
    return partial


def array_objects(text: str | None, key: str) -> list[dict]:
    """The whole objects of the array of that name, also of one that breaks off."""
    said = answer(text)
    m = re.search(rf'"{re.escape(key)}"\s*:\s*\[', said)
    out = []
    at = m.end() if m else len(said)
    while at < len(said):
        reader = _Reader(said, at)
        if reader.skip() != "{":
            break
        found = reader.object()
        if not reader.whole:
            break
        out.append(found)
        at = reader.at
    return out


def plain(x):
    """A value with nulls and NaN as empty text, and keys as text."""
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    return [plain(v) for v in x] if isinstance(x, (list, tuple, set)) else x


def dumped(x) -> str:
    """JSON with sorted keys and characters as they are."""
    return json.dumps(plain(x), ensure_ascii=False, sort_keys=True)


def _tidy(x) -> str:
    return " ".join(str(plain(x)).split())


def item_text(item, field: str) -> str:
    """A readable text of an extracted item: a figure by its parts, another by the field that names it best, else its JSON."""
    if not isinstance(item, dict):
        return _tidy(item) if isinstance(item, (str, int, float)) else _tidy(dumped(item))
    if field == "financial_metric_mentions":
        parts = [next((t for name in names if (t := _tidy(item.get(name)))), "") for names in FIGURE_FIELDS]
        if any(parts):
            return " | ".join(p for p in parts if p)
    return next((t for name in NAME_FIELDS if (t := _tidy(item.get(name)))), _tidy(dumped(item)))


def list_texts(value, field: str) -> list[str]:
    """The readable texts of an extracted list, or of a single text; nothing of other values."""
    items = [value] if isinstance(value, str) else value if isinstance(value, list) else []
    return [t for x in items if (t := item_text(x, field))]


def _loaded(text: str | None):
    try:
        return json.loads(text or "")
    except ValueError:
        return None


def stable_json(df: DataFrame, column: str) -> DataFrame:
    """df with the column's JSON written in one stable way; broken or null JSON becomes null."""
    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            x[column] = [None if (v := _loaded(t)) is None else dumped(v) for t in x[column]]
            yield x

    return df.mapInPandas(f, df.schema)


def extracted_lists(df: DataFrame, column: str, field: str) -> DataFrame:
    """df with the column's JSON list as an array of readable texts, empty where there is none."""
    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            x[column] = [list_texts(_loaded(t), field) for t in x[column]]
            yield x

    return df.mapInPandas(f, ", ".join(f"`{c}` {'array<string>' if c == column else t}" for c, t in df.dtypes))


def recovered_objects(df: DataFrame, column: str, key: str, id_column: str) -> DataFrame:
    """id_column, pos, object: the whole objects of the named array in each reply, also of one that breaks off."""
    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = [(i, n, dumped(o)) for i, t in zip(x[id_column], x[column]) for n, o in enumerate(array_objects(t, key))]
            yield pd.DataFrame(rows, columns=[id_column, "pos", "object"])

    return df.select(id_column, column).mapInPandas(f, f"{id_column} {dict(df.dtypes)[id_column]}, pos int, object string")
