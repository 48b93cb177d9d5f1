"""Places for models that aren't part of the library: encoders of texts and extractors of records, run in Arrow batches.

A factory is called once a Python worker and returns the model, so weights are loaded where they are used and never shipped with a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.functions.vectors import packed, pooled, unit

Encoder = Callable[[list[str]], np.ndarray]
Extractor = Callable[[list[str]], list[dict]]


def hashing_encoder(dim: int = 64) -> Callable[[], Encoder]:
    """A factory of an encoder without a model: signed hashes of words, at length 1."""
    def make() -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    h = xxhash.xxh3_64_intdigest(w)
                    out[i, h % dim] += 1 if h >> 63 else -1
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

        return encode

    return make


def encoded(df: DataFrame, text: str, out: str, factory: Callable[[], Encoder], batch: int = 64) -> DataFrame:
    """df with the vectors of a text column; a null text has a null vector."""
    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for x in frames:
            have = x[text].notna().to_numpy()
            texts = x[text][have].tolist()
            vectors = iter([v for at in range(0, len(texts), batch) for v in np.asarray(model(texts[at : at + batch]), dtype=float).tolist()])
            yield x.assign(**{out: [next(vectors) if h else None for h in have]})

    return df.mapInPandas(f, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{out}` array<double>")


def article_vectors(articles: DataFrame, factory: Callable[[], Encoder], size: int = 1800, most: int = 12) -> DataFrame:
    """article_id, vector: texts cut into chunks, each encoded, the mean at length 1. Articles without text are left out."""
    parts = articles.select("article_id", F.explode(X.chunks("text", size, most)).alias("chunk"))
    vectors = encoded(parts, "chunk", "v", factory)
    mean = packed(pooled(vectors, "v", F.lit(1.0), "article_id"), "article_id", name="v")
    return mean.select("article_id", unit(F.col("v")).alias("vector"))


def extracted(df: DataFrame, text: str, factory: Callable[[], Extractor], schema: str, batch: int = 16) -> DataFrame:
    """df with the fields of a schema (``name type, ...``) that an extractor fills from a text column; what it leaves out is null."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for x in frames:
            texts = x[text].fillna("").tolist()
            records = [r for at in range(0, len(texts), batch) for r in model(texts[at : at + batch])]
            yield x.assign(**{n: [r.get(n) for r in records] for n in names})

    return df.mapInPandas(f, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", " + schema)
