"""Sinks: partitioned tables, typed tensors, and the one-row description beside a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.functions.vectors import wide


def described(df: DataFrame, path: str, **parameters) -> dict:
    """Writes the table and a description with its row count and the parameters; rows are counted while they are written."""
    seen = Observation("rows")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    about = {"rows": seen.get["rows"], "columns": df.columns, "parameters": parameters}
    df.sparkSession.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.about")
    return about


def by_ticker(df: DataFrame, path: str) -> None:
    """CSV files partitioned by ticker; rows of one ticker meet in one task a file, spread over the day when it is hot."""
    df.repartition("ticker", F.month("date")).write.mode("overwrite").partitionBy("ticker").option("header", True).csv(path)


def wide_vectors(df: DataFrame, path: str, vector: str, prefix: str, n: int) -> None:
    wide(df, vector, prefix, n).write.mode("overwrite").option("header", True).csv(path)


def typed_tensors(edges: DataFrame, path: str) -> None:
    """source, target indices partitioned by source type, edge type and target type."""
    edges.write.mode("overwrite").partitionBy("source_type", "edge_type", "target_type").parquet(path)
