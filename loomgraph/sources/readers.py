"""Readers of flat files: news archives, record lines, price files, result logs, arrays and metric files.

Missing columns and unreadable values become null; files that aren't there raise Spark's own error.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.dedup import keep_last


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with quoted multi-line fields, every column as text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def news(spark: SparkSession, path: str, symbols: list[str], first: str, last: str) -> DataFrame:
    """Rows of the symbols whose date text lies in the range and whose body isn't blank; dates are compared as text."""
    day = F.substring("Date", 1, 10)
    return csv_text(spark, path).where(F.col("Stock_symbol").isin(symbols) & day.between(first, last) & (F.trim("Article") != ""))


def prices(spark: SparkSession, path: str) -> DataFrame:
    """ticker (from the file's name), date, open, high, low, close, adj_close, volume; an empty adj_close is the close, rows with garbage are dropped."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])
    num = lambda c: F.col(c).try_cast("double").alias(c)
    adj = F.coalesce(F.nullif(F.trim("adj_close"), F.lit("")), "close") if "adj_close" in raw.columns else F.col("close")
    ticker = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    return raw.select(ticker.alias("ticker"), F.col("date").try_cast("date").alias("date"), *map(num, ("open", "high", "low", "close")), adj.try_cast("double").alias("adj_close"), num("volume")).dropna("any")


def record_lines(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """JSON lines with blank and broken ones skipped; of several with one key the last counts."""
    lines = spark.read.text(path).select(F.from_json("value", schema).alias("r"), F.monotonically_increasing_id().alias("_line"))
    return keep_last(lines.where(f"r.{key} is not null").select("r.*", "_line"), [key], "_line").drop("_line")


def partitions(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """The table of every partition folder below the path, tagged by the folder and its number."""
    folder = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(f"{path}/*/{table}").withColumns({"folder": folder, "number": F.regexp_extract(folder, r"(\d+)$", 1).try_cast("int")})


def result_log(spark: SparkSession, path: str) -> DataFrame:
    """file, setting, seed, mse, mae, gates: pairs of a setting line and a metric line; of one setting the last pair counts."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    pair = F.regexp_extract_all("value", F.lit(r"(?m)^(\S[^\n]*)\n\s*mse:[^\n]*"), F.lit(0))
    rows = text.select("file", F.posexplode(pair).alias("pos", "x"))
    num = lambda name: F.regexp_extract("x", rf"{name}:\s*([-+0-9.eE]+)", 1).try_cast("double").alias(name)
    gates = F.transform(F.split(F.regexp_extract("x", r"graph_gates:\[([^\]]*)\]", 1), r"[,\s]+"), lambda g: g.try_cast("double"))
    out = rows.select("file", "pos", F.trim(F.regexp_extract("x", r"^([^\n]*)", 1)).alias("setting"), num("mse"), num("mae"), F.filter(gates, lambda g: g.isNotNull()).alias("gates"))
    return keep_last(out, ["file", "setting"], "pos").withColumn("seed", F.regexp_extract("setting", r"seed_?(\d+)", 1).try_cast("int")).drop("pos")


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """file, shape, vals of float .npy files; other files come out without values."""
    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out = []
            for p, c in zip(x["path"], x["content"]):
                try:
                    a = np.load(io.BytesIO(c), allow_pickle=False)
                    out.append((p, list(a.shape), a.astype(float).ravel().tolist()))
                except ValueError:
                    out.append((p, None, None))
            yield pd.DataFrame(out, columns=["file", "shape", "vals"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(f, "file string, shape array<long>, vals array<double>")


def metric_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metric records, one JSON object a file, with the run from the file's folder."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def checksums(spark: SparkSession, *globs: str) -> DataFrame:
    """file, sha256, bytes of all files of the globs."""
    return spark.read.format("binaryFile").load([*globs]).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
