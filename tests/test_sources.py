import json

import numpy as np
from pyspark.sql import functions as F

from loomgraph.sources import readers, writers
from loomgraph.streaming import news


def test_news_and_prices(spark, tmp_path):
    (tmp_path / "n.csv").write_text('Date,Article_title,Stock_symbol,Url,Article\n2019-01-02 10:00,t,A,u,"two\nlines ""quoted"""\n2017-01-01,t,A,u,old\n2019-05-05,t,B,u,x\n2019-05-06,t,A,u," "\n')
    rows = readers.news(spark, str(tmp_path / "n.csv"), ["A"], "2018-01-01", "2023-12-31").collect()
    assert [r.Article for r in rows] == ['two\nlines "quoted"']
    (tmp_path / "p").mkdir()
    (tmp_path / "p/AB.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2020-01-02,1,2,1,2,,9\n2020-01-03,1,2,1,2,0,9\n2020-01-04,x,2,1,2,1,9\n")
    got = {(r.ticker, str(r.date), r.adj_close) for r in readers.prices(spark, str(tmp_path / "p")).collect()}
    assert got == {("AB", "2020-01-02", 2.0), ("AB", "2020-01-03", 0.0)}


def test_record_lines_last_wins(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "a", "v": 1}\n\nbroken{\n{"id": "a", "v": 2}\n{"id": "b", "v": 3}\n')
    got = {(r.id, r.v) for r in readers.record_lines(spark, str(tmp_path / "r.jsonl"), "id", "id string, v int").collect()}
    assert got == {("a", 2), ("b", 3)}


def test_result_log(spark, tmp_path):
    (tmp_path / "T.txt").write_text("run_seed1\nmse:0.5, mae:0.1, graph_gates:[0.0, 0.2]\n\nrun_seed2\nmse:0.7, mae:0.2\n\nrun_seed1\nmse:0.4, mae:0.1, graph_gates:[0.0]\n")
    got = {(r.setting, r.seed, r.mse, tuple(r.gates)) for r in readers.result_log(spark, str(tmp_path / "T.txt")).collect()}
    assert got == {("run_seed1", 1, 0.4, (0.0,)), ("run_seed2", 2, 0.7, ())}


def test_arrays_metrics_checksums(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
    (tmp_path / "bad.npy").write_bytes(b"no array")
    got = {r.file.rsplit("/", 1)[1]: r for r in readers.arrays(spark, str(tmp_path / "*.npy")).collect()}
    assert got["a.npy"].shape == [2, 3] and got["a.npy"].vals == [0, 1, 2, 3, 4, 5] and got["bad.npy"].vals is None
    (tmp_path / "run7").mkdir()
    (tmp_path / "run7/m.json").write_text(json.dumps({"val_auc": 0.5}))
    assert [(r.run, r.val_auc) for r in readers.metric_files(spark, str(tmp_path / "run7"), "val_auc double").collect()] == [("run7", 0.5)]
    assert {r.file: r.bytes for r in readers.checksums(spark, str(tmp_path / "bad.npy")).collect()} == {"bad.npy": 8}


def test_partitions(spark, tmp_path):
    for n in (2, 10):
        (tmp_path / f"chunk_{n}").mkdir()
        (tmp_path / f"chunk_{n}/articles.csv").write_text(f"id,x\na{n},1\n")
    got = {(r.id, r.folder, r.number) for r in readers.partitions(spark, str(tmp_path), "articles.csv", "id string, x int").collect()}
    assert got == {("a2", "chunk_2", 2), ("a10", "chunk_10", 10)}


def test_writers(spark, tmp_path):
    df = spark.range(5).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    assert writers.described(df, str(tmp_path / "t"), seed=3)["rows"] == 5
    writers.wide_vectors(df, str(tmp_path / "w"), "v", "gnn", 2)
    assert spark.read.option("header", True).csv(str(tmp_path / "w")).columns == ["id", "gnn_0", "gnn_1"]


def test_stream_equals_batch(spark, tmp_path):
    a = spark.read.parquet("/root/testdata/sf0.001/articles.parquet").withColumn("_date", F.col("_date").cast("timestamp")).where("_date is not null and article_id is not null")
    src = str(tmp_path / "src")
    a.repartition(3).write.parquet(src)
    rows = news.arrivals(spark, src, a.schema, late="4000 days")
    news.ingest(rows, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = a.distinct()
    assert got.count() == want.select("article_id").distinct().count()
    assert news.window_counts(got).exceptAll(news.window_counts(want)).count() == 0
