import pytest
from pyspark.sql import functions as F

from loomline.functions.options import override
from loomline.streaming.metrics import windowed_means


def test_round_trip(spark, sf):
    pytest.importorskip("tiktoken")
    from loomline.plans.tokens import bpe_encode, bpe_round_trip

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.md5(F.col("text").cast("binary")).alias("m"))
    assert bpe_round_trip(spark, sf).join(docs, "doc_id").where("text_md5 <> m").count() == 0
    assert bpe_encode(spark, sf).where("last_id <> 50256").count() == 0


def test_options():
    base = {"batch": 4, "rate": 0.1, "name": "x", "on": True}
    assert override(base, {"batch": 8}, ["--rate=1", "--name=y", "--on=False"]) == {"batch": 8, "rate": 1.0, "name": "y", "on": False}
    for bad, kind in (({"other": 1}, KeyError), ({"batch": "8"}, TypeError)):
        with pytest.raises(kind):
            override(base, bad)
    with pytest.raises(ValueError):
        override(base, {}, ["batch=3"])


def test_windowed_means(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "a", 1.0), ("2024-01-01 00:00:05", "a", 3.0), ("2024-01-01 00:01:05", "b", 5.0), ("2024-01-01 01:00:00", "b", 7.0)]
    spark.createDataFrame(rows, "ts string, k string, v double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(str(tmp_path / "in"))
    query = windowed_means(stream, "ts", "k", "v", "1 minute", "10 minutes").writeStream.format("memory").queryName("means").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r["k"], r["n"], r["mean"]) for r in spark.table("means").collect()) == [("a", 2, 2.0), ("b", 1, 5.0), ("b", 1, 7.0)]
