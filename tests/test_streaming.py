import random
import time

from pyspark.sql import functions as F

from palisade.config import Config
from palisade.operators.limiter import rate_limit
from palisade.streaming import moderation


def test_decisions_over_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "idiot"), (2, "fine words")], "id int, prompt string").write.parquet(str(source))
    stream = spark.readStream.schema("id int, prompt string").parquet(str(source))
    seen = []
    query = moderation.each_batch(moderation.decisions(stream).select("id", "action"), lambda df, n: seen.extend(df.collect()), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert {(r.id, r.action) for r in seen} == {(1, "BLOCK"), (2, "ALLOW")}


def test_block_rates_over_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS ts, true AS allow UNION ALL SELECT timestamp'2024-01-01 00:02:00', false").write.parquet(str(source))
    stream = spark.readStream.schema("ts timestamp, allow boolean").parquet(str(source))
    query = moderation.block_rates(stream, "ts").writeStream.format("memory").queryName("rates").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.blocks, r.n) for r in spark.table("rates").collect()] == [(1, 2)]


def test_limiter_state_equals_the_batch_fold(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "client string, n long, t double").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        limited = moderation.rate_limited(stream, client="client", event_id="n", time="ts", config=Config(rate_limit_max=3, rate_limit_window_s=10))
        query = limited.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "state")).start()
        for _ in range(240):  # state with a time to live keeps the query busy: it is stopped once all rows are out
            if spark.table("limited").count() == len(rows) or query.exception():
                break
            time.sleep(0.5)
        query.stop()
    finally:
        spark.conf.unset(key)
    batch = rate_limit(df, client="client", time="ts", most=3, window_s=10, tie="n")
    assert {(r.event_id, r.allowed) for r in spark.table("limited").collect()} == {(r.n, r.allowed) for r in batch.collect()}
