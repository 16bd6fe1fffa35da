"""Streams give what the same functions give on batches."""

from lodestone.sources import table
from lodestone.streaming import windows as W


def test_windows_of_a_drained_stream(spark, data, tmp_path):
    events = table(spark, f"{data}/sf0.001", "events").drop("props")
    src = str(tmp_path / "src")
    events.repartition(4).write.parquet(src)
    stream = W.tumbling(W.late_tolerant(W.read_stream(spark, src, events, 2).withColumn("ts", W.F.col("ts").cast("timestamp")), "ts", "60 days"), "ts", "6 hours", "event_type", "value")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.sql("SELECT CAST(start AS timestamp_ntz) start, event_type, n, total FROM w").collect()}
    assert got == {tuple(r) for r in W.tumbling(events, "ts", "6 hours", "event_type", "value").collect()}


def test_drain_is_resumable_and_exactly_once(spark, data, tmp_path):
    events = table(spark, f"{data}/sf0.001", "events").withColumn("ts", W.F.col("ts").cast("timestamp"))
    src, sink, mark = (str(tmp_path / x) for x in ("src", "sink", "mark"))
    events.limit(100).write.parquet(src)
    for more in (0, 1):
        if more:
            events.filter("event_id >= 900").write.mode("append").parquet(src)
        W.drain(W.deduplicated(W.read_stream(spark, src, events), "ts", "365 days", "event_id"), sink, mark).awaitTermination(120)
    n = spark.read.parquet(sink).count()
    assert n == spark.read.parquet(src).select("event_id").distinct().count()
