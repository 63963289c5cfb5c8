import datetime as dt

from fieldloom.streaming import arrivals


def test_stream_counts_and_deduplicates(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 12, 1)
    rows = [(1, "P<UTO", t), (1, "P<UTO", t), (2, "V<USA", t), (3, "x", t + dt.timedelta(minutes=15))]
    spark.createDataFrame(rows, arrivals.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = arrivals.arrivals(spark, str(tmp_path / "in"))
    for name, df, mode in (("once", arrivals.classified(stream), "append"), ("many", arrivals.counts(stream), "complete")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted((r.doc_id, r.type) for r in spark.table("once").collect()) == [(1, "PASSPORT"), (2, "VISA"), (3, "UNKNOWN")]
    assert sorted((r.type, r.n) for r in spark.table("many").collect()) == [("PASSPORT", 2), ("UNKNOWN", 1), ("VISA", 1)]
