from pyspark.sql import functions as F

from meterloom.operators import daily, quality
from meterloom.plans import queries
from meterloom.streaming.rollup import daily_stream


def test_stream_equals_batch(spark, folder, tmp_path):
    batch = queries.stamped(spark, folder)
    source = str(tmp_path / "in")
    # later files hold later days, as records arrive
    for first, last in ((1, 8), (9, 16), (17, 24), (25, 31)):
        part = batch.where(F.dayofmonth("settlement_datetime").between(first, last))
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = (
        daily_stream(stream, ["nd"], late="40 days").writeStream.format("memory").queryName("days")
        .outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start()
    )
    assert run.awaitTermination(120)
    # nothing is final while records may be 40 days late
    assert spark.table("days").count() == 0

    run = (
        daily_stream(stream, ["nd"], late="1 day").writeStream.format("memory").queryName("closed_days")
        .outputMode("append").option("checkpointLocation", str(tmp_path / "state2"))
        .trigger(availableNow=True).start()
    )
    assert run.awaitTermination(120)
    want = {r.date: r for r in daily.daily_rollup(quality.resolve_duplicates(batch)).collect()}
    got = spark.table("closed_days").collect()
    assert len(got) >= 20
    for r in got:
        w = want[r.date]
        assert (r.settlement_period_count, r.has_incomplete_day) == (w.settlement_period_count, w.has_incomplete_day)
        assert abs(r.nd_mean - w.nd_mean) < 1e-9 and r.nd_peak == w.nd_peak
