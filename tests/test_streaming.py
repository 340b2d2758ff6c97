from __future__ import annotations

from spanwright.streaming import events as E


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def source(spark, tmp_path):
    rows = [("u", "2024-01-01 00:00:01"), ("u", "2024-01-01 00:00:02"), ("u", "2024-01-02 00:00:00"), ("v", "2024-01-05 00:00:00")]
    spark.createDataFrame(rows, "user string, at string").selectExpr("user", "CAST(at AS timestamp) AS ts").write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("user string, ts timestamp").parquet(str(tmp_path / "in"))


def test_daily_position(spark, tmp_path):
    got = run(spark, E.daily_position(source(spark, tmp_path), "user", "ts"), "daily", "update")
    assert {tuple(r) for r in got} == {("u", 1, "2024-01-02"), ("v", 0, "2024-01-05")}


def test_throttled(spark, tmp_path):
    got = run(spark, E.throttled(source(spark, tmp_path), "user", "ts", 1), "throttle", "complete")
    assert {(r.user, r.attempts, r.blocked) for r in got} == {("u", 2, 1), ("u", 1, 0), ("v", 1, 0)}
