from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from spanwright.sources import sinks, tables


def test_features_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", [1.0, 2.0])], "id int, name string, at array<double>")
    sinks.write_features(df.withColumn("geometry", F.struct(F.lit("Point").alias("type"), F.col("at").alias("coordinates"))), str(tmp_path / "f"), ["id", "name"], "geometry")
    back = tables.read_features(spark, str(tmp_path / "f"), "struct<id:int,name:string>").first()
    assert (back.properties.id, back.properties.name, json.loads(back.geometry.coordinates)) == (1, "é", [1.0, 2.0])


def test_corrupt_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"type":"Feature","properties":{"id":1}}\n{broken\n')
    rows = tables.read_features(spark, str(tmp_path / "x.jsonl"), "struct<id:int>").cache()
    assert rows.filter("_corrupt_record IS NOT NULL").count() == 1


def test_front_matter(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: x\n---\nbody\n")
    row = tables.read_front_matter(spark, str(tmp_path / "a.md")).first()
    assert (row.head, row.body) == ("title: x", "body\n")


def test_verified_and_sync(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"x")
    sums = spark.createDataFrame([("f.bin", hashlib.sha256(b"x").hexdigest()), ("g.bin", "00")], "name string, sha256 string")
    assert {tuple(r) for r in tables.verified(spark, str(tmp_path / "*.bin"), sums).collect()} == {("f.bin", True), ("g.bin", False)}
    a = spark.createDataFrame([("p", 1, 1), ("q", 2, 1)], "path string, size int, modified int")
    b = spark.createDataFrame([("q", 2, 1), ("r", 1, 1)], "path string, size int, modified int")
    assert {tuple(r) for r in sinks.to_sync(a, b).collect()} == {("p", "copy"), ("r", "delete")}


def test_chunks_overwrite_only_their_own(spark, tmp_path):
    path = str(tmp_path / "c")
    sinks.write_chunks(spark.createDataFrame([(1, "a"), (2, "b")], "v int, chunk string"), path, ["chunk"])
    sinks.write_chunks(spark.createDataFrame([(3, "b")], "v int, chunk string"), path, ["chunk"])
    assert {tuple(r) for r in spark.read.parquet(path).select("v", "chunk").collect()} == {(1, "a"), (3, "b")}
