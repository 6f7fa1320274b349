"""Streams over files, against the same work as a batch."""

import uuid

from pyspark.sql import functions as F

from framesift.operators.similarity import shared_folder
from framesift.sources.bindings import photos, table
from framesift.streaming import library as L

SF = "/root/testdata/sf0.001"


def test_sessions(spark):
    e = table(spark, SF, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 5).alias("camera"))
    at = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    e.repartition(4).write.parquet(at)
    name = f"s{uuid.uuid4().hex}"
    stream = spark.readStream.schema(e.schema).parquet(at)
    L.sessions(stream, by="camera").select("camera", "n", "first", "last").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    rows = lambda df: sorted(tuple(r) for r in df.select("camera", "n", "first", "last").collect())
    want = rows(L.sessions(e, by="camera"))
    assert rows(spark.table(name)) == want and sum(n for _, n, *_ in want) == e.count()


def test_import_goes_on_where_it_stopped(spark):
    p = photos(spark, SF, "id", "captured_at", "group_id")
    base = f"{shared_folder(spark)}/import-{uuid.uuid4().hex}"
    p.filter("id % 2 = 0").write.parquet(f"{base}/in")
    for part in ("id % 2 = 1 and id % 3 = 0", "id % 2 = 1 and id % 3 > 0", None):
        L.import_into(L.photo_stream(spark, f"{base}/in", "id long, captured_at long, group_id string"), f"{base}/out", f"{base}/cursor").awaitTermination()
        if part:
            p.filter(part).write.mode("append").parquet(f"{base}/in")
    out = spark.read.parquet(f"{base}/out")
    assert out.count() == p.count() == out.select("id").distinct().count()
    late = L.late_series(p.filter("id < 100"), p).select("id", "group_id").collect()
    assert {r["id"] for r in late} == set(range(100)) | {r["id"] for r in p.filter("group_id = ''").collect()} and len(late) == len({r["id"] for r in late})


def test_hourly_usage(spark):
    e = table(spark, SF, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    got = {r["window"]["start"]: r["used"] for r in L.hourly_usage(e).collect()}
    assert max(got.values()) <= e.count() and len(got) > 30
