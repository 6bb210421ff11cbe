import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from numerail.sources.packed import unpack60
from numerail.streaming.monitors import high_water, pack_stream, sample_windows


def test_stream_packer_carries_the_odd_limb(spark, tmp_path):
    limbs = {"a": list(range(100, 117)), "b": [10**18 - 1] * 8}
    chunks = [("a", 0, limbs["a"][:3], False), ("b", 0, limbs["b"][:5], False), ("a", 2, limbs["a"][8:], True), ("a", 1, limbs["a"][3:8], False), ("b", 1, limbs["b"][5:], True)]
    schema = "stream string, seq long, limbs array<long>, final boolean"
    for i, c in enumerate(chunks):
        spark.createDataFrame([c], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = pack_stream(source).writeStream.format("memory").queryName("packed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    for name, want in limbs.items():
        data = sorted(bytes(r["data"]) for r in spark.table("packed").where(F.col("stream") == name).collect())
        assert sum(map(len, data)) == 15 * (len(want) // 2) + 8 * (len(want) % 2)
    whole = [bytes(r["data"]) for r in spark.table("packed").where("stream = 'b'").collect()]
    assert all(np.all(unpack60(d, len(d) // 15 * 2) == 10**18 - 1) for d in whole)


def test_sample_windows_and_high_water(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, start + dt.timedelta(minutes=i), 100.0 - i) for i in range(12)] + [(2, start, 50.0)]
    df = spark.createDataFrame(rows, "rank int, ts timestamp, value double")
    got = {(r["rank"], r["start"].minute): (r["low"], r["high"], r["n"], r["alert"]) for r in sample_windows(df, guard=91.0).collect()}
    assert got == {(1, 0): (96.0, 100.0, 5, False), (1, 5): (91.0, 95.0, 5, False), (1, 10): (89.0, 90.0, 2, True), (2, 0): (50.0, 50.0, 1, True)}
    assert {r["rank"]: r["drop"] for r in high_water(df, "rank", "ts", "value").collect()} == {1: 11.0, 2: 0.0}
