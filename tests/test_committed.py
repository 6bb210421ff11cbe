"""Numbers in committed parts: versions, corrections, lost jobs."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from numerail.operators import division as dv
from numerail.operators import longnums as ln
from numerail.operators import numbers as nb
from numerail.sources import committed as cm

B, CHUNK = nb.BASE, nb.CHUNK


def text_of(spark, path, version=None):
    return "".join(r["text"] for r in cm.digits(spark, path, version).orderBy(F.desc("chunk")).collect())


def number(spark, value):
    return ln.stored(dv.from_int(spark, "n", value), "number")


def test_corrections_run_through_parts_as_versions(spark, tmp_path):
    """A carry over three parts and a borrow back, each a version that has only what changed."""
    sys.set_int_max_str_digits(0)
    path = str(tmp_path / "number")
    value = random.Random(1).randrange(B ** (CHUNK * 2 - 5)) * B ** (CHUNK * 4) + (B ** (CHUNK * 4) - 3)
    assert cm.save(number(spark, value), path, 3) == 1
    assert text_of(spark, path) == str(value) and cm.damaged(spark, path) == []
    assert cm.correct(spark, path, 10**9) == 2
    assert text_of(spark, path) == str(value + 10**9) and cm.damaged(spark, path) == []
    assert cm.correct(spark, path, -(10**9)) == 3 and cm.correct(spark, path, 1) == 4
    assert [text_of(spark, path, v) for v in (1, 2, 3, 4)] == [str(value + d) for d in (0, 10**9, 0, 1)]
    data = lambda v: spark.read.parquet(f"{path}/v{v}/data")
    assert data(1).count() == 6 and data(2).select("part").distinct().count() == 3 and [data(v).count() for v in (2, 3, 4)] == [5, 5, 1]
    with pytest.raises(ValueError, match="longer"):
        full = str(tmp_path / "full")
        cm.save(number(spark, B**CHUNK - 1), full, 1)
        cm.correct(spark, full, 1)


def test_a_lost_job_leaves_no_version(spark, tmp_path):
    path = str(tmp_path / "number")
    cm.save(number(spark, 7**5000), path, 2)

    def dies(batches):
        yield from batches
        raise RuntimeError("killed")

    broken = number(spark, 7**5001).mapInArrow(dies, ln.PACKED)
    with pytest.raises(Exception, match="killed"):
        cm._write(spark, broken.withColumn("part", F.lit(0)), path, {"version": 2, "parent": None, "nparts": 1, "chunks": 1, "primes": [], "batch": None})
    assert cm.header(spark, path)["version"] == 1 and int(text_of(spark, path)) == 7**5000
    assert cm.save(number(spark, 7**5002), path, 2) == 2 and int(text_of(spark, path)) == 7**5002
    # a part that has changed since is named
    data = cm.read(spark, path)
    other = data.withColumn("data", F.when(F.col("part") == 0, F.lit(bytes(4 * CHUNK))).otherwise(F.col("data")))
    assert cm.part_residues(data) == cm.header(spark, path)["residues"] != cm.part_residues(other)


def test_a_stream_of_corrections(spark, tmp_path):
    path, source = str(tmp_path / "number"), str(tmp_path / "in")
    cm.save(number(spark, 10**60 - 4), path, 1)
    for n, rows in enumerate(([1, 2], [5], [-5])):
        spark.createDataFrame([(x,) for x in rows], "by long").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("by long").parquet(source)
        cm.follow(stream, path, str(tmp_path / "marks")).awaitTermination()
        assert int(text_of(spark, path)) == 10**60 - 4 + [3, 8, 3][n]
    # a batch that comes again changes nothing
    h = cm.header(spark, path)
    assert h["batch"] == 2 and cm.correct(spark, path, 100, batch=2) == h["version"]


def test_writing_begins_before_the_number_is_final(spark, tmp_path):
    """The high part is written while the low one is made; its carry runs up through the parts."""
    path = str(tmp_path / "number")
    high, low = (B**CHUNK * 5 - 1) * B**CHUNK, B ** (CHUNK + 1) - 7
    seen = []

    def late():
        seen.append(cm.header(spark, path))
        return number(spark, low)

    version = cm.save_early(number(spark, high), late, path, 2)
    assert version == 2 and int(text_of(spark, path)) == high + low and cm.damaged(spark, path) == []
    assert not cm.header(spark, path, 1)["final"] and int(text_of(spark, path, 1)) == high
    # a low part that fails leaves an early version, which is not read as the number
    other = str(tmp_path / "other")

    def fails():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        cm.save_early(number(spark, high), fails, other, 2)
    with pytest.raises(FileNotFoundError, match="early"):
        cm.read(spark, other)
    assert cm.correct(spark, other, number(spark, low)) == 2 and int(text_of(spark, other)) == high + low
    # a number of no digits changes no chunk
    assert cm.correct(spark, other, number(spark, 0)) == 3 and int(text_of(spark, other)) == high + low
