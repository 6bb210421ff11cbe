"""Long numbers: carries by heads, places of a product, leaves of a series, jobs of a division."""

import random

import pytest
from pyspark.sql import functions as F

from numerail.operators import division as dv
from numerail.operators import longnums as ln
from numerail.operators import recovery as rv
from numerail.operators import series as se
from numerail.operators.numbers import BASE, CHUNK


@pytest.mark.parametrize("heads", [-1, 1 << 14])
def test_carries_by_heads_and_by_windows(spark, monkeypatch, heads):
    monkeypatch.setattr(ln, "HEADS", heads)
    long = BASE ** (3 * CHUNK)
    r = random.Random(5).randrange(BASE ** (2 * CHUNK))
    for x, y in ((long - 1, 1), (long - BASE ** (CHUNK + 7), BASE ** (CHUNK + 7)), (r, r // 3), (long - 1, long - 1), (0, 0)):
        a, b = dv.from_int(spark, "n", x), dv.from_int(spark, "n", y)
        assert dv.head(ln.sum_of(a, b), 0) == x + y
        assert dv.head(ln.difference(a, b), 0) == x - y
    assert dv.head(ln.difference(dv.from_int(spark, "n", long), dv.from_int(spark, "n", 1)), 0) == long - 1


def test_a_borrow_passes_chunks_without_a_row(spark):
    a = dv.from_int(spark, "n", BASE ** (5 * CHUNK)).where("chunk = 0 or top >= 0")
    assert dv.head(ln.difference(a, dv.from_int(spark, "n", 1)), 0) == BASE ** (5 * CHUNK) - 1


def test_places_of_a_product_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(rv, "MOST_PLACES", 4)
    some = random.Random(7)
    x, y = some.randrange(BASE ** (11 * CHUNK)), some.randrange(BASE ** (3 * CHUNK))
    spoiled = lambda places, attempt: places if attempt else places.withColumn("data", F.when((F.col("num") == "n|0") & (F.col("chunk") == 0), F.lit(bytes(4 * CHUNK))).otherwise(F.col("data")))
    product, made = rv.product_in_pieces(dv.from_int(spark, "n", x), dv.from_int(spark, "n", y), 2 * CHUNK, fault=spoiled)
    assert made[0] <= 4 and made[1:] == [1]
    assert dv.head(product, 0) == x * y


def test_batches_to_python_are_bounded(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.range(3 * CHUNK).select(F.lit("n").alias("num"), F.col("id").alias("idx"), F.lit(BASE - 1).cast("long").alias("limb"))
    assert dv.head(ln.packed(rows), 0) == BASE ** (3 * CHUNK) - 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= ln.BATCH_BYTES


def test_leaves_are_few_and_equal_the_recurrence():
    for a, b in ((1, 2), (1, 65), (5, 300), (1000, 1777)):
        p, q = 0, 1
        for k in range(b - 1, a - 1, -1):
            p, q = q + p, q * k
        assert se.leaf_fold(a, b) == (p, q)
    assert se.leaf_for(10) == se.LEAF
    n = se.terms_for(5_400_000)
    assert -(-n // se.leaf_for(n)) <= se.LEAVES


def test_a_division_takes_few_jobs(spark):
    """The first reciprocal and both halves of the quotient."""
    some = random.Random(9)
    x, y = some.randrange(BASE ** (5 * CHUNK)), some.randrange(BASE ** (2 * CHUNK))
    a, b = dv.from_int(spark, "n", x), dv.from_int(spark, "n", y)
    a, b = ln.stored(a, "a"), ln.stored(b, "b")
    next_job = spark.sparkContext._jsc.sc().dagScheduler().nextJobId
    before = next_job()
    q, r = dv.divided(a, b)
    jobs = next_job() - before
    assert (dv.head(q, 0), dv.head(r, 0)) == divmod(x, y)
    assert jobs < 140
