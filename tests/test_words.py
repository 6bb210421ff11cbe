"""Numbers over one word."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from numerail.operators import numbers as nb
from numerail.operators import products as pr
from numerail.operators import residues as rs
from numerail.operators import words as wd

R = random.Random(11)
LENGTHS = {"one": 1, "run": wd.RUN, "more": wd.RUN + 1, "two": wd.RUN**2 + 3}


@pytest.mark.parametrize("divisor", [1, 2, 7, 10**6, 998_244_353, wd.WIDE_FROM - 1, wd.WIDE_FROM, 2**59 - 55, 10**18])
def test_quotients_by_a_word(spark, divisor):
    numbers = {k: R.randrange(1, nb.BASE**n) for k, n in LENGTHS.items() if n < 1000} | {"zero": 0, "below": divisor - 1, "equal": divisor, "top": nb.BASE**300 - 1, "power": nb.BASE**257}
    q, r = wd.divided_by_word(nb.from_ints(spark, numbers), divisor)
    assert nb.to_ints(q) == {k: v // divisor for k, v in numbers.items()}
    assert {x["num"]: x["remainder"] for x in r.collect()} == {k: v % divisor for k, v in numbers.items()}
    # no zero limb above the top
    tops = {x["num"]: x["n"] for x in q.groupBy("num").count().withColumnRenamed("count", "n").collect()}
    assert tops == {k: len(nb.limbs_of(v // divisor)) for k, v in numbers.items()}


def test_a_number_of_runs_of_runs(spark):
    n = LENGTHS["two"]
    number = nb.power(spark, "p", n)  # base^n
    q, r = wd.divided_by_word(number, 999_983)
    assert r.first()["remainder"] == pow(nb.BASE, n, 999_983)
    back = nb.added(nb.times_small(q, 999_983), nb.from_ints(spark, {"p": pow(nb.BASE, n, 999_983)}))
    assert not nb.compared(back, number).where("cmp <> 0").take(1)


def test_words_that_are_none(spark):
    for divisor in (0, -3, 10**18 + 1):
        with pytest.raises(ValueError, match="word"):
            wd.divided_by_word(nb.from_ints(spark, {"a": 5}), divisor)
    q, r = wd.divided_by_word(nb.from_ints(spark, {"a": 5}).where("false"), 7)
    assert q.count() == r.count() == 0


@pytest.mark.parametrize("q", [2, 3, 998_244_353, rs.CHECK_PRIMES[0]])
def test_powers_and_inverses_modulo_a_prime(spark, q):
    values = [0, 1, -1, 2, 17, q - 1, q, -q, 3 * q + 2, 10**37, -(10**37)] + [R.randrange(-(10**30), 10**30) for _ in range(40)]
    df = spark.createDataFrame([(i, Decimal(v)) for i, v in enumerate(values)], "i int, v decimal(38,0)").withColumn("c", rs.canonical(F.col("v"), q))
    rows = df.select("i", "c", rs.inversemod(F.col("c"), q).alias("inv"), rs.raisedmod(F.col("c"), 0, q).alias("p0"), rs.raisedmod(F.col("c"), 12_345, q).alias("p"))
    for r in rows.collect():
        c = values[r["i"]] % q
        assert (r["c"], r["p0"], r["p"]) == (c, 1, pow(c, 12_345, q)) and r["inv"] == (pow(c, -1, q) if c else None)
    with pytest.raises(ValueError, match="prime"):
        rs.inversemod(F.col("c"), 15)


def test_bands_of_products(spark):
    """What a cut leaves out is less than a unit at the cut for each pair of blocks left out."""
    a, b = R.getrandbits(1500) | 1, R.getrandbits(1100) | 1
    x, y = nb.from_ints(spark, {"n": a}), nb.from_ints(spark, {"n": b})
    for low, high, size in ((40, None, 8), (24, 48, 8), (0, 30, 8), (33, 47, 4)):
        got = nb.to_ints(pr.multiplied(x, y, low=low, high=high, size=size))["n"]
        top = nb.BASE ** (high or 1000)
        assert 0 <= (a * b - got) % top <= (low // size + 1) ** 2 * nb.BASE**low
