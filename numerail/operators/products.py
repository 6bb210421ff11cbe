"""Exact products of limb numbers: convolution joins and block grids."""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import longnums
from .numbers import BASE, DIGITS, carried, digits_to_limbs
from .storage import stored

#: Limbs of a block of the grid; a block is one string of 6 digits a limb.
BLOCK = 2048


def _context(digits: int) -> decimal.Context:
    return decimal.Context(prec=max(28, digits), Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN, traps=[decimal.Inexact, decimal.InvalidOperation])


def convolved(a: DataFrame, b: DataFrame, low: int = 0, high: int | None = None, cycle: int | None = None) -> DataFrame:
    """Product by the definition: limbs of a and b of the same name meet, and
    products add up by position (modulo ``cycle`` if given).

    Positions outside [low, high) are cut in the join itself. For short
    operands or one short one; ``multiplied`` is for long ones.
    """
    x = a.select("num", F.col("idx").alias("i"), F.col("limb").alias("x")).where("x <> 0")
    y = b.select("num", F.col("idx").alias("j"), F.col("limb").alias("y")).where("y <> 0")
    cut = [F.col("i") + F.col("j") >= low] + ([F.col("i") + F.col("j") < high] if high is not None else [])
    on = [x["num"] == y["num"], *cut]
    k = (F.col("i") + F.col("j")) % cycle if cycle else F.col("i") + F.col("j")
    # (10^6 - 1)^2 < 10^12, so nine million products fit a bigint sum
    sums = x.join(y, on).groupBy(x["num"], k.alias("idx")).agg(F.sum(F.col("x") * F.col("y")).alias("limb"))
    return carried(sums)


def to_blocks(df: DataFrame, size: int = BLOCK) -> DataFrame:
    """(num, blk, text): blocks of limbs as digit strings, most significant first."""
    parts = df.select("num", F.expr(f"idx div {size}").alias("blk"), F.expr(f"idx % {size}").alias("k"), F.lpad(F.col("limb").cast("string"), DIGITS, "0").alias("t"))
    grouped = parts.groupBy("num", "blk").agg(F.reverse(F.array_sort(F.collect_list(F.struct("k", "t")))).alias("p"))
    return grouped.select("num", "blk", F.array_join(F.transform("p", lambda s: s["t"]), "").alias("text"))


def from_blocks(df: DataFrame, size: int = BLOCK) -> DataFrame:
    """Position sums (num, idx, limb) of blocks (num, blk, limbs), which may be longer than a block."""
    wide = df.select("num", "blk", F.posexplode("limbs").alias("_i", "limb"))
    return wide.groupBy("num", (F.col("blk") * size + F.col("_i")).cast("long").alias("idx")).agg(F.sum("limb").alias("limb"))


def cells(spark: SparkSession) -> int:
    """The side of the grid of cells: about as many cells as shuffle partitions."""
    return max(1, math.ceil(math.sqrt(int(spark.conf.get("spark.sql.shuffle.partitions", "200")))))


def _multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for x, y in zip(f["x"], f["y"], strict=True):
            out.append(digits_to_limbs(format(_context(len(x) + len(y)).multiply(decimal.Decimal(x), decimal.Decimal(y)), "f").encode()))
        yield pd.DataFrame({"num": f["num"], "blk": f["blk"], "limbs": out})


def block_grid(a: DataFrame, b: DataFrame, low: int = 0, high: int | None = None, size: int = BLOCK) -> DataFrame:
    """Pairs of blocks whose products can reach positions in [low, high).

    The pairs of a number are dealt over a square grid of cells (i modulo k,
    j modulo k): each block goes to the k cells of its row or column and meets
    the others there, so that one long product is the work of k * k tasks.
    """
    k = cells(a.sparkSession)
    others = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    x = to_blocks(a, size).select("num", F.col("blk").alias("i"), F.col("text").alias("x"), (F.col("blk") % k).cast("int").alias("ci"), others.alias("cj"))
    y = to_blocks(b, size).select("num", F.col("blk").alias("j"), F.col("text").alias("y"), others.alias("ci"), (F.col("blk") % k).cast("int").alias("cj"))
    n = k * k
    x, y = x.repartition(n, "num", "ci", "cj"), y.repartition(n, "num", "ci", "cj")
    on = [x["num"] == y["num"], x["ci"] == y["ci"], x["cj"] == y["cj"], (F.col("i") + F.col("j") + 2) * size > low]
    if high is not None:
        on.append((F.col("i") + F.col("j")) * size < high)
    return x.join(y, on).select(x["num"], (F.col("i") + F.col("j")).alias("blk"), "x", "y")


def multiplied(a: DataFrame, b: DataFrame, plus: DataFrame | None = None, low: int = 0, high: int | None = None, cycle: int | None = None, size: int | None = None) -> DataFrame:
    """a * b (+ plus) of numbers of the same names.

    By distributed transforms (longnums.py), in time about n log n. With a
    ``size`` by a grid of blocks of so many limbs, each pair an exact decimal
    product, in time of the product of the lengths: for a short operand, or a
    few positions of a long product.

    ``high`` gives the product modulo base^high; ``low`` lets a grid leave out
    pairs that end below it, so what is above comes out low by at most the pairs
    left out (a band has both; transforms leave out nothing); ``cycle`` gives
    the product modulo base^cycle - 1 up to a further fold. The added operand
    joins before the carry, in one shuffle.
    """
    if size is None:
        return _by_transforms(a, b, plus, high, cycle)
    grid = block_grid(a, b, low, high, size)
    sums = from_blocks(grid.mapInPandas(_multiply, "num string, blk long, limbs array<bigint>"), size)
    if plus is not None:
        sums = sums.unionByName(plus.select("num", "idx", "limb"))
    if high is not None:
        sums = sums.where(F.col("idx") < high)
    if cycle is not None:
        sums = sums.withColumn("idx", F.col("idx") % cycle)
    # the carries read their input several times, the products are made once
    out = carried(stored(sums.groupBy("num", "idx").agg(F.sum("limb").alias("limb")), "sums"))
    return out.where(F.col("idx") < high) if high is not None else out


def _by_transforms(a: DataFrame, b: DataFrame, plus: DataFrame | None, high: int | None, cycle: int | None) -> DataFrame:
    x = longnums.packed(a)
    y = x if b is a else longnums.packed(b)
    more = None if plus is None else x if plus is a else y if plus is b else longnums.packed(plus)
    out = longnums.unpacked(longnums.product(x, y, more, high))
    if cycle is None:
        return out
    sums = stored(out.groupBy("num", (F.col("idx") % cycle).alias("idx")).agg(F.sum("limb").alias("limb")), "wrapped")
    return stored(carried(sums, rounds=1), "wrapped")


#: Digits of an operand in a batch, beyond which a product is split into pieces.
LONG_DIGITS = 20_000


def multiply_many(pairs: DataFrame, long_digits: int = LONG_DIGITS) -> DataFrame:
    """Many products at once: (pair_id, a, b) digit strings to (pair_id, product).

    A pair with a longer operand is split into a grid of blocks, which are
    multiplied apart and added up, so no task multiplies all of it.
    """

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"pair_id": f["pair_id"], "product": [format(_context(len(x) + len(y)).multiply(decimal.Decimal(x), decimal.Decimal(y)), "f") for x, y in zip(f["a"], f["b"], strict=True)]})

    long = (F.length("a") > long_digits) | (F.length("b") > long_digits)
    short = pairs.where(~long).select("pair_id", "a", "b").mapInPandas(run, "pair_id long, product string")
    return short.unionByName(_in_pieces(pairs.where(long), max(1, long_digits // DIGITS)))


def _in_pieces(pairs: DataFrame, size: int) -> DataFrame:
    from .numbers import from_digits
    from .residues import FAN

    number = lambda c: from_digits(pairs.select(F.col("pair_id").cast("string").alias("num"), F.col(c).alias("digits")))
    limbs = multiplied(number("a"), number("b"), size=size)
    # limbs to text in two steps, runs of limbs first
    step = limbs.groupBy("num", F.expr(f"idx div {FAN}").alias("k")).agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("idx", "limb")))), lambda s: F.lpad(s["limb"].cast("string"), DIGITS, "0")), "").alias("t"))
    text = step.groupBy("num").agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("k", "t")))), lambda s: s["t"]), "").alias("t"))
    whole = F.regexp_replace("t", "^0+", "")
    return text.select(F.col("num").cast("long").alias("pair_id"), F.when(whole == "", "0").otherwise(whole).alias("product"))


def checked_product(a: DataFrame, b: DataFrame, primes: list[int], attempts: int = 2, fault=None, **cuts) -> DataFrame:
    """The product, accepted when (a mod q)(b mod q) = product mod q for all q; else made again.

    The residues of the operands are taken once. ``fault`` is for tests of the
    check: it gets the product and the number of the attempt, and returns what
    is checked in its place.
    """
    from .residues import identity_holds, mulmod

    a, b = longnums.packed(a), longnums.packed(b)
    ra, rb = longnums.residues(a, primes), longnums.residues(b, primes)
    want = ra.alias("a").join(rb.alias("b"), "num").select("num", *[mulmod(F.col(f"a.r{i}"), F.col(f"b.r{i}"), q).alias(f"r{i}") for i, q in enumerate(primes)])
    want = stored(want, "product-residues")
    for attempt in range(attempts):
        product = longnums.packed(multiplied(longnums.unpacked(a), longnums.unpacked(b), **cuts)) if cuts else longnums.product(a, b)
        if fault:
            product = longnums.packed(fault(longnums.unpacked(product), attempt))
        if not identity_holds(want, longnums.residues(product, primes), primes).where("not ok").take(1):
            return longnums.unpacked(product)
    raise ArithmeticError("a product does not agree with its residues")


def max_terms(bits: int = 63, base: int = BASE) -> int:
    """Products that a signed sum of so many bits holds: the bound of convolved()."""
    return (2**bits - 1) // (base - 1) ** 2
