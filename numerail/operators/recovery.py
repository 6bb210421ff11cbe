"""Products that are checked piece by piece, of which only what fails is made again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import longnums as ln
from .numbers import CHUNK
from .residues import CHECK_PRIMES, WIDE, mulmod
from .storage import stored

#: Failed pieces that are made again one by one; if there are more, all are.
MOST_FAILED = 10_000
#: Places of a product at most: a task holds a band of each, and their products are as many as the square.
MOST_PLACES = 256


def piece_residues(a: DataFrame, piece: int, primes: list[int]) -> DataFrame:
    """num, piece, r0, r1, ...: the residues of each piece of ``piece`` limbs (a multiple of 4096) as a number of its own."""
    per = piece // CHUNK
    cut = a.select(F.concat("num", F.lit("|"), F.expr(f"chunk div {per}").cast("string")).alias("num"), (F.col("chunk") % per).alias("chunk"), "data")
    named = ln.residues(cut, primes)
    return named.select(F.expr("substring_index(num, '|', size(split(num, '[|]')) - 1)").alias("num"), F.expr("int(substring_index(num, '|', -1))").alias("piece"), *[f"r{i}" for i in range(len(primes))])


def unlike(found: DataFrame, wanted: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The keys whose residues do not agree, or that one of the tables does not have."""
    both = found.alias("f").join(wanted.alias("w"), keys, "full")
    same = F.lit(True)
    for i in range(count):
        same = same & F.col(f"f.r{i}").cast(WIDE).eqNullSafe(F.col(f"w.r{i}").cast(WIDE))
    return both.where(~same).select(*keys)


def at_rest(a: DataFrame, recorded: DataFrame, piece: int, primes: list[int]) -> DataFrame:
    """num, piece of the pieces of an operand that are not what they were when their residues were recorded."""
    return unlike(piece_residues(a, piece, primes), recorded, ["num", "piece"], len(primes))


def planned(a: DataFrame, b: DataFrame, primes: list[int]) -> DataFrame:
    """num (<num>|<place>), r0, ...: what the residues of each place of a product have to be, from those of the operands' pieces."""
    both = a.alias("a").join(b.alias("b"), "num")
    place = F.concat("num", F.lit("|"), (F.col("a.piece") + F.col("b.piece")).cast("string")).alias("num")
    terms = both.select(place, *[mulmod(F.col(f"a.r{i}"), F.col(f"b.r{i}"), q).alias(f"r{i}") for i, q in enumerate(primes)])
    wide = "decimal(38,0)"
    return terms.groupBy("num").agg(*[(F.sum(f"r{i}").cast(wide) % F.lit(q).cast(wide)).cast(WIDE).alias(f"r{i}") for i, q in enumerate(primes)])


def product_in_pieces(a: DataFrame, b: DataFrame, max_points: int, primes: tuple[int, ...] = CHECK_PRIMES[:2], attempts: int = 3, fault: Callable[[DataFrame, int], DataFrame] | None = None) -> tuple[DataFrame, list[int]]:
    """a * b (PACKED, stored), and how many places of it each attempt made.

    ``max_points`` is doubled, up to MAX_POINTS, until there are no more than
    MOST_PLACES places. The operands' pieces have their residues taken once and are compared with
    them again before each attempt. Every place of the product (the sum of the
    products of pieces i and j with i + j alike) is a number of its own, whose
    residues have to be those that the operands' give; the places that differ,
    and no others, are made again. ``fault`` is for tests: it gets the places
    (PACKED, named <num>|<place>) and the attempt and returns what is checked.
    """
    limbs = sum(ln.sizes(a, b))
    while max_points < ln.MAX_POINTS and limbs > MOST_PLACES * (max_points // 2):
        max_points *= 2
    shape, piece = ln._layout(a, b, max_points)
    checks = list(primes)
    ra, rb = (stored(piece_residues(n, piece, checks), "pieces-at-rest") for n in (a, b))
    plan = stored(planned(ra, rb, checks), "places")
    good, only, failed, made = None, None, None, []
    for attempt in range(attempts):
        for name, n, r in (("first", a, ra), ("second", b, rb)):
            bad = at_rest(n, r, piece, checks).take(1)
            if bad:
                raise ArithmeticError(f"the {name} operand has changed since its residues were taken: piece {bad[0]['piece']} of {bad[0]['num']}")
        slices = ln._sliced(a, shape, 0, piece, False).unionByName(ln._sliced(b, shape, 1, piece, False))
        bands = ln._mapped(ln._dealt(slices, "num", "side", "piece", "band"), ln._forward(shape), ln.TILE)
        lines = ln._mapped(ln._dealt(bands, "num", "band"), ln._pointwise(shape, only), ln.TILE)
        places = ln.carried(ln._mapped(ln._dealt(lines, "num", "piece", "band"), ln._backward(shape, piece, False, apart=True), ln.PIECE))
        if fault:
            places = stored(fault(places, attempt), "places-made")
        made.append(places.select("num").distinct().count())
        expected = plan if failed is None else plan.join(failed, "num", "left_semi")
        failed = stored(unlike(ln.residues(places, checks), expected, ["num"], len(checks)), "failed")
        sound = places.join(failed, "num", "left_anti")
        good = stored(sound if good is None else good.unionByName(sound), "places-sound")
        names = [r["num"] for r in failed.limit(MOST_FAILED + 1).collect()]
        if not names:
            per = piece // CHUNK
            at = F.expr("bigint(substring_index(num, '|', -1))") * per
            name = F.expr("substring_index(num, '|', size(split(num, '[|]')) - 1)")
            return ln.carried(ln.as_pieces(good.select(name.alias("num"), (F.col("chunk") + at).alias("chunk"), "data"))), made
        if len(names) > MOST_FAILED:
            good, only, failed = None, None, None
        else:
            only = frozenset((n.rpartition("|")[0], int(n.rpartition("|")[2])) for n in names)
    raise ArithmeticError(f"places of a product do not agree with their residues after {attempts} attempts: {names[:5]}")
