"""Division of long packed numbers: Newton's reciprocal with doubling precision, the quotient in two halves.

A step takes what is left, a - x q, of an estimate x. Its size is known
beforehand, so the product x q is needed only modulo base^p - 1 for a p just
above that size, which a transform of p points gives by its own wrap. Each
step's identity is checked modulo primes; a step that fails is named.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import longnums as ln
from .numbers import BASE, CHUNK
from .residues import CHECK_PRIMES
from .transforms import length_for

#: Limbs of the first reciprocal, which the driver makes by itself (196,608 digits), and of what it divides whole.
SEED_LIMBS, WHOLE_LIMBS = 32_768, 4096
#: Units by which an estimate may be off at most before it counts as wrong.
MAX_CORRECTIONS = 8


@dataclass
class Steps:
    """How a division goes: whether products wrap, the primes of the checks, and the points of each step's product.

    ``fault`` is for tests: it gets a step's name and its result and returns what goes on in its place.
    """

    wrap: bool = True
    primes: tuple[int, ...] = CHECK_PRIMES[:2]
    points: dict[str, int] = field(default_factory=dict)
    fault: Callable[[str, DataFrame], DataFrame] | None = None


def chunks_of(num: str, value: int) -> Iterator[tuple]:
    """The rows of PACKED of an integer."""
    chunk, whole = 0, BASE**CHUNK
    while value or not chunk:
        value, low = divmod(value, whole)
        yield ln._packed_row(num, chunk, np.array(_limbs(low, CHUNK), dtype=np.int64))
        chunk += 1


def from_int(spark: SparkSession, num: str, value: int) -> DataFrame:
    """A number of few chunks from the driver."""
    return spark.createDataFrame(list(chunks_of(num, value)), ln.PACKED)


def _limbs(value: int, n: int) -> list[int]:
    """n limbs of an integer, by halves."""
    if n == 1:
        return [value]
    half = n // 2
    high, low = divmod(value, BASE**half)
    return _limbs(low, half) + _limbs(high, n - half)


def head(a: DataFrame, low: int) -> int:
    """The integer of the limbs from a position on, for a number that has few of them."""
    low = max(0, low)
    first = low // CHUNK
    total = 0
    for r in a.where(F.col("chunk") >= first).select("chunk", "data").collect():
        limbs = np.frombuffer(r["data"], dtype=np.uint32)[max(0, low - r["chunk"] * CHUNK) :]
        total += ln.integer_of(limbs) * BASE ** max(0, r["chunk"] * CHUNK - low)
    return total


def size(a: DataFrame) -> int:
    return max(0, a.agg(F.max("top")).first()[0] or 0) + 1


def _moved(a: DataFrame, by: int) -> DataFrame:
    return a if by == 0 else ln.assembled(ln.shifted(a, by))


def _low(a: DataFrame, count: int) -> DataFrame:
    return ln.below(a, count)


def power_of_base(spark: SparkSession, num: str, k: int) -> DataFrame:
    """base^k as PACKED."""
    one = np.zeros(CHUNK, dtype=np.int64)
    one[k % CHUNK] = 1
    rows = [ln._packed_row(num, k // CHUNK, one)]
    if k >= CHUNK:
        rows.append(ln._packed_row(num, 0, np.zeros(CHUNK, dtype=np.int64)))
    return spark.createDataFrame(rows, ln.PACKED)


def wrap_length(limbs: int) -> int:
    """The least length of a transform that is a multiple of a chunk and holds so many limbs."""
    return CHUNK * length_for(max(1, -(-limbs // CHUNK)), (1, 3))


def rest(a: DataFrame, x: DataFrame, q: DataFrame, limit: int, steps: Steps, name: str) -> tuple[DataFrame, int]:
    """|a - x q| and its sign, where it is known to be below base^limit. ``a`` may be PIECE or PACKED."""
    spark, num = q.sparkSession, q.first()["num"]
    a = ln.carried(a) if "stride" in a.columns else a
    p, whole = wrap_length(limit + 1), sum(ln.sizes(x, q))
    steps.points[name] = min(p, length_for(whole, (1, 3))) if steps.wrap else length_for(whole, (1, 3))
    if steps.wrap and p < whole:
        per = p // CHUNK
        product = ln.wrapped_product(x, q, p)
        nines = spark.range(per).select(F.lit(num).alias("num"), F.col("id").alias("chunk"), F.lit(0).cast("long").alias("start"), F.lit(CHUNK).cast("long").alias("stride"), F.lit(CHUNK).alias("width"), F.lit(np.full(CHUNK, BASE - 1, dtype=np.int64).tobytes()).alias("data"))
        folded = ln.as_pieces(a.withColumn("chunk", F.col("chunk") % per))
        # a + (base^p - 1 - product): its fold is what is left, or that far below base^p - 1
        left = ln.folded(ln.carried(folded.unionByName(nines.unionByName(ln.as_pieces(product, -1))), difference=False), p)
        left = ln.stored(left, "left")
        high = head(left, p - 1)
        if high not in (0, BASE - 1):
            raise ArithmeticError(f"division step {name}: what is left is larger than it can be")
        if high:
            left = ln.carried(nines.unionByName(ln.as_pieces(left, -1)))
        sign = -1 if high else 1
    else:
        product = ln.product(x, q)
        sign = ln.compared(a, product).first()["cmp"]
        left = ln.difference(a, product) if sign >= 0 else ln.difference(product, a)
        sign = -1 if sign < 0 else 1
    if steps.fault:
        left = steps.fault(name, left)
    mods = ln.residues_of({"a": a, "x": x, "q": q, "left": left}, list(steps.primes))
    for m, ra, rx, rq, rl in zip(steps.primes, *(mods[k] for k in ("a", "x", "q", "left")), strict=True):
        if (ra - rx * rq - sign * rl) % m:
            raise ArithmeticError(f"division step {name}: a - x q does not agree modulo {m}")
    return left, sign


def precisions(k: int, seed: int = SEED_LIMBS, guard: int = 2) -> list[int]:
    """Precisions of a Newton chain, each at most twice the one before less a guard; the last is k."""
    out = [k]
    while out[0] > seed:
        out.insert(0, out[0] // 2 + guard)
    return out


def reciprocal(q: DataFrame, n: int, k: int, seed: int = SEED_LIMBS, steps: Steps | None = None) -> DataFrame:
    """base^(n + k) / q for q of n limbs, off by a few units at most.

    A step from j to h limbs: what the leading limbs of q leave of base^(u + j),
    e = base^(u + j) - x q, gives x base^(h - j) + x e / base^(u + 2 j - h).
    """
    steps = steps or Steps()
    spark, num = q.sparkSession, q.first()["num"]
    chain = precisions(k, seed)
    j = chain[0]
    u = min(n, j + 2)
    x = from_int(spark, num, BASE ** (u + j) // head(q, n - u))
    for h in chain[1:]:
        u = min(n, h + 2)
        top = _moved(q, u - n)
        # x is off by less than 16 units and the limbs of q that an earlier step left out, so e is below base^(u + 2)
        e, sign = rest(power_of_base(spark, num, u + j), x, top, u + 2, steps, f"reciprocal of {h} limbs")
        s = max(0, u - h + j - 1)
        change = _moved(ln.product(x, _moved(e, -s)), -(u + 2 * j - h - s))
        moved = ln.shifted(x, h - j)
        x = ln.carried(moved.unionByName(ln.as_pieces(change, sign)), difference=sign < 0)
        j = h
    return x


def _quotient(a: DataFrame, q: DataFrame, mu: DataFrame, n: int, k: int, steps: Steps, name: str) -> tuple[DataFrame, DataFrame]:
    """Quotient and remainder for a below q base^k, by a reciprocal of k limbs at least (base^(n + k) / q)."""
    cut = max(0, n - 2)
    x = _moved(ln.product(_moved(a, -cut), mu), -(k + n - cut))
    r, sign = rest(a, x, q, n + 2, steps, name)
    low = max(0, n - 3)
    divisor = head(q, low)
    spark, num = q.sparkSession, q.first()["num"]
    for _ in range(MAX_CORRECTIONS):
        if sign > 0 and ln.compared(r, q).first()["cmp"] < 0:
            return x, r
        units = head(r, low) // (divisor + 1) + (0 if sign > 0 else 1)
        units = max(1, units)
        small, many = ln.as_pieces(from_int(spark, num, units), sign), ln.carried(ln.as_pieces(q, units))
        x = ln.carried(ln.as_pieces(x).unionByName(small), difference=sign < 0)
        over = ln.compared(r, many).first()["cmp"]
        r = ln.difference(r, many) if over >= 0 else ln.difference(many, r)
        sign = sign if over > 0 else 1 if over == 0 else -sign
    raise ArithmeticError(f"division step {name}: the estimate is too far off")


def divided(a: DataFrame, q: DataFrame, seed: int = SEED_LIMBS, steps: Steps | None = None) -> tuple[DataFrame, DataFrame]:
    """Quotient and remainder of two PACKED numbers (one of each, of one name; stored).

    The upper half of the quotient comes first, and what it leaves gives the
    lower half, so the reciprocal needs half of the quotient's limbs.
    """
    steps = steps or Steps()
    spark, num = q.sparkSession, q.first()["num"]
    na, n = ln.sizes(a, q)
    if not head(q, n - 1):
        raise ZeroDivisionError("division by zero")
    if na < n:
        return from_int(spark, num, 0), a
    if na <= min(seed, WHOLE_LIMBS):
        x, r = divmod(head(a, 0), head(q, 0))
        return from_int(spark, num, x), from_int(spark, num, r)
    k = na - n + 1
    low = k // 2
    high = k - low
    mu = reciprocal(q, n, high + 1, seed, steps)
    mu = _moved(mu, -1)  # base^(n + high) / q
    x, r = _quotient(_moved(a, -low), q, mu, n, high, steps, "quotient, upper half")
    if not low:
        return x, r
    rest_of_a = ln.assembled(ln.shifted(r, low).unionByName(ln.as_pieces(_low(a, low))))
    mu = _moved(mu, low - high)
    y, r = _quotient(rest_of_a, q, mu, n, low, steps, "quotient, lower half")
    return ln.carried(ln.shifted(x, low).unionByName(ln.as_pieces(y))), r  # y may be base^low at most
