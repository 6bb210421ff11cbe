"""Residues of limb numbers and digit strings, by ordered folds of chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbers import BASE

#: Elements that one fold combines; tiers of folds reduce any number of them.
FAN = 4096
#: Decimal digits that one step of a digit fold takes.
STEP = 9


def is_prime(n: int) -> bool:
    """Miller-Rabin; the witnesses decide all n below 3.3 * 10^24."""
    if n < 2:
        return False
    witnesses = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41)
    for p in witnesses:
        if n % p == 0:
            return n == p
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in witnesses:
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_above(start: int, count: int) -> list[int]:
    """The first primes above a number. Checks need primes, not just odd moduli."""
    out, n = [], start | 1
    while len(out) < count:
        if n > start and is_prime(n):
            out.append(n)
        n += 2
    return out


#: Moduli of the checks of large numbers.
CHECK_PRIMES = tuple(primes_above(2**62, 8))
WIDE, PRODUCT = "decimal(19,0)", "decimal(38,0)"


def mulmod(a: Column, b: Column, q: int) -> Column:
    """a * b mod q for a, b < q < 2^63, exact in decimal(38, 0)."""
    return ((a.cast(WIDE) * b.cast(WIDE)).cast(PRODUCT) % F.lit(q).cast(WIDE)).cast(WIDE)


def canonical(a: Column, q: int) -> Column:
    """The representative from 0 to q - 1 of an integer of any sign (up to 38 digits)."""
    m = F.lit(q).cast(PRODUCT)
    return F.pmod(a.cast(PRODUCT), m).cast(WIDE)


def raisedmod(a: Column, e: int, q: int) -> Column:
    """a^e mod q for 0 <= a < q < 2^63 and e >= 0, by squaring along the bits of e."""
    if e < 0:
        raise ValueError("a negative exponent; take the power of the inverse")
    one = F.lit(1).cast(WIDE)
    bits = F.array(*[F.lit(bit == "1") for bit in f"{e:b}"])
    return F.aggregate(bits, one, lambda acc, bit: mulmod(mulmod(acc, acc, q), F.when(bit, a.cast(WIDE)).otherwise(one), q))


def inversemod(a: Column, q: int) -> Column:
    """The inverse of a modulo a prime below 2^63, from 1 to q - 1; null for 0."""
    if not is_prime(q):
        raise ValueError(f"{q} is no prime")
    return F.when(a != 0, raisedmod(a, q - 2, q))


def _horner(items: Column, weight: int, q: int) -> Column:
    """From the first element on: (acc * weight + x) mod q."""
    w = weight % q
    if q < 2**31:
        return F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: (acc * F.lit(w).cast("long") + x.cast("long") % q) % q)
    zero, m = F.lit(0).cast(PRODUCT), F.lit(q).cast(WIDE)
    step = lambda acc, x: (((acc.cast(WIDE) * F.lit(w).cast(WIDE)).cast(PRODUCT) % m + x.cast(WIDE) % m) % m).cast(PRODUCT)
    return F.aggregate(items, zero, step)


def _field(items: str, name: str) -> Column:
    return F.transform(items, lambda s: s[name])


def folded_mod(df: DataFrame, by: list[str], value: str, primes: list[int], base: int) -> DataFrame:
    """``by`` and r0, r1, ...: dense ordered values as digits of a number in a base, modulo each q.

    Chunks of 4096 values are folded in the order of ``idx``; a chunk's residue
    has the weight base^(values before it), so the chunks are summed in any
    order and the input runs once. All residues come in one pass.
    """
    names = [f"r{i}" for i in range(len(primes))]
    items = F.reverse(F.array_sort(F.collect_list(F.struct("idx", F.col(value).alias("v")))))
    groups = df.select(*by, "idx", value).groupBy(*by, F.expr(f"idx div {FAN}").alias("_chunk")).agg(items.alias("_items"))
    folds = [mulmod(_horner(_field("_items", "v"), base, q), powmod(pow(base, FAN, q), F.col("_chunk"), q), q).alias(n) for n, q in zip(names, primes, strict=True)]
    sums = groups.select(*by, *folds).groupBy(*by).agg(*[(F.sum(n).cast(PRODUCT) % F.lit(q).cast(WIDE)).cast(WIDE).alias(n) for n, q in zip(names, primes, strict=True)])
    kinds = ["long" if q < 2**31 else WIDE for q in primes]
    return sums.select(*by, *[F.col(n).cast(k).alias(n) for n, k in zip(names, kinds, strict=True)])


def limbs_mod(df: DataFrame, primes: list[int], base: int = BASE) -> DataFrame:
    """num, r0, r1, ...: numbers modulo each q."""
    return folded_mod(df, ["num"], "limb", primes, base)


def digits_mod(df: DataFrame, primes: list[int]) -> DataFrame:
    """num, r0, ...: digit strings (num, chunk_no, text; most significant chunk
    first) modulo each q. Chunks may differ in length: each is folded alone and
    joined to the next by 10^length."""
    names = [f"r{i}" for i in range(len(primes))]
    pieces = F.expr(f"transform(sequence(0, (length(text) - 1) div {STEP}), i -> substring(text, i * {STEP} + 1, {STEP}))")
    one = df.where("text <> ''").withColumn("_p", pieces)

    def chunk(q: int) -> Column:
        m = F.lit(q).cast(WIDE)
        step = lambda acc, x: (((acc.cast(WIDE) * F.pow(F.lit(10.0), F.length(x)).cast("long").cast(WIDE)).cast(PRODUCT) % m + x.cast(WIDE) % m) % m).cast(PRODUCT)
        return F.aggregate("_p", F.lit(0).cast(PRODUCT), step).cast(WIDE)

    folded = one.select("num", "chunk_no", F.length("text").alias("n"), *[chunk(q).alias(x) for q, x in zip(primes, names, strict=True)])
    return joined_mod(folded, primes)


def joined_mod(parts: DataFrame, primes: list[int]) -> DataFrame:
    """Joins residues of consecutive digit chunks (num, chunk_no, n, r0, ...) into those of the whole.

    A chunk weighs 10^(digits after it): running sums give the digits, powers
    of ten by square and multiply give the weight, and the sum needs no order.
    The sums run within groups of chunks, and over the groups, a row each.
    """
    grouped = parts.withColumn("_g", F.floor(F.col("chunk_no") / FAN))
    sums = grouped.groupBy("num", "_g").agg(F.sum("n").alias("_n"))
    later = Window.partitionBy("num").orderBy(F.desc("_g")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("num", "_g", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_later"))
    after = Window.partitionBy("num", "_g").orderBy(F.desc("chunk_no")).rowsBetween(Window.unboundedPreceding, -1)
    out = grouped.withColumn("_inner", F.coalesce(F.sum("n").over(after), F.lit(0))).join(sums, ["num", "_g"])
    out = out.withColumn("_after", (F.col("_inner") + F.col("_later")).cast("long"))
    sums = []
    for i, q in enumerate(primes):
        w = powmod(10, F.col("_after"), q)
        sums.append((F.sum(mulmod(F.col(f"r{i}"), w, q)).cast(PRODUCT) % F.lit(q).cast(WIDE)).cast(WIDE).alias(f"r{i}"))
    return out.groupBy("num").agg(*sums)


def powmod(base: int, exponent: Column, q: int, bits: int = 50) -> Column:
    """base^exponent mod q for exponents below 2^bits, by the bits of the exponent."""
    m = F.lit(q).cast(WIDE)
    squares = [pow(base, 1 << i, q) for i in range(bits)]
    table = F.array(*[F.lit(s).cast(WIDE) for s in squares])
    factors = F.filter(F.transform(table, lambda s, i: F.when(F.call_function("shiftright", exponent, i.cast("int")).bitwiseAND(F.lit(1)) == 1, s)), lambda s: s.isNotNull())
    return F.aggregate(factors, F.lit(1).cast(PRODUCT), lambda acc, s: ((acc.cast(WIDE) * s).cast(PRODUCT) % m).cast(PRODUCT)).cast(WIDE)


def identity_holds(left: DataFrame, right: DataFrame, primes: list[int]) -> DataFrame:
    """num, prime, ok: whether residues agree, one row for each check."""
    both = left.alias("a").join(right.alias("b"), "num", "full")
    checks = F.array(*[F.struct(F.lit(str(q)).alias("prime"), F.coalesce(F.col(f"a.r{i}").cast(WIDE) == F.col(f"b.r{i}").cast(WIDE), F.lit(False)).alias("ok")) for i, q in enumerate(primes)])
    return both.select("num", F.explode(checks).alias("c")).select("num", "c.prime", "c.ok")


def series_mod(n_terms: int, spark, primes: list[int], partitions: int | None = None) -> DataFrame:
    """p, q mod each prime of the series sum 1/k! to n terms: the ordered fold of
    (P1, Q1) o (P2, Q2) = (P1 Q2 + P2, Q1 Q2) over ranges of terms.

    Rows: prime, p, q. Each range folds its terms on an executor; ranges, one
    row each, are joined in order.
    """
    parts = partitions or spark.sparkContext.defaultParallelism
    step = -(-n_terms // parts)
    ranges = spark.createDataFrame([(i, 1 + i * step, min(n_terms + 1, 1 + (i + 1) * step)) for i in range(parts) if 1 + i * step <= n_terms], "i int, a long, b long").repartition(parts, "i")

    def fold(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                for m in primes:
                    p, q = 0, 1
                    for k in range(r.a, r.b):  # (p, q) o (1, k)
                        p, q = (p * k + 1) % m, q * k % m
                    out.append((r.i, str(m), str(p), str(q)))
            yield pd.DataFrame(out, columns=["i", "prime", "p", "q"])

    rows = ranges.mapInPandas(fold, "i int, prime string, p string, q string")
    joined: dict[str, tuple[int, int]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["prime"], r["i"])):  # one row for each range and prime
        m, (p, q) = int(r["prime"]), joined.get(r["prime"], (0, 1))
        joined[r["prime"]] = ((p * int(r["q"]) + int(r["p"])) % m, q * int(r["q"]) % m)
    return spark.createDataFrame([(k, str(p), str(q)) for k, (p, q) in joined.items()], "prime string, p string, q string")
