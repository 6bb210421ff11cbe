"""Numbers as DataFrames of limbs: (num, idx, limb), base 10^6, least significant first.

A number is dense: every position from 0 to its top has a row. All operators
take and give such frames; many numbers are processed at once, by ``num``.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASE, DIGITS = 10**6, 6
#: Limbs of a chunk of the carry scan; each tier divides the rows by so many.
CHUNK = 4096
#: Rounds of a fold; a sum of limbs needs a few.
FOLDS = 64
#: Rows of a batch from Python.
LIMB_ROWS = 1 << 16
SCHEMA = "num string, idx long, limb long"


def limbs_of(value: int) -> list[int]:
    """Limbs of a non-negative integer; zero has one."""
    out = []
    while value or not out:
        value, low = divmod(value, BASE)
        out.append(low)
    return out


def from_ints(spark: SparkSession, numbers: dict[str, int]) -> DataFrame:
    """Imports small numbers from the driver."""
    return spark.createDataFrame([(k, i, x) for k, v in numbers.items() for i, x in enumerate(limbs_of(v))], SCHEMA)


def to_ints(df: DataFrame) -> dict[str, int]:
    """Exports small numbers to the driver (positions without a row count as 0)."""
    out: dict[str, int] = {}
    for r in df.collect():
        out[r["num"]] = out.get(r["num"], 0) + r["limb"] * BASE ** r["idx"]
    return out


def digits_to_limbs(text: bytes) -> np.ndarray:
    """The limbs of a decimal text, least significant first, in time linear in its length."""
    digits = np.frombuffer(text.rjust(-(-max(1, len(text)) // DIGITS) * DIGITS, b"0"), dtype=np.uint8).astype(np.int64) - ord("0")
    if digits.min() < 0 or digits.max() > 9:
        raise ValueError("a decimal text has other letters than digits")
    return (digits.reshape(-1, DIGITS) @ 10 ** np.arange(DIGITS - 1, -1, -1))[::-1]


def from_digits(df: DataFrame, text: str = "digits") -> DataFrame:
    """Numbers from decimal strings (num, digits); leading zeros are kept as limbs, an empty text is 0, null has no rows."""

    def run(batches):
        for b in batches:
            for num, digits in zip(b.column("num").to_pylist(), b.column("digits").to_pylist(), strict=True):
                limbs = digits_to_limbs(digits.encode())
                for at in range(0, len(limbs), LIMB_ROWS):
                    part = limbs[at : at + LIMB_ROWS]
                    names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(part), dtype=np.int32)), pa.array([num], pa.string())).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([names, pa.array(np.arange(at, at + len(part))), pa.array(part)], ["num", "idx", "limb"])

    return df.select("num", F.col(text).alias("digits")).where("digits is not null").mapInArrow(run, SCHEMA)


def regrouped(df: DataFrame, have: int, want: int, value: str = "limb") -> DataFrame:
    """Units of ``have`` digits, least significant first, as units of ``want``: (num, idx, value), decimals.

    The lengths need no common divisor: a unit is cut where units of the other
    kind end, which repeats with their least common multiple, and the cuts that
    fall into one new unit are joined. So a value meets only its neighbours.
    """
    if not 0 < want <= 38 or not 0 < have <= 38:
        raise ValueError("units have 1 to 38 digits")
    low, high = F.col("idx") * have, (F.col("idx") + 1) * have
    text = F.lpad(F.col(value).cast("string"), have, "0")
    cut = df.select("num", low.alias("_low"), high.alias("_high"), text.alias("_t"), F.explode(F.sequence(F.expr(f"idx * {have} div {want}"), F.expr(f"((idx + 1) * {have} - 1) div {want}"))).alias("_to"))
    start, end = F.greatest(F.col("_to") * want, F.col("_low")), F.least((F.col("_to") + 1) * want, F.col("_high"))
    piece = F.substring("_t", (F.col("_high") - end + 1).cast("int"), (end - start).cast("int"))
    joined = cut.select("num", F.col("_to").alias("idx"), F.struct(start.alias("at"), piece.alias("t")).alias("p")).groupBy("num", "idx").agg(F.reverse(F.array_sort(F.collect_list("p"))).alias("p"))
    return joined.select("num", F.col("idx").cast("long").alias("idx"), F.array_join(F.transform("p", lambda s: s["t"]), "").cast("decimal(38,0)").alias("value"))


def constant(spark: SparkSession, num: str, n: int, limb: int = 0) -> DataFrame:
    """A number of n equal limbs, generated on the executors."""
    return spark.range(n).select(F.lit(num).alias("num"), F.col("id").alias("idx"), F.lit(limb).cast("long").alias("limb"))


def power(spark: SparkSession, num: str, k: int) -> DataFrame:
    """base^k."""
    return spark.range(k + 1).select(F.lit(num).alias("num"), F.col("id").alias("idx"), F.when(F.col("id") == k, 1).otherwise(0).cast("long").alias("limb"))


def positions(tops: DataFrame) -> DataFrame:
    """num, idx: all positions 0 .. top of numbers given as (num, top).

    A row for each chunk of positions is dealt to a task of its own, which
    makes them; so no row or task holds the positions of a whole long number.
    """
    n = int(tops.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    chunks = tops.where("top >= 0").select("num", "top", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"top div {CHUNK}"))).alias("_c")).repartition(n, "num", "_c")
    first = F.col("_c") * CHUNK
    return chunks.select("num", F.explode(F.sequence(first, F.least(first + CHUNK - 1, F.col("top")))).alias("idx"))


def shifted(df: DataFrame, by: int) -> DataFrame:
    """Times base^by; negative: the whole part of the quotient. The low limbs of a left shift are zero rows."""
    if by <= 0:
        return df.select("num", (F.col("idx") + by).alias("idx"), "limb").where("idx >= 0")
    up = df.select("num", (F.col("idx") + by).alias("idx"), "limb")
    low = positions(df.select("num").distinct().withColumn("top", F.lit(by - 1).cast("long")))
    return up.unionByName(low.withColumn("limb", F.lit(0).cast("long")))


def view(df: DataFrame, low: int, count: int) -> DataFrame:
    """Limbs low .. low + count - 1 as a number of their own; nothing is copied."""
    return df.where(F.col("idx").between(low, low + count - 1)).select("num", (F.col("idx") - low).alias("idx"), "limb")


def normalized(df: DataFrame) -> DataFrame:
    """Without zero limbs above the highest other one; zero keeps one limb."""
    top = df.groupBy("num").agg(F.coalesce(F.max(F.when(F.col("limb") != 0, F.col("idx"))), F.lit(0)).alias("_top"))
    return df.join(top, "num").where("idx <= _top").select("num", "idx", "limb")


def filled(df: DataFrame, extra: int = 0) -> DataFrame:
    """Zero rows for positions without one, and ``extra`` more above the top."""
    every = positions(df.groupBy("num").agg((F.max("idx") + extra).alias("top")))
    return every.join(df, ["num", "idx"], "left").select("num", "idx", F.coalesce("limb", F.lit(0)).alias("limb"))


def limb_at(df: DataFrame, idx: int) -> DataFrame:
    return df.where(F.col("idx") == idx)


def with_limb(df: DataFrame, idx: int, value: int) -> DataFrame:
    return df.withColumn("limb", F.when(F.col("idx") == idx, F.lit(value).cast("long")).otherwise(F.col("limb")))


def any_below(df: DataFrame, idx: int) -> DataFrame:
    """num, found: whether a limb below a position is not zero."""
    return df.groupBy("num").agg(F.coalesce(F.bool_or((F.col("limb") != 0) & (F.col("idx") < idx)), F.lit(False)).alias("found"))


def incoming(df: DataFrame, flag: str, keys: list[str], tiers: int = 3, name: str = "cin") -> DataFrame:
    """What each position receives, where ``flag`` is what it sends up whatever
    it gets, and null where it hands on what it gets; the lowest gets 0.

    A scan over chunks: inside a chunk, the last flag below; for positions with
    none, what the chunk receives, found by the same scan over one row per
    chunk. So no task holds more than a chunk, or the rows of the last tier.
    """
    if tiers == 1:
        w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.last(flag, ignorenulls=True).over(w), F.lit(0)))
    chunk, inner, outer = f"_chunk{tiers}", f"_in{tiers}", f"_from{tiers}"
    cut = df.withColumn(chunk, F.expr(f"idx div {CHUNK}"))
    w = Window.partitionBy(*keys, chunk).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumn(inner, F.last(flag, ignorenulls=True).over(w))
    # the last flag of a chunk that does not hand on
    sums = cut.groupBy(*keys, chunk).agg(F.max_by(flag, F.when(F.col(flag).isNotNull(), F.col("idx"))).alias(flag))
    chunks = incoming(sums.withColumnRenamed(chunk, "idx"), flag, keys, tiers - 1, outer)
    out = inside.join(chunks.select(*keys, F.col("idx").alias(chunk), outer), [*keys, chunk])
    return out.withColumn(name, F.coalesce(inner, outer)).drop(chunk, inner, outer)


def carried(df: DataFrame, rounds: int = 2) -> DataFrame:
    """Limbs from sums: any non-negative values per position become limbs below the base.

    Two rounds split each value over the positions above (map-side combined),
    which leaves at most one to carry; the rest is the carry scan. Sums of two
    limbs have at most one to carry as they are, those of up to a million after
    one round.
    """
    for _ in range(rounds):
        parts = F.array(*[F.struct((F.col("idx") + k).alias("idx"), F.expr(f"(limb div {BASE**k}L) % {BASE}L").alias("limb")) for k in range(4)])
        parts = F.filter(parts, lambda p: (p["limb"] != 0) | (p["idx"] == F.col("idx")))
        df = df.select("num", F.explode(parts).alias("p")).select("num", "p.idx", "p.limb").groupBy("num", "idx").agg(F.sum("limb").alias("limb"))
    full = filled(df, 1)
    flag = F.when(F.col("limb") >= BASE, 1).when(F.col("limb") < BASE - 1, 0)
    scanned = incoming(full.withColumn("flag", flag), "flag", ["num"])
    return normalized(scanned.select("num", "idx", ((F.col("limb") + F.col("cin")) % BASE).alias("limb")))


def added(*numbers: DataFrame) -> DataFrame:
    """Sum of numbers of the same name."""
    return carried(_summed(numbers), rounds=0 if len(numbers) <= 2 else 1)


def _summed(numbers: Iterable[DataFrame]) -> DataFrame:
    frames = [n.select("num", "idx", "limb") for n in numbers]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.groupBy("num", "idx").agg(F.sum("limb").alias("limb"))


def subtracted(a: DataFrame, b: DataFrame) -> DataFrame:
    """a - b for a >= b: aligned differences, then a scan of borrows."""
    diff = _summed([a, b.withColumn("limb", -F.col("limb"))])
    flag = F.when(F.col("limb") < 0, -1).when(F.col("limb") > 0, 0)
    scanned = incoming(filled(diff).withColumn("flag", flag), "flag", ["num"])
    return normalized(scanned.select("num", "idx", F.pmod(F.col("limb") + F.col("cin"), F.lit(BASE)).alias("limb")))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """num, cmp: -1, 0 or 1; the highest position that differs decides."""
    both = a.select("num", "idx", F.col("limb").alias("x")).join(b.select("num", "idx", F.col("limb").alias("y")), ["num", "idx"], "full")
    sign = F.signum(F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0))).cast("int")
    top = F.max_by(sign, F.when(sign != 0, F.col("idx")))
    return both.groupBy("num").agg(F.coalesce(top, F.lit(0)).alias("cmp"))


def complement(df: DataFrame, e: int) -> DataFrame:
    """base^e - number (of at most e limbs)."""
    one = positions(df.select("num").distinct().withColumn("top", F.lit(e).cast("long")))
    return subtracted(one.withColumn("limb", F.when(F.col("idx") == e, 1).otherwise(0).cast("long")), df)


def plus_small(df: DataFrame, value: int, at: int = 0) -> DataFrame:
    """Adds a small signed integer at a position."""
    term = df.select("num").distinct()
    rows = F.array(*[F.struct(F.lit(at + i).cast("long").alias("idx"), F.lit(x).cast("long").alias("limb")) for i, x in enumerate(limbs_of(abs(value)))])
    term = term.select("num", F.explode(rows).alias("p")).select("num", "p.idx", "p.limb")
    return added(df, term) if value >= 0 else subtracted(df, term)


def times_small(df: DataFrame, factor: int) -> DataFrame:
    """Times an integer below 10^12."""
    return carried(df.select("num", "idx", (F.col("limb") * factor).alias("limb")))


def folded(df: DataFrame, p: int) -> DataFrame:
    """The number modulo base^p - 1: positions modulo p are added, until nothing is above."""
    from .storage import stored

    for _ in range(FOLDS):
        # the carries read their input several times, what is folded is made once
        sums = stored(df.groupBy("num", (F.col("idx") % p).alias("idx")).agg(F.sum("limb").alias("limb")), "fold")
        df = stored(carried(sums), "folded")
        if not df.where(F.col("idx") >= p).take(1):
            break
    else:
        raise ArithmeticError(f"a fold to {p} limbs does not end after {FOLDS} rounds")
    full = df.groupBy("num").agg(F.min("limb").alias("least"), F.count(F.lit(1)).alias("n"))
    is_zero = (F.col("least") == BASE - 1) & (F.col("n") == p)  # base^p - 1 itself is 0
    return normalized(df.join(full, "num").select("num", "idx", F.when(is_zero, 0).otherwise(F.col("limb")).alias("limb")))


def _alternating(plus: bool) -> Column:
    q = BASE + 1 if plus else BASE - 1
    signed: Column = F.when(F.col("idx") % 2 == 1, -F.col("limb")).otherwise(F.col("limb")) if plus else F.col("limb")
    return F.pmod(F.sum(signed), F.lit(q))


def alternating_mod(df: DataFrame, plus: bool) -> DataFrame:
    """num, r: the number modulo base + 1 (alternating sum) or base - 1 (plain sum)."""
    return df.groupBy("num").agg(_alternating(plus).alias("r"))


def alternating_mods(df: DataFrame) -> DataFrame:
    """num, plus, minus: both residues in one pass."""
    return df.groupBy("num").agg(_alternating(True).alias("plus"), _alternating(False).alias("minus"))
