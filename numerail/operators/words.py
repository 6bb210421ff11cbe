"""Division of limb numbers by one word: an ordered fold from the top limb down, scanned by runs of limbs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import BASE, normalized
from .storage import stored

#: Limbs of a run, and how often runs are made of runs; what is left above is folded by number.
RUN, TIERS = 256, 3
#: From here on products of two remainders need decimals; largest divisor whose products fit them.
WIDE_FROM, LARGEST = 3_037_000_499, 10**18


def _kind(divisor: int) -> str:
    return "bigint" if divisor < WIDE_FROM else "decimal(38,0)"


def _next(r: Column, x: Column, power: int, divisor: int) -> Column:
    """The remainder below a place whose value is x, where r is what comes from above."""
    kind = _kind(divisor)
    return ((r * F.lit(power).cast(kind) + x) % F.lit(divisor).cast(kind)).cast(kind)


def entering(df: DataFrame, divisor: int, power: int = BASE, tiers: int = TIERS) -> DataFrame:
    """num, idx, value, above: the remainder by the divisor of all that is above each place.

    Values are digits in a base whose remainder is ``power``. A run of places
    folds to its own remainder; what enters a run is found by the same scan over
    one row per run, whose base is that of the places to the run's length. So a
    task has a run at a time, and no row has more than a run, but on the last
    tier, where a number of 10^9 limbs has some 60 runs of runs of runs.
    """
    kind = _kind(divisor)
    power %= divisor
    run = F.expr(f"idx div {RUN}") if tiers else F.lit(0).cast("long")
    pairs = F.reverse(F.array_sort(F.collect_list(F.struct("idx", F.col("value").cast(kind).alias("value")))))
    runs = df.groupBy("num", run.alias("_run")).agg(pairs.alias("_v"))
    zero = F.lit(0).cast(kind)
    if tiers:
        runs = stored(runs, "runs") if tiers == TIERS else runs
        sums = runs.select("num", F.col("_run").alias("idx"), F.aggregate("_v", zero, lambda r, v: _next(r, v["value"], power, divisor)).alias("value"))
        over = entering(sums, divisor, pow(power, RUN, divisor), tiers - 1)
        runs = runs.join(over.select("num", F.col("idx").alias("_run"), F.col("above").alias("_above")), ["num", "_run"])
    else:
        runs = runs.withColumn("_above", zero)
    start = F.struct(F.col("_above").alias("r"), F.array().cast(f"array<{kind}>").alias("out"))
    folded = F.aggregate("_v", start, lambda a, v: F.struct(_next(a["r"], v["value"], power, divisor).alias("r"), F.array_append(a["out"], a["r"]).alias("out")))
    each = runs.select("num", F.inline(F.arrays_zip(F.col("_v").alias("v"), folded["out"].alias("above"))))
    return each.select("num", "v.idx", "v.value", "above")


def divided_by_word(df: DataFrame, divisor: int) -> tuple[DataFrame, DataFrame]:
    """Quotients (num, idx, limb) and remainders (num, remainder) of dense numbers by an integer of 1 to 10^18.

    A number has a row for each place up to its top, in any order. The quotient
    has no zero limbs above its highest other one; a number below the divisor
    has the quotient 0. An empty table gives two.
    """
    if not 1 <= divisor <= LARGEST:
        raise ValueError(f"a word is 1 to {LARGEST}")
    kind = _kind(divisor)
    rows = stored(entering(df.select("num", "idx", F.col("limb").alias("value")), divisor), "entering")
    part = F.col("above") * F.lit(BASE).cast(kind) + F.col("value")
    quotient = rows.select("num", "idx", part.alias("_part")).select("num", "idx", F.expr(f"_part div cast({divisor} as {kind})").cast("long").alias("limb"))
    rest = rows.where("idx = 0").select("num", (part % F.lit(divisor).cast(kind)).cast("long").alias("remainder"))
    return normalized(quotient), rest
