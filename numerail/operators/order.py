"""Dense positions and prefix sums in a global order, without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a global order is cut into by default, as a multiple of the shuffle partitions.
RANGES = 4


def range_id(value: Column, bounds: list) -> Column:
    """Number of bounds below a value (nulls: -1), by two look-ups of a square root each."""
    if not bounds:
        return F.when(value.isNull(), -1).otherwise(0)
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(p[0]) for p in parts])
    coarse = F.greatest(F.size(F.filter(heads, lambda b: b < value)) - 1, F.lit(0))
    fine = F.array(*[F.array(*[F.lit(b) for b in p]) for p in parts])
    found = coarse * step + F.size(F.filter(F.get(fine, coarse), lambda b: b < value))
    return F.when(value.isNull(), -1).otherwise(found).cast("int")


def quantile_bounds(df: DataFrame, column: str, parts: int) -> list:
    """Cut points of a numeric column into ranges of about equal rows; ``parts`` numbers come to the driver."""
    if parts < 2:
        return []
    row = df.select(F.percentile_approx(column, [i / parts for i in range(1, parts)], 20 * parts).alias("b")).first()
    return sorted(set(row["b"] or []))


def indexed(df: DataFrame, order: list[str], name: str = "idx", parts: int | None = None) -> DataFrame:
    """Adds the position of each row, from 0, in the order of columns (the first one numeric).

    Rows are numbered within ranges of the first column; the sizes of the
    ranges, one row each, give where each starts.
    """
    spark = df.sparkSession
    parts = parts or RANGES * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    bounds = quantile_bounds(df, order[0], parts)
    ranged = df.withColumn("_range", range_id(F.col(order[0]), bounds))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", exclusive_prefix(F.col("_n"), [F.col("_range")]).alias("_start"))
    within = Window.partitionBy("_range").orderBy(*order)
    numbered = ranged.withColumn("_k", F.row_number().over(within) - 1)
    out = numbered.join(F.broadcast(starts), "_range")  # as many rows as ranges
    return out.withColumn(name, (F.col("_start") + F.col("_k")).cast("long")).drop("_range", "_k", "_start")


def indexed_within(df: DataFrame, key: list[str], order: list[str], name: str = "idx", parts: int | None = None) -> DataFrame:
    """Adds the position of each row among those of its key, from 0, in an order (its first column numeric or a timestamp).

    Rows are numbered within ranges of the first column, and how many rows of
    the key are in the ranges before, a row for each key and range, is added.
    So a key with very many rows is the work of as many tasks as there are ranges.
    """
    spark = df.sparkSession
    parts = parts or RANGES * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    first = F.unix_micros(F.col(order[0]).cast("timestamp")) if dict(df.dtypes)[order[0]].startswith("timestamp") else F.col(order[0])
    ranged = df.withColumn("_at", first)
    ranged = ranged.withColumn("_range", range_id(F.col("_at"), quantile_bounds(ranged, "_at", parts))).drop("_at")
    sizes = ranged.groupBy(*key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_range").alias("_r"), exclusive_prefix(F.col("_n"), [F.col("_range")], key).alias("_start"))
    within = Window.partitionBy(*key, "_range").orderBy(*order)
    numbered = ranged.withColumn("_k", F.row_number().over(within) - 1)
    same = (F.col("_range") == F.col("_r"))
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = numbered.join(starts, same).withColumn(name, (F.col("_start") + F.col("_k")).cast("long"))
    return out.select(*df.columns, name)


def exclusive_prefix(value: Column, order: list, by: list | None = None) -> Column:
    """Sum of the values before a row: a window column for small tables (one row per part)."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long")


def running_sums(df: DataFrame, value: str, key: str, chunk: int, name: str) -> DataFrame:
    """Adds the sum of all values before each row in the order of a dense key.

    Two tiers: within chunks of the key, and over the sums of chunks.
    """
    c = df.withColumn("_c", F.expr(f"{key} div {chunk}"))
    sums = c.groupBy("_c").agg(F.sum(value).alias("_s"))
    starts = sums.select("_c", exclusive_prefix(F.col("_s"), [F.col("_c")]).alias("_start"))
    w = Window.partitionBy("_c").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = c.withColumn("_in", F.coalesce(F.sum(value).over(w), F.lit(0))).join(starts, "_c")
    return out.withColumn(name, (F.col("_start") + F.col("_in")).cast("long")).drop("_c", "_in", "_start")
