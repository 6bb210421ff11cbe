"""Analytics over run logs and measurements: metrics, medians, outliers, pairs, islands, overlaps."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import indexed, indexed_within
from .storage import partitions, stored

#: Two-sided 95 % points of Student's t for 1 to 10 degrees of freedom (fixed values); 1.96 beyond.
T95 = (12.71, 4.30, 3.18, 2.78, 2.57, 2.45, 2.36, 2.31, 2.26, 2.23)


#: Values of a key whose median comes from one buffer.
SMALL_GROUP = 100_000
#: Entries of a table that points are interpolated in.
MOST_ENTRIES = 100_000


def first_or_max(df: DataFrame, key: list[str], value: str, order: str, max_when: Column) -> DataFrame:
    """One value per key: the first in an order, but the largest for keys where ``max_when`` holds."""
    known = F.col(value).isNotNull()
    first = F.min_by(value, F.struct(order, value))
    return df.groupBy(*key).agg(F.when(F.bool_or(max_when), F.max(F.when(known, F.col(value)))).otherwise(first).alias("value"))


def verdict(df: DataFrame, key: list[str], ok: Column, failed: Column, all_ok: Column, single: Column) -> DataFrame:
    """FAIL if anything failed; OK if the whole says so, or one of a single node does; else NONE."""
    n_ok, n_failed = F.count_if(ok), F.count_if(failed)
    said = F.when(n_failed > 0, "FAIL").when(F.bool_or(all_ok), "OK").when(F.bool_or(single) & (n_ok > 0), "OK").otherwise("NONE")
    return df.groupBy(*key).agg(n_ok.alias("n_ok"), n_failed.alias("n_failed"), said.alias("verdict"))


def fingerprint(df: DataFrame, key: list[str], line: Column, letters: int = 16) -> DataFrame:
    """Digest of the sorted distinct lines of each key, whatever their order.

    The digest is made while the lines stream by in order, so a key's lines are
    never in memory together. Keys without a line but null are left out.
    """
    lines = df.select(*key, line.alias("_line")).where("_line is not null").distinct()
    spark = df.sparkSession
    sorted_ = lines.withColumn("_key", F.to_json(F.struct(*key), {"ignoreNullFields": "false"})).repartition(partitions(spark), "_key").sortWithinPartitions("_key", "_line")

    def run(batches):
        now, digest, n = None, None, 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()[:letters]]), pa.array([n], pa.int64())], ["_key", "fingerprint", "n_lines"])

        for b in batches:
            for k, text in zip(b.column("_key").to_pylist(), b.column("_line").to_pylist(), strict=True):
                if k != now:
                    if digest is not None:
                        yield done()
                    now, digest, n = k, hashlib.sha256(), 0
                digest.update(("\n" if n else "").encode() + text.encode("utf-8", "surrogatepass"))
                n += 1
        if digest is not None:
            yield done()

    out = sorted_.select("_key", "_line").mapInArrow(run, "_key string, fingerprint string, n_lines long")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*key).schema)
    return out.select(F.from_json("_key", kinds).alias("_k"), "fingerprint", "n_lines").select(*[F.col("_k").getField(k).alias(k) for k in key], "fingerprint", "n_lines")


def rollup_max(df: DataFrame, mapping: DataFrame, on: str, to: str, values: list[str]) -> DataFrame:
    """Largest values per parent of each row's key; keys without a parent keep their own name."""
    named = df.join(mapping, on, "left").withColumn("_to", F.coalesce(to, on))
    return named.groupBy(F.col("_to").alias(to)).agg(*[F.max(v).alias(v) for v in values])


def medians(df: DataFrame, key: list[str], value: str, small: int = SMALL_GROUP, buckets: int = 1024) -> DataFrame:
    """key, median: exact medians of finite values, in bounded memory whatever a key has.

    Keys of up to ``small`` values are aggregated as they are. Of others the
    ranks in the middle are narrowed down: counts in equal parts between a
    key's least and largest value tell in which part a rank lies, whose own
    least and largest value bound the next round, until a part has one value or
    up to ``small`` of them. Counts are combined before they are shuffled.
    """
    known = df.where(F.col(value).isNotNull()).select(*key, F.col(value).cast("double").alias("_v"))
    sizes = known.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    many = stored(sizes.where(F.col("_n") > small), "large-keys")
    if not many.take(1):
        return known.groupBy(*key).agg(F.median("_v").alias("median"))
    few = known.join(many.select(*key), key, "left_anti").groupBy(*key).agg(F.median("_v").alias("median"))
    ranks = F.explode(F.array_distinct(F.array(F.expr("(_n - 1) div 2"), F.expr("_n div 2"))))
    now = many.select(*key, ranks.alias("_rank"), F.lit(0).cast("long").alias("_below"), "_lo", "_hi", F.col("_n").alias("_m"))
    span = [*key, "_lo", "_hi"]
    inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    is_open = (F.col("_lo") < F.col("_hi")) & (F.col("_m") > small)
    while True:
        now = stored(now, "ranks")
        going = now.where(is_open)
        if not going.take(1):
            break
        part = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets), F.lit(buckets - 1))
        counted = known.join(going.select(*span).distinct(), key).where(inside).groupBy(*span, part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_l"), F.max("_v").alias("_h"))
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(*span).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = going.join(counted.withColumn("_before", before), span).where((F.col("_rank") >= F.col("_below") + F.col("_before")) & (F.col("_rank") < F.col("_below") + F.col("_before") + F.col("_c")))
        now = placed.select(*key, "_rank", (F.col("_below") + F.col("_before")).alias("_below"), F.col("_l").alias("_lo"), F.col("_h").alias("_hi"), F.col("_c").alias("_m")).unionByName(now.where(~is_open))
    one = now.where("_lo = _hi").select(*key, F.col("_lo").alias("_v"))
    last = known.join(now.where("_lo < _hi"), key).where(inside).groupBy(*key, "_rank", "_below").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    found = one.unionByName(last.select(*key, F.get("_all", (F.col("_rank") - F.col("_below")).cast("int")).alias("_v")))
    return few.unionByName(found.groupBy(*key).agg(F.avg("_v").alias("median")))


def median_and_worst(df: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """Median of a metric, its maximum, and who has it (the last name among equals)."""
    worst = df.groupBy(*key).agg(F.max(value).alias("worst"), F.max(F.when(F.col(value).isNotNull(), F.struct(value, name)))[name].alias("who"))
    return worst.join(medians(df, key, value), key, "left").select(*key, "median", "worst", "who")


def outliers(df: DataFrame, key: list[str], value: str, ratio: float, excess: float, least: int = 2, strict_excess: bool = False, least_for_median: int = 3) -> DataFrame:
    """Rows far above their key's reference: over ratio * reference and by ``excess``.

    Needs ``least`` values. The references, a row per key, are aggregated first
    and joined, so no key's rows are gathered.
    """
    refs = df.groupBy(*key).agg(F.min(value).alias("least"), F.count(value).alias("n")).join(medians(df, key, value), key)
    refs = refs.select(*key, F.when(F.col("n") >= least_for_median, F.col("median")).otherwise(F.col("least")).alias("ref"), "n")  # few values have no median
    far = F.col(value) - F.col("ref") > excess if strict_excess else F.col(value) - F.col("ref") >= excess
    return df.join(refs, key).where((F.col("n") >= least) & (F.col(value) > ratio * F.col("ref")) & far)


def first_lines(df: DataFrame, key: list[str], order: str, text: str, count: int = 2, width: int = 160) -> DataFrame:
    """The first lines of each key, cut to a width: the rule of a report. The rank
    limits rows before they are shuffled too, so no key's lines are gathered."""
    k = F.row_number().over(Window.partitionBy(*key).orderBy(order, text))
    return df.withColumn("_k", k).where(F.col("_k") <= count).select(*key, order, F.substring(text, 1, width).alias(text))


def summary_by_arm(df: DataFrame, arm: str, value: str, counts: Column) -> DataFrame:
    """n, mean, sample standard deviation (0 for one value) of the counted runs; bad is the number of others."""
    good = F.when(counts, F.col(value))
    return df.groupBy(arm).agg(F.count(good).alias("n"), F.avg(good).alias("mean"), F.coalesce(F.stddev_samp(good), F.lit(0.0)).alias("sd"), F.count_if(~F.coalesce(counts, F.lit(False)) | F.col(value).isNull()).alias("bad"))


def paired_difference(df: DataFrame, arm: str, base: str, order: list[str], value: str, counts: Column) -> DataFrame:
    """Mean difference of the k-th counted runs of each arm and of the base, with a 95 % interval.

    Rows: arm, pairs, diff, pct (of the base's mean over the pairs), ci95 (null for one pair).
    """
    good = df.where(counts & F.col(value).isNotNull())
    runs = indexed_within(good, [arm], order, "k").select(arm, F.col(value).alias("v"), "k")
    b = runs.where(F.col(arm) == base).select(F.col("v").alias("b"), "k")
    pairs = runs.where(F.col(arm) != base).join(b, "k").withColumn("d", F.col("v") - F.col("b"))
    points = F.array(*[F.lit(t) for t in T95])
    n = F.count(F.lit(1))
    t = F.coalesce(F.get(points, F.col("pairs").cast("int") - 2), F.lit(1.96))
    sums = pairs.groupBy(arm).agg(n.alias("pairs"), F.avg("d").alias("diff"), F.avg("b").alias("base_mean"), F.stddev_samp("d").alias("sd"))
    pct = F.when(F.col("base_mean") != 0, 100 * F.col("diff") / F.col("base_mean")).otherwise(0.0)
    ci = F.when(F.col("pairs") > 1, t * F.col("sd") / F.sqrt("pairs"))
    return sums.select(arm, "pairs", "diff", pct.alias("pct"), ci.alias("ci95"))


def zipped_columns(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Each column (of numbers) sorted on its own and put side by side: row, and the metrics."""
    out = None
    for m in metrics:
        one = indexed(df.where(F.col(m).isNotNull()).select(m), [m], "row").select((F.col("row") + 1).cast("int").alias("row"), m)
        out = one if out is None else out.join(one, "row", "full")
    return out


def islands(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Run-length encoding in an order: key, island, value, first and last of the order's first column, length."""
    w = Window.partitionBy(*key).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*key, "island", value).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("length"))


def spanning_sets(df: DataFrame, position: str, group: str, sizes: list[int]) -> DataFrame:
    """Aligned sets of positions that fall into several groups: size, set_no, groups. One pass over all sizes."""
    each = F.array(*[F.struct(F.lit(s).alias("size"), F.expr(f"{position} div {s}").alias("set_no")) for s in sizes])
    sets = df.select(F.explode(each).alias("s"), group).groupBy("s.size", "s.set_no").agg(F.count_distinct(group).alias("groups"))
    return sets.where("groups > 1")


def overlaps(df: DataFrame, key: list[str], row_id: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs of half-open intervals of one key that overlap: key, a, b (a < b).

    Intervals are cut at multiples of ``width``; only those of one cell meet,
    and a pair is told where the later one starts. Cells of the typical length
    keep both the copies and the comparisons in proportion to the input and the result.
    """
    cells = F.sequence(F.expr(f"{start} div {width}"), F.expr(f"({end} - 1) div {width}"))
    cut = df.where(F.col(end) > F.col(start)).select(*key, F.col(row_id).alias("_id"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.explode(cells).alias("_cell"))
    x, y = cut.alias("x"), cut.alias("y")
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in [*key, "_cell"]] + [F.col("x._id") < F.col("y._id"), F.col("x._s") < F.col("y._e"), F.col("y._s") < F.col("x._e")]
    met = x.join(y, on).where(F.expr(f"greatest(x._s, y._s) div {width} = x._cell"))
    return met.select(*[F.col(f"x.{k}").alias(k) for k in key], F.col("x._id").alias("a"), F.col("y._id").alias("b"))


def neighbours(table: DataFrame, x: str, y: str, points: DataFrame, at: str) -> DataFrame:
    """Log-log interpolation of a small table at points, by the nearest entries at
    and around each. The table is counted, and broadcast as one row; it raises
    beyond MOST_ENTRIES.

    An entry at the point itself gives its value; outside the range, the
    nearest two entries give the line (one entry: its value).
    """
    if table.limit(MOST_ENTRIES + 1).count() > MOST_ENTRIES:
        raise ValueError(f"a table to interpolate has at most {MOST_ENTRIES} entries")
    entries = F.broadcast(table.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("t")))
    p = F.col(at).cast("double")
    n = F.size("t")
    above = F.size(F.filter("t", lambda e: e["x"] < p))
    exact = F.get(F.filter("t", lambda e: e["x"] == p), F.lit(0))["y"]
    hi = F.least(F.greatest(above, F.lit(1)), n - 1)
    a, b = F.get("t", hi - 1), F.get("t", hi)
    line = F.exp(F.log(a["y"]) + (F.log(p) - F.log(a["x"])) / (F.log(b["x"]) - F.log(a["x"])) * (F.log(b["y"]) - F.log(a["y"])))
    value = F.when(exact.isNotNull(), exact).when(n == 1, F.get("t", F.lit(0))["y"]).otherwise(line)
    return points.crossJoin(entries).withColumn("value", value).drop("t")


def wilson(n: Column, failures: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a proportion; (0, 1) without runs."""
    p = failures / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, middle - half).otherwise(0.0), F.when(n > 0, middle + half).otherwise(1.0)


def drift(code: DataFrame, registry: DataFrame, name: str, value: str) -> DataFrame:
    """name, kind: MISSING in the registry, STALE in it, or DIFFERS in value."""
    c = code.select(name, F.col(value).alias("_c"), F.lit(True).alias("_in_c"))
    r = registry.select(name, F.col(value).alias("_r"), F.lit(True).alias("_in_r"))
    both = c.join(r, name, "full")
    kind = F.when(F.col("_in_r").isNull(), "MISSING").when(F.col("_in_c").isNull(), "STALE").when(~F.col("_c").eqNullSafe(F.col("_r")), "DIFFERS")
    return both.select(name, kind.alias("kind")).where("kind is not null")


def precedence(levels: list[tuple[str, Column]], name: str = "value") -> list[Column]:
    """The first value there is, and the label of the level that has it."""
    origin = F.lit(None).cast("string")
    for label, c in reversed(levels):
        origin = F.when(c.isNotNull(), label).otherwise(origin)
    return [F.coalesce(*[c for _, c in levels]).alias(name), origin.alias("origin")]


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The last value of each key."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def gate(*conditions: Column) -> Column:
    """PASS when all conditions hold (null does not)."""
    return F.when(F.forall(F.array(*[F.coalesce(c, F.lit(False)) for c in conditions]), lambda c: c), "PASS").otherwise("FAIL")
