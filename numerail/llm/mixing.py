"""Mixing sources to target weights by nested hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bounded_broadcast, stored

#: Weights of the sources in their order, over and over.
WEIGHTS = (5, 2, 1)
#: Bits of the document's hash, and bits that each histogram resolves.
HASH_BITS, LEVEL_BITS = 60, 12
#: Up to so many sources, counted at run time, their plan is broadcast.
MANY_SOURCES = 100_000


def words_of(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(doc_id: Column) -> Column:
    """The first 60 bits of the MD5 of the id as decimal text ('' for null)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, total_share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, target.

    The shares follow the weights 5, 2, 1 over the sources in code-point order
    (null last). A target stops at ``cap`` times its source's size and the rest
    is shared again by weight. That is min(cap * size, weight * level) at the
    level where the targets sum to ``total_share`` times all sizes: the capped
    sources are those with the smallest size per weight, found by running sums
    over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    per = per.withColumn("w", F.get(cycle, (F.row_number().over(order) - 1) % len(WEIGHTS)))
    per = per.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    rising = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("all", total_share * F.sum("source_size").over(whole))
        .withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("left_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        # the level if this source and all later ones are not capped; the first such one has the highest
        .withColumn("level", (F.col("all") - F.col("full")) / F.col("left_w"))
        .withColumn("open", F.col("level") <= F.col("ratio"))
        .withColumn("at", F.max(F.when(F.col("open"), F.col("level"))).over(whole))
    )
    target = F.when(F.col("at").isNull(), F.col("most")).otherwise(F.least("most", F.col("w") * F.col("at")))
    return per.select("source", "source_size", target.alias("target"))


def source_key(source: Column) -> Column:
    """A source's name that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def mix(docs: DataFrame, total_share: float = 1.5, cap: float = 2.0, keep: list[str] | None = None) -> DataFrame:
    """Rows doc_id, source, size, source_size, target, repeats for each row of
    docs, and a struct ``row`` of the columns ``keep`` if these are given.

    A source's whole passes come first (repeats of all its documents), then one
    partial pass: its documents in the order of a hash of doc_id, as long as
    this brings the taken words nearer to the target. The threshold hash is
    found without sorting: a histogram of words by source and the top 12 bits
    gives the bucket in which the budget ends, and only this bucket is refined
    by the next 12 bits, down to all 60. A source of size 0 takes none. Rows with equal ids share their hash
    and are taken together. Null ids hash as ''; null sources are one source;
    null or empty texts have size 0 and are taken like others; an empty table
    gives an empty result. Extra columns are ignored.
    """
    key = source_key(F.col("source"))
    base = stored(
        docs.select("doc_id", "source", key.alias("sk"), words_of(F.col("text")).alias("size"), hash60(F.col("doc_id")).alias("h")),
        "mix-sizes",
    )
    plan = source_targets(base, total_share, cap).withColumn("sk", key).drop("source")
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    plan = stored(plan.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    # of each source, hashes below `low` are taken, with `taken` words so far
    front = plan.select("sk", "budget", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("taken"))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = base.select("sk", "h", "size").join(bounded_broadcast(front, MANY_SOURCES), "sk")
        if shift + LEVEL_BITS < HASH_BITS:
            inside = inside.where(f"h >= low and h < low + {1 << (shift + LEVEL_BITS)}L")
        bucket = F.expr(f"low + shiftright(h - low, {shift}) * {1 << shift}L")
        histogram = inside.groupBy("sk", "budget", "low", "taken", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("sk").orderBy("bucket")
        histogram = histogram.withColumn("upto", F.col("taken") + F.sum("words").over(run)).withColumn("since", F.col("upto") - F.col("words"))
        # a bucket of many hashes fits whole or is refined; a single hash goes where it brings the sum nearer.
        # The whole source is never below its budget, so each source has a bucket to refine, also one without words
        fits = F.col("upto") < F.col("budget") if shift else F.col("since") + F.col("upto") < 2 * F.col("budget")
        after = histogram.groupBy("sk", "budget").agg(
            F.coalesce(F.min(F.when(~fits, F.col("bucket"))), F.max("bucket") + F.lit(1 << shift)).alias("low"),
            F.max(F.when(fits, F.col("upto")).otherwise(F.col("taken"))).alias("taken"),
        )
        front = stored(after, "mix-front")
    cuts = plan.drop("budget").join(front.select("sk", "low"), "sk")
    if keep is not None:  # the filter needs the id and source only, so it runs on the documents as they are
        more = F.struct(*keep, F.lit(0).alias("_")).alias("row")
        base = docs.select("doc_id", "source", key.alias("sk"), words_of(F.col("text")).alias("size"), hash60(F.col("doc_id")).alias("h"), more)
    out = base.join(bounded_broadcast(stored(cuts, "mix-cuts"), MANY_SOURCES), "sk")
    repeats = F.col("whole") + F.when(F.col("h") < F.col("low"), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), *(["row"] if keep is not None else []))


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


#: The same in DuckDB: documents of a source in hash order, with running sums instead of histograms.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w,
             2.0::DOUBLE * source_size AS most FROM s),
r AS (SELECT *, most / w AS ratio FROM w),
c AS (SELECT *, sum(most) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS filled,
             sum(w) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used_w,
             sum(w) OVER () AS all_w, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM r),
l AS (SELECT *, (total - coalesce(filled, 0)) / (all_w - coalesce(used_w, 0)) AS level FROM c),
t AS (SELECT source, source_size,
             least(most, w * max(CASE WHEN level <= ratio THEN level END) OVER ()) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS whole FROM t),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
u AS (SELECT source, h, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto, words FROM g)
SELECT d.doc_id, d.size, p.source_size, p.target,
       (d.size * (p.whole + CASE WHEN 2 * u.upto - u.words < 2 * (p.target - p.whole * p.source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
       JOIN u ON d.source IS NOT DISTINCT FROM u.source AND d.h = u.h
"""
