"""Digit strings of limb numbers: chunks, windows, comparison, block digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbers import DIGITS


def digit_chunks(df: DataFrame, digits: int, width: int) -> DataFrame:
    """num, chunk_no, text: the number's ``digits`` decimal places in chunks of ``width``, the most significant first.

    A limb's digits fall into at most a few chunks; each chunk joins its own
    pieces, so no task sees more than a chunk.
    """
    # place of the limb's first digit in the string (negative where it is padding)
    start = F.lit(digits) - (F.col("idx") + 1) * DIGITS
    limb = df.select("num", start.alias("at"), F.lpad(F.col("limb").cast("string"), DIGITS, "0").alias("t"))
    each = F.sequence(F.expr(f"greatest(at, 0) div {width}"), F.expr(f"(at + {DIGITS - 1}) div {width}"))
    cut = limb.where(f"at + {DIGITS} > 0 and at < {digits}").select("num", "at", "t", F.explode(each).alias("chunk_no"))
    low = F.greatest(F.col("chunk_no") * width, F.col("at"), F.lit(0))
    high = F.least((F.col("chunk_no") + 1) * width, F.col("at") + DIGITS)
    piece = F.substring("t", (low - F.col("at") + 1).cast("int"), (high - low).cast("int"))
    parts = cut.select("num", "chunk_no", low.alias("low"), piece.alias("piece"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", "piece"))), lambda s: s["piece"]), "")
    return parts.groupBy("num", "chunk_no").agg(text.alias("text"))


def write_digits(chunks: DataFrame, path: str, partitions: int) -> None:
    """Part files in order: chunk ranges follow one another by file number."""
    chunks.repartitionByRange(partitions, "chunk_no").sortWithinPartitions("chunk_no").write.parquet(path)


def compare_digits(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: first_difference (digit position in the first chunk that differs) and the verdict.

    identical; prefix, if one ends where the other goes on; else DIFFERS.
    Chunks must have one width.
    """
    both = a.select("chunk_no", F.col("text").alias("x")).join(b.select("chunk_no", F.col("text").alias("y")), "chunk_no", "full")
    odd = both.where("not (x <=> y)")
    n = F.least(F.length("x"), F.length("y"))
    same_start = F.coalesce(F.substring("x", F.lit(1), n) == F.substring("y", F.lit(1), n), F.lit(True))
    at = F.expr("array_position(zip_with(split(x, ''), split(y, ''), (p, q) -> p <=> q), false)")
    first = F.min(F.struct("chunk_no", (at - 1).alias("offset")))
    verdict = F.when(F.count(F.lit(1)) == 0, "identical").when(F.bool_and(same_start), "prefix").otherwise("DIFFERS")
    return odd.agg(verdict.alias("verdict"), first.alias("first_difference"))


def compare_run(run: DataFrame, reference: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: complete, verdict, first_difference of a run's digits against reference digits, in chunks of one width.

    The run's parts (part, nparts, lo, hi) must be whole and adjoin, else
    nothing is compared and the verdict is DIFFERS. A reference that goes on
    after the run's end is ``prefix``; a run that goes on after the reference's DIFFERS.
    """
    if not contiguous(parts).first()["ok"]:
        return run.sparkSession.createDataFrame([(False, "DIFFERS", None)], "complete boolean, verdict string, first_difference struct<chunk_no: bigint, offset: int>")
    length = lambda df, name: df.groupBy().agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias(name), F.lit(1).alias("_one"))
    sizes = length(run, "_mine").join(length(reference, "_theirs"), "_one")
    out = compare_digits(run, reference).withColumn("_one", F.lit(1)).join(F.broadcast(sizes), "_one")  # one row each
    verdict = F.when((F.col("verdict") == "prefix") & (F.col("_mine") > F.col("_theirs")), "DIFFERS").otherwise(F.col("verdict"))
    return out.select(F.lit(True).alias("complete"), verdict.alias("verdict"), F.col("first_difference").cast("struct<chunk_no: bigint, offset: int>").alias("first_difference"))


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """Known windows: lines ``offset digits``."""
    return spark.read.csv(path, schema="off long, w string", sep=" ")


def check_windows(chunks: DataFrame, windows: DataFrame, width: int, length: int = 50) -> DataFrame:
    """off, ok for each window of digits after the first: known digits against the chunks that it lies in.

    Windows meet their chunks by an equal join; one that straddles chunks is
    put together from its pieces. A window beyond the end is not checked (null).
    """
    spans = windows.select("off", "w", F.explode(F.sequence(F.expr(f"off div {width}"), F.expr(f"(off + {length - 1}) div {width}"))).alias("chunk_no"))
    met = spans.join(chunks.select("chunk_no", "text"), "chunk_no", "left")
    low = F.greatest(F.col("off") - F.col("chunk_no") * width, F.lit(0))
    high = F.least(F.col("off") + length - F.col("chunk_no") * width, F.lit(width))
    piece = F.substring("text", (low + 1).cast("int"), (high - low).cast("int"))
    got = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", piece.alias("p")))), lambda s: s["p"]), "")
    return met.groupBy("off", "w").agg(got.alias("got")).select("off", F.when(F.length("got") == length, F.col("got") == F.col("w")).alias("ok"))


def block_digests(chunks: DataFrame, per_block: int) -> DataFrame:
    """block, sha256 of runs of ``per_block`` chunks."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))), lambda s: s["text"]), "")
    return chunks.groupBy(F.expr(f"chunk_no div {per_block}").alias("block")).agg(F.sha2(text.cast("binary"), 256).alias("sha256"))


def contiguous(parts: DataFrame) -> DataFrame:
    """ok, n: whether parts (part, nparts, lo, hi) are 0 .. n - 1, once each, and
    each begins where the one before ends; parts meet the one before by a join."""
    before = parts.select((F.col("part") + 1).alias("part"), F.col("hi").alias("_end"))
    joined = parts.join(before, "part", "left").withColumn("_ok", F.when(F.col("part") == 0, F.col("lo") == 0).otherwise(F.coalesce(F.col("lo") == F.col("_end"), F.lit(False))))
    n = F.count(F.lit(1))
    whole = F.bool_and("_ok") & (F.min("part") == 0) & (F.max("part") == n - 1) & (F.count_distinct("part") == n) & (n == F.max("nparts"))
    return joined.agg(F.coalesce(whole, F.lit(False)).alias("ok"), n.alias("n"))
