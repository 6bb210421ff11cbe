"""A long number as a versioned set of parts that Spark's committer writes.

Below a path of any file system that Spark writes to, ``v<n>/data`` has the
chunks of a PACKED number by part (part 0 is the top), and ``v<n>/header``,
written after them, says what they are: parts, chunks, residues of each part,
and the version that this one changes. A version without a whole header is not
there; so a task or job that is lost leaves nothing that is read. A correction
writes only the chunks that it changes, as a version of its own, and what was
written before stays readable. No part is ever in memory as a whole.

Writing may begin before a number is final: ``save_early`` writes its high part
as an early version while the low part is still being made, which is then a
correction. An early version is read only where it is asked for by its number.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import longnums as ln
from ..operators.division import chunks_of
from ..operators.numbers import CHUNK, DIGITS
from ..operators.residues import CHECK_PRIMES
from .sinks import Background

PRIMES = CHECK_PRIMES[:2]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def header(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The header of a version, or of the last whole one; None if there is none."""
    if version is not None:
        if not _exists(spark, f"{path}/v{version}/header/_SUCCESS"):
            return None
        return json.loads(spark.read.text(f"{path}/v{version}/header").first()["value"])
    last = 0
    while _exists(spark, f"{path}/v{last + 1}/header/_SUCCESS"):
        last += 1
    return header(spark, path, last) if last else None


def _part(chunk, chunks: int, nparts: int):
    """The part of a chunk: parts are runs of chunks of about equal length, the topmost first."""
    return (F.lit(nparts - 1) - F.floor(((chunk + 1) * nparts - 1) / chunks)).cast("int")


def part_residues(number: DataFrame) -> dict[str, list[str]]:
    """The residues of each part as a number, at its place (from num, chunk, data, part)."""
    named = number.select(F.col("part").cast("string").alias("num"), "chunk", "data")
    return {r["num"]: [str(r[f"r{i}"]) for i in range(len(PRIMES))] for r in ln.residues(named, list(PRIMES)).collect()}


def _write(spark: SparkSession, rows: DataFrame, path: str, about: dict) -> int:
    """Data first, then the header that makes it a version."""
    version = about["version"]
    rows.write.mode("overwrite").partitionBy("part").parquet(f"{path}/v{version}/data")
    written = spark.read.schema("num string, chunk long, data binary, top long, part int").parquet(f"{path}/v{version}/data")
    about["residues"] = {**about.get("residues", {}), **about.pop("of", part_residues)(written)}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/v{version}/header")
    return version


def save(number: DataFrame, path: str, nparts: int, final: bool = True) -> int:
    """Writes a PACKED number (one, stored) as a new version in parts; returns the version."""
    spark = number.sparkSession
    last = header(spark, path)
    chunks = (number.agg(F.max("chunk")).first()[0] or 0) + 1
    about = {"version": last["version"] + 1 if last else 1, "parent": None, "nparts": nparts, "chunks": chunks, "primes": [str(p) for p in PRIMES], "batch": None, "final": final}
    return _write(spark, number.withColumn("part", _part(F.col("chunk"), chunks, nparts)), path, about)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The number of a version (the last by default) with the part of each chunk: of every chunk the latest that a version up to it wrote."""
    h = header(spark, path, version)
    if h is None:
        raise FileNotFoundError(f"no whole version {version or ''} in {path}")
    if version is None and not h.get("final", True):
        raise FileNotFoundError(f"version {h['version']} in {path} is an early one")
    every, at = None, h
    while at is not None:
        rows = spark.read.schema("num string, chunk long, data binary, top long, part int").parquet(f"{path}/v{at['version']}/data").withColumn("_v", F.lit(at["version"]))
        every = rows if every is None else every.unionByName(rows)
        at = header(spark, path, at["parent"]) if at["parent"] else None
    latest = F.max_by(F.struct("data", "top", "part"), "_v")
    return every.groupBy("num", "chunk").agg(latest.alias("r")).select("num", "chunk", "r.data", "r.top", "r.part")


def damaged(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    """The parts whose residues are not those of the header."""
    h = header(spark, path, version)
    found = part_residues(read(spark, path, h["version"]))
    return sorted(int(p) for p in h["residues"] if found.get(p) != h["residues"][p])


def correct(spark: SparkSession, path: str, by: int | DataFrame, batch: int | None = None) -> int:
    """Adds a small integer, or a PACKED number of any length, to the last version, as a new version; returns that.

    Carries may run through any number of parts; only the chunks that change
    are written, and only the parts that have them get new residues. ``batch``
    is the number of a stream's batch: one that was applied is not applied again.
    """
    h = header(spark, path)
    if batch is not None and h["batch"] is not None and batch <= h["batch"]:
        return h["version"]
    old = read(spark, path, h["version"])
    num = old.first()["num"]
    if isinstance(by, DataFrame):
        term, sign = by.select(F.lit(num).alias("num"), "chunk", "data", "top"), 1
    else:
        term, sign = spark.createDataFrame(list(chunks_of(num, abs(by))), ln.PACKED), 1 if by >= 0 else -1
    new = ln.carried(ln.as_pieces(old).unionByName(ln.as_pieces(term, sign)), difference=sign < 0)
    if (new.agg(F.max("top")).first()[0] or 0) >= h["chunks"] * CHUNK:
        raise ValueError("the corrected number is longer than its parts")
    before = old.select("num", "chunk", F.col("data").alias("was"))
    changed = new.join(before, ["num", "chunk"], "left").where(~F.col("data").eqNullSafe(F.col("was"))).drop("was")
    changed = ln.stored(changed.withColumn("part", _part(F.col("chunk"), h["chunks"], h["nparts"])), "changed")
    touched = [r["part"] for r in changed.select("part").distinct().collect()]
    rest = old.where(F.col("part").isin(touched)).join(changed.select("num", "chunk"), ["num", "chunk"], "left_anti")
    about = {**h, "version": h["version"] + 1, "parent": h["version"], "batch": h["batch"] if batch is None else batch, "final": True}
    about["of"] = lambda written: part_residues(written.unionByName(rest.select(written.columns)))
    return _write(spark, changed, path, about)


def save_early(high: DataFrame, low: Callable[[], DataFrame], path: str, nparts: int) -> int:
    """Writes high + low(), beginning with ``high`` while ``low`` still runs; returns the version that is final.

    ``high`` is a PACKED number (one, stored) whose parts are long enough for the
    sum; ``low`` makes a PACKED number, stored. Its carries run up through the
    parts, and only chunks that they change are written again. If either fails,
    what is there is an early version or none, and the error is raised.
    """
    spark = high.sparkSession
    jobs = Background(spark)
    jobs.start(lambda: save(high, path, nparts, final=False))
    try:
        term = low()
    finally:
        jobs.join()
    return correct(spark, path, term)


def follow(corrections: DataFrame, path: str, checkpoint: str):
    """Applies a stream of corrections (a column ``by``) to the number: each batch that changes it is a version."""

    def apply(batch: DataFrame, number: int) -> None:
        by = batch.agg(F.sum(F.col("by").cast("decimal(38,0)"))).first()[0]
        if by:
            correct(batch.sparkSession, path, int(by), number)

    return corrections.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def digits(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """part, chunk, text: the digits of each chunk, 6 a limb, the top one without leading zeros; in the order of chunk, the highest first."""
    number = read(spark, path, version)
    top = number.agg(F.greatest(F.max("top"), F.lit(0))).first()[0]
    grid = number.where(F.col("chunk") <= top // CHUNK).select("part", "chunk", "data")

    def rows_of(batches):
        import numpy as np

        for part, chunk, data in ln._rows(batches, ["part", "chunk", "data"]):
            limbs = np.frombuffer(data, dtype=np.uint32)[: top - chunk * CHUNK + 1][::-1]
            table = (limbs[:, None] // 10 ** np.arange(DIGITS - 1, -1, -1) % 10 + ord("0")).astype(np.uint8)
            text = table.tobytes().decode()
            yield part, chunk, (text.lstrip("0") or "0") if chunk == top // CHUNK else text

    return ln._mapped(grid, rows_of, "part int, chunk long, text string")
