"""Small sinks and sources beside the digit files: tables for people, sidecars, background writes, rates, memory facts."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def write_table(df: DataFrame, path: str, order: list[str]) -> None:
    """Tab-separated files with a header, in an order: ranges follow one another by file number."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_sidecar(spark: SparkSession, path: str, facts: dict) -> None:
    """One row of JSON beside a number's files: sizes, residues and the last digits."""
    row = {k: ",".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v) for k, v in facts.items()}
    spark.createDataFrame([row], ", ".join(f"`{k}` string" for k in row)).coalesce(1).write.mode("overwrite").json(path)


def read_sidecar(spark: SparkSession, path: str) -> dict[str, str]:
    return spark.read.json(path).first().asDict()


class Background:
    """A write or any other job beside the driver's own, as a thread of its own.

    At most ``most`` jobs are in flight: one more waits for the oldest. What a
    job raised is raised where it is joined. Jobs use the pool ``background``
    of Spark's fair scheduler where that is set.
    """

    def __init__(self, spark: SparkSession, most: int = 1):
        self.spark, self.most = spark, most
        self.jobs: list[tuple[threading.Thread, dict]] = []

    def start(self, job: Callable[[], object]) -> None:
        while len(self.jobs) >= self.most:
            self.join_oldest()
        out: dict = {}

        def run() -> None:
            try:
                self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", "background")
                out["value"] = job()
            except BaseException as e:  # noqa: BLE001  handed to whoever joins
                out["error"] = e

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        self.jobs.append((thread, out))

    def poll(self) -> int:
        """How many jobs still run."""
        return sum(t.is_alive() for t, _ in self.jobs)

    def join_oldest(self) -> object:
        thread, out = self.jobs.pop(0)
        thread.join()
        if "error" in out:
            raise out["error"]
        return out["value"]

    def join(self) -> list:
        """The results of all jobs, in the order of their start."""
        return [self.join_oldest() for _ in range(len(self.jobs))]


def write_rate(df: DataFrame, path: str, bytes_per_row: int) -> DataFrame:
    """Writes a table and tells, in one row, rows, seconds and MB a second."""
    spark = df.sparkSession
    began = time.time()
    df.write.mode("overwrite").parquet(path)
    seconds = max(time.time() - began, 1e-9)
    rows = spark.read.parquet(path).count()
    return spark.createDataFrame([(rows, seconds, rows * bytes_per_row / 1e6 / seconds)], "rows long, seconds double, mb_per_s double")


def memory_facts(lines: DataFrame) -> DataFrame:
    """name, kb of lines such as ``MemAvailable:  123 kB``."""
    pattern = r"^(\w+(?:\(\w+\))?):\s+(\d+)(?: kB)?\s*$"
    return lines.where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("name"), F.regexp_extract("value", pattern, 2).cast("long").alias("kb"))


def layout_values(lines: DataFrame) -> DataFrame:
    """kind, name, value of the key=number words of lines that begin with ``layout:`` or ``planes:``."""
    kind = F.regexp_extract("value", r"^(layout|planes):", 1)
    words = F.regexp_extract_all("value", F.lit(r"(\w+=-?[0-9][0-9.eE+-]*)"), 1)
    rows = lines.where(kind != "").select(kind.alias("kind"), F.explode(words).alias("w"))
    return rows.select("kind", F.split("w", "=")[0].alias("name"), F.split("w", "=")[1].cast("double").alias("value"))


class _Meminfo(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options.get("path", "/proc/meminfo")

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": int(time.time() * 1000)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(end["at"])]

    def read(self, partition: InputPartition):
        with open(self.path) as f:
            for line in f:
                name, _, rest = line.partition(":")
                number = rest.split()
                if number and number[0].isdigit():
                    yield partition.value, name.strip(), int(number[0])


class MeminfoSource(DataSource):
    """Stream source ``meminfo``: at_ms, name, kb of a machine's memory facts at
    each trigger (those of the executor that reads)."""

    @classmethod
    def name(cls) -> str:
        return "meminfo"

    def schema(self) -> str:
        return "at_ms long, name string, kb long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Meminfo(self.options)


def memory_stream(spark: SparkSession, path: str = "/proc/meminfo") -> DataFrame:
    spark.dataSource.register(MeminfoSource)
    return spark.readStream.format("meminfo").option("path", path).load()
