"""Text sources: run logs, key=value summaries, tab-separated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import indexed_within
from ..operators.storage import stored

#: Optional "rank: " and "mn: host rank: " before a line.
PREFIX = r"^(?:\s*\d+: )?(?:mn: (\S+) (\d+): )?"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, value of text files; lines are numbered from 0 within each file.

    A file is read in as many splits as Spark makes of it: lines are numbered by
    the start of their split and their order in it, so no row or task holds a file.
    """
    rows = spark.read.text(path, lineSep="\n")
    placed = rows.select(F.input_file_name().alias("path"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_in"), "value")
    placed = stored(placed, "lines")  # an id within a split is given once
    return indexed_within(placed, ["path"], ["_split", "_in"], "line_no").select("path", "line_no", "value")


def prefixed(value: Column) -> tuple[Column, Column, Column]:
    """host, rank and the rest of a line."""
    host, rank = F.regexp_extract(value, PREFIX, 1), F.regexp_extract(value, PREFIX, 2)
    return F.when(host != "", host), rank.try_cast("int"), F.regexp_replace(value, PREFIX, "")


def metric_lines(lines: DataFrame, program: str) -> DataFrame:
    """line_no, host, rank, name, unit, metric of lines ``RESULT program name unit value``."""
    host, rank, rest = prefixed(F.col("value"))
    pattern = rf"^RESULT {program} (\S+) (\S+) (\S+)"
    found = lines.select("line_no", host.alias("host"), rank.alias("rank"), rest.alias("_l")).where(F.col("_l").rlike(pattern))
    return found.select("line_no", "host", "rank", *[F.regexp_extract("_l", pattern, i).alias(n) for i, n in ((1, "name"), (2, "unit"))], F.regexp_extract("_l", pattern, 3).try_cast("double").alias("metric"))


#: Words by which the logs tell of an error.
ERROR_WORDS = "FATAL|Segmentation|SIGSEGV|SIGBUS|SIGABRT|out of memory|REFUSED"


def error_lines(lines: DataFrame, words: str = ERROR_WORDS) -> DataFrame:
    return lines.where(F.col("value").rlike(words))


def key_values(lines: DataFrame) -> DataFrame:
    """key, value of lines key=value; of a repeated key all rows are kept, for last_wins()."""
    kv = F.split("value", "=", 2)
    return lines.where(F.col("value").contains("=")).select(*[c for c in lines.columns if c != "value"], F.get(kv, F.lit(0)).alias("key"), F.get(kv, F.lit(1)).alias("value"))


def word_map(line: Column) -> Column:
    """Map of the key=value words of a line; the last of a key counts."""
    words = F.filter(F.split(line, r"\s+"), lambda w: w.contains("="))
    pairs = F.transform(words, lambda w: F.struct(F.split(w, "=", 2)[0].alias("key"), F.split(w, "=", 2)[1].alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def replica_rows(lines: DataFrame, names: list[str]) -> DataFrame:
    """path, run and a column for each name, of keys p<path>r<run>.<name>."""
    kv = key_values(lines)
    pattern = r"^p(\d)r(\d+)\.(\w+)$"
    rows = kv.where(F.col("key").rlike(pattern)).select(*[F.regexp_extract("key", pattern, i).alias(n) for i, n in ((1, "path"), (2, "run"), (3, "name"))], "value")
    return rows.groupBy("path", "run").pivot("name", names).agg(F.max("value"))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated files with a header and # comments; files of a glob are united."""
    return spark.read.csv(path, schema=schema, sep="\t", header=True, comment="#", ignoreTrailingWhiteSpace=True, ignoreLeadingWhiteSpace=True)


def united_tables(lines: DataFrame, columns: list[str], types: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of tab-separated files that have one header, and what is wrong with them.

    ``lines``: path, line_no, value. Empty lines and those that start with #
    are left out. The first other line of a file must begin with the columns;
    a file with another header is named in the problems and its rows are taken
    by place all the same. Rows: path, line_no and the columns without spaces
    around them, those in ``types`` (such as {"prio": "int"}) as numbers.
    Problems: path, line_no, problem; a row with a wrong number of columns or
    with a text for a number is a problem and no row. Files without any line
    have neither.
    """
    used = lines.where(~F.col("value").rlike(r"^(\s*$|#)")).select("path", "line_no", F.regexp_replace("value", r"\r$", "").alias("value"))
    heads = used.groupBy("path").agg(F.min(F.struct("line_no", "value")).alias("h")).select("path", "h.line_no", "h.value")
    cells = F.split("value", "\t", -1)
    wanted = F.array(*[F.lit(c) for c in columns])
    bad_heads = heads.where(~F.slice(cells, 1, len(columns)).eqNullSafe(wanted)).select("path", "line_no", F.lit("header must be " + " ".join(columns)).alias("problem"))
    first = heads.select("path", F.col("line_no").alias("_head"))
    body = used.join(first, "path").where("line_no > _head").withColumn("_c", cells)
    numbers = {c: F.expr(f"try_cast(trim(_c[{columns.index(c)}]) as {t})") for c, t in (types or {}).items()}
    short = F.size("_c") != len(columns)
    no_number = F.concat_ws(" ", *[F.when(n.isNull(), F.lit(c)) for c, n in numbers.items()]) if numbers else F.lit("")
    problem = F.when(short, F.concat(F.size("_c").cast("string"), F.lit(f" columns, need {len(columns)}"))).when(no_number != "", F.concat(F.lit("no number: "), no_number))
    checked = body.withColumn("_problem", problem)
    rows = checked.where("_problem is null").select("path", "line_no", *[numbers.get(c, F.trim(F.get("_c", F.lit(i)))).alias(c) for i, c in enumerate(columns)])
    return rows, bad_heads.unionByName(checked.where("_problem is not null").select("path", "line_no", F.col("_problem").alias("problem")))


def field(line: Column, key: str) -> Column:
    """The value of the first ``key=value`` of a line, empty without one."""
    return F.regexp_extract(line, rf"(?:^|\s){key}=(\S*)", 1)


def cited_names(lines: DataFrame, pattern: str) -> DataFrame:
    """line_no, name of every match of a pattern's first group: a scan of sources or documents."""
    return lines.select("line_no", F.explode(F.regexp_extract_all("value", F.lit(pattern), 1)).alias("name"))
