"""Ordered tree aggregation over tables of limbs: binary splitting of a series, digits of e, their identity."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import division as dv
from . import longnums as ln
from . import numbers as nb
from . import residues as rs
from .storage import stored

#: Terms that one leaf folds; children of a tree node.
LEAF, FAN_IN = 4096, 2
#: Leaves that are enough for a short series, and terms of a leaf at most, of a longer one.
LEAVES, MOST_TERMS = 16, 65_536
#: Primes of the residues in a saved level's header.
HEADER_PRIMES = rs.CHECK_PRIMES[:2]


def terms_for(digits: int, guard: int = 50) -> int:
    """The least m with log10(m!) >= digits + guard."""
    low, high = 1, 2
    enough = lambda m: math.lgamma(m + 1) / math.log(10) >= digits + guard
    while not enough(high):
        low, high = high, 2 * high
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle + 1, high)
    return low


def leaf_for(n_terms: int) -> int:
    """Terms of a leaf: LEAF, doubled while there are more than LEAVES leaves, up to MOST_TERMS."""
    leaf = LEAF
    while leaf < MOST_TERMS and n_terms > LEAVES * leaf:
        leaf *= 2
    return leaf


def leaf_fold(a: int, b: int) -> tuple[int, int]:
    """(P, Q) of the terms a .. b - 1 of sum 1/k!, from the last to the first: P = Q + P, Q = k Q; many terms by halves."""
    if b - a > 64:
        (p, q), (r, s) = leaf_fold(a, (a + b) // 2), leaf_fold((a + b) // 2, b)
        return p * s + r, q * s
    p, q = 0, 1
    for k in range(b - 1, a - 1, -1):
        p, q = q + p, q * k
    return p, q


def _leaf_rows(batches):
    """Leaves (i, a, b) to the chunks of their two numbers, named <i>p and <i>q."""
    for i, a, b in ln._rows(batches, ["i", "a", "b"]):
        for kind, value in zip("pq", leaf_fold(a, b), strict=True):
            yield from dv.chunks_of(f"{i}{kind}", value)


def leaves_of(spark: SparkSession, n_terms: int, leaf: int = LEAF) -> DataFrame:
    """The leaves of the tree as PACKED numbers: P and Q of ``leaf`` terms each, folded on the executors."""
    count = -(-n_terms // leaf)
    spans = spark.range(count).select(F.col("id").alias("i"), (F.col("id") * leaf + 1).alias("a"), F.least((F.col("id") + 1) * leaf + 1, F.lit(n_terms + 1)).alias("b"))
    return stored(ln._mapped(spans.repartition(min(count, 4 * spark.sparkContext.defaultParallelism), "i"), _leaf_rows, ln.PACKED), "leaves")


def joined(nodes: DataFrame, count: int) -> DataFrame:
    """The next level of a tree of ``count`` nodes: neighbours in order, (P1, Q1) o (P2, Q2) = (P1 Q2 + P2, Q1 Q2).

    All products of the level are one batch of distributed products, which add
    P2 before their carries; no row or task holds a whole number. A last odd
    node goes up as it is.
    """
    node, kind = F.expr("bigint(substring(num, 1, length(num) - 1))"), F.expr("right(num, 1)")
    n = nodes.withColumn("_n", node).withColumn("_k", kind)
    up = F.concat(F.expr("_n div 2").cast("string"), F.lit("p"))
    last = count - 1 if count % 2 else count
    left = n.where((F.col("_n") % 2 == 0) & (F.col("_n") < last))
    right = n.where(F.col("_n") % 2 == 1)
    columns = ["chunk", "data", "top"]
    name = lambda k: F.concat(F.expr("_n div 2").cast("string"), k).alias("num")
    a = left.select(name(F.col("_k")), *columns)
    b = right.where("_k = 'q'").select(F.explode(F.array(name(F.lit("p")), name(F.lit("q")))).alias("num"), *columns)
    plus = right.where("_k = 'p'").select(up.alias("num"), *columns)
    out = ln.product(a, b, plus)
    if count % 2:
        out = stored(out.unionByName(n.where(F.col("_n") == last).select(name(F.col("_k")), *columns)), "level")
    return out


def _header(nodes: DataFrame, n_terms: int, leaf: int, level: int, count: int) -> dict:
    """What a saved level is: its place, and residues of its numbers, added up."""
    found = ln.residues(nodes, list(HEADER_PRIMES)).agg(*[F.sum(f"r{i}").cast("string").alias(f"r{i}") for i in range(len(HEADER_PRIMES))]).first()
    return {"terms": n_terms, "leaf": leaf, "level": level, "nodes": count, "primes": [str(p) for p in HEADER_PRIMES], "residues": list(found)}


def save_level(nodes: DataFrame, path: str, n_terms: int, leaf: int, level: int, count: int) -> None:
    """Writes a level and then, when it is whole, its header."""
    spark = nodes.sparkSession
    nodes.write.mode("overwrite").parquet(f"{path}/level-{level}")
    spark.createDataFrame([(json.dumps(_header(nodes, n_terms, leaf, level, count)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header-{level}")


def saved_level(spark: SparkSession, path: str, n_terms: int, leaf: int) -> tuple[int, int, DataFrame] | None:
    """(level, nodes, numbers) of the highest whole level below a path; refused if its header says another series or other residues."""
    jvm = spark._jvm
    exists = lambda p: (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(q)
    for level in range((-(-n_terms // leaf)).bit_length() + 1, -1, -1):
        if not exists(f"{path}/header-{level}/_SUCCESS"):
            continue
        header = json.loads(spark.read.text(f"{path}/header-{level}").first()["value"])
        nodes = spark.read.schema(ln.PACKED).parquet(f"{path}/level-{level}")
        if header != _header(nodes, n_terms, leaf, level, header["nodes"]):
            raise ValueError(f"the level saved in {path} is of another series, or damaged: {header}")
        return level, header["nodes"], nodes
    return None


def split_series(spark: SparkSession, n_terms: int, leaf: int | None = None, save: str | None = None, seen: Callable[[int, DataFrame], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """P and Q with P/Q = 1/1! + ... + 1/n! as PACKED numbers named e.

    Each level is a table of its own in the shared folder, so a lost executor
    costs part of a level. With ``save`` every level is kept below that path
    with a header, and a run goes on from the highest one that is whole.
    ``seen`` gets the number and the nodes of each level that is made.
    """
    leaf = leaf or leaf_for(n_terms)
    found = saved_level(spark, save, n_terms, leaf) if save else None
    level, count, nodes = found or (0, -(-n_terms // leaf), None)
    if nodes is None:
        nodes = leaves_of(spark, n_terms, leaf)
        if seen:
            seen(0, nodes)
        if save:
            save_level(nodes, save, n_terms, leaf, 0, count)
    while count > 1:
        nodes = joined(nodes, count)
        level, count = level + 1, -(-count // 2)
        if seen:
            seen(level, nodes)
        if save:
            save_level(nodes, save, n_terms, leaf, level, count)
    return tuple(nodes.where(F.col("num") == k).select(F.lit("e").alias("num"), "chunk", "data", "top") for k in ("0p", "0q"))


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the folder of spark.checkpoint.dir (a new one where it
    is unset on a local master; on a cluster that would be one machine's own)."""
    import tempfile

    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="numerail-"))
    return df.checkpoint()


def _division_of_e(spark: SparkSession, digits: int) -> tuple[DataFrame, ...]:
    """X, R, P, Q with 10^digits (P + Q) = X Q + R, all PACKED."""
    p, q = split_series(spark, terms_for(digits))
    sum_ = ln.sum_of(p, q)
    top = ln.assembled(ln.shifted(ln.carried(ln.as_pieces(sum_, 10 ** (digits % nb.DIGITS))), digits // nb.DIGITS))
    return *dv.divided(top, q), p, q


def e_digits(spark: SparkSession, digits: int) -> DataFrame:
    """floor(10^digits * e) as a limb number 'e', from the series: 1 + P/Q, times 10^digits."""
    return ln.unpacked(stored(_division_of_e(spark, digits)[0], "e"))


def identity_of_e(spark: SparkSession, digits: int, primes: list[int]) -> DataFrame:
    """prime, value, ok: X Q + R modulo each prime, and whether 10^digits (P + Q) is
    the same; and a row 'remainder' for 0 <= R < Q.

    P and Q modulo the primes come from the recurrence over ranges of terms; X
    and R are what the division of the tree's numbers gave. So the two ways to
    P and Q, the digits and the remainder have to agree.
    """
    x, r, _, q = _division_of_e(spark, digits)
    own = ln.residues(q, primes)
    series = rs.series_mod(terms_for(digits), spark, primes)
    names = [f"r{i}" for i in range(len(primes))]
    tall = lambda df, c: df.select(F.explode(F.array(*[F.struct(F.lit(str(m)).alias("prime"), F.col(k).cast(rs.WIDE).alias(c)) for m, k in zip(primes, names, strict=True)])).alias("s")).select("s.*")
    both = stored(series.join(tall(ln.residues(x, primes), "x"), "prime").join(tall(ln.residues(r, primes), "r"), "prime").join(tall(own, "own"), "prime"), "identity")
    checks = None
    for m in primes:
        w = F.lit(pow(10, digits, m)).cast(rs.WIDE)
        big = F.lit(m).cast(rs.WIDE)
        left = rs.mulmod(w, ((F.col("p").cast(rs.WIDE) + F.col("q").cast(rs.WIDE)).cast(rs.PRODUCT) % big).cast(rs.WIDE), m)
        right = ((rs.mulmod(F.col("x"), F.col("own"), m) + F.col("r")).cast(rs.PRODUCT) % big).cast(rs.WIDE)
        row = both.where(F.col("prime") == str(m)).select("prime", right.cast("string").alias("value"), F.coalesce(left == right, F.lit(False)).alias("ok"))
        checks = row if checks is None else checks.unionByName(row)
    less = ln.compared(r, q).select(F.lit("remainder").alias("prime"), F.lit(None).cast("string").alias("value"), (F.col("cmp") < 0).alias("ok"))
    return checks.unionByName(less)


def divided(a: DataFrame, q: DataFrame, seed: int = dv.SEED_LIMBS, steps: dv.Steps | None = None) -> tuple[DataFrame, DataFrame]:
    """Quotient and remainder of two limb numbers of one name."""
    x, r = dv.divided(ln.packed(a), ln.packed(q), seed, steps)
    return ln.unpacked(stored(x, "quotient")), ln.unpacked(stored(r, "remainder"))
