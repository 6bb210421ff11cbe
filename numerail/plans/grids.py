"""Planning of exact products: grids of pieces, bounds, whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.division import precisions
from ..operators.numbers import BASE
from ..operators.series import FAN_IN, LEAF, terms_for

MOST_CUTS = 32


def plane_points(n: int, least: int = 1) -> int:
    """The power of two that holds n points."""
    return max(least, 1 << max(0, n - 1).bit_length())


def grid_shape(na: int, nb: int, cap: int, least: int = 1) -> tuple[int, int]:
    """Cuts (ka, kb) of a product of na x nb limbs, so that a piece has at most
    ``cap`` points: the least total of plane points, then the fewest pieces."""
    if na + nb <= cap:
        return 1, 1
    best = None
    for ka in range(1, MOST_CUTS + 1):
        for kb in range(1, MOST_CUTS + 1):
            n = -(-na // ka) + -(-nb // kb)
            if n <= cap:
                key = (ka * kb * plane_points(n, least), ka * kb)
                if best is None or key < best[0]:
                    best = key, (ka, kb)
    if best is None:
        raise ValueError(f"{na} x {nb} limbs do not fit pieces of {cap} points")
    return best[1]


def piece_skipped(oa: int, ob: int, la: int, lb: int, low: int, high: int | None) -> bool:
    """Whether a piece at offsets oa, ob of lengths la, lb lies wholly outside [low, high)."""
    return oa + ob + la + lb <= low or (high is not None and oa + ob >= high)


def pieces(spark: SparkSession, na: int, nb: int, cap: int, low: int = 0, high: int | None = None) -> DataFrame:
    """A row for each piece of the grid: i, j, their limbs, and whether the cut skips it."""
    ka, kb = grid_shape(na, nb, cap)
    pa, pb = -(-na // ka), -(-nb // kb)
    rows = []
    for i in range(ka):
        for j in range(kb):
            la, lb = min(pa, na - i * pa), min(pb, nb - j * pb)
            if la > 0 and lb > 0:
                rows.append((i, j, la, lb, piece_skipped(i * pa, j * pb, la, lb, low, high)))
    return spark.createDataFrame(rows, "i int, j int, la long, lb long, skipped boolean")


def grid_table(spark: SparkSession, na: int, nb: int, cap: int) -> DataFrame:
    """All grids that fit, with their costs, the best first: the search as a query."""
    cuts = spark.range(1, MOST_CUTS + 1)
    both = cuts.select(F.col("id").alias("ka")).crossJoin(cuts.select(F.col("id").alias("kb")))
    points = F.ceil(F.lit(na) / F.col("ka")) + F.ceil(F.lit(nb) / F.col("kb"))
    plane = F.pow(F.lit(2.0), F.ceil(F.log2(points.cast("double")))).cast("long")
    out = both.withColumn("points", points).where(F.col("points") <= cap).withColumn("pieces", F.col("ka") * F.col("kb"))
    return out.withColumn("cost", F.col("pieces") * plane).orderBy("cost", "pieces", "ka")


def run_plan(spark: SparkSession, digits: int, cap: int = 1 << 22) -> DataFrame:
    """The products of a run for so many digits: stage, level, count, na, nb, ka, kb, terms_ok.

    Sizes are estimates from the size of factorials; ``terms_ok`` says whether
    bigint sums of products hold (the bound that the residue checks rely on).
    """
    import math

    from ..operators.products import max_terms

    n = terms_for(digits)
    limbs_of_range = lambda a, b: max(1, math.ceil((math.lgamma(b + 1) - math.lgamma(a + 1)) / math.log(BASE)))
    rows = []

    def add(stage, level, count, na, nb):
        ka, kb = grid_shape(na, nb, cap)
        rows.append((stage, level, count, na, nb, ka, kb, min(na, nb) <= max_terms()))

    nodes, span, level = -(-n // LEAF), LEAF, 1
    while nodes > 1:
        size = limbs_of_range(max(0, n - span), n)
        add("tree", level, 2 * nodes, size, size)
        nodes, span, level = -(-nodes // FAN_IN), span * FAN_IN, level + 1
    q = limbs_of_range(0, n)
    k = -(-digits // 6) + 2
    for step, p in enumerate(precisions(k)):
        add("reciprocal", step, 2, min(q, p + 2), p)
    add("division", 0, 2, q + k, k)
    return spark.createDataFrame(rows, "stage string, level int, products long, na long, nb long, ka int, kb int, terms_ok boolean")


def fan_in_schedule(size: int) -> list[int]:
    """Group sizes of a tree over ``size`` nodes: powers of two first, then odd factors, up to all."""
    out, v = [], 1
    while v * 2 <= size and size % (v * 2) == 0:
        v *= 2
        out.append(v)
    rest, f = size // v, 3
    while rest > 1:
        if rest % f:
            f += 2
            continue
        v, rest = v * f, rest // f
        out.append(v)
    return out if out and out[-1] == size else [*out, size]
