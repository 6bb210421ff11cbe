"""The queries of the engine's own operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import analytics as an
from .operators import manifest as mf
from .operators import numbers as nb
from .operators import order as od
from .operators import products as pr
from .operators import residues as rs
from .operators import series as se
from .operators import topology as tp

SMALL_PRIME, LARGE_PRIME = 998_244_353, rs.CHECK_PRIMES[0]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def _price_number(spark, sf_dir) -> DataFrame:
    """The line items' prices in cents as limbs, in the order of (order, line, part, price)."""
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", _cents("l_extendedprice").alias("limb"))
    return od.indexed(rows, ["l_orderkey", "l_linenumber", "l_partkey", "limb"]).select(F.lit("n").alias("num"), "idx", "limb")


def limb_residue(spark, sf_dir):
    """A number of base 10^9 modulo a small and a 62-bit prime."""
    r = rs.limbs_mod(_price_number(spark, sf_dir), [SMALL_PRIME, LARGE_PRIME], 10**9)
    return r.select("num", F.col("r0").cast("string").alias("r0"), F.col("r1").cast("string").alias("r1"))


def _two_numbers(spark, sf_dir):
    a = od.indexed(_t(spark, sf_dir, "orders").select("o_orderkey", (_cents("o_totalprice") % nb.BASE).alias("limb")), ["o_orderkey"])
    b = od.indexed(_t(spark, sf_dir, "customer").select("c_custkey", (F.abs(_cents("c_acctbal")) % nb.BASE).alias("limb")), ["c_custkey"])
    return a.select(F.lit("s").alias("num"), "idx", "limb"), b.select(F.lit("s").alias("num"), "idx", "limb")


def number_add_carry(spark, sf_dir):
    a, b = _two_numbers(spark, sf_dir)
    return nb.added(a, b)


def number_sub_borrow(spark, sf_dir):
    a, b = _two_numbers(spark, sf_dir)
    return nb.subtracted(a, b)


def number_compare(spark, sf_dir):
    """For each nation, the number of its suppliers' balances against that of its customers'."""
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("num"), F.col("s_suppkey").alias("k"), (F.abs(_cents("s_acctbal")) % nb.BASE).alias("limb"))
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("num"), F.col("c_custkey").alias("k"), (F.abs(_cents("c_acctbal")) % nb.BASE).alias("limb"))
    return nb.compared(*(od.indexed_within(n, ["num"], ["k"]).drop("k") for n in (s, c)))


def _region_numbers(spark, sf_dir):
    a = _t(spark, sf_dir, "nation").select(F.lit("p").alias("num"), F.col("n_nationkey").cast("long").alias("idx"), ((F.col("n_nationkey") * 39119 + 7) % nb.BASE).cast("long").alias("limb"))
    b = _t(spark, sf_dir, "region").select(F.lit("p").alias("num"), F.col("r_regionkey").cast("long").alias("idx"), ((F.col("r_regionkey") * 271828 + 5) % nb.BASE).cast("long").alias("limb"))
    return a, b


def convolution_small(spark, sf_dir):
    """A product modulo base^20, by the definition."""
    a, b = _region_numbers(spark, sf_dir)
    return nb.view(pr.convolved(a, b, high=20), 0, 20)


def block_product(spark, sf_dir):
    """The same product, whole, by the grid of blocks."""
    a, b = _region_numbers(spark, sf_dir)
    return pr.multiplied(a, b, size=8)


def cyclic_fold(spark, sf_dir):
    """The price number in base 10^6 modulo base^50 - 1."""
    n = _price_number(spark, sf_dir).withColumn("limb", F.col("limb") % nb.BASE)
    return nb.folded(n, 50)


def exclusive_prefix(spark, sf_dir):
    rows = od.indexed(_t(spark, sf_dir, "orders").select("o_orderkey", _cents("o_totalprice").alias("cents")), ["o_orderkey"])
    return od.running_sums(rows, "cents", "idx", 4096, "before").select("o_orderkey", "idx", "before")


def residue_parts(spark, sf_dir):
    """Residues modulo base + 1 and base - 1 of the price number."""
    return nb.alternating_mods(_price_number(spark, sf_dir).withColumn("limb", F.col("limb") % nb.BASE))


def first_vs_max_metric(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("ord", F.struct("ts", "event_id"))
    return an.first_or_max(e, ["user_id", "event_type"], "value", "ord", F.col("event_type").isin("purchase", "view"))


def verdict_case(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return an.verdict(e, ["user_id"], F.col("value") > 50, F.col("value") > 99, F.col("value") < 1, F.col("user_id") % 2 == 0)


def fingerprint(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return an.fingerprint(e, ["event_type"], F.concat_ws(":", "event_type", F.col("user_id").cast("string")))


def slow_outlier(spark, sf_dir):
    """Events far above the median of their type: over 1.3 times and by more than 5."""
    e = _t(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return an.outliers(e, ["event_type"], "value", 1.3, 5.0, least=1, strict_excess=True, least_for_median=1).select("event_id", "event_type", "value", F.round("ref", 6).alias("ref"))


def node_screen(spark, sf_dir):
    """Events above three times the reference of their user and by 2 at least."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return an.outliers(e, ["user_id"], "value", 3.0, 2.0).select("event_id", "user_id", F.round("ref", 6).alias("ref"), "n")


def median_max(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("who", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return an.median_and_worst(e, ["event_type"], "value", "who").select("event_type", F.round("median", 6).alias("median"), "worst", "who")


def arm_summary(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    out = an.summary_by_arm(e, "event_type", "value", F.col("user_id") % 3 != 0)
    return out.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "bad")


def paired_diff(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("arm", (F.col("user_id") % 4).cast("int"))
    out = an.paired_difference(e, "arm", 0, ["ts", "event_id"], "value", F.col("user_id") % 3 != 0)
    return out.select("arm", "pairs", *[F.round(c, 6).alias(c) for c in ("diff", "pct", "ci95")])


def topology_rollup(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").join(F.broadcast(_t(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = _t(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return tp.unit_counts(c, ["r_name", "n_name"], [F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("n_low")])


def window_span(spark, sf_dir):
    """Per priority, the eight consecutive orders with the least span of keys."""
    return tp.best_windows(_t(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], "o_orderkey", 8)


def rle_islands(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return an.islands(e, ["user_id"], ["event_id"], "event_type")


def span_groups(spark, sf_dir):
    o = od.indexed(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"])
    return an.spanning_sets(o, "idx", "o_orderpriority", [2, 4, 8]).select("size", "set_no", "groups")


def interval_overlap(spark, sf_dir):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day.alias("s"), (day + 1 + F.col("o_orderkey") % 30).alias("e"))
    return an.overlaps(o, ["o_custkey"], "o_orderkey", "s", "e", 32)


def registry_drift(spark, sf_dir):
    code = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), (F.col("p_size") % 7).cast("long").alias("value"))
    listed = _t(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") + 3).alias("name")).agg(F.max("l_linenumber").cast("long").alias("value"))
    return an.drift(code, listed, "name", "value")


def anti_join(spark, sf_dir):
    """Customers without a large order."""
    return _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def precedence(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    levels = [("env", F.when(F.col("s_acctbal") > 5000, F.lit("high"))), ("profile", F.when(F.col("s_suppkey") % 3 == 0, F.lit("third"))), ("default", F.when(F.col("s_nationkey") < 20, F.lit("base")))]
    return s.select("s_suppkey", *an.precedence(levels))


def interpolate(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    table = p.where("p_size % 7 = 0").groupBy(F.col("p_size").alias("x")).agg(F.avg("p_retailprice").alias("y"))
    points = p.select("p_size").distinct()
    return an.neighbours(table, "x", "y", points, "p_size").select("p_size", F.round("value", 4).alias("value"))


def wilson(spark, sf_dir):
    e = _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 90).alias("failures"))
    low, high = an.wilson(F.col("n"), F.col("failures"))
    return e.select("event_type", "n", "failures", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def kv_json(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_type", F.from_json("props", "map<string,long>").alias("m"))
    return e.groupBy("event_type").agg(F.max(F.array_max(F.map_values("m"))).alias("most"), F.sum(F.try_element_at("m", F.lit("k"))).cast("long").alias("total"), F.count_if(F.map_contains_key("m", "k")).alias("n"))


def digit_chunks(spark, sf_dir):
    """Documents' lengths written one after the other, per source, as one number: its residues."""
    d = _t(spark, sf_dir, "documents").select(F.col("source").alias("num"), F.col("doc_id").alias("chunk_no"), F.col("n_chars").cast("string").alias("text"))
    r = rs.digits_mod(d, [SMALL_PRIME, LARGE_PRIME])
    return r.select("num", F.col("r0").cast("string").alias("r0"), F.col("r1").cast("string").alias("r1"))


def natural_sort(spark, sf_dir):
    prefix, number = tp.natural_key(F.col("c_name"))
    return _t(spark, sf_dir, "customer").select("c_custkey", prefix.alias("prefix"), number.alias("number"))


def hostlist(spark, sf_dir):
    k = F.col("n_nationkey")
    three = lambda c: F.lpad(c.cast("string"), 3, "0")
    expr = F.concat(F.lower(F.regexp_replace("n_name", " ", "")), F.lit("["), three(k), F.lit("-"), three(k + 2), F.lit(","), (k + 40).cast("string"), F.lit("]"))
    return tp.expanded(_t(spark, sf_dir, "nation").select("n_nationkey", expr.alias("expr")), "expr").select("n_nationkey", "host")


def log_metrics(spark, sf_dir):
    """Values read from log lines with an optional rank: first wins, but for purchases the largest."""
    from .sources.logs import metric_lines

    e = _t(spark, sf_dir, "events")
    rank = F.when(F.col("user_id") % 2 == 0, F.concat((F.col("user_id") % 8).cast("string"), F.lit(": "))).otherwise("")
    lines = e.select(F.col("event_id").alias("line_no"), F.concat(rank, F.lit("RESULT run "), "event_type", F.lit(" s "), F.round("value", 2).cast("string")).alias("value"))
    m = metric_lines(lines, "run")
    return an.first_or_max(m, ["name"], "metric", "line_no", F.col("name") == "purchase")


def replica_pivot(spark, sf_dir):
    """Summary keys p<path>r<run>.<name> to rows of (path, run)."""
    from .sources.logs import replica_rows

    e = _t(spark, sf_dir, "events")
    key = F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string"), F.lit("r"), (F.col("event_id") % 5).cast("string"), F.lit("."), F.when(F.col("event_id") % 2 == 0, "total").otherwise("verify"))
    lines = e.groupBy(key.alias("key")).agg(F.max("event_id").cast("string").alias("value")).select(F.concat("key", F.lit("="), "value").alias("value"))
    return replica_rows(lines, ["total", "verify"])


def part_contiguity(spark, sf_dir):
    """Whether parts of a number, by order month, are complete and adjoin."""
    o = od.indexed(_t(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])
    parts = o.groupBy(F.expr("idx div 1000").cast("int").alias("part")).agg(F.min("idx").alias("lo"), (F.max("idx") + 1).alias("hi"))
    before = parts.select((F.col("part") + 1).alias("part"), F.col("hi").alias("_end"))
    return parts.join(before, "part", "left").select("part", "lo", "hi", F.coalesce(F.col("lo") == F.col("_end"), F.col("lo") == 0).alias("joins"))


def first_mismatch(spark, sf_dir):
    """First position at which the limbs of two numbers differ."""
    a, b = _two_numbers(spark, sf_dir)
    both = a.select("idx", F.col("limb").alias("x")).join(b.select("idx", F.col("limb").alias("y")), "idx", "full")
    return both.where("not (x <=> y)").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("differ"))


def dependency_cycles(spark, sf_dir):
    """Referral edges of all customers: those that no order can place.

    In each ten a customer needs the next; the last needs the fourth in every third ten, else an id that nobody has.
    """
    k = F.col("c_custkey")
    last = F.when(F.expr("c_custkey div 10 % 3 = 0"), k - 6).otherwise(F.lit(-1))
    return mf.cyclic(_t(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 10 < 9, k + 1).otherwise(last).alias("dep")))


def gate_counts(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    said = an.gate(F.col("o_orderstatus") != "F", F.col("o_totalprice") > 1000, F.col("o_orderpriority") != "1-URGENT")
    return o.groupBy(said.alias("gate")).agg(F.count(F.lit(1)).alias("n"))


def e_digits(spark, sf_dir):
    """As many decimals of e as there are customers, as chunks of 50 digits, with the digits' place."""
    from .sources.digits import digit_chunks as chunks

    d = _t(spark, sf_dir, "customer").count()
    return chunks(se.e_digits(spark, d), d + 1, 50).select("chunk_no", "text")


def long_product(spark, sf_dir):
    """The product of the orders' and the customers' number, whole, by distributed transforms: its residues."""
    r = rs.limbs_mod(pr.multiplied(*_two_numbers(spark, sf_dir)), [SMALL_PRIME, LARGE_PRIME])
    return r.select("num", F.col("r0").cast("string").alias("r0"), F.col("r1").cast("string").alias("r1"))


def e_digits_long(spark, sf_dir):
    """Twenty decimals of e for each customer, whose terms fill several leaves and levels of the splitting, as chunks of 50 digits."""
    from .sources.digits import digit_chunks as chunks

    d = 20 * _t(spark, sf_dir, "customer").count()
    return chunks(se.e_digits(spark, d), d + 1, 50).select("chunk_no", "text")


QUERIES = (
    limb_residue, number_add_carry, number_sub_borrow, number_compare, convolution_small, block_product, cyclic_fold, exclusive_prefix,
    residue_parts, first_vs_max_metric, verdict_case, fingerprint, slow_outlier, node_screen, median_max, arm_summary, paired_diff,
    topology_rollup, window_span, rle_islands, span_groups, interval_overlap, registry_drift, anti_join, precedence, interpolate, wilson,
    kv_json, digit_chunks, natural_sort, hostlist, log_metrics, replica_pivot, part_contiguity, first_mismatch, dependency_cycles,
    gate_counts, e_digits, long_product, e_digits_long,
)


def queries():
    from . import number_queries, report_queries

    return {q.__name__: q for q in (*QUERIES, *number_queries.QUERIES, *report_queries.QUERIES)}


def oracle_sql():
    from . import number_queries, oracles, report_queries

    return {**oracles.SQL, **number_queries.SQL, **report_queries.SQL}
