"""Queries of the report operators over the test tables, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import reports as rp
from .operators import topology as tp
from .sources import logs as lg


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def phase_shares(spark, sf_dir):
    """Discount and tax of each order, in cents, as shares of its price."""
    cents = lambda e: F.sum(F.expr(e)).cast("long")
    price, low, tax = "round(l_extendedprice * 100)", "round(l_extendedprice * l_discount * 100)", "round(l_extendedprice * l_tax * 100)"
    o = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(cents(price).alias("total"), cents(low).alias("discount"), cents(tax).alias("tax"))
    return rp.phase_shares(o, "total", ["discount", "tax"])


def _runs(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select(
        "event_type", F.round(F.col("value") * 100).cast("long").alias("total"), (F.col("value") > 20).alias("ok"), F.when(F.col("value") > 99, 1).otherwise(0).alias("rc"),
        F.when(F.col("event_type") == "view", (F.col("user_id") % 2).cast("string")).when(F.col("event_type") != "click", "d").alias("digest"),
        F.when(F.col("user_id") % 3 == 0, "42").alias("tail"), F.lit("27").alias("head"),
    )


def path_table(spark, sf_dir):
    t = rp.path_table(_runs(spark, sf_dir), "event_type", "total", F.col("ok"), F.col("rc"), "digest")
    return t.select("event_type", "runs", "n_ok", "bad_exits", F.round("mean", 6).alias("mean"), "least", "most", F.round("spread_pct", 6).alias("spread_pct"), "digests")


def cross_path(spark, sf_dir):
    r = _runs(spark, sf_dir)
    return rp.cross_path(rp.path_table(r, "event_type", "total", F.col("ok"), F.col("rc"), "digest"), r, "tail", "head", 1000)


def host_classes(spark, sf_dir):
    """Suppliers as hosts, the events of the users of their number as logs."""
    hosts = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("host"))
    e = _t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("host")).agg(F.max("value").alias("avail"), F.count_if(F.col("event_type") == "purchase").alias("ue"))
    return rp.classified(rp.with_logs(hosts, e, "host"), "avail", "ue", 80.0).select("host", "reasons", "warnings", "class")


def host_order(spark, sf_dir):
    """Suppliers in the order of the cabinets that customers of their number have."""
    hosts = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("host"), F.col("s_suppkey").alias("at"))
    k = F.col("c_custkey")
    part = lambda c: c.cast("string")
    name = F.concat(F.lit("x"), part(F.col("c_nationkey")), F.lit("c"), part(k % 8), F.lit("s"), part(k % 5), F.lit("b"), part(k % 3), F.lit("n"), part(k % 2))
    # customers that owe have a number of no supplier
    names = _t(spark, sf_dir, "customer").select(F.when(F.col("c_acctbal") > 0, k).otherwise(-1 - k).alias("host"), name.alias("xname"))
    return rp.placed_hosts(hosts, names, "host", "at")


def _topology(spark, sf_dir):
    k = F.col("n_nationkey")
    three = lambda c: F.lpad(c.cast("string"), 3, "0")
    return _t(spark, sf_dir, "nation").select(F.concat(F.lit("SwitchName=s"), k.cast("string"), F.lit(" Level="), (k % 2).cast("string"), F.lit(" LinkSpeed=1 Nodes=n["), three(k * 4), F.lit("-"), three(k * 4 + 2), F.lit("]")).alias("value"))


def leaf_groups(spark, sf_dir):
    """Hosts n000 and so on of the suppliers with their leaf switch."""
    hosts = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), F.lpad((F.col("s_suppkey")).cast("string"), 3, "0")).alias("host"))
    return rp.host_groups(hosts, rp.leaf_switches(_topology(spark, sf_dir)), 16)


def _node_lines(spark, sf_dir):
    """Customers as lines of a scheduler, a seventh of them without a physical name in the line."""
    k = F.col("c_custkey")
    unit = lambda c, n: F.concat(F.lit(c), (k % n).cast("string"))
    xname = F.concat(unit("x", 20), unit("c", 8), unit("s", 5), unit("b", 3), unit("n", 2))
    state = F.element_at(F.array(*[F.lit(s) for s in ("IDLE", "ALLOCATED", "IDLE+DRAIN", "MIXED*")]), (k % 4 + 1).cast("int"))
    address = F.when(k % 7 == 0, F.lit("10.0.0.1")).otherwise(F.concat(F.lit("nid-"), xname))
    host = F.translate("c_name", "#", "-")
    line = F.concat(F.lit("NodeName="), host, F.lit(" Arch=a NodeAddr="), address, F.lit(" State="), state, F.lit(" Partitions=all,p"), (k % 3).cast("string"), F.lit(" End=1"))
    return _t(spark, sf_dir, "customer").select(k, host.alias("host"), F.when(k % 6 == 0, F.concat(F.lit(" "), line)).otherwise(line).alias("value"))


def node_text(spark, sf_dir):
    """The nodes of a scheduler's text with names from a map, and which are free: idle, of partition p1, not excluded."""
    lines = _node_lines(spark, sf_dir)
    names = lines.where("c_custkey % 14 = 0").select("host", F.concat(F.lit("x9c0s0b0n"), F.col("c_custkey").cast("string")).alias("xname"))
    excluded = tp.name_list(lines.where("c_custkey % 11 = 0").select(F.concat("host", F.lit(", nobody # Customer-000000004")).alias("value")))
    nodes = tp.free_nodes(tp.scheduler_nodes(lines, names), "idle", excluded, "p1")
    return nodes.select("host", "xname", *tp.UNITS, "state", F.array_join("partitions", ",").alias("partitions"), "skipped", "free")


def unit_sizes(spark, sf_dir):
    """For each part's key, the smallest unit level of the customers' nodes that holds so many."""
    k = F.col("c_custkey")
    nodes = _t(spark, sf_dir, "customer").select((k % 4).alias("cab"), (k % 3).alias("chassis"), (k % 5).alias("slot"), F.expr("c_custkey div 64").alias("blade"), k.alias("node"))
    return tp.smallest_units(nodes, _t(spark, sf_dir, "part").select("p_partkey"), "p_partkey")


def table_problems(spark, sf_dir):
    """The rows of seven tab-separated files with one header, and what is wrong with them."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.concat(F.lit(" i"), k.cast("string"), F.lit(" "))
    value = F.when(k < 7, F.when(k == 3, "id\tpriority\test").otherwise("id\tprio\test\tmore")).when(k % 13 == 0, "# note\t1\t2").when(k % 17 == 0, "  ")
    value = value.when(k % 19 == 0, F.concat_ws("\t", name, size)).when(k % 23 == 0, F.concat(name, F.lit("\thigh\t1.5"))).otherwise(F.concat_ws("\t", name, size, F.concat(size, F.lit(".5"))))
    lines = _t(spark, sf_dir, "part").select(F.concat(F.lit("f"), (k % 7).cast("string")).alias("path"), F.expr("p_partkey div 7").alias("line_no"), value.alias("value"))
    rows, problems = lg.united_tables(lines, ["id", "prio", "est"], {"prio": "bigint", "est": "double"})
    return rows.unionByName(problems, allowMissingColumns=True)


def default_groups(spark, sf_dir):
    """Customers in groups of 16 by the number of their name."""
    return rp.host_groups(_t(spark, sf_dir, "customer").select(F.col("c_name").alias("host")), None, 16)


def _states(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    items = o.select(F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).alias("prio"), (F.col("o_custkey") % 90 + 1).alias("est_min"))
    done = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 < 3, "PASS").when(F.col("o_orderkey") % 5 == 3, "PARTIAL").alias("status"), (F.col("o_custkey") * 60).cast("long").alias("wall_s"))
    claims = o.where("o_orderstatus <> 'O' or o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("w"), (F.col("o_custkey") % 7).cast("string")).alias("worker"), (F.col("o_orderkey") % 12000).cast("long").alias("age_s"))
    return rp.item_states(items, done, claims)


def item_states(spark, sf_dir):
    return _states(spark, sf_dir)


def status_table(spark, sf_dir):
    return rp.status_table(_states(spark, sf_dir))


def switch_table(spark, sf_dir):
    """Parts as settings that line items read: the quantity is the default."""
    li = _t(spark, sf_dir, "lineitem")
    value = F.when(F.col("l_partkey") % 4 == 0, "7").when(F.col("l_linenumber") % 3 == 0, "unset").when((F.col("l_partkey") % 4 == 1) & (F.col("l_linenumber") % 3 == 1), "derived").when(F.col("l_partkey") % 4 == 2, "unset").otherwise((F.col("l_quantity").cast("long") % 9).cast("string"))
    return rp.switch_table(li.select(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("file"), value.alias("value")))


def _profile(spark, sf_dir):
    k = F.col("p_partkey")
    text = (
        F.when(k % 29 == 0, F.concat(F.lit("# part "), k.cast("string")))
        .when(k % 31 == 0, F.concat(F.lit("no setting "), k.cast("string")))
        .when(k % 37 == 0, F.concat(F.lit("  P"), (k - 1).cast("string"), F.lit("=again")))
        .when(k % 41 == 0, F.concat(F.lit("FI_P"), k.cast("string"), F.lit("=1")))
        .when(k == 1, "LAUNCH_LINE_KEYS=P2 P3 P23 P999999")
        .when(k % 23 == 0, F.concat(F.lit("P"), k.cast("string"), F.lit("=__FILL__")))
        .otherwise(F.concat(F.lit("P"), k.cast("string"), F.lit("="), (F.col("p_size") % 5).cast("string")))
    )
    return _t(spark, sf_dir, "part").select(k.alias("line_no"), text.alias("value"))


def _known(spark, sf_dir):
    # the items after the fifth of an order give names of another kind
    kind = F.when(F.col("l_linenumber") < 6, "P").otherwise("late-P")
    return _t(spark, sf_dir, "lineitem").select(F.concat(kind, F.col("l_partkey").cast("string")).alias("name")).distinct()


def profile_lines(spark, sf_dir):
    """What is wrong with the lines of a profile of parts."""
    return rp.profile_settings(_profile(spark, sf_dir))[1]


def profile_problems(spark, sf_dir):
    return rp.profile_problems(rp.profile_settings(_profile(spark, sf_dir))[0], _known(spark, sf_dir))


def profile_drift(spark, sf_dir):
    """The profile's settings against defaults from the line items."""
    kind = F.when(F.col("l_linenumber") == 1, "P").otherwise("later-P")
    li = _t(spark, sf_dir, "lineitem").select(F.concat(kind, F.col("l_partkey").cast("string")).alias("name"), (F.col("l_partkey") % 5).cast("string").alias("value"))
    return rp.profile_drift(rp.profile_settings(_profile(spark, sf_dir))[0], li, _known(spark, sf_dir))


def drift_counts(spark, sf_dir):
    return rp.drift_counts(profile_drift(spark, sf_dir))


def config_line(spark, sf_dir):
    return rp.config_line(rp.profile_settings(_profile(spark, sf_dir))[0], _known(spark, sf_dir))


def filled_template(spark, sf_dir):
    """Parts as names, their suppliers' last comment as facts."""
    li = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("name")).agg(F.max("l_suppkey").alias("s"))
    value = F.when(F.col("s") % 4 == 0, "NA").when(F.col("s") % 7 == 0, "missing tool").when(F.col("s") % 5 != 0, F.col("s").cast("string"))
    return rp.filled_template(_t(spark, sf_dir, "part").select((F.col("p_partkey") + 5).alias("name")), li.select("name", value.alias("value")))


def undeclared(spark, sf_dir):
    """Suppliers that line items name and no supplier of an even nation has, with how often."""
    return rp.undeclared(_t(spark, sf_dir, "lineitem").select("l_suppkey"), _t(spark, sf_dir, "supplier").select(F.when(F.col("s_nationkey") % 2 == 0, F.col("s_suppkey")).otherwise(-1 - F.col("s_suppkey")).alias("l_suppkey")), "l_suppkey")


def phase_table(spark, sf_dir):
    """Line items as runs: mean phases by quantity, the wall weighted by line number; in whole cents."""
    c = F.round(F.col("l_extendedprice") * 100)
    r = _t(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("size"), c.alias("total"), F.col("l_linenumber").alias("n"), F.when(F.col("l_linenumber") > 1, F.floor(c * 0.125)).cast("double").alias("start"), F.floor(c * 0.25).cast("double").alias("bs"), F.floor(c * 0.5).cast("double").alias("dm"))
    return rp.phase_table(r, "size", "total", "n", "start", ["bs", "dm"]).select("size", *[F.round(x, 4).alias(x) for x in ("bs", "dm", "wall", "init", "other")])


def residual_table(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_retailprice", (F.lit(900.0) + F.col("p_partkey") % 200).alias("modeled"))
    return rp.residuals(p, "modeled", "p_retailprice").select("p_partkey", F.round("residual", 9).alias("residual"))


def risk_rows(spark, sf_dir):
    """Ranges of order prices with their urgent orders as failures, over the sizes of parts."""
    o = _t(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 6).alias("b")).agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("failures"))
    ledger = o.select(F.concat(F.lit("row "), F.col("b").cast("string")).alias("label"), (F.col("b") * 8 + 1).alias("low"), (F.col("b") * 8 + 12).alias("high"), "runs", "failures")
    out = rp.risk_rows(_t(spark, sf_dir, "part").select("p_size").distinct(), ledger, "p_size")
    return out.select("p_size", "label", "runs", "failures", *[F.round(x, 9).alias(x) for x in ("rate", "rate_low", "rate_high", "attempts")])


def relative_differences(spark, sf_dir):
    """Prices of parts against those of the line items with them."""
    li = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.max(F.round(F.col("l_extendedprice") / F.col("l_quantity"))).alias("price"))
    return rp.relative_differences(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.round("p_retailprice").alias("price")), li, ["part"], "price", 0.05).select("part", F.round("difference", 9).alias("difference"), "ok")


QUERIES = (
    phase_shares, path_table, cross_path, host_classes, host_order, leaf_groups, node_text, unit_sizes, table_problems, default_groups, item_states, status_table, switch_table, profile_lines,
    profile_problems, profile_drift, drift_counts, config_line, filled_template, undeclared, phase_table, residual_table, risk_rows, relative_differences,
)

_RUNS = """r AS (SELECT event_type, round(value * 100)::BIGINT AS total, value > 20 AS ok, CASE WHEN value > 99 THEN 1 ELSE 0 END AS rc,
  CASE WHEN event_type = 'view' THEN (user_id % 2)::VARCHAR WHEN event_type <> 'click' THEN 'd' END AS digest, CASE WHEN user_id % 3 = 0 THEN '42' END AS tail, '27' AS head FROM events),
p AS (SELECT event_type, count(*) AS runs, count(*) FILTER (ok) AS n_ok, count(*) FILTER (rc <> 0) AS bad_exits, avg(total) FILTER (ok) AS mean, min(total) FILTER (ok) AS least, max(total) FILTER (ok) AS most,
  CASE count(DISTINCT digest) WHEN 0 THEN 'NONE' WHEN 1 THEN 'AGREE' ELSE 'DIFFER' END AS digests FROM r GROUP BY event_type)"""
_LINES = """l AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 29 = 0 THEN '# part ' || p_partkey WHEN p_partkey % 31 = 0 THEN 'no setting ' || p_partkey WHEN p_partkey % 37 = 0 THEN 'P' || (p_partkey - 1) || '=again'
    WHEN p_partkey % 41 = 0 THEN 'FI_P' || p_partkey || '=1' WHEN p_partkey = 1 THEN 'LAUNCH_LINE_KEYS=P2 P3 P23 P999999' WHEN p_partkey % 23 = 0 THEN 'P' || p_partkey || '=__FILL__'
    ELSE 'P' || p_partkey || '=' || (p_size % 5) END AS t FROM part),
k AS (SELECT n, t, string_split(t, '=')[1] AS name, substr(t, strpos(t, '=') + 1) AS value FROM l WHERE t NOT LIKE '#%' AND strpos(t, '=') > 0),
s AS (SELECT name, arg_max(value, n) AS value, min(n) AS first, max(n) AS line_no FROM k GROUP BY name),
g AS (SELECT DISTINCT 'P' || l_partkey AS name FROM lineitem WHERE l_linenumber < 6)"""
_DRIFT = f"""{_LINES},
d AS (SELECT 'P' || l_partkey AS name, min((l_partkey % 5)::VARCHAR) AS low, max((l_partkey % 5)::VARCHAR) AS high FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL),
c AS (SELECT s.name, CASE WHEN value = '__FILL__' THEN 'UNFILLED' WHEN low IS NULL THEN 'PROFILE-ONLY' WHEN low = value AND high = value THEN 'SAME' ELSE 'OVERRIDE' END AS class FROM s LEFT JOIN d ON d.name = s.name
  UNION ALL SELECT name, 'UNKNOWN' FROM s WHERE name NOT IN (SELECT name FROM g) AND NOT starts_with(name, 'FI_'))"""
_STATES = """d AS (SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 5 < 3 THEN 'PASS' WHEN o_orderkey % 5 = 3 THEN 'PARTIAL' END, 'FAIL') AS status, o_custkey::BIGINT * 60 AS wall FROM orders WHERE o_orderstatus = 'F'),
c AS (SELECT o_orderkey AS id, 'w' || (o_custkey % 7) AS worker, (o_orderkey % 12000)::BIGINT AS age FROM orders WHERE o_orderstatus <> 'O' OR o_orderkey % 3 = 0),
i AS (SELECT o_orderkey AS id, substr(o_orderpriority, 1, 1) AS prio, o_custkey % 90 + 1 AS est, d.id IS NOT NULL AS done, coalesce(status, '') AS status, wall, coalesce(worker, '') AS worker, age,
  CASE WHEN d.id IS NOT NULL THEN 'done' WHEN age IS NOT NULL THEN 'claimed' ELSE 'unclaimed' END AS state FROM orders LEFT JOIN d ON d.id = o_orderkey LEFT JOIN c ON c.id = o_orderkey),
s AS (SELECT id, prio, state, status, worker, CASE state WHEN 'done' THEN wall WHEN 'claimed' THEN age END AS wall_s, state = 'claimed' AND age > (2 * est + 10) * 60 AS stale,
  CASE WHEN done THEN 'done-' || status ELSE state END AS label FROM i)"""

SQL = {
    "node_text": """WITH c AS (SELECT c_custkey AS k, replace(c_name, '#', '-') AS host, ['IDLE', 'ALLOCATED', 'IDLE+DRAIN', 'MIXED*'][c_custkey % 4 + 1] AS state FROM customer WHERE c_custkey % 6 > 0),
        n AS (SELECT *, k % 7 = 0 AND k % 14 > 0 AS skipped, k % 14 = 0 AS mapped FROM c)
        SELECT host, CASE WHEN mapped THEN 'x9c0s0b0n' || k WHEN NOT skipped THEN 'x' || k % 20 || 'c' || k % 8 || 's' || k % 5 || 'b' || k % 3 || 'n' || k % 2 END AS xname,
          CASE WHEN mapped THEN 9 WHEN NOT skipped THEN k % 20 END AS cab, CASE WHEN mapped THEN 0 WHEN NOT skipped THEN k % 8 END AS chassis, CASE WHEN mapped THEN 0 WHEN NOT skipped THEN k % 5 END AS slot,
          CASE WHEN mapped THEN 0 WHEN NOT skipped THEN k % 3 END AS blade, CASE WHEN mapped THEN k WHEN NOT skipped THEN k % 2 END AS node,
          state, 'all,p' || k % 3 AS partitions, skipped, NOT skipped AND state = 'IDLE' AND k % 3 = 1 AND k % 11 > 0 AS free FROM n""",
    "unit_sizes": """WITH c AS (SELECT c_custkey % 4 AS cab, c_custkey % 3 AS chassis, c_custkey % 5 AS slot, c_custkey // 64 AS blade FROM customer),
        m AS (SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM c GROUP BY cab, chassis, slot, blade)) AS m0, (SELECT max(n) FROM (SELECT count(*) AS n FROM c GROUP BY cab, chassis, slot)) AS m1,
          (SELECT max(n) FROM (SELECT count(*) AS n FROM c GROUP BY cab, chassis)) AS m2, (SELECT max(n) FROM (SELECT count(*) AS n FROM c GROUP BY cab)) AS m3)
        SELECT p_partkey, CASE WHEN p_partkey <= m0 THEN 'blade' WHEN p_partkey <= m1 THEN 'slot' WHEN p_partkey <= m2 THEN 'chassis' WHEN p_partkey <= m3 THEN 'cabinet' ELSE 'system' END AS level FROM part, m""",
    "table_problems": """WITH p AS (SELECT p_partkey AS k, 'f' || p_partkey % 7 AS path, p_partkey // 7 AS line_no, p_size AS s FROM part WHERE p_partkey < 7 OR (p_partkey % 13 > 0 AND p_partkey % 17 > 0)),
        t AS (SELECT *, CASE WHEN k = 3 THEN 'header must be id prio est' WHEN k < 7 THEN '' WHEN k % 19 = 0 THEN '2 columns, need 3' WHEN k % 23 = 0 THEN 'no number: prio' END AS problem FROM p)
        SELECT path, line_no, CASE WHEN problem IS NULL THEN 'i' || k END AS id, CASE WHEN problem IS NULL THEN s::BIGINT END AS prio, CASE WHEN problem IS NULL THEN s + 0.5::DOUBLE END AS est, problem FROM t WHERE problem IS DISTINCT FROM ''""",
    "phase_shares": """WITH o AS (SELECT l_orderkey, sum(round(l_extendedprice * 100))::BIGINT AS total, sum(round(l_extendedprice * l_discount * 100))::BIGINT AS discount, sum(round(l_extendedprice * l_tax * 100))::BIGINT AS tax FROM lineitem GROUP BY l_orderkey)
        SELECT *, round(discount / nullif(total, 0), 3) AS discount_share, round(tax / nullif(total, 0), 3) AS tax_share FROM o""",
    "path_table": f"WITH {_RUNS} SELECT event_type, runs, n_ok, bad_exits, round(mean, 6) AS mean, least, most, round(100 * (most - least) / nullif(mean, 0), 6) AS spread_pct, digests FROM p",
    "cross_path": f"""WITH {_RUNS}, w AS (SELECT count(*) AS replicas, count(*) >= 1000 AS complete, count(DISTINCT tail) = 1 AS tails_agree, count(DISTINCT head) <= 1 AS heads_agree FROM r),
        o AS (SELECT bool_and(n_ok = runs AND bad_exits = 0 AND digests = 'AGREE') AS paths_ok FROM p)
        SELECT *, CASE WHEN complete AND tails_agree AND heads_agree AND paths_ok THEN 'PASS' ELSE 'NOT PASS' END AS overall FROM w, o""",
    "host_classes": """WITH e AS (SELECT user_id, max(value) AS avail, count(*) FILTER (event_type = 'purchase') AS ue FROM events GROUP BY user_id),
        x AS (SELECT s_suppkey AS host, concat_ws(',', CASE WHEN e.user_id IS NULL THEN 'failed: no local log' END, CASE WHEN avail < 80 THEN 'memory' END) AS reasons, CASE WHEN ue > 0 THEN 'errors' ELSE '' END AS warnings FROM supplier LEFT JOIN e ON user_id = s_suppkey)
        SELECT *, CASE WHEN reasons <> '' THEN 'EXCLUDE' WHEN warnings <> '' THEN 'WARN' ELSE 'KEEP' END AS class FROM x""",
    "host_order": """SELECT s_suppkey AS host, row_number() OVER (ORDER BY c_custkey IS NULL, c_nationkey, c_custkey % 8, c_custkey % 5, c_custkey % 3, c_custkey % 2, s_suppkey) - 1 AS place
        FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey AND c_acctbal > 0""",
    "leaf_groups": """WITH h AS (SELECT 'n' || lpad(s_suppkey::VARCHAR, 3, '0') AS host, s_suppkey AS k FROM supplier)
        SELECT h.host, CASE WHEN n_nationkey IS NULL THEN '?' ELSE 's' || n_nationkey END AS leaf FROM h LEFT JOIN nation ON n_nationkey % 2 = 0 AND k BETWEEN n_nationkey * 4 AND n_nationkey * 4 + 2""",
    "default_groups": r"SELECT c_name AS host, CASE WHEN regexp_extract(c_name, '(\d+)$', 1)::BIGINT > 0 THEN 'g' || ((regexp_extract(c_name, '(\d+)$', 1)::BIGINT - 1) // 16) ELSE '?' END AS leaf FROM customer",
    "item_states": f"WITH {_STATES} SELECT * FROM s",
    "status_table": f"WITH {_STATES} SELECT label, count(*) AS items, count(*) FILTER (stale) AS stale FROM s GROUP BY label",
    "switch_table": """WITH v AS (SELECT l_partkey AS name, l_suppkey AS file, CASE WHEN l_partkey % 4 = 0 THEN '7' WHEN l_linenumber % 3 = 0 THEN 'unset' WHEN l_partkey % 4 = 1 AND l_linenumber % 3 = 1 THEN 'derived'
          WHEN l_partkey % 4 = 2 THEN 'unset' ELSE (l_quantity::BIGINT % 9)::VARCHAR END AS value FROM lineitem),
        a AS (SELECT name, count(*) AS sites, count(DISTINCT file) AS files, min(value) FILTER (value NOT IN ('unset', 'derived')) AS low, max(value) FILTER (value NOT IN ('unset', 'derived')) AS high, bool_or(value = 'unset') AS u, bool_or(value = 'derived') AS d FROM v GROUP BY name)
        SELECT name, sites, files, CASE WHEN low < high THEN 'conflict:' || low || '|' || high WHEN low IS NOT NULL THEN low WHEN u AND NOT d THEN 'unset' ELSE 'derived' END AS "default" FROM a""",
    "profile_lines": f"""WITH {_LINES} SELECT n AS line_no, 'not KEY=value: ' || t AS problem FROM l WHERE t NOT LIKE '#%' AND strpos(t, '=') = 0
        UNION ALL SELECT n, 'duplicate key ' || k.name FROM k JOIN s ON s.name = k.name AND k.n > s.first""",
    "profile_problems": f"""WITH {_LINES} SELECT name, 'unknown switch' AS problem FROM s WHERE name NOT IN (SELECT name FROM g) AND NOT starts_with(name, 'FI_') AND name <> 'LAUNCH_LINE_KEYS'
        UNION ALL SELECT name, 'still to fill' FROM s WHERE value = '__FILL__'
        UNION ALL SELECT x, 'on the launch line but not set' FROM (SELECT DISTINCT unnest(string_split(value, ' ')) AS x FROM s WHERE name = 'LAUNCH_LINE_KEYS') WHERE x NOT IN (SELECT name FROM s WHERE value <> '__FILL__')""",
    "profile_drift": f"WITH {_DRIFT} SELECT * FROM c",
    "drift_counts": f"WITH {_DRIFT} SELECT class, count(*) AS settings FROM c GROUP BY class",
    "config_line": f"""WITH {_LINES} SELECT count(*) AS settings, count(*) FILTER (name NOT IN (SELECT name FROM g)) AS unknown,
        substr(sha256(string_agg(sha256(name || '=' || value), chr(10) ORDER BY sha256(name || '=' || value))), 1, 16) AS digest FROM s""",
    "filled_template": """WITH f AS (SELECT l_partkey AS name, max(l_suppkey) AS s FROM lineitem GROUP BY l_partkey),
        v AS (SELECT name, CASE WHEN s % 4 = 0 THEN 'NA' WHEN s % 7 = 0 THEN 'missing tool' WHEN s % 5 <> 0 THEN s::VARCHAR END AS value FROM f),
        j AS (SELECT p_partkey + 5 AS name, v.name IS NOT NULL AS there, value, coalesce(value NOT IN ('NA', 'missing tool'), FALSE) AS good FROM part LEFT JOIN v ON v.name = p_partkey + 5)
        SELECT name, CASE WHEN good THEN value ELSE '__FILL__' END AS value, CASE WHEN good THEN NULL WHEN NOT there THEN 'no such fact' ELSE 'no value: ' || coalesce(value, 'null') END AS reason FROM j""",
    "undeclared": "SELECT l_suppkey, count(*) AS uses FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 0) GROUP BY l_suppkey",
    "phase_table": """WITH r AS (SELECT l_quantity::INT AS size, round(l_extendedprice * 100) AS total, l_linenumber AS n, CASE WHEN l_linenumber > 1 THEN floor(round(l_extendedprice * 100) * 0.125::DOUBLE) END AS start,
          floor(round(l_extendedprice * 100) * 0.25::DOUBLE) AS bs, floor(round(l_extendedprice * 100) * 0.5::DOUBLE) AS dm FROM lineitem),
        a AS (SELECT size, avg(bs) AS bs, avg(dm) AS dm, sum(total * n) / sum(n) AS wall, sum(start * n) / sum(n) FILTER (start IS NOT NULL) AS init FROM r GROUP BY size)
        SELECT size, round(bs, 4) AS bs, round(dm, 4) AS dm, round(wall, 4) AS wall, round(init, 4) AS init, round(greatest(0, wall - bs - dm - coalesce(init, 0)), 4) AS other FROM a""",
    "residual_table": "SELECT p_partkey, round((900.0::DOUBLE + p_partkey % 200) / p_retailprice - 1, 9) AS residual FROM part",
    "risk_rows": """WITH o AS (SELECT o_custkey % 6 AS b, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS f FROM orders GROUP BY ALL), p AS (SELECT DISTINCT p_size FROM part),
        j AS (SELECT p_size, 'row ' || b AS label, n, f, f / n AS r FROM p JOIN o ON p_size BETWEEN (b * 8 + 1) * 0.99::DOUBLE AND (b * 8 + 12) * 1.01::DOUBLE),
        w AS (SELECT *, (r + 3.8416 / (2 * n)) / (1 + 3.8416 / n) AS m, 1.96 * sqrt(r * (1 - r) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n) AS h FROM j)
        SELECT p_size, label, n AS runs, f AS failures, round(r, 9) AS rate, round(m - h, 9)::DOUBLE AS rate_low, round(m + h, 9)::DOUBLE AS rate_high, round(CASE WHEN f < n THEN 1 / (1 - r) END, 9) AS attempts FROM w""",
    "relative_differences": """WITH l AS (SELECT l_partkey AS part, max(round(l_extendedprice / l_quantity)) AS b FROM lineitem GROUP BY l_partkey),
        j AS (SELECT coalesce(p_partkey, part) AS part, round(p_retailprice) AS a, b FROM part FULL JOIN l ON part = p_partkey)
        SELECT part, round(CASE WHEN a = b THEN 0 ELSE abs(a - b) / abs(b) END, 9) AS difference, coalesce(CASE WHEN a = b THEN 0 ELSE abs(a - b) / abs(b) END <= 0.05, FALSE) AS ok FROM j""",
}
