"""More queries of the number, log and placement operators over the test tables, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.counts import count_column
from .operators import analytics as an
from .operators import manifest as mf
from .operators import numbers as nb
from .operators import order as od
from .operators import products as pr
from .operators import residues as rs
from .operators import series as se
from .operators import topology as tp
from .operators import words as wd
from .oracles import _TWO, E_TEXT
from .plans import grids
from .registry import LARGE_PRIME, SMALL_PRIME, _cents, _two_numbers
from .sources import digits as dg
from .sources import logs as lg
from .sources.packed import part_ranges
from .streaming import monitors as mo


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark, sf_dir):
    return _two_numbers(spark, sf_dir)[0]


def number_shift(spark, sf_dir):
    """The orders' number times base^3, and the whole part of it over base^2."""
    a = _orders(spark, sf_dir)
    return nb.shifted(a, 3).withColumn("num", F.lit("up")).unionByName(nb.shifted(a, -2).withColumn("num", F.lit("down")))


def _zeros(spark, sf_dir):
    """Numbers by nation with zero limbs for most of their low positions."""
    c = _t(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").cast("string").alias("num"), F.expr("c_custkey div 25").cast("long").alias("idx"), F.when(F.col("c_custkey") % 7 == 0, F.abs(_cents("c_acctbal")) % nb.BASE).otherwise(0).cast("long").alias("limb")).groupBy("num", "idx").agg(F.max("limb").alias("limb"))


def any_below(spark, sf_dir):
    return nb.any_below(_zeros(spark, sf_dir), 5)


def limb_point(spark, sf_dir):
    """The limbs at position 3 after it was set to 42 where the number has one."""
    return nb.limb_at(nb.with_limb(_zeros(spark, sf_dir), 3, 42), 3)


def number_complement(spark, sf_dir):
    """base^e less the customers' number, for e over its length."""
    b = _two_numbers(spark, sf_dir)[1]
    return nb.complement(b, _t(spark, sf_dir, "customer").count() + 2)


def plus_small(spark, sf_dir):
    """The orders' number with 999999 added at its lowest position."""
    return nb.plus_small(_orders(spark, sf_dir), 999_999)


def _residue_rows(df):
    r = rs.limbs_mod(df, [SMALL_PRIME, LARGE_PRIME])
    return r.select("num", F.col("r0").cast("string").alias("r0"), F.col("r1").cast("string").alias("r1"))


def product_plus(spark, sf_dir):
    """The product of the orders' and the customers' number plus the orders' number: its residues."""
    a, b = _two_numbers(spark, sf_dir)
    return _residue_rows(pr.multiplied(a, b, plus=a))


def product_checked(spark, sf_dir):
    """The same without the addend, accepted by residues: its residues."""
    return _residue_rows(pr.checked_product(*_two_numbers(spark, sf_dir), list(rs.CHECK_PRIMES[:2])))


def product_low(spark, sf_dir):
    """The product modulo base^60."""
    a, b = _two_numbers(spark, sf_dir)
    return _residue_rows(pr.multiplied(a, b, high=60, size=32))


def product_band(spark, sf_dir):
    """The middle of the product of the two numbers: only pairs of blocks that reach the limbs from 64 to 159."""
    a, b = _two_numbers(spark, sf_dir)
    return _residue_rows(pr.multiplied(a, b, low=64, high=160, size=32))


def modular_inverses(spark, sf_dir):
    """The inverses of the orders' prices in cents less a million, of any sign, modulo two primes (null where there is none)."""
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", (_cents("o_totalprice") - 1_000_000).alias("x"))
    return rows.select("o_orderkey", *[rs.inversemod(rs.canonical(F.col("x"), q), q).cast("string").alias(f"inv{i}") for i, q in enumerate((SMALL_PRIME, LARGE_PRIME))])


def product_cyclic(spark, sf_dir):
    """The product of the customers' and the suppliers' number modulo base^50 - 1."""
    b = _two_numbers(spark, sf_dir)[1]
    s = od.indexed(_t(spark, sf_dir, "supplier").select("s_suppkey", (F.abs(_cents("s_acctbal")) % nb.BASE).alias("limb")), ["s_suppkey"]).select(F.lit("s").alias("num"), "idx", "limb")
    return nb.folded(pr.multiplied(b, s, cycle=50), 50)


def divided_by_word(spark, sf_dir):
    """For each nation, the number of its customers' balances over a prime: the quotient's limbs, and the remainder beside them."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("num"), "c_custkey", (F.abs(_cents("c_acctbal")) % nb.BASE).alias("limb"))
    quotient, rest = wd.divided_by_word(od.indexed_within(c, ["num"], ["c_custkey"]), SMALL_PRIME)
    return quotient.join(rest, "num")


def digit_blocks(spark, sf_dir):
    """SHA-256 of each 400 digits of the orders' number, the most significant first."""
    n = _t(spark, sf_dir, "orders").count()
    return dg.block_digests(dg.digit_chunks(_orders(spark, sf_dir), nb.DIGITS * n, 50), 8)


def number_committed(spark, sf_dir):
    """The orders' number written in 24 committed parts, 999999 added to it there as a new version, and read back."""
    from .operators import longnums as ln
    from .operators.storage import fresh_path
    from .sources import committed as cm

    path = fresh_path(spark, "number")
    cm.save(ln.packed(_orders(spark, sf_dir)), path, 24)
    cm.correct(spark, path, 999_999)
    return ln.unpacked(ln.stored(cm.read(spark, path).select("num", "chunk", "data", "top"), "number"))


def product_redone(spark, sf_dir):
    """The product of the two numbers in pieces, of which one is spoiled at first: residues of the product, and how many pieces were made again."""
    from .operators import longnums as ln
    from .operators import recovery as rv

    def spoiled(places, attempt):
        wrong = (F.col("num") == "s|0") & (F.col("chunk") == 0)
        return places if attempt else places.withColumn("data", F.when(wrong, F.lit(bytes(4 * nb.CHUNK))).otherwise(F.col("data")))

    product, made = rv.product_in_pieces(*(ln.packed(n) for n in _two_numbers(spark, sf_dir)), 1 << 16, fault=spoiled)
    out = ln.residues(product, [SMALL_PRIME, LARGE_PRIME])
    return out.select("num", F.col("r0").cast("string").alias("r0"), F.col("r1").cast("string").alias("r1"), F.lit(sum(made[1:])).alias("again"))


def regrouped_points(spark, sf_dir):
    """The orders' number in points of 15 digits, by windows of 30 digits."""
    out = nb.regrouped(_orders(spark, sf_dir), 6, 15)
    return out.select("num", "idx", F.col("value").cast("string").alias("value"))


def number_division(spark, sf_dir):
    """The orders' number over the customers': of quotient X and remainder R, X b + R modulo two primes, and whether R < b."""
    from .operators import division as dv
    from .operators import longnums as ln

    a, b = (ln.packed(n) for n in _two_numbers(spark, sf_dir))
    x, r = dv.divided(a, b)
    primes = [SMALL_PRIME, LARGE_PRIME]
    q, d, e = (ln.residues(n, primes) for n in (x, b, r))
    both = q.alias("x").join(d.alias("b"), "num").join(e.alias("r"), "num")
    sums = [((rs.mulmod(F.col(f"x.r{i}"), F.col(f"b.r{i}"), p) + F.col(f"r.r{i}")).cast(rs.PRODUCT) % F.lit(p).cast(rs.WIDE)).cast(rs.WIDE).cast("string").alias(f"r{i}") for i, p in enumerate(primes)]
    less = ln.compared(r, b).select("num", (F.col("cmp") < 0).alias("less"))
    return both.select("num", *sums).join(less, "num")


def many_products(spark, sf_dir):
    """A product for every line item: the price in cents, squared, by the order's and the part's key."""
    li = _t(spark, sf_dir, "lineitem")
    pair = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pair_id")
    return pr.multiply_many(li.select(pair, (_cents("l_extendedprice") * 1_000_003 + F.col("l_orderkey")).cast("string").alias("a"), (_cents("l_extendedprice") * 7 + F.col("l_partkey")).cast("string").alias("b")))


def grid_search(spark, sf_dir):
    """The grids of pieces of the product of the two numbers, of at most a quarter of its points a piece, with their costs."""
    na, nb_ = _t(spark, sf_dir, "orders").count(), _t(spark, sf_dir, "customer").count()
    return grids.grid_table(spark, na, nb_, (na + nb_) // 4)


def part_plan(spark, sf_dir):
    """The 24 parts of a file of the orders' number: limbs of 18 digits, digits, and the sum of the number's own limbs in each."""
    o = _orders(spark, sf_dir)
    n = _t(spark, sf_dir, "orders").count()
    parts = part_ranges(nb.DIGITS * n, 24)
    nl = parts[0]["nl"]
    rank = F.expr(f"((idx div 3 + 1) * 24 - 1) div {nl}")
    sums = o.groupBy((23 - rank).alias("part")).agg(F.sum("limb").alias("total"), F.count(F.lit(1)).alias("limbs"))
    plan = spark.createDataFrame(parts, "part long, nparts long, nl long, pad long, lo long, hi long, k0 long, k1 long")
    return plan.join(sums, "part")


def digit_counts(spark, sf_dir):
    """Counts written plainly and in scientific notation: their values, null where they are none."""
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    text = (
        F.when(k % 7 == 0, F.concat(s(k % 100), F.lit("e"), s(k % 12)))
        .when(k % 7 == 1, F.concat(s(k % 10), F.lit("."), s(k % 1000), F.lit("e"), s(k % 6)))
        .when(k % 7 == 2, F.concat(F.lit("-"), s(k)))
        .when(k % 7 == 3, F.concat(s(k), F.lit(".5")))
        .when(k % 7 == 4, F.concat(F.lit("00"), s(k % 3)))
        .when(k % 7 == 5, F.concat(s(k % 50), F.lit("E+"), s(k % 5)))
        .otherwise(s(k))
    )
    return _t(spark, sf_dir, "orders").select(k.alias("id"), text.alias("text")).select("id", "text", count_column(F.col("text")).cast("string").alias("value"))


def last_wins(spark, sf_dir):
    """The last type of each user's events."""
    e = _t(spark, sf_dir, "events")
    return an.last_wins(e.select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id")


def sample_windows(spark, sf_dir):
    """Least, most and number of values by type in windows of an hour, with an alert below 1."""
    out = mo.sample_windows(_t(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value", "event_type"), key="event_type", width="1 hour", guard=1.0)
    return out.select("event_type", F.unix_timestamp("start").alias("start"), "low", "high", "n", "alert")


def high_water(spark, sf_dir):
    """How far a user's values fell below the first."""
    return mo.high_water(_t(spark, sf_dir, "events").withColumn("_o", F.col("event_id")), "user_id", "_o", "value").select("user_id", F.round("drop", 6).alias("drop"))


def rollup_max(spark, sf_dir):
    """Largest balance and key by region of a customer's nation; nations of the first region count for themselves."""
    unit = F.when(F.col("n_regionkey") > 0, F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))  # null: none
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("nation"), unit.alias("unit"))
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("nation"), "c_acctbal", "c_custkey")
    return an.rollup_max(c, n, "nation", "unit", ["c_acctbal", "c_custkey"])


def first_lines(spark, sf_dir):
    """The first two events of each user, as lines of 12 letters."""
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("line"))
    return an.first_lines(e, ["user_id"], "event_id", "line", 2, 12)


def zipped_columns(spark, sf_dir):
    """Suppliers' balances and keys, each sorted on its own."""
    return an.zipped_columns(_t(spark, sf_dir, "supplier").select("s_acctbal", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey")).alias("s_suppkey")), ["s_acctbal", "s_suppkey"])


def physical_keys(spark, sf_dir):
    k = F.col("c_custkey")
    part = lambda c: c.cast("string")
    name = F.when(k % 9 == 0, F.concat(F.lit("login"), part(k))).otherwise(F.concat(F.lit("x"), part(k % 20), F.lit("c"), part(k % 8), F.lit("s"), part(k % 5), F.lit("b"), part(k % 3), F.lit("n"), part(k % 2)))
    return _t(spark, sf_dir, "customer").select(k.alias("id"), *tp.physical_key(name))


def state_flags(spark, sf_dir):
    """Orders as nodes whose states are made of their status and priority."""
    base = F.element_at(F.array(*[F.lit(s) for s in ("IDLE", "ALLOCATED", "MIXED", "DOWN", "idle", "COMPLETING", "")]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    more = F.element_at(F.array(*[F.lit(s) for s in ("", "+DRAIN", "+RESERVED", "*", "+CLOUD$")]), (F.col("o_custkey") % 5 + 1).cast("int"))
    usable, idle, busy = tp.state_flags(F.concat(base, more))
    return _t(spark, sf_dir, "orders").select("o_orderkey", usable.alias("usable"), idle.alias("idle"), busy.alias("busy"))


def _items(spark, sf_dir):
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    deps = F.array_compact(F.array(F.when(k % 4 == 0, F.concat(F.lit("i"), s(k - 1))), F.when(k % 10 == 0, F.concat(F.lit("i"), s(k + 3))), F.when(k % 33 == 0, F.concat(F.lit("i"), s(k)))))
    name = F.when(k % 50 == 0, F.concat(F.lit("I "), s(k))).when(k % 47 == 0, F.concat(F.lit("i"), s(k - 1))).otherwise(F.concat(F.lit("i"), s(k)))
    return _t(spark, sf_dir, "part").select(name.alias("id"), (k % 3 + F.when(k % 5 == 0, 0).otherwise(1)).cast("int").alias("tier"), (F.col("p_size") - 2).cast("int").alias("nodes"), (F.col("p_size") % 45).cast("int").alias("est_min"), deps.alias("deps"), F.concat(F.lit("s"), s(k % 12)).alias("script"), (k % 17).cast("int").alias("prio"), k.alias("key"))


def manifest_problems(spark, sf_dir):
    """What is wrong with a work list of parts."""
    kind = F.when(F.col("n_nationkey") < 11, "s").otherwise("old-s")
    scripts = _t(spark, sf_dir, "nation").select(F.concat(kind, F.col("n_nationkey").cast("string")).alias("script"))
    return mf.problems(_items(spark, sf_dir), "^[a-z][0-9]+$", scripts)


def eligible_items(spark, sf_dir):
    """Items of the work list that can start, and why the others cannot."""
    k = F.col("p_partkey")
    # a part in three has no state yet
    states = _t(spark, sf_dir, "part").select(F.concat(F.lit("i"), k.cast("string")).alias("id"), F.when(k % 3 == 1, "done").when((k % 3 == 2) & (k % 2 == 0), "claimed").when(k % 3 == 2, "unclaimed").alias("state"), F.when(k % 3 == 0, None).when(k % 5 == 0, "FAIL").when(k % 5 == 1, "PARTIAL").otherwise("PASS").alias("status"))
    # of items with one id that of the least key
    every = _items(spark, sf_dir).where("id like 'i%'")
    items = every.groupBy("id").agg(F.min_by(F.struct(*[c for c in every.columns if c != "id"]), "key").alias("row")).select("id", "row.*")
    return mf.eligible(items, states, 30, 35.0, tier=2)


def name_suggestions(spark, sf_dir):
    """Known nations near names with a letter changed or left out."""
    n = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    wrong = n.select(F.concat(F.substring("name", 1, 2), F.lit("x"), F.expr("substring(name, 4)")).alias("name")).unionByName(n.select(F.expr("substring(name, 2)").alias("name")))
    return mf.suggestions(wrong, n).select("name", F.array_join("near", ",").alias("near"))


def cited_items(spark, sf_dir):
    """Numbers of two to four digits that documents cite and no part has as its key, with how often."""
    from .operators.reports import undeclared

    lines = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_no"), F.col("text").alias("value"))
    cited = lg.cited_names(lines, r"\b([1-9][0-9]{1,3})\b").select(F.col("name").cast("long").alias("name"))
    return undeclared(cited, _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("name")), "name")


def t1_identity(spark, sf_dir):
    """For as many decimals as there are customers: X Q + R modulo eight primes, of the digits X of e, the
    remainder R and the tree's Q, whether 10^d (P + Q) of the recurrence is the same; and 0 <= R < Q."""
    return se.identity_of_e(spark, _t(spark, sf_dir, "customer").count(), list(rs.CHECK_PRIMES))


def e_windows(spark, sf_dir):
    """Known windows of the decimals of e against as many of them as there are customers; the last runs over the end."""
    d = _t(spark, sf_dir, "customer").count()
    windows = spark.createDataFrame([*KNOWN_WINDOWS, (d - 10, "0" * 50)], "off long, w string")
    return dg.check_windows(dg.digit_chunks(se.e_digits(spark, d), d + 1, 64), windows, 64)


#: 50 decimals of e from a position on (the first digit has position 0); the third is wrong on purpose.
KNOWN_WINDOWS = [
    (0, "27182818284590452353602874713526624977572470936999"),
    (50, "59574966967627724076630353547594571382178525166427"),
    (100, "42746639193200305992181741359662904357290033429527"),
]

QUERIES = (
    number_shift, any_below, limb_point, number_complement, plus_small, product_plus, product_checked, product_low, product_band, modular_inverses, product_cyclic, divided_by_word, digit_blocks, number_committed, product_redone, regrouped_points, number_division, many_products, grid_search, part_plan,
    digit_counts, last_wins, sample_windows, high_water, rollup_max, first_lines, zipped_columns, physical_keys, state_flags, manifest_problems,
    eligible_items, name_suggestions, cited_items, t1_identity, e_windows,
)

_ZEROS = "z AS (SELECT c_nationkey::VARCHAR AS num, (c_custkey // 25)::BIGINT AS idx, max(CASE WHEN c_custkey % 7 = 0 THEN abs(round(c_acctbal * 100)::BIGINT) % 1000000 ELSE 0 END)::BIGINT AS limb FROM customer GROUP BY ALL)"


def _mod(items: str, q: int) -> str:
    return f"list_reduce({items}, lambda acc, x: (acc * 1000000::HUGEINT + x) % {q}::HUGEINT)"


def _product_sql(plus: bool) -> str:
    out = [f"(({_mod('x', q)}) * ({_mod('y', q)}) % {q}::HUGEINT {f'+ ({_mod("x", q)})' if plus else ''}) % {q}::HUGEINT" for q in (SMALL_PRIME, LARGE_PRIME)]
    return f"""WITH {_TWO},
        x AS (SELECT list_prepend(0::HUGEINT, list(limb::HUGEINT ORDER BY idx DESC)) AS x FROM a), y AS (SELECT list_prepend(0::HUGEINT, list(limb::HUGEINT ORDER BY idx DESC)) AS y FROM b)
        SELECT 's' AS num, ({out[0]})::VARCHAR AS r0, ({out[1]})::VARCHAR AS r1 FROM x, y"""


def _inverse_sql(q: int) -> str:
    bits = ", ".join(f"{bit}::HUGEINT" for bit in f"{q - 2:b}"[1:])  # the first bit is x itself
    x = f"((((v % {q}) + {q}) % {q})::HUGEINT)"
    return f"CASE WHEN {x} <> 0 THEN list_reduce([{x}, {bits}], lambda acc, bit: (acc * acc % {q}::HUGEINT) * (CASE WHEN bit = 1 THEN {x} ELSE 1::HUGEINT END) % {q}::HUGEINT)::VARCHAR END"


_ITEMS = """i AS (SELECT CASE WHEN p_partkey % 50 = 0 THEN 'I ' || p_partkey WHEN p_partkey % 47 = 0 THEN 'i' || (p_partkey - 1) ELSE 'i' || p_partkey END AS id, p_partkey % 3 + CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END AS tier,
    p_size - 2 AS nodes, p_size % 45 AS est, list_filter([CASE WHEN p_partkey % 4 = 0 THEN 'i' || (p_partkey - 1) END, CASE WHEN p_partkey % 10 = 0 THEN 'i' || (p_partkey + 3) END, CASE WHEN p_partkey % 33 = 0 THEN 'i' || p_partkey END], lambda x: x IS NOT NULL) AS deps,
    's' || (p_partkey % 12) AS script, (p_partkey % 17)::INT AS prio, p_partkey AS k FROM part)"""

SQL = {
    "number_shift": f"""WITH {_TWO} SELECT 'up' AS num, (idx + 3)::BIGINT AS idx, limb::BIGINT AS limb FROM a UNION ALL SELECT 'up', unnest(range(3)), 0
        UNION ALL SELECT 'down', idx - 2, limb FROM a WHERE idx >= 2""",
    "any_below": f"WITH {_ZEROS} SELECT num, coalesce(bool_or(limb <> 0 AND idx < 5), FALSE) AS found FROM z GROUP BY num",
    "limb_point": f"WITH {_ZEROS} SELECT num, idx, 42::BIGINT AS limb FROM z WHERE idx = 3",
    "number_complement": f"""WITH {_TWO}, n AS (SELECT count(*) AS n, min(idx) FILTER (limb <> 0) AS low FROM b),
        c AS (SELECT unnest(range(n + 2)) AS idx, low FROM n),
        d AS (SELECT c.idx, CASE WHEN c.idx < low THEN 0 WHEN c.idx = low THEN 1000000 - limb ELSE 999999 - coalesce(limb, 0) END AS limb FROM c LEFT JOIN b ON b.idx = c.idx)
        SELECT 's' AS num, idx::BIGINT AS idx, limb::BIGINT AS limb FROM d WHERE idx <= (SELECT max(idx) FROM d WHERE limb <> 0)""",
    "plus_small": f"""WITH {_TWO}, s AS (SELECT idx, limb + CASE WHEN idx = 0 THEN 999999 ELSE 0 END AS v FROM a UNION ALL SELECT max(idx) + 1, 0 FROM a),
        f AS (SELECT *, CASE WHEN v >= 1000000 THEN 1 WHEN v < 999999 THEN 0 END AS flag FROM s),
        c AS (SELECT idx, (v + coalesce(last_value(flag IGNORE NULLS) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 1000000 AS limb FROM f)
        SELECT 's' AS num, idx::BIGINT AS idx, limb::BIGINT AS limb FROM c WHERE idx <= (SELECT max(idx) FROM c WHERE limb <> 0)""",
    "product_plus": _product_sql(True),
    "product_checked": _product_sql(False),
    "product_redone": f"SELECT *, 1 AS again FROM ({_product_sql(False)})",
    "regrouped_points": f"""WITH {_TWO}, d AS (SELECT idx // 5 AS w, string_agg(lpad(limb::VARCHAR, 6, '0'), '' ORDER BY idx DESC) AS t FROM a GROUP BY ALL),
        p AS (SELECT w, lpad(t, 30, '0') AS t, length(t) AS n FROM d)
        SELECT 's' AS num, (2 * w)::BIGINT AS idx, substr(t, 16)::BIGINT::VARCHAR AS value FROM p UNION ALL SELECT 's', 2 * w + 1, substr(t, 1, 15)::BIGINT::VARCHAR FROM p WHERE n > 15""",
    "number_division": f"""WITH {_TWO}, x AS (SELECT list_prepend(0::HUGEINT, list(limb::HUGEINT ORDER BY idx DESC)) AS x FROM a)
        SELECT 's' AS num, ({_mod("x", SMALL_PRIME)})::VARCHAR AS r0, ({_mod("x", LARGE_PRIME)})::VARCHAR AS r1, TRUE AS less FROM x""",
    "product_low": f"""WITH RECURSIVE {_TWO}, p AS (SELECT a.idx + b.idx AS k, sum(a.limb::HUGEINT * b.limb)::HUGEINT AS v FROM a JOIN b ON a.idx + b.idx < 60 GROUP BY ALL),
        c AS (SELECT 0::BIGINT AS k, (v % 1000000)::HUGEINT AS limb, v // 1000000 AS carry FROM p WHERE k = 0 UNION ALL SELECT c.k + 1, (p.v + c.carry) % 1000000, (p.v + c.carry) // 1000000 FROM c JOIN p ON p.k = c.k + 1),
        x AS (SELECT list_prepend(0::HUGEINT, list(limb ORDER BY k DESC)) AS x FROM c)
        SELECT 's' AS num, ({_mod('x', SMALL_PRIME)})::VARCHAR AS r0, ({_mod('x', LARGE_PRIME)})::VARCHAR AS r1 FROM x""",
    "product_band": f"""WITH RECURSIVE {_TWO}, p AS (SELECT a.idx + b.idx AS k, sum(a.limb::HUGEINT * b.limb)::HUGEINT AS v FROM a JOIN b ON (a.idx // 32 + b.idx // 32 + 2) * 32 > 64 AND (a.idx // 32 + b.idx // 32) * 32 < 160 AND a.idx + b.idx < 160 GROUP BY ALL),
        c AS (SELECT 32::BIGINT AS k, (v % 1000000)::HUGEINT AS limb, v // 1000000 AS carry FROM p WHERE k = 32 UNION ALL SELECT c.k + 1, (p.v + c.carry) % 1000000, (p.v + c.carry) // 1000000 FROM c JOIN p ON p.k = c.k + 1),
        x AS (SELECT list_prepend(0::HUGEINT, list_concat(list(limb ORDER BY k DESC), list_transform(range(32), lambda i: 0::HUGEINT))) AS x FROM c)
        SELECT 's' AS num, ({_mod('x', SMALL_PRIME)})::VARCHAR AS r0, ({_mod('x', LARGE_PRIME)})::VARCHAR AS r1 FROM x""",
    "modular_inverses": f"""WITH o AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT - 1000000 AS v FROM orders)
        SELECT o_orderkey, {_inverse_sql(SMALL_PRIME)} AS inv0, {_inverse_sql(LARGE_PRIME)} AS inv1 FROM o""",
    "product_cyclic": f"""WITH RECURSIVE {_TWO}, s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS idx, abs(round(s_acctbal * 100)::BIGINT) % 1000000 AS limb FROM supplier),
        p AS (SELECT (b.idx + s.idx) % 50 AS k, sum(b.limb::HUGEINT * s.limb)::HUGEINT AS v FROM b, s GROUP BY ALL),
        l AS (SELECT list(v ORDER BY k) AS x FROM p),
        c AS (SELECT 0 AS t, x, 0::HUGEINT AS carry FROM l
              UNION ALL SELECT t + 1, list_transform(x, lambda v, i: CASE WHEN i = t % 50 + 1 THEN (v + carry) % 1000000 ELSE v END), (x[t % 50 + 1] + carry) // 1000000
              FROM c WHERE t < 250),
        f AS (SELECT unnest(range(50)) AS idx, unnest(x) AS limb FROM c WHERE t = 250)
        SELECT 's' AS num, idx::BIGINT AS idx, limb::BIGINT AS limb FROM f WHERE idx <= (SELECT max(idx) FROM f WHERE limb <> 0)""",
    "divided_by_word": f"""WITH b AS (SELECT c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS idx, abs(round(c_acctbal * 100)::BIGINT) % 1000000 AS limb FROM customer),
        l AS (SELECT k, count(*) AS n, list_prepend({{'r': 0::HUGEINT, 'q': []::BIGINT[]}}, list({{'r': limb::HUGEINT, 'q': []::BIGINT[]}} ORDER BY idx DESC)) AS x FROM b GROUP BY k),
        f AS (SELECT k, n, list_reduce(x, lambda a, y: {{'r': (a.r * 1000000 + y.r) % {SMALL_PRIME}, 'q': list_append(a.q, ((a.r * 1000000 + y.r) // {SMALL_PRIME})::BIGINT)}}) AS z FROM l),
        u AS (SELECT k, z.r AS r, unnest(z.q) AS limb, unnest(range(n - 1, -1, -1)) AS idx FROM f),
        t AS (SELECT k, coalesce(max(idx) FILTER (limb <> 0), 0) AS top FROM u GROUP BY k)
        SELECT u.k::VARCHAR AS num, idx::BIGINT AS idx, limb, r::BIGINT AS remainder FROM u JOIN t ON u.k = t.k WHERE idx <= top""",
    "digit_blocks": f"""WITH {_TWO}, t AS (SELECT string_agg(lpad(limb::VARCHAR, 6, '0'), '' ORDER BY idx DESC) AS t FROM a)
        SELECT block, sha256(substr(t, 400 * block + 1, 400)) AS sha256 FROM t, (SELECT unnest(range((SELECT ceil(length(t) / 400)::BIGINT FROM t))) AS block)""",
    "many_products": """SELECT l_orderkey * 10 + l_linenumber AS pair_id, ((round(l_extendedprice * 100)::HUGEINT * 1000003 + l_orderkey) * (round(l_extendedprice * 100)::HUGEINT * 7 + l_partkey))::VARCHAR AS product FROM lineitem""",
    "grid_search": """WITH n AS (SELECT (SELECT count(*) FROM orders) AS na, (SELECT count(*) FROM customer) AS nb),
        g AS (SELECT ka, kb, (ceil(na / ka) + ceil(nb / kb))::BIGINT AS points, ka * kb AS pieces, (na + nb) // 4 AS cap FROM n, (SELECT unnest(range(1, 33)) AS ka), (SELECT unnest(range(1, 33)) AS kb))
        SELECT ka, kb, points, pieces, pieces * (2 ** ceil(log2(points)))::BIGINT AS cost FROM g WHERE points <= cap""",
    "part_plan": f"""WITH {_TWO}, n AS (SELECT ceil(count(*) / 3)::BIGINT AS nl, ceil(count(*) / 3)::BIGINT * 18 - 6 * count(*) AS pad FROM a),
        r AS (SELECT part, 24::BIGINT AS nparts, nl, pad, nl * (23 - part) // 24 AS lo, nl * (24 - part) // 24 AS hi FROM n, (SELECT unnest(range(24)) AS part))
        SELECT r.*, greatest(0, (nl - hi) * 18 - pad) AS k0, (nl - lo) * 18 - pad AS k1, sum(limb)::BIGINT AS total, count(*) AS limbs FROM r JOIN a ON a.idx // 3 >= lo AND a.idx // 3 < hi GROUP BY ALL""",
    "digit_counts": """WITH o AS (SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN (o_orderkey % 100) || 'e' || (o_orderkey % 12) WHEN 1 THEN (o_orderkey % 10) || '.' || (o_orderkey % 1000) || 'e' || (o_orderkey % 6)
          WHEN 2 THEN '-' || o_orderkey WHEN 3 THEN o_orderkey || '.5' WHEN 4 THEN '00' || (o_orderkey % 3) WHEN 5 THEN (o_orderkey % 50) || 'E+' || (o_orderkey % 5) ELSE o_orderkey::VARCHAR END AS text FROM orders),
        p AS (SELECT *, regexp_full_match(text, '[0-9]+([.][0-9]+)?([eE][+]?[0-9]+)?') AND (strpos(text, '.') = 0 OR regexp_matches(text, '[eE]')) AS ok, regexp_extract(text, '^([0-9]+)', 1) AS w, regexp_extract(text, '[.]([0-9]+)', 1) AS f, coalesce(try_cast(regexp_extract(text, '[eE][+]?([0-9]+)$', 1) AS INT), 0) AS e FROM o),
        v AS (SELECT *, CASE WHEN ok THEN (w || f)::HUGEINT END AS d, e - length(f) AS shift FROM p)
        SELECT id, text, CASE WHEN d > 0 AND shift >= 0 THEN (d * (10::HUGEINT ** shift)::HUGEINT)::VARCHAR WHEN d > 0 AND d % (10::HUGEINT ** -shift)::HUGEINT = 0 THEN (d // (10::HUGEINT ** -shift)::HUGEINT)::VARCHAR END AS value FROM v""",
    "last_wins": "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "sample_windows": "SELECT event_type, (floor(epoch(ts::TIMESTAMP) / 3600) * 3600)::BIGINT AS start, min(value) AS low, max(value) AS high, count(*) AS n, min(value) < 1 AS alert FROM events GROUP BY ALL",
    "high_water": "SELECT user_id, round(arg_min(value, event_id) - min(value), 6) AS \"drop\" FROM events GROUP BY user_id",
    "rollup_max": """SELECT CASE WHEN n_regionkey > 0 THEN 'r' || n_regionkey ELSE c_nationkey::VARCHAR END AS unit, max(c_acctbal) AS c_acctbal, max(c_custkey) AS c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""",
    "first_lines": """SELECT user_id, event_id, line FROM (SELECT user_id, event_id, substr(event_type || ' ' || event_id, 1, 12) AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 2""",
    "zipped_columns": """WITH a AS (SELECT row_number() OVER (ORDER BY s_acctbal) AS r, s_acctbal FROM supplier), b AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS r, s_suppkey FROM supplier WHERE s_suppkey % 3 > 0)
        SELECT coalesce(a.r, b.r)::INT AS row, s_acctbal, s_suppkey FROM a FULL JOIN b ON a.r = b.r""",
    "physical_keys": """SELECT c_custkey AS id, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 20 END AS cab, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 8 END AS chassis, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 5 END AS slot,
        CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 3 END AS blade, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 2 END AS node FROM customer""",
    "state_flags": """WITH s AS (SELECT o_orderkey, ['IDLE', 'ALLOCATED', 'MIXED', 'DOWN', 'IDLE', 'COMPLETING', ''][o_orderkey % 7 + 1] AS b, ['', 'DRAIN', 'RESERVED', '', 'CLOUD'][o_custkey % 5 + 1] AS f FROM orders),
        u AS (SELECT *, b NOT IN ('', 'DOWN') AND f NOT IN ('DRAIN', 'CLOUD') AS usable FROM s)
        SELECT o_orderkey, usable, usable AND b = 'IDLE' AND f <> 'RESERVED' AS idle, usable AND b IN ('ALLOCATED', 'MIXED', 'COMPLETING') AS busy FROM u""",
    "manifest_problems": f"""WITH {_ITEMS}, e AS (SELECT id, unnest(deps) AS dep FROM i)
        SELECT id, 'duplicate id' AS problem FROM i GROUP BY id HAVING count(*) > 1
        UNION ALL SELECT id, 'bad id' FROM i WHERE NOT regexp_full_match(id, '[a-z][0-9]+')
        UNION ALL SELECT id, 'tier must be 1 or 2' FROM i WHERE tier NOT IN (1, 2)
        UNION ALL SELECT id, 'nodes or est_min out of range' FROM i WHERE nodes < 0 OR est <= 0
        UNION ALL SELECT id, 'depends on itself' FROM i WHERE list_contains(deps, id)
        UNION ALL SELECT id, 'script missing' FROM i WHERE script NOT IN (SELECT 's' || n_nationkey FROM nation WHERE n_nationkey < 11)
        UNION ALL SELECT id, 'unknown id ' || dep FROM e WHERE dep NOT IN (SELECT id FROM i)""",
    "eligible_items": f"""WITH {_ITEMS}, u AS (SELECT id, arg_min(struct_pack(tier, nodes, est, deps, prio, k), k) AS r, count(*) AS n FROM i WHERE id LIKE 'i%' GROUP BY id),
        s AS (SELECT 'i' || p_partkey AS id, CASE WHEN p_partkey % 3 = 1 THEN 'done' WHEN p_partkey % 2 = 0 THEN 'claimed' ELSE 'unclaimed' END AS state, CASE p_partkey % 5 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'PARTIAL' ELSE 'PASS' END AS status FROM part WHERE p_partkey % 3 <> 0),
        t AS (SELECT u.id, r.nodes AS nodes, r.est AS est, r.prio AS prio, r.deps AS deps FROM u LEFT JOIN s ON s.id = u.id WHERE r.tier = 2 AND coalesce(s.state, 'unclaimed') = 'unclaimed'),
        d AS (SELECT t.id, dep, s.state, s.status FROM (SELECT id, unnest(deps) AS dep FROM t) t LEFT JOIN s ON s.id = dep),
        m AS (SELECT id, min(dep) FILTER (state = 'done') AS dead, coalesce(bool_or(state = 'claimed'), FALSE) AS claimed, array_to_string(list_sort(list(DISTINCT dep)), ',') AS lack FROM d WHERE NOT coalesce(state = 'done' AND status IN ('PASS', 'PARTIAL'), FALSE) GROUP BY id)
        SELECT t.id, prio, CASE WHEN nodes > 30 THEN 'needs more nodes' WHEN est > 35 THEN 'needs more time' WHEN dead IS NOT NULL THEN 'dependency ended badly: ' || dead WHEN claimed THEN 'waits for ' || lack
          WHEN lack IS NOT NULL THEN 'waits for unclaimed ' || lack END AS reason FROM t LEFT JOIN m ON m.id = t.id""",
    "name_suggestions": """WITH w AS (SELECT substr(n_name, 1, 2) || 'x' || substr(n_name, 4) AS u FROM nation UNION SELECT substr(n_name, 2) FROM nation),
        d AS (SELECT u, n_name AS k, levenshtein(u, n_name) AS d FROM w, nation WHERE levenshtein(u, n_name) <= 3)
        SELECT u AS name, array_to_string(list_slice(list(k ORDER BY d, k), 1, 2), ',') AS near FROM d GROUP BY u""",
    "cited_items": r"""WITH c AS (SELECT unnest(regexp_extract_all(text, '\b([1-9][0-9]{1,3})\b', 1))::BIGINT AS name FROM documents)
        SELECT name, count(*) AS uses FROM c WHERE name NOT IN (SELECT p_partkey FROM part) GROUP BY name""",
    "t1_identity": f"""WITH n AS (SELECT count(*) AS d FROM customer), m AS (SELECT d, min(m) AS m FROM (SELECT d, unnest(range(1, d + 200)) AS m FROM n) WHERE lgamma(m + 1) / ln(10) >= d + 50 GROUP BY d),
        p AS (SELECT unnest([{", ".join(f"{q}::HUGEINT" for q in rs.CHECK_PRIMES)}]) AS q),
        s AS (SELECT q, list_reduce(list_prepend({{'p': 0::HUGEINT, 'q': 1::HUGEINT, 'k': 0::HUGEINT}}, list_transform(range(1, m + 1), lambda k: {{'p': 0::HUGEINT, 'q': 0::HUGEINT, 'k': k::HUGEINT}})),
            lambda a, x: {{'p': (a.p * x.k + 1) % q, 'q': a.q * x.k % q, 'k': x.k}}) AS z, list_reduce(list_prepend(1::HUGEINT, list_transform(range(d), lambda i: 10::HUGEINT)), lambda a, x: a * x % q) AS ten FROM p, m)
        SELECT q::VARCHAR AS prime, (ten * ((z.p + z.q) % q) % q)::VARCHAR AS value, TRUE AS ok FROM s UNION ALL SELECT 'remainder', NULL, TRUE""",
    "e_windows": f"""WITH RECURSIVE {E_TEXT}, w AS (SELECT * FROM (VALUES {", ".join(f"({off}, '{w}')" for off, w in KNOWN_WINDOWS)}) w(off, w) UNION ALL SELECT d - 10, repeat('0', 50) FROM n)
        SELECT off::BIGINT AS off, CASE WHEN off + 50 <= d + 1 THEN substr(t, off::INT + 1, 50) = w END AS ok FROM w, t""",
}
SQL["number_committed"] = SQL["plus_small"]
