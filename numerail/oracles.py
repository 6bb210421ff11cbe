"""SQL of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from .operators.residues import CHECK_PRIMES

P0, P1 = 998_244_353, CHECK_PRIMES[0]


def _fold(items: str, base: str, q: int) -> str:
    return f"list_reduce({items}, lambda acc, x: (acc * {base} + x) % {q}::HUGEINT)"


_LIMBS = "SELECT l_orderkey, l_linenumber, round(l_extendedprice * 100)::BIGINT AS limb, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * 100)) - 1 AS idx FROM lineitem"
_TWO = """
a AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, round(o_totalprice * 100)::BIGINT % 1000000 AS limb FROM orders),
b AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, abs(round(c_acctbal * 100)::BIGINT) % 1000000 AS limb FROM customer)"""
#: As many decimals of e as there are customers: 1 + (1 + (1 + ...) / 2) / 1 in digits of base 10^9, from the last term on.
E_TEXT = """n AS (SELECT count(*)::INT AS d FROM customer),
f AS (
  SELECT d, d // 2 + 60 AS k, list_prepend(1::HUGEINT, list_transform(range(d // 9 + 3), lambda i: 0::HUGEINT)) AS x FROM n
  UNION ALL
  SELECT d, k - 1, list_transform(list_reduce(list_prepend({'r': 0::HUGEINT, 'q': []::HUGEINT[]}, list_transform(x, lambda y: {'r': y, 'q': []::HUGEINT[]})),
      lambda a, y: {'r': (a.r * 1000000000 + y.r) % k, 'q': list_append(a.q, (a.r * 1000000000 + y.r) // k)}).q, lambda y, i: CASE WHEN i = 1 THEN y + 1 ELSE y END)
  FROM f WHERE k > 0),
t AS (SELECT d, x[1]::VARCHAR || list_aggregate(list_transform(x[2:], lambda y: lpad(y::VARCHAR, 9, '0')), 'string_agg', '') AS t FROM f WHERE k = 0)"""
_BEFORE = "OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_CONV = """
a AS (SELECT n_nationkey AS i, (n_nationkey * 39119 + 7) % 1000000 AS x FROM nation),
b AS (SELECT r_regionkey AS j, (r_regionkey * 271828 + 5) % 1000000 AS y FROM region),
s AS (SELECT k.idx, coalesce(sum(x::HUGEINT * y), 0)::HUGEINT AS v FROM (SELECT unnest(range({n})) AS idx) k LEFT JOIN (a CROSS JOIN b) ON i + j = k.idx GROUP BY k.idx),
c AS (SELECT 0::BIGINT AS idx, (v % 1000000)::BIGINT AS limb, v // 1000000 AS carry FROM s WHERE idx = 0
      UNION ALL SELECT c.idx + 1, ((s.v + c.carry) % 1000000)::BIGINT, (s.v + c.carry) // 1000000 FROM c JOIN s ON s.idx = c.idx + 1)"""

SQL = {
    "limb_residue": f"""WITH n AS ({_LIMBS}),
        l AS (SELECT list(limb::HUGEINT ORDER BY idx DESC) AS x FROM n)
        SELECT 'n' AS num, ({_fold("list_prepend(0::HUGEINT, x)", "1000000000::HUGEINT", P0)})::VARCHAR AS r0,
               ({_fold("list_prepend(0::HUGEINT, x)", "1000000000::HUGEINT", P1)})::VARCHAR AS r1 FROM l""",
    "number_add_carry": f"""WITH {_TWO},
        s AS (SELECT coalesce(a.idx, b.idx) AS idx, coalesce(a.limb, 0) + coalesce(b.limb, 0) AS v FROM a FULL JOIN b ON a.idx = b.idx),
        t AS (SELECT * FROM s UNION ALL SELECT max(idx) + 1, 0 FROM s),
        f AS (SELECT *, CASE WHEN v >= 1000000 THEN 1 WHEN v < 999999 THEN 0 END AS flag FROM t),
        c AS (SELECT idx, (v + coalesce(last_value(flag IGNORE NULLS) {_BEFORE}, 0)) % 1000000 AS limb FROM f)
        SELECT 's' AS num, idx::BIGINT AS idx, limb::BIGINT AS limb FROM c WHERE idx <= (SELECT max(idx) FROM c WHERE limb <> 0)""",
    "number_sub_borrow": f"""WITH {_TWO},
        s AS (SELECT coalesce(a.idx, b.idx) AS idx, coalesce(a.limb, 0) - coalesce(b.limb, 0) AS v FROM a FULL JOIN b ON a.idx = b.idx),
        f AS (SELECT *, CASE WHEN v < 0 THEN -1 WHEN v > 0 THEN 0 END AS flag FROM s),
        c AS (SELECT idx, (v + coalesce(last_value(flag IGNORE NULLS) {_BEFORE}, 0) + 1000000) % 1000000 AS limb FROM f)
        SELECT 's' AS num, idx::BIGINT AS idx, limb::BIGINT AS limb FROM c WHERE idx <= (SELECT max(idx) FROM c WHERE limb <> 0)""",
    "number_compare": """WITH
        a AS (SELECT s_nationkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS idx, abs(round(s_acctbal * 100)::BIGINT) % 1000000 AS x FROM supplier),
        b AS (SELECT c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS idx, abs(round(c_acctbal * 100)::BIGINT) % 1000000 AS y FROM customer),
        j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.idx, b.idx) AS idx, sign(coalesce(x, 0) - coalesce(y, 0)) AS s FROM a FULL JOIN b ON a.k = b.k AND a.idx = b.idx)
        SELECT k::VARCHAR AS num, coalesce(arg_max(s, idx) FILTER (s <> 0), 0)::INT AS cmp FROM j GROUP BY k""",
    "convolution_small": f"WITH RECURSIVE {_CONV.format(n=20)} SELECT 'p' AS num, idx, limb FROM c WHERE idx <= (SELECT max(idx) FROM c WHERE limb <> 0)",
    "block_product": f"WITH RECURSIVE {_CONV.format(n=32)} SELECT 'p' AS num, idx, limb FROM c WHERE idx <= (SELECT max(idx) FROM c WHERE limb <> 0)",
    "cyclic_fold": f"""WITH RECURSIVE n AS ({_LIMBS}),
        s AS (SELECT idx % 50 AS k, sum(limb % 1000000)::BIGINT AS v FROM n GROUP BY ALL),
        l AS (SELECT list(v ORDER BY k) AS x FROM s),
        c AS (SELECT 0 AS t, x, 0::BIGINT AS carry FROM l
              UNION ALL SELECT t + 1, list_transform(x, lambda v, i: CASE WHEN i = t % 50 + 1 THEN (v + carry) % 1000000 ELSE v END), (x[t % 50 + 1] + carry) // 1000000
              FROM c WHERE t < 250),
        f AS (SELECT x FROM c WHERE t = 250)
        SELECT 'n' AS num, (i - 1)::BIGINT AS idx, x[i]::BIGINT AS limb FROM (SELECT x, unnest(range(1, 51)) AS i FROM f)
        WHERE i <= (SELECT max(j) FROM (SELECT x, unnest(range(1, 51)) AS j FROM f) WHERE x[j] <> 0)""",
    "exclusive_prefix": """SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS idx,
        coalesce(sum(round(o_totalprice * 100)::BIGINT) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM orders""",
    "residue_parts": f"""WITH n AS ({_LIMBS})
        SELECT 'n' AS num, (((sum(CASE WHEN idx % 2 = 1 THEN -(limb % 1000000) ELSE limb % 1000000 END) % 1000001) + 1000001) % 1000001)::BIGINT AS plus,
               (sum(limb % 1000000) % 999999)::BIGINT AS minus FROM n""",
    "first_vs_max_metric": """SELECT user_id, event_type,
        CASE WHEN event_type IN ('purchase', 'view') THEN max(value) ELSE arg_min(value, {'a': ts, 'b': event_id}) END AS value FROM events GROUP BY user_id, event_type""",
    "verdict_case": """SELECT user_id, count(*) FILTER (value > 50) AS n_ok, count(*) FILTER (value > 99) AS n_failed,
        CASE WHEN count(*) FILTER (value > 99) > 0 THEN 'FAIL' WHEN bool_or(value < 1) THEN 'OK'
             WHEN user_id % 2 = 0 AND count(*) FILTER (value > 50) > 0 THEN 'OK' ELSE 'NONE' END AS verdict FROM events GROUP BY user_id""",
    "fingerprint": """WITH d AS (SELECT DISTINCT event_type, event_type || ':' || user_id::VARCHAR AS line FROM events)
        SELECT event_type, substr(sha256(string_agg(line, chr(10) ORDER BY line)), 1, 16) AS fingerprint, count(*) AS n_lines FROM d GROUP BY event_type""",
    "slow_outlier": """WITH m AS (SELECT event_type, median(value) AS ref FROM events GROUP BY event_type)
        SELECT event_id, event_type, value, round(ref, 6) AS ref FROM events JOIN m USING (event_type) WHERE value > 1.3 * ref AND value - ref > 5""",
    "node_screen": """WITH m AS (SELECT user_id, CASE WHEN count(value) >= 3 THEN median(value) ELSE min(value) END AS ref, count(value) AS n FROM events GROUP BY user_id)
        SELECT event_id, user_id, round(ref, 6) AS ref, n FROM events JOIN m USING (user_id) WHERE n >= 2 AND value > 3 * ref AND value - ref >= 2""",
    "median_max": """SELECT event_type, round(median(value), 6) AS median, max(value) AS worst,
        arg_max('u' || user_id::VARCHAR, {'a': value, 'b': 'u' || user_id::VARCHAR}) AS who FROM events GROUP BY event_type""",
    "arm_summary": """SELECT event_type, count(*) FILTER (user_id % 3 <> 0 AND value IS NOT NULL) AS n, round(avg(value) FILTER (user_id % 3 <> 0), 6) AS mean,
        round(coalesce(stddev_samp(value) FILTER (user_id % 3 <> 0), 0), 6) AS sd, count(*) FILTER (user_id % 3 = 0 OR value IS NULL) AS bad FROM events GROUP BY event_type""",
    "paired_diff": """WITH r AS (SELECT (user_id % 4)::INT AS arm, value AS v, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS k FROM events WHERE user_id % 3 <> 0 AND value IS NOT NULL),
        p AS (SELECT r.arm, r.v - b.v AS d, b.v AS b FROM r JOIN r b ON b.arm = 0 AND b.k = r.k WHERE r.arm <> 0),
        s AS (SELECT arm, count(*) AS pairs, avg(d) AS diff, avg(b) AS bm, stddev_samp(d) AS sd FROM p GROUP BY arm)
        SELECT arm, pairs, round(diff, 6) AS diff, round(CASE WHEN bm <> 0 THEN 100 * diff / bm ELSE 0 END, 6) AS pct,
          round(CASE WHEN pairs > 1 THEN coalesce([12.71, 4.30, 3.18, 2.78, 2.57, 2.45, 2.36, 2.31, 2.26, 2.23][pairs - 1]::DOUBLE, 1.96) * sd / sqrt(pairs) END, 6) AS ci95 FROM s""",
    "topology_rollup": """SELECT r_name, n_name, (2 - grouping(r_name) - grouping(n_name))::INT AS level, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS n_low
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""",
    "window_span": """WITH w AS (SELECT o_orderpriority, o_orderkey AS first, lead(o_orderkey, 7) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - o_orderkey AS span FROM orders)
        SELECT o_orderpriority, arg_min(first, {'a': span, 'b': first}) AS first, min(span) AS span FROM w WHERE span IS NOT NULL GROUP BY o_orderpriority""",
    "rle_islands": """WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM m)
        SELECT user_id, island, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM i GROUP BY user_id, island, event_type""",
    "span_groups": """WITH o AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders)
        SELECT size::INT AS size, (idx // size)::BIGINT AS set_no, count(DISTINCT o_orderpriority) AS groups FROM o, (VALUES (2), (4), (8)) s(size) GROUP BY size, idx // size HAVING count(DISTINCT o_orderpriority) > 1""",
    "interval_overlap": """WITH o AS (SELECT o_custkey, o_orderkey AS id, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS s, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) + 1 + o_orderkey % 30 AS e FROM orders)
        SELECT x.o_custkey, x.id AS a, y.id AS b FROM o x JOIN o y ON x.o_custkey = y.o_custkey AND x.id < y.id AND x.s < y.e AND y.s < x.e""",
    "registry_drift": """WITH c AS (SELECT p_partkey AS name, (p_size % 7)::BIGINT AS v FROM part), r AS (SELECT l_partkey + 3 AS name, max(l_linenumber)::BIGINT AS v FROM lineitem GROUP BY l_partkey)
        SELECT * FROM (SELECT coalesce(c.name, r.name) AS name, CASE WHEN r.name IS NULL THEN 'MISSING' WHEN c.name IS NULL THEN 'STALE' WHEN c.v IS DISTINCT FROM r.v THEN 'DIFFERS' END AS kind
        FROM c FULL JOIN r ON c.name = r.name) WHERE kind IS NOT NULL""",
    "anti_join": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "precedence": """SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'high' WHEN s_suppkey % 3 = 0 THEN 'third' WHEN s_nationkey < 20 THEN 'base' END AS value,
        CASE WHEN s_acctbal > 5000 THEN 'env' WHEN s_suppkey % 3 = 0 THEN 'profile' WHEN s_nationkey < 20 THEN 'default' END AS origin FROM supplier""",
    "interpolate": """WITH t AS (SELECT p_size::DOUBLE AS x, avg(p_retailprice) AS y FROM part WHERE p_size % 7 = 0 GROUP BY p_size), n AS (SELECT *, row_number() OVER (ORDER BY x) AS k, count(*) OVER () AS n FROM t),
        p AS (SELECT DISTINCT p_size FROM part), h AS (SELECT p_size, least(greatest((SELECT count(*) FROM t WHERE x < p_size), 1), (SELECT count(*) FROM t) - 1) AS k FROM p)
        SELECT h.p_size, round(CASE WHEN e.y IS NOT NULL THEN e.y ELSE exp(ln(a.y) + (ln(h.p_size) - ln(a.x)) / (ln(b.x) - ln(a.x)) * (ln(b.y) - ln(a.y))) END, 4) AS value
        FROM h JOIN n a ON a.k = h.k JOIN n b ON b.k = h.k + 1 LEFT JOIN t e ON e.x = h.p_size""",
    "wilson": """WITH e AS (SELECT event_type, count(*) AS n, count(*) FILTER (value > 90) AS failures FROM events GROUP BY event_type), p AS (SELECT *, failures / n AS p FROM e)
        SELECT event_type, n, failures, round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 9)::DOUBLE AS low,
          round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 9)::DOUBLE AS high FROM p""",
    "kv_json": """SELECT event_type, max((props::JSON->>'k')::BIGINT) AS most, sum((props::JSON->>'k')::BIGINT)::BIGINT AS total, count(props::JSON->>'k') AS n FROM events GROUP BY event_type""",
    "digit_chunks": f"""WITH d AS (SELECT source AS num, string_agg(n_chars::VARCHAR, '' ORDER BY doc_id) AS t FROM documents GROUP BY source),
        l AS (SELECT num, list_prepend(0::HUGEINT, list_transform(string_split(t, ''), lambda c: c::HUGEINT)) AS x FROM d)
        SELECT num, ({_fold("x", "10::HUGEINT", P0)})::VARCHAR AS r0, ({_fold("x", "10::HUGEINT", P1)})::VARCHAR AS r1 FROM l""",
    "natural_sort": r"SELECT c_custkey, regexp_replace(c_name, '\d+$', '') AS prefix, coalesce(try_cast(regexp_extract(c_name, '(\d+)$', 1) AS BIGINT), -1) AS number FROM customer",
    "hostlist": """SELECT n_nationkey, lower(replace(n_name, ' ', '')) || lpad(v::VARCHAR, 3, '0') AS host FROM (SELECT *, unnest(range(n_nationkey, n_nationkey + 3)) AS v FROM nation)
        UNION ALL SELECT n_nationkey, lower(replace(n_name, ' ', '')) || (n_nationkey + 40)::VARCHAR FROM nation""",
    "log_metrics": "SELECT event_type AS name, CASE WHEN event_type = 'purchase' THEN max(round(value, 2)) ELSE arg_min(round(value, 2), event_id) END AS value FROM events GROUP BY event_type",
    "replica_pivot": """SELECT (user_id % 3)::VARCHAR AS path, (event_id % 5)::VARCHAR AS run, max(event_id) FILTER (event_id % 2 = 0)::VARCHAR AS total, max(event_id) FILTER (event_id % 2 = 1)::VARCHAR AS verify FROM events GROUP BY user_id % 3, event_id % 5""",
    "part_contiguity": """WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders), p AS (SELECT (idx // 1000)::INT AS part, min(idx)::BIGINT AS lo, (max(idx) + 1)::BIGINT AS hi FROM o GROUP BY ALL)
        SELECT part, lo, hi, coalesce(lo = lag(hi) OVER (ORDER BY part), lo = 0) AS joins FROM p""",
    "first_mismatch": f"""WITH {_TWO} SELECT min(coalesce(a.idx, b.idx))::BIGINT AS first, count(*) AS differ FROM a FULL JOIN b ON a.idx = b.idx WHERE a.limb IS DISTINCT FROM b.limb""",
    "dependency_cycles": """WITH RECURSIVE e AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 < 9 THEN c_custkey + 1 WHEN c_custkey // 10 % 3 = 0 THEN c_custkey - 6 ELSE -1 END AS dep FROM customer),
        walk AS (SELECT id, dep, 1 AS n FROM e UNION ALL SELECT w.id, e.dep, n + 1 FROM walk w JOIN e ON e.id = w.dep WHERE n < 20)
        SELECT DISTINCT id FROM walk WHERE n = 20""",
    "gate_counts": "SELECT CASE WHEN o_orderstatus <> 'F' AND o_totalprice > 1000 AND o_orderpriority <> '1-URGENT' THEN 'PASS' ELSE 'FAIL' END AS gate, count(*) AS n FROM orders GROUP BY ALL",
    "long_product": f"""WITH {_TWO},
        x AS (SELECT list_prepend(0::HUGEINT, list(limb::HUGEINT ORDER BY idx DESC)) AS x FROM a), y AS (SELECT list_prepend(0::HUGEINT, list(limb::HUGEINT ORDER BY idx DESC)) AS y FROM b)
        SELECT 's' AS num, (({_fold("x", "1000000::HUGEINT", P0)}) * ({_fold("y", "1000000::HUGEINT", P0)}) % {P0}::HUGEINT)::VARCHAR AS r0,
               (({_fold("x", "1000000::HUGEINT", P1)}) * ({_fold("y", "1000000::HUGEINT", P1)}) % {P1}::HUGEINT)::VARCHAR AS r1 FROM x, y""",
    "e_digits": f"""WITH RECURSIVE {E_TEXT}
SELECT c AS chunk_no, substr(t, 50 * c + 1, least(50, d + 1 - 50 * c)) AS text FROM (SELECT *, unnest(range(d // 50 + 1)) AS c FROM t)""",
}
