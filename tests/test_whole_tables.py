"""Queries that have to use every row of their tables, against brute force."""

import hashlib
import sys

import duckdb
from pyspark.sql import functions as F

from numerail import registry
from numerail.operators import analytics, order, series

SF = "/root/testdata/sf0.001"


def column_pairs(sql):
    return duckdb.sql(sql).fetchall()


def numbers(table, nation, key, balance):
    out = {}
    for k, cents in column_pairs(f"SELECT {nation}, abs(round({balance} * 100)::BIGINT) % 1000000 FROM '{SF}/{table}.parquet' ORDER BY {key}"):
        out.setdefault(str(k), []).append(cents)
    return {k: sum(x * 10 ** (6 * i) for i, x in enumerate(limbs)) for k, limbs in out.items()}


def test_comparison_has_all_customers(spark):
    a, b = numbers("supplier", "s_nationkey", "s_suppkey", "s_acctbal"), numbers("customer", "c_nationkey", "c_custkey", "c_acctbal")
    want = {k: (a.get(k, 0) > b.get(k, 0)) - (a.get(k, 0) < b.get(k, 0)) for k in a | b}
    assert {r["num"]: r["cmp"] for r in registry.number_compare(spark, SF).collect()} == want


def test_cycles_of_all_customers(spark):
    ids = [k for (k,) in column_pairs(f"SELECT c_custkey FROM '{SF}/customer.parquet'")]
    left = {k: k + 1 if k % 10 < 9 else k - 6 if k // 10 % 3 == 0 else -1 for k in ids}
    while placed := [k for k, dep in left.items() if dep not in left]:
        for k in placed:
            del left[k]
    assert {k % 3 for k in left} == {0, 1, 2} and len(left) < len(ids)
    assert sorted(r["id"] for r in registry.dependency_cycles(spark, SF).collect()) == sorted(left)


def test_long_digits_of_e_by_levels(spark):
    digits = 20 * column_pairs("SELECT count(*) FROM '/root/testdata/sf0.01/customer.parquet'")[0][0]
    terms = series.terms_for(digits)
    assert terms > 2 * series.LEAF
    one = 10 ** (digits + 20)
    total = term = one
    for k in range(1, terms + 1):
        term //= k
        total += term
    sys.set_int_max_str_digits(0)
    text = "".join(r["text"] for r in registry.e_digits_long(spark, "/root/testdata/sf0.01").orderBy("chunk_no").collect())
    assert text == str(total // 10**20)


def test_positions_within_one_large_key(spark):
    """One key with nearly all rows is numbered by ranges, in the order of the columns."""
    rows = [("all", i * 7919 % 5000, i) for i in range(5000)] + [("few", 3, 1), ("few", 3, 0), ("few", -1, 9), (None, 4, 4), (None, 2, 2)]
    df = spark.createDataFrame(rows, "k string, a long, b long")
    got = {(r["k"], r["b"]): r["idx"] for r in order.indexed_within(df, ["k"], ["a", "b"], parts=16).collect()}
    want = {}
    for k in ("all", "few", None):
        want |= {(k, b): i for i, (_, b) in enumerate(sorted((a, b) for x, a, b in rows if x == k))}
    assert got == want


def test_fingerprints_of_one_large_key(spark):
    rows = [("all", f"line {i % 3000} é") for i in range(9000)] + [("few", "b"), ("few", "a"), ("few", None), (None, "x"), ("none", None)]
    got = analytics.fingerprint(spark.createDataFrame(rows, "k string, line string").repartition(5), ["k"], F.col("line"))
    digest = lambda lines: hashlib.sha256("\n".join(sorted(set(lines), key=str.encode)).encode()).hexdigest()[:16]
    want = {k: (digest([x for y, x in rows if y == k and x is not None]), len({x for y, x in rows if y == k and x is not None})) for k in ("all", "few", None)}
    assert {r["k"]: (r["fingerprint"], r["n_lines"]) for r in got.collect()} == want
