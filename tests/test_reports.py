import itertools
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from numerail.operators import analytics as an
from numerail.operators import manifest as mf
from numerail.operators import numbers as nb
from numerail.operators import products as pr
from numerail.operators import reports as rp
from numerail.operators import residues as rs
from numerail.operators import transforms as tf
from numerail.sources import packed, sinks


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_paths_without_verified_runs(spark):
    runs = spark.createDataFrame([("p1", 10.0, True, 0, "a", "9", "2"), ("p1", 14.0, True, 0, "a", "9", "2"), ("p1", 99.0, False, 1, "a", "9", "2"), ("p2", None, None, None, None, "9", None)], "path string, total double, ok boolean, rc int, digest string, tail string, head string")
    table = rp.path_table(runs, "path", "total", F.col("ok"), F.col("rc"), "digest")
    assert rows(table, "path", "runs", "n_ok", "bad_exits", "mean", "least", "most", "digests") == [("p1", 3, 2, 1, 12.0, 10.0, 14.0, "AGREE"), ("p2", 1, 0, 0, None, None, None, "NONE")]
    one = rp.cross_path(table, runs, "tail", "head", 4).first()
    assert (one["replicas"], one["complete"], one["tails_agree"], one["heads_agree"], one["paths_ok"], one["overall"]) == (4, True, True, True, False, "NOT PASS")
    good = runs.where("path = 'p1' and ok")
    assert rp.cross_path(rp.path_table(good, "path", "total", F.col("ok"), F.col("rc"), "digest"), good, "tail", "head", 2).first()["overall"] == "PASS"
    none = rp.cross_path(table.where("false"), runs.where("false"), "tail", "head", 0).first()
    assert none["replicas"] == 0 and none["overall"] == "NOT PASS"


def test_refused_errors_exclude(spark):
    hosts = spark.createDataFrame([("a",), ("b",), ("c",)], "host string")
    logs = spark.createDataFrame([("a", 10.0, 3), ("b", 90.0, 0)], "host string, avail double, ue int")
    found = rp.with_logs(hosts, logs, "host")
    classes = lambda **k: rows(rp.classified(found, "avail", "ue", 50.0, **k), "host", "reasons", "warnings", "class")
    assert classes() == [("a", "memory", "errors", "EXCLUDE"), ("b", "", "", "KEEP"), ("c", "failed: no local log", "", "EXCLUDE")]
    assert classes(refuse_errors=True, flags=[F.when(F.col("host") == "b", "slow")]) == [("a", "errors,memory", "", "EXCLUDE"), ("b", "slow", "", "EXCLUDE"), ("c", "failed: no local log", "", "EXCLUDE")]


def test_groups_by_trailing_number(spark):
    hosts = spark.createDataFrame([("n1",), ("n16",), ("n17",), ("n0",), ("login",)], "host string")
    assert rows(rp.host_groups(hosts, None, 16), "host", "leaf") == [("login", "?"), ("n0", "?"), ("n1", "g0"), ("n16", "g0"), ("n17", "g1")]


@pytest.mark.parametrize(("npe", "ppn", "schedule"), [(1, 1, [1]), (2, 2, [2]), (6, 2, [2, 6]), (12, 4, [2, 4, 12]), (16, 4, [4, 16]), (23, 1, [23])])
def test_runs_of_groups(spark, npe, ppn, schedule):
    want = set()
    for level in range(1, 16):
        if npe > 1 and 2 ** (level - 1) < npe:
            want |= {(f"at{level}", a, min(2**level, npe - a)) for a in range(0, npe, 2**level) if min(2**level, npe - a) > 1}
    for at, (before, size) in enumerate(zip([1, *schedule], schedule), 1):
        for a in range(0, npe, size):
            g = min(size, npe - a)
            binary = g in {2**k for k in range(20)} and a % g == 0 or (a == 0 and g == npe)
            if -(-g // before) >= 2 and not binary:
                want.add((f"sched{at}", a, g))
    if 2 <= ppn < npe and npe % ppn == 0:
        want |= {("node", 0, ppn), ("node", npe - ppn, ppn)}
    if npe > 1:
        want.add(("selftest", 0, max(2**k for k in range(20) if 2**k <= npe)))
    assert set(rows(rp.group_runs(spark, npe, ppn, schedule), "what", "g0", "g")) == want


def test_worker_sizes():
    r = random.Random(4)
    items = [{"id": f"i{k}", "prio": r.randrange(3), "nodes": r.choice([1, 2, 4]), "est_min": r.randrange(5, 30), "deps": [f"i{r.randrange(k)}"] if k % 3 == 2 else []} for k in range(9)]
    best = rp.best_workers(items, 2)
    keys = []
    for choice in itertools.combinations_with_replacement([1, 2, 4], 2):
        if max(choice) >= 4:
            span, _, left = mf.schedule(items, list(choice))
            keys.append((len(left), span, sum(choice)))
    assert best["key"] == min(keys) and best["left"] == []
    behind = rp.best_workers(items, 1, done={"i0": "FAIL", "i1": "PASS"})
    stuck = {"i0"}
    for i in items:
        if i["id"] not in ("i0", "i1") and any(d in stuck for d in i["deps"]):
            stuck.add(i["id"])
    assert behind["left"] == sorted(stuck - {"i0"})
    assert rp.best_workers([], 2)["span"] == 0.0


def test_profile_lines(spark):
    text = ["# note", "", "A=1", " B = 2", "A=3", "C=", "LAUNCH_LINE_KEYS=A D", "E=__FILL__", "FI_X=1"]
    lines = spark.createDataFrame(list(enumerate(text, 1)), "line_no int, value string")
    settings, bad = rp.profile_settings(lines)
    assert rows(settings, "name", "value") == [("A", "3"), ("C", ""), ("E", "__FILL__"), ("FI_X", "1"), ("LAUNCH_LINE_KEYS", "A D")]
    assert rows(bad, "line_no", "problem") == [(4, "not KEY=value: B = 2"), (5, "duplicate key A")]
    registry = spark.createDataFrame([("A",), ("E",)], "name string")
    assert rows(rp.profile_problems(settings, registry), "name", "problem") == [("C", "unknown switch"), ("D", "on the launch line but not set"), ("E", "still to fill")]
    defaults = spark.createDataFrame([("A", "3"), ("A", "3"), ("C", "x")], "name string, value string")
    assert rows(rp.profile_drift(settings, defaults, registry), "name", "class") == [("A", "SAME"), ("C", "OVERRIDE"), ("C", "UNKNOWN"), ("E", "UNFILLED"), ("FI_X", "PROFILE-ONLY"), ("LAUNCH_LINE_KEYS", "PROFILE-ONLY"), ("LAUNCH_LINE_KEYS", "UNKNOWN")]


def test_suggestions_are_all_near_names(spark):
    r = random.Random(5)
    names = ["".join(r.choice("ABCD_") for _ in range(r.randrange(1, 12))) for _ in range(60)]
    wrong = ["".join(r.choice("ABCD_") for _ in range(r.randrange(1, 12))) for _ in range(40)] + [n[1:] + "A" for n in names[:10]] + ["QQQQQQQQQQQQQQ"]

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, last = [i], d
            for j, y in enumerate(b, 1):
                d.append(min(last[j] + 1, d[-1] + 1, last[j - 1] + (x != y)))
        return d[-1]

    want = {}
    for u in set(wrong):
        near = sorted((distance(u, k), k) for k in set(names) if distance(u, k) <= 3)[:2]
        if near:
            want[u] = [k for _, k in near]
    got = mf.suggestions(spark.createDataFrame([(w,) for w in wrong], "name string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert {r["name"]: list(r["near"]) for r in got.collect()} == want


def test_rounds_that_do_not_end_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "id long, dep long")
    assert mf.cyclic(chain).count() == 0
    with pytest.raises(RuntimeError):
        mf.cyclic(chain, max_rounds=3)


def test_deep_chains_end_in_few_rounds(spark):
    """A chain of n nodes in about log2(n) rounds; cycles, what is behind them, and nodes of several needs by brute force."""
    n = 20_000
    chain = spark.range(n).select("id", (F.col("id") + 1).alias("dep"))
    assert mf.cyclic(chain, max_rounds=17).count() == 0
    ring = chain.unionByName(spark.createDataFrame([(n, n + 1), (n + 1, n + 2), (n + 2, n)], "id long, dep long"))
    assert mf.cyclic(ring, max_rounds=17).count() == n + 3
    r = random.Random(12)
    for density in (0.9, 1.3):
        edges = [(r.randrange(300), r.randrange(400)) for _ in range(int(300 * density))] + [(7, 7), (500, 7)]
        left = set(edges)
        while placed := {e for e in left if e[1] not in {i for i, _ in left}}:
            left -= placed
        got = mf.cyclic(spark.createDataFrame(edges, "id long, dep long"))
        assert {x["id"] for x in got.collect()} == {i for i, _ in left}


@pytest.mark.parametrize("small, buckets", [(5, 2), (50, 7), (10**6, 1024)])
def test_medians_in_bounded_memory(spark, small, buckets):
    """One key with nearly all rows, few and many equal values, wide ranges, nulls; against the plain median."""
    r = random.Random(6)
    rows = [("all", r.choice([r.random(), r.gauss(0, 1) * 10 ** r.randrange(-5, 9), 7.0, 7.0])) for _ in range(3001)]
    rows += [("even", float(v)) for v in (1, 2, 3, 10)] + [("same", 5.5)] * 300 + [("one", -1.0), ("none", None), ("two", 1e300), ("two", -1e300)] + [(None, 3.0)] * 7
    rows += [("neg", -float(i * i)) for i in range(100)] + [("all", None)] * 5
    df = spark.createDataFrame(rows, "k string, v double")
    got = {x["k"]: x["median"] for x in an.medians(df.where("k is not null"), ["k"], "v", small, buckets).collect()}
    values = {}
    for k, v in rows:
        if v is not None and k is not None:
            values.setdefault(k, []).append(v)
    assert got == {k: statistics.median(v) for k, v in values.items()}


def test_long_products_are_split(spark):
    r = random.Random(7)
    pairs = [(1, "12", "3"), (2, str(r.getrandbits(3000)), str(r.getrandbits(90))), (3, str(r.getrandbits(1500)), str(r.getrandbits(1600))), (4, "0" * 200, "9" * 200)]
    got = {x["pair_id"]: x["product"] for x in pr.multiply_many(spark.createDataFrame(pairs, "pair_id long, a string, b string"), long_digits=100).collect()}
    assert got == {i: str(int(a) * int(b)) for i, a, b in pairs}


def test_one_long_product_is_many_tasks(spark):
    a, b = 3 ** 9000, 7 ** 4000
    grid = pr.block_grid(nb.from_ints(spark, {"n": a}), nb.from_ints(spark, {"n": b}), size=32)
    assert grid.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1
    pairs = grid.select("blk").count()
    blocks = lambda v: -(-len(nb.limbs_of(v)) // 32)
    assert pairs == blocks(a) * blocks(b)
    assert nb.to_ints(pr.multiplied(nb.from_ints(spark, {"n": a}), nb.from_ints(spark, {"n": b}), size=32))["n"] == a * b


def test_faults_are_seen_and_a_second_try_helps(spark):
    a, b = nb.from_ints(spark, {"n": 10**50 + 7}), nb.from_ints(spark, {"n": 10**40 + 3})
    wrong = lambda product, attempt: nb.with_limb(product, 2, 1) if attempt == 0 else product
    primes = list(rs.CHECK_PRIMES[:2])
    assert nb.to_ints(pr.checked_product(a, b, primes, fault=wrong))["n"] == (10**50 + 7) * (10**40 + 3)
    with pytest.raises(ArithmeticError):
        pr.checked_product(a, b, primes, attempts=1, fault=wrong)


def test_transforms_of_three_parts():
    p = tf.transform_primes(1, thirds=3)[0]
    r = random.Random(9)
    for n in (3, 12, 96):
        x = np.array([r.randrange(p) for _ in range(n)])
        w = tf.root_of_unity(n, p)
        want = [sum(int(v) * pow(w, i * k, p) for i, v in enumerate(x)) % p for k in range(n)]
        assert tf.transform_mod(x, p).tolist() == want and tf.transform_mod(tf.transform_mod(x, p), p, True).tolist() == x.tolist()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, None), ("a", 1, 0.5), ("c", 0, 1.5)], "host string, rank int, dc double")
    sinks.write_table(df, str(tmp_path / "t"), ["rank", "host"])
    lines = [line for f in sorted((tmp_path / "t").glob("part-*")) for line in f.read_text().splitlines() if not line.startswith("host\t")]
    assert lines == ["c\t0\t1.5", "a\t1\t0.5", "b\t2\t"]
    sinks.write_sidecar(spark, str(tmp_path / "s"), {"digits": 10, "residues": [1, 2], "tail": "123"})
    assert sinks.read_sidecar(spark, str(tmp_path / "s")) == {"digits": "10", "residues": "1,2", "tail": "123"}
    rate = sinks.write_rate(spark.range(1000), str(tmp_path / "r"), 8).first()
    assert rate["rows"] == 1000 and rate["mb_per_s"] > 0


def test_background_jobs(spark, tmp_path):
    jobs = sinks.Background(spark, most=2)
    for i in range(4):
        jobs.start(lambda i=i: spark.range(10 + i).count())
    assert len(jobs.jobs) <= 2 and jobs.join()[-1] == 13 and jobs.poll() == 0
    jobs.start(lambda: spark.read.parquet(str(tmp_path / "nothing")).count())
    with pytest.raises(Exception, match="nothing"):
        jobs.join()


def test_memory_and_layout_lines(spark, tmp_path):
    text = ["MemTotal:       100 kB", "MemAvailable:    40 kB", "HugePages_Total:   0", "junk", "layout: a=1 b=2.5e3 c=x", "planes: n=4"]
    lines = spark.createDataFrame([(t,) for t in text], "value string")
    assert rows(sinks.memory_facts(lines), "name", "kb") == [("HugePages_Total", 0), ("MemAvailable", 40), ("MemTotal", 100)]
    assert rows(sinks.layout_values(lines), "kind", "name", "value") == [("layout", "a", 1.0), ("layout", "b", 2500.0), ("planes", "n", 4.0)]
    facts = tmp_path / "meminfo"
    facts.write_text("\n".join(text[:3]))
    query = sinks.memory_stream(spark, str(facts)).writeStream.format("memory").queryName("mem").trigger(once=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    assert rows(spark.table("mem").select("name", "kb").distinct(), "name", "kb") == [("HugePages_Total", 0), ("MemAvailable", 40), ("MemTotal", 100)]


@pytest.mark.parametrize("version", [1, 2])
def test_corrections_carry_through_parts(spark, tmp_path, version):
    text = "27" + "18" * 60 + "9" * 150
    base = str(tmp_path / "n.bin")
    made = packed.write_parts(nb.from_ints(spark, {"x": int(text)}), len(text), base, 4, version=version)
    paths = [r["path"] for r in made.orderBy("part").collect()]
    assert packed.patch_number(paths, 7) == 3
    parts = packed.read_parts(spark, f"{base}.part*")
    assert "".join(r["text"] for r in parts.orderBy("part").collect()) == str(int(text) + 7) and packed.recheck(parts).first()["verdict"] == "OK"
    assert packed.patch_number(paths, -7) == 3
    again = packed.read_parts(spark, f"{base}.part*")
    assert "".join(r["text"] for r in again.orderBy("part").collect()) == text and packed.recheck(again).first()["verdict"] == "OK"
    assert packed.recheck(again.where("part <> 1")).first()["verdict"] == "FAIL"


def test_names_of_other_software_pass_by_use(spark):
    """A profile may hold more prefixes than the drift check lets pass."""
    settings = spark.createDataFrame([(n, "1") for n in ("OMP_x", "ROCm", "FI_y", "OWN", "Z_z", "SLURM_a")], "name string, value string")
    registry = spark.createDataFrame([("OWN",)], "name string")
    assert rows(rp.profile_problems(settings, registry), "name") == [("Z_z",)]
    drift = rp.profile_drift(settings, settings.limit(0), registry)
    assert rows(drift.where("class = 'UNKNOWN'"), "name") == [("OMP_x",), ("ROCm",), ("Z_z",)]
    assert rows(rp.profile_problems(settings, registry, external=()), "name") == [("FI_y",), ("OMP_x",), ("ROCm",), ("SLURM_a",), ("Z_z",)]
