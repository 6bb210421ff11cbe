import random

import numpy as np
from pyspark.sql import functions as F

from numerail.functions.counts import count_column, parse_count
from numerail.operators import analytics as an
from numerail.operators import manifest as mf
from numerail.operators import numbers as nb
from numerail.operators import topology as tp
from numerail.plans import grids
from numerail.sources import digits as dg
from numerail.sources import logs, packed

R = random.Random(8)


def test_counts(spark):
    cases = {"1e9": 10**9, "1.6e10": 16 * 10**9, "1.50e1": 15, "42": 42, "007": 7, "1E+3": 1000, "0": None, "0e5": None, "1.5": None, "-3": None, "1.55e1": None, "12x": None, "e5": None, ".5e1": None, "5.e1": None, "": None, "18446744073709551598": 2**64 - 18, "18446744073709551599": None, "1e30": None, "100e0": 100}
    assert {k: parse_count(k) for k in cases} == cases
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: None if r["v"] is None else int(r["v"]) for r in df.select("t", count_column(df["t"]).alias("v")).collect()} == cases


def test_packed_codec():
    for n in (0, 1, 2, 7, 1000):
        limbs = np.array([R.choice([0, 10**18 - 1, R.randrange(10**18)]) for _ in range(n)], dtype=np.uint64)
        data = packed.pack60(limbs) if n else b""
        assert len(data) == packed.packed_bytes(n) and packed.unpack60(data, n).tolist() == limbs.tolist()
        stream, out, at = packed.StreamPacker(), b"", 0
        while at < n:
            k = min(n - at, R.randrange(1, 9))
            out, at = out + stream.add(limbs[at : at + k], at + k == n), at + k
        assert out == data


def test_parts_round_trip_patch_and_recheck(spark, tmp_path):
    n_digits = 701
    value = int("2" + "".join(R.choice("0123456789") for _ in range(n_digits - 1)))
    df = nb.from_ints(spark, {"x": value})
    for version in (1, 2):
        base = str(tmp_path / f"v{version}")
        packed.write_parts(df, n_digits, base, 4, version)
        parts = packed.read_parts(spark, base + ".part*").cache()
        assert packed.recheck(parts).first()["verdict"] == "OK"
        text = "".join(r["text"] for r in packed.to_ascii(parts, 690).orderBy("part").collect())
        assert text == f"2.{str(value)[1:691]}\n"
        parts.unpersist()
        packed.patch_tail(f"{base}.part0003", 5)
        again = packed.read_parts(spark, base + ".part*")
        assert packed.recheck(again).first()["verdict"] == "OK"
        assert "".join(r["text"] for r in again.orderBy("part").collect()) == str(value + 5)
        with open(f"{base}.part0001", "r+b") as f:  # one changed digit
            f.seek(packed.HEADER_BYTES + 3)
            byte = f.read(1)
            f.seek(-1, 1)
            f.write(bytes([byte[0] ^ 1]))
        assert packed.recheck(packed.read_parts(spark, base + ".part*")).first()["verdict"] == "FAIL"
        assert packed.recheck(packed.read_parts(spark, base + ".part000[023]")).first()["verdict"] == "FAIL"


def test_digit_chunks_windows_and_comparison(spark):
    text = "2" + "".join(R.choice("0123456789") for _ in range(499))
    chunks = dg.digit_chunks(nb.from_ints(spark, {"x": int(text)}), 500, 70).cache()
    assert "".join(r["text"] for r in chunks.orderBy("chunk_no").collect()) == text
    windows = [(0, text[:50]), (45, text[45:95]), (130, text[130:180]), (131, text[130:180]), (470, text[:50])]
    got = {r["off"]: r["ok"] for r in dg.check_windows(chunks, spark.createDataFrame(windows, "off long, w string"), 70).collect()}
    assert got == {0: True, 45: True, 130: True, 131: False, 470: None}
    assert dg.compare_digits(chunks, chunks).first()["verdict"] == "identical"
    assert dg.compare_digits(chunks, chunks.where("chunk_no < 3")).first()["verdict"] == "prefix"
    wrong = text[:200] + str((int(text[200]) + 1) % 10) + text[201:]
    odd = dg.compare_digits(chunks, dg.digit_chunks(nb.from_ints(spark, {"x": int(wrong)}), 500, 70)).first()
    assert odd["verdict"] == "DIFFERS" and tuple(odd["first_difference"]) == (2, 60)
    assert dg.block_digests(chunks, 3).count() == 3


def test_logs(spark, tmp_path):
    (tmp_path / "run.log").write_text("RESULT app total s 12.5\nmn: host7 3: RESULT app dm s 4\n 5: RESULT app dm s 9\nother FATAL x\nRESULT app bad s -\nk=v=w\nk=2\n")
    lines = logs.read_lines(spark, str(tmp_path))
    got = {(r["host"], r["rank"], r["name"], r["metric"]) for r in logs.metric_lines(lines, "app").collect()}
    assert got == {(None, None, "total", 12.5), ("host7", 3, "dm", 4.0), (None, None, "dm", 9.0), (None, None, "bad", None)}
    assert logs.error_lines(lines).count() == 1
    kv = logs.key_values(lines)
    assert [r["value"] for r in kv.orderBy("line_no").collect()] == ["v=w", "2"]
    assert an.last_wins(kv, "key", "value", "line_no").first()["value"] == "2"
    words = spark.createDataFrame([("NS a=1 b=2 a=3 x",)], "value string").select(logs.word_map(F.col("value")).alias("m")).first()["m"]
    assert words == {"a": "3", "b": "2"}


def test_hosts_keys_and_states(spark):
    df = spark.createDataFrame([("a[001-003,7]b,c,d[9-11]",)], "e string")
    assert [r["host"] for r in tp.expanded(df, "e").collect()] == ["a001b", "a002b", "a003b", "a7b", "c", "d9", "d10", "d11"]
    states = spark.createDataFrame([("IDLE",), ("idle*",), ("IDLE+DRAIN",), ("ALLOCATED",), ("DOWN*",), ("IDLE+RESERVED",), ("",)], "s string")
    u, i, b = tp.state_flags(states["s"])
    assert [tuple(r) for r in states.select(u.alias("u"), i.alias("i"), b.alias("b")).collect()] == [(True, True, False), (True, True, False), (False, False, False), (True, False, True), (False, False, False), (True, False, False), (False, False, False)]


def machine(spark, busy=()):
    rows = [(f"h{c}{h}{s}{b}{n}", c, h, s, b, n, f"h{c}{h}{s}{b}{n}" not in busy) for c in range(2) for h in range(2) for s in range(2) for b in range(2) for n in range(2)]
    return spark.createDataFrame(rows, "host string, cab int, chassis int, slot int, blade int, node int, free boolean")


def test_adjacent_groups(spark):
    nodes = machine(spark, {"h00000"})
    assert tp.smallest_unit(nodes, 2) == "blade" and tp.smallest_unit(nodes, 3) == "slot" and tp.smallest_unit(nodes, 17) == "system"
    groups = tp.pick_groups(nodes, 4, 2)
    assert groups[0]["hosts"] == ["h00100", "h00101", "h00110", "h00111"] and groups[0]["level"] == "slot" and not groups[0]["cross"]
    assert groups[1]["hosts"] == ["h01000", "h01001", "h01010", "h01011"]


def test_collisions(spark):
    runs = spark.createDataFrame([(8, 1, 0, 4), (8, 1, 3, 2), (8, 1, 4, 4), (8, 2, 0, 8), (9, 1, 3, 2)], "npe int, id int, g0 long, g long")
    assert {(tuple(r["a"]), tuple(r["b"])) for r in tp.collisions(runs).collect()} == {((0, 4), (3, 2)), ((3, 2), (4, 4))}


ITEMS = [("sys1", 1, 10, 2, 30.0, [], "a.sh"), ("gpu2", 2, 5, 4, 10.0, ["sys1"], "b.sh"), ("mem3", 1, 20, 1, 5.0, ["gpu2", "nope9"], "c.sh"), ("net4", 3, 1, 1, 0.0, ["net4"], "a.sh"), ("cal5", 1, 2, 1, 4.0, ["cal6"], "a.sh"), ("cal6", 1, 2, 1, 4.0, ["cal5"], "a.sh"), ("sys1", 1, 3, 1, 1.0, [], "a.sh")]
SCHEMA = "id string, tier int, prio int, nodes int, est_min double, deps array<string>, script string"


def test_work_lists(spark):
    items = spark.createDataFrame(ITEMS, SCHEMA)
    scripts = spark.createDataFrame([("a.sh",), ("b.sh",)], "script string")
    got = {(r["id"], r["problem"]) for r in mf.problems(items, "^(sys|gpu|mem|net|cal)[0-9]+$", scripts).collect()}
    assert got == {("sys1", "duplicate id"), ("mem3", "script missing"), ("mem3", "unknown id nope9"), ("net4", "depends on itself"), ("net4", "tier must be 1 or 2"), ("net4", "nodes or est_min out of range")}
    edges = items.selectExpr("id", "explode(deps) as dep")
    assert {r["id"] for r in mf.cyclic(edges).collect()} == {"net4", "cal5", "cal6"}
    states = spark.createDataFrame([("sys1", "done", "PASS"), ("cal6", "done", "FAIL"), ("gpu2", "unclaimed", None), ("mem3", "unclaimed", None), ("cal5", "unclaimed", None), ("net4", "claimed", None)], "id string, state string, status string")
    todo = {r["id"]: r["reason"] for r in mf.eligible(items, states, 4).collect()}
    assert todo == {"gpu2": None, "cal5": "dependency ended badly: cal6", "mem3": "waits for unclaimed gpu2,nope9"}
    plan = [{"id": i, "prio": p, "nodes": n, "est_min": m, "deps": d} for i, p, n, m, d in (("a", 1, 2, 10, []), ("b", 2, 1, 5, []), ("c", 3, 1, 5, ["a"]), ("x", 4, 9, 5, []))]
    assert mf.schedule(plan, [2, 1]) == (15.0, [[("a", 0.0), ("c", 10.0)], [("b", 0.0)]], ["x"])
    near = mf.suggestions(spark.createDataFrame([("sizee",)], "name string"), spark.createDataFrame([("size",), ("seize",), ("other",)], "name string")).first()["near"]
    assert near == ["size", "seize"]


def test_plans(spark):
    assert grids.grid_shape(10, 10, 64) == (1, 1)
    na, nb_, cap = 1000, 700, 256
    best = grids.grid_table(spark, na, nb_, cap).first()
    assert (best["ka"] * best["kb"]) == np.prod(grids.grid_shape(na, nb_, cap))
    rows = grids.pieces(spark, na, nb_, cap, low=900, high=1200).collect()
    assert sum(r["la"] * r["lb"] for r in rows) == na * nb_ and {r["skipped"] for r in rows} == {True, False}
    plan = grids.run_plan(spark, 100_000)
    assert plan.where("not terms_ok").count() == 0 and {r["stage"] for r in plan.collect()} == {"tree", "reciprocal", "division"}
    assert grids.fan_in_schedule(12) == [2, 4, 12] and grids.fan_in_schedule(7) == [7]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    """Files of several splits, of one, of none, with empty lines and without an end of line."""
    texts = {"a.log": "".join(f"line {i}\n" for i in range(3000)), "b.log": "one", "c.log": "", "d.log": "\n\nx\n\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = logs.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {name: [r["value"] for r in sorted((r for r in rows if r["path"].endswith(name)), key=lambda r: r["line_no"])] for name in texts}
    assert got == {"a.log": [f"line {i}" for i in range(3000)], "b.log": ["one"], "c.log": [], "d.log": ["", "", "x", ""]}
    assert sorted(r["line_no"] for r in rows if r["path"].endswith("a.log")) == list(range(3000))


def test_united_tables_and_their_problems(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("# items\n\nid\tn\tx\n a \t1\t2.5\nb\tmany\t1\nc\t3\n#d\t1\t1\n")
    (tmp_path / "b.tsv").write_text("id\tcount\tx\r\nd\t4\t1e2\r\n")
    (tmp_path / "c.tsv").write_text("# nothing\n")
    rows, problems = logs.united_tables(logs.read_lines(spark, str(tmp_path)), ["id", "n", "x"], {"n": "int", "x": "double"})
    file = lambda r: r["path"][-5:]
    assert {(file(r), r["line_no"], r["id"], r["n"], r["x"]) for r in rows.collect()} == {("a.tsv", 3, "a", 1, 2.5), ("b.tsv", 1, "d", 4, 100.0)}
    assert {(file(r), r["line_no"], r["problem"]) for r in problems.collect()} == {("a.tsv", 4, "no number: n"), ("a.tsv", 5, "2 columns, need 3"), ("b.tsv", 0, "header must be id n x")}
    rows, problems = logs.united_tables(logs.read_lines(spark, str(tmp_path)).where("false"), ["id"])
    assert rows.columns == ["path", "line_no", "id"] and rows.count() == problems.count() == 0


def test_nodes_of_text_and_of_tables(spark):
    text = [
        "NodeName=n1 Arch=a NodeAddr=nid-x1c2s3b0n1 State=IDLE Partitions=all,p1", "NodeName=n2 NodeAddr=? Comment=at-x1c2s3b1n0 State=IDLE+DRAIN Partitions=all",
        "NodeName=n3 Comment= State=IDLE Partitions=p1", "NodeName=n4 NodeAddr=x9c9s9b9n9 State=ALLOCATED* Partitions=", "  NodeName=n5 NodeAddr=x1c1s1b1n1", "Other=x1c1s1b1n1",
    ]
    names = spark.createDataFrame([("n4", "x0c1s2b3n4"), ("n3", "x1c1"), ("zz", "x1c1s1b1n1")], "host string, xname string")
    nodes = tp.scheduler_nodes(spark.createDataFrame([(x,) for x in text], "value string"), names)
    got = {r["host"]: (r["cab"], r["chassis"], r["slot"], r["blade"], r["node"], r["state"], r["partitions"], r["skipped"]) for r in nodes.collect()}
    assert got == {"n1": (1, 2, 3, 0, 1, "IDLE", ["all", "p1"], False), "n2": (1, 2, 3, 1, 0, "IDLE+DRAIN", ["all"], False), "n3": (None,) * 5 + ("IDLE", ["p1"], True), "n4": (0, 1, 2, 3, 4, "ALLOCATED*", [], False)}
    free = lambda **how: {r["host"] for r in tp.free_nodes(nodes, **how).where("free").collect()}
    out = tp.name_list(spark.createDataFrame([("n9, n1 # n4",), ("# n4",), ("",)], "value string"))
    assert free() == {"n1"} and free(state="usable") == {"n1", "n4"} and free(partition="p2") == free(excluded=out) == set() and free(excluded=out, state="usable") == {"n4"}
    table = ["host\txname\ta\tb\tc\td\te\tstate", "h1\tx1c2s3b0n1\t\t\t\t\t\tIDLE\tp1,p2", "h2\tx1c2s3b0n2\t\t\t\t\t\tDOWN", "h3\tnone\t\t\t\t\t\tIDLE", "h4\tx1c2s3b0n1"]
    listed = tp.listed_nodes(spark.createDataFrame([(x,) for x in table], "value string")).collect()
    assert {(r["host"], r["node"], r["state"], tuple(r["partitions"])) for r in listed} == {("h1", 1, "IDLE", ("p1", "p2")), ("h2", 2, "DOWN", ())}


def test_sizes_meet_the_smallest_unit(spark):
    nodes = machine(spark)
    sizes = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 8, 16, 17, 32, 33)], "n int")
    want = {0: "blade", 1: "blade", 2: "blade", 3: "slot", 8: "chassis", 16: "cabinet", 17: "system", 32: "system", 33: "system"}
    assert {r["n"]: r["level"] for r in tp.smallest_units(nodes, sizes, "n").collect()} == want
    assert {r["level"] for r in tp.smallest_units(nodes.where("false"), sizes.where("n > 0"), "n").collect()} == {"system"}


def test_runs_against_references(spark):
    digits = "2" + "7" * 299
    chunks = lambda t: spark.createDataFrame([(i // 70, t[i : i + 70]) for i in range(0, len(t), 70)], "chunk_no long, text string")
    parts = spark.createDataFrame([(0, 2, 0, 25), (1, 2, 25, 50)], "part int, nparts int, lo long, hi long")
    say = lambda a, b, p=parts: tuple(dg.compare_run(chunks(a), chunks(b), p).first())
    assert say(digits, digits) == (True, "identical", None)
    assert say(digits[:200], digits)[:2] == (True, "prefix") and say(digits, digits[:200])[:2] == (True, "DIFFERS") and say(digits[:140], digits)[1] == "prefix"
    complete, verdict, first = say(digits[:150] + "8" + digits[151:], digits)
    assert complete and verdict == "DIFFERS" and tuple(first) == (2, 10)
    for wrong in (parts.where("part = 0"), parts.where("part = 1"), parts.union(parts.where("part = 1")), parts.where("false")):
        assert say(digits, digits, wrong) == (False, "DIFFERS", None)
