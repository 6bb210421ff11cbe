import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from numerail.operators import division as dv
from numerail.operators import longnums as ln
from numerail.operators import numbers as nb
from numerail.operators import products as pr
from numerail.operators import recovery as rv
from numerail.operators import residues as rs
from numerail.operators import series as se
from numerail.operators import transforms as tf

B = nb.BASE
R = random.Random(3)
#: Uniform limbs, all limbs at their largest, a power, zeros with a top, small ones.
A = {"u": R.getrandbits(3000), "m": B**40 - 1, "p": B**37, "z": 5 * B**30, "s": 7}
C = {"u": R.getrandbits(1500), "m": 1, "p": B**36 + 1, "z": 5 * B**30 - 1, "s": 3}


@pytest.fixture(scope="module")
def a(spark):
    return nb.from_ints(spark, A).cache()


@pytest.fixture(scope="module")
def c(spark):
    return nb.from_ints(spark, C).cache()


def test_import_and_export(spark, a):
    assert nb.to_ints(a) == A
    texts = spark.createDataFrame([(k, str(v)) for k, v in A.items()], "num string, digits string")
    assert nb.to_ints(nb.from_digits(texts)) == A


def test_sum_difference_and_comparison(a, c):
    assert nb.to_ints(nb.added(a, c)) == {k: A[k] + C[k] for k in A}
    assert nb.to_ints(nb.subtracted(a, c)) == {k: A[k] - C[k] for k in A}
    assert {r["num"]: r["cmp"] for r in nb.compared(a, c).collect()} == {k: (A[k] > C[k]) - (A[k] < C[k]) for k in A}
    assert {r["cmp"] for r in nb.compared(a, a).collect()} == {0}


def test_carry_runs_through_chunks(spark, monkeypatch):
    monkeypatch.setattr(nb, "CHUNK", 4)
    n = {"x": B**70 - 1, "y": B**70 - B**33, "w": B**20}
    one = {"x": 1, "y": B**33, "w": B**20 - 1}
    x, y = nb.from_ints(spark, n), nb.from_ints(spark, one)
    assert nb.to_ints(nb.added(x, y)) == {k: n[k] + one[k] for k in n}
    assert nb.to_ints(nb.subtracted(x, y)) == {k: n[k] - one[k] for k in n}


def test_shift_view_and_small_changes(a):
    assert nb.to_ints(nb.shifted(a, 3)) == {k: v * B**3 for k, v in A.items()}
    assert nb.to_ints(nb.shifted(a, -2))["u"] == A["u"] // B**2
    assert nb.to_ints(nb.view(a, 2, 5))["u"] == A["u"] // B**2 % B**5
    assert nb.to_ints(nb.plus_small(a, 10**9)) == {k: v + 10**9 for k, v in A.items()}
    assert nb.to_ints(nb.times_small(a, 987_654)) == {k: v * 987_654 for k, v in A.items()}
    assert nb.to_ints(nb.complement(a, 200)) == {k: B**200 - v for k, v in A.items()}
    assert {r["num"]: r["found"] for r in nb.any_below(a, 5).collect()} == {k: v % B**5 != 0 for k, v in A.items()}
    assert nb.to_ints(nb.normalized(nb.filled(a, 4))) == A


def test_folds(a):
    assert nb.to_ints(nb.folded(a, 7)) == {k: v % (B**7 - 1) for k, v in A.items()}
    assert {r["num"]: r["r"] for r in nb.alternating_mod(a, True).collect()} == {k: v % (B + 1) for k, v in A.items()}
    assert {r["num"]: r["r"] for r in nb.alternating_mod(a, False).collect()} == {k: v % (B - 1) for k, v in A.items()}


def test_products(a, c):
    want = {k: A[k] * C[k] for k in A}
    assert nb.to_ints(pr.convolved(a, c)) == want
    assert nb.to_ints(pr.multiplied(a, c, size=16)) == want
    assert nb.to_ints(tf.multiplied_by_transforms(a, c)) == want
    assert nb.to_ints(pr.multiplied(a, c, plus=a, size=16)) == {k: want[k] + A[k] for k in A}
    assert nb.to_ints(pr.multiplied(a, c, high=20, size=8)) == {k: want[k] % B**20 for k in A}
    assert nb.to_ints(pr.convolved(a, c, cycle=9))["u"] % (B**9 - 1) == want["u"] % (B**9 - 1)
    high = nb.to_ints(pr.multiplied(a, c, low=40, size=8))
    assert all(high[k] // B**40 <= want[k] // B**40 <= high[k] // B**40 + 16 for k in A if k in high)


def test_many_products(spark):
    pairs = [(i, str(R.getrandbits(700)), str(R.getrandbits(90))) for i in range(50)]
    got = {r["pair_id"]: int(r["product"]) for r in pr.multiply_many(spark.createDataFrame(pairs, "pair_id long, a string, b string")).collect()}
    assert got == {i: int(x) * int(y) for i, x, y in pairs}


def test_checked_product_sees_a_single_wrong_limb(a, c, monkeypatch):
    primes = list(rs.CHECK_PRIMES[:2])
    a, c = a.where("num = 'u'"), c.where("num = 'u'")
    assert nb.to_ints(pr.checked_product(a, c, primes))["u"] == A["u"] * C["u"]
    good = pr.multiplied
    monkeypatch.setattr(pr, "multiplied", lambda *x, **y: nb.plus_small(good(*x, **y), 1, 3))
    with pytest.raises(ArithmeticError):
        pr.checked_product(a, c, primes, attempts=1, size=32)


def test_residues(spark, a, monkeypatch):
    primes = [1_000_003, *rs.CHECK_PRIMES]
    want = {k: [v % q for q in primes] for k, v in A.items()}
    for fan in (4096, 8):
        monkeypatch.setattr(rs, "FAN", fan)
        assert {r["num"]: [int(r[f"r{i}"]) for i in range(9)] for r in rs.limbs_mod(a, primes).collect()} == want
    text = str(A["u"])
    cuts = [0, 5, 40, 41, 300, len(text)]
    chunks = spark.createDataFrame([("n", i, text[x:y]) for i, (x, y) in enumerate(zip(cuts, cuts[1:]))], "num string, chunk_no int, text string")
    assert [int(x) for x in rs.digits_mod(chunks, primes).first()[1:]] == [int(text) % q for q in primes]
    assert all(rs.is_prime(q) and q > 2**62 for q in rs.CHECK_PRIMES) and len(set(rs.CHECK_PRIMES)) == 8


def test_series_and_its_residues(spark):
    p, q = se.leaf_fold(1, 1001)
    found = se.split_series(spark, 1000, leaf=200)
    assert [whole(x)["e"] for x in found] == [p, q]
    got = {int(r["prime"]): (int(r["p"]), int(r["q"])) for r in rs.series_mod(1000, spark, list(rs.CHECK_PRIMES[:2])).collect()}
    assert got == {m: (p % m, q % m) for m in rs.CHECK_PRIMES[:2]}
    assert nb.to_ints(se.e_digits(spark, 40))["e"] == 27182818284590452353602874713526624977572
    assert se.terms_for(1000) > 450


def whole(df):
    """Integers of PACKED numbers."""
    out = {}
    for r in df.collect():
        out[r["num"]] = out.get(r["num"], 0) + ln.integer_of(np.frombuffer(r["data"], dtype=np.uint32)) * B ** (r["chunk"] * nb.CHUNK)
    return out


def packed(spark, numbers):
    return ln.packed(nb.from_ints(spark, numbers))


def test_packed_numbers(spark):
    """Sums, differences, shifts, products by transforms, whole, in pieces and wrapped, against integers."""
    a = {"a": R.randrange(B**9000), "z": 0, "n": B**8192 - 1, "s": 7}
    c = {"a": R.randrange(B**5000), "z": 5, "n": B**8192 - 1, "s": B**4096}
    x, y = packed(spark, a), packed(spark, c)
    assert whole(ln.sum_of(x, y)) == {k: a[k] + c[k] for k in a}
    high, low = {k: max(a[k], c[k]) for k in a}, {k: min(a[k], c[k]) for k in a}
    assert whole(ln.difference(packed(spark, high), packed(spark, low))) == {k: high[k] - low[k] for k in a}
    assert {r["num"]: r["cmp"] for r in ln.compared(x, y).collect()} == {k: (a[k] > c[k]) - (a[k] < c[k]) for k in a}
    for by in (3, 5000, -5000, -20000):
        assert whole(ln.carried(ln.shifted(x, by))) == {k: a[k] * B**by if by > 0 else a[k] // B**-by for k in a}
    want = {k: a[k] * c[k] for k in a}
    assert whole(ln.product(x, y, plus=x)) == {k: want[k] + a[k] for k in a}
    assert whole(ln.product(x, y, max_points=8192)) == want
    assert whole(ln.product(x, y, high=100)) == {k: v % B**100 for k, v in want.items()}
    for cycle in (8192, 12288):
        assert whole(ln.wrapped_product(x, y, cycle)) == {k: v % (B**cycle - 1) for k, v in want.items()}
    primes = [998_244_353, rs.CHECK_PRIMES[0]]
    assert {r["num"]: [int(r["r0"]), int(r["r1"])] for r in ln.residues(x, primes).collect()} == {k: [v % q for q in primes] for k, v in a.items()}
    assert nb.to_ints(ln.unpacked(x)) == a


def test_products_of_wide_matrices(spark):
    """Rows of a transform that are as long as a chunk or longer."""
    a, c = R.randrange(B**9000), R.randrange(B**5000)
    x, y = packed(spark, {"a": a}), packed(spark, {"a": c})
    for columns in (2048, 4096, 8192):
        assert whole(ln.carried(ln.product_pieces(x, y, columns=columns)))["a"] == a * c


def test_only_a_wrong_place_is_made_again(spark):
    """One spoiled place of several costs one place; an operand that changed is seen; a fault that stays is an error."""
    a, c = R.randrange(B**40000), R.randrange(B**9000)
    x, y = packed(spark, {"n|1": a, "m": 5}), packed(spark, {"n|1": c, "m": 7})

    def spoiled(places, attempt):
        if attempt:
            return places
        wrong = (F.col("num") == "n|1|2") & (F.col("chunk") == 1)
        return places.withColumn("data", F.when(wrong, F.lit(bytes(4 * nb.CHUNK))).otherwise(F.col("data")))

    product, made = rv.product_in_pieces(x, y, 16384, fault=spoiled)
    assert whole(product) == {"n|1": a * c, "m": 35}
    assert made[1:] == [1] and made[0] == 5 + 1 + 1 - 1 + 1
    with pytest.raises(ArithmeticError, match="after 2 attempts"):
        rv.product_in_pieces(x, y, 16384, attempts=2, fault=lambda places, attempt: spoiled(places, 0))
    recorded = rv.piece_residues(x, 8192, list(rs.CHECK_PRIMES[:2]))
    changed = x.withColumn("data", F.when(F.col("chunk") == 3, F.lit(bytes(4 * nb.CHUNK))).otherwise(F.col("data")))
    assert [tuple(r) for r in rv.at_rest(changed, recorded, 8192, list(rs.CHECK_PRIMES[:2])).collect()] == [("n|1", 1)]


@pytest.mark.parametrize("digits", [(1800, 720, 32, True), (9000, 4100, 300, False)])
def test_division_by_a_newton_reciprocal(spark, digits):
    n, m, seed, wrap = digits
    x, y = R.randrange(10**n), R.randrange(10**m)
    q, r = se.divided(nb.from_ints(spark, {"n": x}), nb.from_ints(spark, {"n": y}), seed=seed, steps=dv.Steps(wrap=wrap))
    assert (nb.to_ints(q)["n"], nb.to_ints(r)["n"]) == divmod(x, y)


def test_wrapped_division_takes_fewer_points_and_names_faults(spark):
    """What a product leaves is known to be short, so half of the points do; a fault is named with its step."""
    x, y = R.randrange(B**12000), R.randrange(B**6000)
    a, q = packed(spark, {"n": x}), packed(spark, {"n": y})
    estimate = packed(spark, {"n": x // y + 2})
    points = {}
    for wrap in (True, False):
        steps = dv.Steps(wrap=wrap)
        left, sign = dv.rest(a, estimate, q, 6003, steps, "quotient")
        assert sign == -1 and whole(left)["n"] == (x // y + 2) * y - x
        points[wrap] = steps.points["quotient"]
    assert points == {True: 8192, False: 12288}
    faulty = dv.Steps(fault=lambda name, left: ln.sum_of(left, dv.from_int(spark, "n", 1)))
    with pytest.raises(ArithmeticError, match="step quotient of test"):
        dv.rest(a, estimate, q, 6003, faulty, "quotient of test")


def test_a_tree_goes_on_from_a_saved_level(spark, tmp_path):
    """Levels agree with the recurrence; a run that stopped goes on; a level of another series is refused."""
    path, made = str(tmp_path / "tree"), []
    terms, leaf = 1100, 200
    primes = list(rs.CHECK_PRIMES[:2])

    def seen(level, nodes):
        made.append(level)
        spans = [(i * leaf * 2**level + 1, min(terms, (i + 1) * leaf * 2**level) + 1) for i in range(-(-terms // (leaf * 2**level)))]
        want = {f"{i}{k}": v for i, span in enumerate(spans) for k, v in zip("pq", se.leaf_fold(*span), strict=True)}
        got = {r["num"]: [int(r["r0"]), int(r["r1"])] for r in ln.residues(nodes, primes).collect()}
        assert got == {k: [v % m for m in primes] for k, v in want.items()}
        if level == 2 and len(made) == 3:
            raise KeyboardInterrupt  # before level 2 is saved

    with pytest.raises(KeyboardInterrupt):
        se.split_series(spark, terms, leaf, path, seen)
    p, q = se.split_series(spark, terms, leaf, path, seen)
    assert made == [0, 1, 2, 2, 3] and [whole(x)["e"] for x in (p, q)] == list(se.leaf_fold(1, terms + 1))
    with pytest.raises(ValueError, match="another series"):
        se.split_series(spark, terms + 1, leaf, path)


def test_short_division(spark):
    x, y = R.getrandbits(900), R.getrandbits(400)
    q, r = se.divided(nb.from_ints(spark, {"n": x}), nb.from_ints(spark, {"n": y}))
    assert (nb.to_ints(q)["n"], nb.to_ints(r)["n"]) == divmod(x, y)


@pytest.mark.parametrize("n", [1, 5, 7, 13, 40, 45, 577])
def test_transforms_of_any_length(n):
    p = tf.primes_for(n)[0]
    w, r = tf.root_of_unity(n, p), np.random.default_rng(n)
    x = r.integers(0, p, (n, 3)).astype(np.uint64)
    want = [[sum(int(x[j, c]) * pow(w, j * k, p) for j in range(n)) % p for c in range(3)] for k in range(n)]
    assert tf.transform_any(x, p, w).tolist() == want


@pytest.mark.parametrize("rows, cols", [(20, 8), (13, 16)])
def test_four_steps_of_any_group(spark, rows, cols):
    n = rows * cols
    p = tf.primes_for(n)[0]
    x, w = [R.randrange(p) for _ in range(n)], tf.root_of_unity(n, p)
    df = spark.createDataFrame(list(enumerate(x)), "idx long, v long")
    there = tf.four_step(df, rows, cols, p)
    assert [r["v"] for r in there.orderBy("idx").collect()] == [sum(v * pow(w, i * k, p) for i, v in enumerate(x)) % p for k in range(n)]
    # on the way back rows and columns change places
    back = tf.four_step(there, cols, rows, p, inverse=True)
    assert [r["v"] for r in back.orderBy("idx").collect()] == x


@pytest.mark.parametrize("have, want", [(6, 24), (6, 15), (9, 24), (24, 9), (7, 5), (1, 38)])
def test_regrouping_goes_both_ways(spark, have, want):
    v = R.randrange(10**400)
    units = [("n", i, str(v // 10 ** (i * have) % 10**have)) for i in range(-(-400 // have))]
    df = spark.createDataFrame(units, "num string, idx long, limb string").selectExpr("num", "idx", "cast(limb as decimal(38,0)) AS limb")
    there = nb.regrouped(df, have, want)
    assert {r["idx"]: int(r["value"]) for r in there.collect()} == {i: v // 10 ** (i * want) % 10**want for i in range(-(-(-(-400 // have) * have) // want))}
    back = nb.regrouped(there, want, have, "value")
    assert {r["idx"]: int(r["value"]) for r in back.collect() if r["idx"] < len(units)} == {i: int(x) for _, i, x in units}


def test_transforms(spark):
    p = tf.transform_primes(1)[0]
    x = np.array([R.randrange(p) for _ in range(64)])
    w = tf.root_of_unity(64, p)
    want = [sum(int(v) * pow(w, i * k, p) for i, v in enumerate(x)) % p for k in range(64)]
    assert tf.transform_mod(x, p).tolist() == want and tf.transform_mod(tf.transform_mod(x, p), p, True).tolist() == x.tolist()
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(x)], "idx long, v long")
    assert [r["v"] for r in tf.four_step(df, 8, 8, p).orderBy("idx").collect()] == want
    assert tf.bounds_ok(1000, tf.transform_primes(3)) and not tf.bounds_ok(1000, tf.transform_primes(1))
    assert tf.length_for(65) == 128 and tf.length_for(65, (1, 3)) == 96
