"""Number-theoretic transforms and residue-number products as vectorised kernels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import BASE, carried
from .residues import is_prime


def transform_primes(count: int, log_length: int = 20, bits: int = 31, thirds: int = 1) -> list[int]:
    """Primes c * 2^log_length + 1 below 2^bits, the largest first; with
    ``thirds`` = 3 those that have roots for lengths 3 * 2^k too."""
    out, c = [], (2**bits - 1) >> log_length
    while len(out) < count:
        p = (c << log_length) + 1
        if (p - 1) % thirds == 0 and is_prime(p):
            out.append(p)
        c -= 1
    return out


def prime_factors(n: int) -> list[int]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return out + [n] * (n > 1)


def root_of_unity(n: int, p: int) -> int:
    """An element of order n modulo p, for an n that divides p - 1."""
    if (p - 1) % n:
        raise ValueError(f"{n} does not divide {p} - 1")
    factors = prime_factors(n)
    for g in range(1, p):
        w = pow(g, (p - 1) // n, p)
        if all(pow(w, n // f, p) != 1 for f in factors):
            return w
    raise ValueError("no root")


def primes_for(n: int, count: int = 1, bits: int = 31) -> list[int]:
    """Primes below 2^bits modulo which columns of any length n have a transform, the largest first."""
    step = math.lcm(2 * n, 1 << max(1, (2 * n - 1).bit_length()))
    out, c = [], (2**bits - 2) // step
    while len(out) < count and c > 0:
        if is_prime(c * step + 1):
            out.append(c * step + 1)
        c -= 1
    if len(out) < count:
        raise ValueError(f"no {count} primes of {bits} bits for the length {n}")
    return out


def transform_any(x: np.ndarray, p: int, w: int) -> np.ndarray:
    """Transforms of all columns of a matrix of any number n of rows, with a root w of order n.

    Odd factors up to 7 are taken out one by one (n = f m: f transforms of every
    f-th row, joined by powers of the root); what is left is a power of two, or
    a length whose transform is a convolution with a chirp, for which 2 n and a
    power of two above 2 n divide p - 1 (primes_for).
    """
    n, k = x.shape
    m = np.uint64(p)
    for f in (3, 5, 7):
        if n % f == 0 and n > f:
            parts = [transform_any(np.ascontiguousarray(x[j::f]), p, pow(w, f, p)) for j in range(f)]
            turn = powers_of([pow(w, j, p) for j in range(f)], n, p)
            return sum(np.tile(parts[j], (f, 1)) * turn[:, j : j + 1] % m for j in range(f)) % m
    if n & (n - 1) == 0:
        return transform_columns(x, p, w)
    # j k = (j^2 + k^2 - (k - j)^2) / 2: a convolution with the powers of a root of w
    half = root_of_unity(2 * n, p)
    half = next(r for e in range(1, 2 * n, 2) if pow(r := pow(half, e, p), 2, p) == w)
    chirp = np.array([pow(half, j * j % (2 * n), p) for j in range(n)], dtype=np.uint64)
    back = np.array([pow(half, -j * j % (2 * n), p) for j in range(n)], dtype=np.uint64)
    size = 1 << (2 * n - 1).bit_length()
    long, kernel = np.zeros((size, k), dtype=np.uint64), np.zeros((size, 1), dtype=np.uint64)
    long[:n] = x % m * chirp[:, None] % m
    kernel[:n, 0] = back
    kernel[size - n + 1 :, 0] = back[1:][::-1]
    root = root_of_unity(size, p)
    both = transform_columns(long, p, root) * transform_columns(kernel, p, root) % m
    out = transform_columns(both, p, pow(root, p - 2, p)) * np.uint64(pow(size, p - 2, p)) % m
    return out[:n] * chirp[:, None] % m


def length_for(n: int, factors: tuple[int, ...] = (1,)) -> int:
    """The least transform length f * 2^k that holds n points."""
    return min(f << max(0, (-(-n // f) - 1).bit_length()) for f in factors)


def transform_mod(x: np.ndarray, p: int, inverse: bool = False) -> np.ndarray:
    """Transform of a length 2^k or 3 * 2^k modulo p < 2^31, in vectorised passes.

    Stockham's form: each pass joins halves of ever longer runs, so there is
    no reordering pass. A length of three parts is three transforms of every
    third value, joined by powers of the root.
    """
    n = len(x)
    if n % 3 == 0:
        return _by_thirds(x, p, inverse)
    w = root_of_unity(n, p) if n > 1 else 1
    return _passes(x, p, pow(w, p - 2, p) if inverse else w, inverse)


def _by_thirds(x: np.ndarray, p: int, inverse: bool) -> np.ndarray:
    n = len(x)
    part, m = n // 3, np.uint64(p)
    w = root_of_unity(n, p)
    w = pow(w, p - 2, p) if inverse else w
    cube = pow(w, 3, p)
    parts = [_passes(x[j::3], p, cube, False) for j in range(3)]
    powers = np.ones(n, dtype=np.uint64)
    span = 1
    while span < n:  # powers by doubling
        powers[span : 2 * span] = powers[: min(span, n - span)] * np.uint64(pow(w, span, p)) % m
        span *= 2
    at = np.arange(n)
    out = sum(parts[j][at % part] * powers[at * j % n] % m for j in range(3)) % m
    return out * np.uint64(pow(n, p - 2, p)) % m if inverse else out


def _passes(x: np.ndarray, p: int, w: int, scaled: bool) -> np.ndarray:
    """The passes of a power-of-two length with the root w; ``scaled`` divides by the length."""
    n = len(x)
    m, a = np.uint64(p), x.astype(np.uint64) % np.uint64(p)
    half, stride = n // 2, 1
    while half >= 1:
        step = pow(w, stride, p)
        twiddle = np.ones(half, dtype=np.uint64)
        span = 1
        while span < half:  # powers by doubling
            twiddle[span : 2 * span] = twiddle[: min(span, half - span)] * np.uint64(pow(step, span, p)) % m
            span *= 2
        block = a.reshape(2, half, stride)
        total = (block[0] + block[1]) % m
        diff = (block[0] + m - block[1]) % m * twiddle[:, None] % m
        a = np.stack([total, diff], axis=1).reshape(-1)
        half, stride = half // 2, stride * 2
    return a * np.uint64(pow(n, p - 2, p)) % m if scaled else a


def powers_of(bases: list[int], n: int, p: int) -> np.ndarray:
    """The powers 0 .. n - 1 of some numbers modulo p, a column for each, by doubling."""
    m = np.uint64(p)
    out = np.ones((n, len(bases)), dtype=np.uint64)
    span = 1
    while span < n:
        step = np.array([pow(b, span, p) for b in bases], dtype=np.uint64)
        out[span : 2 * span] = out[: min(span, n - span)] * step % m
        span *= 2
    return out


def transform_columns(x: np.ndarray, p: int, w: int) -> np.ndarray:
    """Transforms of all columns of a matrix at once, with a root w of the order of its rows, 2^k or 3 * 2^k.

    Stockham's passes over rows that are whole lines of the matrix; not scaled on the way back.
    """
    n, k = x.shape
    m = np.uint64(p)
    if n % 3 == 0:
        part = n // 3
        parts = [transform_columns(np.ascontiguousarray(x[j::3]), p, pow(w, 3, p)) for j in range(3)]
        turn = powers_of([pow(w, j, p) for j in range(3)], n, p)
        return sum(np.tile(parts[j], (3, 1)).reshape(3 * part, k) * turn[:, j : j + 1] % m for j in range(3)) % m
    a, half, stride = np.ascontiguousarray(x, dtype=np.uint64).reshape(-1), n // 2, k
    while half >= 1:
        twiddle = powers_of([pow(w, stride // k, p)], half, p)
        block = a.reshape(2, half, stride)
        total = block[0] + block[1]
        total -= m * (total >= m)
        diff = (block[0] + m - block[1]) * twiddle % m
        a = np.stack([total, diff], axis=1).reshape(-1)
        half, stride = half // 2, stride * 2
    return a.reshape(n, k)


def cyclic_product(x: np.ndarray, y: np.ndarray, p: int) -> np.ndarray:
    return transform_mod(transform_mod(x, p) * transform_mod(y, p) % np.uint64(p), p, inverse=True)


def residue_planes(df: DataFrame, primes: list[int]) -> DataFrame:
    """Limbs to one residue column per prime."""
    return df.select("num", "idx", *[(F.col("limb") % p).alias(f"r{i}") for i, p in enumerate(primes)])


def garner(primes: list[int], residues: list[Column]) -> list[Column]:
    """Mixed-radix digits v0, v1, ... of the value with these residues (31-bit primes)."""
    digits: list[Column] = []
    for i, p in enumerate(primes):
        v = residues[i].cast("long")
        for j, d in enumerate(digits):
            v = F.pmod((v - d) % p * pow(primes[j], -1, p), F.lit(p))
        digits.append(v)
    return digits


def garner_limbs(primes: list[int], digits: list[Column], base: int = BASE) -> list[Column]:
    """Base digits of v0 + v1 p0 + v2 p0 p1 + ... as column sums per position (not yet carried)."""
    weight, out = 1, {}
    for p, d in zip(primes, digits, strict=True):
        w, k = weight, 0
        while w:
            # digits are below 2^31 and pieces of the weight below 10^6, so sums stay in a bigint
            out.setdefault(k, []).append(d * (w % base))
            w, k = w // base, k + 1
        weight *= p
    return [sum(out[k][1:], out[k][0]) for k in sorted(out)]


def multiplied_by_transforms(a: DataFrame, b: DataFrame, primes: list[int] | None = None) -> DataFrame:
    """Product of numbers by transforms modulo several primes, one task per number and prime.

    The primes' product must exceed terms * (base - 1)^2. The recombination and
    the carry are column expressions.
    """
    primes = primes or transform_primes(3)
    rows = residue_planes(a, primes).withColumn("side", F.lit(0)).unionByName(residue_planes(b, primes).withColumn("side", F.lit(1)))
    planes = F.array(*[F.struct(F.lit(i).alias("plane"), F.col(f"r{i}").alias("r")) for i in range(len(primes))])
    tall = rows.select("num", "idx", "side", F.explode(planes).alias("x")).select("num", "idx", "side", "x.plane", "x.r")

    def kernel(key, f: pd.DataFrame) -> pd.DataFrame:
        p = primes[key[1]]
        sides = [f[f["side"] == s] for s in (0, 1)]
        tops = [int(s["idx"].max()) + 1 if len(s) else 0 for s in sides]
        n = length_for(max(1, sum(tops)))
        x = [np.zeros(n, dtype=np.uint64) for _ in sides]
        for v, s in zip(x, sides, strict=True):
            v[s["idx"].to_numpy()] = s["r"].to_numpy().astype(np.uint64)
        out = cyclic_product(x[0], x[1], p)[: max(1, sum(tops) - 1)]
        return pd.DataFrame({"num": key[0], "plane": key[1], "idx": np.arange(len(out)), "r": out.astype(np.int64)})

    done = tall.groupBy("num", "plane").applyInPandas(kernel, "num string, plane int, idx long, r long")
    wide = done.groupBy("num", "idx").agg(*[F.max(F.when(F.col("plane") == i, F.col("r"))).alias(f"r{i}") for i in range(len(primes))])
    for i, d in enumerate(garner(primes, [F.col(f"r{i}") for i in range(len(primes))])):
        wide = wide.withColumn(f"v{i}", d)
    pieces = garner_limbs(primes, [F.col(f"v{i}") for i in range(len(primes))])
    parts = F.array(*[F.struct((F.col("idx") + k).alias("idx"), c.alias("limb")) for k, c in enumerate(pieces)])
    sums = wide.select("num", F.explode(parts).alias("p")).select("num", "p.idx", "p.limb").groupBy("num", "idx").agg(F.sum("limb").alias("limb"))
    return carried(sums)


def bounds_ok(terms: int, primes: list[int], base: int = BASE) -> bool:
    """Whether the primes determine sums of so many limb products."""
    m = 1
    for p in primes:
        m *= p
    return terms * (base - 1) ** 2 < m


def out_of_range(df: DataFrame) -> DataFrame:
    """Rows that are no limbs; empty for a sound number."""
    return df.where("limb < 0 or limb >= 1000000 or limb is null or idx < 0")


def four_step(df: DataFrame, rows: int, cols: int, p: int, inverse: bool = False) -> DataFrame:
    """Distributed transform of (idx, v): rows * cols points, as column transforms,
    twiddles, a transpose by shuffle, and row transforms. One exchange for each
    side, none holds more than a row or column. Rows and columns may be of any
    number, such as that of a group of workers, for which p has roots. The
    result is in the order of idx.
    """
    n = rows * cols
    w = root_of_unity(n, p)
    if inverse:
        w = pow(w, p - 2, p)

    def side(f: pd.DataFrame, at: str, length: int, root: int) -> np.ndarray:
        v = np.zeros((length, 1), dtype=np.uint64)
        v[f[at].to_numpy(), 0] = f["v"].to_numpy().astype(np.uint64)
        out = transform_any(v, p, root)[:, 0]
        return out * np.uint64(pow(length, p - 2, p)) % np.uint64(p) if inverse else out  # the scales of the sides make up that of the whole

    def columns(key, f: pd.DataFrame) -> pd.DataFrame:
        c = int(key[0])
        out = side(f, "r", rows, pow(w, cols, p)) * powers_of([pow(w, c, p)], rows, p)[:, 0] % np.uint64(p)
        return pd.DataFrame({"r": np.arange(rows), "c": c, "v": out.astype(np.int64)})

    def lines(key, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"idx": int(key[0]) + rows * np.arange(cols), "v": side(f, "c", cols, pow(w, rows, p)).astype(np.int64)})

    cells = df.select(F.expr(f"idx div {cols}").cast("int").alias("r"), (F.col("idx") % cols).cast("int").alias("c"), "v")
    mid = cells.groupBy("c").applyInPandas(columns, "r int, c int, v long")
    return mid.groupBy("r").applyInPandas(lines, "idx long, v long")
