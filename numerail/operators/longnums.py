"""Long numbers as packed chunks: (num, chunk, data, top), 4096 limbs of base 10^6 a row.

``data`` holds the limbs of positions chunk * 4096 .. as little-endian unsigned
32-bit integers, ``top`` the position of the highest limb that is not zero, or
-1. A chunk without a row is zero; every number has a row for chunk 0. Sums,
differences and products of very many limbs pass through the kernels below as
arrays; only the first and the last step of a calculation has a row per limb.

A product is a four-step transform modulo three primes. The points of a piece
are a matrix of R rows and C columns; bands of columns, then bands of rows, are
the work of a task, and what tasks exchange are tiles, the parts of a band in
each band of the other kind. Pieces of longer operands are transformed once
each, and their products are added up before the way back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .numbers import BASE, CHUNK, incoming
from .storage import partitions, stored
from .transforms import bounds_ok, length_for, powers_of, root_of_unity, transform_columns, transform_primes

PACKED = "num string, chunk long, data binary, top long"
#: Values that are added up at start, start + 1, ... (width of them), then from start + stride on, of a chunk.
PIECE = "num string, chunk long, start long, stride long, width int, data binary"
CARRYING = "num string, chunk long, data binary, out long, low long, nines boolean, zeros boolean"
TILE = "num string, side int, piece int, band int, other int, data binary"
#: Points of a transform; longer operands are cut into pieces of half of them.
MAX_POINTS = 1 << 24
#: Points that a band should have at least, and of a tile.
BAND_POINTS, TILE_POINTS = 1 << 14, 256
#: Limbs of a coefficient: three primes of 31 bits are below 10^30.
SPREAD = 5
#: Chunks whose carries are scanned in one window, and broadcast; rows of 50 bytes.
SCANNED = 1 << 17
#: Chunks whose carries the driver scans itself, from a row of 50 bytes each.
HEADS = 1 << 14
#: Bytes of an Arrow batch to and from Python, and rows of it that are Python objects at once.
BATCH_BYTES, AT_ONCE = 8 << 20, 256


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*((f.split(" ")[0], kinds[f.split(" ")[1]]) for f in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def _batches(rows: Iterator[tuple], schema: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches of a bounded number of bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, bytes))
        if size > most:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            part = b.slice(at, AT_ONCE)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of sorted input: one group at a time is held."""
    now, held, n = None, [], len(keys)
    for row in _rows(batches, [*keys, *columns]):
        if row[:n] != now:
            if held:
                yield now, held
            now, held = row[:n], []
        held.append(row[n:])
    if held:
        yield now, held


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    # no number of partitions: adaptive execution joins small ones, so short numbers take few tasks
    return df.repartition(*keys).sortWithinPartitions(*keys)


def _mapped(df: DataFrame, rows_of, schema: str) -> DataFrame:
    """Runs ``rows_of`` (record batches to rows) on the executors."""

    def run(batches):
        yield from _batches(rows_of(batches), schema)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bytes per Arrow batch where they are above BATCH_BYTES: a row may have 32 KB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m")
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


# ---- rows and chunks


def pieces_of(df: DataFrame) -> DataFrame:
    """(num, idx, limb) with any integers as limbs, also several at a position, to PIECE."""
    cut = df.where((F.col("limb") != 0) | (F.col("idx") == 0)).select("num", F.expr(f"idx div {CHUNK}").alias("chunk"), F.struct(F.expr(f"idx % {CHUNK}").cast("int").alias("k"), F.col("limb").cast("long").alias("limb")).alias("s"))
    lists = cut.groupBy("num", "chunk").agg(F.collect_list("s").alias("s"))

    def rows_of(batches):
        for b in batches:
            items = b.column("s")
            at, k, v = items.offsets.to_numpy(), items.values.field("k").to_numpy(), items.values.field("limb").to_numpy()
            for i, (num, chunk) in enumerate(zip(b.column("num").to_pylist(), b.column("chunk").to_pylist(), strict=True)):
                dense = np.zeros(CHUNK, dtype=np.int64)
                np.add.at(dense, k[at[i] : at[i + 1]], v[at[i] : at[i + 1]])
                yield num, chunk, 0, CHUNK, CHUNK, dense.tobytes()

    return _mapped(lists, rows_of, PIECE)


def packed(df: DataFrame) -> DataFrame:
    """(num, idx, limb), one row a position and limbs below the base, to PACKED (stored)."""

    def rows_of(batches):
        for num, chunk, data in _rows(batches, ["num", "chunk", "data"]):
            yield _packed_row(num, chunk, np.frombuffer(data, dtype=np.int64))

    return stored(_mapped(pieces_of(df), rows_of, PACKED), "packed")


def _packed_row(num: str, chunk: int, limbs: np.ndarray) -> tuple:
    used = np.flatnonzero(limbs)
    return num, chunk, limbs.astype(np.uint32).tobytes(), chunk * CHUNK + int(used[-1]) if len(used) else -1


def tops(a: DataFrame) -> DataFrame:
    """num, top: the highest position of each number (0 for zero)."""
    return a.groupBy("num").agg(F.greatest(F.max("top"), F.lit(0)).alias("top"))


def unpacked(a: DataFrame) -> DataFrame:
    """PACKED to (num, idx, limb), dense from 0 to the top of each number. ``a`` should be stored."""
    grid = tops(a).select("num", "top", F.explode(F.expr(f"sequence(0L, top div {CHUNK})")).alias("chunk"))
    both = grid.join(a.select("num", "chunk", "data"), ["num", "chunk"], "left")

    def run(batches):
        for num, chunk, top, data in _rows(batches, ["num", "chunk", "top", "data"]):
            n = min(CHUNK, top - chunk * CHUNK + 1)
            limbs = np.zeros(n, dtype=np.int64) if data is None else np.frombuffer(data, dtype=np.uint32, count=n).astype(np.int64)
            names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, dtype=np.int32)), pa.array([num], pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(np.arange(chunk * CHUNK, chunk * CHUNK + n)), pa.array(limbs)], ["num", "idx", "limb"])

    return both.mapInArrow(run, "num string, idx long, limb long")


def as_pieces(a: DataFrame, factor: int = 1) -> DataFrame:
    """PACKED times a small integer (also a negative one), as PIECE."""

    def rows_of(batches):
        for num, chunk, data in _rows(batches, ["num", "chunk", "data"]):
            yield num, chunk, 0, CHUNK, CHUNK, (np.frombuffer(data, dtype=np.uint32).astype(np.int64) * factor).tobytes()

    return _mapped(a.select("num", "chunk", "data"), rows_of, PIECE)


def shifted(a: DataFrame, by: int) -> DataFrame:
    """Times base^by, or the whole part of the quotient by base^-by, as PIECE."""

    def rows_of(batches):
        for num, chunk, data in _rows(batches, ["num", "chunk", "data"]):
            limbs, at = np.frombuffer(data, dtype=np.uint32).astype(np.int64), chunk * CHUNK + by
            if at < 0:
                limbs, at = limbs[-at:], 0
                if chunk == 0 or not len(limbs):
                    yield num, 0, 0, CHUNK, 1, np.zeros(1, dtype=np.int64).tobytes()  # every number has a row for chunk 0
            elif chunk == 0 and at >= CHUNK:
                yield num, 0, 0, CHUNK, 1, np.zeros(1, dtype=np.int64).tobytes()
            while len(limbs):
                n = min(len(limbs), CHUNK - at % CHUNK)
                yield num, at // CHUNK, at % CHUNK, CHUNK, n, limbs[:n].tobytes()
                limbs, at = limbs[n:], at + n

    return _mapped(a.select("num", "chunk", "data"), rows_of, PIECE)


def below(a: DataFrame, high: int) -> DataFrame:
    """The number modulo base^high."""

    def rows_of(batches):
        for num, chunk, data in _rows(batches, ["num", "chunk", "data"]):
            limbs = np.frombuffer(data, dtype=np.uint32).astype(np.int64)
            limbs[max(0, high - chunk * CHUNK) :] = 0
            yield _packed_row(num, chunk, limbs)

    return _mapped(a.where((F.col("chunk") * CHUNK < high) | (F.col("chunk") == 0)).select("num", "chunk", "data"), rows_of, PACKED)


# ---- sums and carries


def _settled(s: np.ndarray) -> int:
    """Carries (and borrows) within a chunk, in place; returns what goes out."""
    out = 0
    while True:
        c = s // BASE
        if not c.any():
            return out
        s -= c * BASE
        out += int(c[-1])
        s[1:] += c[:-1]


def added_up(parts: DataFrame) -> DataFrame:
    """PIECE to CARRYING: the sums of each chunk with its own carries settled, and what goes out of it."""

    def rows_of(batches):
        for (num, chunk), rows in _groups(batches, ["num", "chunk"], ["start", "stride", "width", "data"]):
            s = np.zeros(CHUNK, dtype=np.int64)
            for start, stride, width, data in rows:
                v = np.frombuffer(data, dtype=np.int64).reshape(-1, width)
                if len(v) == 1:
                    s[start : start + width] += v[0]
                else:
                    np.add.at(s, start + stride * np.arange(len(v))[:, None] + np.arange(width), v)
            out = _settled(s)
            low = int(s[0]) + int(s[1]) * BASE + int(s[2]) * BASE**2
            yield num, chunk, s.astype(np.uint32).tobytes(), out, low, bool((s[3:] == BASE - 1).all()), not s[3:].any()

    return _mapped(_dealt(parts, "num", "chunk"), rows_of, CARRYING)


def assembled(parts: DataFrame) -> DataFrame:
    """PIECE to PACKED (stored), where no two values meet at a position and all are limbs: a shifted number."""

    def rows_of(batches):
        for (num, chunk), rows in _groups(batches, ["num", "chunk"], ["start", "width", "data"]):
            s = np.zeros(CHUNK, dtype=np.int64)
            for start, width, data in rows:
                s[start : start + width] += np.frombuffer(data, dtype=np.int64)
            yield _packed_row(num, chunk, s)

    return stored(_mapped(_dealt(parts, "num", "chunk"), rows_of, PACKED), "packed")


def carried(parts: DataFrame, difference: bool = False) -> DataFrame:
    """PIECE to PACKED (stored): the sums as numbers.

    What goes out of a chunk is known before what comes in, except for chunks
    of only nines (zeros, for a difference), which hand on; so the carries
    between chunks are a scan over one small row per chunk. ``difference``: the
    sums are those of a - b with a >= b.
    """
    counted = Observation()
    done = stored(added_up(parts).observe(counted, F.count(F.lit(1)).alias("n")), "carrying")
    if counted.get["n"] <= HEADS:
        return _carried_by_heads(done, difference)
    heads = done.select("num", "chunk", "out", "low", "nines", "zeros")
    after = heads.select("num", (F.col("chunk") + 1).alias("chunk"), "out")
    every = heads.select("num", "chunk", F.lit(0).cast("long").alias("out"), "low", "nines", "zeros").unionByName(after, allowMissingColumns=True)
    # up to a number of chunks the scan is one window, beyond it goes by runs of chunks
    tiers = 1 if counted.get["n"] <= SCANNED else 2
    if tiers == 1:
        every = every.repartition(partitions(done.sparkSession), "num")
    every = every.groupBy("num", F.col("chunk").alias("idx")).agg(F.sum("out").alias("got"), F.max("low").alias("low"), F.max("nines").alias("nines"), F.max("zeros").alias("zeros"))
    most = F.lit(BASE**3).cast("long")
    if difference:
        out = lambda e: F.coalesce(F.col("zeros"), F.lit(True)) & (F.coalesce("low", F.lit(0)) + F.col("got") + e < 0)
        flag = F.when(out(0), -1).when(~out(-1), 0)
    else:
        out = lambda e: F.coalesce(F.col("nines"), F.lit(False)) & (F.coalesce("low", F.lit(0)) + F.col("got") + e >= most)
        flag = F.when(out(0), 1).when(~out(1), 0)
    scanned = incoming(every.withColumn("flag", flag), "flag", ["num"], tiers=tiers)
    comes = stored(scanned.select("num", F.col("idx").alias("chunk"), (F.col("got") + F.col("cin")).alias("comes"), F.col("low").isNull().alias("new")).where("comes <> 0"), "comes")
    own = comes.where("not new").drop("new")
    data = done.select("num", "chunk", "data").join(F.broadcast(own) if tiers == 1 else own, ["num", "chunk"], "left")
    fresh = comes.where("new").select("num", "chunk", F.lit(None).cast("binary").alias("data"), "comes")

    def rows_of(batches):
        for num, chunk, limbs, come in _rows(batches, ["num", "chunk", "data", "comes"]):
            s = np.zeros(CHUNK, dtype=np.int64) if limbs is None else np.frombuffer(limbs, dtype=np.uint32).astype(np.int64)
            if come:
                s[0] += come
                _settled(s)  # what goes out has been counted
            yield _packed_row(num, chunk, s)

    return stored(_mapped(data.unionByName(fresh), rows_of, PACKED), "packed")


def _carried_by_heads(done: DataFrame, difference: bool) -> DataFrame:
    """CARRYING of a bounded number of chunks to PACKED: the scan runs over their heads on the driver."""
    heads = {(r["num"], r["chunk"]): r for r in done.select("num", "chunk", "out", "low", "nines", "zeros").collect()}
    got = {(num, chunk + 1): r["out"] for (num, chunk), r in heads.items() if r["out"]}
    comes: dict[tuple[str, int], int] = {}
    passed: dict[tuple[str, int], int] = {}
    most = max((chunk for _, chunk in heads), default=0)
    todo = sorted(heads.keys() | got.keys(), reverse=True)
    while todo:
        key = num, chunk = todo.pop()
        come = got.get(key, 0) + passed.get(key, 0)
        if come:
            comes[key] = come
        r = heads.get(key)
        low, on = (r["low"], r["zeros"] if difference else r["nines"]) if r else (0, difference)
        sends = (-1 if low + come < 0 else 0) if difference else (1 if low + come >= BASE**3 else 0)
        if on and sends and not (difference and chunk >= most):
            passed[num, chunk + 1] = sends
            if (num, chunk + 1) not in heads and (num, chunk + 1) not in got:
                todo.append((num, chunk + 1))
    spark, schema = done.sparkSession, "num string, chunk long, data binary"
    data = done.select("num", "chunk", "data")
    fresh = [(*key, None) for key in comes if key not in heads]
    if fresh:
        data = data.unionByName(spark.createDataFrame(fresh, schema))

    def rows_of(batches):
        for num, chunk, limbs in _rows(batches, ["num", "chunk", "data"]):
            s = np.zeros(CHUNK, dtype=np.int64) if limbs is None else np.frombuffer(limbs, dtype=np.uint32).astype(np.int64)
            come = comes.get((num, chunk))
            if come:
                s[0] += come
                _settled(s)  # what goes out has been counted
            yield _packed_row(num, chunk, s)

    return stored(_mapped(data, rows_of, PACKED), "packed")


def sum_of(*numbers: DataFrame) -> DataFrame:
    out = as_pieces(numbers[0])
    for n in numbers[1:]:
        out = out.unionByName(as_pieces(n))
    return carried(out)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """a - b for a >= b."""
    return carried(as_pieces(a).unionByName(as_pieces(b, -1)), difference=True)


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """num, cmp: -1, 0 or 1; the highest chunk that differs decides."""
    both = a.select("num", "chunk", F.col("data").alias("x")).join(b.select("num", "chunk", F.col("data").alias("y")), ["num", "chunk"], "full")

    def rows_of(batches):
        zero = np.zeros(CHUNK, dtype=np.int64)
        for num, chunk, x, y in _rows(batches, ["num", "chunk", "x", "y"]):
            d = (zero if x is None else np.frombuffer(x, dtype=np.uint32).astype(np.int64)) - (zero if y is None else np.frombuffer(y, dtype=np.uint32).astype(np.int64))
            at = np.flatnonzero(d)
            yield num, chunk, int(np.sign(d[at[-1]])) if len(at) else 0

    signs = _mapped(both, rows_of, "num string, chunk long, sign int")
    return signs.groupBy("num").agg(F.coalesce(F.max_by("sign", F.when(F.col("sign") != 0, F.col("chunk"))), F.lit(0)).alias("cmp"))


# ---- products


class Shape:
    """How the points of a transform are laid out and dealt."""

    def __init__(self, points: int, terms: int, columns: int | None = None):
        self.n = max(64, length_for(points, (1, 3)))
        odd = 3 if self.n % 3 == 0 else 1
        log = (self.n // odd).bit_length() - 1
        self.columns = columns or 1 << max(3, log // 2)
        self.rows = self.n // self.columns
        bands = 1 << max(0, int(min(self.n / BAND_POINTS, (self.n / TILE_POINTS) ** 0.5)).bit_length() - 1)
        self.bands = max(1, self.columns // CHUNK, min(bands, self.columns // 4, self.rows // odd))  # a band is no wider than a chunk
        self.width, self.height = self.columns // self.bands, self.rows // self.bands
        if self.rows % self.bands:
            raise ValueError(f"{self.rows} rows do not part into {self.bands} bands")
        self.primes = transform_primes(3, log, thirds=odd)
        if not bounds_ok(terms, self.primes):
            raise ValueError("three primes do not determine sums of so many products")
        self.roots = [root_of_unity(self.n, p) for p in self.primes]


def _sliced(a: DataFrame, shape: Shape, side: int, piece: int, cycle: bool) -> DataFrame:
    """PACKED to the parts of its chunks in each band of columns, as TILE (other: the first row)."""
    per, c, k = piece // CHUNK, shape.columns, shape.width
    wrap = shape.n // CHUNK if cycle else 0

    def rows_of(batches):
        for num, chunk, data in _rows(batches, ["num", "chunk", "data"]):
            limbs = np.frombuffer(data, dtype=np.uint32)
            number, local = (0, chunk % wrap) if cycle else divmod(chunk, per)
            limbs = limbs[: max(0, shape.n - local * CHUNK)]
            at = local * CHUNK
            if c >= CHUNK:
                row, first = divmod(at, c)
                for i in range(0, len(limbs), min(k, CHUNK)):
                    yield num, side, number, (first + i) // k, row * c + first + i, limbs[i : i + k].tobytes()
            else:
                m = limbs.reshape(-1, c)
                for band in range(shape.bands):
                    yield num, side, number, band, at + band * k, np.ascontiguousarray(m[:, band * k : (band + 1) * k]).tobytes()

    return _mapped(a.select("num", "chunk", "data"), rows_of, TILE)


def _forward(shape: Shape):
    """A band of columns: transforms along the columns and twiddles, cut into bands of rows."""

    def rows_of(batches):
        for (num, side, piece, band), rows in _groups(batches, ["num", "side", "piece", "band"], ["other", "data"]):
            k, first = shape.width, band * shape.width
            x = np.zeros((shape.rows, k), dtype=np.uint64)
            flat = x.reshape(-1)
            for at, data in rows:
                v = np.frombuffer(data, dtype=np.uint32)
                row, column = divmod(at, shape.columns)
                start = row * k + column - first
                flat[start : start + len(v)] += v
            out = np.empty((len(shape.primes), shape.rows, k), dtype=np.uint32)
            for i, (p, w) in enumerate(zip(shape.primes, shape.roots, strict=True)):
                m = np.uint64(p)
                y = transform_columns(x % m, p, pow(w, shape.columns, p))
                out[i] = y * powers_of([pow(w, first + j, p) for j in range(k)], shape.rows, p) % m
            for j in range(shape.bands):
                part = out[:, j * shape.height : (j + 1) * shape.height]
                yield num, side, piece, j, band, np.ascontiguousarray(part.transpose(0, 2, 1)).tobytes()

    return rows_of


def _pointwise(shape: Shape, only: frozenset | None = None):
    """A band of rows of all pieces: transforms along the rows, products of pieces added up by their place, and back along
    the rows. ``only``: the (num, place) that are wanted."""
    count, c, h, k = len(shape.primes), shape.columns, shape.height, shape.width

    def rows_of(batches):
        for (num, band), rows in _groups(batches, ["num", "band"], ["side", "piece", "other", "data"]):
            m: dict[tuple[int, int], np.ndarray] = {}
            for side, piece, other, data in rows:
                x = m.setdefault((side, piece), np.zeros((count, c, h), dtype=np.uint32))
                x[:, other * k : (other + 1) * k] = np.frombuffer(data, dtype=np.uint32).reshape(count, k, h)
            sums: dict[int, np.ndarray] = {}
            for i, (p, w) in enumerate(zip(shape.primes, shape.roots, strict=True)):
                q, root = np.uint64(p), pow(w, shape.rows, p)
                done = {key: transform_columns(x[i].astype(np.uint64), p, root).astype(np.uint32) for key, x in m.items()}
                for s in {a + b for (sa, a) in done if sa == 0 for (sb, b) in done if sb == 1}:
                    if only is not None and (num, s) not in only:
                        continue
                    total = np.zeros((c, h), dtype=np.uint64)
                    for (side, a), x in done.items():
                        if side == 0 and (1, s - a) in done:
                            total = (total + x.astype(np.uint64) * done[1, s - a] % q) % q
                    back = transform_columns(total, p, pow(root, p - 2, p))
                    sums.setdefault(s, np.empty((count, c, h), dtype=np.uint32))[i] = back
            for s, x in sums.items():
                for j in range(shape.bands):
                    yield num, 0, s, j, band, np.ascontiguousarray(x[:, j * k : (j + 1) * k]).tobytes()

    return rows_of


def coefficients(residues: list[np.ndarray], primes: list[int]) -> list[np.ndarray]:
    """Limbs of the values with these residues: mixed-radix digits, and their weights by limbs."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        v, q = residues[i].astype(np.uint64), np.uint64(p)
        for j, d in enumerate(digits):
            v = (v + q - d % q) % q * np.uint64(pow(primes[j], -1, p)) % q
        digits.append(v)
    out = [np.zeros(residues[0].shape, dtype=np.int64) for _ in range(SPREAD)]
    weight = 1
    for d, p in zip(digits, primes, strict=True):
        w, k = weight, 0
        while w:  # digits are below 2^31 and limbs of a weight below 10^6, so three of their products fit
            out[k] += d.astype(np.int64) * (w % BASE)
            w, k = w // BASE, k + 1
        weight *= p
    for k in range(SPREAD - 1):
        c = out[k] // BASE
        out[k] -= c * BASE
        out[k + 1] += c
    return out


def _backward(shape: Shape, piece: int, cycle: bool, apart: bool = False):
    """A band of columns of a sum of products: twiddles and transforms back, then its coefficients as limbs, as PIECE.
    ``apart``: each place is a number of its own, <num>|<place>."""
    r, c, k = shape.rows, shape.columns, shape.width

    def rows_of(batches):
        for (num, s, band), rows in _groups(batches, ["num", "piece", "band"], ["other", "data"]):
            x = np.zeros((len(shape.primes), r, k), dtype=np.uint64)
            for other, data in rows:
                x[:, other * shape.height : (other + 1) * shape.height] = np.frombuffer(data, dtype=np.uint32).reshape(-1, k, shape.height).transpose(0, 2, 1)
            first, residues = band * k, []
            for i, (p, w) in enumerate(zip(shape.primes, shape.roots, strict=True)):
                m, back = np.uint64(p), pow(w, p - 2, p)
                y = x[i] * powers_of([pow(back, first + j, p) for j in range(k)], r, p) % m
                y = transform_columns(y, p, pow(back, c, p))
                residues.append(y * np.uint64(pow(shape.n, p - 2, p)) % m)
            out = np.zeros((r, k + SPREAD - 1), dtype=np.int64)
            for j, limbs in enumerate(coefficients(residues, shape.primes)):
                out[:, j : j + k] += limbs
            num, offset = (f"{num}|{s}", first) if apart else (num, s * piece + first)
            starts = offset + c * np.arange(r)
            # what runs over the end of a chunk belongs to the next one
            over = (starts + k) % CHUNK == 0
            tails = out[over, k:].copy()
            out[over, k:] = 0
            for at, tail in zip(starts[over] + k, tails, strict=True):
                if tail.any():
                    at = int(at) % shape.n if cycle else int(at)
                    yield num, at // CHUNK, at % CHUNK, CHUNK, SPREAD - 1, tail.tobytes()
            step = max(1, CHUNK // c)
            for i in range(0, r, step):
                part = out[i : i + step]
                if part.any() or starts[i] == 0:
                    # the zeros that stand past the end of a chunk are cut
                    at, width = int(starts[i]) % CHUNK, k if over[min(i + step, r) - 1] else k + SPREAD - 1
                    if width == k and step > 1 and len(part) > 1 and part[:-1, k:].any():
                        yield num, int(starts[i]) // CHUNK, at + k, c, SPREAD - 1, np.ascontiguousarray(part[:-1, k:]).tobytes()
                    yield num, int(starts[i]) // CHUNK, at, c, width, np.ascontiguousarray(part[:, :width]).tobytes()

    return rows_of


def sizes(*numbers: DataFrame) -> list[int]:
    """Limbs of the longest of each of some tables of numbers, in one job."""
    every = None
    for i, n in enumerate(numbers):
        n = n.select(F.lit(i).alias("i"), "top")
        every = n if every is None else every.unionByName(n)
    found = {r["i"]: r["top"] for r in every.groupBy("i").agg(F.max("top").alias("top")).collect()}
    return [max(0, found.get(i) or 0) + 1 for i in range(len(numbers))]


def _layout(a: DataFrame, b: DataFrame, most: int, cycle: int | None = None, columns: int | None = None) -> tuple[Shape, int]:
    """The shape of the transforms and the limbs of a piece."""
    if cycle is not None:
        if cycle % CHUNK or length_for(cycle, (1, 3)) != cycle:
            raise ValueError(f"{cycle} is no length of a transform")
        return Shape(cycle, cycle), cycle
    na, nb = sizes(a, b)
    if na + nb <= most:
        return Shape(na + nb, min(na, nb), columns), -(-max(na, nb, 1) // CHUNK) * CHUNK
    piece = max(CHUNK, most // 2 // CHUNK * CHUNK)
    return Shape(2 * piece, piece * (1 + max(na, nb) // piece)), piece


def product_pieces(a: DataFrame, b: DataFrame, max_points: int | None = None, cycle: int | None = None, columns: int | None = None) -> DataFrame:
    """The coefficients of a * b by number, as PIECE. ``a`` and ``b`` should be
    stored: their sizes are read first. ``cycle``: modulo base^cycle - 1, for a
    length that transforms have and that is a multiple of 4096. ``columns`` of the
    matrix are for tests."""
    shape, piece = _layout(a, b, max_points or MAX_POINTS, cycle, columns)
    wrap = cycle is not None
    slices = _sliced(a, shape, 0, piece, wrap).unionByName(_sliced(b, shape, 1, piece, wrap))
    bands = _mapped(_dealt(slices, "num", "side", "piece", "band"), _forward(shape), TILE)
    lines = _mapped(_dealt(bands, "num", "band"), _pointwise(shape), TILE)
    return _mapped(_dealt(lines, "num", "piece", "band"), _backward(shape, piece, wrap), PIECE)


def product(a: DataFrame, b: DataFrame, plus: DataFrame | None = None, high: int | None = None, max_points: int | None = None) -> DataFrame:
    """a * b (+ plus), or that modulo base^high, of PACKED numbers of the same names, as PACKED (stored)."""
    if high is not None:
        a, b = below(a, high), below(b, high)
    parts = product_pieces(a, b, max_points)
    if plus is not None:
        parts = parts.unionByName(as_pieces(plus))
    out = carried(parts)
    return out if high is None else below(out, high)


def wrapped_product(a: DataFrame, b: DataFrame, cycle: int) -> DataFrame:
    """a * b modulo base^cycle - 1 (PACKED, stored; a multiple of the modulus comes out as 0).

    The transform's own wrap does the work: it has half the points of a whole product.
    """
    return folded(carried(product_pieces(a, b, cycle=cycle)), cycle)


def folded(a: DataFrame, cycle: int, rounds: int = 8) -> DataFrame:
    """A PACKED number modulo base^cycle - 1, for a multiple of 4096."""
    per = cycle // CHUNK
    for _ in range(rounds):
        if (a.agg(F.max("top")).first()[0] or 0) < cycle:
            break
        a = carried(as_pieces(a.withColumn("chunk", F.col("chunk") % per)))
    else:
        raise ArithmeticError(f"a fold to {cycle} limbs does not end after {rounds} rounds")
    nines = np.full(CHUNK, BASE - 1, dtype=np.uint32).tobytes()
    full = a.groupBy("num").agg(F.sum((F.col("data") == F.lit(nines)).cast("int")).alias("n")).where(F.col("n") == per)
    zero = F.lit(bytes(4 * CHUNK))
    marked = a.join(full, "num", "left")
    is_zero = F.col("n").isNotNull()
    return marked.select("num", "chunk", F.when(is_zero, zero).otherwise(F.col("data")).alias("data"), F.when(is_zero, F.lit(-1)).otherwise(F.col("top")).cast("long").alias("top"))


# ---- residues


def residues(a: DataFrame, primes: list[int]) -> DataFrame:
    """num, r0, r1, ...: PACKED numbers modulo each prime (decimals). A chunk is an
    integer of its task; its residues have the weight of its place, so the sum needs no order."""
    names = [f"r{i}" for i in range(len(primes))]

    def rows_of(frames):
        for f in frames:
            out = []
            for num, chunk, data in zip(f["num"], f["chunk"], f["data"], strict=True):
                n = integer_of(np.frombuffer(data, dtype=np.uint32))
                out.append((num, *(str(n % q * pow(BASE, int(chunk) * CHUNK, q) % q) for q in primes)))
            yield pd.DataFrame(out, columns=["num", *names])

    each = a.select("num", "chunk", "data").mapInPandas(rows_of, "num string, " + ", ".join(f"{n} string" for n in names))
    wide = "decimal(38,0)"
    return each.groupBy("num").agg(*[(F.sum(F.col(n).cast("decimal(28,0)")).cast(wide) % F.lit(str(q)).cast(wide)).cast("decimal(19,0)").alias(n) for n, q in zip(names, primes, strict=True)])


def residues_of(numbers: dict[str, DataFrame], primes: list[int]) -> dict[str, list[int]]:
    """The residues of several single numbers, in one job."""
    every = None
    for name, n in numbers.items():
        n = n.select(F.lit(name).alias("num"), "chunk", "data")
        every = n if every is None else every.unionByName(n)
    return {r["num"]: [int(r[f"r{i}"]) for i in range(len(primes))] for r in residues(every, primes).collect()}


def integer_of(limbs: np.ndarray) -> int:
    """The integer of a few thousand limbs, by halves of ever longer words."""
    words, weight = [int(x) for x in limbs], BASE
    while len(words) > 1:
        if len(words) % 2:
            words.append(0)
        words = [low + high * weight for low, high in zip(words[::2], words[1::2], strict=True)]
        weight *= weight
    return words[0] if words else 0
