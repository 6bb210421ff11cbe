"""Packed digit files: a 4096-byte header and base-10^18 limbs, most significant first.

Version 1 holds 8 bytes a limb; version 2 holds 60 bits a limb, two limbs in 15
bytes and a last odd one in 8. A number is cut into parts; part 0 has the top
limbs. Each part is one row: writers and readers work on parts in parallel.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbers import DIGITS
from ..operators.residues import CHECK_PRIMES

#: Fixed by the format.
MAGIC, HEADER_BYTES, ENDIAN, TEXT_AT = b"ECPACK18", 4096, 0x01020304, 1024
LIMB_DIGITS, WIDE_BASE = 18, 10**18
FIELDS = "magic version hdr_bytes endian limb_bytes limb_digits order part nparts reserved0 d d_out nl pad lo hi k0 k1 complete nq".split()
LAYOUT = struct.Struct("<8s9I4x10Q8Q8Q")


def packed_bytes(n: int) -> int:
    """Bytes of n limbs in the 60-bit form."""
    return 15 * (n // 2) + 8 * (n % 2)


def pack60(limbs: np.ndarray) -> bytes:
    """The 60-bit form of limbs in file order."""
    pairs = limbs[: len(limbs) // 2 * 2].astype(np.uint64).reshape(-1, 2)
    words = np.empty((len(pairs), 2), dtype="<u8")
    words[:, 0] = pairs[:, 0] | (pairs[:, 1] << np.uint64(60))
    words[:, 1] = pairs[:, 1] >> np.uint64(4)
    out = words.view(np.uint8).reshape(-1, 16)[:, :15].tobytes()
    return out + (struct.pack("<Q", int(limbs[-1])) if len(limbs) % 2 else b"")


def unpack60(data: bytes, n: int) -> np.ndarray:
    """n limbs of the 60-bit form."""
    pairs = n // 2
    wide = np.zeros((pairs, 16), dtype=np.uint8)
    wide[:, :15] = np.frombuffer(data, dtype=np.uint8, count=15 * pairs).reshape(-1, 15)
    words = wide.reshape(-1).view("<u8").reshape(-1, 2)
    out = np.empty(n, dtype=np.uint64)
    out[0 : 2 * pairs : 2] = words[:, 0] & np.uint64(2**60 - 1)
    out[1 : 2 * pairs : 2] = (words[:, 0] >> np.uint64(60)) | (words[:, 1] << np.uint64(4))
    if n % 2:
        out[-1] = struct.unpack_from("<Q", data, 15 * pairs)[0]
    return out


class StreamPacker:
    """Packs limbs that come in chunks: an odd last limb waits for the next chunk."""

    def __init__(self, waiting: int | None = None):
        self.waiting = waiting

    def add(self, limbs: np.ndarray, final: bool) -> bytes:
        if self.waiting is not None:
            limbs = np.concatenate([[np.uint64(self.waiting)], limbs.astype(np.uint64)])
            self.waiting = None
        if len(limbs) % 2 and not final:
            self.waiting, limbs = int(limbs[-1]), limbs[:-1]
        return pack60(limbs)


def part_ranges(digits: int, nparts: int) -> list[dict]:
    """Limbs [lo, hi) and digits [k0, k1) of the parts of a number of ``digits`` digits in all; part 0 is the top."""
    nl = -(-digits // LIMB_DIGITS)
    pad = nl * LIMB_DIGITS - digits
    out = []
    for part in range(nparts):
        rank = nparts - 1 - part
        lo, hi = nl * rank // nparts, nl * (rank + 1) // nparts
        k0 = max(0, (nl - hi) * LIMB_DIGITS - pad)
        out.append({"part": part, "nparts": nparts, "nl": nl, "pad": pad, "lo": lo, "hi": hi, "k0": k0, "k1": (nl - lo) * LIMB_DIGITS - pad})
    return out


def digit_residues(text: str, primes=CHECK_PRIMES) -> list[int]:
    """A digit string modulo each prime, 18 digits a step from the left."""
    out = [0] * len(primes)
    head = len(text) % LIMB_DIGITS
    steps = ([text[:head]] if head else []) + [text[i : i + LIMB_DIGITS] for i in range(head, len(text), LIMB_DIGITS)]
    for s in steps:
        x, w = int(s), 10 ** len(s)
        out = [(a * w + x) % q for a, q in zip(out, primes, strict=True)]
    return out


def _text(limbs: np.ndarray) -> str:
    return "".join(f"{int(x):018d}" for x in limbs)


def header(info: dict, d: int, d_out: int, version: int, residues: list[int]) -> bytes:
    head = LAYOUT.pack(
        MAGIC, version, HEADER_BYTES, ENDIAN, 8, LIMB_DIGITS, 1, info["part"], info["nparts"], 60 if version == 2 else 0,
        d, d_out, info["nl"], info["pad"], info["lo"], info["hi"], info["k0"], info["k1"], 1, len(CHECK_PRIMES), *CHECK_PRIMES, *residues,
    )
    note = f"packed decimal digits: part {info['part']} of {info['nparts']}, digits [{info['k0']}, {info['k1']})\n".encode()
    return head.ljust(TEXT_AT, b"\0") + note.ljust(HEADER_BYTES - TEXT_AT, b"\0")


def parse_header(data: bytes) -> dict:
    values = LAYOUT.unpack_from(data)
    out = dict(zip(FIELDS, values[:20], strict=True))
    if out["magic"] != MAGIC or out["endian"] != ENDIAN or out["version"] not in (1, 2):
        raise ValueError("not a packed digit file")
    return out | {"q": list(values[20:28]), "dres": list(values[28:36])}


def wide_limbs(df: DataFrame) -> DataFrame:
    """num, idx, limb in base 10^18: three limbs of 10^6 each."""
    scaled = F.col("limb").cast("decimal(18,0)") * F.element_at(F.array(*[F.lit(10 ** (DIGITS * k)).cast("decimal(18,0)") for k in range(3)]), (F.col("idx") % 3 + 1).cast("int"))
    return df.groupBy("num", F.expr("idx div 3").alias("idx")).agg(F.sum(scaled).cast("decimal(18,0)").cast("long").alias("limb"))


def write_parts(df: DataFrame, digits: int, path: str, nparts: int, version: int = 2, d_out: int | None = None) -> DataFrame:
    """Writes a number of ``digits`` digits (with its first) as part files <path>.part<k>; returns the parts' rows.

    Limbs go to the task of their part; a part is written to a temporary name
    and renamed, so a task that runs again leaves whole files. The folder must
    be shared by the executors.
    """
    ranges = part_ranges(digits, nparts)
    wide = wide_limbs(df)
    case = F.lit(None).cast("int")
    for r in ranges:
        case = F.when(F.col("idx").between(r["lo"], r["hi"] - 1), r["part"]).otherwise(case)
    d = digits - 1

    def write(key, f: pd.DataFrame) -> pd.DataFrame:
        info = ranges[int(key[0])]
        limbs = np.zeros(info["hi"] - info["lo"], dtype=np.uint64)
        limbs[f["idx"].to_numpy() - info["lo"]] = f["limb"].to_numpy().astype(np.uint64)
        limbs = limbs[::-1]
        text = _text(limbs)[info["pad"] if info["hi"] == info["nl"] else 0 :]
        body = pack60(limbs) if version == 2 else limbs.astype("<u8").tobytes()
        name = f"{path}.part{info['part']:04d}" if nparts > 1 else path
        with open(f"{name}.tmp{os.getpid()}", "wb") as out:
            out.write(header(info, d, d if d_out is None else d_out, version, digit_residues(text)) + body)
        os.replace(out.name, name)
        return pd.DataFrame([{"part": info["part"], "path": name, "bytes": HEADER_BYTES + len(body)}])

    every = wide.withColumn("part", case).where("part is not null").select("part", "idx", "limb")
    schema = "part int, path string, bytes long"
    done = every.groupBy("part").applyInPandas(write, schema).collect()  # a row for each part
    return df.sparkSession.createDataFrame(sorted(done), schema)


PART = "path string, part int, nparts int, version int, d long, d_out long, nl long, pad long, lo long, hi long, k0 long, k1 long, complete long, ok boolean, text string"


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each part file (glob), in any order: header, digits [k0, k1) as text, and whether they agree with the header's residues."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for name, data in zip(f["path"], f["content"], strict=True):
                h = parse_header(data)
                n = h["hi"] - h["lo"]
                body = data[h["hdr_bytes"] :]
                limbs = unpack60(body, n) if h["version"] == 2 else np.frombuffer(body, dtype="<u8", count=n)
                text = _text(limbs)[h["pad"] if h["hi"] == h["nl"] else 0 :]
                rows.append({**{k: h[k] for k in "part nparts version d d_out nl pad lo hi k0 k1 complete".split()}, "path": name, "ok": digit_residues(text, h["q"]) == h["dres"], "text": text})
            yield pd.DataFrame(rows)[[c.split(" ")[0] for c in PART.split(", ")]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, PART)


def recheck(parts: DataFrame) -> DataFrame:
    """One row: whether all parts are there, adjoin, are complete and agree with their residues."""
    from .digits import contiguous

    sums = parts.agg(F.bool_and("ok").alias("residues"), F.bool_and(F.col("complete") == 1).alias("complete"))
    joined = contiguous(parts.select("part", "nparts", F.col("k0").alias("lo"), F.col("k1").alias("hi")))
    return sums.crossJoin(joined.select(F.col("ok").alias("contiguous"), "n")).withColumn("verdict", F.when(F.col("residues") & F.col("complete") & F.col("contiguous"), "OK").otherwise("FAIL"))


def patch_tail(path: str, change: int) -> int:
    """Adds a small correction to the number in one part file in place, and
    returns what carries into the part above (0, or a unit either way): only the
    limbs that change are rewritten, and the residues move by the same change."""
    with open(path, "r+b") as f:
        h = parse_header(f.read(HEADER_BYTES))
        body = f.read()
        n = h["hi"] - h["lo"]
        limbs = (unpack60(body, n) if h["version"] == 2 else np.frombuffer(body, dtype="<u8", count=n)).copy()
        at, carry = n - 1, change
        while carry and at >= 0:
            carry, low = divmod(int(limbs[at]) + carry, WIDE_BASE)
            limbs[at], at = low, at - 1
        if carry and h["hi"] == h["nl"]:
            raise ArithmeticError("the correction leaves the number")
        first = max(0, (at + 1) // 2 * 2)
        data = pack60(limbs[first:]) if h["version"] == 2 else limbs[first:].astype("<u8").tobytes()
        f.seek(HEADER_BYTES + (packed_bytes(first) if h["version"] == 2 else 8 * first))
        f.write(data)
        new = [(r + change - carry * pow(10, LIMB_DIGITS * n, q)) % q for r, q in zip(h["dres"], h["q"], strict=True)]
        f.seek(LAYOUT.size - 64)
        f.write(struct.pack("<8Q", *new))
    return carry


def patch_number(paths: list[str], change: int) -> int:
    """Adds a small correction to a number in its part files, given from the top
    part down; the carry goes on from part to part. Returns how many were rewritten."""
    for done, path in enumerate(reversed(paths), 1):
        change = patch_tail(path, change)
        if not change:
            return done
    raise ArithmeticError("the correction leaves the number")


def to_ascii(parts: DataFrame, d_out: int) -> DataFrame:
    """part, text: '2.' digits newline, cut at d_out decimals, a piece for each part."""
    keep = F.greatest(F.least(F.lit(d_out + 1), F.col("k1")) - F.col("k0"), F.lit(0)).cast("int")
    body = F.substring("text", F.lit(1), keep)
    point = F.when(F.col("k0") == 0, F.concat(F.substring("text", 1, 1), F.lit("."), F.substring(body, 2, 2**31 - 1))).otherwise(body)
    end = F.when((F.col("k0") <= d_out) & (F.col("k1") > d_out), "\n").otherwise("")
    return parts.select("part", F.concat(point, end).alias("text"))
