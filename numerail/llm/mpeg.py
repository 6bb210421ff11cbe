"""MPEG-1 Layer III streams as media columns: writing, resynchronising, checking.

A payload is held in the frames of a silent mono stream (48 kbit/s, 32 kHz, so
216 bytes a frame): no main data is coded, and what follows the side
information is ancillary data, 192 bytes of it payload. So each frame stands
alone and the stored bytes come back exactly.

The stored table has, beside the stream, its exact duration in samples, the
byte offsets of all frames for seeking, and the fields of its tags.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

UNIT = 192
SAMPLE_RATE, SAMPLES, FRAME = 32_000, 1152, 216
SIDE = 17  # bytes of side information in mono
BODY = 4 + 2 + SIDE  # header, checksum, side information
#: Fixed by the format (ISO/IEC 11172-3): kbit/s of Layer III by index, Hz by index.
BIT_RATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES = (44_100, 48_000, 32_000)
#: Sync, MPEG-1, Layer III, with checksum; 48 kbit/s, 32 kHz, no padding; mono, original.
HEADER = bytes((0xFF, 0xFA, 3 << 4 | 2 << 2, 3 << 6 | 1 << 2))
TOC = 100


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        out = ((out << 1) ^ np.where(out & 0x8000, 0x8005, 0)) & 0xFFFF
    return out.astype(np.uint16)


CRC = _crc_table()


def checksums(parts: np.ndarray) -> np.ndarray:
    """CRC-16 of each row of bytes, as the frames hold it."""
    crc = np.full(len(parts), 0xFFFF, dtype=np.uint16)
    for column in parts.T:
        crc = (crc << np.uint16(8)) ^ CRC[(crc >> np.uint16(8)) ^ column]
    return crc


def padded(data: bytes) -> bytes:
    """The data with spaces up to a positive multiple of 192 bytes."""
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def _frames(body: np.ndarray) -> np.ndarray:
    out = np.zeros((len(body), FRAME), dtype=np.uint8)
    out[:, :4] = np.frombuffer(HEADER, dtype=np.uint8)
    crc = checksums(np.concatenate([out[:, 2:4], out[:, 6:BODY]], axis=1))
    out[:, 4], out[:, 5] = crc >> 8, crc & 0xFF
    out[:, BODY : BODY + body.shape[1]] = body
    return out


def _tag(frames: int) -> bytes:
    value = b"\x00" + str(frames * SAMPLES * 1000 // SAMPLE_RATE).encode()
    frame = b"TLEN" + struct.pack(">IH", len(value), 0) + value
    n = len(frame)
    return b"ID3\x03\x00\x00" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + frame


def encode(payload: bytes) -> bytes:
    """An ID3v2.3 tag, a frame with the variable-bitrate table, and the payload's frames."""
    frames = _frames(np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT))
    n = len(frames)
    table = bytes(min(255, 256 * (FRAME + FRAME * (n * i // TOC)) // (FRAME * (n + 1))) for i in range(TOC))
    info = b"Xing" + struct.pack(">III", 7, n, FRAME * (n + 1)) + table
    first = _frames(np.frombuffer(info, dtype=np.uint8).reshape(1, -1))
    return _tag(n) + first.tobytes() + frames.tobytes()


def _header(data: bytes, at: int) -> tuple[int, int, bool, int] | None:
    """Frame bytes, sample rate, checksum there, side bytes of the header at a place."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xFA:
        return None
    rate, hz, pad = data[at + 2] >> 4, data[at + 2] >> 2 & 3, data[at + 2] >> 1 & 1
    if rate in (0, 15) or hz == 3:
        return None
    return 144_000 * BIT_RATES[rate] // RATES[hz] + pad, RATES[hz], not data[at + 1] & 1, 17 if data[at + 3] >> 6 == 3 else 32


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(b: bytes) -> str:
    """A text of an ID3v2 frame: a byte tells its encoding, zeros part values."""
    kind, body = b[:1], b[1:]
    name = {b"\x00": "latin-1", b"\x01": "utf-16", b"\x02": "utf-16-be", b"\x03": "utf-8"}.get(kind)
    return "" if name is None else body.decode(name, "replace").rstrip("\0").replace("\0", "/")


def id3v2(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """The end of an ID3v2 tag (2.2 to 2.4) and its text fields; other frames give their size.

    An extended header, unsynchronised bytes and a footer are minded; what does
    not fit the tag ends it.
    """
    major, flags, size = data[at + 3], data[at + 5], _syncsafe(data[at + 6 : at + 10])
    end = at + 10 + size
    body = data[at + 10 : end]
    if major >= 4 and flags & 0x10:
        end += 10
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    pos = 0
    if flags & 0x40 and major >= 3 and len(body) >= 4:
        pos = _syncsafe(body[:4]) if major >= 4 else 4 + int.from_bytes(body[:4], "big")
    name_n, head = (3, 6) if major == 2 else (4, 10)
    fields: dict[str, str] = {}
    while pos + head <= len(body) and body[pos : pos + 1] != b"\0":
        name = body[pos : pos + name_n].decode("latin-1")
        raw = body[pos + name_n : pos + 2 * name_n]
        n = _syncsafe(raw) if major >= 4 else int.from_bytes(raw, "big")
        value = body[pos + head : pos + head + n]
        if not name.isalnum() or len(value) < n:
            break
        if major >= 4 and flags & 0x80:
            value = value.replace(b"\xff\x00", b"\xff")
        fields.setdefault(name, _text(value) if name[0] == "T" else f"{n} bytes")
        pos += head + n
    return end, fields


def id3v1(b: bytes) -> dict[str, str]:
    """The fields of an ID3v1 tag of 128 bytes."""
    cuts = {"title": (3, 33), "artist": (33, 63), "album": (63, 93), "year": (93, 97), "comment": (97, 127)}
    fields = {k: b[x:y].split(b"\0")[0].decode("latin-1").rstrip() for k, (x, y) in cuts.items()}
    return {k: v for k, v in fields.items() if v} | {"genre": str(b[127])}


def vbr_table(frame: bytes, body: int) -> dict | None:
    """The variable-bitrate table in a first frame: a Xing or Info header, of
    which the flags tell what follows, or a VBRI header; null if there is none."""
    mark = frame[body : body + 4]
    if mark in (b"Xing", b"Info") and len(frame) >= body + 8:
        flags, at = int.from_bytes(frame[body + 4 : body + 8], "big"), body + 8
        out: dict = {"kind": mark.decode(), "flags": flags, "frames": None, "bytes": None, "toc": None, "quality": None}
        for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", TOC), (8, "quality", 4)):
            if flags & bit:
                value = frame[at : at + n]
                if len(value) == n:
                    out[name] = value if name == "toc" else int.from_bytes(value, "big")
                at += n
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, per = struct.unpack(">IIHHHH", frame[46:62])
        toc = frame[62 : 62 + entries * width]
        return {"kind": "VBRI", "flags": 0, "frames": frames, "bytes": size, "toc": toc, "quality": int.from_bytes(frame[44:46], "big"), "scale": scale, "frames_per_entry": per}
    return None


def probe(data: bytes) -> dict:
    """Parses a stream: tags, table, frames with offsets, checksums, duration, payload.

    Bytes between frames are skipped to the next header which the header of
    the following frame (or the end) confirms. Frames of any Layer III bit rate
    are parsed one by one; a run of equal headers is parsed at once.
    """
    at, end, tags = 0, len(data), 0
    fields: dict[str, str] = {}
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        at, found = id3v2(data, at)
        fields, tags = found | fields, tags + 1
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end, tags = end - 128, tags + 1
        fields = id3v1(data[end : end + 128]) | fields
    whole = np.frombuffer(data, dtype=np.uint8)
    offsets: list[np.ndarray] = []
    bodies: list[bytes] = []
    bad = skipped = samples = 0
    vbr: dict | None = None
    hz = 0
    while at + 4 <= end:
        h = _header(data, at)
        if h is None or at + h[0] > end or not (at + h[0] == end or at + h[0] + 4 > end or _header(data, at + h[0]) or data[at + h[0] : at + h[0] + 3] == b"TAG"):
            after = data.find(b"\xff", at + 1, end)
            after = end if after < 0 else after
            skipped, at = skipped + after - at, after
            continue
        length, hz, checked, side = h
        limit = (end - at) // length
        run = whole[at : at + limit * length].reshape(limit, length)
        same = (run[:, :4] == run[0, :4]).all(axis=1)
        n = limit if same.all() else int(same.argmin())
        run = run[:n]
        body = 4 + 2 * checked + side
        if checked:
            stated = run[:, 4].astype(np.uint16) << 8 | run[:, 5]
            bad += int((checksums(np.concatenate([run[:, 2:4], run[:, 6:body]], axis=1)) != stated).sum())
        starts = at + length * np.arange(n, dtype=np.int64)
        if vbr is None and not offsets:
            vbr = vbr_table(run[0].tobytes(), body)
            if vbr:
                run, starts = run[1:], starts[1:]
        if len(run):
            offsets.append(starts)
            bodies.append(run[:, body : body + UNIT].tobytes())
            samples += SAMPLES * len(run)
        at += n * length
    skipped += max(0, end - at)
    place = np.concatenate(offsets) if offsets else np.zeros(0, dtype=np.int64)
    return {"tags": tags, "fields": fields, "vbr": vbr, "offsets": place, "bad_checksums": bad, "skipped": skipped, "samples": samples, "sample_rate": hz, "payload": b"".join(bodies)}


def seek(parsed: dict, second: float) -> int:
    """The exact byte offset of the frame that holds a time."""
    n = len(parsed["offsets"])
    return int(parsed["offsets"][min(n - 1, max(0, int(second * parsed["sample_rate"] // SAMPLES)))])


#: The stored table: beside the stream, its duration and the places of its frames, and its tags' fields.
MEDIA = "doc_id long, n_bytes long, media binary, samples long, sample_rate int, offsets array<long>, fields map<string,string>"
FACTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, sample_rate int, bad_checksums long, as_stored boolean"
TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "map<string,string>": pa.map_(pa.string(), pa.string())}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(f.split(" ") for f in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], TYPES[k]) for c, k in enumerate(kinds)], list(names))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, rows = batch.slice(at, 256), []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                data = b"" if text is None else text.encode()
                media = encode(padded(data))
                p = probe(media)
                rows.append((doc_id, len(data), media, p["samples"], p["sample_rate"], p["offsets"], list(p["fields"].items())))
            yield _batch(MEDIA, rows)


def feature(p: dict) -> str:
    """What a stream's parse tells, as one text."""
    place = p["offsets"]
    toc = hashlib.md5(p["vbr"]["toc"]).hexdigest()[:8] if p["vbr"] and p["vbr"]["toc"] else "none"
    return f"duration={p['samples']}/{p['sample_rate']};frames={len(place)};first={place[0] if len(place) else -1};last={place[-1] if len(place) else -1};tags={p['tags']};length={p['fields'].get('TLEN', '')};toc={toc};bad={p['bad_checksums']};skipped={p['skipped']}"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, rows = batch.slice(at, 256), []
            offsets = part.column("offsets")
            for i, (doc_id, n_bytes, media, samples) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "samples")), strict=True)):
                p = probe(media)
                data = p["payload"]
                as_stored = samples == p["samples"] and np.array_equal(offsets[i].values.to_numpy(), p["offsets"])
                rows.append((doc_id, n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(p), p["samples"], p["sample_rate"], p["bad_checksums"], as_stored))
            yield _batch(FACTS, rows)


def write_media(docs: DataFrame) -> DataFrame:
    """Rows of MEDIA: each text (null: empty) as an MPEG stream, with the exact
    duration in samples, the byte offset of every frame and the tags' fields.

    Empty texts give one frame of spaces; texts may be of any length; equal
    texts give equal streams; null ids and repeated rows are kept; extra
    columns are ignored whatever their names; an empty table gives none. The
    table is stored.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(ids.mapInArrow(_write, MEDIA), "media")


def read_media(media: DataFrame) -> DataFrame:
    """Rows of FACTS: parses the stored streams, whose bytes alone give digests
    and features; ``as_stored`` tells whether duration and offsets are the stored ones."""
    return media.select("doc_id", "n_bytes", "media", "samples", "offsets").mapInArrow(_read, FACTS)


def op5_mpeg_media(spark, sf_dir: str) -> DataFrame:
    return read_media(write_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
