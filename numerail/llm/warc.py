"""WARC archives: records with segments and revisits, written as files of bounded size and read back.

Writing: of equal payloads the one with the largest id is a ``response``
record, the others are ``revisit`` records that refer to it. A response's
block is an HTTP message with a chunked body; blocks longer than SEGMENT bytes
are cut into a first record and ``continuation`` records, which are dealt over
the files one by one. A file holds about FILE_BYTES of records, by their mean size. Reading parses each file record by record by the
lengths of its headers, groups the segments of a record by its origin id in
the order of their numbers, verifies the total length and the digests, and
decodes the chunked framing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, n_shuffle, small_batches, stored

CRLF, END = b"\r\n", "\r\n\r\n"
VERSION = b"WARC/1.1"
#: Bytes of a block that one record holds; longer ones are segmented.
SEGMENT = 16 << 10
#: Bytes of a chunk of the HTTP body; bytes of blocks in a file, about.
CHUNK, FILE_BYTES = 4 << 10, 32 << 20
#: Copies of a row that one task makes revisits of.
RUN = 4096
#: The archives give all records one date, so that reruns write the same bytes.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows of one batch of records to Spark, in bytes.
BATCH_BYTES = 8 << 20
SPACE_NAME = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

RECORD = "record_id string, type string, page_id long, url string, refers_to_id string, header_digest string, payload_digest string, origin_id string, segment int, total_length long, data binary, problem string"
PAGE = "record_id string, type string, page_id long, url string, refers_to_id string, header_digest string, payload_digest string, payload binary, problem string"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_NAME, f'{page_id} {copy} {digest} {url}')}>"


def header_safe(value: str) -> str:
    """Control characters and spaces, which would end a header's value, as %XX."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: "%%%02X" % ord(m[0]), value)


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = [VERSION, *(f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in fields if v is not None), b"Content-Length: %d" % len(block)]
    return CRLF.join(lines) + CRLF + CRLF + block


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The body of a message with chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join([x for p in parts for x in (b"%x" % len(p), CRLF, p, CRLF)] + [b"0", CRLF, CRLF])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        size = body[at : end if end >= 0 else len(body)].split(b";")[0].strip()
        if end < 0 or not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("chunk size")
        n, at = int(size, 16), end + 2
        if not n:
            break
        if body[at + n : at + n + 2] != CRLF:
            raise ValueError("chunk end")
        out.append(body[at : at + n])
        at += n + 2
    while (end := body.find(CRLF, at)) != at:  # trailer fields, up to an empty line
        if end < 0:
            raise ValueError("trailer")
        at = end + 2
    return b"".join(out)


def headers_of(raw: bytes) -> dict[str, str]:
    """Named fields (names in lower case) after the first line; folded lines are joined."""
    out: dict[str, str] = {}
    last = None
    for line in raw.split(CRLF)[1:]:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if colon:
            last = name.strip().decode("utf-8", "replace").lower()
            out[last] = value.strip().decode("utf-8", "replace")
    return out


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response message."""
    head, end, body = block.partition(CRLF + CRLF)
    if not end:
        raise ValueError("HTTP header")
    fields = headers_of(head)
    if fields.get("transfer-encoding", "").lower() == "chunked":
        return unchunked(body)
    n = fields.get("content-length")
    return body if n is None or not n.isdigit() else body[: int(n)]


def records_in(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(fields, block, problem) of each record of a file; whole files and records may be gzipped.

    After a record without a sound header or length the next version line at
    the start of a line is looked for.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(VERSION[:5], at)) >= 0:
        if at and data[at - 1 : at] != b"\n":
            at += 1
            continue
        end = data.find(CRLF + CRLF, at)
        fields = headers_of(data[at:end]) if end >= 0 else {}
        length = fields.get("content-length", "")
        if not length.isdigit():
            yield fields, b"", "no length"
            at += 1
            continue
        start = end + 4
        stop = start + int(length)
        cut = stop > len(data)
        yield fields, data[start:stop], "cut short" if cut else None
        # a wrong length does not take later records along
        at = stop if stop == len(data) or (not cut and data[stop : stop + 4] == CRLF + CRLF) else start


def _number(value: str | None) -> int | None:
    return int(value) if value is not None and re.fullmatch(r"-?\d{1,18}", value) else None


def payload_or_problem(block: bytes, digest: str | None) -> tuple[str | None, bytes | None, str | None]:
    """The digest that a block's payload has, the payload, and what is wrong with it."""
    try:
        payload = http_payload(block)
    except ValueError as e:
        return None, None, str(e)
    found = base32_digest(payload)
    if digest not in (None, found):
        return found, None, "payload digest"
    return found, payload, None


def _batches(rows: Iterator[tuple], schema: str, size_of) -> Iterator[pa.RecordBatch]:
    """Record batches of a bounded number of bytes."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*((f.split(" ")[0], kinds[f.split(" ")[1]]) for f in schema.split(", ")), strict=True)
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], list(names))

    for row in rows:
        held.append(row)
        size += size_of(row) + 200
        if size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)


def _segments(page_id, url, digest, copy, html, segment: int) -> Iterator[tuple[int, bytes]]:
    """(number, record) of a response; number 0 for a record that is whole."""
    payload = html.encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    name = record_name(page_id, url, digest, copy)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", None if url is None else header_safe(url)), ("WARC-X-Page-ID", page_id)]
    head = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment:
        yield 0, record(head, block)
        return
    cuts = range(0, len(block), segment)
    for k, at in enumerate(cuts, 1):
        part = block[at : at + segment]
        own = [("WARC-Block-Digest", f"sha1:{base32_digest(part)}"), ("WARC-Segment-Number", k)]
        if k > 1:
            own += [("WARC-Segment-Origin-ID", name), ("WARC-Segment-Total-Length", len(block) if k == len(cuts) else None)]
            yield k, record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_name(page_id, url, f"{digest}/{k}", copy)), *common, *own], part)
        else:
            yield k, record([*head, *own], part)


def _revisit(page_id, url, digest, copy, top_id, top_url) -> bytes:
    fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_name(page_id, url, digest, copy)), ("WARC-Date", DATE), ("WARC-Target-URI", None if url is None else header_safe(url)), ("WARC-X-Page-ID", page_id)]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_name(top_id, top_url, digest, 0)), ("Content-Type", "application/http; msgtype=response")]
    return record(fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")


def _base32_of_hex(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def write_archives(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT, file_bytes: int = FILE_BYTES, compression: str = "gzip") -> None:
    """Writes pages (page_id, url, html) as WARC files into a folder of any file system that Spark writes to.

    Of rows with equal payloads of at least ``least`` bytes the one with the
    largest page_id (then url) is the response and the others are revisits, of
    rows that are alike all but one. Null html is an empty payload; null ids
    and urls leave their header out, and a null id is smaller than others;
    repeated rows have a record each; extra columns are ignored; html may be
    of any length; an empty table gives no file. The files are written by
    Spark's committer, so a lost task leaves none behind.

    Equal payloads are combined before the shuffle, so a payload with very many
    copies is sent once by each task; copies are counted, not gathered.
    """
    spark = pages.sparkSession
    small_batches(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).cast("long").alias("n"))
    # payloads that are too short for revisits are classes of their own
    alone = F.col("n") < least
    keys = stored(base.groupBy("sha1", "n", "page_id", "url").agg(F.count(F.lit(1)).alias("copies")), "warc-keys")
    classes = [F.when(alone, F.col("page_id")).alias("own_id"), F.when(alone, F.col("url")).alias("own_url")]
    tops = base.groupBy("sha1", "n", *classes).agg(F.max(F.struct("page_id", "url")).alias("top"), F.count(F.lit(1)).alias("copies"), F.first("html").alias("html"))
    responses = tops.select("top.page_id", "top.url", "sha1", "html", F.when(alone, F.col("copies")).otherwise(1).alias("copies"))

    def blocks(batches):
        def rows():
            for page_id, url, sha1, text, copies in _rows(batches, ["page_id", "url", "sha1", "html", "copies"]):
                digest = _base32_of_hex(sha1)
                for copy in range(copies):
                    for k, raw in _segments(page_id, url, digest, copy, text, segment):
                        yield f"{digest}/{page_id}/{url}/{copy}/{k}", raw

        return _batches(rows(), "key string, data binary", lambda r: len(r[1]))

    several = keys.where(f"n >= {int(least)}")
    top_keys = stored(several.groupBy("sha1", "n").agg(F.max(F.struct("page_id", "url")).alias("top"), F.sum("copies").alias("rows")).where("rows > 1").drop("rows"), "warc-tops")
    joined = several.join(top_keys, ["sha1", "n"])
    is_top = F.struct("page_id", "url").eqNullSafe(F.col("top"))
    # copies run from 0, or from 1 where the row itself is the response; those of rows that are alike are dealt in runs
    run = F.col("run") * RUN
    again = joined.select("page_id", "url", "sha1", "top", is_top.alias("is_top"), "copies", F.explode(F.expr(f"sequence(0L, (copies - 1) div {RUN})")).alias("run")).repartition(n_shuffle(spark), "sha1", "page_id", "url", "run")
    again = again.select("page_id", "url", "sha1", F.col("top.page_id").alias("top_id"), F.col("top.url").alias("top_url"), "is_top", F.explode(F.sequence(run, F.least(run + RUN, F.col("copies")) - 1)).alias("copy"))
    again = again.where("copy > 0 or not is_top")

    def revisits(batches):
        def rows():
            for page_id, url, sha1, copy, top_id, top_url in _rows(batches, ["page_id", "url", "sha1", "copy", "top_id", "top_url"]):
                digest = _base32_of_hex(sha1)
                yield f"{digest}/{page_id}/{url}/{copy}", _revisit(page_id, url, digest, copy, top_id, top_url)

        return _batches(rows(), "key string, data binary", lambda r: len(r[1]))

    # records stay where their payload was brought together; the segments of long ones are dealt anew, each on its own
    is_long = F.octet_length("html") + 400 > segment
    long = responses.where(is_long).mapInArrow(blocks, "key string, data binary").repartition(n_shuffle(spark), "key")
    out = responses.where(~is_long).mapInArrow(blocks, "key string, data binary").unionByName(long).unionByName(again.mapInArrow(revisits, "key string, data binary"))
    total, rows = keys.agg(F.sum((F.col("n") + 600) * F.col("copies")), F.sum("copies")).first()
    most = max(1, file_bytes * (rows or 1) // (total or 1))
    # the text writer puts bytes as they are; the two line ends that close a record are its separator
    out.select(F.col("data").cast("string").alias("value")).write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", most).text(path)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for i in range(batch.num_rows):
                for f, block, problem in records_in(batch.column("content")[i].as_buffer().to_pybytes()):
                    kind, number = f.get("warc-type"), _number(f.get("warc-segment-number"))
                    digest = f.get("warc-payload-digest")
                    digest = digest[5:] if digest and digest.lower().startswith("sha1:") else None
                    own = f.get("warc-block-digest", "")
                    if problem is None and own.lower().startswith("sha1:") and own[5:] != base32_digest(block):
                        problem = "block digest"
                    name, found = f.get("warc-record-id"), None
                    origin = f.get("warc-segment-origin-id") if kind == "continuation" else name
                    if kind != "response" or number is not None or problem:
                        data = block
                    else:
                        found, data, problem = payload_or_problem(block, digest)
                    yield name, kind, _number(f.get("warc-x-page-id")), f.get("warc-target-uri"), f.get("warc-refers-to"), digest, found, origin, number, _number(f.get("warc-segment-total-length")), data, problem

    return _batches(rows(), RECORD, lambda r: len(r[10] or b""))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files below a path, as RECORD; the data of a whole
    response is its payload, that of others their block. Files are read whole,
    so they should be of bounded size, as write_archives() makes them."""
    small_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_parsed, RECORD)


def _reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in the order of (origin, number) to pages: one record's blocks at a time are held."""
    columns = ["origin_id", "segment", "type", "page_id", "url", "header_digest", "total_length", "data", "problem"]

    def finished(origin, first, parts, total, problem):
        kind, page_id, url, digest = first
        if problem is None and total is None:
            problem = "no last segment"
        block = b"".join(parts)
        if problem is None and len(block) != total:
            problem = "total length"
        found = payload = None
        if problem is None:
            found, payload, problem = payload_or_problem(block, digest)
        return origin, kind, page_id, url, None, digest, found, payload, problem

    def rows():
        now, first, parts, total, problem, last = None, None, [], None, None, 0
        for origin, number, kind, page_id, url, digest, length, data, wrong in _rows(batches, columns):
            if origin != now or first is None:
                if first is not None:
                    yield finished(now, first, parts, total, problem)
                now, parts, total, problem, last = origin, [], None, None, 0
                first = (kind, page_id, url, digest) if number == 1 else ("response", page_id, url, None)
            if number == last:
                continue  # a segment that was written again
            if number != last + 1:
                problem = problem or "missing segment"
            problem, last = problem or wrong, number
            total = length if length is not None else total
            parts.append(data)
        if first is not None:
            yield finished(now, first, parts, total, problem)

    return _batches(rows(), PAGE, lambda r: len(r[7] or b""))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits of the WARC files below a path, as PAGE plus
    payload_bytes and refers_to, the page id of the record that a revisit refers to.

    Segments of a record may lie in any files and order; doubled ones count
    once. A response's payload is decoded and compared with its digest;
    ``problem`` says what is wrong with a record, and then it has no payload. A
    revisit has the length of the payload of the record that it refers to, and
    the problem ``no original`` if there is none. No files give no rows.
    """
    records = stored(read_records(spark, path), "warc-records")
    wanted = records.where("type in ('response', 'continuation')")
    whole = records.where("type = 'response' and segment is null").select("record_id", "type", "page_id", "url", "refers_to_id", "header_digest", "payload_digest", F.when(F.col("problem").isNull(), F.col("data")).alias("payload"), "problem")
    parts = wanted.where("segment is not null and origin_id is not null").repartition(n_shuffle(spark), "origin_id").sortWithinPartitions("origin_id", "segment")
    joined = parts.select("origin_id", "segment", "type", "page_id", "url", "header_digest", "total_length", "data", "problem").mapInArrow(_reassembled, PAGE)
    responses = whole.unionByName(joined).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("refers_to", F.lit(None).cast("long"))
    revisits = records.where("type = 'revisit'").select("record_id", "type", "page_id", "url", "refers_to_id", "header_digest", "problem")
    # payloads are not stored a second time: whole ones stay where they are, and those in segments are put together for each use
    known = stored(responses.where("problem is null").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest", F.lit(True).alias("found")), "warc-known")
    revisits = revisits.join(known, "refers_to_id", "left")
    lost = F.when(F.col("found").isNull(), "no original").when(F.col("payload_digest") != F.col("header_digest"), "payload digest")
    revisits = revisits.select("record_id", "type", "page_id", "url", "refers_to_id", "header_digest", F.col("header_digest").alias("payload_digest"), F.lit(None).cast("binary").alias("payload"), F.coalesce("problem", lost).alias("problem"), "payload_bytes", "refers_to")
    return responses.unionByName(revisits)


def op13_warc(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "problem")



#: The base-32 text of a SHA-1 is made of its eight groups of 20 bits.
OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to, NULL::VARCHAR AS problem
FROM d
"""
