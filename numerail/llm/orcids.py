"""Token ids in ORC files: run-length coded stripes, row indexes, Bloom filters.

Documents are written in ascending doc_id order, a range of ids to a file.
Each row is a document: its file's number, its place in the file, doc_id, ids.
ORC codes the ids of a stripe as runs of integers (RLE version 2), keeps
minimum and maximum of doc_id per stripe and per row group, and a Bloom filter
of doc_id per row group. A reader opens stripes in parallel, and a look-up by
doc_id reads only the stripes and row groups whose statistics and filters
admit it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, hold, n_shuffle, small_batches, stored, trim
from .pieces import MARKS, START, Cutter, PartTable, gathered, groups_of, literal, special_tokens

END_ID = 0
STRIPE_BYTES = 16 << 20
#: Settings of the files: an index entry and a Bloom filter for every 1000 documents.
ORC_OPTIONS = {
    "compression": "lz4",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(STRIPE_BYTES),
    "orc.encoding.strategy": "SPEED",
}
FILE_SCHEMA = "part int, place long, doc_id long, ids array<int>"
#: Parts that a worker keeps, and parts in one text for the library.
CACHE_LIMIT, AT_ONCE = 600_000, 2000
#: Documents of a block of running sums.
BLOCK = 65_536
#: Bytes of texts that are encoded at once, and rows that Spark's reader decodes at once: a row has a list of ids.
GROUP_BYTES, READ_ROWS = 4 << 20, 256


class ChunkEncoder:
    """Ids of texts by the tokenizers library, each distinct part encoded once while it is kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # of byte-level tokens each letter is a byte; special tokens are plain text
        self.lengths = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.lengths[i] = len(token)
        marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids[0] for m in MARKS}
        self.table = PartTable(Cutter(special_tokens(path)), CACHE_LIMIT, self._encode_new, marks)

    def _encode_new(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Encodes many parts in one text: those that encode alike after any
        other are told apart by the ids' byte lengths; others are texts of their own."""
        encode = self.tokenizer.encode_batch_fast
        starts = pc.starts_with(new, START)
        order = pc.array_sort_indices(starts.cast(pa.int8())).to_numpy()  # joined ones first
        new, n = new.take(pa.array(order)), len(new) - pc.sum(starts).as_py()
        # the text of a joined part is a space and the part, but a newline needs no space
        size = (pc.binary_length(new).to_numpy() + ~pc.starts_with(new, "\n").to_numpy(zero_copy_only=False)).astype(np.int64)
        at = np.append(np.arange(0, n, AT_ONCE), n)
        groups = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), new.slice(0, n))
        blocks = [(" " + b).replace(" \n", "\n") for b in pc.binary_join(groups, " ").to_pylist()]
        lengths, ids, alone = [], [], []
        for a, b, e in zip(at[:-1].tolist(), at[1:].tolist(), encode(blocks, add_special_tokens=False), strict=True):
            found = np.array(e.ids, dtype=np.int32)
            ends, upto = np.cumsum(size[a:b]), np.cumsum(self.lengths[found])
            cuts = np.searchsorted(upto, ends) + 1
            if cuts[-1] != len(found) or (upto[cuts - 1] != ends).any():
                alone.append(len(lengths))
                lengths.append(None)
                ids.append(new.slice(a, b - a))
                continue
            lengths.append(np.diff(cuts, prepend=0))
            ids.append(found)
        alone.append(len(lengths))
        lengths.append(None)
        ids.append(new.slice(n))
        for i in alone:
            found = [np.array(e.ids, dtype=np.int32) for e in encode([literal(k) for k in ids[i].to_pylist()], add_special_tokens=False)]
            lengths[i] = np.array([len(f) for f in found], dtype=np.int64)
            ids[i] = np.concatenate([*found, np.zeros(0, dtype=np.int32)])
        lengths, ids = np.concatenate(lengths), np.concatenate(ids)
        return gathered(lengths, ids, np.argsort(order))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.table.encode(texts)


_LOADED: dict[str, ChunkEncoder] = {}


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        hold("orc", _LOADED.clear)
        if path not in _LOADED:  # kept for the worker's later tasks
            _LOADED[path] = ChunkEncoder(path)
        encoder, place = _LOADED[path], 0
        for batch in batches:
            texts = batch.column("text").fill_null("")
            for at, to in groups_of(texts, GROUP_BYTES):
                part = batch.slice(at, to - at)
                offsets, ids = encoder.encode(texts.slice(at, to - at))
                ids = np.insert(ids, offsets[1:], END_ID)
                offsets = offsets + np.arange(len(offsets))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                places = pa.array(np.arange(place, place + to - at))
                place += to - at
                yield pa.RecordBatch.from_arrays([part.column("part"), places, part.column("doc_id"), lists], ["part", "place", "doc_id", "ids"])
        trim()

    return run


INDEX = "part int, place long, doc_id long, n_tokens long, ids_crc32 long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        at = ids.offsets.to_numpy()
        data = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "place", "doc_id")), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], [f.split(" ")[0] for f in INDEX.split(", ")])


def write_ids(docs: DataFrame, tokenizer_path: str, path: str) -> str:
    """Writes the ids of every text (null: empty), each with the end id, and returns the path.

    Rows with a null doc_id come first; rows with one id come in the order in
    which they are read, in one file or in files that follow one another, so an
    id that has very many rows is no burden. Repeated rows are kept; extra
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("at"))
    # the sort runs within ranges, which follow one another by their number
    ranges = flat.repartitionByRange(n_shuffle(spark), "doc_id", "at").sortWithinPartitions("doc_id", "at")
    ids = ranges.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(_encode(tokenizer_path), FILE_SCHEMA)
    ids.write.options(**ORC_OPTIONS).orc(path)
    return path


def read_ids(spark, path: str) -> DataFrame:
    """The files' rows. The reader's rows at once are lowered in the session: it keeps the lists of a batch in arrays of 8 bytes an id."""
    name = "spark.sql.orc.columnarReaderBatchSize"
    if int(spark.conf.get(name, "4096")) > READ_ROWS:
        spark.conf.set(name, str(READ_ROWS))
    return spark.read.schema(FILE_SCHEMA).orc(path)


def lookup(spark, path: str, doc_id: int) -> DataFrame:
    """The ids of one document; the predicate prunes stripes and row groups."""
    return read_ids(spark, path).where(F.col("doc_id") == doc_id).select("doc_id", "ids")


def id_index(ids: DataFrame) -> DataFrame:
    """Rows doc_id, start, n_tokens, ids_crc32 from the files, which are read once.

    ``start`` counts the ids of all documents before, in the files' order
    (part, place): running sums within a file, over blocks of BLOCK places, and
    over whole files (one row each).
    """
    rows = stored(ids.mapInArrow(_digest, INDEX), "token-index").withColumn("block", F.floor(F.col("place") / BLOCK))
    sums = rows.groupBy("part", "block").agg(F.sum("n_tokens").alias("all"))
    files = sums.groupBy("part").agg(F.sum("all").alias("all"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("base"))
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.withColumn("first", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all")
    inside = Window.partitionBy("part", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    out = out.join(blocks, ["part", "block"]).join(F.broadcast(files), "part")
    return out.select("doc_id", (F.col("base") + F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op9_orc_token_ids(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "token-ids"))
    return id_index(read_ids(spark, path))
