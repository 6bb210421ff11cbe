"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersection.

Documents are sets of word 5-grams (64-bit hashes). Two sets A and B with
|A & B| / |A | B| >= t share a token among the first |X| - ceil(t |X|) + 1 of
each set X in any common order (prefix filter), and their sizes differ by a
factor of at most 1 / t. A tile is a token with a band of sizes; it holds the
sets with the token in their prefix, of this band or the next one.

1. Scan: size, fingerprint and bitmap of each set; counts of hashed tokens in
   a sketch of fixed size. Equal sets are one class from here on.
2. Scan: prefixes in an order that puts tokens the sketch finds frequent last,
   packed by ranges of tokens; tokens that only one set has are dropped.
3. Tiles of a band and a range of tokens come together with the bitmaps: the
   bits in which two bitmaps of parities differ bound the overlap from above. Pairs of
   a tile within the bound are joined in a forest, not listed.
4. Each tree of that forest (a cluster) gets the sorted arrays of its sets;
   exact intersections give the links. A pair whose ends are linked already
   is not compared. So all links are within a cluster and none is lost as far
   as it joins two components.
5. Connected components of the links.

Groups beyond a size in bytes, in 3 and 4, are cut into chunks, and each pair
of chunks is a group of its own, dealt by chunks too. The number of ranges of
tokens, and of parts that a band's sets are gathered in, follows the counted
bytes and sets, so groups that are cut are rare.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS as HASHES
from .common import bounded_broadcast, components, drop_stored, hold, mix64, n_shuffle, stored

WORDS = 5
#: The threshold as a fraction.
NUM, DEN = 75, 100
SKETCH_BITS = 20
#: Order of tokens by frequency: classes by powers of two of the sketch's count over its mean.
CLASS_BITS = 3
FLUSH_ROWS = 1_000_000
#: Bytes of a group in one task, beyond which it is cut into chunks; sets of a band that are gathered by one task.
CHUNK_BYTES, GATHER_SETS = 24 << 20, 4096
#: Bytes of packed prefixes that a range of tokens gets.
BUCKET_BYTES = 16 << 20
#: Groups that are cut, up to which their list is broadcast.
CUT_GROUPS = 100_000
#: Up to so many ids, counted at run time, are broadcast to pick the texts of clusters.
BROADCAST_IDS = 1_000_000


def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the k-word sequences; with fewer words, of the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = HASHES.of(words)
    n = min(k, len(h))
    s = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return np.unique(mix64(s))


def _band_starts() -> list[int]:
    """Starts of the bands: a set of a band matches sets of the same or the next one only."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * DEN // NUM + 1)
    return out


BANDS = np.array(_band_starts(), dtype=np.int64)


def band(n: int) -> int:
    return int(np.searchsorted(BANDS, n, side="right")) - 1


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities of the tokens' hashes in 64 to 131,072 bits, by the size of the set."""
    bits = 64
    while bits < 2 * len(tokens) and bits < 1 << 17:
        bits *= 2
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> bytes:
    """The bitmap of fewer bits of the same set: parities of halves add up."""
    x = np.frombuffer(bits, dtype=np.uint64)
    while x.nbytes > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def _fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


META = "doc_id long, th long, n long, hi long, lo long, bits binary, chunk int, counts binary"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents, and at the end this task's part of the sketch."""
    hold("words", HASHES.clear)
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    names = [f.split(" ")[0] for f in META.split(", ")]
    types = [pa.int64()] * 5 + [pa.binary(), pa.int32(), pa.binary()]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows, sets = [], []
            for doc_id, th, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "th", "text")), strict=True):
                s = shingle_set(text)
                sets.append(s)
                rows.append((doc_id, th, len(s), *_fingerprint(s), bitmap(s), None, None))
            every = np.concatenate(sets)
            counts += np.bincount((every >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    if counts.any():
        parts = np.minimum(counts, 0xFFFF_FFFF).astype(np.uint32).reshape(64, -1)
        rows = [(*[None] * 6, i, p.tobytes()) for i, p in enumerate(parts)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _sum_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, c in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            c = np.frombuffer(c, dtype=np.uint32).astype(np.uint64)
            sums[i] = sums[i] + c if i in sums else c
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], ["chunk", "counts"])


def frequency_classes(meta: DataFrame) -> np.ndarray:
    """A class, 0 to 7, for each of the sketch's 2^20 cells: a megabyte at any size of the input."""
    parts = meta.where("counts is not null").select("chunk", "counts")
    merged = parts.mapInArrow(_sum_sketch, "chunk int, counts binary")
    rows = merged.repartition(min(64, n_shuffle(meta.sparkSession)), "chunk").mapInArrow(_sum_sketch_long, "chunk int, counts binary").collect()
    total = np.zeros((64, (1 << SKETCH_BITS) // 64))
    for r in rows:
        total[r["chunk"]] += np.frombuffer(r["counts"], dtype=np.uint64)
    flat = total.ravel()
    mean = max(1.0, flat.mean())
    # a cell counts as frequent when other tokens that fall into it do not explain its count
    excess = np.maximum(flat - mean - 6 * np.sqrt(mean), 0)
    return np.minimum(np.ceil(np.log2(1 + excess / (4 + mean / 8))), (1 << CLASS_BITS) - 1).astype(np.uint8)


def _sum_sketch_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, c in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            c = np.frombuffer(c, dtype=np.uint64)
            sums[i] = sums[i] + c if i in sums else c
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], ["chunk", "counts"])


def _prefixes(classes: np.ndarray, buckets: int):
    """Packs (token, band) and class id of all prefixes by ranges of tokens."""

    def flush(keys: list, ids: list) -> pa.RecordBatch:
        k, i = np.concatenate(keys), np.concatenate(ids)
        b = (mix64(k >> np.uint64(8)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(b, kind="stable")
        k, i, b = k[order], i[order], b[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]])
        rows = [(int(b[x]), k[x:y].tobytes(), i[x:y].tobytes()) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "keys", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("words", HASHES.clear)
        keys, ids, rows, seen = [], [], 0, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for text in batch.slice(at, 512).column("text").to_pylist():
                    s = shingle_set(text)
                    if not len(s):
                        continue
                    hi, lo = _fingerprint(s)
                    if (hi, lo) in seen:
                        continue
                    seen.add((hi, lo))
                    order = classes[s >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(64 - CLASS_BITS) | s >> np.uint64(CLASS_BITS)
                    n = len(s) - (NUM * len(s) + DEN - 1) // DEN + 1
                    first = np.partition(order, n - 1)[:n] if n < len(s) else order
                    # 56 bits of the token and 8 of the size's band
                    keys.append(first << np.uint64(8) | np.uint64(band(len(s))))
                    ids.append(np.full(n, hi, dtype=np.int64))
                    rows += n
                if rows >= FLUSH_ROWS:
                    yield flush(keys, ids)
                    keys, ids, rows, seen = [], [], 0, set()
        if rows:
            yield flush(keys, ids)

    return run


def _shared_tokens(ranges: np.ndarray, parts: np.ndarray):
    """Keeps the tokens that two or more sets of a tile have; packs them, with
    their sets, by band, range and a hash of the set: at most as many rows as
    there are of these. ``ranges`` and ``parts``: how many there are of each band."""
    names = ["tband", "range", "part", "ids", "tokens"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def run(table: pa.Table) -> pa.Table:
        hold("words", HASHES.clear)
        k = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in table.column("keys").to_pylist()])
        i = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in table.column("ids").to_pylist()])
        token, b = k >> np.uint64(8), (k & np.uint64(255)).astype(np.int64)
        order = np.argsort(token, kind="stable")
        token, b, i = token[order], b[order], i[order]
        new = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.zeros(0, bool)
        run_of = np.cumsum(new) - 1
        many = np.bincount(run_of)[run_of] > 1
        token, b, i = token[many], b[many], i[many]
        # each set is in the tile of its band and of the one below
        token, tb, i = np.concatenate([token, token]), np.concatenate([b, b - 1]), np.concatenate([i, i])
        order = np.lexsort((i, tb, token))
        token, tb, i = token[order], tb[order], i[order]
        same_tile = (token[1:] == token[:-1]) & (tb[1:] == tb[:-1])
        keep = np.concatenate([[True], ~(same_tile & (i[1:] == i[:-1]))]) if len(token) else np.zeros(0, bool)
        token, tb, i = token[keep], tb[keep], i[keep]
        if len(token):
            tile = np.cumsum(np.concatenate([[True], (token[1:] != token[:-1]) | (tb[1:] != tb[:-1])])) - 1
            many = np.bincount(tile)[tile] > 1
            token, tb, i = token[many], tb[many], i[many]
        if not len(token):
            return pa.Table.from_arrays([pa.array([], t) for t in types], names)
        r = ((mix64(token) >> np.uint64(17)) % ranges[tb + 1]).astype(np.int64)
        of = ((mix64(i.view(np.uint64)) >> np.uint64(11)) % parts[tb + 1]).astype(np.int64)
        order = np.lexsort((of, r, tb))
        token, tb, i, r, of = token[order], tb[order], i[order], r[order], of[order]
        cuts = np.flatnonzero(np.concatenate([[True], (tb[1:] != tb[:-1]) | (r[1:] != r[:-1]) | (of[1:] != of[:-1])]))
        ends = np.append(cuts[1:], len(token))
        packed = [pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()) for x in (i, token)]
        return pa.Table.from_arrays([*(pa.array(x[cuts], pa.int32()) for x in (tb, r, of)), *packed], names)

    return run


def _by_set(table: pa.Table) -> pa.Table:
    """One row for each set of a band, range and part, with its tokens."""
    i = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in table.column("ids").to_pylist()])
    token = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in table.column("tokens").to_pylist()])
    order = np.argsort(i, kind="stable")
    i, token = i[order], token[order]
    cuts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    ends = np.append(cuts[1:], len(i))
    n = len(cuts)
    band_, range_ = table.column("tband")[0].as_py(), table.column("range")[0].as_py()
    packed = pa.array([token[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())
    return pa.Table.from_arrays([pa.array(np.full(n, band_), pa.int32()), pa.array(np.full(n, range_), pa.int32()), pa.array(i[cuts]), packed], ["tband", "range", "hi", "tokens"])


class Forest:
    """Disjoint sets of 0 .. n-1."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.root[max(a, b)] = min(a, b)
        return a != b

    def roots(self, members: np.ndarray) -> np.ndarray:
        out = self.root[members]
        while True:
            up = self.root[out]
            if (up == out).all():
                self.root[members] = out
                return out
            out = up


def _join_members(members: np.ndarray, forest: Forest, linked, edges: list) -> None:
    """Joins all linked pairs of members that are in different trees so far.

    ``linked(i, others)`` compares one member with many. The first member is
    compared with all, then those outside the largest tree: each pair of
    different trees has such an end.
    """
    for turn in range(2):
        roots = forest.roots(members)
        if (roots == roots[0]).all():
            return
        if turn == 0:
            todo = members[:1]
        else:
            values, counts = np.unique(roots, return_counts=True)
            todo = members[roots != values[counts.argmax()]]
        for i in todo:
            roots = forest.roots(members)
            others = members[roots != forest.find(i)]
            if not len(others):
                return
            for j in others[linked(i, others)]:
                if forest.join(int(i), int(j)):
                    edges.append((int(i), int(j)))


def _tiles(table: pa.Table) -> pa.Table:
    """The forest of pairs within the bitmaps' bound, over the tiles of one group."""
    hold("words", HASHES.clear)
    rows = table.select(["hi", "n", "bits", "tokens"]).to_pylist()
    sets: dict[int, int] = {}
    for r in rows:
        sets.setdefault(r["hi"], len(sets))
    size = min(len(r["bits"]) for r in rows)
    n, maps = np.zeros(len(sets), dtype=np.int64), [b""] * len(sets)
    tokens, owner = [], []
    for r in rows:
        at = sets[r["hi"]]
        n[at] = r["n"]
        maps[at] = maps[at] or folded(r["bits"], size)
        tokens.append(np.frombuffer(r["tokens"], dtype=np.uint64))
        owner.append(np.full(len(tokens[-1]), at, dtype=np.int64))
    bits = np.frombuffer(b"".join(maps), dtype=np.uint64).reshape(len(sets), -1)
    token, own = np.concatenate(tokens), np.concatenate(owner)
    order = np.lexsort((own, token))
    token, own = token[order], own[order]
    keep = np.concatenate([[True], (token[1:] != token[:-1]) | (own[1:] != own[:-1])])
    token, own = token[keep], own[keep]
    cuts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    ends = np.append(cuts[1:], len(token))
    # tiles of the same members need one look
    marks = np.add.reduceat(mix64(own.astype(np.uint64) + np.uint64(1)), cuts)
    length = ends - cuts
    _, first = np.unique(np.stack([marks, length.astype(np.uint64)]), axis=1, return_index=True)
    first = first[length[first] > 1]
    forest, edges = Forest(len(sets)), []

    def linked(i, others):
        differ = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
        sums, low = n[others] + n[i], np.minimum(n[others], n[i])
        return ((DEN + NUM) * (sums - differ) >= 2 * NUM * sums) & ((DEN + NUM) * low >= NUM * sums)

    for x in first[np.argsort(-length[first], kind="stable")]:
        _join_members(own[cuts[x] : ends[x]], forest, linked, edges)
    names = np.array(list(sets), dtype=np.int64)
    a = np.array([e[0] for e in edges], dtype=np.int64)
    b = np.array([e[1] for e in edges], dtype=np.int64)
    return pa.Table.from_arrays([pa.array(names[a]), pa.array(names[b])], ["a", "b"])


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold("words", HASHES.clear)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            packed = [shingle_set(t).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("cluster"), pa.array(packed, pa.binary())], ["doc_id", "cluster", "tokens"])


def exactly_linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * intersection >= 75 * union, of sorted distinct arrays."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return DEN * common >= NUM * (len(a) + len(b) - common)


def _link_cluster(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    order = sorted(range(len(ids)), key=lambda i: (ids[i], len(sets[i])))
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    n = np.array([len(s) for s in sets])

    def linked(i, others):
        fit = (DEN * np.minimum(n[others], n[i])) >= NUM * np.maximum(n[others], n[i])
        return np.array([bool(f) and exactly_linked(sets[i], sets[j]) for f, j in zip(fit, others, strict=True)], dtype=bool)

    edges: list[tuple[int, int]] = []
    _join_members(np.arange(len(ids)), Forest(len(ids)), linked, edges)
    return [(ids[a], ids[b]) for a, b in edges]


def _clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links within clusters; the rows come sorted by cluster block."""
    now, ids, sets = None, [], []
    out: list[tuple[int, int]] = []

    def batch_of(edges):
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

    for batch in batches:
        for key, doc_id, tokens in zip(zip(*(batch.column(c).to_pylist() for c in ("cluster", "bi", "bj")), strict=True), batch.column("doc_id").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
            if key != now:
                out += _link_cluster(ids, sets) if len(ids) > 1 else []
                now, ids, sets = key, [], []
            ids.append(doc_id)
            sets.append(np.frombuffer(tokens, dtype=np.uint64))
        if len(out) > 10_000:
            yield batch_of(out)
            out = []
    out += _link_cluster(ids, sets) if len(ids) > 1 else []
    yield batch_of(out)


def in_blocks(rows: DataFrame, group: list[str], weight, by) -> DataFrame:
    """Adds bi, bj: groups of more than CHUNK_BYTES are cut into chunks by a
    hash, and a row of chunk c goes to the blocks of c with each chunk. Blocks
    are dealt one by one, so those of a group are many tasks."""
    chunks = F.ceil(F.sum(weight) / CHUNK_BYTES).cast("int")
    cuts = stored(rows.groupBy(*group).agg(chunks.alias("_k")).where("_k > 1"), "jaccard-cuts")
    cut = rows.join(bounded_broadcast(cuts, CUT_GROUPS), group, "left")
    chunk = F.pmod(F.xxhash64(by), F.col("_k")).cast("int")
    all_chunks = F.when(F.col("_k").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("_k") - 1))
    wide = cut.withColumn("_c", chunk).withColumn("_d", F.explode(all_chunks))
    alone = F.col("_k").isNull()
    blocks = wide.withColumn("bi", F.when(alone, 0).otherwise(F.least("_c", "_d"))).withColumn("bj", F.when(alone, 0).otherwise(F.greatest("_c", "_d"))).drop("_k", "_c", "_d")
    # a join by group leaves all blocks of it in one task; this deals them anew
    return blocks.repartition(n_shuffle(rows.sparkSession), *group, "bi", "bj")


def _deal(meta: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of ranges of packed prefixes, and the ranges and parts of each
    band (from -1 on), by the bytes of the bands' prefixes and their sets."""
    starts = F.array(*[F.lit(int(x)) for x in BANDS[1:]]).cast("array<bigint>")
    of = meta.where("n > 0").select("n", F.size(F.filter(starts, lambda x: x <= F.col("n"))).alias("b"), (F.octet_length("bits") + 64).alias("bytes"))
    prefix = F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1
    found = of.groupBy("b").agg(F.count(F.lit(1)).alias("sets"), F.sum(16 * prefix).alias("packed"), F.sum(8 * prefix + F.col("bytes")).alias("bytes")).collect()
    sets, size = (np.zeros(len(BANDS) + 2) for _ in range(2))
    for r in found:  # a band's sets are in its tile and in the one below
        for b in (r["b"], r["b"] + 1):
            sets[b] += r["sets"]
            size[b] += r["bytes"]
    p = n_shuffle(meta.sparkSession)
    buckets = max(4, p // 2, -(-int(sum(r["packed"] for r in found)) // BUCKET_BYTES))
    ranges = np.maximum(max(1, p // 16), np.ceil(size / CHUNK_BYTES)).astype(np.uint64)
    return buckets, ranges, np.maximum(1, np.ceil(sets / GATHER_SETS)).astype(np.uint64)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Rows doc_id, n_shingles, component_id for each row of docs.

    Null texts and texts without words have no shingles and stand alone.
    Equal sets are linked; repeated rows are kept, and rows with one id are one
    node, also where their texts differ. A row with a null id takes part: its
    component is that of its set's other rows, or null. Texts may be of any
    length. Extra columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    p = n_shuffle(spark)
    # the hash of a text tells the texts of one id apart
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    meta = stored(flat.mapInArrow(_scan, META), "jaccard-meta")
    classes = frequency_classes(meta)
    rows = meta.where("n is not null").select("doc_id", "n", "hi", "lo")
    least = meta.where("n > 0 and doc_id is not null").groupBy("n", "hi", "lo").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.first("bits").alias("bits"))
    reps = stored(least.select("n", "hi", "lo", F.col("rep.doc_id").alias("rep"), F.col("rep.th").alias("th"), "bits"), "jaccard-classes")
    buckets, ranges, parts = _deal(meta)
    packed = flat.select("text").mapInArrow(_prefixes(classes, buckets), "bucket int, keys binary, ids binary")
    if buckets > p:
        packed = packed.repartition(buckets, "bucket")
    shared = packed.groupBy("bucket").applyInArrow(_shared_tokens(ranges, parts), "tband int, range int, part int, ids binary, tokens binary")
    by_set = shared.groupBy("tband", "range", "part").applyInArrow(_by_set, "tband int, range int, hi long, tokens binary")
    tiles = stored(by_set.join(reps.select("hi", "n", "bits"), "hi"), "jaccard-tiles")
    blocks = in_blocks(tiles, ["tband", "range"], F.length("bits") + F.length("tokens"), F.col("hi"))
    forest = stored(blocks.groupBy("tband", "range", "bi", "bj").applyInArrow(_tiles, "a long, b long").distinct(), "jaccard-forest")
    clusters = components(forest, "jaccard-clusters")
    wanted = stored(reps.join(clusters, reps["hi"] == clusters["node"]).select(F.col("rep").alias("doc_id"), "th", F.col("label").alias("cluster")).distinct(), "jaccard-wanted")
    texts = flat.join(bounded_broadcast(wanted, BROADCAST_IDS), ["doc_id", "th"]).select("doc_id", "cluster", "text")
    sets = stored(texts.mapInArrow(_sets_of, "doc_id long, cluster long, tokens binary"), "jaccard-sets")
    by_cluster = in_blocks(sets, ["cluster"], F.length("tokens"), F.struct("doc_id", F.xxhash64("tokens"))).sortWithinPartitions("cluster", "bi", "bj", "doc_id")
    links = by_cluster.mapInArrow(_clusters, "a long, b long")
    # an id with several sets is one node: it is linked with the first id of each of its sets
    many = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("n", "hi", "lo")).alias("x"), F.max(F.struct("n", "hi", "lo")).alias("y")).where("x <> y").select("doc_id")
    same = rows.join(many, "doc_id").join(reps.select("n", "hi", "lo", "rep"), ["n", "hi", "lo"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = stored(links.unionByName(same).distinct(), "jaccard-links")
    labels = components(links, "jaccard-components")
    named = stored(reps.join(labels, reps["rep"] == labels["node"], "left").select("n", "hi", "lo", F.coalesce("label", "rep").alias("component")), "jaccard-named")
    drop_stored(tiles, forest, sets, wanted, reps, links, labels, clusters)
    out = rows.join(named, ["n", "hi", "lo"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, one for each id:
    of several the one whose text, then whose other columns have the least hash, in whatever order they come.

    Rows with a null id stay as they are.
    """
    found = jaccard_components(docs).where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    found = stored(found, "jaccard-kept")
    single = docs.join(bounded_broadcast(found.where("_rows = 1").select("doc_id"), BROADCAST_IDS), "doc_id", "left_semi")
    several = docs.join(bounded_broadcast(found.where("_rows > 1").select("doc_id"), BROADCAST_IDS), "doc_id", "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), F.col("text").isNull(), F.xxhash64(*rest) if rest else F.lit(0)))
    several = several.groupBy("doc_id").agg(least.alias("_row")).select("_row.*")
    return single.unionByName(several).unionByName(docs.where("doc_id is null"))


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same in DuckDB: all pairs that share a shingle, and reachability.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.y AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.x = d.doc_id
"""
