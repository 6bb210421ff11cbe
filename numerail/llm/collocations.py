"""Phrase collocations by generalised suffix automata of bounded depth.

The words of a language are cut into shards of bounded size. A shard's
automaton has a state for each sequence of up to four words that it holds; it
is grown level by level over the end positions in arrays: the state of depth
d + 1 at an end position is the transition from the state of depth d one
position before, and its suffix link is the state of depth d at the same
position. A state's count is the size of its set of end positions.

1. Scan: the states of depth 1 and 2 of each shard with their counts are dealt
   by hash and summed. Words and pairs below the floor are dropped.
2. The frequent pairs set bits of a filter of bounded size, which is broadcast.
3. Scan: the automata grow to depth 4, from states whose word pairs pass the
   filter (a sequence is at most as frequent as its pairs); counts are summed.
4. Joins of the frequent sequences with their parts give the scores. A sequence
   inside a longer one is inside one that is a word longer, to which it is the
   suffix link or the state before the last transition, so the largest count
   over those two decides on subsumption.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, hold, mix64, n_shuffle, small_batches, stored, trim

DEPTH = 4
#: Occurrences of a candidate; share of them in a longer candidate that drops it; phrases of a language in the result.
FLOOR, COVERED, MOST = 30, (80, 100), 2000
#: Words of a shard; bytes of text that are parted into words at a time; entries that a sum holds before it merges them.
SHARD_WORDS, WINDOW, PENDING = 1 << 21, 4 << 20, 1 << 21
#: Bytes of texts for each partition of the sums, and buckets of each.
PARTITION_BYTES, BUCKETS = 8 << 20, 4
#: Bits of the filter of pairs: 16 for each pair, up to 2^28. Beyond that it passes more and results stay the same.
FILTER_BITS, FILTER_LOG = 16, 28
#: Seeds of the words' hashes; the next is taken where another word has the hash of a frequent one.
SEEDS = 8

BREAK = b"."
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", BREAK * 10)
_PART = re.compile(rb"[\x09-\x0D .,;:!?]")
#: A row holds the counts of one bucket: of each shard and depth the number of entries, the bytes of their arrays, and those, compressed.
PACKED = "bucket int, depth array<int>, lang array<string>, n array<long>, size array<long>, data array<binary>"
COUNTED = "depth int, lang string, h1 long, h2 long, h3 long, h4 long, word binary, f long"


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words and, between pieces, BREAK."""
    return text.lower().translate(_ENDS).replace(BREAK, b" . ").split()


def windows(text: bytes, size: int) -> Iterator[bytes]:
    """Parts of a text of about so many bytes that cut no word."""
    at = 0
    while at < len(text):
        found = _PART.search(text, at + size) if at + size < len(text) else None
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


class Numbers(dict):
    """Numbers of words within a shard, in the order of their first use; 0 is the break."""

    def __init__(self):
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


class Automaton:
    """States of sequences of words by depth, over the end positions of a shard.

    ``spelled[d]``: the words of each state of depth d + 1, a column for each;
    ``counts[d]``: its end positions among those that the shard owns. The first
    words of a shard may belong to the one before: sequences may begin there
    but not end.
    """

    def __init__(self, x: np.ndarray, own: np.ndarray, size: int):
        self.x, self.own, self.size = x, own, size
        self.at = np.where(x > 0, x.astype(np.int64), -1)  # the state at each end position
        self.spelled = [[np.arange(size)]]
        self.counts = [np.bincount(x[own], minlength=size)]
        self.counts[0][0] = 0

    def grow(self, keep=None) -> None:
        """Adds a level: a transition from the state before each word, if its suffix link has a state too.
        ``keep(columns)`` tells which of the new states may go on and count."""
        e = 1 + np.flatnonzero((self.at[1:] >= 0) & (self.at[:-1] >= 0))
        keys, state = np.unique(self.at[e - 1] * self.size + self.x[e], return_inverse=True)
        before, last = keys // self.size, keys % self.size
        columns = [c[before] for c in self.spelled[-1]] + [last]
        kept = np.ones(len(keys), dtype=bool) if keep is None else keep(columns)
        number = np.where(kept, np.cumsum(kept) - 1, -1)
        self.at = np.full(len(self.x), -1, dtype=np.int64)
        self.at[e] = number[state]
        ends = self.at[self.own]
        self.spelled.append([c[kept] for c in columns])
        self.counts.append(np.bincount(ends[ends >= 0], minlength=int(kept.sum())))


class Shard:
    """Words of one language, until there are enough of them."""

    def __init__(self, carried: list[bytes] = ()):
        self.numbers = Numbers()
        self.parts = [np.fromiter(map(self.numbers.__getitem__, carried), dtype=np.int32, count=len(carried))]
        self.carried = self.n = len(carried)

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int32, count=len(words)))
        self.n += len(words)

    def automaton(self) -> tuple[Automaton, list[bytes]]:
        x = np.concatenate(self.parts)
        own = np.ones(len(x), dtype=bool)
        own[: self.carried] = False
        return Automaton(x, own, len(self.numbers)), list(self.numbers)


def shards_of(batches: Iterator[pa.RecordBatch], limit: int, window: int) -> Iterator[tuple[str, Shard]]:
    """(lang, shard) of a task's texts. A text that fills a shard goes on in the
    next one, which gets its last words to begin sequences with."""
    open_: dict[str, Shard] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                lang = "und" if lang is None else lang
                shard = open_.setdefault(lang, Shard())
                for piece in windows(text, window):
                    words = words_of(piece)
                    shard.add(words)
                    if shard.n >= limit:
                        yield lang, shard
                        # the last words may be a few of this window and some of those before
                        tail = [w for w in words[1 - DEPTH :]] if len(words) >= DEPTH - 1 else _tail(shard)
                        shard = open_[lang] = Shard(tail)
                shard.add([BREAK])
        while sum(s.n for s in open_.values()) > limit:  # of many languages the largest go first
            lang = max(open_, key=lambda k: open_[k].n)
            yield lang, open_.pop(lang)
    yield from open_.items()


def _tail(shard: Shard) -> list[bytes]:
    names = list(shard.numbers)
    return [names[i] for i in np.concatenate(shard.parts)[1 - DEPTH :]]


def hashes(lang: str, words: list[bytes], seed: int) -> np.ndarray:
    """64-bit hashes of words; those of languages differ."""
    own = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), seed)
    return np.fromiter((xxhash.xxh3_64_intdigest(w, own) for w in words), dtype=np.uint64, count=len(words))


def combined(columns: list[np.ndarray]) -> np.ndarray:
    """One well-spread hash of columns of hashes."""
    v = np.full(len(columns[0]), len(columns), dtype=np.uint64)
    for c in columns:
        v = mix64(v * np.uint64(0x9E3779B97F4A7C15) + c)
    return v


def _zipped(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _dealt(depth: int, lang: str | None, bucket: np.ndarray, pack) -> Iterator[tuple]:
    """(bucket, depth, lang, n, size, data) of each bucket; ``pack(order)`` gives the bytes of some entries."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cuts = np.flatnonzero(np.diff(sorted_)) + 1
    for chosen in np.split(order, cuts):
        if len(chosen):
            data = pack(chosen)
            yield int(bucket[chosen[0]]), depth, lang, len(chosen), len(data), _zipped(data)


def _to_batches(counts: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The counts of a few shards as PACKED, a row for each bucket, a few hundred rows a batch."""
    types = [pa.int32(), *(pa.list_(t) for t in (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary()))]
    rows: dict[int, tuple] = {}
    for bucket, *values in counts:
        for held, v in zip(rows.setdefault(bucket, ([], [], [], [], [])), values, strict=True):
            held.append(v)
    every = [(bucket, *held) for bucket, held in rows.items()]
    for at in range(0, len(every), 256):
        columns = zip(*every[at : at + 256], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split(" ")[0] for f in PACKED.split(", ")])


def _states(lang: str, shard: Shard, buckets: int, seed: int, passes) -> Iterator[tuple]:
    """Packed counts of a shard: of depths 1 and 2, or, with a filter of pairs, of 3 and 4."""
    automaton, words = shard.automaton()
    h = hashes(lang, words, seed)
    if passes is None:
        automaton.grow()
        count = automaton.counts[0]
        used = np.flatnonzero(count)
        if len(used):
            mine = h[used] % np.uint64(buckets)
            yield from _dealt(1, lang, mine.astype(np.int64), lambda i: count[used[i]].astype(np.uint32).tobytes() + b" ".join([words[k] for k in used[i]]))
        depths = (2,)
    else:
        automaton.grow(lambda columns: passes(combined([h[c] for c in columns])))
        automaton.grow()
        automaton.grow()
        depths = (3, 4)
    for depth in depths:
        count = automaton.counts[depth - 1]
        used = np.flatnonzero(count)
        if len(used):
            columns = [h[c[used]] for c in automaton.spelled[depth - 1]]
            count = count[used].astype(np.uint32)
            bucket = (combined(columns) % np.uint64(buckets)).astype(np.int64)
            yield from _dealt(depth, None, bucket, lambda i, columns=columns, count=count: b"".join([c[i].tobytes() for c in columns] + [count[i].tobytes()]))


def packed_counts(docs: DataFrame, buckets: int, seed: int, bits=None, shard_words: int = SHARD_WORDS, window: int = WINDOW) -> DataFrame:
    """The counts of all shards of documents (text, lang), as PACKED."""

    def run(batches):
        hold("collocations", lambda: None)
        passes = None if bits is None else passing(np.frombuffer(bits.value, dtype=np.uint8))
        held, words = [], 0
        for lang, shard in shards_of(batches, shard_words, window):
            held += _states(lang, shard, buckets, seed, passes)
            words += shard.n
            trim()
            if words >= shard_words:  # small shards of a task, of several languages, share rows
                yield from _to_batches(held)
                held, words = [], 0
        yield from _to_batches(held)

    return docs.select("text", "lang").mapInArrow(run, PACKED)


class Sum:
    """Sums of counts by rows of hashes; merges what it holds when there is much."""

    def __init__(self, depth: int):
        self.columns: list[list[np.ndarray]] = [[] for _ in range(depth)]
        self.counts: list[np.ndarray] = []
        self.n = 0

    def add(self, data: bytes, n: int) -> None:
        for k, c in enumerate(self.columns):
            c.append(np.frombuffer(data, dtype=np.uint64, count=n, offset=8 * n * k))
        self.counts.append(np.frombuffer(data, dtype=np.uint32, count=n, offset=8 * n * len(self.columns)).astype(np.int64))
        self.n += n
        if self.n > 2 * len(self.counts[0]) + PENDING:
            self.merge()

    def merge(self) -> None:
        if not self.counts:
            return
        columns, counts = [np.concatenate(c) for c in self.columns], np.concatenate(self.counts)
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        starts = np.flatnonzero(new)
        self.columns, self.counts = [[c[starts]] for c in columns], [np.add.reduceat(counts[order], starts)]
        self.n = len(starts)


class WordSum:
    """Sums of counts by words of a language."""

    def __init__(self):
        self.tables: list[pa.Table] = []
        self.n = 0

    def add(self, data: bytes, n: int) -> None:
        counts = np.frombuffer(data, dtype=np.uint32, count=n).astype(np.int64)
        self.tables.append(pa.table({"w": pa.array(data[4 * n :].split(b" "), pa.large_binary()), "c": counts}))
        self.n += n
        if self.n > 2 * self.tables[0].num_rows + PENDING:
            self.merge()

    def merge(self) -> None:
        if len(self.tables) > 1:
            t = pa.concat_tables(self.tables).group_by("w").aggregate([("c", "sum")])
            self.tables = [t.select(["w", "c_sum"]).rename_columns(["w", "c"])]
        self.n = sum(t.num_rows for t in self.tables)


def summed(packed: DataFrame, partitions: int, floor: int, seed: int) -> DataFrame:
    """Sequences that come at least ``floor`` times, as COUNTED; at depth 0 the
    words of each language (by partition), at depth -1 frequent words whose hash another word has."""

    def out(depth, lang, columns, word, f) -> pa.RecordBatch:
        n = len(f)
        h = [pa.array(c.view(np.int64)) for c in columns] + [pa.nulls(n, pa.int64())] * (DEPTH - len(columns))
        return pa.RecordBatch.from_arrays([pa.array([depth] * n, pa.int32()), pa.array([lang] * n, pa.string()), *h, word if word is not None else pa.nulls(n, pa.binary()), pa.array(f, pa.int64())], [x.split(" ")[0] for x in COUNTED.split(", ")])

    def run(batches):
        words: dict[str, WordSum] = {}
        sums: dict[int, Sum] = {}
        for batch in batches:
            parts = [batch.column(c).flatten() for c in ("depth", "lang", "n", "size", "data")]
            for depth, lang, n, size, data in zip(*parts, strict=True):
                raw, n = pa.decompress(data.as_buffer(), decompressed_size=size.as_py(), codec="zstd", asbytes=True), n.as_py()
                if depth.as_py() == 1:
                    words.setdefault(lang.as_py(), WordSum()).add(raw, n)
                else:
                    sums.setdefault(depth.as_py(), Sum(depth.as_py())).add(raw, n)
        every, frequent = [], []
        for lang, s in words.items():
            s.merge()
            t = s.tables[0]
            names, count = t["w"].to_pylist(), t["c"].to_numpy()
            h = hashes(lang, names, seed)
            every.append(h)
            yield out(0, lang, [], None, [int(count.sum())])
            many = np.flatnonzero(count >= floor)
            frequent.append(h[many])
            if len(many):
                yield out(1, lang, [h[many]], pa.array([names[i] for i in many], pa.binary()), count[many])
        if every:
            h, c = np.unique(np.concatenate(every), return_counts=True)
            shared = np.intersect1d(h[c > 1], np.concatenate(frequent))
            if len(shared):
                yield out(-1, None, [shared], None, np.zeros(len(shared), dtype=np.int64))
        for depth, s in sums.items():
            s.merge()
            many = s.counts[0] >= floor
            if many.any():
                yield out(depth, None, [c[0][many] for c in s.columns], None, s.counts[0][many])

    return packed.repartition(partitions, "bucket").mapInArrow(run, COUNTED)


def _places(v: np.ndarray, log: int) -> list[np.ndarray]:
    mask = np.uint64((1 << log) - 1)
    return [(v & mask).astype(np.int64), ((v >> np.uint64(32)) & mask).astype(np.int64)]


def passing(bits: np.ndarray):
    """The test of a filter: whether the two bits of a hash are set."""
    log = len(bits).bit_length() + 2

    def test(v: np.ndarray) -> np.ndarray:
        out = np.ones(len(v), dtype=bool)
        for p in _places(v, log):
            out &= (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return out

    return test


def pair_filter(pairs: DataFrame, most_log: int = FILTER_LOG) -> bytes:
    """Bits set by the rows (h1, h2): made on the executors by parts, of which each is gathered once; at most 2^most_log bits come to the driver."""
    log = max(13, min(most_log, (FILTER_BITS * pairs.count()).bit_length()))
    part = min(1 << 20, 1 << (log - 3))

    def rows_of(bits: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k in sorted(bits):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits[k].tobytes()], pa.binary())], ["part", "bits"])

    def set_bits(batches):
        bits: dict[int, np.ndarray] = {}
        for b in batches:
            v = combined([b.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2")])
            for p in _places(v, log):
                for k in np.unique(p >> 3 >> (part.bit_length() - 1)):
                    own = p[p >> 3 >> (part.bit_length() - 1) == k] & (8 * part - 1)
                    np.bitwise_or.at(bits.setdefault(int(k), np.zeros(part, dtype=np.uint8)), own >> 3, np.uint8(1) << (own & 7).astype(np.uint8))
        yield from rows_of(bits)

    def join(batches):
        bits: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column("part").to_pylist(), b.column("bits"), strict=True):
                own = np.frombuffer(data.as_buffer(), dtype=np.uint8)
                bits[k] = bits[k] | own if k in bits else own
        yield from rows_of(bits)

    kind = "part int, bits binary"
    out = np.zeros((1 << log) // 8, dtype=np.uint8)
    for r in pairs.select("h1", "h2").mapInArrow(set_bits, kind).repartition(n_shuffle(pairs.sparkSession), "part").mapInArrow(join, kind).collect():
        out[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.tobytes()


def counts(docs: DataFrame, floor: int = FLOOR, **sizes) -> DataFrame:
    """All sequences of up to four words that come ``floor`` times in a language, as COUNTED (stored), without depth -1."""
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(n_shuffle(spark), -(-total // PARTITION_BYTES))
    buckets = BUCKETS * partitions
    for seed in range(SEEDS):
        short = stored(summed(packed_counts(docs, buckets, seed, **sizes), partitions, floor, seed), "phrases-short")
        if not short.where("depth = -1").take(1):
            break
        drop_stored(short)
    else:
        raise RuntimeError(f"words share hashes under {SEEDS} seeds")
    pairs = short.where("depth = 2")
    bits = spark.sparkContext.broadcast(pair_filter(pairs))
    long = stored(summed(packed_counts(docs, buckets, seed, bits, **sizes), partitions, floor, seed), "phrases-long")
    return short.unionByName(long)


def _scored(df: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """lang, phrase, a, l, r and score of the cut that scores lowest, the first of those."""
    wide = "decimal(20,0)"
    score = lambda p, q: F.expr(f"(cast(a as {wide}) * cast(2000000 as decimal(7,0))) div (cast({p} as {wide}) + cast({q} as {wide}))")
    best = F.least(*[F.struct(score(p, q).alias("score"), F.lit(k).alias("k"), F.col(p).alias("l"), F.col(q).alias("r")) for k, (p, q) in enumerate(cuts)]) if len(cuts) > 1 else F.struct(score(*cuts[0]).alias("score"), F.lit(0).alias("k"), F.col(cuts[0][0]).alias("l"), F.col(cuts[0][1]).alias("r"))
    return df.select("*", best.alias("best"))


def _covered(longer: DataFrame, size: int) -> DataFrame:
    """h1 .. h_size and the largest count of a sequence that is a word longer: by the state
    before its last transition, and by its suffix link."""
    names = [f"h{k}" for k in range(1, size + 1)]
    before = longer.select(*names, "f")
    link = longer.select(*[F.col(f"h{k + 1}").alias(f"h{k}") for k in range(1, size + 1)], "f")
    return before.unionByName(link).groupBy(*names).agg(F.max("f").alias("over"))


def collocations(docs: DataFrame, floor: int = FLOOR, covered: tuple[int, int] = COVERED, most: int = MOST, **sizes) -> DataFrame:
    """The phrases of two to four words of each language whose words belong together most.

    Rows (lang, rank, phrase, a, l, r, n, score), at most ``most`` of a
    language. A-Z are lower-cased, texts are parted into pieces at
    ``[.,;:!?\\x0A-\\x0D]`` and those into words ``[^\\x20\\x09]+``. A phrase with
    a >= ``floor`` occurrences is a candidate; its score is the lowest
    2000000 a / (l + r), rounded down, over its cuts into a first part of l and
    a rest of r occurrences. Candidates are left out of which
    ``covered[0] / covered[1]`` of the occurrences lie in one longer candidate.

    Null langs are ``und``, null and empty texts have no words; texts may be of
    any length; repeated rows count as often as they come; doc_ids and extra
    columns are not looked at; an empty table gives no rows. Ties are ordered by
    occurrences, then by the phrase's bytes.
    """
    all_ = counts(docs, floor, **sizes)
    of = lambda depth: all_.where(F.col("depth") == depth)
    words = of(1).select("h1", "lang", F.col("word").cast("string").alias("word"), "f")
    second = words.select(F.col("h1").alias("h2"), F.col("word").alias("last"), F.col("f").alias("f_last"))
    two = of(2).select("h1", "h2", F.col("f").alias("a")).join(words.select("h1", "lang", "word", F.col("f").alias("f_first")), "h1").join(second, "h2")
    two = stored(two.select("h1", "h2", "lang", F.concat_ws(" ", "word", "last").alias("phrase"), "last", "a", "f_first", "f_last"), "phrases-two")

    tail = two.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), "last", F.col("a").alias("f_rest"), "f_last")
    three = of(3).select("h1", "h2", "h3", F.col("f").alias("a")).join(two.select("h1", "h2", "lang", "phrase", F.col("a").alias("f_but"), "f_first"), ["h1", "h2"]).join(tail, ["h2", "h3"])
    three = stored(three.select("h1", "h2", "h3", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "a", "f_first", "f_rest", "f_but", "f_last"), "phrases-three")

    tail = three.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("h3").alias("h4"), "last", F.col("a").alias("f_rest"), F.col("f_rest").alias("f_end"), "f_last")
    head = three.select("h1", "h2", "h3", "lang", "phrase", F.col("a").alias("f_but"), F.col("f_but").alias("f_begin"), "f_first")
    four = of(4).select("h1", "h2", "h3", "h4", F.col("f").alias("a")).join(head, ["h1", "h2", "h3"]).join(tail, ["h2", "h3", "h4"])
    four = four.withColumn("phrase", F.concat_ws(" ", "phrase", "last"))

    share, whole = covered
    inside = F.col("over").isNotNull() & (F.col("over").cast("decimal(20,0)") * whole >= F.col("a").cast("decimal(20,0)") * share)
    two = _scored(two, [("f_first", "f_last")]).join(_covered(of(3), 2), ["h1", "h2"], "left").where(~inside)
    three = _scored(three, [("f_first", "f_rest"), ("f_but", "f_last")]).join(_covered(of(4), 3), ["h1", "h2", "h3"], "left").where(~inside)
    four = _scored(four, [("f_first", "f_rest"), ("f_begin", "f_end"), ("f_but", "f_last")])
    found = [d.select("lang", "phrase", "a", "best.l", "best.r", "best.score") for d in (two, three, four)]
    best = first_of_each(found[0].unionByName(found[1]).unionByName(found[2]), most)
    totals = of(0).groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def first_of_each(df: DataFrame, most: int) -> DataFrame:
    """The first rows of each language, in two steps: of parts of a language, then of those."""
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(n_shuffle(df.sparkSession))))
    parts = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= most)
    return parts.drop("_salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
g AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, range(1, 5) r(k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cut AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score,
    row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (2000000::HUGEINT * c.a) // (x.f + y.f), j) AS nth
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[j + 1:], ' ')),
inner_ AS (SELECT lang, k, a, array_to_string(ws[i:i + m - 1], ' ') AS part
           FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))),
over_ AS (SELECT lang, part, max(a) AS most FROM inner_ GROUP BY ALL),
kept AS (SELECT cut.* FROM cut LEFT JOIN over_ ON over_.lang = cut.lang AND over_.part = cut.phrase
         WHERE nth = 1 AND NOT coalesce(100::HUGEINT * most >= 80::HUGEINT * a, FALSE)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
