"""Substring dedup by automata of repeated phrases.

A window of 50 words is removed where its words also start a window in a
document with a smaller id. Each window selects one of its 20-word phrases,
the one with the least hash, so equal windows select equal phrases.

1. Scan: the selected phrases of every document, packed by ranges of hashes;
   phrases of one document only are dropped. What is left are the phrases that
   may recur, and the documents that have them.
2. The documents meet their phrases. Those without any keep all words. Of the
   others, the stretch of text around each place (all windows that selected
   the phrase) goes to the shard of its phrase; a window that an earlier
   document of the same task has too, word by word, is settled there, and one
   that the text itself had before ends as that does.
   Of a phrase with very many stretches only the windows whose digest recurs go
   on, each to a shard of its own, so that equal windows meet and others do not.
3. Each shard confirms the phrases that different documents have, compiles them
   into an Aho-Corasick automaton (one letter a word), streams its stretches
   through it, and finds for each window around each occurrence the smallest
   document with the same words.
4. The removed stretches meet their documents again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, bounded_broadcast, drop_stored, hold, mix64, n_shuffle, stored

WINDOW, PHRASE = 50, 20
FLUSH_ROWS = 1_000_000
#: Stretches of one automaton; a shard's rows are taken in portions of whole phrases.
PORTION = 4_000
#: Up to so many ids, counted at run time, are broadcast to pick texts.
BROADCAST_IDS = 1_000_000
#: Stretches of a phrase, beyond which its windows are dealt one by one.
MANY = 1_000
#: Windows that a task remembers, to settle those of later documents.
REMEMBERED = 150_000
#: Letters that stand for words in automata: code points above the surrogates.
LETTERS = 0x100000


def hashes(words: list[bytes]) -> np.ndarray:
    return WORDS.of(words)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, for n = 2^a + 2^b or a power of two, by doubling."""
    out, have, done = None, h, 1
    rest, offset, width = n, 0, 0
    while rest:
        if rest & 1:
            piece = have[offset:]
            if out is None:
                out = piece
            else:
                m = min(len(out), len(piece))
                out = mix64(out[:m] * np.uint64(0x9E3779B97F4A7C15) + piece[:m] + np.uint64(width))
            offset += done
            width += done
        rest >>= 1
        if rest:
            m = max(0, len(have) - done)
            have = mix64(have[:m] * np.uint64(0xC2B2AE3D27D4EB4F) + have[done : done + m])
            done *= 2
    return out[: max(0, len(h) - n + 1)]


def selected(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window, the place of its phrase (the first of the least), and all phrase hashes."""
    p = rolling(h, PHRASE)
    span = WINDOW - PHRASE + 1
    windows = len(h) - WINDOW + 1
    if windows <= 0:
        return np.zeros(0, dtype=np.int64), p
    view = np.lib.stride_tricks.sliding_window_view(p, span)
    return np.arange(windows) + view.argmin(axis=1), p


def least_in_windows(p: np.ndarray) -> np.ndarray:
    """The least phrase hash of each window, by doubling."""
    span, have, m = WINDOW - PHRASE + 1, 1, p
    while 2 * have <= span:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(p) - span + 1], m[span - have :][: len(p) - span + 1])


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _phrases(buckets: int):
    """Packs (phrase hash, doc_id, th) of the places that windows select.

    A phrase that several documents of a flush have recurs for sure: it comes
    out with each of them, and with two of them in the range of its hash. So a
    range gets two rows of a phrase from a flush at most, however common it is.
    """
    names = ["bucket", "doc_id", "th", "keys", "ids", "ths"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def flush(found: list) -> Iterator[pa.RecordBatch]:
        k = np.concatenate([f[0] for f in found])
        i, t = (np.repeat(np.array([f[c] for f in found], dtype=np.int64), [len(f[0]) for f in found]) for c in (1, 2))
        order = np.lexsort((t, i, k))
        k, i, t = k[order], i[order], t[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(k)) - 1
        several = (i[starts] != i[ends])[np.cumsum(new) - 1]
        rows = [(None, d, h, x.tobytes(), None, None) for d, h, x in _by_text(k[several], i[several], t[several])]
        both = np.unique(np.concatenate([starts, ends]))
        k, i, t = k[both], i[both], t[both]
        b = (mix64(k) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(b, kind="stable")
        k, i, t, b = k[order], i[order], t[order], b[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]])
        rows += [(int(b[x]), None, None, k[x:y].tobytes(), i[x:y].tobytes(), t[x:y].tobytes()) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        for at in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 5000], strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("words", WORDS.clear)
        found, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc_id, th, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "th", "text")), strict=True):
                    words = _split(text)
                    if doc_id is None or len(words) < WINDOW:
                        continue
                    k = np.unique(least_in_windows(rolling(hashes(words), PHRASE)))
                    found.append((k, doc_id, th))
                    rows += len(k)
                if rows >= FLUSH_ROWS:
                    yield from flush(found)
                    found, rows = [], 0
        if rows:
            yield from flush(found)

    return run


def _by_text(k: np.ndarray, i: np.ndarray, t: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(doc_id, th, phrase hashes) of each text."""
    if not len(k):
        return []
    order = np.lexsort((k, t, i))
    k, i, t = k[order], i[order], t[order]
    cuts = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])]))
    return [(int(i[x]), int(t[x]), k[x:y]) for x, y in zip(cuts, np.append(cuts[1:], len(k)), strict=True)]


def _recurring(table: pa.Table) -> pa.Table:
    """For each text, its phrases of this range that other documents have too."""
    hold("words", WORDS.clear)
    k = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in table.column("keys").to_pylist()])
    i, t = (np.concatenate([np.frombuffer(x, dtype=np.int64) for x in table.column(c).to_pylist()]) for c in ("ids", "ths"))
    order = np.lexsort((t, i, k))
    k, i, t = k[order], i[order], t[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(k)) - 1
    several = (i[starts] != i[ends])[np.cumsum(new) - 1]  # smallest and largest document differ
    rows = [(d, h, x.tobytes()) for d, h, x in _by_text(k[several], i[several], t[several])]
    return pa.Table.from_arrays([pa.array([r[c] for r in rows], ty) for c, ty in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "th", "keys"])


STRETCH = "doc_id long, th long, start int, first int, shard long, phrase int, words binary, kind int, same int"
#: Kinds of stretches: those to settle in shards, those an earlier document has, and those that repeat windows of their own text.
OPEN, SETTLED, REPEATED = 0, 1, 2


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, kinds = zip(*(f.split(" ") for f in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types[k]) for c, k in enumerate(kinds)], list(names))


class Earlier:
    """Windows of a task's documents so far, which come in the order of doc_id."""

    def __init__(self):
        self.seen: dict[int, tuple] = {}

    def kinds(self, doc_id: int, th: int, start: int, hashes: list[int], words: list[bytes]) -> list[tuple[int, int | None]]:
        """Of each window of a stretch that starts at word ``start``: SETTLED if an
        earlier document has the same words, REPEATED and where if this text had
        them before, else OPEN."""
        out, last = [], (None, -1)
        for x, h in enumerate(hashes):
            of, of_text, place, there, at = self.seen.setdefault(h, (doc_id, th, start + x, words, x))
            kind = SETTLED if of < doc_id else REPEATED if of_text == th and place < start + x else OPEN
            if kind != OPEN:
                # next to the window compared before, one word is left to compare
                equal = there[at + WINDOW - 1] == words[x + WINDOW - 1] if last == (id(there), at - 1) else there[at : at + WINDOW] == words[x : x + WINDOW]
                kind = kind if equal else OPEN
            last = (None, -1) if kind == OPEN else (id(there), at)
            out.append((kind, place if kind == REPEATED else None))
        if len(self.seen) > REMEMBERED:  # only a shorter memory: what is not told here is settled in the shards
            self.seen.clear()
        return out


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretch of each place with a recurring phrase.

    A row holds the words from the first to the last window that selected the
    place, ``start`` of the first word, and the place of the phrase in it.
    The rows come in the order of doc_id, so a window that an earlier document
    of this task has is removed for sure: those come out settled, with no words.
    Windows that a text repeats come out with the place they repeat, as they
    end alike. A row that repeats the one before it adds nothing.
    """
    hold("words", WORDS.clear)
    earlier, last = Earlier(), None
    rows: list[tuple] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            for doc_id, th, text, packed in zip(*(part.column(c).to_pylist() for c in ("doc_id", "th", "text", "keys")), strict=True):
                words = _split(text)
                if len(words) < WINDOW or (doc_id, th) == last:
                    continue
                last = doc_id, th
                keys = np.unique(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in packed]))
                h = hashes(words)
                place, p = selected(h)
                w = rolling(h, WINDOW)
                # a place is selected by a run of windows
                starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                ends = np.append(starts[1:], len(place))
                there = np.minimum(np.searchsorted(keys, p[place[starts]]), len(keys) - 1)
                recur = np.flatnonzero(keys[there] == p[place[starts]])
                for a, b in zip(starts[recur].tolist(), ends[recur].tolist(), strict=True):
                    at_phrase = int(place[a])
                    key = int(p[at_phrase].astype(np.int64))
                    known = earlier.kinds(doc_id, th, a, w[a:b].tolist(), words[a : b - 1 + WINDOW])
                    # runs of windows of one kind
                    x = a
                    while x < b:
                        kind, same = known[x - a]
                        y = x + 1
                        while y < b and known[y - a] == (kind, None if same is None else same + y - x):
                            y += 1
                        if kind == OPEN:
                            rows.append((doc_id, th, x, y - x, key, at_phrase - x, b"\n".join(words[x : y - 1 + WINDOW]), kind, None))
                        else:
                            rows.append((doc_id, th, x, y - x, None, None, None, kind, same))
                        x = y
            if len(rows) > 2000:
                yield _rows(STRETCH, rows)
                rows = []
    if rows:
        yield _rows(STRETCH, rows)


DIGESTS = "doc_id long, th long, start int, at int, digest binary"


def _windows(words: bytes, count: int) -> list[bytes]:
    split = words.split(b"\n")
    return [b"\n".join(split[x : x + WINDOW]) for x in range(count)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the words of each window."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            cols = [batch.slice(at, 512).column(c).to_pylist() for c in ("doc_id", "th", "start", "first", "words")]
            yield _rows(DIGESTS, [(d, t, s, x, hashlib.md5(w).digest()) for d, t, s, n, words in zip(*cols, strict=True) for x, w in enumerate(_windows(words, n))])


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows ``at`` of each stretch as stretches of their own, in shards by their digest."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            cols = [batch.slice(at, 128).column(c).to_pylist() for c in ("doc_id", "th", "start", "first", "phrase", "words", "at")]
            rows = []
            for doc_id, th, start, n, phrase, words, which in zip(*cols, strict=True):
                cut = _windows(words, n)
                rows += [(doc_id, th, start + x, 1, int.from_bytes(hashlib.md5(cut[x]).digest()[:8], "little", signed=True), phrase - x, cut[x], OPEN, None) for x in sorted(set(which))]
            yield _rows(STRETCH, rows)


def spread(stretches: DataFrame) -> DataFrame:
    """Open stretches, those of a phrase that has more than MANY cut into windows.

    Of such a phrase only windows whose digest different documents have go on;
    equal ones meet in one shard, which their digest tells. Digests are counted
    where they are made before they are shuffled, so a window that very many
    documents have is no burden.
    """
    open_ = stretches.where(F.col("kind") == OPEN)
    hot = stored(open_.groupBy("shard").count().where(F.col("count") > MANY).select("shard"), "phrase-hot")
    if not hot.limit(1).count():
        return open_
    hot = bounded_broadcast(hot, BROADCAST_IDS)
    theirs = stored(open_.join(hot, "shard").select(open_.columns), "phrase-many")
    digests = stored(theirs.mapInArrow(_digests, DIGESTS), "phrase-digests")
    several = digests.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("digest")
    several = stored(several, "phrase-several")
    key = ["doc_id", "th", "start"]
    which = digests.join(bounded_broadcast(several, BROADCAST_IDS), "digest").groupBy(*key).agg(F.collect_list("at").alias("at"))
    cut = stored(theirs.join(which, key).mapInArrow(_one_by_one, STRETCH), "phrase-cut")
    drop_stored(theirs, digests, several)
    return open_.join(hot, "shard", "left_anti").select(open_.columns).unionByName(cut)


class PhraseAutomaton:
    """Aho-Corasick over words: a letter stands for a word. All phrases are of one length."""

    def __init__(self, phrases: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for text in phrases:
            self.automaton.add_word(text, True)
        if phrases:
            self.automaton.make_automaton()

    def ends(self, text: str) -> np.ndarray:
        """The last letter of every occurrence."""
        return np.array([end for end, _ in self.automaton.iter(text)] if len(self.automaton) else [], dtype=np.int64)


def letters(codes: np.ndarray) -> np.ndarray:
    """Code points for numbered words, above the surrogates; words may share one."""
    return (codes % LETTERS).astype("<u4") + np.uint32(0x10000)


def _settle(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
    """Removed windows (doc_id, th, first window, windows) of the stretches of some phrases."""
    doc, th, start, count, shard, phrase = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(6))
    size = np.array([r[6].count(b"\n") + 1 for r in rows], dtype=np.int64)
    flat = pa.array(b"\n".join([r[6] for r in rows]).split(b"\n"), pa.binary())
    begin = np.cumsum(size) - size
    # equal words have equal numbers
    codes = flat.dictionary_encode().indices.to_numpy()
    del flat
    # the stretches as one text, a separator after each
    row_of = np.repeat(np.arange(len(rows)), size)
    spelt = np.full(len(codes) + len(rows), 0xFFFF, dtype="<u4")
    spelt[np.arange(len(codes)) + row_of] = letters(codes)
    text = spelt.tobytes().decode("utf-32-le")
    # confirm: phrases that more than one document has
    _, group = np.unique(shard, return_inverse=True)
    low, high = np.full(group.max() + 1, np.iinfo(np.int64).max), np.full(group.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, group, doc)
    np.maximum.at(high, group, doc)
    confirmed = np.flatnonzero((low < high)[group])
    runs = codes[(begin + phrase)[confirmed][:, None] + np.arange(PHRASE)]
    runs, first = np.unique(runs, axis=0, return_index=True)
    at = (begin + phrase)[confirmed][first] + confirmed[first]
    patterns = {text[i : i + PHRASE] for i in at.tolist()}
    end = PhraseAutomaton(sorted(patterns)).ends(text)
    row = np.searchsorted(begin + np.arange(len(rows)), end, side="right") - 1
    hit = end - row - PHRASE + 1  # first word, in codes
    # windows around an occurrence; where letters are shared a place too many only costs a comparison
    a = np.maximum(begin[row], hit + PHRASE - WINDOW)
    b = np.minimum(begin[row] + count[row] - 1, hit)
    ok = a <= b
    edge = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(edge, a[ok], 1)
    np.add.at(edge, b[ok] + 1, -1)
    places = np.flatnonzero(np.cumsum(edge) > 0)
    if not len(places):
        return []
    owner = row_of[places]
    group = equal_runs(codes, places, WINDOW)
    least = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, doc[owner])
    removed = least[group] < doc[owner]
    at, of = (start[owner] + places - begin[owner])[removed], owner[removed]
    if not len(of):
        return []
    # a text's windows, whatever stretch they are from
    d, t = doc[of], th[of]
    order = np.lexsort((at, t, d))
    d, t, at = d[order], t[order], at[order]
    cuts = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (at[1:] > at[:-1] + 1)]))
    ends = np.append(cuts[1:], len(d)) - 1
    return list(zip(d[cuts].tolist(), t[cuts].tolist(), at[cuts].tolist(), (at[ends] - at[cuts] + 1).tolist(), strict=True))


def equal_runs(codes: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Numbers the runs of n codes at places, so that those with equal codes have one number."""
    h = rolling(mix64(codes.astype(np.uint64) + np.uint64(1)), n)
    _, first, group = np.unique(h[places], return_index=True, return_inverse=True)
    same = np.ones(len(places), dtype=bool)
    for k in range(n):
        same &= codes[places + k] == codes[places[first[group]] + k]
    if same.all():
        return group
    # runs that share a hash by chance
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(codes[p : p + n].tobytes(), len(numbers)) for p in places.tolist()], dtype=np.int64)


FOUND = "doc_id long, th long, start int, first int"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settles the stretches of a task, which come sorted by phrase, portion by portion."""
    hold("words", WORDS.clear)
    rows: list[tuple] = []
    last = None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("doc_id", "th", "start", "first", "shard", "phrase", "words")]
        for row in zip(*cols, strict=True):
            if row[4] != last and len(rows) >= PORTION:
                yield _rows(FOUND, _settle(rows))
                rows = []
            last = row[4]
            rows.append(row)
    if rows:
        yield _rows(FOUND, _settle(rows))


def _covered(n: int, spans: list[dict]) -> np.ndarray:
    """Whether each of n words is in a removed window. A span is a run of removed
    windows, or one that ends as an earlier run of its text, ``same``, does."""
    removed = np.zeros(max(0, n - WINDOW + 1), dtype=bool)
    for s in sorted(spans, key=lambda s: s["same"] is not None):
        to = slice(s["start"], s["start"] + s["first"])
        removed[to] |= True if s["same"] is None else removed[s["same"] : s["same"] + s["first"]]
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(removed)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return np.cumsum(edge)[:n] > 0


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            words_n, removed_n, sha, kept_text = [], [], [], []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                words = _split(text)
                gone = _covered(len(words), spans or [])
                n = int(gone.sum())
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if n else words)
                words_n.append(len(words))
                removed_n.append(n)
                sha.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(text if not n else kept.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row"), pa.array(words_n, pa.int64()), pa.array(removed_n, pa.int64()), pa.array(sha), pa.array(kept_text, pa.string())],
                ["doc_id", "row", "n_words", "n_removed", "kept_sha256", "kept"],
            )


def _texts(docs: DataFrame, *more) -> DataFrame:
    """doc_id, th and text: the hash of a text tells the texts of one id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text", *more)


KEY = ["doc_id", "th"]


def removed_spans(docs: DataFrame) -> DataFrame:
    """Rows doc_id, th, start, first, same: runs of ``first`` removed windows that
    start at word ``start`` of the texts with hash ``th``; where ``same`` is not
    null, of windows that are removed if those at word ``same`` are. Some may come twice."""
    spark = docs.sparkSession
    p = n_shuffle(spark)
    flat = _texts(docs)
    packed = stored(flat.mapInArrow(_phrases(max(4, p // 2)), "bucket int, doc_id long, th long, keys binary, ids binary, ths binary"), "phrase-packed")
    met = packed.where("bucket is not null").groupBy("bucket").applyInArrow(_recurring, "doc_id long, th long, keys binary")
    met = met.unionByName(packed.where("bucket is null").select(*KEY, "keys"))
    places = stored(met.groupBy(*KEY).agg(F.collect_list("keys").alias("keys")), "phrase-places")
    drop_stored(packed)
    # only texts with places are shuffled, unless these are too many to be told by their ids
    texts = flat.join(bounded_broadcast(places.select(*KEY), BROADCAST_IDS), KEY)
    meet = texts.join(places.hint("merge"), KEY).sortWithinPartitions(*KEY)
    stretches = stored(meet.select(*KEY, "text", "keys").mapInArrow(_stretches, STRETCH), "phrase-stretches")
    open_ = spread(stretches).drop("kind", "same").repartition(2 * p, "shard").sortWithinPartitions("shard")
    found = stored(open_.mapInArrow(_shards, FOUND), "phrase-found")
    told = stored(stretches.where(F.col("kind") != OPEN).select(*KEY, "start", "first", "same"), "phrase-told")
    drop_stored(stretches, places)
    out = told.unionByName(found.withColumn("same", F.lit(None).cast("int")))
    out._parts = (found, told)
    return out


def dedup_substrings(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rows doc_id, n_words, n_removed, kept_sha256, kept and the columns ``keep``.

    ``kept`` is the text itself where nothing is removed, else the kept words
    joined by one space. Null texts have no words. Rows with one id count as
    one document (none removes words of another), and each loses what its own
    text has; rows with a null id neither lose words nor make others lose any.
    Repeated rows are kept and end alike; texts may be of any length; columns
    that are not asked for are ignored. An empty table gives none.
    """
    keep = keep or []
    found = removed_spans(docs)
    spans = found.groupBy(*KEY).agg(F.collect_set(F.struct("start", "first", "same")).alias("spans"), F.bool_or(F.col("same").isNull()).alias("any"))
    spans = stored(spans.where("any").drop("any"), "phrase-spans")
    drop_stored(*found._parts)
    flat = _texts(docs, F.struct(*keep, F.lit(0).alias("_")).alias("row"))
    row = flat.schema["row"].dataType.simpleString()
    schema = f"doc_id long, row {row}, n_words long, n_removed long, kept_sha256 string, kept string"
    # only texts that lose words are shuffled to their spans, unless these are too many to be told by their ids
    ids = bounded_broadcast(spans.select(*KEY), BROADCAST_IDS)
    whole = flat.join(ids, KEY, "left_anti").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    less = flat.join(ids, KEY, "left_semi").join(spans.hint("merge"), KEY)
    out = whole.unionByName(less).mapInArrow(_kept, schema)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept", *[F.col("row")[c].alias(c) for c in keep])


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


#: The same in DuckDB: all windows, the smallest document of each, and the words outside removed ones.
OP8_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM h JOIN f USING (h) WHERE first < doc_id),
o AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM w),
k AS (SELECT o.doc_id, count(*) AS n_words, count(g.j) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY o.j) FILTER (g.j IS NULL), '') AS kept
      FROM o LEFT JOIN g ON g.doc_id = o.doc_id AND g.j = o.j GROUP BY o.doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""
