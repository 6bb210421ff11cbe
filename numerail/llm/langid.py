"""Language identification by words, backing off to shorter character n-grams.

A word that the model has is scored by its log frequency in each language. One
that it has not is scored by the mean over those of its longest n-grams that
the model has, from four letters down to one. The model is sparse: an entry is
there for the languages that have it, others get a floor. A text's scores are
sums over its words.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, hold, mix64, n_shuffle, small_batches, stored, trim
from .pieces import groups_of

#: Bounds of the sample of labelled documents that the model is fitted on: of each language, and of all together.
SAMPLE_DOCS, SAMPLE_ALL = 600, 24_000
#: Bytes of the texts of a language, of SAMPLE_DOCS documents, after which no more are taken.
SAMPLE_BYTES = 16 << 20
UNKNOWN = "und"
#: What parts words, which are runs of letters in lower case.
NOT_LETTERS = r"[^\pL]+"
#: Kinds of entries: words (0), then n-grams by length, as they are tried.
KINDS = (0, 4, 3, 2, 1)
#: Parts of texts that a worker keeps; bytes of texts that are looked up, and parts of them that are summed, together.
PARTS, HOT, GROUP_BYTES, SUMMED = 160_000, 32_768, 4 << 20, 200_000
#: Bytes of texts whose words are counted together.
COUNTED = 2 << 20


def held_out(doc_id):
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, and which text each is of."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), NOT_LETTERS)
    words, owner = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    some = pc.greater(pc.binary_length(words), 0)
    return words.filter(some), owner[some.to_numpy(zero_copy_only=False)]


class Grams:
    """The n-grams of words: of a space, the word and a space; those of one letter of the word."""

    def __init__(self, words: pa.Array):
        joined = pc.binary_join(pa.array([words.to_pylist()], pa.list_(pa.string())), "  ")[0].as_py() if len(words) else ""
        self.points = np.frombuffer(f" {joined} ".encode("utf-32-le"), dtype="<u4")
        self.length = pc.utf8_length(words).to_numpy().astype(np.int64)
        self.start = np.cumsum(self.length + 2) - self.length - 2

    def of(self, n: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of some words, and which of these each is of."""
        count = np.maximum(0, self.length[which] + 3 - n) if n > 1 else self.length[which]
        first = self.start[which] + (n == 1)
        owner = np.repeat(np.arange(len(which)), count)
        at = np.repeat(first, count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        return gram_hash([self.points[at + j] for j in range(n)]), owner


def gram_hash(points: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(points[0]), dtype=np.uint64)
    for p in points:
        h = mix64(h + p.astype(np.uint64) + np.uint64(1))
    return h


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and n-grams by language, of a bounded run of texts at a time."""
    hold("language", _LOADED.clear)
    names, types = ["lang", "n", "gram", "k"], [pa.string(), pa.int32(), pa.string(), pa.int64()]
    for batch in batches:
        for at, to in groups_of(batch.column("text"), COUNTED):
            tallies = _tallies(batch.slice(at, to - at))
            columns = [*zip(*tallies, strict=True), tuple(tallies.values())] if tallies else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _tallies(batch: pa.RecordBatch) -> dict[tuple, int]:
    langs = batch.column("lang").to_pylist()
    words, owner = words_of(batch.column("text"))
    tallies: dict[tuple, int] = {}
    for lang in sorted(set(langs)):
        mine = np.array([x == lang for x in langs])
        for entry in pc.value_counts(words.filter(pa.array(mine[owner]))).to_pylist():
            word, k = entry["values"], entry["counts"]
            padded = f" {word} "
            keys = [(0, word), *((1, c) for c in word), *((n, padded[i : i + n]) for n in (2, 3, 4) for i in range(len(padded) - n + 1))]
            for n, gram in keys:
                tallies[lang, n, gram] = tallies.get((lang, n, gram), 0) + k
    return tallies


class Entries:
    """Entries of one kind: their keys in order, and for each the languages that have it with how much this lifts them."""

    def __init__(self, keys, of: np.ndarray, lang: np.ndarray, lift: np.ndarray):
        """``of``: which key each language and lift is of, in order."""
        self.keys, self.lang, self.lift = keys, lang, lift
        self.offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(keys)))])

    def spread(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of ``at``, language, lift) for all languages of the entries at places."""
        count = np.diff(self.offsets)[at]
        owner = np.repeat(np.arange(len(at)), count)
        place = np.repeat(self.offsets[at] - np.cumsum(count) + count, count) + np.arange(len(owner))
        return owner, self.lang[place], self.lift[place]


class LanguageModel:
    """Log frequencies of words and n-grams by language, from rows (language, kind, text, count)."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        lang, kind, gram = rows.column("lang").to_numpy(zero_copy_only=False) if rows.num_rows else [], rows.column("n").to_numpy(), rows.column("gram")
        self.languages = sorted(set(lang))
        at = {x: i for i, x in enumerate(self.languages)}
        of, k = np.array([at[x] for x in lang], dtype=np.int64), rows.column("k").to_numpy().astype(np.float64)
        self.floor = np.zeros((len(KINDS), len(self.languages)))
        self.entries: list[Entries] = []
        for row, n in enumerate(KINDS):
            mine = kind == n
            total = np.bincount(of[mine], weights=k[mine], minlength=len(self.languages))
            self.floor[row] = -np.log(2.0 + 2.0 * total)
            texts = gram.filter(pa.array(mine)).combine_chunks() if mine.any() else pa.array([], pa.string())
            texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
            if n == 0:
                coded = texts.dictionary_encode()
                keys, which = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            else:
                points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), dtype="<u4").reshape(-1, n)
                keys, which = np.unique(gram_hash([points[:, j] for j in range(n)]), return_inverse=True)
            lift = np.log((k[mine] + 0.5) / (total[of[mine]] + 1.0)) - self.floor[row][of[mine]]
            order = np.lexsort((of[mine], which))
            self.entries.append(Entries(keys, which[order], of[mine][order], lift[order]))
        self.name = uuid.uuid4().hex

    def score(self, words: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each word the row of its kind in ``floor`` (or -1 where nothing of
        it is known), and the lifts (word, language, lift)."""
        kind, lifts = np.full(len(words), -1, dtype=np.int64), []
        place = pc.index_in(words, value_set=self.entries[0].keys).fill_null(-1).to_numpy().astype(np.int64)
        known = np.flatnonzero(place >= 0)
        kind[known] = 0
        w, lang, lift = self.entries[0].spread(place[known])
        lifts.append((known[w], lang, lift))
        rest = np.flatnonzero(place < 0)
        grams = Grams(words)
        for row, n in enumerate(KINDS[1:], 1):
            entries = self.entries[row]
            if not len(rest) or not len(entries.keys):
                continue
            hashes, owner = grams.of(n, rest)
            at = np.minimum(np.searchsorted(entries.keys, hashes), len(entries.keys) - 1)
            there = entries.keys[at] == hashes
            at, owner = at[there], owner[there]
            found = np.bincount(owner, minlength=len(rest))
            which, lang, lift = entries.spread(at)
            lifts.append((rest[owner[which]], lang, lift / found[owner[which]]))
            kind[rest[found > 0]] = row
            rest = rest[found == 0]
        return kind, tuple(np.concatenate([x[c] for x in lifts]) for c in range(3))


def sample_of(labelled: DataFrame, each: int, most_bytes: int) -> DataFrame:
    """Of each lang the rows (lang, text) with the ``each`` least hashes of (doc_id,
    text), in that order up to ``most_bytes``, but at least one.

    Rows that are alike count once. The least hashes are found in two steps, of
    parts of a language first, from hashes and sizes alone; the texts come
    to those that were chosen.
    """
    spark = labelled.sparkSession
    hashed = labelled.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    rows = hashed.groupBy("lang", "h").agg(F.max(F.octet_length("text")).cast("long").alias("size"))
    parts = Window.partitionBy("lang", "part").orderBy("h")
    whole = Window.partitionBy("lang").orderBy("h")
    few = rows.withColumn("part", F.pmod("h", F.lit(n_shuffle(spark)))).withColumn("k", F.row_number().over(parts)).where(F.col("k") <= each)
    before = F.coalesce(F.sum("size").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    few = few.drop("part", "k").select("lang", "h", F.row_number().over(whole).alias("k"), before.alias("before")).where((F.col("k") <= each) & (F.col("before") < most_bytes))
    chosen = stored(few.select("lang", "h"), "language-sample")
    return hashed.join(bounded_broadcast(chosen, SAMPLE_ALL), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text")


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_all: int = SAMPLE_ALL, sample_bytes: int = SAMPLE_BYTES) -> LanguageModel:
    """Learns from documents that are not held out and have lang and text.

    The ``sample_docs`` documents of each language with the least hashes of id
    and text are taken (all, if there are fewer), of every language that there
    is; with so many languages that these would be more than ``sample_all``, an
    equal share of that of each, and one at least. Of very long texts fewer are
    taken: none after ``sample_bytes`` of a language (or its share of what
    ``sample_all`` documents would have). All that the sample has is in the
    model, so its size follows the sample's and not the table's.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    small_batches(docs.sparkSession)
    each = max(1, min(sample_docs, sample_all // max(1, labelled.select("lang").distinct().count())))
    sample = sample_of(labelled, each, max(1, sample_bytes * each // sample_docs))
    sums = sample.mapInArrow(_count, "lang string, n int, gram string, k long").groupBy("lang", "n", "gram").agg(F.sum("k").alias("k"))
    return LanguageModel(sums.toArrow())


class Scorer:
    """Predicts languages; what a part of a text (what spaces part) adds is computed once while it is kept."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.keys, self.uses = pa.array([], pa.string()), np.zeros(0, dtype=np.int64)
        # of each part its words by kind (the last: of no kind), and its lifts by language
        self.kinds = np.zeros((0, len(KINDS) + 1), dtype=np.float64)
        self.lifts = Entries(np.zeros(0), *(np.zeros(0, dtype=np.int64),) * 2, np.zeros(0))

    def _add(self, keys: pa.Array, kinds: np.ndarray, of: np.ndarray, lang: np.ndarray, lift: np.ndarray) -> None:
        old, n = self.lifts, len(self.keys)
        before = np.repeat(np.arange(n), np.diff(old.offsets))
        self.keys = pa.concat_arrays([self.keys, keys])
        self.uses = np.concatenate([self.uses, np.zeros(len(keys), dtype=np.int64)])
        self.kinds = np.concatenate([self.kinds, kinds])
        self.lifts = Entries(np.zeros(len(self.keys)), np.concatenate([before, of + n]), np.concatenate([old.lang, lang]), np.concatenate([old.lift, lift]))

    def _trim(self) -> None:
        """Forgets the less used half of the parts if they are too many."""
        if len(self.keys) <= PARTS and len(self.lifts.lang) <= 16 * PARTS:
            return
        stay = np.argsort(-self.uses, kind="stable")[: PARTS // 2]
        stay = stay[np.cumsum(np.diff(self.lifts.offsets)[stay]) <= 8 * PARTS]
        keys, kinds, uses, lifts = self.keys.take(pa.array(stay)), self.kinds[stay], self.uses[stay] // 2, self.lifts.spread(stay)
        self._clear()
        self._add(keys, kinds, *lifts)
        self.uses = uses

    def _learn(self, parts: pa.Array) -> None:
        words, owner = words_of(parts)
        kind, (word, lang, lift) = self.model.score(words)
        kinds = np.zeros((len(parts), len(KINDS) + 1))
        np.add.at(kinds, (owner, kind), 1)  # -1 is the last column
        width = max(1, len(self.model.languages))
        cell, back = np.unique(owner[word] * width + lang, return_inverse=True)
        self._add(parts, kinds, cell // width, cell % width, np.bincount(back, weights=lift, minlength=len(cell)))

    def _places(self, parts: pa.Array) -> np.ndarray:
        self._trim()
        at = pc.index_in(parts, value_set=self.keys.slice(0, HOT)).fill_null(-1).to_numpy().astype(np.int64)
        rare = at < 0
        coded = parts.filter(pa.array(rare)).dictionary_encode()
        hot = min(HOT, len(self.keys))
        place = pc.index_in(coded.dictionary, value_set=self.keys.slice(hot)).fill_null(-1).to_numpy().astype(np.int64) + hot
        unknown = np.flatnonzero(place < hot)
        if len(unknown):
            place[unknown] = len(self.keys) + np.arange(len(unknown))
            self._learn(coded.dictionary.take(pa.array(unknown)))
        at[rare] = place[coded.indices.to_numpy()]
        self.uses += np.bincount(at, minlength=len(self.keys))
        return at

    def predict(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """lang_pred and score of each text."""
        languages, n = self.model.languages, len(texts)
        lists = pc.utf8_split_whitespace(texts.fill_null(""))
        at = self._places(lists.flatten())
        offsets, width = lists.offsets.to_numpy(), max(1, len(languages))
        kinds, total = np.zeros((n, len(KINDS) + 1)), np.zeros((n, width))
        first = 0
        while first < n:  # texts by the number of their parts, which bounds what is spread at once
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SUMMED, side="right")) - 1)
            mine, m = at[offsets[first] : offsets[last]], last - first
            owner = np.repeat(np.arange(m), np.diff(offsets[first : last + 1]))
            for c in range(len(KINDS) + 1):
                kinds[first:last, c] = np.bincount(owner, weights=self.kinds[mine, c], minlength=m)
            part, lang, lift = self.lifts.spread(mine)
            total[first:last] = np.bincount(owner[part] * width + lang, weights=lift, minlength=m * width).reshape(m, width)
            first = last
        if languages:
            total += kinds[:, :-1] @ self.model.floor
        z = total / np.sqrt(np.maximum(1.0, kinds[:, :-1].sum(axis=1)))[:, None]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        best = z.argmax(axis=1)
        told = (kinds.sum(axis=1) > 0) & bool(languages)
        score = np.where(told, z[np.arange(n), best] / z.sum(axis=1), 0.0)
        names = pa.array([*languages, UNKNOWN], pa.string())
        return names.take(pa.array(np.where(told, best, len(languages)))), pa.array(score)


_LOADED: dict[str, Scorer] = {}


def _predict(model: LanguageModel, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("language", _LOADED.clear)
        if model.name not in _LOADED:  # a worker keeps what it knows of parts for its later tasks
            _LOADED.clear()
            _LOADED[model.name] = Scorer(model)
        scorer = _LOADED[model.name]
        for batch in batches:
            texts = batch.column("text")
            for at, to in score_groups(texts, max(1, len(model.languages))):
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *scorer.predict(part.column("text"))], [*names, "lang_pred", "score"])
                trim()

    return run


def score_groups(texts: pa.Array, width: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of bounded bytes, and of bounded cells of scores."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    at = 0
    while at < len(texts):
        before = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + GROUP_BYTES, side="right")))
        to = min(to, at + max(1, 4_000_000 // width))
        yield at, to
        at = to


def predict(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` (text among them), lang_pred and score of every row.

    Only the text counts, all of it. Null texts and texts without a letter get
    'und' and 0; ties go to the language first in code-point order; without a
    learned language all get 'und'. Repeated rows are kept, other columns
    dropped; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    flat = docs.select(*keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema] + ["lang_pred string, score double"])
    return flat.mapInArrow(_predict(model, keep), schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, fit(docs), ["doc_id", "text"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
