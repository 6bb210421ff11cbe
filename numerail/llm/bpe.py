"""Byte-pair encoding by a tokenization automaton.

The merges are compiled into a deterministic automaton over tokens that
accepts just the token sequences which byte-pair encoding produces. It starts
as one state with a loop for each byte. A merge (u, v) -> w applies a gadget:
the state q which arcs of u enter is copied, the copy loses its arc of v, arcs
of u enter the copy instead, and each state with an arc of u gets an arc of w
to where v led. As all arcs of a token enter one state, a state is known by the
token that enters it, and the arcs need one entry per merge: the arc lost and
when.

Words are read byte by byte. Every start of a word has one tokenization, the
start of no other path, so the automaton is also one over bytes: its state is
the token that ends here and the arcs under way, each with the place in the
tree of labels that it has reached. The transitions (state, byte) -> state are
a table, filled as they first come up; a word is walked once, and its tokens
are read off the states from the end. Decoding emits the labels.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, small_batches, trim
from .pieces import MARKS, START, Cutter, PartTable, groups_of, literal, special_tokens

#: Most entries of a worker's tables: parts (words with what surrounds them), and states over bytes.
PARTS, STATES = 400_000, 100_000
#: Bits of a token in a packed label under way; vocabularies have far fewer tokens.
SHIFT = 24
MASK = (1 << SHIFT) - 1


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in out]
    return out | {b: chr(256 + i) for i, b in enumerate(hidden)}


class TokenAutomaton:
    """The automaton of a vocabulary (labels as bytes) and its merges (pairs of labels)."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.vocab = dict(vocab)
        self.length = {i: len(t) for t, i in vocab.items()}
        self.states = 1
        self.enters: dict[int, int] = {i: 0 for t, i in vocab.items() if len(t) == 1}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.made: dict[int, int] = {}
        self.lost: dict[int, int] = {}
        for at, (a, b) in enumerate(merges):
            self._gadget(at, self.vocab[a], self.vocab[b], self.vocab[a + b])
        # the tree of labels: (node, byte) -> node, and of each node its token or -1 and whether it goes on
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for t, i in self.vocab.items():
            if i in self.enters:
                self._grow(t, i)
        self._forget()

    def _grow(self, label: bytes, token: int) -> None:
        node = 0
        for c in label:
            self.inner[node] = True
            after = self.child.get(node << 8 | c)
            if after is None:
                after = self.child[node << 8 | c] = len(self.token)
                self.token.append(-1)
                self.inner.append(False)
            node = after
        self.token[node] = token

    def _forget(self) -> None:
        """Empties the table of states over bytes; state 0 is the start of a word.

        The key of a state is its last token and, packed into an integer each,
        the labels under way in it: the node, and one more than the token before.
        """
        self.last, self.keys = [-1], [(-1,)]
        self.number: dict[tuple, int] = {}
        self.moves: dict[int, int] = {}

    def _gadget(self, at: int, u: int, v: int, w: int) -> None:
        if u not in self.enters or v not in self.enters or not self._open(u, v):
            return  # the pair never comes up: earlier merges part it
        self.enters[w], self.left[w], self.right[w], self.made[w] = self.enters[v], u, v, at
        self.lost[u << 32 | v] = at
        self.enters[u] = self.states
        self.states += 1

    def _since(self, last: int, token: int) -> int | None:
        """The merge since which the state that ``last`` enters lacks an arc.

        The table holds what the copies made for one token lost. The first of
        them is a copy of the state that the token's right part entered when
        the token was made, so the search goes on there, up to that merge.
        """
        before = len(self.lost) + 1
        while True:
            at = self.lost.get(last << 32 | token)
            if at is not None and at < before:
                return at
            if last not in self.right:
                return None
            before, last = self.made[last], self.right[last]

    def _open(self, last: int, token: int) -> bool:
        open_ = self._since(last, token) is None
        while open_ and token in self.left:
            made, token = self.made[token], self.left[token]
            lost = self._since(last, token)
            open_ = lost is None or lost > made
        return open_

    def arc(self, last: int, token: int) -> bool:
        """Whether the state that ``last`` enters (-1: the first) has an arc of ``token``.

        An arc of a merged token was added where its left part had an arc at
        that time; so along the left parts, none may have been lost before.
        """
        return last < 0 or self._open(last, token)

    def _move(self, state: int, byte: int) -> int:
        """Adds the transition of a state by a byte to the table."""
        ends, under_way = -1, []
        for packed in (*self.keys[state][1:], self.last[state] + 1):
            node, before = packed >> SHIFT, packed & MASK
            after = self.child.get(node << 8 | byte)
            if after is None:
                continue
            token = self.token[after]
            if token >= 0 and ends < 0 and self.arc(before - 1, token):
                ends = token  # no other arc can end here
            if self.inner[after]:
                under_way.append(after << SHIFT | before)
        if ends < 0:
            raise ValueError(f"no path spells a word with the byte {byte}")
        key = (ends, *under_way)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.last)
            self.last.append(ends)
            self.keys.append(key)
        self.moves[state << 8 | byte] = to
        return to

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the path that spells a word: one look-up for each byte."""
        if len(self.last) > STATES:
            self._forget()
        moves, last, length = self.moves, self.last, self.length
        state, ends = 0, []
        for c in word:
            to = moves.get(state << 8 | c)
            state = self._move(state, c) if to is None else to
            ends.append(last[state])
        path, at = [], len(word)
        while at:
            token = ends[at - 1]
            path.append(token)
            at -= length[token]
        path.reverse()
        return path


class Bpe:
    """Encoder and decoder of a byte-level tokenizer file."""

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.byte = {c: b for b, c in byte_letters().items()}
        specials = special_tokens(path)
        label = {t: bytes(self.byte[c] for c in t) for t in model["vocab"] if t not in specials}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.automaton = TokenAutomaton({label[t]: i for t, i in model["vocab"].items() if t in label}, [(label[a], label[b]) for a, b in merges])
        self.words = ByteLevel(add_prefix_space=False).pre_tokenize_str
        labels = {i: t for t, i in self.automaton.vocab.items()} | {i: t.encode() for t, i in specials.items()}
        # arc labels end to end, and their places
        self.label_bytes = np.frombuffer(b"".join(labels.get(i, b"") for i in range(max(labels) + 1)), dtype=np.uint8)
        self.label_length = np.array([len(labels.get(i, b"")) for i in range(max(labels) + 1)], dtype=np.int64)
        self.label_start = np.cumsum(self.label_length) - self.label_length
        self.decimal = np.array([f"{i}," for i in range(max(labels) + 1)], dtype="S")
        self.specials = {START + t: i for t, i in specials.items()}
        self.table = PartTable(Cutter(specials), PARTS, self._encode_new, {m: self.automaton.vocab[m.encode()] for m in MARKS})

    def _ids(self, key: str) -> list[int]:
        """Ids of a key: of its words, if it is not all Latin letters and so one word."""
        if key in self.specials:
            return [self.specials[key]]
        if key[0] not in "\r\n" and key.isalpha() and max(key) < "\u0250":
            return self.automaton.encode_word(b" " + key.encode())
        words = (bytes(map(self.byte.__getitem__, w)) for w, _ in self.words(literal(key)))
        return [i for w in words for i in self.automaton.encode_word(w)]

    def _encode_new(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [self._ids(k) for k in new.to_pylist()]
        return np.array([len(i) for i in ids], dtype=np.int64), np.array([x for i in ids for x in i], dtype=np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts."""
        return self.table.encode(texts)

    def decode(self, ids: np.ndarray) -> str:
        """The text whose bytes are the labels of the arcs."""
        length = self.label_length[ids]
        upto = np.cumsum(length)
        place = np.repeat(self.label_start[ids] - upto + length, length) + np.arange(upto[-1] if len(ids) else 0)
        return self.label_bytes[place].tobytes().decode("utf-8", "replace")

    def decimals(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return self.decimal[ids].tobytes().replace(b"\0", b"")[:-1]


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """The automaton of a file, compiled once in a worker."""
    hold("bpe", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def _encoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    bpe = loaded(path)
    for batch in batches:
        texts = batch.column("text").fill_null("")
        for at, to in groups_of(texts):
            offsets, ids = bpe.encode(texts.slice(at, to - at))
            yield batch.column("doc_id").slice(at, to - at), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            trim()


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids in _encoded(path, batches):
            yield pa.RecordBatch.from_arrays([doc_id, ids], ["doc_id", "ids"])

    return run


def _checked(bpe: Bpe, ids: pa.ListArray) -> tuple[list[pa.Array], list[str]]:
    """n_tokens, ids_sha256 and decoded_sha256 of lists of ids, and the decoded texts."""
    offsets = ids.offsets.to_numpy()
    every = ids.values.to_numpy(zero_copy_only=False)
    lists = [every[x:y] for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
    texts = [bpe.decode(i) for i in lists]
    sha = [hashlib.sha256(bpe.decimals(i)).hexdigest() for i in lists]
    return [pa.array(np.diff(offsets).astype(np.int64)), pa.array(sha, pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())], texts


CHECKED = ["n_tokens", "ids_sha256", "decoded_sha256"]


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                digests, texts = _checked(bpe, part.column("ids"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *digests, pa.array(texts, pa.string())], ["doc_id", *CHECKED, "decoded"])

    return run


def encode_texts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Rows doc_id, ids: the ids of each text; null and empty texts have none.

    Repeated rows are kept; extra columns are ignored. Nothing is shuffled, a
    worker holds the automaton and bounded caches.
    """
    small_batches(docs.sparkSession)
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return flat.mapInArrow(_encode(tokenizer_path), "doc_id long, ids array<int>")


def decode_ids(ids: DataFrame, tokenizer_path: str) -> DataFrame:
    """Rows doc_id, n_tokens, ids_sha256, decoded_sha256, decoded."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded string"
    return ids.select("doc_id", "ids").mapInArrow(_decode(tokenizer_path), schema)


def _both(path: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for doc_ids, ids in _encoded(path, batches):
            for at in range(0, len(ids), 256):
                part = ids.slice(at, 256)
                digests, _ = _checked(bpe, part)
                yield pa.RecordBatch.from_arrays([doc_ids.slice(at, 256), *digests, *([part] if keep_ids else [])], ["doc_id", *CHECKED, *(["ids"] if keep_ids else [])])

    return run


def encode_and_check(docs: DataFrame, tokenizer_path: str, keep_ids: bool = True) -> DataFrame:
    """Rows doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (if wanted): ids
    with digests of them and of what they decode to. Encoding and decoding are
    one pass; rows are as those of ``encode_texts``."""
    small_batches(docs.sparkSession)
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return flat.mapInArrow(_both(tokenizer_path, keep_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def op6_bpe_automaton(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return encode_and_check(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, keep_ids=False)
