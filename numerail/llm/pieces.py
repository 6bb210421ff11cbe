"""Cutting texts for byte-level tokenizers into parts that encode independently."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space or newline before a non-space always starts a piece of the byte-level pattern, so texts may be cut there.
CUT = re.compile(r"(?=[ \n]\S)")
#: The same test for Arrow: texts in which this is not found are words parted by single spaces and newlines.
NOT_PLAIN = r"[ \n](?:[\s\x{0b}\x{1c}-\x{1f}\x{85}\pZ]|\z)"
#: Marks a part that starts a text: no other part starts with it, as parts start with a non-space or a newline.
START = "\r"
MARKS = ",.;:!?"


def special_tokens(path: str) -> dict[str, int]:
    """Tokens that the library finds in raw text before all else."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


class Cutter:
    """Cuts texts into keys of parts whose ids, joined, are the text's.

    A key that starts with START stands for what follows it, at the start of a
    text or a special token. One that starts with a newline stands for itself,
    any other one for a space and itself; these encode alike after any other
    part.
    """

    def __init__(self, specials):
        self.specials = set(specials)
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")").split if self.specials else None

    def __call__(self, text: str) -> list[str]:
        if self.split and any(s in text for s in self.specials):
            return [c for p in self.split(text) if p for c in ([START + p] if p in self.specials else _parts(p))]
        return _parts(text) if text else []

    def odd(self, texts: pa.Array) -> np.ndarray:
        """Which texts ``plain`` cannot cut."""
        out = pc.or_(pc.match_substring_regex(texts, NOT_PLAIN), pc.equal(pc.binary_length(texts), 0))
        for s in self.specials:
            out = pc.or_(out, pc.match_substring(texts, s))
        return out.to_numpy(zero_copy_only=False)

    def plain(self, texts: pa.Array) -> pa.ListArray:
        """The keys of texts without runs of spaces and special tokens, cut by Arrow."""
        return pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(START, texts, ""), "\n", " \n"), " ")


def _parts(text: str) -> list[str]:
    first, *rest = (p for p in CUT.split(text) if p)
    return [START + first, *(p[1:] if p[0] == " " else p for p in rest)]


def literal(key: str) -> str:
    """The text of a key."""
    return key[1:] if key[0] == START else key if key[0] == "\n" else " " + key


#: Keys that end with a punctuation mark which is a piece of its own.
MARKED = r"\A[^\r](?s:.*)\pL[" + MARKS + r"]\z"


#: The most frequent keys, which are looked up first in a table of their own.
HOT = 32_768


class PartTable:
    """Ids of texts by tables: each distinct part is encoded once while it is kept.

    ``compute`` gets an Arrow array of keys and returns (lengths, ids). Known
    keys are an Arrow array, and the ids of the i-th the i-th list of another,
    so parts are looked up and ids gathered without Python objects. A part that
    ends with a mark has the ids of the rest, and the mark's. Beyond ``limit``
    keys, or 16 ids for each, the more used half stays, in that order.
    """

    def __init__(self, cutter: Cutter, limit: int, compute, mark_ids: dict[str, int]):
        self.cut, self.limit, self.compute = cutter, limit, compute
        self.mark_ids = np.array([mark_ids[m] for m in MARKS], dtype=np.int32)
        self.clear()

    def clear(self) -> None:
        self.keys, self.uses = pa.array([], pa.string()), np.zeros(0, dtype=np.int64)
        self.offsets, self.ids = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def _take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of the keys at places."""
        return gathered(np.diff(self.offsets), self.ids, at)

    def _add(self, keys: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.keys = pa.concat_arrays([self.keys, keys])
        self.uses = np.concatenate([self.uses, np.zeros(len(keys), dtype=np.int64)])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32, copy=False)])

    def _trim(self) -> None:
        """Forgets the less used half if the table is full; uses count half from then on."""
        if len(self.keys) <= self.limit and len(self.ids) <= 16 * self.limit:
            return
        short = np.diff(self.offsets) <= 64
        stay = np.argsort(np.where(short, -self.uses, 1), kind="stable")[: self.limit // 2]
        stay = stay[short[stay]]
        keys, uses, (lengths, ids) = self.keys.take(pa.array(stay)), self.uses[stay] // 2, self._take(stay)
        self.clear()
        self._add(keys, lengths, ids)
        self.uses = uses

    def _found(self, keys: pa.Array) -> np.ndarray:
        """Places of keys, each there once and not among the hot ones; new ones are added."""
        hot = min(HOT, len(self.keys))
        place = pc.index_in(keys, value_set=self.keys.slice(hot)).fill_null(-1).to_numpy().astype(np.int64) + hot
        unknown = np.flatnonzero(place < hot)
        if len(unknown):
            place[unknown] = np.arange(len(unknown)) + len(self.keys)
            new = keys.take(pa.array(unknown))
            self._add(new, *self.compute(new))
        return place

    def ids_of(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of keys."""
        self._trim()
        hot = self.keys.slice(0, HOT)
        at = pc.index_in(keys, value_set=hot).fill_null(-1).to_numpy().astype(np.int64)
        rare = at < 0
        coded = keys.filter(pa.array(rare)).dictionary_encode()
        ends = pc.match_substring_regex(coded.dictionary, MARKED)
        marked = ends.to_numpy(zero_copy_only=False)
        with_mark = coded.dictionary.filter(ends)
        bases = pa.concat_arrays([coded.dictionary.filter(pc.invert(ends)), pc.utf8_slice_codeunits(with_mark, 0, -1)]).dictionary_encode()
        # bases of marked parts may be hot
        place = pc.index_in(bases.dictionary, value_set=hot).fill_null(-1).to_numpy().astype(np.int64)
        cold = np.flatnonzero(place < 0)
        place[cold] = self._found(bases.dictionary.take(pa.array(cold)))
        base = place[bases.indices.to_numpy()]
        n = len(base) - len(with_mark)
        # parts with marks follow the table's for now
        lengths, ids = self._take(base[n:])
        mark = pc.index_in(pc.utf8_slice_codeunits(with_mark, -1), value_set=pa.array(list(MARKS))).to_numpy()
        own = np.empty(len(marked), dtype=np.int64)
        own[~marked], own[marked] = base[:n], len(self.keys) + np.arange(len(with_mark))
        at[rare] = own[coded.indices.to_numpy()]
        uses = np.bincount(at, minlength=len(self.keys) + len(with_mark))
        self.uses += uses[: len(self.keys)]
        np.add.at(self.uses, base[n:], uses[len(self.keys) :])
        every = np.concatenate([np.diff(self.offsets), lengths + 1])
        return gathered(every, np.concatenate([self.ids, np.insert(ids, np.cumsum(lengths), self.mark_ids[mark])]), at)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): of text i, the ids from offsets[i] to offsets[i + 1]."""
        odd = self.cut.odd(texts)
        split = self.cut.plain(texts.filter(pa.array(~odd)))
        cut = [self.cut(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        keys = pa.concat_arrays([split.flatten(), pa.array([k for c in cut for k in c], pa.string())])
        counts = np.concatenate([np.diff(split.offsets.to_numpy()), np.array([len(c) for c in cut], dtype=np.int64)])
        lengths, ids = self.ids_of(keys)
        upto = np.concatenate([[0], np.cumsum(lengths)])
        offsets = upto[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        if odd.any():
            back = np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]))
            lengths, ids = gathered(np.diff(offsets), ids, back)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
        return offsets, ids


def gathered(lengths: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, ids) of the lists at places, of lists that lie end to end."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return lengths[at], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)).take(pa.array(at)).flatten().to_numpy()


def groups_of(texts: pa.Array, size: int = 8 << 20):
    """Runs of texts of bounded bytes (one long text is a run of its own)."""
    upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + size, side="right")) - 1)
        yield at, to
        at = to
