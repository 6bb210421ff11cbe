"""Small documents with the awkward cases, and brute-force versions of operators."""

import math
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, row string, h long, bucket int"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join("w%d" % r.randrange(vocabulary) for _ in range(n))


def edited(text: str, seed: int, changes: int) -> str:
    words, r = text.split(" "), random.Random(seed)
    for _ in range(changes):
        words[r.randrange(len(words))] = "x%d" % r.randrange(10**6)
    return " ".join(words)


def awkward_texts() -> list[tuple]:
    """(doc_id, text): nulls, blanks, copies, near copies, repeated rows, shared passages, long and odd texts."""
    base = prose(1, 300)
    passage = prose(2, 60)
    rows = [
        (10, base), (11, base), (12, base.upper()), (13, edited(base, 1, 3)), (14, edited(base, 2, 9)), (15, edited(base, 3, 40)),
        (20, None), (21, ""), (22, " \t\n "), (23, "one two"), (24, "one\ttwo"), (25, "one"), (26, "ONE two"),
        (30, prose(3, 80) + " " + passage + " " + prose(4, 30)), (31, passage + " " + prose(5, 90)), (32, prose(6, 20) + "  " + passage.replace(" ", "\n")),
        (33, prose(7, 10) + " " + " ".join(passage.split(" ")[3:]) + " end"),
        (40, prose(8, 20_000, 5000)), (41, "a" * 70_000), (42, "ß é́ 漢字 🙂 \x1c\x00 end"), (43, "<|endoftext|> x <|endoftext|>"),
        (50, "1234 5678 !!! ---"), (None, base), (None, "no id here"), (60, prose(9, 49)), (61, prose(9, 49)), (62, prose(9, 50)), (63, prose(9, 50)),
    ]
    rows += [(100 + i, edited(base, 50 + i, 2)) for i in range(25)]
    rows += [(10, base), (31, passage + " " + prose(5, 90)), (30, "another text with the same id " + prose(10, 60))]
    return rows


def frame(spark, rows):
    langs = ["en", None, "de"]
    full = [(i, t, langs[n % 3], None if n % 5 == 0 else f"s{n % 4}", None if t is None else len(t), -1, "r", 7, n) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def shingles(text, lower=True):
    t = (text or "").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    w = WORD.findall(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    """component of each row: nodes are ids; rows link when 100 * common >= 75 * union."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    out = []
    for i, a in sets:
        if i is None:
            same = [find(j) for j, b in sets if j is not None and a and a == b]
            out.append((i, len(a), min(same) if same else None))
        else:
            out.append((i, len(a), find(i)))
    return out


def brute_removed(rows):
    """(doc_id, words, removed words, kept text) of each row."""
    first: dict[tuple, int] = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


class BruteLanguages:
    """The word-first backoff model and scores in plain Python, of labelled texts (lang, text)."""

    def __init__(self, labelled):
        self.counts: dict[int, dict[str, dict[str, int]]] = {n: {} for n in range(5)}
        self.total: dict[tuple[int, str], int] = {}
        self.languages = sorted({lang for lang, _ in labelled})
        for lang, text in labelled:
            for word in self.words(text):
                for n in range(5):
                    for gram in self.grams(word, n):
                        of = self.counts[n].setdefault(gram, {})
                        of[lang] = of.get(lang, 0) + 1
                        self.total[n, lang] = self.total.get((n, lang), 0) + 1

    @staticmethod
    def words(text):
        out, now = [], ""
        for c in text + " ":
            if c.isalpha():
                now += c.lower()
            elif now:
                out.append(now)
                now = ""
        return out

    @staticmethod
    def grams(word, n):
        if n < 2:
            return [word] if n == 0 else list(word)
        padded = f" {word} "
        return [padded[i : i + n] for i in range(len(padded) - n + 1)]

    def log_frequency(self, n, gram, lang):
        total = self.total.get((n, lang), 0)
        k = self.counts[n][gram].get(lang)
        return -math.log(2 + 2 * total) if k is None else math.log((k + 0.5) / (total + 1))

    def predict(self, text):
        words, sums, scored = self.words(text or ""), {x: 0.0 for x in self.languages}, 0
        if not words or not self.languages:
            return "und", 0.0
        for word in words:
            for n in (0, 4, 3, 2, 1):
                found = [g for g in self.grams(word, n) if g in self.counts[n]]
                if found:
                    scored += 1
                    for lang in self.languages:
                        sums[lang] += sum(self.log_frequency(n, g, lang) for g in found) / len(found)
                    break
        z = {x: s / math.sqrt(max(1, scored)) for x, s in sums.items()}
        top = max(z.values())
        e = {x: math.exp(v - top) for x, v in z.items()}
        best = max(self.languages, key=lambda x: e[x])
        return best, e[best] / sum(e.values())
