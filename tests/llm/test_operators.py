import base64
import glob
import gzip
import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.orc
import pytest
from pyspark.sql import functions as F

from numerail.llm import audit, bpe, collocations, common, jaccard, langid, mixing, mpeg, orcids, phrases, pieces, sharding, spotsigs, toolcalls, warc

from .helpers import SCHEMA, BruteLanguages, awkward_texts, brute_components, brute_removed, edited, frame, prose

os.environ["TOKENIZERS_PARALLELISM"] = "false"
P = pytest.importorskip("public_tokenizers")
BPE = P.path("byte_bpe_50k.json")
ROWS = awkward_texts()


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def in_duckdb(sql, df):
    c = duckdb.connect()
    frame_ = df.select("doc_id", "text", "source").toPandas()
    c.register("documents", frame_.assign(doc_id=frame_["doc_id"].astype("Int64")))
    return c.sql(sql).df()


# near duplicates
def test_components_equal_brute_force(docs):
    assert rows_of(jaccard.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == Counter(brute_components(ROWS))


def test_components_of_nothing(empty):
    assert jaccard.jaccard_components(empty).count() == 0


def test_components_in_chunks(spark, monkeypatch):
    rows = [(i, edited(prose(77, 120), i, 1 + i % 6)) for i in range(120)] + [(500 + i, prose(500 + i, 60)) for i in range(40)]
    monkeypatch.setattr(jaccard, "CHUNK_BYTES", 20_000)  # many chunks for each group
    assert rows_of(jaccard.jaccard_components(frame(spark, rows)), "doc_id", "n_shingles", "component_id") == Counter(brute_components(rows))


def test_an_id_with_several_texts_is_one_node(spark):
    a, b, c, d = (prose(600 + i, 80) for i in range(4))
    rows = [(3, a), (5, a), (5, b), (9, b), (9, edited(c, 1, 2)), (11, c), (20, d), (21, edited(d, 2, 2)), (21, "few words"), (2, "few words"), (30, None), (30, ""), (31, ""), (5, a)]
    got = rows_of(jaccard.jaccard_components(frame(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == Counter(brute_components(rows))
    assert {c for i, _, c in got if i in (3, 5, 9, 11)} == {3} and {c for i, _, c in got if i in (2, 20, 21)} == {2}


def test_blocks_of_a_group_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_BYTES", 10)
    rows = spark.range(200).selectExpr("1 as g", "id", "'x' as t")
    blocks = jaccard.in_blocks(rows, ["g"], F.length("t"), F.col("id"))
    sizes = [r["count"] for r in blocks.groupBy("bi", "bj").count().collect()]
    assert len(sizes) == 20 * 21 // 2 and max(sizes) <= 60
    # each pair of rows meets in a block
    pairs = blocks.alias("x").join(blocks.alias("y"), ["g", "bi", "bj"]).where("x.id < y.id").select("x.id", "y.id").distinct().count()
    assert pairs == 199 * 100
    assert blocks.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 1


def test_threshold_is_exact(spark):
    a = [f"a{i}" for i in range(104)]  # 100 shingles
    rows = [(1, " ".join(a))] + [(2 + k, " ".join(a[: 104 - k])) for k in range(20, 30)]  # 75 of 100 link, 74 do not
    assert rows_of(jaccard.jaccard_components(frame(spark, rows)), "doc_id", "n_shingles", "component_id") == Counter(brute_components(rows))


def test_bitmaps_bound_the_difference():
    r = random.Random(4)
    for _ in range(200):
        n = r.choice([3, 40, 300])
        both = [r.getrandbits(64) for _ in range(n)]
        a = np.unique(np.array(both + [r.getrandbits(64) for _ in range(r.randrange(n))], dtype=np.uint64))
        b = np.unique(np.array(both + [r.getrandbits(64) for _ in range(r.randrange(n))], dtype=np.uint64))
        x, y = jaccard.bitmap(a), jaccard.bitmap(b)
        size = min(len(x), len(y))
        x, y = (np.frombuffer(jaccard.folded(z, size), dtype=np.uint64) for z in (x, y))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


def test_bands_hold_all_partners():
    for n in range(1, 3000):
        assert jaccard.band(n * 100 // 75) - jaccard.band(n) in (0, 1)


def test_one_of_each_group_stays(docs):
    kept = [r["doc_id"] for r in jaccard.keep_one_of_each(docs).select("doc_id").collect()]
    want = {c for i, _, c in brute_components(ROWS) if i is not None}
    assert sorted(k for k in kept if k is not None) == sorted(want) and kept.count(None) == 2


# graph components
def test_the_row_that_stays_does_not_follow_the_order(spark):
    rows = [(1, f"text number {n} of one id", f"l{n % 3}") for n in range(20)] + [(2, None, "x"), (2, "", "y"), (2, None, "z")]
    kept = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        kept.append(sorted(jaccard.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect(), key=str))
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 2


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_graph_components(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_NODES", broadcast)
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    parent = list(range(401))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x["node"]: x["label"] for x in common.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {n: find(n) for e in edges for n in e if e[0] != e[1]}
    assert common.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_unsettled_components_raise(spark, monkeypatch):
    monkeypatch.setattr(common, "ROUNDS", 1)
    with pytest.raises(RuntimeError):
        common.components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"), "t")


# repeated passages
def test_removed_words_equal_brute_force(docs):
    got = rows_of(phrases.dedup_substrings(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    want = Counter((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute_removed(ROWS))
    assert got == want and sum(k for (_, _, k, _), _ in got.items()) > 0


def test_removed_words_with_small_portions(spark, monkeypatch):
    passage = prose(5, 70)
    rows = [(i, f"{prose(100 + i, 10 + i)} {passage if i % 2 else ' '.join(passage.split(' ')[i % 20:])} {prose(200 + i, 12)}") for i in range(60)]
    monkeypatch.setattr(phrases, "PORTION", 3)
    monkeypatch.setattr(phrases, "FLUSH_ROWS", 20)
    got = rows_of(phrases.dedup_substrings(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == Counter((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute_removed(rows))


def test_a_text_loses_only_what_it_has_itself(spark):
    p, other = prose(700, 60), prose(701, 80)
    rows = [(1, p), (2, p + " " + prose(702, 30)), (2, other), (2, other), (3, prose(703, 5) + " " + other), (2, p + " " + prose(702, 30))]
    got = rows_of(phrases.dedup_substrings(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == Counter((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute_removed(rows))
    assert sorted((i, k) for i, _, k, _ in got.elements()) == [(1, 0), (2, 0), (2, 0), (2, 60), (2, 60), (3, 80)]


def common_passage_rows():
    passage = prose(710, 58)
    rows = [(i, f"{prose(2000 + i, 5 + i % 40)} {passage} {prose(4000 + i, 45 - i % 40)}") for i in range(90)]
    rows += [(200 + i, " ".join(passage.split(" ")[i % 9 :]) + " " + " ".join(prose(5000 + i % 3, 40).split(" "))) for i in range(30)]
    return rows


@pytest.mark.parametrize("remembered", [0, 10**6])
def test_a_phrase_of_many_documents_is_cut_into_windows(spark, monkeypatch, remembered):
    monkeypatch.setattr(phrases, "MANY", 5)
    monkeypatch.setattr(phrases, "REMEMBERED", remembered)
    cut = []
    monkeypatch.setattr(phrases, "stored", lambda df, name, stored=phrases.stored: cut.append(name) or stored(df, name))
    rows = common_passage_rows()
    got = rows_of(phrases.dedup_substrings(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == Counter((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute_removed(rows))
    assert "phrase-cut" in cut


def test_places_come_from_the_automaton(monkeypatch):
    words = prose(720, 60).encode().replace(b" ", b"\n")
    rows = [(i, 0, 0, 11, 5, 12, words) for i in (1, 2)]
    assert phrases._settle(rows) == [(2, 0, 0, 11)]
    monkeypatch.setattr(phrases.PhraseAutomaton, "ends", lambda self, text: np.zeros(0, dtype=np.int64))
    assert phrases._settle(rows) == []


def test_words_are_compared_not_only_hashes(monkeypatch):
    a, b = (prose(i, 60).encode().replace(b" ", b"\n") for i in (721, 722))
    rows = [(1, 0, 0, 11, 5, 12, a), (2, 0, 0, 11, 5, 12, b), (3, 0, 0, 11, 5, 12, b)]
    monkeypatch.setattr(phrases, "rolling", lambda h, n: np.zeros(max(0, len(h) - n + 1), dtype=np.uint64))  # all collide
    monkeypatch.setattr(phrases, "LETTERS", 2)  # and letters too
    assert phrases._settle(rows) == [(3, 0, 0, 11)]
    earlier = phrases.Earlier()
    x, y = a.split(b"\n"), b.split(b"\n")
    kinds = lambda *args: [k for k, _ in earlier.kinds(*args)]
    assert kinds(1, 11, 0, [7, 8], x[:51]) == [phrases.OPEN] * 2
    assert kinds(2, 12, 0, [7, 8], y[:51]) == [phrases.OPEN] * 2 and kinds(3, 13, 0, [7, 8], x[:51]) == [phrases.SETTLED] * 2
    assert earlier.kinds(1, 11, 100, [7, 8], x[:51]) == [(phrases.REPEATED, 0), (phrases.REPEATED, 1)]
    assert kinds(1, 11, 200, [7, 8], y[:51]) == [phrases.OPEN] * 2 and kinds(1, 14, 0, [7, 8], x[:51]) == [phrases.OPEN] * 2


def test_lines_that_a_text_repeats(spark):
    line = prose(730, 17)
    rows = [(i, f"{prose(740 + i, i)} {' '.join([line] * (10 + i))} {prose(760 + i, 5)}") for i in range(6)] + [(10, " ".join([prose(731, 60)] * 3)), (11, prose(731, 60)), (12, " ".join(["a"] * 300)), (13, " ".join(["a"] * 120))]
    stretches = []
    original = phrases.spread
    try:
        phrases.spread = lambda df: stretches.append(df.groupBy("kind").agg(F.sum("first").alias("n")).collect()) or original(df)
        got = rows_of(phrases.dedup_substrings(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    finally:
        phrases.spread = original
    assert got == Counter((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute_removed(rows))
    sums = {r["kind"]: r["n"] for r in stretches[0]}
    assert sums[phrases.REPEATED] > sums[phrases.OPEN] / 2


def test_passages_of_nothing(empty):
    assert phrases.dedup_substrings(empty, ["lang", "source"]).count() == 0


def test_rolling_hashes_tell_runs_apart():
    h = np.array([3, 5, 3, 5, 3, 5, 9, 3, 5] * 30, dtype=np.uint64)
    for n in (20, 50):
        got = phrases.rolling(h, n)
        want = [tuple(h[i : i + n].tolist()) for i in range(len(h) - n + 1)]
        assert len(got) == len(want) and len(set(got.tolist())) == len(set(want))
    place, p = phrases.selected(h)
    assert (p[place] == phrases.least_in_windows(p)).all()


# mixing
def test_mix_equals_sql(docs):
    got = mixing.mix(docs)
    got = Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["size"] * r["repeats"]) for r in got.collect())
    want = in_duckdb(mixing.OP7_SQL, docs)
    assert got == Counter((None if pd.isna(r.doc_id) else int(r.doc_id), int(r.size_), int(r.source_size), round(r.target, 6), int(r.taken)) for r in want.rename(columns={"size": "size_"}).itertuples())


def test_mix_comes_near_its_targets(spark):
    r = random.Random(5)
    rows = [(i, prose(i, r.randrange(1, 60)), "en", f"s{min(i % 7, 3)}", 0, 0, "", 0, 0) for i in range(900)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).toPandas()
    out["taken"] = out["size"] * out["repeats"]
    total = out["size"].sum()
    sums = out.groupby("source").agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(sums["target"].sum() - 1.5 * total) < 1e-6 * total and (sums["target"] <= 2 * sums["size"] + 1e-6).all()
    assert (abs(sums["taken"] - sums["target"]) <= 60).all() and out["repeats"].max() <= 2


def test_mix_keeps_sources_without_words(spark):
    texts = {"a": "one two three", "blank": " ", None: None, "c": ""}
    rows = [(i, list(texts.values())[i % 4], "en", list(texts)[i % 4], 0, 0, "", 0, 0) for i in range(40)]
    for part in (rows, [r for r in rows if r[3] != "a"], [r for r in rows if r[3] == "blank"]):
        df = spark.createDataFrame(part, SCHEMA)
        for keep in (None, ["text"]):
            got = mixing.mix(df, keep=keep).collect()
            assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in part)
            assert all(r["repeats"] == 0 for r in got if r["size"] == 0)
        want = in_duckdb(mixing.OP7_SQL, df)
        assert Counter((r["doc_id"], r["source_size"], r["target"], r["size"] * r["repeats"]) for r in got) == Counter((int(r.doc_id), int(r.source_size), r.target, int(r.taken)) for r in want.itertuples())


def test_mix_takes_no_document_a_third_time(spark):
    rows = [(i, "one two" if i % 3 == 1 else " ", "en", "s", 0, 0, "", 0, 0) for i in range(60)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA), total_share=2.0).collect()
    assert len(out) == 60 and {r["repeats"] for r in out} == {2}


def test_mix_of_nothing(empty):
    assert mixing.mix(empty).count() == 0


# sharding
def test_shards_are_even_and_gapless(spark):
    rows = [(i, prose(i, 1 + i % 90)) for i in range(3000)] + ROWS
    out, versions = sharding.shard_documents(frame(spark, rows))
    out = out.toPandas()
    assert len(out) == len(rows)
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    sums = out.groupby("shard")["size"].sum().sort_values()
    # two slots are larger than a shard should be; the others are even
    assert len(sums) == 16 and sums.iloc[13] <= 1.01 * sums.iloc[0]
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    got = Counter((None if np.isnan(a) else int(a), b, c) for a, b, c in zip(out["doc_id"], out["size"], out["text_crc32"], strict=True))
    assert got == want
    assert versions.groupBy("version").count().count() == 2


def test_shards_equal_a_plain_version(spark):
    """Sizes, checksums, shards and places against plain Python, given only each row's virtual slot."""
    rows = [(i % 700, prose(i, 1 + i * 7 % 90)) for i in range(900)] + [(5, "same")] * 40 + ROWS
    out, versions = sharding.shard_documents(frame(spark, rows), shards=5, slots=64)
    out = out.collect()
    weight = [0] * 64
    for r in out:
        weight[r["vslot"]] += r["size"]
    shard = [s % 5 for s in range(64)]
    limit = sharding.SPREAD * sum(weight) / 5
    while True:
        total = [sum(w for w, x in zip(weight, shard) if x == k) for k in range(5)]
        low = min(range(5), key=lambda k: (total[k], k))
        edit = None
        for high in sorted((k for k in range(5) if total[k] - total[low] > limit), key=lambda k: (-total[k], k)):
            gap = total[high] - total[low]
            ways = [(abs(gap - 2 * weight[s]), s, -1) for s in range(64) if shard[s] == high and 0 < weight[s] < gap]
            if not ways or min(ways)[0] > limit:
                for s in (s for s in range(64) if shard[s] == high):
                    near = sorted((t for t in range(64) if shard[t] == low), key=lambda t: (weight[t], t))
                    above = [t for t in near if (weight[t], t) >= (weight[s] - gap / 2, -1)][:1]
                    below = [t for t in near if (weight[t], t) < (weight[s] - gap / 2, -1)][-1:]
                    if below + above:
                        t = min(below + above, key=lambda t: abs(weight[t] - (weight[s] - gap / 2)))
                        if 0 < weight[s] - weight[t] < gap:
                            ways.append((abs(gap - 2 * (weight[s] - weight[t])), s, t))
            if ways:
                edit = high, min(ways)
                break
        if edit is None:
            break
        _, (_, s, t) = edit
        shard[s] = low
        if t >= 0:
            shard[t] = edit[0]
    order = lambda r: (r["vslot"], r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"])
    for k in range(5):
        mine = sorted((r for r in out if r["shard"] == k), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        assert [order(r) for r in mine] == sorted(order(r) for r in mine)
        assert all(shard[r["vslot"]] == k for r in mine)
    now = {r["vslot"]: r["shard"] for r in versions.where("version = 1").collect()}
    assert [now[s] for s in range(64)] == shard
    same = {r["vslot"] for r in out if r["doc_id"] == 5 and r["size"] == 5}
    assert len(same) > 20 and len({r["vslot"] for r in out if r["doc_id"] == 30}) > 1  # equal rows are spread, and other texts of an id


def test_rows_that_are_alike_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 1000)
    out, _ = sharding.shard_documents(frame(spark, [(7, "one text")] * 8000))
    rows = out.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top")).collect()
    assert len(rows) == 16 and sum(r["n"] for r in rows) == 8000 and all(r["top"] == r["n"] - 1 for r in rows)
    assert max(r["n"] for r in rows) - min(r["n"] for r in rows) <= 2


def test_growing_moves_rows_only_into_the_new_shard():
    before = sharding.rebalanced(sharding.first_map(16), [((i * 7919) % 1000) for i in range(4096)], 16)[0]
    after = sharding.grown(before, 16)
    assert all(a == b or b == 16 for a, b in zip(before, after, strict=True)) and after.count(16) == 4096 // 17


def test_shards_of_nothing(empty):
    assert sharding.shard_documents(empty)[0].count() == 0


# languages
def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.predict(docs, langid.fit(docs), ["doc_id", "text", "lang"]).withColumn("out", langid.held_out(F.col("doc_id"))).where("out and lang is not null")
    good = out.where("lang = lang_pred").count()
    assert good >= 0.98 * out.count() > 0


def language_texts():
    """(doc_id, text, lang): three invented languages, mixtures, words and letters that no other text has."""
    r = random.Random(12)
    letters = {"xa": "abcdeé", "xb": "abcxyzß", "xc": "αβγδabc"}
    rows = []
    for i in range(400):
        lang = r.choice(list(letters))
        words = ["".join(r.choice(letters[lang]) for _ in range(r.randrange(1, 7))) for _ in range(r.randrange(0, 25))]
        rows.append((i, r.choice([" ", ", ", "\n", "-", " 7"]).join(words).title() if i % 3 else " ".join(words), lang if i % 9 else None))
    rows += [(500, None, "xa"), (501, "", "xb"), (502, "12 34 !", "xa"), (503, "漢字 漢字", "xa"), (504, "漢字", None), (505, "QQQ", None), (506, "Ωω", None), (507, "a" * 50_000, "xa"), (508, " ".join(["abc"] * 30_000), "xb"), (None, "abc xyz", "xb"), (1, "abc", "xa")]
    return rows


def test_predictions_equal_brute_force(spark, monkeypatch):
    rows = language_texts()
    learned = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 != 2
    brute = BruteLanguages([(x, t) for i, t, x in rows if x is not None and t is not None and learned(i)])
    df = spark.createDataFrame([(i, t, x, None, 0, -1, "r", 7, 0) for i, t, x in rows], SCHEMA).repartition(3)
    want = sorted((i is not None, i, t or "", *brute.predict(t)) for i, t, x in rows)
    for parts, group in ((langid.PARTS, langid.GROUP_BYTES), (40, 500)):
        monkeypatch.setattr(langid, "PARTS", parts)
        monkeypatch.setattr(langid, "GROUP_BYTES", group)
        monkeypatch.setattr(langid, "SUMMED", group // 50)
        model = langid.fit(df)
        scorer = langid.Scorer(model)
        texts = pa.array([t for _, t, _ in rows], pa.string())
        got = [x for a, b in langid.score_groups(texts, 3) for x in zip(*(y.to_pylist() for y in scorer.predict(texts.slice(a, b - a))), strict=True)]
        assert len(got) == len(rows) and len(scorer.keys) <= max(parts, 40) + 30_000
        for (_, t, _), (lang, score) in zip(rows, got, strict=True):
            name, value = brute.predict(t)
            assert lang == name and abs(score - value) < 1e-9
        out = sorted((r["doc_id"] is not None, r["doc_id"], r["text"] or "", r["lang_pred"], r["score"]) for r in langid.predict(df, model, ["doc_id", "text"]).collect())
        assert [x[:4] for x in out] == [x[:4] for x in want] and all(abs(x[4] - y[4]) < 1e-9 for x, y in zip(out, want, strict=True))


def test_ties_go_to_the_first_language(spark):
    rows = [(i, "same words here", x, None, 0, 0, "", 0, 0) for i in range(40) for x in ("zz", "aa", "mm")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = langid.predict(df, langid.fit(df), ["text"]).collect()
    assert {(r["lang_pred"], round(r["score"], 9)) for r in out} == {("aa", round(1 / 3, 9))}


def test_every_language_is_learned(spark):
    names = [f"l{i:03d}" for i in range(600)]
    word = lambda i: "".join(chr(0x4E00 + 26 * i + j) for j in (3, 7, 11))
    rows = [(i * 10 + j, " ".join([word(i)] * 5), names[i], "s", 0, 0, "", 0, 0) for i in range(600) for j in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(df)
    assert model.languages == sorted({names[i // 10] for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 != 2})
    assert len(model.languages) > 500
    assert langid.predict(df, model, ["text", "lang"]).where("lang <> lang_pred").where(F.col("lang").isin(model.languages)).count() == 0
    # a sample share of each language where they are many
    assert len(langid.fit(df, sample_docs=2, sample_all=10).languages) == len(model.languages)


@pytest.mark.parametrize("doc_id", [0, 3, 4, None])
def test_texts_of_one_id_are_sampled(spark, doc_id):
    """The bound of the sample and all its languages hold whatever the ids are, of long texts and repeated ones too."""
    assert zlib.crc32(str(doc_id or "").encode() if doc_id is not None else b"") % 4 != 2
    rows = [(doc_id, f"aaa{n} bbb", "en") for n in range(2000)] + [(doc_id, "ccc ddd", "de")] * 1000 + [(doc_id, "eee " * 5000 + str(n), "fr") for n in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = Counter((r["lang"], len(r["text"]) > 1000) for r in langid.sample_of(docs, 50, 100_000).collect())
    assert taken == {("en", False): 50, ("de", False): 1, ("fr", True): 5}
    model = langid.fit(docs, 50)
    assert model.languages == ["de", "en", "fr"]


def test_language_of_awkward_texts(docs, empty):
    model = langid.fit(docs)
    out = langid.predict(docs, model, ["doc_id", "text"]).collect()
    assert len(out) == len(ROWS)
    for r in out:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in ("und", "en", "de")
    assert langid.predict(empty, langid.fit(empty), ["doc_id", "text"]).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(empty), ["text"]).collect()} == {"und"}


# fingerprints
PRINTS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "similar_edited", "similar_next", "n_signatures", "length_band"]


def test_fingerprints_equal_sql(spark):
    rows = [(i, t) for n, (i, t) in enumerate(ROWS) if i is not None and i not in (10, 30, 31) or n < 3]
    rows += [(900, "The cat and the dog are in the house of a man."), (901, "the cat and the dog are in the house of a man"), (902, "the cat and the dog are in the house of a woman now")]
    df = frame(spark, rows)
    want = Counter(tuple(r) for r in in_duckdb(spotsigs.OP4_SQL, df)[PRINTS].itertuples(index=False))
    for parts in (1, 7):
        assert rows_of(spotsigs.fingerprints(df, parts), *PRINTS) == want


def plain_print(text):
    """The signatures' hashes in plain Python."""
    flat = "".join(" " if c in spotsigs.MARKS else c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", flat) if w]
    found = set()
    for i, w in enumerate(words):
        chain = [x for x in words[i + 1 :] if x not in spotsigs.COMMON][: spotsigs.CHAIN] if w in spotsigs.COMMON else []
        if len(chain) == spotsigs.CHAIN:
            found.add(" ".join([w, *chain]))
    found = found or {"=" + hashlib.md5((text or "").encode()).hexdigest()}
    return " ".join(sorted({hashlib.md5(x.encode()).hexdigest()[: spotsigs.HASH_LETTERS] for x in found}))


def jaccard_of(a, b):
    x, y = set(a.split(" ")), set(b.split(" "))
    return len(x & y) / len(x | y)


def test_fingerprints_of_awkward_rows(docs, empty):
    """Repeated and null ids too: every row against plain Python, with the next row in the documented order."""
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    want = Counter()
    for n, (i, t) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        a, b, c = map(plain_print, (t, edited, after))
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, jaccard_of(a, b), jaccard_of(a, c), jaccard_of(a, b) >= 0.75, jaccard_of(a, c) >= 0.75] += 1
    assert rows_of(spotsigs.fingerprints(docs), *PRINTS[:9]) == want
    assert spotsigs.fingerprints(empty).count() == 0


def test_similar_pairs_equal_brute_force(spark):
    r = random.Random(15)
    base = [" ".join(r.choice(["the", "of", "a", "w%d" % r.randrange(60)]) for _ in range(r.randrange(4, 60))) for _ in range(25)]
    texts = [t for t in base] + [edited(t, i, 1 + i % 4) for i, t in enumerate(base * 3)] + base[:5] + ["", None]
    prints = [(i, plain_print(t)) for i, t in enumerate(texts)] + [(None, plain_print(base[0])), (None, "ffffffffff"), (400, None)]
    df = spark.createDataFrame(prints, "doc_id long, fingerprint string")
    least = {}
    for i, p in prints:
        if i is not None and p is not None:
            least[p] = min(i, least.get(p, i))
    queries = [(i, p) for i, p in prints if i is not None and i % 3 == 0]
    want = Counter((i, c, jaccard_of(p, q)) for i, p in queries if p is not None for q, c in least.items() if jaccard_of(p, q) >= 0.75)
    got = rows_of(spotsigs.similar_pairs(df, df.where("doc_id % 3 = 0")), "query_id", "class_id", "likeness")
    assert got == want and any(i != c for i, c, _ in want)


def test_sets_in_distant_bands_are_not_compared(spark):
    for n in range(1, 400):
        assert 0 <= math.floor(math.log(-(-n * 4 // 3)) / -math.log(0.75)) - math.floor(math.log(n) / -math.log(0.75)) <= 2
        m = n * 4 // 3  # the longest set that n can be similar to
        assert math.floor(math.log(m) / -math.log(0.75)) - math.floor(math.log(n) / -math.log(0.75)) <= 1
    df = spark.createDataFrame([("a b c", "a b c d"), ("a", "a b"), ("a b c", "x y z")], "a string, b string")
    out = df.select(spotsigs.similar(F.col("a"), F.col("b")).alias("s"), spotsigs.likeness(F.col("a"), F.col("b")).alias("l")).collect()
    assert [(r["s"], r["l"]) for r in out] == [(True, 0.75), (False, 0.5), (False, 0.0)]


# media
@pytest.mark.parametrize("data", [b"", b"a", b"b" * 191, b"c" * 192, b"d" * 193, "é🙂\n".encode() * 999, bytes(range(255)) * 40])
def test_mpeg_round_trip(data):
    payload = mpeg.padded(data)
    assert len(payload) % 192 == 0 and payload and payload[: len(data)] == data
    media = mpeg.encode(payload)
    got = mpeg.probe(media)
    n = len(payload) // 192
    assert got["payload"] == payload and got["bad_checksums"] == got["skipped"] == 0
    assert got["samples"] == 1152 * n and got["vbr"]["frames"] == n == len(got["offsets"])
    assert all(media[o : o + 4] == mpeg.HEADER for o in got["offsets"].tolist())
    assert mpeg.seek(got, 0.0) == got["offsets"][0] and mpeg.seek(got, 1e9) == got["offsets"][-1]


def test_mpeg_resynchronises_and_checks():
    payload = mpeg.padded(b"x" * 5000)
    media = mpeg.encode(payload)
    first = int(mpeg.probe(media)["offsets"][3])
    torn = media[:first] + b"\xff\xfbjunk\xff" + media[first:]
    got = mpeg.probe(torn)
    assert got["payload"] == payload and got["skipped"] == 7
    bad = bytearray(media)
    bad[first + 10] ^= 4  # in the side information
    assert mpeg.probe(bytes(bad))["bad_checksums"] == 1
    assert mpeg.probe(b"")["samples"] == 0 and mpeg.probe(b"\xff" * 50)["samples"] == 0


def walk(media):
    """An independent parser of the streams that are written: frames by a plain walk, their checksums bit by bit."""
    assert media[:3] == b"ID3" and media[3] == 3
    n = media[9] | media[8] << 7 | media[7] << 14 | media[6] << 21
    tag, at = media[10 : 10 + n], 10 + n
    length = tag[11 : 10 + int.from_bytes(tag[4:8], "big")].decode() if tag[:4] == b"TLEN" else None
    frames, bad = [], 0
    while at < len(media):
        head = int.from_bytes(media[at : at + 4], "big")
        assert head >> 21 == 0x7FF and head >> 19 & 3 == 3 and head >> 17 & 3 == 1  # sync, MPEG-1, Layer III
        rate = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320][head >> 12 & 15]
        hz = [44100, 48000, 32000][head >> 10 & 3]
        size = 144000 * rate // hz + (head >> 9 & 1)
        crc = 0xFFFF
        for byte in media[at + 2 : at + 4] + media[at + 6 : at + 6 + 17]:
            for bit in range(7, -1, -1):
                crc = (crc << 1 ^ (0x8005 if (crc >> 15 ^ byte >> bit) & 1 else 0)) & 0xFFFF
        bad += crc != int.from_bytes(media[at + 4 : at + 6], "big")
        frames.append((at, media[at + 23 : at + size]))
        at += size
    assert at == len(media)
    (_, info), *rest = frames
    assert info[:4] == b"Xing" and int.from_bytes(info[4:8], "big") == 7 and int.from_bytes(info[8:12], "big") == len(rest)
    return {"length": length, "offsets": [a for a, _ in rest], "payload": b"".join(x[:192] for _, x in rest), "bad": bad, "hz": hz, "toc": hashlib.md5(info[16:116]).hexdigest()[:8]}


def test_mpeg_media_column(docs, empty):
    pad = lambda t: mpeg.padded((t or "").encode())
    media = mpeg.write_media(docs)
    streams = Counter()
    for r in media.collect():
        w = walk(bytes(r["media"]))
        assert w["bad"] == 0 and w["offsets"] == r["offsets"] and r["samples"] == 1152 * len(w["offsets"]) and r["sample_rate"] == w["hz"] == 32000
        assert r["fields"] == {"TLEN": str(len(w["offsets"]) * 36)} and w["length"] == r["fields"]["TLEN"]
        feature = f"duration={r['samples']}/32000;frames={len(w['offsets'])};first={w['offsets'][0]};last={w['offsets'][-1]};tags=1;length={w['length']};toc={w['toc']};bad=0;skipped=0"
        streams[r["doc_id"], hashlib.sha256(w["payload"]).hexdigest(), len(r["media"]), hashlib.sha256(r["media"]).hexdigest(), feature] += 1
    out = mpeg.read_media(media).collect()
    assert all(r["as_stored"] and r["bad_checksums"] == 0 for r in out)
    assert Counter((r["doc_id"], r["payload_sha256"], r["media_bytes"], r["media_sha256"], r["feature"]) for r in out) == streams
    got = Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out)
    assert got == Counter((i, len((t or "").encode()), len(pad(t)), hashlib.sha256(pad(t)).hexdigest(), zlib.crc32(pad(t)[-16:])) for i, t in ROWS)
    assert mpeg.read_media(mpeg.write_media(empty)).count() == 0


def id3_frame(name, value, size=lambda n: n.to_bytes(4, "big")):
    return name + size(len(value)) + b"\0\0" + value


def test_tags_are_parsed():
    safe = lambda n: bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))
    stream = mpeg.encode(mpeg.padded(b"x" * 1000))
    frames = stream[mpeg.id3v2(stream, 0)[0] :]
    body = id3_frame(b"TIT2", b"\x03" + "Tïtle".encode(), safe) + id3_frame(b"TPE1", b"\x01" + "Änn".encode("utf-16"), safe) + id3_frame(b"APIC", b"\0" * 200, safe)
    extended = safe(6) + b"\x01\x00"
    tag = b"ID3\x04\x00" + bytes([0x50]) + safe(len(extended + body)) + extended + body
    footer = b"3DI\x04\x00" + bytes([0x50]) + safe(len(extended + body))
    old = b"ID3\x02\x00\x00" + safe(11) + b"TT2" + (5).to_bytes(3, "big") + b"\0abcd"
    last = b"TAG" + b"Old title".ljust(30, b"\0") + b"Artist".ljust(30) + b"Album".ljust(30, b"\0") + b"1999" + b"note".ljust(30, b"\0") + b"\x07"
    p = mpeg.probe(tag + footer + old + frames + last)
    assert p["fields"] == {"TIT2": "Tïtle", "TPE1": "Änn", "APIC": "200 bytes", "TT2": "abcd", "title": "Old title", "artist": "Artist", "album": "Album", "year": "1999", "comment": "note", "genre": "7"}
    assert p["tags"] == 3 and p["skipped"] == 0 and p["payload"] == mpeg.padded(b"x" * 1000)
    cut = mpeg.probe((b"ID3\x03\x00\x00" + safe(500) + b"TIT2")[:14])
    assert cut["fields"] == {} and cut["samples"] == 0


def test_variable_bitrate_tables_follow_their_flags():
    frame = bytearray(mpeg.encode(mpeg.padded(b"y"))[-mpeg.FRAME :])

    def with_head(head, at=mpeg.BODY):
        f = bytearray(frame)
        f[at : at + len(head)] = head
        return mpeg.probe(bytes(f))["vbr"]

    n = lambda x: x.to_bytes(4, "big")
    empty = bytes(160)
    assert with_head(b"Xing" + n(1) + n(77) + b"\xee" * 150) == {"kind": "Xing", "flags": 1, "frames": 77, "bytes": None, "toc": None, "quality": None}
    assert with_head(b"Info" + n(10) + n(4321) + n(55) + b"\xee" * 150) == {"kind": "Info", "flags": 10, "frames": None, "bytes": 4321, "toc": None, "quality": 55}
    toc = bytes(range(100))
    assert with_head(b"Xing" + n(5) + n(3) + toc + b"\xee" * 20)["toc"] == toc
    assert with_head(empty) is None
    vbri = b"VBRI" + bytes([0, 1, 0, 0, 0, 9]) + n(900) + n(12) + bytes([0, 2, 0, 1, 0, 2, 0, 6]) + b"\1\2\3\4"
    got = with_head(empty[:120], mpeg.BODY) or with_head(vbri, 36)
    assert got["kind"] == "VBRI" and got["frames"] == 12 and got["bytes"] == 900 and got["toc"] == b"\1\2\3\4" and got["quality"] == 9


# tokens
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def odd_texts(n=3000):
    r = random.Random(3)
    letters = "abcdetheing' \n\t .,!1239éüßçñ漢字🙂  \x1c\x85​ -="
    return ["".join(r.choice(letters) for _ in range(r.randrange(60))) + r.choice(["", "", "<|endoftext|> x", " \n <|endoftext|>"]) for _ in range(n)]


def test_bpe_equals_the_library(library):
    texts = odd_texts() + [t or "" for _, t in ROWS]
    mine = bpe.Bpe(BPE)
    offsets, ids = mine.encode(pa.array(texts))
    for t, got in zip(texts, np.split(ids, offsets[1:-1]), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert got.tolist() == want
        assert mine.decode(got) == library.decode(want, skip_special_tokens=False) == t
        assert mine.decimals(got) == ",".join(map(str, want)).encode()


def test_bpe_automaton_of_a_small_vocabulary():
    merges = [("a", "b"), ("ab", "c"), ("b", "c"), ("a", "a"), ("aa", "b"), ("c", "ab")]
    vocab = {t: i for i, t in enumerate(["a", "b", "c", *dict.fromkeys(x + y for x, y in merges)])}
    machine = bpe.TokenAutomaton({t.encode(): i for t, i in vocab.items()}, [(x.encode(), y.encode()) for x, y in merges])

    def by_merging(word):
        parts = list(word)
        while True:
            ranks = [(merges.index((x, y)), i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if (x, y) in merges]
            if not ranks:
                return [vocab[p] for p in parts]
            _, i = min(ranks)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    r = random.Random(9)
    for _ in range(3000):
        word = "".join(r.choice("abc") for _ in range(r.randrange(1, 12)))
        assert machine.encode_word(word.encode()) == by_merging(word), word


def test_words_are_walked_once_over_a_bounded_table(monkeypatch, library):
    machine = bpe.Bpe(BPE).automaton
    monkeypatch.setattr(bpe, "STATES", 200)
    r = random.Random(6)
    moved = []
    monkeypatch.setattr(machine, "_move", lambda s, c, move=machine._move: moved.append(1) or move(s, c))
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(14)) for _ in range(400)]
    for w in words:
        before = len(moved)
        assert machine.encode_word(b" " + w.encode()) == library.encode(" " + w, add_special_tokens=False).ids
        assert len(moved) - before <= 15 and len(machine.last) <= 200 + 16  # a byte adds one move at most: nothing is tried twice
    del moved[:]
    machine.encode_word(b" " + words[-1].encode())
    assert not moved  # all by the table


def test_parts_give_back_the_text():
    cut = pieces.Cutter(["<|endoftext|>"])
    texts = odd_texts()
    odd = cut.odd(pa.array(texts))
    for t, parts in zip([t for t, o in zip(texts, odd, strict=True) if not o], cut.plain(pa.array(texts).filter(pa.array(~odd))).to_pylist(), strict=True):
        assert "".join(map(pieces.literal, parts)) == t
    for t in texts:
        assert "".join(map(pieces.literal, cut(t))) == t


@pytest.mark.parametrize("limit", [20, 10**6])
def test_part_table_forgets_without_effect(library, monkeypatch, limit):
    monkeypatch.setattr(orcids, "CACHE_LIMIT", limit)
    monkeypatch.setattr(pieces, "HOT", 8)
    encoder = orcids.ChunkEncoder(BPE)
    texts = odd_texts(600) + ["word, word. word one, two three! one " * 3] * 5
    for at in range(0, len(texts), 40):
        some = texts[at : at + 40]
        offsets, ids = encoder.encode(pa.array(some))
        for t, got in zip(some, np.split(ids, offsets[1:-1]), strict=True):
            assert got.tolist() == library.encode(t, add_special_tokens=False).ids


def test_bpe_query_columns(docs, empty, library):
    out = bpe.decode_ids(bpe.encode_texts(docs, BPE), BPE).collect()
    want = Counter((i, hashlib.sha256(",".join(map(str, library.encode(t or "", add_special_tokens=False).ids)).encode()).hexdigest(), t or "") for i, t in ROWS)
    assert Counter((r["doc_id"], r["ids_sha256"], r["decoded"]) for r in out) == want
    assert bpe.encode_and_check(docs, BPE).count() == len(ROWS) and bpe.encode_texts(empty, BPE).count() == 0


def test_orc_ids_equal_the_library(spark, docs, empty, library, tmp_path):
    path = orcids.write_ids(docs, BPE, str(tmp_path / "ids"))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in orcids.id_index(orcids.read_ids(spark, path)).collect())
    crc = lambda t: zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4").tobytes())
    assert Counter((g[1], g[3]) for g in got) == Counter((i, crc(t)) for i, t in ROWS)
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    ids = [g[1] for g in got]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert orcids.lookup(spark, path, 23).first()["ids"] == library.encode("one two", add_special_tokens=False).ids + [0]
    nothing = orcids.write_ids(empty, BPE, str(tmp_path / "nothing"))
    assert orcids.id_index(orcids.read_ids(spark, nothing)).count() == 0


def orc_files(path):
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".orc"))


def orc_footer(spark, path):
    """Kinds of the streams and encodings of the columns of a file's first stripe."""
    orc = spark._jvm.org.apache.orc.OrcFile
    reader = orc.createReader(spark._jvm.org.apache.hadoop.fs.Path(path), orc.readerOptions(spark._jsc.hadoopConfiguration()))
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
    return ({str(footer.getStreams(i).getKind()) for i in range(footer.getStreamsCount())}, [str(footer.getColumns(i).getKind()) for i in range(footer.getColumnsCount())])


def scanned(df):
    """Rows that the scan of a query made."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_starts_are_places_in_the_files(spark, library, tmp_path, monkeypatch):
    """Rows of one id with different texts too; ``start`` finds their ids in the files, end to end."""
    monkeypatch.setattr(orcids, "BLOCK", 4)
    texts = ["one", "one two three four five", "", "six seven"]
    rows = [(7, texts[i % 4]) for i in range(40)] + [(i, prose(i, i % 9)) for i in range(30)] + [(None, "x y z")] * 3
    path = orcids.write_ids(frame(spark, rows), BPE, str(tmp_path / "ids"))
    tables = [pa.orc.read_table(f) for f in orc_files(path)]
    lists = [x for t in sorted((t for t in tables if t.num_rows), key=lambda t: t.column("part")[0].as_py()) for x in t.column("ids").to_pylist()]
    flat = np.array([i for x in lists for i in x], dtype="<u4")
    found = orcids.id_index(orcids.read_ids(spark, path)).collect()
    assert len(found) == len(rows) and sum(r["n_tokens"] for r in found) == len(flat)
    for r in found:
        assert zlib.crc32(flat[r["start"] : r["start"] + r["n_tokens"]].tobytes()) == r["ids_crc32"]
    crc = lambda t: zlib.crc32(np.array(library.encode(t, add_special_tokens=False).ids + [0], dtype="<u4").tobytes())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in found) == Counter((i, crc(t)) for i, t in rows)


def test_orc_files_are_run_length_coded_with_filters(spark, tmp_path):
    rows = [(i * 3, "a a a a a a a a " * 20) for i in range(5000)]
    path = orcids.write_ids(frame(spark, rows), BPE, str(tmp_path / "ids"))
    sizes, kept = 0, 0
    for name in orc_files(path):
        f = pa.orc.ORCFile(name)
        assert f.compression.upper() == "LZ4" and f.row_index_stride == 1000
        sizes, kept = sizes + os.path.getsize(name), kept + f.nrows
        if f.nrows:
            streams, encodings = orc_footer(spark, name)
            assert "ROW_INDEX" in streams and any(x.startswith("BLOOM_FILTER") for x in streams)
            assert encodings.count("DIRECT_V2") == 5  # part, place, doc_id, lengths and ids: integer run-length coding, version 2
    tokens = orcids.id_index(orcids.read_ids(spark, path)).agg(F.sum("n_tokens")).first()[0]
    assert kept == len(rows) and sizes < tokens // 4  # runs: far under a byte for an id
    plan = orcids.lookup(spark, path, 23)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,23)]" in plan
    # statistics leave one row group of a thousand rows; an id between their bounds that no row has is left out by the filters
    assert 0 < scanned(orcids.lookup(spark, path, 2400 * 3)) <= 1000
    assert sum(scanned(orcids.lookup(spark, path, 3 * i + 1)) > 0 for i in range(1000, 1020)) <= 3


# chat
def chat(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, call_id string, kind int, json string")


def test_tool_calls_equal_sql(spark):
    r = random.Random(2)
    rows = []
    for c in range(40):
        for t in range(r.randrange(1, 19)):
            text = r.choice(["hello", 'say "x" \\ y\n\tz\x01', "", "  ", None, "é🙂", "z" * 2001])
            rows.append((c, t, "system" if t == 0 and c % 3 == 0 else "user" if r.random() < 0.1 else ["user", "assistant"][t % 2], text, "clash", 1, "j"))
    df = chat(spark, rows)
    names = ["conv_id", "turn", "kind", "call_id", "linked", "valid", "order_turn", "order_level", "order_kind", "json"]
    c = duckdb.connect()
    c.register("conversations", df.select("conv_id", "turn", "role", "text").toPandas())
    want = c.sql(toolcalls.OP10_SQL).df()
    key = lambda v: None if v is None or v != v else v
    got = rows_of(toolcalls.link_conversations(df), *names)
    assert got == Counter(tuple(key(x) for x in row) for row in want[names].itertuples(index=False))
    assert max(row[7] for row in got) >= 10


CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after string, order_turn int"
RESULTS = "conv_id long, turn long, call_id string, content string, kind int, first int"


def linked(spark, calls, results, **more):
    calls = spark.createDataFrame([(*c, *[None] * (6 - len(c)), 9) for c in calls], CALLS)
    results = spark.createDataFrame([(*r, 7, 8) for r in results], RESULTS)
    return {(r["kind"], r["turn"], r["call_id"]): r for r in toolcalls.link(calls, results, **more).collect()}


def test_results_follow_their_calls_and_orphans_stay(spark):
    calls = [(1, 5, "a", "reply", '{"prompt":"hi"}'), (1, 6, "a", "reply", '{"prompt":"other"}'), (1, 7, None, "nope", "not json"), (1, 8, "c", "reply", '{"prompt":7}'), (None, 9, "a", "reply", None)]
    results = [(1, 2, "a", "early"), (1, 9, "zz", "orphan"), (1, 9, None, "no id"), (1, 10, "a", None)]
    out = linked(spark, calls, results)
    assert len(out) == len(calls) + len(results)
    assert out[2, 2, "a"]["order_turn"] == 5 and out[2, 2, "a"]["linked"]
    assert out[1, 5, "a"]["linked"] and not out[1, 6, "a"]["linked"]
    assert not out[2, 9, "zz"]["linked"] and not out[2, 9, None]["linked"] and not out[1, 7, None]["linked"]
    assert not out[1, 7, None]["valid"] and not out[1, 8, "c"]["valid"] and not out[1, 9, "a"]["linked"]
    assert out[1, 5, "a"]["json"] == '{"arguments":{"prompt":"hi"},"id":"a","name":"reply","type":"call","violations":[]}'
    assert out[1, 7, None]["json"] == '{"arguments":"not json","id":null,"name":"nope","type":"call","violations":["unknown_tool","not_json"]}'
    assert out[2, 10, "a"]["json"] == '{"content":null,"id":"a","type":"result"}'
    assert toolcalls.link_conversations(chat(spark, [])).count() == 0
    assert linked(spark, [], []) == {} and len(linked(spark, [], results)) == 4 and len(linked(spark, calls, [])) == 5


def test_json_is_canonical_and_keeps_types(spark):
    calls = [
        (1, 1, "a", "reply", ' {"prompt" : "hi", "o": {"b":1, "a":[2, 1, {"z":null,"y":true}]}, "n":7} '),
        (1, 2, "b", "reply", '{"prompt":"1","prompt":"2"}'),
        (1, 3, "c", "reply", '{"prompt":"x","deep":{"k":1,"k":2}}'),
        (1, 4, "d", "reply", "[1]"),
        (1, 5, "e", "search", '{"limit":3,"query":"q","sites":["s"]}'),
        (1, 6, "f", "search", '{"limit":"3","query":"","sites":{}}'),
        (1, 7, "g", "search", '{"query":"' + "q" * 401 + '","more":1}'),
        (1, 8, "h", "reply", '{"prompt":null}'),
        (1, 9, "i", "reply", '{"prompt":"' + "long " * 60_000 + '"}'),
        (1, 10, "j", "reply", None),
    ]
    out = {k[2]: r["json"] for k, r in linked(spark, calls, []).items()}
    assert '"arguments":{"n":7,"o":{"a":[2,1,{"y":true,"z":null}],"b":1},"prompt":"hi"},' in out["a"]
    bad = {k: v.split('"violations":')[1] for k, v in out.items()}
    assert bad == {
        "a": '["unexpected:n,o"]}', "b": '["not_json"]}', "c": '["not_json"]}', "d": '["not_object"]}', "e": "[]}", "f": '["empty:query","type:limit","type:sites"]}',
        "g": '["long:query","unexpected:more"]}', "h": '["type:prompt"]}', "i": '["long:prompt"]}', "j": '["not_json"]}',
    }
    odd = linked(spark, [(1, 1, "a", "t", '{"x":1}')], [], schemas={"t": {"x": ("BIGINT", True, None)}})
    assert odd[1, 1, "a"]["valid"]
    assert not linked(spark, [(1, 1, "a", "t", '{"x":1}')], [], schemas={})[1, 1, "a"]["valid"]


def test_what_follows_a_value_makes_it_no_json(spark):
    good = ['{"query":"a"}', ' {"query":"a"}\n', "[1, 2]", '"x"', "1", "null", "[]"]
    bad = ['{"query":"a"} and more', "1] x", "1} x", "{} {}", "1, 2", '1, "x": 2', '{"query":"a"', '"a', "", " ", '{"a":1}}', "[1]]", '{"query":"a"}//']
    df = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", toolcalls.canonical(F.col("t")).alias("c"), toolcalls.violations(F.lit("search"), F.col("t")).alias("v"))
    got = {r["t"]: (r["c"], r["v"]) for r in df.collect()}
    assert all(got[t][0] is not None and "not_json" not in got[t][1] for t in good)
    assert all(got[t] == (None, ["not_json"]) for t in bad)
    assert got['{"query":"a"}'] == ('{"query":"a"}', [])


def test_chains_come_in_topological_order(spark):
    r = random.Random(8)
    n, calls, results = 60, [], []
    after = {i: None if i == 0 or r.random() < 0.1 else r.randrange(max(0, i - 3), i) for i in range(n)}
    turn = {i: r.randrange(100) for i in range(n)}  # turns tell nothing of the order
    calls = [(1, turn[i], f"c{i}", "reply", '{"prompt":"p"}', None if after[i] is None else f"c{after[i]}") for i in range(n)]
    results = [(1, r.randrange(100), f"c{i}", "ok") for i in range(n) if i % 7] + [(1, r.randrange(100), "c1", "again")]
    calls += [(2, i, f"x{i}", "reply", '{"prompt":"p"}', f"x{(i + 1) % 5}") for i in range(5)] + [(2, 9, "y", "reply", '{"prompt":"p"}', "x0"), (2, 10, "z", "reply", '{"prompt":"p"}', "nowhere")]
    results += [(2, 20 + i, f"x{i}", "ok") for i in range(5)]
    out = linked(spark, calls, results)
    place = lambda m: (m["order_turn"], m["order_level"], m["order_kind"])
    call = {k[2]: m for k, m in out.items() if k[0] == 1}
    answers = {}
    for k, m in out.items():
        if k[0] == 2:
            answers.setdefault(k[2], []).append(m)
            assert place(m) > place(call[k[2]])
    for i in range(n):
        of = f"c{after[i]}"
        for m in answers.get(of, []):
            assert place(call[f"c{i}"]) > place(m)
        depth = 0 if of not in answers else call[of]["order_level"] // 2 + 1
        assert call[f"c{i}"]["order_level"] == 2 * depth
    assert all('"violations":["cycle"]' in call[f"x{i}"]["json"] and not call[f"x{i}"]["valid"] for i in range(5))
    assert call["z"]["order_level"] == 0 and call["z"]["valid"]


def test_links_are_hash_joins(spark):
    plan = toolcalls.link_conversations(chat(spark, [(1, 0, "user", "a", "c", 1, "j"), (1, 1, "assistant", "b", "c", 1, "j")]).repartition(3))
    plan.collect()
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in shown and "HashJoin" in shown


def test_counts_do_not_depend_on_the_runs_of_texts(monkeypatch):
    rows = [("en", "the cat and the hat"), ("de", "die Katze und der Hut"), ("en", ""), ("de", "der der " * 50), ("en", "the cat and the hat")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string()) for c in range(2)], ["lang", "text"])

    def sums(batch):
        out: dict[tuple, int] = {}
        for part in langid._count(iter([batch])):
            for r in part.to_pylist():
                out[r["lang"], r["n"], r["gram"]] = out.get((r["lang"], r["n"], r["gram"]), 0) + r["k"]
        return out

    whole = sums(batch)
    assert whole["de", 0, "der"] == 101 and whole["en", 0, "the"] == 4
    monkeypatch.setattr(langid, "COUNTED", 1)
    assert sums(batch) == whole
    assert sums(batch.slice(0, 0)) == {} and sums(batch.slice(2, 1)) == {}


def _audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n long, part string, mask int, th string")
    return audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, part string"))


def test_audit_equals_brute_force(spark, empty):
    long = prose(1, 260)
    texts = [t for _, t in ROWS][:24] + [long, long, long.upper(), long + " $", "a a a a " * 80, "A#", "A#", None, ""]
    rows = [(None if n % 11 == 3 else n % 29, t, [None, "", "en", "de"][n % 4], n, "p", 3, "t") for n, t in enumerate(texts)]
    rows += rows[5:8]
    labels = [(1, 1, 0, "x"), (1, 0, 1, "x"), (2, 1, 1, "x"), (3, 0, None, "x"), (None, 1, 1, "x"), (999, 1, 1, "x"), (4, None, 1, "x"), (8, 1, 0, "x"), (8, 1, 0, "x")]
    word = re.compile(r"[^\x20\x09-\x0D]+")
    seen = []
    for i, t, lang, *_ in rows:
        t, w = t or "", word.findall(t or "")
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in t for c in "#$%&*|")}
        fails["E"] = any(i is not None and j is not None and j < i and (u or "") == t for j, u, *_ in rows)
        mine = [x for x in labels if i is not None and x[0] == i]
        seen.append((lang or "", {k for k, v in fails.items() if v}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    want = set()
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    for part in {p for p, *_ in seen}:
        mine = [x for x in seen if x[0] == part]
        first = {o: Counter(next((c for c in o if c in f), "") for _, f, _, _ in mine) for o in orders}
        for o in orders:
            for k, x in enumerate(o):
                gone = lambda f, k=k, o=o: any(c in f for c in o[:k])
                here = [(g, b) for _, f, g, b in mine if x in f and not gone(f)]
                kept = sum(not any(c in f for c in o[: k + 1]) for _, f, _, _ in mine)
                again = sum(x in f and gone(f) for _, f, _, _ in mine)
                want.add((part, o, k + 1, kept, len(here), again, sum(f == {x} for _, f, _, _ in mine), sum(g for g, _ in here), sum(b for _, b in here), sum(first[q][x] for q in orders)))
    got = _audited(spark, rows, labels)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert audit.audit(empty, empty.selectExpr("doc_id", "bucket AS quality", "bucket AS toxic")).count() == 0


def test_parity_sums_invert_exactly(spark):
    r = random.Random(4)
    cells = [r.randrange(10**12) for _ in range(32)]
    rows = spark.createDataFrame([("p", m, n, bool(m % 2), False) for m, n in enumerate(cells)], "part string, mask int, n long, good boolean, toxic boolean")
    sums = audit.parity_sums(rows, 5)
    back = sums.select(audit.inverse(F.col("w_all"), 5).alias("a"), audit.inverse(F.col("w_good"), 5).alias("g"), audit.inverse(F.col("w_toxic"), 5).alias("t")).first()
    assert back["a"] == cells and back["g"] == [n * (m % 2) for m, n in enumerate(cells)] and back["t"] == [0] * 32


def _pages():
    r = random.Random(7)
    big = "<p>" + "".join(r.choice("abc déf漢<>\r\n ") for _ in range(70_000)) + "WARC/1.1\r\nWARC-Type: response\r\n\r\n</p>"
    html = ["<b>x</b>", None, "", "<b>x</b>", big, big + " ", "0\r\n\r\n", "<b>x</b>", big, "ß\x00🙂", None, "<i>y</i>"]
    urls = ["http://a/1", None, "http://a/x y\r\nWARC-Type: warcinfo", "http://a/ß"]
    rows = [(n * 3 % 25, urls[n % 4], t, "r", "sha") for n, t in enumerate(html)]
    rows += [rows[0], rows[0], rows[4], (None, None, "<b>x</b>", "q", "sha"), (None, "u", "alone", "q", "sha"), (3, "other", "<b>x</b>", "q", "sha"), (9, "u", rows[3][2], "q", "sha")]
    return rows


PAGES = "page_id long, url string, html string, record_id string, sha1 string"


def _warc_want(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) by plain Python."""
    best, want = {}, []
    for i, u, t, *_ in rows:
        key = (i is not None, i or 0, u is not None, u or "")
        best[t or ""] = max(best.get(t or "", key), key)
    used = set()
    for i, u, t, *_ in sorted(rows, key=str):
        b = (t or "").encode()
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        top = best[t or ""] == (i is not None, i or 0, u is not None, u or "") and (t or "") not in used
        if top or len(b) < least:
            used.add(t or "")
            want.append((i, len(b), digest, "response", None))
        else:
            want.append((i, len(b), digest, "revisit", best[t or ""][1] if best[t or ""][0] else None))
    return Counter(want)


@pytest.mark.parametrize("least, segment, compression", [(0, 1 << 14, "gzip"), (5, 1000, "none"), (10**6, 1 << 20, "gzip")])
def test_warc_round_trip(spark, tmp_path, least, segment, compression):
    rows = _pages()
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, least=least, segment=segment, file_bytes=100_000, compression=compression)
    got = warc.read_archives(spark, path)
    assert rows_of(got, "page_id", "payload_bytes", "payload_digest", "type", "refers_to") == _warc_want(rows, least)
    assert not got.where("problem is not null").count()
    texts = {r["page_id"]: bytes(r["payload"]).decode() for r in got.where("type = 'response'").collect()}
    assert all(t in {r[2] or "" for r in rows if r[0] == i} for i, t in texts.items())
    blocks = [b for f in glob.glob(path + "/part-*") for b in _plain_records(f)]
    assert all(len(b) <= segment for _, b in blocks) and len({h["warc-record-id"] for h, _ in blocks}) == len(blocks)
    kinds = Counter(h["warc-type"] for h, _ in blocks)
    assert kinds["response"] + kinds["revisit"] == len(rows) and (kinds["continuation"] > 0) == (segment < 10**5)
    if segment == 1000:  # segments of one record lie in several files
        homes = {}
        for f in glob.glob(path + "/part-*"):
            for h, _ in _plain_records(f):
                homes.setdefault(h.get("warc-segment-origin-id"), set()).add(f)
        assert max(len(v) for k, v in homes.items() if k) > 1


def _plain_records(path):
    """Records of a file by a reader of its own."""
    data, at, out = open(path, "rb").read(), 0, []
    data = gzip.decompress(data) if path.endswith(".gz") else data
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        start = at + len(head) + 4
        end = start + int(fields["content-length"])
        assert data[end : end + 4] == b"\r\n\r\n"
        out.append((fields, data[start:end]))
        at = end + 4
    return out


def _warc_files(spark, tmp_path, name, records):
    (tmp_path / name).mkdir()
    for n, data in enumerate(records):
        (tmp_path / name / f"{n}.warc").write_bytes(data)
    return {r["record_id"]: r for r in warc.read_archives(spark, str(tmp_path / name)).collect()}


def test_damaged_and_foreign_archives(spark, tmp_path):
    rec = lambda block, **f: warc.record([(k.replace("_", "-"), v) for k, v in f.items()], block) + b"\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nX: y\r\nTransfer-Encoding: chunked\r\n\r\n"
    body = b"5;ext=1\r\nhello\r\n1\r\n \r\nA\r\n0123456789\r\n0\r\nTrailer: t\r\n\r\n"
    seg = lambda k, part, last=None, **f: rec(part, WARC_Type="response" if k == 1 else "continuation", WARC_Record_ID="s" if k == 1 else f"s{k}", WARC_Segment_Number=k, WARC_Segment_Origin_ID=None if k == 1 else "s", WARC_Segment_Total_Length=last, **f)
    whole = http + body
    cuts = [whole[:20], whole[20:70], whole[70:]]
    parts = [seg(1, cuts[0]), seg(2, cuts[1]), seg(3, cuts[2], len(whole))]
    good = rec(whole, WARC_Type="response", WARC_Record_ID="g", WARC_Payload_Digest="sha1:" + warc.base32_digest(b"hello 0123456789"))
    info = rec(b"software: x", WARC_Type="warcinfo", WARC_Record_ID="i")
    plain = rec(b"HTTP/1.0 200 OK\r\nContent-Length: 3\r\n\r\nabcdef", WARC_Type="response", WARC_Record_ID="p")
    visit = rec(http, WARC_Type="revisit", WARC_Record_ID="v", WARC_Refers_To="g", WARC_Payload_Digest="sha1:" + warc.base32_digest(b"hello 0123456789"))
    lost = rec(http, WARC_Type="revisit", WARC_Record_ID="l", WARC_Refers_To="nowhere")
    got = _warc_files(spark, tmp_path, "a", [parts[2] + info + parts[0], gzip.compress(good) + gzip.compress(parts[1]), plain + visit + lost + parts[1]])
    assert sorted(got) == ["g", "l", "p", "s", "v"]
    assert [bytes(got[k]["payload"]) for k in "gsp"] == [b"hello 0123456789"] * 2 + [b"abc"]
    assert got["v"]["payload_bytes"] == 16 and got["l"]["problem"] == "no original" and not got["s"]["problem"]
    # damage: a lost segment, a wrong total, no last segment, a broken chunk, a digest, a length that runs over its record
    for name, files, problem in [
        ("b", [parts[0] + parts[2]], "missing segment"), ("c", parts[:2] + [seg(3, cuts[2], 7)], "total length"), ("d", parts[:2], "no last segment"),
        ("e", [seg(1, http), seg(2, b"zz\r\n", len(http) + 4)], "chunk size"), ("f", [parts[0], parts[1], seg(3, cuts[2] + b"x", len(whole), WARC_Block_Digest="sha1:AAAA")], "block digest"),
    ]:
        got = _warc_files(spark, tmp_path, name, files)
        assert got["s"]["problem"] == problem and got["s"]["payload"] is None, name
    broken = good.replace(b"hello", b"hallo") + plain.replace(b"Content-Length: 43", b"Content-Length: 9") + visit
    got = _warc_files(spark, tmp_path, "h", [b"junk\r\n" + broken])
    assert got["g"]["problem"] == "payload digest" and got["v"]["problem"] == "no original"


def test_warc_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.read_archives(spark, path).count() == 0


def brute_collocations(rows, floor, most):
    """Rows of (lang, text) by the definition."""
    occurrences, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        t = (text or "").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
        for piece in re.split("[.,;:!?\x0a-\x0d]", t):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f = occurrences.setdefault(lang, Counter())
                    f[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in occurrences.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= floor}
        scored = []
        for p, a in candidates.items():
            longer = [q for q in candidates if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * candidates[q] >= 80 * a for q in longer):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            phrase = " ".join(p)
            scored.append((-score, -a, phrase.encode(), phrase, f[p[:k]], f[p[k:]]))
        for rank, (s, a, _, phrase, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, phrase, -a, left, right, n[lang], -s))
    return Counter(out)


COLLOCATION = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("shard_words, window, floor, most", [(1 << 21, 4 << 20, 3, 25), (40, 16, 3, 10**6), (300, 1 << 20, 1, 200)])
def test_collocations_equal_brute_force(spark, monkeypatch, shard_words, window, floor, most):
    r = random.Random(11)
    zipf = lambda n, v: " ".join("w%d" % int(v ** r.random()) for _ in range(n))
    texts = [t for _, t in ROWS if t is None or len(t) < 5000]
    texts += [zipf(200, 30).replace("w3", "w3,").replace("w7 ", "W7\t").replace("w9 ", "w9\n") for _ in range(20)]
    texts += ["Red Green BLUE violet. " * 7, "red green blue! red green", "a\x00b é\u00a0x É\u00a0x\x1c é\u00a0x\x85y " * 5, "x" * 3000, "...", zipf(3000, 12), "one two three " * 40]
    rows = [(n, t, [None, "en", "und", "fr"][n % 4], "p", 1) for n, t in enumerate(texts)] + [(1, texts[-1], "en", "p", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string, f int").repartition(3)
    got = collocations.collocations(docs, floor, most=most, shard_words=shard_words, window=window)
    assert rows_of(got, *COLLOCATION) == brute_collocations([(x[2], x[1]) for x in rows], floor, most)


def test_sums_merge_what_they_hold(monkeypatch):
    monkeypatch.setattr(collocations, "PENDING", 5)
    r = random.Random(2)
    want, s = Counter(), collocations.Sum(2)
    for _ in range(30):
        rows = [(r.randrange(3), r.randrange(4), r.randrange(1, 9)) for _ in range(4)]
        columns = [np.array(c, dtype=np.uint64) for c in zip(*(x[:2] for x in rows), strict=True)]
        s.add(b"".join(c.tobytes() for c in columns) + np.array([x[2] for x in rows], dtype=np.uint32).tobytes(), 4)
        for a, b, n in rows:
            want[a, b] += n
    s.merge()
    assert {(int(a), int(b)): int(n) for a, b, n in zip(*[c[0] for c in s.columns], s.counts[0], strict=True)} == want


def test_collocations_of_nothing(docs, empty):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(docs.where("text is null or text in ('', '.')")).count() == 0


def test_sums_of_packed_words(spark):
    pack = lambda words, counts: np.array(counts, dtype=np.uint32).tobytes() + b" ".join(words)
    english = [pack([b"aa", b"bb", b"cc"], [5, 1, 9]), pack([b"aa", b"dd", b"cc"], [6, 2, 1])]
    french = [pack([b"aa"], [4])]
    rows = [(k, [1] * len(d), [lang] * len(d), n, [len(x) for x in d], [collocations._zipped(x) for x in d]) for k, (lang, n, d) in enumerate((("en", [3, 3], english), ("fr", [1], french)))]
    packed = spark.createDataFrame(rows, collocations.PACKED)
    got = collocations.summed(packed, 2, 3, 0)
    assert {(r["lang"], bytes(r["word"]), r["f"]) for r in got.where("depth = 1").collect()} == {("en", b"aa", 11), ("en", b"cc", 10), ("fr", b"aa", 4)}
    assert rows_of(got.where("depth = 0"), "lang", "f") == Counter([("en", 24), ("fr", 4)])
    assert not got.where("depth = -1").count()


def test_automaton_states_and_suffix_links():
    words = collocations.words_of(b"A b a b c. a b a b c, a b a b")
    shard = collocations.Shard()
    shard.add(words)
    automaton, names = shard.automaton()
    levels = [automaton.at.copy()]
    for _ in range(3):
        automaton.grow()
        levels.append(automaton.at.copy())
    for depth in range(4):
        columns, count = automaton.spelled[depth], automaton.counts[depth]
        got = {tuple(names[c[s]] for c in columns): int(count[s]) for s in range(len(count)) if count[s]}
        want = Counter(tuple(words[i : i + depth + 1]) for i in range(len(words) - depth) if b"." not in words[i : i + depth + 1])
        assert got == want
        if depth:
            for e in np.flatnonzero(levels[depth] >= 0):  # the suffix link of a state has all its end positions
                assert automaton.counts[depth - 1][levels[depth - 1][e]] >= count[levels[depth][e]]


def test_windows_cut_no_word():
    text = b"ab cd,ef\tgh" + b"x" * 50 + b" yz."
    for size in (1, 3, 20, 100):
        parts = list(collocations.windows(text, size))
        assert b"".join(parts) == text and [w for p in parts for w in collocations.words_of(p)] == collocations.words_of(text)


def test_filter_of_pairs_passes_all_pairs(spark):
    r = random.Random(5)
    pairs = [(r.randrange(-(2**63), 2**63), r.randrange(-(2**63), 2**63)) for _ in range(3000)]
    bits = collocations.pair_filter(spark.createDataFrame(pairs, "h1 long, h2 long").repartition(3))
    test = collocations.passing(np.frombuffer(bits, dtype=np.uint8))
    hashed = lambda p: collocations.combined([np.array(c, dtype=np.int64).view(np.uint64) for c in zip(*p, strict=True)])
    assert test(hashed(pairs)).all()
    other = [(r.randrange(2**62), r.randrange(2**62)) for _ in range(20000)]
    assert test(hashed(other)).mean() < 0.05


def test_words_that_share_a_hash_take_another_seed(spark, monkeypatch):
    """Counts under a seed that gives a frequent word the hash of another are not used."""
    docs = spark.createDataFrame([("en", "aa bb cc " * 4), ("en", "aa bb")], "lang string, text string")
    plain, seeds = collocations.summed, []

    def clashing(packed, partitions, floor, seed):
        seeds.append(seed)
        out = plain(packed, partitions, floor, seed)
        shared = spark.createDataFrame([(-1, None, 7, None, None, None, None, 0)], collocations.COUNTED)
        return out.unionByName(shared) if seed == 0 else out

    monkeypatch.setattr(collocations, "summed", clashing)
    got = collocations.collocations(docs, 2)
    assert rows_of(got, *COLLOCATION) == brute_collocations([("en", "aa bb cc " * 4), ("en", "aa bb")], 2, 2000)
    assert seeds == [0, 1, 1]
    monkeypatch.setattr(collocations, "SEEDS", 1)
    with pytest.raises(RuntimeError, match="share hashes"):
        collocations.collocations(docs, 2)


def test_ids_are_made_and_read_in_small_groups(spark, tmp_path):
    texts = pa.array(["a word " * 150_000] * 12)  # 12.6 MB in one batch
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 12, pa.int32()), pa.array(range(12)), texts], ["part", "doc_id", "text"])
    out = list(orcids._encode(BPE)(iter([batch])))
    assert [d for b in out for d in b.column("doc_id").to_pylist()] == [p for b in out for p in b.column("place").to_pylist()] == list(range(12))
    assert max(b.num_rows for b in out) <= 3
    spark.conf.unset("spark.sql.orc.columnarReaderBatchSize")
    docs = spark.createDataFrame([(i, "some words " * 400) for i in range(1000)], "doc_id long, text string")
    ids = orcids.read_ids(spark, orcids.write_ids(docs, BPE, str(tmp_path / "ids")))
    assert int(spark.conf.get("spark.sql.orc.columnarReaderBatchSize")) <= 256
    assert orcids.id_index(ids).count() == 1000
