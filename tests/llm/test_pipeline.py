import hashlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from numerail.llm import common, langid

from .helpers import awkward_texts, brute_components, brute_removed, frame

pytest.importorskip("public_tokenizers")


def test_stages_agree_with_brute_force(spark):
    rows = [(i, t) for i, t in awkward_texts() if i is not None]
    docs = frame(spark, rows).select(*corpus_pipeline.COLUMNS)
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = common.stored(stage(spark, docs, ""), f"test-{name}")
        assert docs.columns == corpus_pipeline.COLUMNS
        after = Counter((r["doc_id"], r["text"]) for r in docs.collect())
        kept.append(sum(after.values()))
        if name == "language_id":
            lost = Counter(before) - after
            assert all(not any(c.isalpha() for c in t or "") for _, t in lost) and not after - Counter(before)
        elif name == "ngram_jaccard":
            assert sorted(i for i, _ in after) == sorted({c for _, _, c in brute_components(before)})
            assert not after - Counter(before)
        elif name == "substring_dedup":
            want = Counter((i, k if r else t) for (i, t), (_, n, r, k) in zip(before, brute_removed(before), strict=True) if not r or r < n)
            assert after == want
        else:
            assert set(after) <= set(before) and max(after.values()) <= 2
    assert all(kept)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in last) == Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in after.elements())
    assert all(r["n_tokens"] == len(r["ids"]) for r in last)


def test_documents_stay_where_no_language_is_known(spark):
    words = {"xa": "alpha", "xb": "bravo", "xc": "gogol", None: "\u10d0\u10d1\u10d2"}  # the last in a script of no learned language
    rows = [(i, " ".join([words[k]] * 4), k) for i, k in enumerate([*words] * 10)] + [(100, "12 34", "xa"), (101, None, "xb")]
    docs = spark.createDataFrame([(i, t, k, "s", 0) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.withColumn("lang", F.lit(None).cast("string"))):
        assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, table, "").collect()) == list(range(40))


def test_unclear_documents_go_by_the_number_of_languages(spark, monkeypatch):
    docs = frame(spark, [(1, "clear"), (2, "likely"), (3, "unclear"), (4, "unknown"), (5, "1")])
    for n, kept in ((2, [1, 2, 3, 4]), (4, [1, 4]), (10, [1, 2, 4])):
        model = langid.LanguageModel(pa.table({"lang": [f"x{i}" for i in range(n)], "n": [0] * n, "gram": ["a"] * n, "k": [1] * n}))
        score = F.element_at(F.create_map(*[F.lit(x) for x in ("clear", 0.9, "likely", max(0.35, 1.05 / n), "unclear", 1.05 / n, "unknown", 1.0 / n, "1", 0.0)]), F.col("text"))
        monkeypatch.setattr(langid, "fit", lambda d, model=model: model)
        monkeypatch.setattr(langid, "predict", lambda d, m, keep, score=score: d.select(*keep).withColumn("score", score).withColumn("lang_pred", F.when(score == 0, "und").otherwise("x1")))
        assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()) == kept


def test_pipeline_of_nothing(spark):
    docs = frame(spark, [(1, "x")]).where("doc_id < 0").select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
