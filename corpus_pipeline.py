"""A corpus pipeline of five stages, each a table in and a table out.

Each stage works on all that its predecessor kept; all but the last return the
columns of ``documents`` (doc_id, text, lang, source, n_chars) and no others,
whatever other columns come in. Texts are worked on whole, however long. An
empty table passes as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numerail.llm import bpe, jaccard, langid, mixing, phrases
from numerail.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose language is told with less than this are rejected, or with less than CHANCES times chance if that is lower.
MIN_SCORE, CHANCES = 0.4, 1.6


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose language is unclear.

    A document stays where the model has nothing to say: no language could be
    learned, or none of its words and n-grams is known (all languages score alike).
    Null and empty texts have no letter and go; repeated rows stay or go
    together; null ids, langs and sources do not matter.
    """
    model = langid.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    chance = 1.0 / len(model.languages)
    clear = (F.col("score") >= min(MIN_SCORE, CHANCES * chance)) | (F.col("score") <= chance + 1e-9)
    return langid.predict(docs, model, COLUMNS).where((F.col("lang_pred") != langid.UNKNOWN) & clear).select(*COLUMNS)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest id.

    Of repeated rows one stays, of rows with one id and different texts one of
    them. Null and empty texts are like no other and stay, one for each id;
    rows with a null id stay as they are.
    """
    return jaccard.keep_one_of_each(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words and more that an earlier document has; a text of which nothing is left goes.

    Texts that lose nothing are unchanged, null ones too; repeated rows end
    alike; rows with a null id lose nothing and cost others nothing.
    """
    cut = phrases.dedup_substrings(docs, ["lang", "source", "n_chars"])
    cut = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    n_chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept").cast("long"))
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the sources by weight: each document comes none, one or two times.

    Documents without words (null, empty) come as often as others of their
    source and hash, but none of a source without any words; null sources are
    one source; rows with one id are drawn together.
    """
    drawn = mixing.mix(docs, keep=["text", "lang", "n_chars"]).where("repeats > 0")
    drawn = drawn.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return drawn.select("doc_id", F.col("row.text").alias("text"), F.col("row.lang").alias("lang"), "source", F.col("row.n_chars").alias("n_chars"))


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Token ids of each text, with the digest of the text that they decode to.

    A row for each row; null and empty texts have no ids.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_and_check(docs, tokenizer_path)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]

#: SQL can express neither the language model nor the merges; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
