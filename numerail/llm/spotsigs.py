"""SpotSigs fingerprints: chains of content words after common-word anchors.

A text's fingerprint is the set of its signatures as short hashes in order, so
two fingerprints alone give the likeness of their texts. Sets are parted by
length: those whose lengths alone keep the likeness under a threshold are in
bands that are not next to each other, and are not compared.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, n_shuffle

#: Content words of a chain; hexadecimal letters of a signature's hash; the likeness of near duplicates.
CHAIN, HASH_LETTERS, AT_LEAST = 2, 10, 0.75
#: Common words of English, German, French and Spanish that anchor chains.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were which with you",
    "auch auf aus bei das dem den der des die ein eine einem einen einer er es für ich im ist mit nach nicht sich sie sind und von war wie zu zum zur",
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas pour qui que sa se ses son sur un une vous",
    "al como con de del el ella en es esta este la las lo los más no nos o para pero por que se sin su sus un una y ya",
)
COMMON = tuple(sorted({w for line in ANCHORS for w in line.split()}))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = ".,;:!?\"()[]{}<>|/*_#"


def words_of(text: Column) -> Column:
    """Words in lower case (A-Z), without punctuation marks."""
    flat = F.translate(text, UPPER + MARKS, LOWER + " " * len(MARKS))
    return F.filter(F.split(flat, SPACE), lambda w: w != "")


def anchors_of(words: Column) -> Column:
    """Anchors with their places."""
    common = [F.lit(w) for w in COMMON]
    return F.filter(F.transform(words, lambda w, i: F.when(w.isin(common), F.struct(w.alias("w"), i.alias("i")))), lambda a: a.isNotNull())


def content_of(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin([F.lit(c) for c in COMMON]))


def signatures(anchors: Column, content: Column, text: Column) -> Column:
    """Distinct signatures: an anchor and the next content words.

    The j-th anchor at place i has i - j content words before it. A text
    without any whole chain has one signature, a digest of itself.
    """
    whole = F.filter(anchors, lambda a, j: a["i"] - j + CHAIN <= F.size(content))
    chain = F.transform(whole, lambda a, j: F.concat_ws(" ", a["w"], *[F.get(content, a["i"] - j + k) for k in range(CHAIN)]))
    found = F.array_distinct(chain)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.concat(F.lit("="), F.md5(text.cast("binary")))))


def fingerprint(sigs: Column) -> Column:
    """The distinct hashes of the signatures, in order, parted by spaces."""
    return F.array_join(F.sort_array(F.array_distinct(F.transform(sigs, lambda s: F.substring(F.md5(s.cast("binary")), 1, HASH_LETTERS)))), " ")


def set_of(print_: Column) -> Column:
    return F.split(print_, " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of two fingerprints."""
    x, y = set_of(a), set_of(b)
    common = F.size(F.array_intersect(x, y))
    return common.cast("double") / (F.size(x) + F.size(y) - common)


def length_band(n: Column, ratio: float = AT_LEAST) -> Column:
    """Sets whose likeness reaches the ratio are in the same or adjacent bands."""
    return F.floor(F.log(n.cast("double")) / F.lit(-math.log(ratio))).cast("int")


def similar(a: Column, b: Column, at_least: float = AT_LEAST) -> Column:
    """Whether the likeness of two fingerprints reaches a threshold; sets in
    bands that are not adjacent, or of lengths too different, are not compared."""
    n, m = F.size(set_of(a)), F.size(set_of(b))
    apart = (F.abs(length_band(n, at_least) - length_band(m, at_least)) > 1) | (F.least(n, m) < at_least * F.greatest(n, m))
    return F.when(apart, F.lit(False)).otherwise(likeness(a, b) >= at_least)


def similar_pairs(prints: DataFrame, queries: DataFrame, at_least: float = AT_LEAST) -> DataFrame:
    """Rows query_id, class_id, likeness: for each query the classes of equal
    fingerprints that reach the threshold, each named by its least doc_id.

    Both tables: doc_id, fingerprint. Queries with equal fingerprints are
    looked up once and have equal rows; a class may be a query's own. A set and
    one like it share a hash among the first |X| - ceil(at_least |X|) + 1 of
    each (prefix filter), so sets meet by hash and band of length, and those
    that meet are compared unless their lengths rule it out. Null fingerprints
    have no rows; rows with a null id are no queries, and are in a class only
    with others.
    """
    def sets(df: DataFrame, name: str) -> DataFrame:
        rows = df.where("fingerprint is not null").groupBy("fingerprint").agg(F.min("doc_id").alias(name)).where(F.col(name).isNotNull())
        rows = rows.withColumn("set", set_of(F.col("fingerprint"))).withColumn("n", F.size("set"))
        return rows.withColumn("band", length_band(F.col("n"), at_least)).withColumn("hash", F.explode(F.slice("set", F.lit(1), F.col("n") - F.ceil(at_least * F.col("n") - 1e-9).cast("int") + 1)))

    tiles = sets(prints, "class_id").select("class_id", F.col("fingerprint").alias("theirs"), F.col("n").alias("m"), "band", "hash")
    asked = sets(queries, "query").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    met = asked.join(tiles, ["hash", "band"]).where(F.least("n", "m") >= at_least * F.greatest("n", "m"))
    met = met.groupBy("query", "class_id").agg(F.first("fingerprint").alias("fingerprint"), F.first("theirs").alias("theirs"))
    found = met.select("fingerprint", "class_id", likeness(F.col("fingerprint"), F.col("theirs")).alias("likeness")).where(F.col("likeness") >= at_least)
    asking = queries.where("doc_id is not null").select(F.col("doc_id").alias("query_id"), "fingerprint")
    return asking.join(found, "fingerprint").select("query_id", "class_id", "likeness")


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are below the id, found in two steps of a square root each."""
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    coarse = F.greatest(F.size(F.filter(F.array(*[F.lit(p[0]) for p in parts if p]).cast("array<bigint>"), lambda b: b < doc_id)) - 1, F.lit(0))
    fine = F.array(*[F.array(*[F.lit(b) for b in p]).cast("array<bigint>") for p in parts])
    return F.coalesce(coarse * step + F.size(F.filter(F.get(fine, coarse), lambda b: b < doc_id)), F.lit(-1)).cast("int")


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Adds next_text: the text of the next document in descending doc_id, after the last the first.

    Documents are dealt by ranges of doc_id, so that each text moves once; the
    first document of a range also goes to the range before it, as its end.
    """
    ids = docs.select("doc_id")
    cuts = ids.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0]
    bounds = sorted(set(cuts or []))
    dealt = docs.withColumn("r", _range_of(F.col("doc_id"), bounds)).withColumn("end", F.lit(0))
    tops = ids.withColumn("r", _range_of(F.col("doc_id"), bounds)).groupBy("r").agg(F.max("doc_id").alias("top"))
    # one row per range: the range before (of larger ids); the topmost one ends the last
    order = Window.orderBy(F.desc("r"))
    tops = tops.withColumn("to", F.coalesce(F.lag("r").over(order), F.min("r").over(Window.partitionBy())))
    heads = dealt.join(F.broadcast(tops.withColumnRenamed("r", "tr")), F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("r") == F.col("tr")))
    heads = heads.groupBy("to").agg(F.max(F.struct("doc_id", "text")).alias("h")).select(F.col("h.doc_id").alias("doc_id"), F.col("h.text").alias("text"), F.col("to").alias("r"), F.lit(1).alias("end"))
    every = dealt.select("doc_id", "text", "r", "end").unionByName(heads)
    within = Window.partitionBy("r").orderBy("end", F.col("doc_id").desc_nulls_last(), F.desc("text"))
    return every.withColumn("next_text", F.lead("text").over(within)).where(F.col("end") == 0).select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, similar_edited, similar_next, n_signatures and
    length_band for each document.

    The likenesses are those of the fingerprints in the row and of the next
    document's. Null texts are empty. Rows with one doc_id are ordered by text,
    null ids come last; a single row is its own next. Texts may be of any
    length. Repeated rows are kept, extra columns ignored whatever their names;
    an empty table gives none.
    """
    parts = parts or 2 * n_shuffle(docs.sparkSession)
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = with_next(flat, parts)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    for name in ("text", "edited", "next_text"):
        rows = rows.withColumn(f"{name}_w", words_of(F.col(name)))
    for name in ("text", "edited", "next_text"):
        rows = rows.withColumn(f"{name}_a", anchors_of(F.col(f"{name}_w"))).withColumn(f"{name}_c", content_of(F.col(f"{name}_w")))
    digest = F.sha2(F.col("edited").cast("binary"), 256)
    prints = [fingerprint(signatures(F.col(f"{x}_a"), F.col(f"{x}_c"), F.col(x))).alias(y) for x, y in (("text", "fingerprint"), ("edited", "edited_fingerprint"), ("next_text", "next"))]
    rows = rows.select("doc_id", "n_chars", digest.alias("edited_sha256"), *prints)
    mine, edited, after = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next")
    size = F.size(set_of(mine))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(mine, edited).alias("near_edited"),
        likeness(mine, after).alias("near_next"),
        similar(mine, edited).alias("similar_edited"),
        similar(mine, after).alias("similar_next"),
        size.alias("n_signatures"),
        length_band(size).alias("length_band"),
    )


def op4_spotsigs(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    common = ", ".join(f"'{w}'" for w in COMMON)
    quoted = MARKS.replace("'", "''")
    space = " " * len(MARKS)

    def sigs(text: str) -> str:
        words = f"list_filter(regexp_split_to_array(translate({text}, '{UPPER}{quoted}', '{LOWER}{space}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
        return words

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n,
        coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text FROM d),
e AS (SELECT *, substr(text, 1, n - n // 3) || substr(next_text, 1, n // 3) AS edited FROM n),
t AS (SELECT doc_id, 1 AS k, text AS x FROM e UNION ALL SELECT doc_id, 2, edited FROM e UNION ALL SELECT doc_id, 3, next_text FROM e),
w AS (SELECT doc_id, k, x, {sigs('x')} AS w FROM t),
a AS (SELECT doc_id, k, x, list_filter(w, lambda y: y NOT IN ({common})) AS c,
        list_filter(list_transform(w, lambda y, i: {{'w': y, 'i': i, 'a': y IN ({common})}}), lambda y: y.a) AS a FROM w),
s0 AS (SELECT doc_id, k, x, list_distinct(list_filter(list_transform(a, lambda y, j: CASE WHEN y.i - j + {CHAIN} <= len(c)
        THEN y.w || ' ' || {" || ' ' || ".join(f"c[y.i - j + {1 + i}]" for i in range(CHAIN))} END), lambda z: z IS NOT NULL)) AS s FROM a),
s AS (SELECT doc_id, k, list_sort(list_distinct(list_transform(CASE WHEN len(s) > 0 THEN s ELSE ['=' || md5(x)] END, lambda y: substr(md5(y), 1, {HASH_LETTERS})))) AS s FROM s0),
p AS (SELECT e.doc_id, e.n, e.edited, s1.s AS s1, s2.s AS s2, s3.s AS s3 FROM e
        JOIN s s1 ON s1.doc_id = e.doc_id AND s1.k = 1 JOIN s s2 ON s2.doc_id = e.doc_id AND s2.k = 2 JOIN s s3 ON s3.doc_id = e.doc_id AND s3.k = 3),
i AS (SELECT *, len(list_intersect(s1, s2)) AS i2, len(list_intersect(s1, s3)) AS i3 FROM p)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
  array_to_string(s1, ' ') AS fingerprint, array_to_string(s2, ' ') AS edited_fingerprint,
  i2::DOUBLE / (len(s1) + len(s2) - i2) AS near_edited, i3::DOUBLE / (len(s1) + len(s3) - i3) AS near_next,
  100 * i2 >= 75 * (len(s1) + len(s2) - i2) AS similar_edited, 100 * i3 >= 75 * (len(s1) + len(s3) - i3) AS similar_next,
  len(s1)::INT AS n_signatures, floor(ln(len(s1)) / -ln({AT_LEAST}))::INT AS length_band
FROM i
"""


OP4_SQL = _sql()
