"""Filter interaction audit by Walsh-Hadamard sums.

Each document fails a subset of the filters, its mask. Of each part and label
(all, good, toxic) the 2^k signed parity sums of the masks are aggregated, as
counts that are combined before the shuffle; their transform, divided by 2^k,
is exactly the number of documents of each mask. All orders, steps and Shapley
values come from those numbers, so the documents are read once, however many
orders there are.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stored

#: The filter that compares with other documents; the others are conditions on a text.
DUPLICATE = "E"
#: A row is made for each order and step: 7 filters have 35,280.
MOST_FILTERS = 7


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters A to D on a text without null."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n.cast("long"),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, filters=text_filters) -> tuple[DataFrame, str]:
    """Rows (doc_id, part, mask, n) and the filters' letters, one bit each in that order.

    A text fails ``E`` if a smaller doc_id has the same text (by SHA-256). Texts
    of a class meet only as a minimum; which rows hold it is found by a join on
    text and id, so a text with very many copies is no large group.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    conditions = filters(text)
    letters = "".join(conditions) + DUPLICATE
    own = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions.values())), F.lit(0))
    rows = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("th"), own.alias("own"))
    rows = stored(rows.groupBy("doc_id", "part", "th", "own").agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    firsts = rows.where("doc_id is not null").groupBy("th").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    last = 1 << (len(letters) - 1)
    repeats = F.col("doc_id").isNotNull() & F.col("first").isNull()
    marked = rows.join(firsts, ["th", "doc_id"], "left").select("doc_id", "part", (F.col("own") + F.when(repeats, last).otherwise(0)).alias("mask"), "n")
    return marked.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")), letters


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic: whether a label of the doc_id says so. Null ids have no label."""
    flags = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = rows.where("doc_id is not null").join(flags, "doc_id", "left")
    no = F.lit(False)
    joined = joined.select("part", "mask", "n", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return joined.unionByName(rows.where("doc_id is null").select("part", "mask", "n", no.alias("good"), no.alias("toxic")))


def _sign(a: Column, b: Column) -> Column:
    """-1 to the number of common bits."""
    return 1 - 2 * (F.bit_count(a.bitwiseAND(b)) % 2)


def parity_sums(rows: DataFrame, k: int) -> DataFrame:
    """part, w_all, w_good, w_toxic: arrays of the 2^k signed sums of n over the masks."""

    def sums(name: str, label: str) -> Column:
        signed = [f"bigint(sum(if({label}, n * (1 - 2 * (bit_count(mask & {s}) % 2)), 0)))" for s in range(1 << k)]
        return F.expr(f"array({', '.join(signed)})").alias(name)

    return rows.groupBy("part").agg(sums("w_all", "true"), sums("w_good", "good"), sums("w_toxic", "toxic"))


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc + x)


def inverse(sums: Column, k: int) -> Column:
    """The documents of each mask, from the parity sums: the transform is its own inverse times 2^k."""
    one = lambda m: _total(F.transform(sums, lambda w, s: w * _sign(m, s)))
    return F.transform(F.sequence(F.lit(0), F.lit((1 << k) - 1)), lambda m: F.call_function("shiftright", one(m), F.lit(k)))


def _cells(cells: str, keep, weigh=lambda n, m: n) -> Column:
    """The sum of the cells whose mask is kept."""
    return _total(F.transform(cells, lambda n, m: F.when(keep(m), weigh(n, m)).otherwise(F.lit(0).cast("long"))))


def orders(cells: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order and step, from part and the arrays all, good and toxic of cells."""
    steps = []
    for order in permutations(letters):
        for i, letter in enumerate(order):
            before = sum(1 << letters.index(x) for x in order[:i])
            steps.append(f"struct('{''.join(order)}' AS filter_order, {i + 1} AS step, {1 << letters.index(letter)} AS bit, {before} AS before)")
    wide = cells.select("*", F.expr(f"explode(array({', '.join(steps)}))").alias("s")).select("part", "all", "good", "toxic", "s.*")
    bit, before = F.col("bit"), F.col("before")
    fails = lambda m: m.bitwiseAND(bit) != 0
    here = lambda m: fails(m) & (m.bitwiseAND(before) == 0)
    shares = F.array(*[F.lit(math.factorial(len(letters)) // i).cast("long") for i in range(1, len(letters) + 1)])
    return wide.select(
        "part", "filter_order", "step",
        _cells("all", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        _cells("all", here).alias("removed"),
        _cells("all", lambda m: fails(m) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        F.get("all", bit).alias("unique_fails"),
        _cells("good", here).alias("good_lost"),
        _cells("toxic", here).alias("toxic_lost"),
        # of the orders of a mask's filters, each filter comes first in an equal share
        _cells("all", fails, lambda n, m: n * F.element_at(shares, F.bit_count(m))).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters=text_filters) -> DataFrame:
    """What each filter removes in every order of the filters, for each part (lang; null: empty string).

    Rows (part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley); zeros are included. Null texts count as
    empty, which fail A only (and E); a null doc_id is no smaller and no larger
    than others, so it never fails E; repeated rows count as often as they
    come and do not repeat each other; labels of one id add up (any says
    so); extra columns are ignored; an empty table has no parts and no rows.
    """
    rows, letters = masks(docs.select("doc_id", "text", "lang"), filters)
    k = len(letters)
    if k > MOST_FILTERS:
        raise ValueError(f"{k} filters have too many orders; {MOST_FILTERS} are the most")
    sums = stored(parity_sums(labelled(rows, labels.select("doc_id", "quality", "toxic")), k), "audit-sums")
    cells = sums.select("part", inverse(F.col("w_all"), k).alias("all"), inverse(F.col("w_good"), k).alias("good"), inverse(F.col("w_toxic"), k).alias("toxic"))
    return orders(cells, letters)


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
first AS (SELECT t, min(doc_id) AS m FROM d GROUP BY t),
label AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN w.doc_id > first.m THEN 'E' ELSE '' END AS fails
  FROM w JOIN first USING (t) LEFT JOIN label ON label.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS ng, count(*) FILTER (toxic) AS nt FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT part, filter_order, step::INT AS step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS earlier
      FROM (SELECT DISTINCT part FROM d), o, range(1, 6) r(step)),
j AS (SELECT s.*, n, ng, nt, fails, contains(fails, x) AS bad, length(translate(earlier, fails, '')) = length(earlier) AS reached FROM s JOIN c USING (part)),
shap AS (SELECT part, x, sum(n) AS v FROM j WHERE bad AND reached GROUP BY ALL)
SELECT j.part, filter_order, step,
  coalesce(sum(n) FILTER (reached AND NOT bad), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (reached AND bad), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (bad AND NOT reached), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = x), 0)::BIGINT AS unique_fails,
  coalesce(sum(ng) FILTER (reached AND bad), 0)::BIGINT AS good_lost, coalesce(sum(nt) FILTER (reached AND bad), 0)::BIGINT AS toxic_lost,
  coalesce(any_value(shap.v), 0)::BIGINT AS shapley
FROM j LEFT JOIN shap USING (part, x) GROUP BY j.part, filter_order, step
"""
