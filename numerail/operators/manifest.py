"""Work lists with dependencies: validation, cycles, eligibility, scheduling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import dropped, stored

OK = ("PASS", "PARTIAL")


def problems(items: DataFrame, pattern: str, scripts: DataFrame) -> DataFrame:
    """id, problem of an item table (id, tier, nodes, est_min, deps array, script)."""
    known = items.select("id").distinct()
    duplicate = items.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("problem"))
    checks = [
        (~F.col("id").rlike(pattern), "bad id"),
        (~F.coalesce(F.col("tier").isin(1, 2), F.lit(False)), "tier must be 1 or 2"),
        ((F.col("nodes") < 0) | (F.col("est_min") <= 0), "nodes or est_min out of range"),
        (F.array_contains("deps", F.col("id")), "depends on itself"),
    ]
    own = items.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in checks]))).alias("problem"))
    missing = items.join(scripts.select("script"), "script", "left_anti").select("id", F.lit("script missing").alias("problem"))
    edges = items.select("id", F.explode("deps").alias("dep"))
    dangling = edges.join(known.withColumnRenamed("id", "dep"), "dep", "left_anti").select("id", F.concat(F.lit("unknown id "), "dep").alias("problem"))
    return duplicate.unionByName(own).unionByName(missing).unionByName(dangling)


def cyclic(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Nodes that no order of the edges (id needs dep) can place: those on cycles or behind them.

    A round takes away the needs that nothing is left of, and lets who needs a
    node with one need have that need instead: the two can be placed or not
    alike. So needs along a chain double their reach in a round, and a chain of
    n nodes is gone after about log2(n) rounds; nodes with several needs go by
    layers. The rounds end when one takes nothing away, as some node that can
    be placed always has only needs that are gone. Each round is written to the
    shared folder; it raises when ``max_rounds`` are not enough.
    """
    left = stored(edges.select("id", "dep").distinct(), "needs")
    n = left.count()
    for _ in range(max_rounds):
        needing = left.groupBy(F.col("id").alias("dep")).agg(F.count(F.lit(1)).alias("needs"), F.min("dep").alias("next"))
        here = left.join(needing, "dep").select("id", F.when(F.col("needs") == 1, F.col("next")).otherwise(F.col("dep")).alias("dep"))
        after = stored(here.distinct(), "needs")
        dropped(left)
        left, m = after, after.count()
        if m == n or not m:
            break
        n = m
    else:
        raise RuntimeError(f"dependencies are deeper than {max_rounds}")
    return left.select("id").distinct()


def eligible(items: DataFrame, states: DataFrame, nodes: int, minutes: float | None = None, tier: int | None = None) -> DataFrame:
    """id, prio, reason of unclaimed items; reason is null where an item can start now.

    ``states``: id, state, status. Items need their nodes and time, and all
    dependencies done with a good status.
    """
    todo = items.join(states, "id", "left").where(F.coalesce("state", F.lit("unclaimed")) == "unclaimed")
    if tier is not None:
        todo = todo.where(F.col("tier") == tier)
    deps = todo.select("id", F.explode("deps").alias("dep")).join(states.select(F.col("id").alias("dep"), F.col("state").alias("ds"), F.col("status").alias("dst")), "dep", "left")
    good: Column = (F.col("ds") == "done") & F.col("dst").isin(*OK)
    unmet = deps.where(~F.coalesce(good, F.lit(False))).groupBy("id").agg(F.min(F.when(F.col("ds") == "done", F.col("dep"))).alias("dead"), F.bool_or(F.coalesce(F.col("ds") == "claimed", F.lit(False))).alias("claimed"), F.array_join(F.array_sort(F.collect_set("dep")), ",").alias("deps_left"))
    reason = F.when(F.col("nodes") > nodes, "needs more nodes")
    if minutes is not None:
        reason = reason.when(F.col("est_min") > minutes, "needs more time")
    reason = reason.when(F.col("dead").isNotNull(), F.concat(F.lit("dependency ended badly: "), "dead")).when(F.col("claimed"), F.concat(F.lit("waits for "), "deps_left")).when(F.col("deps_left").isNotNull(), F.concat(F.lit("waits for unclaimed "), "deps_left"))
    return todo.join(unmet, "id", "left").select("id", "prio", reason.alias("reason"))


def stale(age_s: Column, est_min: Column) -> Column:
    """Whether a claim is older than twice the estimate and ten minutes."""
    return age_s > (2 * est_min + 10) * 60


def schedule(items: list[dict], sizes: list[int]) -> tuple[float, list[list[tuple[str, float]]], list[str]]:
    """List scheduling on workers of given sizes: makespan, each worker's (item, start), items left.

    The worker that is free first takes the first item by (prio, id) that fits
    it and whose dependencies have ended; else it waits for the next end. Work
    lists are small; this runs on the driver.
    """
    import heapq

    ends: dict[str, float] = {}
    waiting = sorted(items, key=lambda i: (i["prio"], i["id"]))
    free = [(0.0, w) for w in range(len(sizes))]
    plan: list[list[tuple[str, float]]] = [[] for _ in sizes]
    while waiting and free:
        now, w = heapq.heappop(free)
        fit = next((i for i in waiting if i["nodes"] <= sizes[w] and all(ends.get(d, float("inf")) <= now for d in i["deps"])), None)
        if fit is not None:
            waiting.remove(fit)
            ends[fit["id"]] = now + fit["est_min"]
            plan[w].append((fit["id"], now))
            heapq.heappush(free, (ends[fit["id"]], w))
        elif later := [e for e in ends.values() if e > now]:
            heapq.heappush(free, (min(later), w))
    return max(ends.values(), default=0.0), plan, [i["id"] for i in waiting]


def suggestions(unknown: DataFrame, known: DataFrame, name: str = "name", count: int = 2, most: int = 3) -> DataFrame:
    """Up to two known names near each unknown one by edit distance (``known`` is a registry: broadcast)."""
    def cut(df, alias):
        """Names in pieces: most + 1 pieces of two names within ``most`` edits share one, near the same place."""
        n = F.length(name)
        pieces = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.struct(i.alias("i"), F.floor(i * n / (most + 1)).cast("int").alias("at"), F.floor((i + 1) * n / (most + 1)).cast("int").alias("to")))
        return df.select(F.col(name).alias(alias), F.explode(pieces).alias("p"))

    # all substrings of the unknown names that can be a piece of a known one
    known_pieces = cut(known.distinct(), "k").select("k", F.col("p.at").alias("at"), F.expr("substring(k, p.at + 1, p.to - p.at)").alias("piece"), F.length("k").alias("nk"))
    spans = F.expr(f"flatten(transform(sequence(0, length(u)), a -> transform(sequence(0, length(u) - a), m -> struct(a AS at, substring(u, a + 1, m) AS piece))))")
    theirs = unknown.select(F.col(name).alias("u")).distinct().select("u", F.explode(F.array_distinct(spans)).alias("s")).select("u", F.col("s.at").alias("ua"), F.col("s.piece").alias("piece"))
    met = theirs.join(known_pieces, "piece").where((F.abs(F.col("at") - F.col("ua")) <= most) & (F.abs(F.length("u") - F.col("nk")) <= most)).select("u", "k").distinct()
    near = met.withColumn("d", F.levenshtein("u", "k", most)).where("d >= 0")
    return near.groupBy(F.col("u").alias(name)).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("d", "k"))), 1, count), lambda s: s["k"]).alias("near"))
