"""Reports over runs, hosts, work lists, settings and model tables."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .analytics import wilson
from .topology import expanded, physical_key

#: Values of a fact that count as none (fixed values).
NO_VALUE = ("", "NA", "none", "unknown", "?")
#: Fixed values of a profile's format: what stands where a value is still to fill, and the key that lists the launch line's.
FILL, LINE_KEYS = "__FILL__", "LAUNCH_LINE_KEYS"
#: Prefixes of names that other software reads, which a profile may hold, and those of them that the drift check lets pass.
ALLOWED = ("SLURM_", "PMI_", "SHMEM_", "FI_", "OMPI_", "XT_", "HIP_", "ROC", "HSA_", "OMP_", "MPICH_", "CRAY_", "LD_")
CHECKED = ("FI_", "SHMEM_", "XT_", "OMPI_", "SLURM_")


def begins_with(name: Column, prefixes: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: name.startswith(p)) if prefixes else F.lit(False)


# runs
def phase_shares(df: DataFrame, total: str, phases: list[str]) -> DataFrame:
    """Adds <phase>_share: each phase over the total, to three places; null without a total."""
    whole = F.when(F.col(total) != 0, F.col(total))
    return df.select("*", *[F.round(F.col(p) / whole, 3).alias(f"{p}_share") for p in phases])


def path_table(runs: DataFrame, path: str, total: str, verified: Column, exit_code: Column, digest: str) -> DataFrame:
    """A row per path: runs, verified ones, bad exits, mean, least and most total
    of the verified runs, their spread in percent of the mean, and whether the
    digests that there are agree (AGREE, DIFFER, or NONE without any).

    Two digests tell whether they differ, so none are gathered.
    """
    ok = F.coalesce(verified, F.lit(False))
    good = F.when(ok, F.col(total))
    out = runs.groupBy(path).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(ok).alias("n_ok"), F.count_if(F.coalesce(exit_code, F.lit(0)) != 0).alias("bad_exits"),
        F.avg(good).alias("mean"), F.min(good).alias("least"), F.max(good).alias("most"), F.min(digest).alias("_low"), F.max(digest).alias("_high"),
    )
    spread = F.when(F.col("mean") != 0, 100 * (F.col("most") - F.col("least")) / F.col("mean"))
    agree = F.when(F.col("_low").isNull(), "NONE").when(F.col("_low") == F.col("_high"), "AGREE").otherwise("DIFFER")
    return out.select("*", spread.alias("spread_pct"), agree.alias("digests")).drop("_low", "_high")


def cross_path(paths: DataFrame, runs: DataFrame, tail: str, head: str, expected: int) -> DataFrame:
    """One row: replicas found and whether they are as many as expected, whether
    all runs have one tail and no two heads, and PASS when with these every path
    has only verified runs, clean exits and one digest."""
    whole = runs.agg(F.count(F.lit(1)).alias("replicas"), (F.min(tail) == F.max(tail)).alias("_tail"), (F.min(head) != F.max(head)).alias("_heads"))
    per = paths.agg(F.coalesce(F.bool_and((F.col("n_ok") == F.col("runs")) & (F.col("bad_exits") == 0) & (F.col("digests") == "AGREE")), F.lit(False)).alias("paths_ok"))
    one = whole.crossJoin(per)  # one row each
    one = one.select("replicas", (F.col("replicas") >= expected).alias("complete"), F.coalesce("_tail", F.lit(False)).alias("tails_agree"), (~F.coalesce("_heads", F.lit(False))).alias("heads_agree"), "paths_ok")
    return one.withColumn("overall", F.when(F.col("complete") & F.col("tails_agree") & F.col("heads_agree") & F.col("paths_ok"), "PASS").otherwise("NOT PASS"))


# hosts
def with_logs(hosts: DataFrame, logs: DataFrame, host: str) -> DataFrame:
    """The listed hosts with what their logs say; ``failed`` tells of those without."""
    return hosts.join(logs.withColumn("_there", F.lit(True)), host, "left").withColumn("failed", F.when(F.col("_there").isNull(), "no local log")).drop("_there")


def classified(rows: DataFrame, avail: str, errors: str, least_avail: float, refuse_errors: bool = False, flags: list[Column] | None = None) -> DataFrame:
    """Adds reasons, warnings and class: EXCLUDE with any reason, WARN with a
    warning, else KEEP. Too little memory and a failed log are reasons;
    uncorrected errors warn, or are a reason where they are refused. ``flags``
    are more reasons (null: none)."""
    few = F.when((F.lit(least_avail) > 0) & (F.col(avail) < least_avail), "memory")
    bad = F.when(F.col(errors) > 0, "errors")
    none = F.lit(None).cast("string")
    reasons = F.array_compact(F.array(*(flags or []), F.when(F.col("failed").isNotNull(), F.concat(F.lit("failed: "), "failed")), bad if refuse_errors else none, few))
    warnings = F.array_compact(F.array(none if refuse_errors else bad))
    out = rows.withColumn("reasons", F.array_join(reasons, ",")).withColumn("warnings", F.array_join(warnings, ","))
    return out.withColumn("class", F.when(F.col("reasons") != "", "EXCLUDE").when(F.col("warnings") != "", "WARN").otherwise("KEEP"))


def placed_hosts(hosts: DataFrame, names: DataFrame, host: str, position: str) -> DataFrame:
    """host, place from 0: by physical name (cabinet to node), hosts without one last in the given order.

    ``names``: host, xname. Places come from ranges of one number made of the
    units, so no task sorts all hosts.
    """
    from .order import indexed

    known = names.select(host, *physical_key(F.col("xname"))).where("node is not null")
    rows = hosts.join(known, host, "left")
    units = F.col("cab").cast("long")
    for unit, width in (("chassis", 64), ("slot", 256), ("blade", 64), ("node", 64)):
        units = units * width + F.col(unit)
    rank = F.coalesce(units, F.lit(1 << 60) + F.col(position).cast("long"))
    return indexed(rows.select(host, position, rank.alias("_rank")), ["_rank", position, host], "place").select(host, "place")


def leaf_switches(lines: DataFrame) -> DataFrame:
    """host, leaf of the level-0 lines of a scheduler's topology text (column value); of a host listed twice the last switch by name."""
    pattern = r"SwitchName=(\S+)\s+Level=0\b.*?\bNodes=(\S+)"
    rows = lines.where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("leaf"), F.regexp_extract("value", pattern, 2).alias("_nodes"))
    return expanded(rows, "_nodes").groupBy("host").agg(F.max("leaf").alias("leaf"))


def host_groups(hosts: DataFrame, leaves: DataFrame | None, size: int) -> DataFrame:
    """host, leaf: the leaf switch ('?' for hosts that the topology lacks); without
    a topology groups of ``size`` by the host's trailing number, which starts at 1."""
    if leaves is not None:
        return hosts.join(leaves, "host", "left").select("host", F.coalesce("leaf", F.lit("?")).alias("leaf"))
    number = F.regexp_extract("host", r"(\d+)$", 1).try_cast("long")
    return hosts.select("host", F.when(number > 0, F.concat(F.lit("g"), ((number - 1 - (number - 1) % size) / size).cast("long").cast("string"))).otherwise("?").alias("leaf"))


# runs of groups of processes
def group_runs(spark: SparkSession, npe: int, ppn: int, schedule: list[int]) -> DataFrame:
    """what, g0, g: the runs of consecutive processes that levels, a schedule of
    group sizes, node groups and the self-test make; of one process none.

    Every kind is a range of starts; the last run of a kind may be shorter.
    """
    def starts(what: str, size: int, least: int = 2) -> DataFrame:
        rows = spark.range(0, npe, size).select(F.lit(what).alias("what"), F.col("id").alias("g0"), F.least(F.lit(size), F.lit(npe) - F.col("id")).cast("long").alias("g"))
        return rows.where(F.col("g") >= least)

    power = lambda x: x > 0 and x & (x - 1) == 0
    parts = []
    level = 1
    while npe > 1 and 1 << (level - 1) < npe and level < 16:
        parts.append(starts(f"at{level}", 1 << level))
        level += 1
    for at, size in enumerate(schedule, 1):
        before = schedule[at - 2] if at > 1 else 1
        rows = starts(f"sched{at}", size).where(F.ceil(F.col("g") / before) >= 2)
        twice = (F.bit_count("g") == 1) & (F.col("g0") % F.col("g") == 0) | (F.col("g0") == 0) & (F.col("g") == npe)  # a level has these
        if npe > 1:
            parts.append(rows.where(~twice))
    if npe > 1 and 2 <= ppn < npe and npe % ppn == 0:
        parts.append(spark.createDataFrame(sorted({("node", 0, ppn), ("node", npe - ppn, ppn)}), "what string, g0 long, g long"))
    if npe > 1:
        largest = 1 << (npe.bit_length() - 1)
        assert power(largest)
        parts.append(spark.createDataFrame([("selftest", 0, largest)], "what string, g0 long, g long"))
    out = spark.createDataFrame([], "what string, g0 long, g long")
    for p in parts:
        out = out.unionByName(p)
    return out


# work lists
def item_states(items: DataFrame, done: DataFrame, claims: DataFrame) -> DataFrame:
    """id, prio, state, status, worker, wall_s, stale, label of each item.

    ``done``: id, status, wall_s; ``claims``: id, worker, age_s. A done item
    without a status failed. A claim is stale beyond twice the estimate and ten
    minutes. The label is the state, with the status of a done item.
    """
    d = done.select("id", F.coalesce("status", F.lit("FAIL")).alias("status"), F.col("wall_s").alias("_wall"), F.lit(True).alias("_done"))
    rows = items.join(d, "id", "left").join(claims.select("id", "worker", "age_s"), "id", "left")
    state = F.when(F.col("_done"), "done").when(F.col("age_s").isNotNull(), "claimed").otherwise("unclaimed")
    rows = rows.withColumn("state", state)
    late = F.coalesce((F.col("state") == "claimed") & (F.col("age_s") > (2 * F.col("est_min") + 10) * 60), F.lit(False))
    wall = F.when(F.col("state") == "done", F.col("_wall")).when(F.col("state") == "claimed", F.col("age_s"))
    label = F.when(F.col("state") == "done", F.concat(F.lit("done-"), "status")).otherwise(F.col("state"))
    return rows.select("id", "prio", "state", F.coalesce("status", F.lit("")).alias("status"), F.coalesce("worker", F.lit("")).alias("worker"), wall.alias("wall_s"), late.alias("stale"), label.alias("label"))


def status_table(states: DataFrame) -> DataFrame:
    """label, items, stale: how many items are in each state."""
    return states.groupBy("label").agg(F.count(F.lit(1)).alias("items"), F.count_if("stale").alias("stale"))


def best_workers(items: list[dict], count: int, done: dict[str, str] | None = None, most_nodes: int | None = None) -> dict | None:
    """Sizes of so many workers by which the list of items that are left drains best.

    Tried are all choices from the sizes that items ask for, of which the
    largest fits every item; the best leaves the fewest items, then ends
    soonest, then has the fewest nodes. ``done``: ids with their status; items
    behind one that ended badly stay. Work lists are small; this runs on the driver.
    """
    from .manifest import OK, schedule

    done = done or {}
    use = [i for i in items if most_nodes is None or i["nodes"] <= most_nodes]
    todo = [i for i in use if i["id"] not in done]
    met = {i for i, status in done.items() if status in OK}
    todo = [i | {"deps": [d for d in i["deps"] if d not in met]} for i in todo]
    sizes = sorted({i["nodes"] for i in todo if i["nodes"] > 0}) or [1]
    largest = max((i["nodes"] for i in todo), default=0)
    best = None
    for choice in itertools.combinations_with_replacement(sizes, count):
        if max(choice) >= largest:
            span, plan, left = schedule(todo, list(choice))
            key = (len(left), span, sum(choice))
            if best is None or key < best["key"]:
                best = {"key": key, "sizes": sorted(choice, reverse=True), "span": span, "plan": plan, "left": sorted(left)}
    return best


# settings
def switch_table(sites: DataFrame) -> DataFrame:
    """name, sites, files, default of the places that read a setting (name, file, value).

    ``value``: a literal default, 'unset' or 'derived'. One literal is the
    default; several are a conflict; without any it is unset if some site says
    so and none derives it. Literals are compared by their least and greatest.
    """
    literal = F.when(~F.col("value").isin("unset", "derived"), F.col("value"))
    out = sites.groupBy("name").agg(
        F.count(F.lit(1)).alias("sites"), F.count_distinct("file").alias("files"), F.min(literal).alias("_low"), F.max(literal).alias("_high"),
        F.bool_or(F.col("value") == "unset").alias("_unset"), F.bool_or(F.col("value") == "derived").alias("_derived"),
    )
    default = F.when(F.col("_low") < F.col("_high"), F.concat(F.lit("conflict:"), "_low", F.lit("|"), "_high")).when(F.col("_low").isNotNull(), F.col("_low"))
    return out.select("name", "sites", "files", default.when(F.col("_unset") & ~F.col("_derived"), "unset").otherwise("derived").alias("default"))


def profile_settings(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, value, line_no) of a profile's lines KEY=value (the last of a key
    counts), and (line_no, problem) of lines that are none or repeat a key.
    Blank lines and comments are passed over."""
    text = F.trim("value")
    rows = lines.select("line_no", text.alias("_t")).where((F.col("_t") != "") & ~F.col("_t").startswith("#"))
    pattern = r"^([A-Za-z_][A-Za-z0-9_]*)=(.*)$"
    rows = rows.withColumn("name", F.when(F.col("_t").rlike(pattern), F.regexp_extract("_t", pattern, 1))).withColumn("v", F.regexp_extract("_t", pattern, 2))
    ends = rows.where("name is not null").groupBy("name").agg(F.max_by("v", "line_no").alias("value"), F.min("line_no").alias("first"), F.max("line_no").alias("line_no"))
    bad = rows.where("name is null").select("line_no", F.concat(F.lit("not KEY=value: "), F.substring("_t", 1, 60)).alias("problem"))
    again = rows.join(ends.select("name", "first"), "name").where("line_no > first").select("line_no", F.concat(F.lit("duplicate key "), "name").alias("problem"))
    return ends.select("name", "value", "line_no"), bad.unionByName(again)


def profile_problems(settings: DataFrame, registry: DataFrame, line_keys: str = LINE_KEYS, external: tuple[str, ...] = ALLOWED) -> DataFrame:
    """name, problem: names that the registry lacks (those with an ``external`` prefix are let
    pass), values still to fill, and keys of the launch line that are not set."""
    own = settings.where(~begins_with(F.col("name"), external) & (F.col("name") != line_keys))
    unknown = own.join(registry.select("name"), "name", "left_anti").select("name", F.lit("unknown switch").alias("problem"))
    unfilled = settings.where(F.col("value") == FILL).select("name", F.lit("still to fill").alias("problem"))
    named = settings.where(F.col("name") == line_keys).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("name")).where("name <> ''").distinct()
    lacking = named.join(settings.where(F.col("value") != FILL).select("name"), "name", "left_anti").select("name", F.lit("on the launch line but not set").alias("problem"))
    return unknown.unionByName(unfilled).unionByName(lacking)


def profile_drift(settings: DataFrame, defaults: DataFrame, registry: DataFrame, external: tuple[str, ...] = CHECKED) -> DataFrame:
    """name, class of a profile's settings against the scripts' literal defaults (name, value).

    UNFILLED, or else SAME where all defaults equal the value, OVERRIDE where
    one differs, PROFILE-ONLY without one; besides these UNKNOWN where neither
    the registry has the name nor an ``external`` prefix begins it.
    """
    d = defaults.groupBy("name").agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    rows = settings.join(d, "name", "left").join(registry.select("name").distinct().withColumn("_known", F.lit(True)), "name", "left")
    drift = F.when(F.col("value") == FILL, "UNFILLED").when(F.col("_low").isNull(), "PROFILE-ONLY").when((F.col("_low") == F.col("value")) & (F.col("_high") == F.col("value")), "SAME").otherwise("OVERRIDE")
    unknown = F.when(F.col("_known").isNull() & ~begins_with(F.col("name"), external), "UNKNOWN")
    return rows.select("name", F.explode(F.array_compact(F.array(drift, unknown))).alias("class"))


def drift_counts(drift: DataFrame) -> DataFrame:
    return drift.groupBy("class").agg(F.count(F.lit(1)).alias("settings"))


def config_line(settings: DataFrame, registry: DataFrame, letters: int = 16) -> DataFrame:
    """One row: settings, how many the registry lacks, and a digest of the sorted name=value lines.

    A setting's line is digested first, so the row holds short digests only; it
    is for configurations, which a row can hold.
    """
    rows = settings.join(registry.select("name").distinct().withColumn("_known", F.lit(True)), "name", "left")
    lines = F.array_join(F.array_sort(F.collect_list(F.sha2(F.concat_ws("=", "name", "value").cast("binary"), 256))), "\n")
    return rows.agg(F.count(F.lit(1)).alias("settings"), F.count_if(F.col("_known").isNull()).alias("unknown"), F.substring(F.sha2(lines.cast("binary"), 256), 1, letters).alias("digest"))


def filled_template(template: DataFrame, facts: DataFrame) -> DataFrame:
    """name, value, reason of a template's names with the facts found for them;
    a fact that is none of a value leaves the name to fill, with the reason."""
    rows = template.join(facts.select("name", F.col("value").alias("_v"), F.lit(True).alias("_there")), "name", "left")
    good = F.col("_v").isNotNull() & ~F.col("_v").isin(*NO_VALUE) & ~F.col("_v").startswith("missing")
    reason = F.when(good, F.lit(None)).when(F.col("_there").isNull(), "no such fact").otherwise(F.concat(F.lit("no value: "), F.coalesce("_v", F.lit("null"))))
    return rows.select("name", F.when(good, F.col("_v")).otherwise(FILL).alias("value"), reason.alias("reason"))


def undeclared(uses: DataFrame, declared: DataFrame, name: str) -> DataFrame:
    """name, uses: what is used but not declared, with how often."""
    return uses.groupBy(name).agg(F.count(F.lit(1)).alias("uses")).join(declared.select(name), name, "left_anti")


# models
def phase_table(runs: DataFrame, size: str, total: str, weight: str, init: str, phases: list[str]) -> DataFrame:
    """A row per size: the mean of each phase, the wall and the start-up weighted
    by the runs that a row stands for, and what is left of the wall (not below 0)."""
    n = F.coalesce(F.col(weight), F.lit(1))
    there = F.col(init).isNotNull()
    out = runs.groupBy(size).agg(
        *[F.avg(p).alias(p) for p in phases], (F.sum(F.col(total) * n) / F.sum(n)).alias("wall"), (F.sum(F.when(there, F.col(init) * n)) / F.sum(F.when(there, n))).alias("init")
    )
    named = sum((F.coalesce(p, F.lit(0.0)) for p in [*phases, "init"]), F.lit(0.0))
    return out.withColumn("other", F.greatest(F.lit(0.0), F.col("wall") - named))


def residuals(rows: DataFrame, modeled: str, measured: str) -> DataFrame:
    """Adds residual: modeled over measured, less 1."""
    return rows.withColumn("residual", F.col(modeled) / F.when(F.col(measured) != 0, F.col(measured)) - 1)


def risk_rows(sizes: DataFrame, ledger: DataFrame, size: str) -> DataFrame:
    """The ledger's rows (label, low, high, runs, failures) that cover each size
    within one percent: rate, Wilson interval and expected attempts (null where
    all failed). A ledger is small; the optimizer broadcasts it by its size."""
    rows = sizes.join(ledger, F.col(size).between(F.col("low") * 0.99, F.col("high") * 1.01))
    low, high = wilson(F.col("runs"), F.col("failures"))
    rate = F.col("failures") / F.col("runs")
    attempts = F.when(F.col("failures") < F.col("runs"), 1 / (1 - rate))
    return rows.select(size, "label", "runs", "failures", rate.alias("rate"), low.alias("rate_low"), high.alias("rate_high"), attempts.alias("attempts"))


def relative_differences(a: DataFrame, b: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """key, difference, ok: a's value against b's, relative to b's; a value that one side lacks is not ok."""
    both = a.select(*key, F.col(value).alias("_a")).join(b.select(*key, F.col(value).alias("_b")), key, "full")
    d = F.when(F.col("_a") == F.col("_b"), 0.0).otherwise(F.abs(F.col("_a") - F.col("_b")) / F.abs("_b"))
    return both.select(*key, d.alias("difference"), F.coalesce(d <= tolerance, F.lit(False)).alias("ok"))
