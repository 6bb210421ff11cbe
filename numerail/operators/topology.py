"""Placement data: host lists, physical keys, unit counts, adjacent groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import indexed_within
from .storage import stored

UNITS = ("cab", "chassis", "slot", "blade", "node")
LEVELS = ("blade", "slot", "chassis", "cabinet", "system")
#: Fixed values of the scheduler's node states.
DOWN = (
    "DOWN", "DRAIN", "DRAINING", "DRAINED", "FAIL", "FAILING", "NOT_RESPONDING", "INVALID_REG", "POWERED_DOWN",
    "POWERING_DOWN", "POWER_DOWN", "UNKNOWN", "FUTURE", "CLOUD", "MAINTENANCE", "REBOOT_REQUESTED", "REBOOT_ISSUED",
)
BUSY = ("ALLOCATED", "MIXED", "COMPLETING")


def physical_key(name: Column) -> list[Column]:
    """cab, chassis, slot, blade, node of a name like x1c2s3b0n1 (null where it has none)."""
    pattern = r"x(\d+)c(\d+)s(\d+)b(\d+)n(\d+)"
    return [F.regexp_extract(name, pattern, i + 1).try_cast("int").alias(u) for i, u in enumerate(UNITS)]


XNAME = r"x\d+c\d+s\d+b\d+n\d+"
#: Fields of a scheduler's node line that may hold a physical name, in the order in which they count.
NAME_FIELDS = ("NodeName", "NodeAddr", "NodeHostName", "Comment", "ActiveFeatures", "AvailableFeatures")


def _nodes(rows: DataFrame) -> DataFrame:
    name = F.col("xname")
    return rows.select("host", "xname", *physical_key(name), "state", F.array_remove(F.split("partitions", ","), "").alias("partitions"), name.isNull().alias("skipped"))


def scheduler_nodes(lines: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """host, xname, the units, state, partitions, skipped of a scheduler's node lines (column value).

    The physical name is that of ``names`` (host, xname) where it is a whole
    one, else the first found in the line's name fields; nodes without one have
    null units and are marked as skipped. Other lines count for nothing. Of a
    host that ``names`` has twice the last name by letters is taken.
    """
    from ..sources.logs import field

    line = F.col("value")
    found = F.coalesce(*[F.nullif(F.regexp_extract(field(line, f), XNAME, 0), F.lit("")) for f in NAME_FIELDS])
    rows = lines.where(line.startswith("NodeName=")).select(field(line, "NodeName").alias("host"), found.alias("xname"), field(line, "State").alias("state"), field(line, "Partitions").alias("partitions"))
    if names is not None:
        known = names.where(F.col("xname").rlike(f"^{XNAME}$")).groupBy("host").agg(F.max("xname").alias("_known"))
        rows = rows.join(known, "host", "left").withColumn("xname", F.coalesce("_known", "xname"))
    return _nodes(rows)


def listed_nodes(lines: DataFrame) -> DataFrame:
    """The same of a tab-separated node table: host first, the physical name second, state eighth, partitions ninth
    where there are so many; the header and lines without a whole physical name are left out."""
    c = F.split(F.regexp_replace("value", r"\r$", ""), "\t", -1)
    rows = lines.select(c.alias("c")).where((F.size("c") >= 8) & (F.get("c", F.lit(0)) != "host") & F.get("c", F.lit(1)).rlike(f"^{XNAME}$"))
    return _nodes(rows.select(*[F.get("c", F.lit(i)).alias(n) for i, n in ((0, "host"), (1, "xname"), (7, "state"))], F.coalesce(F.get("c", F.lit(8)), F.lit("")).alias("partitions")))


def name_list(lines: DataFrame) -> DataFrame:
    """host of lists of names parted by commas or spaces, with # comments (column value), each once."""
    words = F.split(F.regexp_replace("value", "#.*", ""), r"[,\s]+")
    return lines.select(F.explode(words).alias("host")).where("host <> ''").distinct()


def free_nodes(nodes: DataFrame, state: str = "idle", excluded: DataFrame | None = None, partition: str | None = None) -> DataFrame:
    """Adds free: whether a node has the state (idle, or usable in any way), is of the partition, and is not excluded (host)."""
    usable, idle, _ = state_flags(F.col("state"))
    free = {"idle": idle, "usable": usable}[state] & ~F.col("skipped")
    if partition:
        free = free & F.array_contains("partitions", partition)
    if excluded is None:
        return nodes.withColumn("free", free)
    out = nodes.join(excluded.select("host", F.lit(True).alias("_out")).distinct(), "host", "left")
    return out.withColumn("free", free & F.col("_out").isNull()).drop("_out")


def natural_key(name: Column) -> tuple[Column, Column]:
    """Prefix and trailing number (-1 without one), by which names sort as people expect."""
    number = F.coalesce(F.regexp_extract(name, r"(\d+)$", 1).try_cast("long"), F.lit(-1).cast("long"))
    return F.regexp_replace(name, r"\d+$", ""), number


def state_flags(state: Column) -> tuple[Column, Column, Column]:
    """usable, idle, busy of a state such as IDLE+DRAIN*."""
    parts = F.split(F.regexp_replace(F.upper(state), r"[*~#!%$@^-]+$", ""), r"\+")
    base, flags = F.get(parts, F.lit(0)), F.slice(parts, 2, 100)
    down = F.array(*[F.lit(s) for s in DOWN])
    usable = (F.coalesce(base, F.lit("")) != "") & ~F.array_contains(down, base) & ~F.arrays_overlap(flags, down)
    busy = base.isin(*BUSY)
    return usable, usable & (base == "IDLE") & ~F.array_contains(flags, "RESERVED"), usable & busy


def expanded(df: DataFrame, expr: str, name: str = "host") -> DataFrame:
    """Rows of the names in lists such as ``a[001-003,7]b,c``: each part of a
    bracket keeps the width of its first number."""
    items = F.regexp_extract_all(F.col(expr), F.lit(r"[^,\[]+(?:\[[^\]]*\])?[^,\[]*"), 0)
    one = df.select("*", F.posexplode(items).alias("_at", "_item"))
    body = F.regexp_extract("_item", r"\[([^\]]*)\]", 1)
    one = one.select("*", F.posexplode(F.when(body == "", F.array(F.lit(""))).otherwise(F.split(body, ","))).alias("_at2", "_part"))
    low, high = F.regexp_extract("_part", r"^(\d+)", 1), F.regexp_extract("_part", r"-(\d+)$", 1)
    numbers = F.sequence(low.cast("long"), F.when(high == "", low).otherwise(high).cast("long"))
    values = F.when(F.col("_part") == "", F.array(F.lit(None).cast("long"))).otherwise(numbers)
    out = one.select("*", low.alias("_low"), F.explode(values).alias("_v"))
    digits = F.when(F.length(F.col("_v").cast("string")) >= F.length("_low"), F.col("_v").cast("string")).otherwise(F.lpad(F.col("_v").cast("string"), F.length("_low"), "0"))
    host = F.concat(F.regexp_extract("_item", r"^([^\[]*)", 1), F.coalesce(digits, F.lit("")), F.regexp_extract("_item", r"\](.*)$", 1))
    return out.select(*df.columns, F.trim(host).alias(name)).where(F.col(name) != "")


def unit_counts(df: DataFrame, units: list[str], measures: list[Column]) -> DataFrame:
    """Counts per unit and all units above it, with the level (number of unit columns given)."""
    level = sum((F.lit(1) - F.grouping(u) for u in units), F.lit(0)).cast("int")
    return df.rollup(*units).agg(level.alias("level"), *measures)


def unit_capacities(df: DataFrame) -> DataFrame:
    """lv, most: the most nodes of one unit on each level below the system, of blades (0) to cabinets (3)."""
    keys = [F.struct(*UNITS[: 4 - lv]) for lv in range(4)]
    each = F.array(*[F.struct(F.lit(lv).alias("lv"), F.to_json(k).alias("unit")) for lv, k in enumerate(keys)])
    return df.select(F.explode(each).alias("u")).groupBy("u.lv", "u.unit").count().groupBy("lv").agg(F.max("count").alias("most"))


def smallest_unit(df: DataFrame, n: int) -> str:
    """The smallest unit level that holds n of the nodes."""
    most = unit_capacities(df)
    row = most.where(F.col("most") >= n).agg(F.min("lv")).first()
    return LEVELS[4 if row is None or row[0] is None else row[0]]


def smallest_units(df: DataFrame, sizes: DataFrame, n: str) -> DataFrame:
    """Adds level: the smallest unit level that holds so many of the nodes, for each row of a table of sizes."""
    most = F.broadcast(unit_capacities(df).agg(F.map_from_entries(F.collect_list(F.struct("lv", "most"))).alias("_most")).withColumn("_one", F.lit(1)))  # one row of four levels
    rows = sizes.withColumn("_one", F.lit(1)).join(most, "_one", "left")
    held = [F.when(F.coalesce(F.try_element_at("_most", F.lit(lv)), F.lit(0)) >= F.col(n), LEVELS[lv]) for lv in range(4)]
    return rows.withColumn("level", F.coalesce(*held, F.lit(LEVELS[4]))).drop("_one", "_most")


def best_windows(df: DataFrame, key: list[str], position: str, n: int) -> DataFrame:
    """Per key, the n consecutive rows with the least span of positions, the earliest among equals: key, first, span.

    Rows are numbered within their key and meet the row n - 1 places on, so no key is sorted in one task.
    """
    rows = stored(indexed_within(df.select(*key, position), key, [position], "_k"), "numbered")
    ends = rows.select(*key, (F.col("_k") - (n - 1)).alias("_k"), F.col(position).alias("_end"))
    spans = rows.join(ends, [*key, "_k"])
    best = F.min(F.struct((F.col("_end") - F.col(position)).alias("span"), F.col(position).alias("first")))
    return spans.groupBy(*key).agg(best.alias("b")).select(*key, "b.first", "b.span")


def pick_groups(nodes: DataFrame, size: int, count: int = 1, exclude: list[str] | None = None) -> list[dict]:
    """Groups of adjacent nodes, taken one after the other; nodes: host, the unit columns, free (boolean).

    A group comes from the smallest level with a unit that has enough free
    nodes: a unit that was wholly free first, then the best fit, then the
    earliest; in it the window of least span. Each choice is one aggregate;
    only the chosen unit's nodes come to the driver.
    """
    order = Window.orderBy(*UNITS)  # as many rows as nodes of a machine
    pool = nodes.withColumn("rank", F.row_number().over(order) - 1).withColumn("free", F.col("free") & ~F.col("host").isin(exclude or [])).persist()
    out: list[dict] = []
    taken: list[str] = []
    ideal = LEVELS.index(smallest_unit(pool, size))
    for _ in range(count):
        left = pool.withColumn("now", F.col("free") & ~F.col("host").isin(taken))
        for lv in range(ideal, 5):
            unit = list(UNITS[: 4 - lv])
            sums = left.groupBy(*unit).agg(F.count_if("now").alias("n"), F.bool_and("free").alias("whole"), F.min(F.when(F.col("now"), F.col("rank"))).alias("first")).where(F.col("n") >= size)
            best = sums.orderBy(F.desc("whole"), "n", "first").first()
            if best:
                break
        else:
            break
        members = left.where("now")
        for u in unit:
            members = members.where(F.col(u) == best[u])
        rows = members.orderBy("rank").select("host", "rank").collect()
        spans = [(rows[i + size - 1]["rank"] - rows[i]["rank"], i) for i in range(len(rows) - size + 1)]
        span, at = min(spans)
        hosts = [r["host"] for r in rows[at : at + size]]
        out.append({"hosts": hosts, "level": LEVELS[lv], "cross": lv > ideal, "gap": span + 1 - size})
        taken += hosts
    pool.unpersist()
    return out


def collisions(df: DataFrame) -> DataFrame:
    """Pairs of runs (npe, id, g0, g) that share an id and overlap in [g0, g0 + g)."""
    from .analytics import overlaps

    spans = df.withColumn("_row", F.struct("g0", "g")).withColumn("_end", F.col("g0") + F.col("g"))
    return overlaps(spans, ["npe", "id"], "_row", "g0", "_end", 64)
