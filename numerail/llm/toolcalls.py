"""Tool-call linking for chat data. DataFrame functions only.

Calls and results meet by hash joins on (conv_id, call_id); the build side has
one row for each identifier. A call may name the call whose result it needs
(``after``), so calls form chains; each message gets a place (order_turn,
order_level, order_kind) that puts a result after its call and a call after
the results that it needs. Places along chains are found by doubling: each
call's reach up the chain doubles in a round. Messages are serialised as
canonical JSON: keys in order, no spaces, types kept. A message is a row
throughout, so the length of a conversation does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Argument schemas: of each tool its arguments, with the type of the JSON value, whether it must be there and its most characters.
SCHEMAS = {
    "reply": {"prompt": ("STRING", True, 2000)},
    "search": {"query": ("STRING", True, 400), "limit": ("BIGINT", False, None), "sites": ("ARRAY", False, None)},
    "compute": {"expression": ("STRING", True, 2000), "options": ("OBJECT", False, None)},
}
TEXT, CALL, RESULT = 0, 1, 2
KEEP_NULLS = {"ignoreNullFields": "false"}


def parsed(json: Column) -> Column:
    """The value of a JSON text; null unless the text is one value and no more.

    The parser stops at the end of a value. A text with anything behind its
    value is no value within a list or within an object: what could go on the
    one cannot go on the other.
    """
    within = lambda before, after: F.try_parse_json(F.concat(F.lit(before), json, F.lit(after))).isNotNull()
    return F.when(within("[", "]") & within('{"v":', "}"), F.try_parse_json(json))


def canonical(json: Column) -> Column:
    """A JSON text with the keys of all its objects in order (of UTF-16 units, as
    RFC 8785 has it) and no spaces; null if it is no JSON, more than one value, or
    an object has a key twice.

    Numbers are written as Spark's variants hold them: whole ones of up to 38
    digits exactly (1.0 as 1), others as decimals or doubles (1e3 as 1000.0),
    and whole ones of more digits as the nearest double.
    """
    return F.to_json(parsed(json))


def violations(name: Column, arguments: Column, schemas=None) -> Column:
    """What is wrong with the arguments: an array of codes, empty if they are valid.

    A text that is no JSON or more than one value, and one with a key twice in an object, is
    ``not_json``; JSON other than an object is ``not_object``. JSON null is a
    value of the wrong type.
    """
    schemas = SCHEMAS if schemas is None else schemas
    value_of = parsed(arguments)
    known = name.isin([F.lit(s) for s in schemas]) if schemas else F.lit(False)
    is_object = F.coalesce(F.schema_of_variant(value_of).startswith("OBJECT"), F.lit(False))
    codes = [
        F.when(~F.coalesce(known, F.lit(False)), F.lit("unknown_tool")),
        F.when(value_of.isNull(), F.lit("not_json")).when(~is_object, F.lit("not_object")),
    ]
    for tool, fields in schemas.items():
        here = (name == tool) & is_object
        for argument, (kind, needed, most) in fields.items():
            value = F.try_variant_get(value_of, f"$['{argument}']", "variant")
            text = F.try_variant_get(value_of, f"$['{argument}']", "string")
            bad = F.when(value.isNull(), F.lit(f"missing:{argument}") if needed else F.lit(None))
            bad = bad.when(~F.schema_of_variant(value).startswith(kind), F.lit(f"type:{argument}"))
            if kind == "STRING":
                bad = bad.when(F.length(F.trim(text)) == 0, F.lit(f"empty:{argument}"))
                if most is not None:
                    bad = bad.when(F.length(text) > most, F.lit(f"long:{argument}"))
            codes.append(F.when(here, bad))
        other = F.array_except(F.json_object_keys(F.to_json(value_of)), F.array(*[F.lit(a) for a in fields]).cast("array<string>"))
        codes.append(F.when(here & (F.size(other) > 0), F.concat(F.lit("unexpected:"), F.array_join(F.array_sort(other), ","))))
    return F.array_compact(F.array(*codes))


def chains(known: DataFrame) -> DataFrame:
    """Of each call (conv_id, call_id): ``depth``, the answered calls before it
    in its chain; ``upto``, the latest turn of those and their results; and
    ``cyclic``, whether the chain runs in a circle (then it counts as without).

    ``known``: conv_id, call_id, turn, last (turn of the last result, or null)
    and after. Each round joins the reach of a call to that of the call which
    it reaches, so there are as many rounds as the length of the longest chain
    has binary digits, and a reach longer than all calls is a circle.
    """
    key = ["conv_id", "call_id"]
    target = known.where("last is not null").select("conv_id", F.col("call_id").alias("after"), F.greatest("turn", "last").alias("up"))
    now = known.select(*key, "after").join(target.hint("shuffle_hash"), ["conv_id", "after"], "left")
    now = stored(now.select(*key, F.when(F.col("up").isNotNull(), F.col("after")).alias("jump"), F.col("up").alias("upto"), F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("depth")), "call-chains")
    calls, reach = None, 1
    while now.where("jump is not null").limit(1).count():
        calls = now.count() if calls is None else calls
        if reach > calls:
            break
        there = now.where("jump is not null or depth > 0").select("conv_id", F.col("call_id").alias("jump"), F.col("jump").alias("next"), F.col("upto").alias("u"), F.col("depth").alias("n"))
        wide = now.join(there.hint("shuffle_hash"), ["conv_id", "jump"], "left")
        now = stored(wide.select(*key, F.col("next").alias("jump"), F.greatest("upto", "u").alias("upto"), (F.col("depth") + F.coalesce("n", F.lit(0))).alias("depth")), "call-chains")
        reach *= 2
    open_ = F.col("jump").isNotNull()
    return now.select(*key, F.when(~open_, F.col("upto")).alias("upto"), F.when(open_, F.lit(0)).otherwise(F.col("depth")).alias("depth"), open_.alias("cyclic"))


def link(calls: DataFrame, results: DataFrame, schemas=None) -> DataFrame:
    """Links results to calls and gives every message its place and JSON.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text) and, if
    wanted, after (the call_id whose result the call needs). ``results``:
    conv_id, turn, call_id, content. Rows: conv_id, turn, kind (1 call, 2
    result), call_id, linked, valid, order_turn, order_level, order_kind, json.
    In the order of these three a result comes after its call, also where its
    turn is smaller, and a call after all results of the calls in its chain.

    Of calls with one id the first by (turn, name, arguments) is linked to and
    has a chain; others stay, unlinked, as do results without a call. A call is
    linked if a result has its id. ``after`` that names no answered call counts
    as none; calls in a circle are found ``cycle``. Null ids link with nothing.
    Repeated rows are kept, other columns ignored whatever their names, texts
    may be of any length; empty tables give no rows.
    """
    key = ["conv_id", "call_id"]
    calls = calls.select(*key, "turn", "name", "arguments", (F.col("after") if "after" in calls.columns else F.lit(None)).cast("string").alias("after"))
    results = results.select(*key, "turn", "content")
    answered = results.where("call_id is not null").groupBy(*key).agg(F.max("turn").alias("last"), F.count(F.lit(1)).alias("answers"))
    first = calls.where("call_id is not null").groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("first"))
    known = stored(first.join(answered.hint("shuffle_hash"), key, "left"), "calls-known")
    known = known.join(chains(known.select(*key, "first.turn", "last", "first.after")).hint("shuffle_hash"), key, "left")
    known = known.select(*key, "first", "answers", "upto", "depth", "cyclic")
    level = 2 * F.coalesce("depth", F.lit(0))

    c = calls.join(known.hint("shuffle_hash"), key, "left")
    # equality of the argument texts keeps a second, different call of the id apart
    is_first = F.coalesce(F.struct("turn", "name", "arguments", "after").eqNullSafe(F.col("first")), F.lit(False))
    c = c.withColumn("own", is_first).withColumn("bad", violations(F.col("name"), F.col("arguments"), schemas))
    c = c.withColumn("bad", F.when(F.col("own") & F.col("cyclic"), F.array_append("bad", F.lit("cycle"))).otherwise(F.col("bad")))

    def call_json(arguments: Column) -> Column:
        return F.to_json(F.struct(arguments.alias("arguments"), F.col("call_id").alias("id"), "name", F.lit("call").alias("type"), F.col("bad").alias("violations")), KEEP_NULLS)

    value = parsed(F.col("arguments"))
    c = c.select(
        "conv_id", "turn", F.lit(CALL).alias("kind"), "call_id", (F.col("answers").isNotNull() & F.col("own")).alias("linked"), (F.size("bad") == 0).alias("valid"),
        F.when(F.col("own"), F.greatest("turn", "upto")).otherwise(F.col("turn")).alias("order_turn"), F.when(F.col("own"), level).otherwise(0).cast("long").alias("order_level"), F.lit(CALL).alias("order_kind"),
        F.when(value.isNotNull(), call_json(value)).otherwise(call_json(F.col("arguments"))).alias("json"),
    )
    r = results.join(known.hint("shuffle_hash"), key, "left")
    result_json = F.to_json(F.struct("content", F.col("call_id").alias("id"), F.lit("result").alias("type")), KEEP_NULLS)
    r = r.select(
        "conv_id", "turn", F.lit(RESULT).alias("kind"), "call_id", F.col("first").isNotNull().alias("linked"), F.lit(True).alias("valid"),
        F.greatest("turn", "first.turn", "upto").alias("order_turn"), (level + 1).cast("long").alias("order_level"), F.lit(RESULT).alias("order_kind"), result_json.alias("json"),
    )
    return c.unionByName(r)


def link_conversations(messages: DataFrame, schemas=None) -> DataFrame:
    """The messages of a chat table as calls and results.

    A user turn is a call of the tool ``reply`` with the text as ``prompt``; an
    assistant turn is the result of the call at the turn before it, and a call
    needs the result of the call two turns before it, if there is one. Other
    roles (null too) are plain text. A null text gives no prompt, which the
    schema finds missing; a null conv_id or turn links with nothing.
    """
    m = messages.select("conv_id", "turn", "role", "text")
    ident = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    turn = F.col("turn")
    calls = m.where("role = 'user'").select("conv_id", "turn", ident(turn).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"))).alias("arguments"), ident(turn - 2).alias("after"))
    results = m.where("role = 'assistant'").select("conv_id", "turn", ident(turn - 1).alias("call_id"), F.col("text").alias("content"))
    rest = m.where("role is null or role not in ('user', 'assistant')").select(
        "conv_id", "turn", F.lit(TEXT).alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(False).alias("linked"), F.lit(True).alias("valid"),
        turn.alias("order_turn"), F.lit(0).cast("long").alias("order_level"), F.lit(TEXT).alias("order_kind"),
        F.to_json(F.struct(F.col("text").alias("content"), "role", F.lit("text").alias("type")), KEEP_NULLS).alias("json"),
    )
    return link(calls, results, schemas).unionByName(rest)


def op10_tool_calls(spark, sf_dir: str) -> DataFrame:
    return link_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP10_SQL = """
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text FROM conversations),
c AS (SELECT *, conv_id::VARCHAR || ':' || turn::VARCHAR AS call_id FROM m WHERE role = 'user'),
r AS (SELECT *, conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR AS call_id FROM m WHERE role = 'assistant'),
n AS (SELECT conv_id, turn, call_id, (conv_id, call_id) IN (SELECT (conv_id, call_id) FROM r) AS answered FROM c GROUP BY ALL),
h AS (
  SELECT n.conv_id, n.turn, n.answered, 0 AS depth FROM n LEFT JOIN n p ON p.conv_id = n.conv_id AND p.turn = n.turn - 2 AND p.answered WHERE p.turn IS NULL
  UNION ALL
  SELECT n.conv_id, n.turn, n.answered, h.depth + 1 FROM h JOIN n ON n.conv_id = h.conv_id AND n.turn = h.turn + 2 WHERE h.answered),
v AS (SELECT *, CASE WHEN text IS NULL THEN 'missing:prompt' WHEN length(trim(text, ' ')) = 0 THEN 'empty:prompt'
        WHEN length(text) > 2000 THEN 'long:prompt' ELSE '' END AS bad FROM c)
SELECT v.conv_id, v.turn, 1 AS kind, v.call_id, n.answered AS linked, bad = '' AS valid,
  v.turn AS order_turn, (2 * h.depth)::BIGINT AS order_level, 1 AS order_kind,
  '{"arguments":' || CASE WHEN text IS NULL THEN '{}' ELSE to_json({'prompt': text})::VARCHAR END || ',"id":' || to_json(v.call_id)::VARCHAR
  || ',"name":"reply","type":"call","violations":[' || CASE WHEN bad = '' THEN '' ELSE '"' || bad || '"' END || ']}' AS json
FROM v JOIN n USING (conv_id, turn) JOIN h USING (conv_id, turn)
UNION ALL
SELECT r.conv_id, r.turn, 2, r.call_id, h.turn IS NOT NULL, TRUE, greatest(r.turn, h.turn), (2 * coalesce(h.depth, 0) + 1)::BIGINT, 2,
  to_json({'content': r.text, 'id': r.call_id, 'type': 'result'})::VARCHAR
FROM r LEFT JOIN h ON r.conv_id = h.conv_id AND r.turn - 1 = h.turn
UNION ALL
SELECT conv_id, turn, 0, NULL, FALSE, TRUE, turn, 0, 0, to_json({'content': text, 'role': role, 'type': 'text'})::VARCHAR
FROM m WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""
