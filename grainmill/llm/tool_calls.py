"""Tool-call linking and canonical chat lines, in DataFrame operations alone.

A turn whose text is a JSON object with ``tool_calls`` makes calls, a turn of
role ``tool`` (or an object with ``tool_call_id``) is a result. Calls and
results are joined by conversation and identifier, calls are ordered after the
calls they depend on, arguments are checked against schemas, and every message,
call and result becomes one line of canonical JSON: sorted keys, no spaces.

A line carries its place as (``turn``, ``level``), so a conversation is put in
order by sorting its lines and no conversation is gathered into one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.plans.workspace import Workspace

_LINE = ["conv_id", "turn", "level", "kind", "call_id", "status", "errors", "json"]
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY", "null": "VOID"}


def canonical_json(text: Column) -> Column:
    """A JSON text with sorted keys and without spaces; null if it is not JSON or repeats a key."""
    return F.to_json(F.try_parse_json(text))


def _field(variant: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(variant, path, kind)


def parse_calls(turns: DataFrame) -> DataFrame:
    """One row a call: conversation, turn, place in the turn, id, name, arguments and the ids it depends on."""
    calls = turns.where("is_call").select("conv_id", "turn", F.posexplode(_field(F.col("v"), "$.tool_calls", "array<variant>")).alias("place", "c"))
    given = F.coalesce(_field(F.col("c"), "$.arguments", "variant"), _field(F.col("c"), "$.function.arguments", "variant"))
    calls = calls.withColumn("given", given)
    args = F.when(F.schema_of_variant("given") == "STRING", F.try_parse_json(_field(F.col("given"), "$"))).otherwise(F.col("given"))
    calls = calls.select(
        "conv_id",
        "turn",
        "place",
        _field(F.col("c"), "$.id").alias("call_id"),
        F.coalesce(_field(F.col("c"), "$.name"), _field(F.col("c"), "$.function.name")).alias("name"),
        args.alias("args"),
        _field(F.col("c"), "$.depends_on", "array<string>").alias("named"),
    )
    refs = F.regexp_extract_all(F.to_json("args"), F.lit(r'"\$ref":"([^"\\]+)"'), F.lit(1))
    empty = F.array().cast("array<string>")
    return calls.withColumn("needs", F.array_distinct(F.concat(F.coalesce("named", empty), F.coalesce(refs, empty)))).drop("named")


def call_levels(calls: DataFrame, space: Workspace) -> DataFrame:
    """Of calls (conv_id, call_id, turn, needs): the turn and level to place each at, after all it depends on; a cycle has null levels.

    Runs one small job for each link of the longest chain of dependencies.
    """
    known = calls.select("conv_id", "call_id", F.col("turn").alias("at"))
    edges = calls.select("conv_id", "call_id", F.explode("needs").alias("need")).join(known.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_semi")
    edges = space.table("edges", edges.distinct())
    waiting = edges.select("conv_id", "call_id").distinct()
    done = known.join(waiting, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0))
    if edges.isEmpty():
        return done
    done, step = space.table("levels0", done), 0
    while True:
        met = edges.join(done.select("conv_id", F.col("call_id").alias("need"), F.col("at").alias("need_at"), F.col("level").alias("need_level")), ["conv_id", "need"], "left")
        ready = met.join(done.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").groupBy("conv_id", "call_id").agg(F.max(F.struct("need_at", "need_level")).alias("m"), F.count_if(F.col("need_level").isNull()).alias("open")).where("open = 0")
        placed = ready.join(known, ["conv_id", "call_id"]).select("conv_id", "call_id", F.greatest("at", "m.need_at").alias("at"), F.expr("CASE WHEN m.need_at >= at THEN m.need_level + 1 ELSE 0 END").alias("level"))
        new = space.table(f"new{step}", placed)
        if new.isEmpty():
            break
        step += 1
        done = space.table(f"levels{step}", done.unionByName(new))
    return known.join(done.drop("at"), ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(None).cast("int")).unionByName(done)


def argument_errors(name: Column, args: Column, fields: Column) -> Column:
    """What is wrong with arguments, given the tool's fields: array<struct<field, type, required>>, null for an unknown tool."""
    have = F.try_variant_get(args, "$", "map<string,variant>")

    def one(f: Column) -> Column:
        value = have[f["field"]]
        kind = F.schema_of_variant(value)
        wrong = value.isNotNull() & ~F.rlike(kind, F.concat(F.lit("^("), F.element_at(F.create_map(*[F.lit(x) for p in _TYPES.items() for x in p]), f["type"]), F.lit(")")))
        return F.when(~F.map_contains_key(have, f["field"]), F.when(f["required"], F.concat(F.lit("missing "), f["field"]))).when(wrong, F.concat(F.lit("not "), f["type"], F.lit(": "), f["field"]))

    return F.when(fields.isNull(), F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit(""))))).when(have.isNull(), F.array(F.lit("arguments are no object"))).otherwise(F.array_compact(F.transform(fields, one)))


def with_calls(turns: DataFrame) -> DataFrame:
    """Conversations in which every assistant's turn makes two calls, one on the other's result, and tools answer.

    A turn's text becomes ``content`` beside ``tool_calls``: ``file``, named first, refers to ``measure``. By the crc32 of
    ``conv_id:turn`` mod 10, 0 leaves out the title to file under, 1 gives its size as text, 2 loses the answer to
    ``measure``, 3 answers ``file`` once more a turn later, and 4 answers a call that nobody made. Texts that are objects
    already, other roles and rows without conv_id or turn stay as they are.
    """
    base = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    plain = F.expr("coalesce(role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL AND NOT coalesce(rlike(text, '^\\\\s*[{]'), false), false)")
    draw = F.when(plain, F.pmod(F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), "turn").cast("binary")), F.lit(10)))
    base = base.withColumn("draw", draw).withColumns({k: F.concat(F.col("turn").cast("string"), F.lit(k)) for k in ("m", "f", "x")})
    size = F.coalesce(F.length("text"), F.lit(0))
    filed = lambda n: F.to_json(F.struct(F.struct(F.col("m").alias("$ref")).alias("measured"), n.alias("size"), F.when(F.col("draw") != 0, F.concat(F.lit("turn "), "turn")).alias("title")))
    file = F.struct(F.col("f").alias("id"), F.lit("file").alias("name"), F.when(F.col("draw") == 1, filed(size.cast("string"))).otherwise(filed(size)).alias("arguments"))
    measure = F.struct(F.col("m").alias("id"), F.lit("measure").alias("name"), F.to_json(F.struct(F.col("turn"), F.lit("characters").alias("unit"))).alias("arguments"))
    made = F.to_json(F.struct(F.col("text").alias("content"), F.array(file, measure).alias("tool_calls")))
    answer = lambda id_, later=0: F.struct((F.col("turn") + later).alias("turn"), F.to_json(F.struct(size.alias("content"), F.col(id_).alias("tool_call_id"))).alias("text"))
    answers = F.array_compact(F.array(F.when(F.col("draw") != 2, answer("m")), answer("f"), F.when(F.col("draw") == 3, answer("f", 1)), F.when(F.col("draw") == 4, answer("x"))))
    given = base.where("draw IS NOT NULL").select("conv_id", F.explode(answers).alias("a")).select("conv_id", "a.turn", F.lit("tool").alias("role"), "a.text")
    return base.select("conv_id", "turn", "role", F.when(F.col("draw").isNotNull(), made).otherwise(F.col("text")).alias("text")).unionByName(given)


def chat_lines(turns: DataFrame, schemas: Mapping[str, Mapping[str, object]] | None = None) -> DataFrame:
    """Canonical lines of conversations (``conv_id``, ``turn``, ``role``, ``text``).

    ``schemas`` maps a tool's name to {"properties": {field: type}, "required":
    [field]}; None checks nothing. Returns ``conv_id``, ``turn``, ``level``,
    ``kind`` (message, call or result), ``call_id``, ``status``, ``errors`` and
    ``json``. Sorted by turn, level and json, a call follows the message that makes
    it and all calls it depends on, and a result follows its call.

    Statuses of calls: linked, no_result, duplicate_call (an id used before in the
    conversation), cycle, no_id. Of results: linked, duplicate_result (not the
    first), orphan; a turn of role ``tool`` that names no call is one, its whole text the content. Texts that are not JSON, or repeat a key, are messages as they
    are. Null roles and texts stay null in their line; rows without conv_id are
    never linked. Repeated rows are repeated lines. An empty table gives none.
    Other columns are ignored.
    """
    space = Workspace(turns.sparkSession, "chat")
    text = F.col("text").cast("string")
    base = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text"))
    looks = F.col("text").rlike(r"^\s*\{")
    base = base.withColumn("v", F.when(looks, F.try_parse_json("text")))
    base = base.withColumn("result_id", _field(F.col("v"), "$.tool_call_id")).withColumn("is_result", F.expr("result_id IS NOT NULL OR coalesce(role = 'tool', false)")).withColumn("is_call", F.coalesce(F.size(_field(F.col("v"), "$.tool_calls", "array<variant>")) > 0, F.lit(False)))
    none, no_errors = F.lit(None).cast("string"), F.array().cast("array<string>")

    message = F.to_json(F.struct(F.when(F.col("is_call"), _field(F.col("v"), "$.content")).otherwise(F.col("text")).alias("content"), F.col("role").alias("role")), {"ignoreNullFields": "false"})
    messages = base.where("NOT is_result").select("conv_id", "turn", F.lit(0).alias("level"), F.lit("message").alias("kind"), none.alias("call_id"), none.alias("status"), no_errors.alias("errors"), message.alias("json"))

    calls = parse_calls(base)
    if calls.isEmpty() and base.where("is_result").isEmpty():
        return messages.select(*_LINE)
    whole = _field(F.try_parse_json(F.to_json(F.struct("text"))), "$.text", "variant")
    content = F.when(F.col("result_id").isNull(), whole).otherwise(_field(F.col("v"), "$.content", "variant"))
    results = base.where("is_result").select("conv_id", "turn", F.col("result_id").alias("call_id"), content.alias("content"))
    calls, results = space.table("calls", calls), space.table("results", results)

    first = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "place", "needs")).alias("f")).select("conv_id", "call_id", "f.*")
    first = space.table("first", first)
    levels = space.table("placed", call_levels(first, space))
    answered = results.groupBy("conv_id", "call_id").agg(F.min("turn").alias("answer_turn"))
    linked = space.table("linked", levels.join(answered, ["conv_id", "call_id"], "left"))

    if schemas is None:
        checked = calls.withColumn("errors", no_errors)
    else:
        rows = [(tool, [(f, str(t), f in s.get("required", ())) for f, t in s.get("properties", {}).items()]) for tool, s in schemas.items()]
        table = turns.sparkSession.createDataFrame(rows, "tool string, fields array<struct<field: string, type: string, required: boolean>>")
        checked = calls.join(table, F.col("name") == F.col("tool"), "left").withColumn("errors", argument_errors(F.col("name"), F.col("args"), F.col("fields")))
    own = first.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("turn").alias("t"), F.col("place").alias("p"))
    checked = checked.join(own, F.expr("conv_id = c AND call_id = i AND turn = t AND place = p"), "left")
    checked = checked.join(linked.select(F.col("conv_id").alias("lc"), F.col("call_id").alias("li"), "at", F.col("level").alias("depth"), "answer_turn"), F.expr("conv_id = lc AND call_id = li"), "left")
    status = F.expr("CASE WHEN call_id IS NULL OR conv_id IS NULL THEN 'no_id' WHEN i IS NULL THEN 'duplicate_call' WHEN depth IS NULL THEN 'cycle' WHEN answer_turn IS NULL THEN 'no_result' ELSE 'linked' END")
    call_json = F.to_json(F.struct(F.col("args").alias("arguments"), F.col("call_id").alias("id"), F.col("name").alias("name")), {"ignoreNullFields": "false"})
    call_lines = checked.withColumn("status", status).select("conv_id", F.expr("CASE WHEN status IN ('linked', 'no_result') THEN at ELSE turn END").alias("turn"), F.expr("CASE WHEN status IN ('linked', 'no_result') THEN 1 + 2 * depth ELSE 1 END").alias("level"), F.lit("call").alias("kind"), "call_id", "status", "errors", call_json.alias("json"))

    found = results.join(linked.select(F.col("conv_id").alias("lc"), F.col("call_id").alias("li"), "at", "level", "answer_turn"), F.expr("conv_id = lc AND call_id = li"), "left")
    result_status = F.expr("CASE WHEN li IS NULL THEN 'orphan' WHEN turn > answer_turn THEN 'duplicate_result' ELSE 'linked' END")
    result_json = F.to_json(F.struct(F.col("content"), F.col("call_id").alias("tool_call_id")), {"ignoreNullFields": "false"})
    result_lines = found.withColumn("status", result_status).select("conv_id", F.expr("CASE WHEN status = 'linked' AND level IS NOT NULL THEN at ELSE turn END").alias("turn"), F.expr("CASE WHEN status = 'linked' AND level IS NOT NULL THEN 2 + 2 * level ELSE 2 END").alias("level"), F.lit("result").alias("kind"), "call_id", "status", no_errors.alias("errors"), result_json.alias("json"))
    return messages.select(*_LINE).unionByName(call_lines.select(*_LINE)).unionByName(result_lines.select(*_LINE))
