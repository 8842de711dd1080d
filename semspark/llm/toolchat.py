"""Tool calls of chats: linked with their results, ordered, checked against schemas and written as canonical JSON.

Native Spark functions only. Calls and results are hash-joined by identifier. The order is topological: a call stands
one level above the calls that it needs. Chains of calls with one need are measured by pointer doubling, the others
placed level by level until no call is left that can be placed. Arguments are parsed to variants, whose object keys
are sorted, so that equal arguments are written alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, short, written

#: Argument types by name, as ``schema_of_variant`` tells them.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}

#: Tools of the conversations' query: argument -> (type, required).
CONVERSATION_TOOLS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "words": ("integer", True)},
    "lookup": {"query": ("string", True), "words": ("integer", True), "lang": ("string", False)},
    "translate": {"query": ("string", True), "words": ("integer", True), "target": ("string", True)},
}


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _faults(value: Column, fields: dict[str, tuple], path: str) -> list[tuple[Column, Column]]:
    """(condition, message) of what may be wrong with an object's fields, in the order in which they count."""
    keys = F.map_keys(F.from_json(F.to_json(value), "map<string,string>"))
    missing, wrong, inner = [], [], []
    for field, (kind, required, *more) in sorted(fields.items()):
        own = F.try_variant_get(value, "$['" + field + "']", "variant")
        there = F.array_contains(keys, field)
        if required:
            missing.append((~there, F.lit(f"missing:{path}{field}")))
        wrong.append((there & ~F.coalesce(_kind(own).isin(list(TYPES[kind])), F.lit(False)), F.lit(f"type:{path}{field}")))
        for limit in more:
            if isinstance(limit, dict):
                inner += [(there & (_kind(own) == "OBJECT") & c, m) for c, m in _faults(own, limit, f"{path}{field}.")]
            else:
                plain = F.try_variant_get(own, "$", "string")
                inner.append((there & ~F.coalesce(plain.isin([str(x) for x in limit]), F.lit(False)), F.lit(f"value:{path}{field}")))
    unknown = F.array_sort(F.array_except(keys, F.array(*[F.lit(f) for f in fields]) if fields else F.array().cast("array<string>")))
    return [*missing, *wrong, (F.size(unknown) > 0, F.concat(F.lit(f"unknown:{path}"), F.get(unknown, 0))), *inner]


def argument_error(name: Column, arguments: Column, tools: dict[str, dict[str, tuple]]) -> Column:
    """What is wrong with a call's arguments (a variant): the first of unknown_tool, not_an_object, missing:x, type:x,
    unknown:x and, for fields with limits, value:x or the faults of x.y that applies; null if all is well.

    A field of a tool is (type, required), and may go on with a dictionary of fields for an object, whose names are
    written x.y, or with a list of the values that are allowed."""
    out = F.when(name.isNull() | ~name.isin(list(tools)), "unknown_tool").when(arguments.isNull() | (_kind(arguments) != "OBJECT"), "not_an_object")
    for tool, fields in tools.items():
        for condition, message in _faults(arguments, fields, ""):
            out = out.when((name == tool) & condition, message)
    return out


def _chain_ends(links: DataFrame, chained: DataFrame) -> DataFrame:
    """(conv_id, call_id, end, steps) of the calls with one need: the first call up the chain that has no need or
    several, and the steps to it. Calls whose chain runs into a cycle have no row.

    Pointer doubling: a round joins each open pointer with the pointer of the call that it points to, so a chain of n
    calls takes log2(n) rounds. A pointer still open after more steps than the conversation has chained calls is on a
    cycle or leads into one.
    """
    spark = links.sparkSession
    alone = chained.select("conv_id", F.col("call_id").alias("end"), F.lit(True).alias("goes_on"))
    own = links.join(chained, ["conv_id", "call_id"], "left_semi").select("conv_id", "call_id", F.col("need").alias("end"), F.lit(1).alias("steps"))
    pointers = written(own.join(alone, ["conv_id", "end"], "left").select("conv_id", "call_id", "end", "steps", F.col("goes_on").isNull().alias("ended")), "chains")
    longest = chained.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach <= longest and pointers.where("not ended").take(1):
        old = pointers
        further = old.select("conv_id", F.col("call_id").alias("end"), F.col("end").alias("next"), F.col("steps").alias("more"), F.col("ended").alias("at_end"))
        moved = old.where("not ended").join(further, ["conv_id", "end"]).select("conv_id", "call_id", F.col("next").alias("end"), (F.col("steps") + F.col("more")).alias("steps"), F.col("at_end").alias("ended"))
        pointers = written(old.where("ended").unionByName(moved), "chains")
        forget(spark, old)
        reach *= 2
    return pointers.where("ended").drop("ended")


def topological_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that need none, else one more than the highest call needed.

    ``calls`` has distinct (conv_id, call_id) and needs (array of call ids of the conversation). Needs of calls that
    are not there, and null needs, count as met. Calls on a cycle, and those that need them, have no row. Chains of
    calls with one need are first contracted to one weighted step; then a round joins the calls placed in the round
    before with the needs still open of calls with several, so rounds grow with the depth of such calls alone.
    """
    spark = calls.sparkSession
    nodes = calls.select("conv_id", "call_id")
    links = calls.select("conv_id", "call_id", F.explode("needs").alias("need")).distinct().join(nodes.withColumnRenamed("call_id", "need"), ["conv_id", "need"])
    links = written(links, "needs")
    needs = written(links.groupBy("conv_id", "call_id").count(), "counts")
    ends = _chain_ends(links, needs.where("count = 1").drop("count"))
    several = links.join(needs.where("count > 1").drop("count"), ["conv_id", "call_id"], "left_semi")
    # A need on a cycle has no end and stays itself: it is never placed.
    skipped = several.join(ends.withColumnsRenamed({"call_id": "need"}), ["conv_id", "need"], "left")
    open_ = written(skipped.select("conv_id", "call_id", F.coalesce("end", "need").alias("need"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"), F.lit(None).cast("int").alias("level")), "open")
    placed = written(nodes.join(needs, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "levels")
    done = placed
    while placed.take(1) and open_.take(1):
        met = open_.join(placed.select("conv_id", F.col("call_id").alias("need"), F.col("level").alias("at")), ["conv_id", "need"], "left")
        met = written(met.select("conv_id", "call_id", "need", "steps", F.coalesce("level", F.col("at") + F.col("steps")).alias("level")), "open")
        ready = met.groupBy("conv_id", "call_id").agg(F.max("level").alias("level"), F.count_if(F.col("level").isNull()).alias("left"))
        placed = written(ready.where("left = 0").drop("left"), "levels")
        old, open_ = open_, written(met.join(placed, ["conv_id", "call_id"], "left_anti"), "open")
        forget(spark, old)
        forget(spark, met)
        done = done.union(placed)
    chained = ends.join(done.withColumnRenamed("call_id", "end"), ["conv_id", "end"]).select("conv_id", "call_id", (F.col("level") + F.col("steps")).alias("level"))
    return done.union(chained)


def positions(placed: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, position) of the calls (conv_id, call_id, turn, level): 1, 2, ... in each conversation.

    Calls are dealt out to ranges of their order, so a conversation with a third of all calls is spread over many
    tasks. A call's position is its number within its range after the calls of its conversation in ranges before.
    """
    order = ["conv_id", "level", "turn", "call_id"]
    ranged = written(placed.repartitionByRange(*order).withColumn("run", F.spark_partition_id()), "ranges")
    runs = ranged.groupBy("conv_id", "run").agg(F.count("*").alias("calls"))
    # A row for each conversation and range; only conversations cut by a range have several.
    before = F.sum("calls").over(Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    later = written(runs.withColumn("before", before).where("before is not null").select("conv_id", "run", "before"), "before")
    within = F.row_number().over(Window.partitionBy("conv_id", "run").orderBy("level", "turn", "call_id"))
    numbered = ranged.withColumn("within", within).join(short(later), ["conv_id", "run"], "left")
    return numbered.select("conv_id", "call_id", "level", (F.col("within") + F.coalesce("before", F.lit(0))).cast("int").alias("position"))


def link_tool_calls(calls: DataFrame, results: DataFrame, tools: dict[str, dict[str, tuple]]) -> DataFrame:
    """(conv_id, call_id, level, position, tool, status, error, message), a row for each identifier of a conversation.

    ``calls`` has conv_id, call_id, turn, name, arguments (JSON text) and needs (array of call ids); ``results`` has
    conv_id, call_id, turn and content. Of calls, and of results, that repeat an identifier the first by turn, then
    by content counts. status: ``ok``, ``invalid`` (see error), ``no_result``, ``cycle``, or ``orphan_result`` for a
    result without a call; the first of cycle, invalid, no_result counts. position numbers a conversation's calls from
    1 by level, turn and identifier; calls on cycles and orphans have none. message is the canonical JSON of call and
    result: keys sorted, no spaces. Rows with a null conv_id or call_id are ignored; a null text is JSON null. Empty
    tables give no rows. Extra columns are ignored.
    """
    known = "conv_id is not null and call_id is not null"
    one = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy("turn", *by))).where("_n = 1").drop("_n")
    made = calls.where(known).select("conv_id", "call_id", "turn", "name", F.col("arguments").alias("raw"), F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))
    made = written(one(made, "name", "raw"), "calls")
    answers = one(results.where(known).select("conv_id", "call_id", F.col("turn").alias("turn"), "content"), "content")
    answers = answers.select("conv_id", "call_id", "content", F.lit(True).alias("answered"))
    levels = positions(made.select("conv_id", "call_id", "turn").join(topological_levels(made), ["conv_id", "call_id"]))
    joined = made.join(levels, ["conv_id", "call_id"], "left").join(answers, ["conv_id", "call_id"], "full")
    joined = joined.withColumn("arguments", F.try_parse_json("raw"))
    is_call = F.col("needs").isNotNull()
    error = F.when(is_call, argument_error(F.col("name"), F.col("arguments"), tools))
    status = F.when(~is_call, "orphan_result").when(F.col("level").isNull(), "cycle").when(F.col("error").isNotNull(), "invalid").when(F.col("answered").isNull(), "no_result").otherwise("ok")
    # to_json has no form for a bare string, so the string is taken out of an array's brackets.
    bare = lambda c: F.when(c.isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", ""))
    message = F.concat(
        F.lit('{"arguments":'),
        F.coalesce(F.to_json("arguments"), bare(F.col("raw"))),
        F.lit(',"id":'),
        bare(F.col("call_id")),
        F.lit(',"result":'),
        bare(F.col("content")),
        F.lit(',"tool":'),
        bare(F.col("name")),
        F.lit("}"),
    )
    out = joined.withColumn("error", error).withColumn("status", status).withColumn("message", message)
    return out.select("conv_id", "call_id", "level", "position", F.col("name").alias("tool"), "status", "error", "message")


def calls_of_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns as tool calls and results: a user's turn calls a tool with its text, and an assistant's turn is the
    result of the turn before it. A call needs the conversation's user turn before, two turns earlier, if there is one.
    """
    turns = conversations.where("conv_id is not null and turn is not null").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    ident = lambda n: F.concat(F.lit("call_"), n.cast("string"))
    users = turns.where("role = 'user'")
    digit = F.conv(F.substring(F.md5("text"), 1, 2), 16, 10).cast("int")
    names = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("translate")), F.pmod(digit, F.lit(3)) + 1)
    raw = F.to_json(F.struct(F.size(F.split("text", " ")).cast("long").alias("words"), F.col("text").alias("query")))
    calls = users.select("conv_id", ident(F.col("turn")).alias("call_id"), "turn", names.alias("name"), raw.alias("arguments"), F.array(ident(F.col("turn") - 2)).alias("needs"))
    results = turns.where("role = 'assistant'").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
