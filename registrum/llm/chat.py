"""Chat formatting with tool calls, in DataFrame operations only: calls and results are hash-joined by identifier, put into a
topological order, checked against schemas, and messages written as canonical JSON."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registrum.llm._shared import scratch, staged

SCHEMA = "tool string, param string, kind string, required boolean"
_LAST = 2**63 - 1


def canonical(json: Column) -> Column:
    """The JSON with object keys sorted and no white space; null where it is none."""
    return F.to_json(F.try_parse_json(json))


def _message_key(m: DataFrame) -> Column:
    """A hash that tells null from other values by its place; repeated rows share it."""
    columns = [m[c] for c in ("conv_id", "turn", "role", "text")]
    return F.xxhash64(*(c.isNull() for c in columns), *columns)


def _got(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, F.lit(path), kind)


def _as_text(value: Column) -> Column:
    """A string as it is, another value as its JSON."""
    return F.when(F.schema_of_variant(value) == "STRING", _got(value, "$", "string")).otherwise(F.to_json(value))


def parsed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, key, held, calls, answers): the members of a text that is a JSON object, its list of calls, and the
    identifier of the call that it answers."""
    rows = messages.select(messages["conv_id"], messages["turn"], messages["role"], messages["text"], _message_key(messages).alias("key"))
    rows = rows.withColumn("held", F.when(F.col("text").rlike(r"^\s*\{"), F.from_json("text", "map<string,variant>")))
    member = lambda name, kind: _got(F.element_at("held", F.lit(name)), "$", kind)
    return rows.withColumn("calls", member("tool_calls", "array<variant>")).withColumn("answers", member("tool_call_id", "string"))


def calls_of(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, key, no, id, name, arguments) of parsed messages: every call once, whether its name and arguments are its own or in
    an object `function`. Arguments are canonical JSON; what is none stays as it is written."""
    listed = messages.where(F.size("calls") > 0).select("conv_id", "turn", "key", F.posexplode("calls").alias("no", "c"))
    either = lambda name, kind: F.coalesce(_got(F.col("c"), f"$.{name}", kind), _got(F.col("c"), f"$.function.{name}", kind))
    given = _as_text(either("arguments", "variant"))
    told = listed.select("conv_id", "turn", "key", "no", _got(F.col("c"), "$.id", "string").alias("id"), either("name", "string").alias("name"), given.alias("given"))
    return told.select("conv_id", "turn", "key", "no", "id", "name", F.coalesce(canonical(F.col("given")), F.col("given")).alias("arguments")).distinct()


def _arguments(calls: DataFrame) -> DataFrame:
    return calls.select("*", F.explode(F.from_json("arguments", "map<string,variant>")).alias("param", "value"))


def check_arguments(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(key, no, valid): true if the tool is known, its arguments are a JSON object, every required parameter is there, no other is unknown,
    and each has its kind (STRING, BIGINT, DOUBLE, BOOLEAN, ARRAY, OBJECT)."""
    kind = F.regexp_extract(F.schema_of_variant("value"), r"^[A-Z]+", 0)
    given = _arguments(calls).select("key", "no", F.col("name").alias("tool"), "param", F.when(kind == "DECIMAL", F.lit("DOUBLE")).otherwise(kind).alias("is"))
    wide = (F.col("kind") == F.col("is")) | ((F.col("kind") == "DOUBLE") & (F.col("is") == "BIGINT"))
    met = given.join(schemas, ["tool", "param"], "left").groupBy("key", "no").agg(
        F.count_if(F.col("kind").isNull() | ~wide).alias("n_bad"), F.count_if(F.col("required") & F.col("kind").isNotNull()).alias("n_required")
    )
    tools = schemas.groupBy("tool").agg(F.count_if("required").alias("n_needed"))
    known = calls.select("key", "no", F.col("name").alias("tool"), "arguments").join(tools, "tool", "left").join(met, ["key", "no"], "left")
    good = F.col("arguments").startswith("{") & F.try_parse_json("arguments").isNotNull() & (F.coalesce("n_bad", F.lit(0)) == 0) & (F.coalesce("n_required", F.lit(0)) == F.col("n_needed"))
    return known.select("key", "no", F.coalesce(good, F.lit(False)).alias("valid"))


def linked(calls: DataFrame, readers: DataFrame) -> DataFrame:
    """readers (conv_id, id, turn, key, kind) with the call message (call_key, call_turn) that has their identifier in their conversation:
    the last one before them, or else the first one. A null turn comes after all others; what finds no call is left out. Both
    sides are merged in one pass by conversation and identifier, so identifiers used over and over make no pairs."""
    made = calls.where(F.col("id").isNotNull()).select("conv_id", "id", "turn", "key").distinct()
    both = made.withColumn("kind", F.lit("call")).unionByName(readers.select("conv_id", "id", "turn", "key", "kind").where(F.col("conv_id").isNotNull() & F.col("id").isNotNull()))
    both = both.withColumn("at", F.coalesce("turn", F.lit(_LAST)))
    call = F.when(F.col("kind") == "call", F.struct("at", "key", F.col("turn").alias("call_turn")))
    group = Window.partitionBy("conv_id", "id")
    before = group.orderBy("at", F.col("kind") == "call", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("link", F.coalesce(F.last(call, True).over(before), F.min(call).over(group)))
    return met.where((F.col("kind") != "call") & F.col("link").isNotNull()).select("conv_id", "id", "turn", "key", "kind", F.col("link.key").alias("call_key"), "link.call_turn")


def topological(calls: DataFrame, results: DataFrame, uses: DataFrame) -> DataFrame:
    """(key, after_turn, depth, cyclic) of the messages that answer calls (results) and of calls that wait for answers (uses), both as
    linked() tells them.

    A result stands behind its call: it has the call's after_turn and a greater depth. A call that uses another's answer stands behind that
    call and its results: at its own turn, or, if that is not later, at theirs and deeper. So the order of (after_turn, depth, turn) is
    topological. Messages on a cycle, or behind one, are cyclic and stand at their own turns. Where every call comes after what it uses,
    that is said in one step; only conversations where one does not are worked off by generations, as many as their longest chain.
    """
    late = lambda turn: F.coalesce(turn, F.lit(_LAST))
    back = uses.where(late(F.col("turn")) <= late(F.col("call_turn"))).select("conv_id").distinct()
    # a message that both answers and calls waits like a call
    both = results.join(calls.select("key").distinct(), "key", "left_semi").select("key", F.lit(True).alias("calls"))
    answers = results.join(both, "key", "left")
    back = staged(back.unionByName(answers.where(F.col("calls") & (late(F.col("turn")) <= late(F.col("call_turn")))).select("conv_id")).distinct(), "back")
    plain = answers.join(back, "conv_id", "left_anti").groupBy("key").agg(F.max(late(F.col("call_turn"))).alias("after"), F.first("turn").alias("turn"), F.bool_or(F.coalesce("calls", F.lit(False))).alias("calls"))
    plain = plain.select("key", F.when(F.col("calls"), late(F.col("turn"))).otherwise(F.col("after")).alias("after"), F.when(F.col("calls"), 0).otherwise(1).alias("depth"), F.lit(False).alias("cyclic"))
    if back.isEmpty():
        return plain.select("key", F.nullif("after", F.lit(_LAST)).alias("after_turn"), "depth", "cyclic")

    # calls and answers are nodes (u, v) of messages; what a call's answers come to is a node of its own, so that no pairs are made
    held = lambda df: df.join(back, "conv_id", "left_semi")
    pool = F.xxhash64(F.lit("answers"), "call_key", "id")
    waits, answers, uses = F.lit("wait"), held(answers), held(uses)
    result = F.when(F.coalesce("calls", F.lit(False)), waits).otherwise(F.lit("result"))
    edges = answers.select(F.col("call_key").alias("u"), F.col("key").alias("v"), result.alias("kind"), "turn")
    pools = uses.select("call_key", "id").distinct()
    edges = edges.unionByName(pools.select(F.col("call_key").alias("u"), pool.alias("v"), F.lit("pool").alias("kind"), F.lit(None).cast("long").alias("turn")))
    edges = edges.unionByName(answers.join(pools, ["call_key", "id"], "left_semi").select(F.col("key").alias("u"), pool.alias("v"), F.lit("pool").alias("kind"), F.lit(None).cast("long").alias("turn")))
    edges = staged(edges.unionByName(uses.select(pool.alias("u"), F.col("key").alias("v"), waits.alias("kind"), "turn")).distinct(), "edges")
    roots = edges.select(F.col("u").alias("key")).distinct().join(edges.select(F.col("v").alias("key")).distinct(), "key", "left_anti")
    turns = calls.select("key", late(F.col("turn")).alias("after")).distinct()
    done = staged(roots.join(turns, "key").select("key", "after", F.lit(0).alias("depth")), "done")
    left = edges
    while True:
        told = left.join(done.select(F.col("key").alias("u"), "after", "depth"), "u", "left")
        ready = told.groupBy("v").agg(F.count_if(F.col("after").isNull()).alias("open"), F.max("kind").alias("kind"), F.max("turn").alias("turn"), F.max(F.struct("after", "depth")).alias("m")).where("open = 0")
        own = late(F.col("turn")) > F.col("m.after")
        after = F.when((F.col("kind") == "wait") & own, late(F.col("turn"))).otherwise(F.col("m.after"))
        depth = F.when(F.col("kind") == "pool", F.col("m.depth")).when((F.col("kind") == "wait") & own, 0).otherwise(F.col("m.depth") + 1)
        more = staged(ready.select(F.col("v").alias("key"), after.alias("after"), depth.alias("depth")), "ready")
        if more.isEmpty():
            break
        left = staged(left.join(more.select(F.col("key").alias("v")), "v", "left_anti"), "open")
        done = done.unionByName(more)
    cyclic = left.where("kind <> 'pool'").groupBy(F.col("v").alias("key")).agg(F.max(late(F.col("turn"))).alias("after")).select("key", "after", F.lit(0).alias("depth"), F.lit(True).alias("cyclic"))
    ordered = done.join(edges.where("kind <> 'pool'").select(F.col("v").alias("key")).distinct(), "key", "left_semi").withColumn("cyclic", F.lit(False))
    every = plain.unionByName(ordered).unionByName(cyclic)
    return every.select("key", F.nullif("after", F.lit(_LAST)).alias("after_turn"), "depth", "cyclic")


def positioned(rows: DataFrame) -> DataFrame:
    """rows with position, from 0 in each conversation in the order of (after_turn, depth, turn, key), nulls last; null without a
    conversation. Ranges of that order are numbered each by itself and then moved on by what lies before them, so that a
    conversation of very many messages is no single task."""
    order = [F.col("conv_id").asc_nulls_first(), *(F.col(c).asc_nulls_last() for c in ("after_turn", "depth", "turn")), F.col("key").asc()]
    laid = staged(rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "ordered")
    counts = laid.groupBy("conv_id", "part_").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    moved = staged(counts.withColumn("before", before).where("before > 0").select(F.col("conv_id").alias("conv_"), F.col("part_").alias("its_part"), "before"), "moved")
    here = F.row_number().over(Window.partitionBy("part_", "conv_id").orderBy(*order[1:]))
    numbered = laid.withColumn("here", here)
    # a row for each range that a conversation runs on into
    met = numbered.join(F.broadcast(moved), (F.col("conv_id") == F.col("conv_")) & (F.col("part_") == F.col("its_part")), "left")
    position = F.when(F.col("conv_id").isNotNull(), F.col("here") - 1 + F.coalesce("before", F.lit(0))).cast("long")
    return met.withColumn("position", position).drop("part_", "its_part", "conv_", "before", "here")


def _sorted_json(members: Column) -> Column:
    keys = F.filter(F.sort_array(F.map_keys(members)), lambda k: F.element_at(members, k).isNotNull())
    return F.to_json(F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(members, k)))))


def link_tools(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, turn, role, position, after_turn, depth, n_calls, n_valid, status, message) of every row of messages (conv_id, turn, role,
    text) with schemas (tool, param, kind, required).

    A message calls tools if its text is a JSON object with tool_calls, and is a result if it has a tool_call_id. A result is linked to the
    last call before it in its conversation that has its identifier, or else to the first one behind it. A call with an argument
    that is another call's identifier uses that call's answer. Order: see topological(); position is the place in it.

    status is call, result, orphan (a result without a call), cycle (waits for itself, or for what does) or plain. message is canonical JSON
    of every member that the text has, with conv_id, role, turn, and each call's id, name and arguments: sorted keys, nulls left out,
    arguments canonical where they are JSON. A null text is a message without content; a null conv_id links nothing and has no position;
    text that isn't a JSON object is plain; a null turn comes last; repeated rows each give a row and share their calls; an empty table
    gives none. Other columns are ignored. Conversations are never gathered: joins are by conversation and identifier together.
    """
    with scratch(messages.sparkSession) as keep:
        rows = parsed(messages)
        calls = staged(calls_of(rows), "calls")
        checked = calls.join(check_arguments(calls, schemas), ["key", "no"])
        tool_calls = F.transform(F.sort_array(F.collect_list(F.struct("no", "arguments", "id", "name"))), lambda c: F.struct(c["arguments"].alias("arguments"), c["id"].alias("id"), c["name"].alias("name")))
        per_message = staged(checked.groupBy("key").agg(F.count(F.lit(1)).alias("n_calls"), F.count_if("valid").alias("n_valid"), F.to_json(tool_calls).alias("tool_calls")), "per_message")

        results = rows.where(F.col("answers").isNotNull()).select("conv_id", F.col("answers").alias("id"), "turn", "key", F.lit("result").alias("kind")).distinct()
        uses = _arguments(calls).select("conv_id", _got(F.col("value"), "$", "string").alias("used"), F.schema_of_variant("value").alias("is"), "turn", "key", "id").where("`is` = 'STRING'")
        uses = uses.select("conv_id", F.col("used").alias("id"), "turn", "key", F.lit("use").alias("kind")).distinct()
        links = staged(linked(calls, results.unionByName(uses)), "links")
        ordered = staged(topological(calls, links.where("kind = 'result'"), links.where("kind = 'use'")), "topological")
        answered = staged(links.where("kind = 'result'").select("key").distinct().withColumn("answered", F.lit(True)), "answered")

        met = rows.join(per_message, "key", "left").join(ordered, "key", "left").join(answered, "key", "left")
        is_result, is_call = F.col("answers").isNotNull(), F.col("n_calls") > 0
        status = F.when(F.col("cyclic"), "cycle").when(is_call, "call").when(is_result & F.col("answered"), "result").when(is_result, "orphan").otherwise("plain")
        own = F.map_from_arrays(F.array(*map(F.lit, ("conv_id", "role", "turn"))), F.array(*(F.try_parse_json(F.to_json(F.struct(F.col(c).alias("x")))) for c in ("conv_id", "role", "turn"))))
        own = F.transform_values(own, lambda k, v: _got(v, "$.x", "variant"))
        members = F.when(is_call | is_result, F.map_filter("held", lambda k, v: ~k.isin("conv_id", "role", "turn", "tool_calls")))
        members = F.coalesce(members, F.when(F.col("text").isNotNull(), F.create_map(F.lit("content"), F.col("text").cast("variant"))), F.create_map().cast("map<string,variant>"))
        members = F.map_concat(members, own, F.when(is_call, F.create_map(F.lit("tool_calls"), F.try_parse_json("tool_calls"))).otherwise(F.create_map().cast("map<string,variant>")))
        told = met.select(
            "conv_id",
            "turn",
            "role",
            "key",
            F.coalesce("after_turn", "turn").alias("after_turn"),
            F.coalesce("depth", F.lit(0)).alias("depth"),
            F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
            F.coalesce("n_valid", F.lit(0)).cast("long").alias("n_valid"),
            status.alias("status"),
            _sorted_json(members).alias("message"),
        )
        out = keep(staged(positioned(told).select("conv_id", "turn", "role", "position", "after_turn", "depth", "n_calls", "n_valid", "status", "message"), "messages"))
    return out
