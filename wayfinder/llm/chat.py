"""Chat formatting: linking tool calls to results.

Calls and results meet in a hash join by conversation and identifier. A call may name calls that
must come before it; levels give a topological order in which a result follows its call and a call
follows the results it waits for. Arguments are checked against the tool's schema, and each linked
pair becomes one line of canonical JSON: keys sorted, no spaces, arguments reparsed.

There is one row for each call and each orphan result, never a row for a whole conversation, so a
conversation may hold any share of the rows. Nulls: a null identifier or conversation links with
nothing, so such a result is an "orphan" and such a call is "open" at level 0, whatever the rest of
the table holds; null or broken arguments are invalid; null contents stay out of the JSON; a null
turn comes after all others. Of calls that share an identifier the one with the first turn takes
part (of alike turns the least hash of name and arguments, of alike rows any) and the others are
"duplicate"; results that share one are all linked, one row each. Texts of any length are whole.
Empty tables give empty results; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfinder.functions.scratch import Scratch
from wayfinder.llm._shared import words

Schema = dict[str, dict[str, tuple]]
#: Kinds of values as the names that schema_of_variant gives them.
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*"}
#: Turns of a conversation that one task orders; a longer conversation is dealt out by its turn numbers.
TURNS = 1024


def valid(name: Column, arguments: Column, schemas: Schema) -> Column:
    """Whether the tool is known and each argument there is has its kind, with none missing or unknown.

    A field is (kind, required) or (kind, required, least): the least number, or length of a string.
    """
    v = F.try_parse_json(arguments)
    out = F.lit(False)
    for tool, fields in schemas.items():
        keys = F.json_object_keys(arguments)
        test = F.size(F.array_except(keys, F.array(*map(F.lit, fields)) if fields else F.array().cast("array<string>"))) == 0
        for field, (kind, required, *least) in fields.items():
            of = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
            good = of.rlike(f"^{KINDS[kind]}$")
            if least:
                is_text = kind == "string"
                value = F.try_variant_get(v, f"$.{field}", "string" if is_text else "double")
                good = good & ((F.length(value) if is_text else value) >= least[0])
            test = test & F.coalesce(good, F.lit(not required))
        out = F.when(name == tool, F.coalesce(test, F.lit(False))).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _chains(waits: DataFrame, scratch: Scratch) -> DataFrame:
    """For calls that wait for just one: `(conv_id, call_id, to, dist, open)`, the first call back along the chain that does not, and how far it is.

    Each round doubles the steps taken, so a chain of n calls takes log n rounds. What is still
    `open` after them runs in a circle.
    """
    one = waits.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("on").alias("to")).where("n = 1")
    now = scratch.cut(one.select("conv_id", "call_id", "to", F.lit(1).cast("long").alias("dist"), F.lit(True).alias("open")), "chain-0")
    rounds = now.count().bit_length() + 1
    for k in range(1, rounds + 1):
        if now.where("open").isEmpty():
            break
        ahead = now.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("_to"), F.col("dist").alias("_dist"))
        far = now.join(ahead, ["conv_id", "to"], "left")
        far = far.select("conv_id", "call_id", F.coalesce("_to", "to").alias("to"), (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"), F.col("_to").isNotNull().alias("open"))
        now = scratch.cut(far, f"chain-{k}")
        scratch.drop(f"chain-{k - 1}")
    return now


def levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """`(conv_id, call_id, level)`: 0 without calls to wait for, else two more than the highest of those. Calls in a cycle, and those that wait for them, have none.

    Chains of calls that wait for one other are followed by doubling; calls that wait for several
    are settled in rounds, one for each level among such calls alone. Identifiers that no call has
    are not waited for.
    """
    ids = calls.select("conv_id", "call_id").distinct()
    waits = calls.select("conv_id", "call_id", F.explode("after").alias("on")).distinct()
    waits = scratch.cut(waits.join(ids.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"], "left_semi"), "waits")
    free = scratch.cut(ids.join(waits, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0).cast("long")), "free")
    heads = _chains(waits, scratch).where("not open").drop("open")
    several = waits.groupBy("conv_id", "call_id").count().where("count > 1").drop("count")
    edges = waits.join(several, ["conv_id", "call_id"], "left_semi").join(heads.select("conv_id", F.col("call_id").alias("on"), "to", "dist"), ["conv_id", "on"], "left")
    state = edges.select("conv_id", "call_id", F.coalesce("to", "on").alias("root"), F.coalesce("dist", F.lit(0).cast("long")).alias("dist"), F.lit(None).cast("long").alias("at"))
    state = scratch.cut(state, "state-0")
    settled, new, k = free, free, 0
    while not state.isEmpty():
        k += 1
        known = new.select("conv_id", F.col("call_id").alias("root"), "level")
        told = state.join(known, ["conv_id", "root"], "left").withColumn("at", F.coalesce("at", F.col("level") + 2 * F.col("dist"))).drop("level")
        told = scratch.cut(told.select(*state.columns), f"told-{k}")
        ready = told.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.count("at").alias("m"), F.max("at").alias("top")).where("n = m")
        new = scratch.cut(ready.select("conv_id", "call_id", (F.col("top") + 2).alias("level")), f"new-{k}")
        if new.isEmpty():
            break
        settled = scratch.cut(settled.unionByName(new), f"settled-{k}")
        state = scratch.cut(told.join(new, ["conv_id", "call_id"], "left_anti").select(*state.columns), f"state-{k}")
        for name in (f"told-{k}", f"state-{k - 1}", f"settled-{k - 1}"):
            scratch.drop(name)
    tail = heads.join(settled.select("conv_id", F.col("call_id").alias("to"), "level"), ["conv_id", "to"])
    return settled.unionByName(tail.select("conv_id", "call_id", (F.col("level") + 2 * F.col("dist")).alias("level")))


def link(calls: DataFrame, results: DataFrame, schemas: Schema) -> DataFrame:
    """Rows `(conv_id, call_turn, result_turn, call_id, level, status, valid, json)`.

    calls: conv_id, turn, call_id, name, arguments (JSON text), after (array of call_id, may be null).
    results: conv_id, turn, call_id, content. status: linked, open, duplicate, cycle or orphan.
    """
    scratch = Scratch(calls.sparkSession, "chat")
    calls = calls.select("conv_id", F.col("turn").alias("call_turn"), "call_id", "name", "arguments", "after", F.monotonically_increasing_id().alias("at"))
    calls = scratch.cut(calls, "calls")
    results = results.select("conv_id", F.col("turn").alias("result_turn"), "call_id", "content")
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    own = calls.where(named)
    # alike rows can stand for each other, so their places in the table may decide between them
    order = F.struct(F.coalesce("call_turn", F.lit((1 << 63) - 1)).alias("t"), F.xxhash64("name", "arguments").alias("h"), "at")
    first = own.groupBy("conv_id", "call_id").agg(F.min(order).alias("first"))
    level = levels(own.select("conv_id", "call_id", "after"), scratch)
    told = own.join(first.join(level, ["conv_id", "call_id"], "left"), ["conv_id", "call_id"]).withColumn("again", F.col("at") != F.col("first.at")).drop("first")
    told = told.withColumn("is_call", F.lit(True))
    met = told.where("not again").join(results.where(named), ["conv_id", "call_id"], "full")
    rest = told.where("again").unionByName(calls.where(~named).select("*", F.lit(0).cast("long").alias("level"), F.lit(False).alias("again"), F.lit(True).alias("is_call")))
    both = met.unionByName(rest, allowMissingColumns=True).unionByName(results.where(~named), allowMissingColumns=True)
    status = F.when(F.col("is_call").isNull(), "orphan").when(F.col("again"), "duplicate").when(F.col("level").isNull(), "cycle").when(F.col("result_turn").isNull() & F.col("content").isNull(), "open").otherwise("linked")
    ok = F.when(F.col("is_call"), valid(F.col("name"), F.col("arguments"), schemas))
    line = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), "call_id", "name", F.col("content").alias("result")))
    return both.select("conv_id", "call_turn", "result_turn", "call_id", "level", status.alias("status"), ok.alias("valid"), line.alias("json"))


#: The schemas of the calls that `exchanges` makes: a request of under five words says too little.
EXCHANGE: Schema = {"reply": {"text": ("string", True, 1), "n_words": ("integer", True, 5)}, "configure": {"text": ("string", True), "n_words": ("integer", True)}}
#: The tools that roles call; any other role calls a tool of its own name, which no schema knows.
TOOLS = {"user": "reply", "system": "configure"}


def exchanges(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations.

    Every turn but an assistant's is a call, which waits for the call before it in its conversation.
    An assistant's turn is the result of the last user turn before it; without one it has no
    identifier. A null role is a call of no tool; a null conversation or turn gives no identifier.

    The turns before a turn are found in blocks of TURNS turn numbers, each with what it takes over
    from the blocks before it, so that no task orders a whole long conversation.
    """
    role, turn = F.col("role"), F.col("turn")
    is_call = ~F.coalesce(role == "assistant", F.lit(False))
    placed = F.col("conv_id").isNotNull() & turn.isNotNull()
    block = F.when(placed, F.floor(turn / TURNS)).otherwise(F.pmod(F.xxhash64("conv_id", "text"), F.lit(TURNS)))
    t = turns.select("conv_id", turn.cast("long").alias("turn"), "role", "text", block.alias("block"), F.when(is_call, turn).alias("call"), F.when(role == "user", turn).alias("user"))
    sums = t.where(placed).groupBy("conv_id", "block").agg(F.max("call").alias("call"), F.max("user").alias("user"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "block", F.max("call").over(earlier).alias("old_call"), F.max("user").over(earlier).alias("old_user")).where("old_call is not null")
    inside = Window.partitionBy("conv_id", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("in_call", F.max("call").over(inside)).withColumn("in_user", F.max("user").over(inside)).join(sums, ["conv_id", "block"], "left")
    id_ = lambda at: F.concat(F.lit("call-"), at.cast("string"))
    last = lambda c: F.when(placed, id_(F.coalesce(f"in_{c}", f"old_{c}")))
    tools = F.create_map(*(F.lit(x) for kv in TOOLS.items() for x in kv))
    said = F.to_json(F.struct(F.size(words(F.col("text"))).alias("n_words"), "text"))
    calls = t.where(is_call).select("conv_id", "turn", F.when(placed, id_(turn)).alias("call_id"), F.coalesce(F.try_element_at(tools, role), role).alias("name"), said.alias("arguments"), F.array_compact(F.array(last("call"))).alias("after"))
    results = t.where(~is_call).select("conv_id", "turn", last("user").alias("call_id"), F.col("text").alias("content"))
    return calls, results
