"""Chat formatting: tool calls linked with their results, ordered, checked and serialised.

Native throughout: DataFrame and SQL functions only.

Calls and results come from markup in the text (``<tool_call>{...}</tool_call>`` and
``<tool_result>{...}</tool_result>``, with an ``id`` each), or from plain turns, where a
user's turn is a call of the tool ``answer`` and the assistant's next turn its result.
They are hash-joined by conversation and identifier. Arguments are checked against the
tool's parameters row by row. Each linked call is one line of canonical JSON: keys
sorted, no white space, arguments as their own canonical JSON.

Topological order without gathering a conversation: a call's place is the larger of its
own and the places of the calls it needs (``after``). As long as calls need earlier ones,
which is the rule, their own places are such an order already. Only between a call and a
later one that it needs are places passed on, until they stand still. Each round passes them
from need to call and jumps along one path of needs, twice as far each time, so a chain
takes rounds by the logarithm of its length. A call that more hops reach than there are calls
between is in a circle, or behind one. ``order_key`` sorts a conversation.

All events of an identifier are brought together once, with their texts; numbering, runs and
linking follow in place.

Defined cases: null texts hold no call. A call whose markup is no JSON keeps its raw text as its
arguments. Arguments given as a JSON text of an object are that object. A call without an id gets
none of the results and keeps its place. Repeated rows are one. Different calls, or results, with the same id in a
conversation all count with ``every``: runs of calls and the results behind them belong
together, the first call with the first result and so on; a call after the first of its id
is reported as a duplicate, and a result beyond the calls of its run is a row of its own.
What needs such an id needs the last such call before it. Without ``every``, the first call
and result of an id are linked and the others only reported as duplicates. Results without a
call are reported as orphans. Arguments that aren't a JSON object are reported. Calls in
a circle, or behind one, are reported. Null conversation ids are one conversation.
Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardwatch.llm.base import stash

CALL = r"(?s)<tool_call>(.*?)</tool_call>"
RESULT = r"(?s)<tool_result>(.*?)</tool_result>"
# JSON schema types by the first word of a variant's type.
KINDS = {
    "STRING": "string", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "BOOLEAN": "boolean",
    "VOID": "null", "ARRAY": "array", "OBJECT": "object",
}

CALL_COLUMNS = ("conv_id", "turn", "place", "call_id", "name", "arguments", "after")
RESULT_COLUMNS = ("conv_id", "turn", "place", "call_id", "content")


def _turns(messages: DataFrame) -> DataFrame:
    return messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )


def _field(name: str) -> str:
    return f"try_variant_get(payload, '$.{name}', 'string')"


def marked_calls(messages: DataFrame) -> DataFrame:
    """The calls in the markup of assistant turns."""
    found = _turns(messages).where("role = 'assistant' and contains(text, '<tool_call>')")
    found = found.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(CALL), F.lit(1))).alias("place", "raw"))
    given = found.selectExpr("*", "try_parse_json(raw) as payload").selectExpr("*", "try_variant_get(payload, '$.arguments', 'variant') as given")
    given = given.selectExpr("*", "if(schema_of_variant(given) = 'STRING', cast(given as string), null) as said")
    return given.selectExpr(
        "conv_id", "turn", "cast(place as long) as place", f"{_field('id')} as call_id", f"{_field('name')} as name",
        """case when payload is null then to_json(named_struct('raw', raw))
                when schema_of_variant(try_parse_json(said)) like 'OBJECT%' then said else to_json(given) end as arguments""",
        "coalesce(try_variant_get(payload, '$.after', 'array<string>'), cast(array() as array<string>)) as after",
    )


def marked_results(messages: DataFrame) -> DataFrame:
    """The results in the markup of any turn."""
    found = _turns(messages).where("contains(text, '<tool_result>')")
    found = found.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(RESULT), F.lit(1))).alias("place", "raw"))
    return found.withColumn("payload", F.expr("try_parse_json(raw)")).selectExpr(
        "conv_id", "turn", "cast(place as long) as place", f"{_field('id')} as call_id", f"{_field('content')} as content"
    )


def turn_calls(messages: DataFrame) -> DataFrame:
    """Each user turn as a call; it needs the one two turns before."""
    return _turns(messages).where("role = 'user' and text is not null").selectExpr(
        "conv_id", "turn", "0L as place", "concat('turn-', turn) as call_id", "'answer' as name",
        "to_json(named_struct('prompt', text, 'turn', turn)) as arguments",
        "if(turn >= 2, array(concat('turn-', turn - 2)), cast(array() as array<string>)) as after",
    )


def turn_results(messages: DataFrame) -> DataFrame:
    """Each assistant turn as the result of the turn before."""
    return _turns(messages).where("role = 'assistant' and text is not null and not contains(text, '<tool_call>')").selectExpr(
        "conv_id", "turn", "0L as place", "concat('turn-', turn - 1) as call_id", "text as content"
    )


_CALL = {"name": "string", "arguments": "string", "after": "array<string>"}
_NOTHING = "cast(null as {kind}) as {name}"


def _events(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Every different call (kind 0) and result (kind 1) that has an id, all of one id in one partition."""
    shape = {**_CALL, "content": "string"}
    parts = [
        rows.where("call_id is not null").select(
            "conv_id", "call_id", "turn", "place", F.lit(kind).alias("kind"),
            *((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in shape.items()),
        )
        for kind, rows in enumerate((calls, results))
    ]
    together = parts[0].unionByName(parts[1]).repartition("conv_id", "call_id")
    return together.distinct()


def _numbered(events: DataFrame) -> DataFrame:
    """Events with ``run`` and ``at``, by which they are linked, and ``k``, the number of a call in its id.

    ``copies`` is over 1 for duplicates; ``known`` tells whether the id has a call.
    """
    of_id = Window.partitionBy("conv_id", "call_id")
    in_order = ("turn", "kind", "place", *_CALL, "content")
    found = events.withColumn("starts", F.expr("kind = 0") & (F.coalesce(F.lag("kind").over(of_id.orderBy(*in_order)), F.lit(1)) == 1))
    found = found.withColumn("run", F.sum(F.col("starts").cast("long")).over(of_id.orderBy(*in_order).rowsBetween(Window.unboundedPreceding, 0)))
    # Results before the first call serve it only if none behind it does.
    found = found.withColumn("early", F.col("run") == 0).withColumn("run", F.greatest("run", F.lit(1)))
    of_run = Window.partitionBy("conv_id", "call_id", "run")
    found = found.select(
        "*", F.row_number().over(Window.partitionBy("conv_id", "call_id", "run", "kind").orderBy("early", *in_order)).cast("long").alias("at"),
        F.row_number().over(Window.partitionBy("conv_id", "call_id", "kind").orderBy(*in_order)).cast("long").alias("k"),
        F.count_if(F.expr("kind = 0")).over(of_run).alias("in_run"), (F.count_if(F.expr("kind = 0")).over(of_id) > 0).alias("known"),
    )
    surplus = F.when(F.col("at") > F.greatest("in_run", F.lit(1)), 2).otherwise(1).cast("long")
    return found.withColumn("copies", F.when(F.col("kind") == 0, F.col("k")).otherwise(surplus))


def _firsts(events: DataFrame) -> DataFrame:
    """The first call and the first result of every id, numbered alike, with ``copies`` of either."""
    rest = ("turn", "place", *_CALL, "content")
    first = events.groupBy("conv_id", "call_id", "kind").agg(F.min(F.struct(*rest)).alias("s"), F.count(F.lit(1)).alias("copies"))
    one = F.lit(1).cast("long")
    return first.select("conv_id", "call_id", "kind", "s.*", "copies", *[one.alias(c) for c in ("run", "at", "k")], F.lit(False).alias("known"))


def _linked(numbered: DataFrame, calls: DataFrame, results: DataFrame) -> DataFrame:
    """A row per call with its result, and per result without a call. A side that is missing has no place."""
    sides = [
        F.max(F.when(F.col("kind") == kind, F.struct("turn", "place", "copies", *fields))).alias(side)
        for kind, side, fields in ((0, "call", ("k", *_CALL)), (1, "result", ("content", "known")))
    ]
    both = numbered.groupBy("conv_id", "call_id", "run", "at").agg(*sides).select(
        "conv_id", "call_id", "call.turn", "call.place", "call.name", "call.arguments", "call.after", "call.k", "call.copies",
        F.col("result.turn").alias("r_turn"), F.col("result.place").alias("r_place"), F.col("result.content").alias("content"),
        F.col("result.copies").alias("r_copies"), F.coalesce("result.known", F.lit(False)).alias("known"),
    )

    def nothing(**kinds: str) -> list[str]:
        return [_NOTHING.format(name=name, kind=kind) for name, kind in kinds.items()]

    lone_calls = calls.where("call_id is null").select(*CALL_COLUMNS).distinct().selectExpr(
        *CALL_COLUMNS, "1L as k", "1L as copies", *nothing(r_turn="long", r_place="long", content="string", r_copies="long"), "false as known"
    )
    lone_results = results.where("call_id is null").select(*RESULT_COLUMNS).distinct().selectExpr(
        "conv_id", "call_id", *nothing(turn="long", place="long", **_CALL, k="long", copies="long"),
        "turn as r_turn", "place as r_place", "content", "1L as r_copies", "false as known",
    )
    return both.unionByName(lone_calls).unionByName(lone_results)


_KEY = "coalesce(cast(conv_id as string), '') as c"  # no number is the empty text
_ORDER = "c string, call_id string, k long, k_turn long, k_place long, hops long, circle boolean"


def _needing_later(calls: DataFrame) -> DataFrame:
    """The conversations (c) in which some call needs one that isn't before it, told by the first call of each id."""
    slim = calls.where("call_id is not null").selectExpr(_KEY, "call_id", "struct(turn, place) as own", "after")
    first = slim.groupBy("c", F.col("call_id").alias("needs")).agg(F.min("own").alias("first"))
    needs = slim.select("c", "own", F.explode("after").alias("needs"))
    return stash(needs.join(first, ["c", "needs"]).where("first >= own").select("c").distinct(), "later")


def _order(calls: DataFrame) -> DataFrame:
    """The places of calls that others move, by c, call_id and k. calls: c, call_id, k, turn, place, after."""
    calls = calls.where("call_id is not null")
    wanted = calls.select("c", F.explode("after").alias("needs"), "turn", "place", F.lit(None).cast("long").alias("n"), "call_id", "k")
    given = calls.selectExpr("c", "call_id as needs", "turn", "place", "k as n", "cast(null as string) as call_id", "cast(null as long) as k")
    # Of the calls of a needed id the last before, or else the first.
    before = Window.partitionBy("c", "needs").orderBy("turn", "place", F.col("n").isNotNull(), "n").rowsBetween(Window.unboundedPreceding, 0)
    edges = wanted.unionByName(given).withColumn("needs_k", F.coalesce(F.last("n", True).over(before), F.lit(1).cast("long")))
    edges = edges.where("call_id is not null").selectExpr("c", "call_id", "k", "struct(turn, place) as own", "needs", "needs_k")
    places = calls.selectExpr("c", "call_id as needs", "k as needs_k", "struct(turn, place) as of_need")
    edges = stash(edges.join(places, ["c", "needs", "needs_k"]), "needs")
    members = stash(_between(calls, edges), "members")
    schema_of_label = "struct(own.turn as turn, own.place as place, 0L as hops)"
    inside = members.select("c", "call_id", "k", "size")
    needed = inside.selectExpr("c", "call_id as needs", "k as needs_k")
    edges = stash(edges.join(inside.drop("size"), ["c", "call_id", "k"]).join(needed, ["c", "needs", "needs_k"]).select(
        "c", "call_id", "k", "needs", "needs_k", "of_need"
    ), "edges")
    # A path to jump along: first to the need that comes last.
    jump = edges.groupBy("c", "call_id", "k").agg(F.max(F.struct("of_need", "needs", "needs_k")).alias("to"))
    labels = members.join(jump, ["c", "call_id", "k"], "left").selectExpr(
        "c", "call_id", "k", "size", f"{schema_of_label} as label", "to.needs as to_id", "to.needs_k as to_k", "1L as far", "false as circle"
    )
    labels = stash(labels, "labels")
    while True:
        of = labels.selectExpr("c", "call_id as needs", "k as needs_k", "label as of")
        heard = edges.join(of, ["c", "needs", "needs_k"]).groupBy("c", "call_id", "k").agg(
            F.max(F.expr("struct(of.turn as turn, of.place as place, of.hops + 1 as hops)")).alias("heard")
        )
        ahead = labels.selectExpr("c", "call_id as to_id", "k as to_k", "label as there", "to_id as next_id", "to_k as next_k", "far as further")
        new = labels.join(heard, ["c", "call_id", "k"], "left").join(ahead, ["c", "to_id", "to_k"], "left")
        jumped = F.expr("if(there is null, null, struct(there.turn as turn, there.place as place, there.hops + far as hops))")
        new = new.withColumn("best", F.when(F.col("circle"), F.col("label")).otherwise(F.greatest("label", "heard", jumped)))
        new = stash(new.selectExpr(
            "c", "call_id", "k", "size", "best as label", "next_id as to_id", "next_k as to_k",
            "if(next_id is null, 0L, least(far + further, size + 1)) as far", "circle or best.hops > size as circle", "best <> label as moved",
        ), "labels")
        labels = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    return labels.select("c", "call_id", "k", F.col("label.turn").alias("k_turn"), F.col("label.place").alias("k_place"), "label.hops", "circle")


def _between(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """The calls from one that needs a later one up to that one, with how many lie in the same stretch: only these can move."""
    back = edges.where("of_need >= own").select("c", F.col("own").alias("low"), F.col("of_need").alias("high"))
    along = Window.partitionBy("c").orderBy("low", "high")
    reach = F.max("high").over(along.rowsBetween(Window.unboundedPreceding, -1))
    parts = back.withColumn("opens", (reach.isNull() | (F.col("low") > reach)).cast("long"))
    parts = parts.withColumn("stretch", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.groupBy("c", "stretch").agg(F.min("low").alias("at"), F.max("high").alias("high"))
    none = {"call_id": "string", "k": "long"}
    marks = parts.select("c", "at", F.lit(0).alias("is_call"), "stretch", "high", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    own = calls.selectExpr("c", "struct(turn, place) as at", "1 as is_call", "cast(null as long) as stretch", "cast(null as struct<turn:long,place:long>) as high", "call_id", "k")
    so_far = Window.partitionBy("c").orderBy("at", "is_call").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(own).withColumns({c: F.last(c, True).over(so_far) for c in ("stretch", "high")})
    found = found.where("is_call = 1 and at <= high")
    sizes = found.groupBy("c", "stretch").agg(F.count(F.lit(1)).alias("size"))
    return found.join(sizes, ["c", "stretch"]).selectExpr("c", "call_id", "k", "at as own", "size")


def _kind(value: str) -> str:
    pairs = ", ".join(f"'{a}', '{b}'" for a, b in KINDS.items())
    return f"map({pairs})[regexp_extract(schema_of_variant({value}), '^[A-Z]+', 0)]"


def _checked(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Adds args (variant) and errors: what speaks against a call's arguments.

    tools: name, parameters array<struct<name, type, required>>.
    """
    t = tools.select(F.col("name").alias("tool"), "parameters").dropDuplicates(["tool"])
    given = calls.join(t, calls["name"] == t["tool"], "left").withColumn("args", F.expr("try_parse_json(arguments)"))
    given = given.withColumn(
        "given", F.expr("if(args is not null and schema_of_variant(args) like 'OBJECT%', cast(args as map<string, variant>), null)")
    )
    value = "element_at(given, p.name)"
    wrong = f"""array_sort(array_compact(concat(
        transform(parameters, p -> case
            when {value} is null then if(p.required, concat('missing:', p.name), null)
            when {_kind(value)} = p.type or p.type = 'number' and {_kind(value)} = 'integer' then null
            else concat('type:', p.name) end),
        transform(map_keys(given), k -> if(exists(parameters, p -> p.name = k), null, concat('unknown:', k))))))"""
    errors = f"case when name is null then array('no_name') when tool is null then array('unknown_tool') when given is null then array('no_object') else {wrong} end"
    return given.withColumn("errors", F.expr(errors))


def link(calls: DataFrame, results: DataFrame, tools: DataFrame, every: bool = False) -> DataFrame:
    """A row per call, with its result, and per result without a call.

    conv_id, turn, call_id, status (answered, unanswered, orphan; duplicate for a result beyond
    the calls of its id), n_errors, order_key and the canonical JSON line. every: see above.
    """
    calls, results = calls.select(*CALL_COLUMNS), results.select(*RESULT_COLUMNS)
    events = _events(calls, results)
    both = _linked(_numbered(events) if every else _firsts(events), calls, results)
    later = _needing_later(calls)
    moved = {"k_turn": "long", "k_place": "long", "hops": "long", "circle": "boolean"}
    if later.isEmpty():
        both = both.selectExpr("*", *[_NOTHING.format(name=c, kind=t) for c, t in moved.items()])
    else:
        both = stash(both, "linked").selectExpr("*", _KEY)
        order = _order(both.where("place is not null").select("c", "call_id", "k", "turn", "place", "after").join(later, "c", "left_semi"))
        both = both.join(order, ["c", "call_id", "k"], "left").drop("c")
    both = _checked(both, tools)
    both = both.withColumn("errors", F.expr("if(place is null, cast(array() as array<string>), errors)"))
    both = both.withColumn("status", F.expr("case when place is null then if(known, 'duplicate', 'orphan') when r_place is null then 'unanswered' else 'answered' end"))
    extra = """array_compact(array(if(copies > 1, 'duplicate_call', null), if(r_copies > 1, 'duplicate_result', null),
        if(circle, 'circle', null), if(status = 'orphan', 'orphan', null), if(status = 'answered' and struct(r_turn, r_place) < struct(turn, place), 'early_result', null)))"""
    both = both.withColumn("errors", F.expr(f"array_sort(concat(coalesce(errors, cast(array() as array<string>)), {extra}))"))
    line = """to_json(named_struct('after', after, 'arguments', args, 'conv_id', conv_id, 'errors', errors, 'id', call_id,
        'name', name, 'result', content, 'status', status, 'turn', coalesce(turn, r_turn)), map('ignoreNullFields', 'false'))"""
    key = """concat_ws('.', lpad(coalesce(k_turn, turn, r_turn), 12, '0'), lpad(coalesce(k_place, place, r_place), 8, '0'),
        lpad(coalesce(hops, 0L), 8, '0'), lpad(coalesce(turn, r_turn), 12, '0'), lpad(coalesce(place, r_place), 8, '0'))"""
    return both.selectExpr(
        "conv_id", "coalesce(turn, r_turn) as turn", "call_id", "status",
        "cast(size(errors) as long) as n_errors", f"{key} as order_key", f"{line} as line",
    )
