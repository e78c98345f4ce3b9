"""Tool calls of conversations: linked, ordered, validated and written as canonical JSON.

Only DataFrame functions are used. Calls and results are hash-joined by conversation and
identifier; of rows that share both one is linked, so no key multiplies, and the others are
told apart. The order is topological: a call comes after those whose results it uses, by
its level, and calls in a cycle or behind one get no level. Arguments are taken apart as
variants and each is held against the schema of its tool. The JSON of a call has sorted
keys, no white space, and one spelling of each number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldwatch.llm.common import stored

# The types that schemas name, by how a variant shows its own.
_TYPES = {
    "string": "^STRING$",
    "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$",
    "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY.*$",
    "object": "^OBJECT.*$",
}


# What identifies a call: identifiers need only differ within a conversation.
_KEY = ["conv_id", "call_id"]

# A JSON text in parts: strings, runs that may be numbers, all else.
_PARTS = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[-+0-9.eE]++|[^-+0-9.eE"]++|.'
_NUMBER = r"^(-?)(0|[1-9][0-9]*+)(?:\.([0-9]++))?(?:[eE]([+-]?[0-9]++))?$"

# Digits that a variant keeps exactly; longer numbers are read in double precision.
_EXACT = 38


def _one_per_call(rows: DataFrame) -> DataFrame:
    """Of rows with one ``conv_id`` and ``call_id`` the least; map tasks reduce before the shuffle.

    ``key`` holds both, ``copies`` counts the rows, and ``differ`` tells if not all were equal.
    """
    rest = F.struct(*[c for c in rows.columns if c not in _KEY])
    least = rows.where("call_id is not null and conv_id is not null").groupBy(*_KEY).agg(
        F.min(rest).alias("least"), F.max(rest).alias("most"), F.count("*").alias("copies")
    )
    return least.select(
        F.struct(*_KEY).alias("key"), *_KEY, "least.*", "copies",
        (~F.col("least").eqNullSafe(F.col("most"))).alias("differ"),
    )


def _left_over(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """The distinct rows that ``_one_per_call`` did not take, with ``copies`` and ``problem``.

    Rows are told from those taken by an aggregation on all columns, so rows of one identifier spread.
    """
    unnamed = F.col("call_id").isNull() | F.col("conv_id").isNull()
    # Where all rows of each identifier are equal, only those without one are left.
    every = rows if not linked.where("differ").isEmpty() else rows.where(unnamed)
    marked = every.withColumn("taken", F.lit(0)).unionByName(
        linked.select(*rows.columns, F.lit(1).alias("taken"))
    )
    told = marked.groupBy(*rows.columns).agg(
        F.max("taken").alias("taken"), F.sum(1 - F.col("taken")).alias("copies")
    )
    problem = F.when(unnamed, "no identifier").otherwise("repeated identifier")
    return told.where("taken = 0").drop("taken").withColumn("problem", problem)


def _chains(nodes: DataFrame) -> DataFrame:
    """(call_id, uses, top, steps, ended): follows calls that use one other up to one that
    uses none or several, in rounds that double the steps. A chain into a cycle does not end.

    ``nodes`` has call_id, uses (their number) and used (the one, if it is one).
    """
    single = F.col("uses") == 1
    chains = stored(
        nodes.select(
            "call_id", "uses",
            F.when(single, F.col("used")).otherwise(F.col("call_id")).alias("top"),
            single.cast("int").alias("steps"), (~single).alias("ended"),
        ),
        "call-chains",
    )
    left = chains.where("not ended").count()
    while left:
        above = chains.select(
            F.col("call_id").alias("top"), F.col("top").alias("next"),
            F.col("steps").alias("more"), F.col("ended").alias("ends"),
        )
        chains = stored(
            chains.join(above, "top").select(
                "call_id", "uses", F.col("next").alias("top"),
                (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("ended"),
            ),
            "call-chains",
        )
        before, left = left, chains.where("not ended").count()
        if left == before:  # what is left runs in circles
            break
    return chains.where("ended")


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level): 0 for calls that use no other, else one more than the last they use.

    ``calls`` has call_id and ``uses``, an array of identifiers; those of no call do not count.
    Calls in a cycle or behind one are left out. Chains are followed in as many rounds as their
    length has binary digits; then a round settles the calls that use several settled ones.
    """
    edges = calls.select("call_id", F.explode("uses").alias("used"))
    known = calls.select(F.col("call_id").alias("used"))
    edges = stored(edges.join(known, "used", "left_semi").distinct(), "call-uses")
    counted = edges.groupBy("call_id").agg(F.count("*").alias("uses"), F.min("used").alias("used"))
    nodes = calls.select("call_id").join(counted, "call_id", "left").fillna(0, ["uses"])
    chains = _chains(nodes)
    settled = chains.where("uses = 0").select("call_id", F.lit(0).alias("level"))
    # Calls that use several: what they wait for, as the top of its chain and the steps to it.
    several = chains.where("uses > 1").select("call_id")
    tops = chains.select(F.col("call_id").alias("used"), "top", "steps")
    waiting = stored(
        edges.join(several, "call_id", "left_semi").join(tops, "used", "left").select(
            "call_id", "top", "steps", F.lit(None).cast("int").alias("level")
        ),
        "call-waits",
    )
    done, newly = settled, settled
    while not waiting.isEmpty():
        found = newly.select(F.col("call_id").alias("top"), F.col("level").alias("found"))
        waiting = stored(
            waiting.join(found, "top", "left").select(
                "call_id", "top", "steps", F.coalesce("level", "found").alias("level")
            ),
            "call-waits",
        )
        ready = waiting.groupBy("call_id").agg(
            F.bool_and(F.col("level").isNotNull()).alias("all"),
            F.max(F.col("level") + F.col("steps") + 1).alias("level"),
        )
        newly = stored(ready.where("all").select("call_id", "level"), "call-levels")
        if newly.isEmpty():
            break
        done = done.unionByName(newly)
        waiting = stored(waiting.join(newly, "call_id", "left_anti"), "call-waits")
    tops = done.select(F.col("call_id").alias("top"), F.col("level").alias("start"))
    return chains.join(tops, "top").select(
        "call_id", (F.col("start") + F.col("steps")).alias("level")
    )


def _kind_matches(kind: Column, wanted: Column) -> Column:
    found = F.lit(False)
    for name, pattern in _TYPES.items():
        found = found | ((wanted == name) & kind.rlike(pattern))
    return found


def problems(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(call_id, problems): what is wrong with each call's arguments, sorted; sound calls are left out.

    ``calls`` has call_id, name and arguments (JSON text); ``schemas`` a row per tool and argument:
    name, argument, type, required.
    """
    parsed = calls.select(
        "call_id", "name", F.try_parse_json("arguments").alias("document")
    ).withColumn("object", F.schema_of_variant("document").startswith("OBJECT"))
    spark = calls.sparkSession
    given = (
        parsed.where("object")
        .lateralJoin(spark.tvf.variant_explode(F.col("document").outer()))
        .select("call_id", "name", F.col("key").alias("argument"),
                F.schema_of_variant("value").alias("kind"))
    )
    tools = schemas.select("name").distinct()
    wanted = parsed.where("object").select("call_id", "name").join(schemas, "name")
    both = wanted.join(given, ["call_id", "name", "argument"], "left")
    absent = both.where("kind is null and required").select(
        "call_id", F.concat(F.lit("missing "), "argument").alias("problem")
    )
    wrong = both.where(F.col("kind").isNotNull() & ~_kind_matches(F.col("kind"), F.col("type")))
    wrong = wrong.select("call_id", F.concat(F.lit("wrong type of "), "argument").alias("problem"))
    unknown = given.join(tools, "name", "left_semi").join(
        schemas.select("name", "argument"), ["name", "argument"], "left_anti"
    ).select("call_id", F.concat(F.lit("unknown "), "argument").alias("problem"))
    no_tool = parsed.join(tools, "name", "left_anti").select(
        "call_id", F.lit("unknown tool").alias("problem")
    )
    no_object = parsed.where(~F.coalesce("object", F.lit(False))).select(
        "call_id", F.lit("arguments are no object").alias("problem")
    )
    every = absent.unionByName(wrong).unionByName(unknown).unionByName(no_tool).unionByName(no_object)
    return every.groupBy("call_id").agg(F.array_sort(F.collect_set("problem")).alias("problems"))


def _json_text(value: Column) -> Column:
    """A JSON string, or null."""
    quoted = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(quoted, F.lit(6), F.length(quoted) - 6)


def _plain(token: Column) -> Column:
    """A number without exponent, leading or trailing zeros; other tokens and longer numbers as they are."""
    sign, whole, part, power = (F.regexp_extract(token, _NUMBER, n) for n in range(1, 5))
    digits = F.concat(whole, part)
    leading = F.regexp_replace(digits, "^0+", "")
    body = F.regexp_replace(leading, "0+$", "")
    shift = F.when(power == "", 0).otherwise(power.try_cast("int")).cast("long")
    # Digits of the body that stand before the point.
    before = F.length(whole) + shift - (F.length(digits) - F.length(leading))
    size = F.length(body)
    fits = (F.greatest(size, before, size - before) <= _EXACT) & shift.isNotNull()

    def zeros(count: Column) -> Column:
        return F.repeat(F.lit("0"), F.greatest(count, F.lit(0)).cast("int"))

    text = (
        F.when(before <= 0, F.concat(F.lit("0."), zeros(-before), body))
        .when(before >= size, F.concat(body, zeros(before - size)))
        .otherwise(F.concat(body.substr(F.lit(1), before.cast("int")), F.lit("."),
                            body.substr(before.cast("int") + 1, size)))
    )
    is_number = token.rlike(_NUMBER)
    return F.when(is_number & (body == ""), "0").when(is_number & fits, F.concat(sign, text)).otherwise(token)


def plain_numbers(text: Column) -> Column:
    """JSON text in which equal numbers of up to 38 digits are spelt alike; strings stay."""
    parts = F.regexp_extract_all(text, F.lit(_PARTS), F.lit(0))
    return F.when(text.rlike(r"[0-9][.eE]|-0"), F.array_join(F.transform(parts, _plain), "")).otherwise(text)


def canonical(call: dict[str, Column]) -> Column:
    """An object of JSON values, keys sorted."""
    members = [
        F.concat(F.lit(f'"{k}":'), F.coalesce(call[k], F.lit("null"))) for k in sorted(call)
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row per call and identifier, per result without a call, and per row that cannot be linked.

    ``calls``: call_id, conv_id, turn, name, arguments (JSON text), uses (array of call ids of
    the conversation). ``results``: call_id, conv_id, turn, content. ``schemas``: name, argument,
    type, required.

    Gives call_id, conv_id, turn, name, level, linked (there are call and result), valid,
    problems (comma-joined, null if none), copies (rows with the identifier), json. Within a
    conversation (level, turn, call_id) is a topological order; level is null in and behind
    cycles. A result without a call has no name, level or arguments and is not valid.

    Identifiers count within their conversation. Of calls, or results, that share one the
    least is linked, by their columns in order. The others have rows of their own, a row for equal
    ones: not linked, not valid, without level, with the problem ``repeated identifier``; rows
    without identifier or conversation have ``no identifier``. Null names, arguments and contents
    are JSON nulls; null arguments are no object. Empty texts are texts. Numbers of up to 38 digits
    are exact and have one spelling (``1``, ``1.0`` and ``1e0`` are the integer 1), longer ones are
    doubles, ``"Infinity"`` beyond their range. Other columns are ignored. Empty tables give no rows.
    """
    asked = calls.select("call_id", "conv_id", "turn", "name", "arguments", "uses")
    told = results.select("call_id", "conv_id", "turn", "content")
    called = stored(
        _one_per_call(asked).withColumn("plain", plain_numbers(F.col("arguments"))), "calls"
    )
    answered = stored(_one_per_call(told), "call-results")
    keyed = called.select(
        F.col("key").alias("call_id"), "name", F.col("plain").alias("arguments"),
        F.transform("uses", lambda used: F.struct(F.col("conv_id"), used.alias("call_id"))).alias("uses"),
    )
    answers = answered.select(
        "key", F.col("conv_id").alias("result_conv"), F.col("call_id").alias("result_id"),
        F.col("turn").alias("result_turn"), "content", F.lit(True).alias("answered"),
        F.col("copies").alias("result_copies"),
    )
    linked = (
        called.withColumn("called", F.lit(True))
        .join(answers.hint("shuffle_hash"), "key", "full")
        .join(levels(keyed).withColumnRenamed("call_id", "key"), "key", "left")
        .join(problems(keyed, schemas).withColumnRenamed("call_id", "key"), "key", "left")
    )
    was_called = F.coalesce("called", F.lit(False))
    was_answered = F.coalesce("answered", F.lit(False))
    rows = linked.select(
        F.coalesce("call_id", "result_id").alias("call_id"),
        F.coalesce("conv_id", "result_conv").alias("conv_id"),
        F.coalesce("turn", "result_turn").alias("turn"),
        "name", "level", "arguments", "plain", "content", "uses",
        (was_called & was_answered).alias("linked"),
        (was_called & F.col("problems").isNull()).alias("valid"),
        F.array_join("problems", ",").alias("problems"),
        (F.coalesce("copies", F.lit(0)) + F.coalesce("result_copies", F.lit(0))).alias("copies"),
    )
    for side, taken in ((asked, called), (told, answered)):
        over = _left_over(side, taken).withColumnRenamed("problem", "problems")
        if "arguments" in over.columns:
            over = over.withColumn("plain", plain_numbers(F.col("arguments")))
        over = over.withColumn("linked", F.lit(False)).withColumn("valid", F.lit(False))
        rows = rows.unionByName(over, allowMissingColumns=True)
    text = canonical(
        {
            "arguments": F.coalesce(
                F.to_json(F.try_parse_json("plain")), _json_text(F.col("arguments"))
            ),
            "call_id": _json_text(F.col("call_id")),
            "level": F.col("level").cast("string"),
            "name": _json_text(F.col("name")),
            "result": _json_text(F.col("content")),
            "uses": F.to_json(F.array_sort("uses")),
        }
    )
    return rows.select(
        "call_id", "conv_id", "turn", "name", "level", "linked", "valid", "problems", "copies",
        text.alias("json"),
    )


# Schemas of the calls that conversations are read as.
SCHEMAS = [
    ("ask", "text", "string", True),
    ("ask", "words", "integer", True),
    ("follow_up", "text", "string", True),
    ("follow_up", "words", "integer", True),
    ("follow_up", "after", "string", True),
]


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that ``conversations`` (conv_id, turn, role, text) stand for.

    What a user says is a call, and what the assistant says next is its result. The
    identifier is made of conversation and turn. A user's first turn asks; a later one
    follows up, and uses the call two turns before. A system message in front leaves the
    first follow-up with nothing to follow, which validation reports. Rows without conversation
    or turn have no identifier, and are reported as such.
    """
    def named(turn: Column) -> Column:
        return F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))

    turn = F.col("turn")
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    after = F.when(turn >= 2, named(turn - 2))
    arguments = F.to_json(F.struct(after.alias("after"), F.col("text"), words.alias("words")))
    calls = conversations.where("role = 'user'").select(
        named(turn).alias("call_id"), "conv_id", "turn",
        F.when(turn == 0, "ask").otherwise("follow_up").alias("name"),
        arguments.alias("arguments"),
        F.when(after.isNull(), F.array().cast("array<string>")).otherwise(F.array(after)).alias("uses"),
    )
    results = conversations.where("role = 'assistant'").select(
        named(turn - 1).alias("call_id"), "conv_id", "turn", F.col("text").alias("content")
    )
    return calls, results
