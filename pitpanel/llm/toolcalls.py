"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Built from DataFrame functions alone. Calls and results are hash-joined by identifier. The level of a
call in the order is the number of calls it rests on, found by pointer doubling: each round joins a
call's ancestor with that one's ancestor, so a chain of n calls takes log2(n) rounds. Arguments are
parsed as variants; each parameter of a tool's schema is checked for presence and type, and names the
schema does not have are errors. Variants keep keys sorted, so their JSON is canonical.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.session import checkpoint_dir

#: tool -> parameter -> (JSON type, required)
SCHEMAS = {"reply": {"text": ("string", True), "turn": ("integer", True)}}
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


def levels(calls: DataFrame) -> DataFrame:
    """``calls`` (call_id, parent_id, ...) with ``level``: 0 without a known parent, else the parent's and one; NULL in a cycle.

    Rows that share a call_id share a level; of several parents the smallest gives it. A round joins only
    calls that have an ancestor left; calls without one are neither joined nor written again."""
    checkpoint_dir(calls.sparkSession)
    ids = calls.select("call_id", "parent_id").where("call_id IS NOT NULL").groupBy("call_id").agg(F.min("parent_id").alias("parent_id")).checkpoint()
    known = ids.select(F.col("call_id").alias("parent_id"), F.lit(True).alias("known"))
    found = ids.where("parent_id IS NOT NULL").join(known, "parent_id", "left")              # NULL parents would all meet in one task
    state = found.select("call_id", F.when(F.col("known"), F.col("parent_id")).alias("up"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("level")).checkpoint()
    roots = ids.where("parent_id IS NULL").select("call_id", F.lit(None).cast("string").alias("up"), F.lit(0).cast("long").alias("level"))
    settled, live = [roots, state.where("up IS NULL")], state.where("up IS NOT NULL")
    for _ in range(live.count().bit_length() + 1):           # what is not settled then is in a cycle
        if live.isEmpty():
            break
        above = reduce(DataFrame.unionByName, [*settled, live]).select(F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("level").alias("more"))
        moved = live.join(above, "up", "left").select("call_id", F.col("up2").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")).checkpoint()
        settled.append(moved.where("up IS NULL"))
        live = moved.where("up IS NOT NULL")
    state = reduce(DataFrame.unionByName, [*settled, live]).select("call_id", F.when(F.col("up").isNull(), F.col("level")).cast("int").alias("level"))
    placed = calls.where("call_id IS NOT NULL").join(state, "call_id", "left")
    return placed.unionByName(calls.where("call_id IS NULL").withColumn("level", F.lit(0)))


def errors(name: Column, arguments: Column, schemas=SCHEMAS) -> Column:
    """What is wrong with a call, sorted and comma-joined; empty if nothing."""
    doc = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    found = F.when(name.isNull() | ~name.isin(*schemas), F.array(F.lit("unknown tool"))).when(keys.isNull(), F.array(F.lit("not an object")))
    for tool, params in schemas.items():
        checks = [F.transform(F.array_except(keys, F.array(*map(F.lit, params))), lambda k: F.concat(F.lit("unknown:"), k))]
        for p, (kind, required) in params.items():
            got = F.schema_of_variant(F.try_variant_get(doc, f"$.{p}", "variant"))
            right = F.regexp_extract(got, r"^[A-Z]+", 0).isin(*TYPES[kind])
            absent = got.isNull() | (got == "VOID")
            checks.append(F.when(absent, F.array(F.lit(f"missing:{p}")) if required else F.array().cast("array<string>"))
                          .when(~right, F.array(F.lit(f"type:{p}"))).otherwise(F.array().cast("array<string>")))
        found = found.when(name == tool, F.concat(*checks))
    return F.array_join(F.array_sort(found), ",")


def link(calls: DataFrame, results: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """One row per call, per further result of a call, and per result without a call.

    ``calls``: call_id, parent_id, name, arguments (JSON text), copies; ``results``: call_id, content, copies. A
    call carries its result, of several the smallest content; every other content is a row of kind ``further
    result``. linked says whether both are there; json is canonical: sorted keys, no spaces, NULL written out."""
    named = results.where("call_id IS NOT NULL")
    answers = named.groupBy("call_id").agg(F.min("content").alias("content"), F.lit(True).alias("linked"))
    placed = levels(calls)
    known = placed.where("call_id IS NOT NULL").join(answers, "call_id", "left")
    done = known.unionByName(placed.where("call_id IS NULL"), allowMissingColumns=True).withColumn("linked", F.coalesce("linked", F.lit(False)))
    wrong = errors(F.col("name"), F.col("arguments"), schemas)
    call = F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), F.col("level"), F.col("name"), F.col("content").alias("result"))
    done = done.select("call_id", F.lit("call").alias("kind"), "parent_id", "level", "linked", wrong.alias("errors"), "copies",
                       F.to_json(call, {"ignoreNullFields": "false"}).alias("json"))
    asked = calls.select("call_id").where("call_id IS NOT NULL").distinct()
    first = answers.select("call_id", F.col("content").alias("_first")).join(asked.withColumn("_asked", F.lit(True)), "call_id", "left")
    rest = named.join(first, "call_id").where("_asked IS NULL OR NOT (content <=> _first)").withColumn("linked", F.col("_asked").isNotNull())
    rest = rest.select("call_id", "content", "copies", "linked").unionByName(results.where("call_id IS NULL").select("call_id", "content", "copies", F.lit(False).alias("linked")))
    rest = rest.select("call_id", F.when(F.col("linked"), "further result").otherwise("result").alias("kind"), F.lit(None).cast("string").alias("parent_id"),
                       F.lit(None).cast("int").alias("level"), "linked", F.when(F.col("linked"), "").otherwise("no call").alias("errors"), "copies",
                       F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result")), {"ignoreNullFields": "false"}).alias("json"))
    return done.unionByName(rest)


def messages(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and other messages of a conversation table (conv_id, turn, role, text).

    A user's message calls the tool ``reply`` with its turn and text; the assistant's message of the next
    turn is the result. A call rests on the call whose result it follows, two turns before. Equal
    messages of a turn are one with ``copies``; different texts of a turn are calls, or results, of their own
    under one identifier. System messages and all other roles, a NULL role too, are messages."""
    m = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                             F.col("text").cast("string").alias("text"))
    m = m.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    name = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - back).cast("string"))
    arguments = F.to_json(F.struct("text", "turn"), {"ignoreNullFields": "false"})
    calls = m.where("role = 'user'").select(name(0).alias("call_id"), name(2).alias("parent_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), "copies")
    results = m.where("role = 'assistant'").select(name(1).alias("call_id"), F.col("text").alias("content"), "copies")
    body = F.to_json(F.struct("conv_id", "role", "text", "turn"), {"ignoreNullFields": "false"})
    others = m.where("role IS NULL OR role NOT IN ('user', 'assistant')").select(name(0).alias("call_id"), body.alias("json"), "copies")
    # a call rests on an earlier one only if that one was answered
    answered = results.select(F.col("call_id").alias("parent_id"), F.lit(True).alias("answered")).where("parent_id IS NOT NULL").distinct()
    calls = calls.join(answered, "parent_id", "left").withColumn("parent_id", F.when(F.col("answered"), F.col("parent_id"))).drop("answered")
    return calls, results, others


def chats(conversations: DataFrame) -> DataFrame:
    """``link`` over ``messages``, and the other messages as rows of kind ``message``: every message is in some row.

    NULL texts are missing arguments, a NULL conv_id or turn links with nothing; no rows give no rows."""
    calls, results, others = messages(conversations)
    linked = link(calls, results)
    plain = others.select("call_id", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("int").alias("level"),
                          F.lit(False).alias("linked"), F.lit("").alias("errors"), "copies", "json")
    return linked.unionByName(plain)


ORACLE = """WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, count(*) AS copies FROM conversations GROUP BY ALL),
    c AS (SELECT conv_id || '-' || turn AS call_id, conv_id || '-' || (turn - 2) AS before, text, turn, copies FROM m WHERE role = 'user'),
    r AS (SELECT conv_id || '-' || (turn - 1) AS call_id, text AS content, copies FROM m WHERE role = 'assistant'),
    a AS (SELECT call_id, min(content) AS content FROM r WHERE call_id IS NOT NULL GROUP BY 1),
    p AS (SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.call_id = c.before) THEN before END AS parent_id FROM c),
    d AS (SELECT DISTINCT call_id, parent_id FROM p),
    lv AS (SELECT call_id, 0 AS level FROM d WHERE parent_id IS NULL OR parent_id NOT IN (SELECT call_id FROM p WHERE call_id IS NOT NULL)
           UNION ALL SELECT d.call_id, lv.level + 1 FROM d JOIN lv ON d.parent_id = lv.call_id)
    SELECT p.call_id, 'call' AS kind, p.parent_id, lv.level::INT AS level, a.call_id IS NOT NULL AS linked, CASE WHEN p.text IS NULL THEN 'missing:text' ELSE '' END AS errors, p.copies,
        '{"arguments":{"text":' || coalesce(to_json(p.text)::VARCHAR, 'null') || ',"turn":' || p.turn || '},"id":' || to_json(p.call_id) || ',"level":' || lv.level || ',"name":"reply","result":' || coalesce(to_json(a.content)::VARCHAR, 'null') || '}' AS json
    FROM p JOIN lv ON p.call_id = lv.call_id LEFT JOIN a ON a.call_id = p.call_id
    UNION ALL SELECT r.call_id, CASE WHEN c.call_id IS NULL THEN 'result' ELSE 'further result' END, NULL, NULL, c.call_id IS NOT NULL, CASE WHEN c.call_id IS NULL THEN 'no call' ELSE '' END, r.copies,
        '{"id":' || to_json(r.call_id) || ',"result":' || coalesce(to_json(r.content)::VARCHAR, 'null') || '}'
    FROM r LEFT JOIN (SELECT DISTINCT call_id FROM c) c ON c.call_id = r.call_id LEFT JOIN a ON a.call_id = r.call_id WHERE c.call_id IS NULL OR r.content IS DISTINCT FROM a.content
    UNION ALL SELECT conv_id || '-' || turn, 'message', NULL, NULL, false, '', copies,
        '{"conv_id":' || coalesce(conv_id::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"text":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"turn":' || coalesce(turn::VARCHAR, 'null') || '}'
    FROM m WHERE role IS NULL OR role NOT IN ('user', 'assistant')"""
