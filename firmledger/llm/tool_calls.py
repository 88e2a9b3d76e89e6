"""Tool calls linked to their results, ordered, validated and serialised (operator 8), native only.

Calls and results are tables; nothing collects a conversation.

- Linking is a hash join on (conv_id, call_id). A call's result is the earliest with its identifier; results that repeat an
  identifier or answer no call are counted or listed, never guessed about.
- Order: calls stand in the order of their turns wherever every call depends on earlier turns only. Conversations where one depends
  on its own turn or a later one, or where a turn is null, are put in order by peeling: a round gives a level to each call whose dependencies all have one. A round per level of such a
  conversation is needed; calls that no round reaches are on or behind a cycle and come last, marked as such.
- Arguments are parsed as a variant. Each required name must be there, every value must have the declared type, and no other
  name may occur. Canonical JSON has sorted keys, no spaces and numbers in shortest form.

A call without conversation or identifier is kept as ``unidentified``; one whose arguments are no JSON object or do not fit is
``invalid``. An identifier used by several calls is one row, from the earliest (``n_calls`` tells), and several results count
likewise (``n_results``). Dependencies on unknown calls do not bind. Extra columns are ignored; empty tables give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, words

#: Name -> {argument: (type as schema_of_variant names it, required)}.
SCHEMAS = {
    "ask": {"text": ("STRING", True), "words": ("BIGINT", True)},
    "follow_up": {"text": ("STRING", True), "turn": ("BIGINT", True), "words": ("BIGINT", True)},
}
NO_ARGUMENTS, UNKNOWN_TOOL = "arguments are no object", "unknown tool"


def problems(name: Column, arguments: Column, schemas: dict) -> Column:
    """Array of what is wrong with the arguments (a JSON string) of a call; empty if nothing is."""
    parsed, keys = F.try_parse_json(arguments), F.json_object_keys(arguments)
    found = F.array(F.lit(UNKNOWN_TOOL))
    for tool, fields in schemas.items():
        checks = []
        for field, (kind, needed) in fields.items():
            there = F.array_contains(keys, field)
            value = F.schema_of_variant(F.try_variant_get(parsed, f"$['{field}']", "variant"))
            checks.append(F.when(~there, F.lit(f"missing {field}") if needed else F.lit(None)).when(value != kind, F.lit(f"type of {field}")))
        known = F.array(*map(F.lit, fields)).cast("array<string>")
        more = F.transform(F.array_sort(F.array_except(keys, known)), lambda key: F.concat(F.lit("unknown "), key))
        found = F.when(name == tool, F.concat(F.array_compact(F.array(*checks).cast("array<string>")), more)).otherwise(found)
    return F.when(keys.isNull() | parsed.isNull(), F.array(F.lit(NO_ARGUMENTS))).otherwise(found)


def canonical(arguments: Column) -> Column:
    """Canonical JSON of a JSON object; null for anything else."""
    return F.when(F.json_object_keys(arguments).isNotNull(), F.to_json(F.try_parse_json(arguments)))


def ordered(calls: DataFrame) -> DataFrame:
    """Add ``level`` (0 where the turn order is right, -1 on or behind a cycle): order by level, then turn, inside a conversation."""
    edges = calls.select("conv_id", F.col("turn").alias("own"), F.col("call_id"), F.explode("depends_on").alias("on"))
    targets = calls.select("conv_id", F.col("call_id").alias("on"), F.col("turn").alias("other"))
    edges = cut(edges.join(targets, ["conv_id", "on"]), "call-edges")
    wrong = edges.where("other >= own OR other IS NULL OR own IS NULL").select("conv_id").distinct()
    nodes = cut(calls.join(wrong, "conv_id", "left_semi").select("conv_id", "call_id"), "call-nodes")
    levels, number = None, 1
    if not nodes.isEmpty():
        open_edges = cut(edges.join(wrong, "conv_id", "left_semi").select("conv_id", "call_id", "on").distinct(), "open-edges")
        while True:
            ready = nodes.join(open_edges.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")
            ready = cut(ready.withColumn("level", F.lit(number)), "ready-calls")
            if ready.isEmpty():
                break
            levels = ready if levels is None else levels.union(ready)
            done = ready.select("conv_id", F.col("call_id").alias("on"))
            nodes = cut(nodes.join(ready, ["conv_id", "call_id"], "left_anti"), "call-nodes")
            open_edges = cut(open_edges.join(done, ["conv_id", "on"], "left_anti"), "open-edges")
            number += 1
        levels = nodes.withColumn("level", F.lit(-1)) if levels is None else levels.union(nodes.withColumn("level", F.lit(-1)))
        return calls.join(levels, ["conv_id", "call_id"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    return calls.withColumn("level", F.lit(0))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row per call, from ``calls(conv_id, call_id, turn, name, arguments, depends_on)`` and ``results(conv_id, call_id, turn,
    content)``: conv_id, call_id, turn, level, name, status, problems, arguments, n_calls, result_turn, n_results, line.

    Calls of a conversation are in order by (level, turn, call_id). ``line`` is the call with its result as canonical JSON.
    """
    ids = [F.col("conv_id").cast("bigint").alias("conv_id"), F.col("call_id").cast("string").alias("call_id")]
    turn = F.col("turn").cast("bigint").alias("turn")
    calls = calls.select(
        *ids, turn, F.col("name").cast("string").alias("name"), F.col("arguments").cast("string").alias("arguments"),
        F.col("depends_on").cast("array<string>").alias("depends_on"),
    )
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("first")
    main = calls.where(known).groupBy("conv_id", "call_id").agg(first, F.count("*").alias("n_calls"))
    answers = results.select(*ids, turn, F.col("content").cast("string").alias("content")).where(known)
    answers = answers.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("answer"), F.count("*").alias("n_results"))
    main = cut(main.join(answers, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "first.*", "n_calls", "answer", "n_results"), "linked-calls")
    loose = calls.where(~known).withColumns(
        {"n_calls": F.lit(1).cast("bigint"), "answer": F.lit(None).cast(main.schema["answer"].dataType), "n_results": F.lit(None).cast("bigint"), "level": F.lit(0)}
    )
    rows = ordered(main).unionByName(loose)
    rows = rows.withColumns({"problems": problems(F.col("name"), F.col("arguments"), schemas), "arguments": canonical(F.col("arguments"))})
    status = (
        F.when(~known, "unidentified")
        .when(F.col("level") < 0, "cyclic")
        .when(F.size("problems") > 0, "invalid")
        .when(F.col("answer").isNull(), "unanswered")
        .otherwise("linked")
    )
    rest = F.to_json(F.struct("call_id", "conv_id", "name", F.col("answer.content").alias("result")))
    return rows.select(
        "conv_id", "call_id", "turn", F.col("level").cast("int").alias("level"), "name", status.alias("status"), "problems", "arguments", "n_calls",
        F.col("answer.turn").alias("result_turn"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.when(status == "linked", F.concat(F.lit('{"arguments":'), F.col("arguments"), F.lit(","), F.substring(rest, 2, 2**31 - 1))).alias("line"),
    )


def orphan_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results that answer no call."""
    return results.join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that plain conversations stand for: a user turn asks, the assistant turn right after it answers.

    The opening question is an ``ask``; a later one is a ``follow_up`` that depends on the question two turns before. Everything
    is arithmetic on a turn's own number, so no conversation is gathered.
    """
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role"), F.col("text").cast("string").alias("text")
    )
    call_id = lambda turn: F.concat(F.lit("c"), turn.cast("string"))
    opening = F.col("turn") < 2
    fields = [F.col("text"), F.size(words("text")).alias("words")]
    arguments = F.when(opening, F.to_json(F.struct(*fields))).otherwise(F.to_json(F.struct(fields[1], F.col("turn"), fields[0])))
    calls = turns.where("role = 'user'").select(
        "conv_id", call_id(F.col("turn")).alias("call_id"), "turn", F.when(opening, "ask").otherwise("follow_up").alias("name"),
        arguments.alias("arguments"), F.when(~opening, F.array(call_id(F.col("turn") - 2))).alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def linked_conversations(conversations: DataFrame) -> DataFrame:
    return link_calls(*calls_of(conversations))


ORACLE_SQL = r"""
WITH u AS (SELECT conv_id, 'c' || turn AS call_id, turn, turn < 2 AS opening, text, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n
           FROM conversations WHERE role = 'user'),
c AS (SELECT *, count(*) OVER (PARTITION BY conv_id, call_id) AS n_calls, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY text) AS k,
             CASE WHEN opening THEN json_object('text', text, 'words', n) ELSE json_object('text', text, 'turn', turn, 'words', n) END::VARCHAR AS arguments FROM u),
r AS (SELECT conv_id, 'c' || (turn - 1) AS call_id, min(turn) AS result_turn, min(text) AS result, count(*) AS n_results
      FROM conversations WHERE role = 'assistant' GROUP BY 1, 2)
SELECT conv_id, call_id, turn, 0 AS level, CASE WHEN opening THEN 'ask' ELSE 'follow_up' END AS name,
       CASE WHEN result_turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status, arguments, n_calls, result_turn, coalesce(n_results, 0) AS n_results,
       CASE WHEN result_turn IS NOT NULL THEN '{"arguments":' || arguments || ',"call_id":' || to_json(call_id)::VARCHAR || ',"conv_id":' || conv_id || ',"name":"'
            || CASE WHEN opening THEN 'ask' ELSE 'follow_up' END || '","result":' || to_json(result)::VARCHAR || '}' END AS line
FROM c LEFT JOIN r USING (conv_id, call_id) WHERE k = 1
"""
