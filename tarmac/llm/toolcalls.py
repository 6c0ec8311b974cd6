"""Chat formatting: linking tool calls with their results.

Calls and results are hash-joined by conversation and identifier (results
first reduced to one per identifier, so the built side has one row a key;
rows without an identifier never enter the join). Calls are ordered
topologically: a call that refers to other calls comes one level after the
last of them, found by taking away calls without open references round by
round; calls on a cycle keep no level. Arguments are validated against the
tool's schema, and each call is serialised as canonical JSON: keys sorted, no
white space. Everything is DataFrame expressions; arguments are variants.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import cut

# tool: {field: (JSON kind, required)}
SCHEMAS = {
    "count": {"exact": ("BOOLEAN", True), "of": ("STRING", True)},
    "note": {"text": ("STRING", True)},
    "search": {"after": ("STRING", False), "limit": ("BIGINT", True), "query": ("STRING", True)},
}
REFERENCE = "after"   # field with the identifier of a call, or a list of them
KEY = ["conv", "call_id"]


def argument_errors(name: Column, args: Column, schemas=SCHEMAS) -> Column:
    """Array of errors of parsed arguments (a variant, null if malformed):
    by field, missing or of the wrong kind first, then fields unknown."""
    none = F.array().cast("array<string>")
    out = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        kinds = []
        for field, (kind, required) in sorted(fields.items()):
            value = F.try_variant_get(args, f"$.{field}", "variant")
            missing = F.array(F.lit(f"missing {field}")) if required else none
            kinds.append(F.when(value.isNull(), missing).when(F.schema_of_variant(value) == kind, none)
                         .otherwise(F.array(F.lit(f"not {kind}: {field}"))))
        known = F.array(*[F.lit(f) for f in sorted(fields)])
        extra = F.transform(F.array_sort(F.array_except(F.json_object_keys(F.to_json(args)), known)), lambda f: F.concat(F.lit("unknown "), f))
        out = F.when(name == tool, F.concat(*kinds, extra)).otherwise(out)
    shape = F.when(F.schema_of_variant(args).startswith("OBJECT"), out).otherwise(F.array(F.lit("not an object")))
    return F.when(args.isNull(), F.array(F.lit("malformed"))).otherwise(shape)


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``conv, call_id, level`` of nodes (conv, call_id) under edges (conv,
    call_id, dep): 0 without references, else one more than the highest
    referred to. Nodes on or behind a cycle are left out. A round per level."""
    open_ = cut(edges.select(*KEY, "dep").distinct())
    ready = cut(nodes.join(open_, KEY, "left_anti").withColumn("level", F.lit(0)))
    out, level = [ready], 0
    while not open_.isEmpty():
        level += 1
        done = ready.select("conv", F.col("call_id").alias("dep"))
        still = cut(open_.join(done, ["conv", "dep"], "left_anti").select(*KEY, "dep"))
        ready = cut(open_.select(*KEY).distinct().join(still, KEY, "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        out.append(ready)
        open_ = still
    return reduce(DataFrame.unionByName, out)


def link(calls: DataFrame, results: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """One row per call and per result without a call: ``conv, turn, call_id,
    status, level, errors, result_turn, canonical``.

    calls: conv, turn, call_id, name, arguments (JSON text); results: conv,
    turn, call_id, content. Of several calls with one identifier the earliest
    turn is meant, the others are ``duplicate``; of several results the
    earliest counts. ``status`` is otherwise linked, unanswered, cyclic (its
    references never resolve), no identifier (null), or orphan result.
    References to identifiers that are no call are errors. Null or malformed
    arguments are errors and serialise as null. Repeated rows share their
    result; empty tables give what the other gives.
    """
    calls = calls.select("conv", "turn", "call_id", "name", "arguments").withColumn("args", F.try_parse_json("arguments"))
    named = calls.where("conv is not null and call_id is not null")
    first = named.groupBy(*KEY).agg(F.min("turn").alias("first_turn"))
    answers = (results.where("conv is not null and call_id is not null").groupBy(*KEY)
               .agg(F.min(F.struct("turn", "content")).alias("r")).select(*KEY, F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content")))
    known = named.join(first, KEY).withColumn("main", F.col("turn").eqNullSafe(F.col("first_turn")))
    refs = F.coalesce(F.try_variant_get("args", f"$.{REFERENCE}", "array<string>"),
                      F.array_compact(F.array(F.try_variant_get("args", f"$.{REFERENCE}", "string"))))
    edges = known.where("main").select(*KEY, F.explode(refs).alias("dep")).distinct()
    real = cut(edges.join(first.select("conv", F.col("call_id").alias("dep")), ["conv", "dep"]))
    unknown = (edges.join(real, [*KEY, "dep"], "left_anti").groupBy(*KEY)
               .agg(F.sort_array(F.collect_set(F.concat(F.lit("unknown reference "), "dep"))).alias("lost")))
    rank = levels(first.select(*KEY), real)
    joined = (known.join(answers.hint("shuffle_hash"), KEY, "left").join(rank, KEY, "left").join(unknown, KEY, "left"))
    status = (F.when(~F.col("main"), "duplicate").when(F.col("level").isNull(), "cyclic")
              .when(F.col("result_turn").isNull(), "unanswered").otherwise("linked"))
    main = F.col("main")
    joined = joined.select(*KEY, "turn", "name", "args", status.alias("status"), F.when(main, F.col("level")).alias("level"),
                           F.when(main, F.col("lost")).alias("lost"), F.when(main, F.col("result_turn")).alias("result_turn"),
                           F.when(main, F.col("content")).alias("content"))
    without = calls.where("conv is null or call_id is null").select(*KEY, "turn", "name", "args", F.lit("no identifier").alias("status"))
    rows = joined.unionByName(without, allowMissingColumns=True)
    errors = F.concat(argument_errors(F.col("name"), F.col("args"), schemas), F.coalesce("lost", F.array().cast("array<string>")))
    done = rows.select("conv", "turn", "call_id", "status", "level", errors.alias("errors"), "result_turn",
                       canonical(F.col("args"), F.col("call_id"), F.col("name"), F.col("content")).alias("canonical"))
    orphans = (results.join(first.select(*KEY), KEY, "left_anti").select("conv", "turn", "call_id", F.lit("orphan result").alias("status"),
               F.col("turn").alias("result_turn"), _object(call_id=F.to_json(F.to_variant_object(F.array("call_id"))), result=F.to_json(F.to_variant_object(F.array("content")))).alias("canonical")))
    return done.unionByName(orphans, allowMissingColumns=True)


def _object(**parts: Column) -> Column:
    """A JSON object of fields given as one-element JSON arrays, by name."""
    inner = [F.concat(F.lit(f'"{k}":'), F.expr("null") if v is None else v.substr(F.lit(2), F.length(v) - 2)) for k, v in sorted(parts.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *inner), F.lit("}"))


def canonical(args: Column, call_id: Column, name: Column, content: Column) -> Column:
    """Canonical JSON of a call: arguments, call_id, name, result."""
    one = {"call_id": call_id, "name": name, "result": content}
    parts = {k: F.to_json(F.to_variant_object(F.array(v))) for k, v in one.items()}
    return _object(arguments=F.concat(F.lit("["), F.coalesce(F.to_json(args), F.lit("null")), F.lit("]")), **parts)


# Calls and results read from the turns of ``conversations``: an assistant's
# turn is a call, the turn behind it its result. Which tool, and what is wrong
# with it, follows from the turn's number of words and its first Latin word.
CALLS = r"""
SELECT conv_id AS conv, turn, 'c' || turn AS call_id, name,
       CASE name WHEN 'search' THEN '{ "query": "' || w || '", "limit": ' || n || CASE WHEN n % 2 = 0 AND turn >= 3 THEN ', "after": "c' || (turn - 2) || '"' ELSE '' END || ' }'
                 WHEN 'count' THEN CASE WHEN n % 7 = 0 THEN '{"of": 5, "by": [1, {"b": 2, "a": 1}]}' ELSE '{"of":  "' || w || '", "exact": true}' END
                 ELSE CASE WHEN n % 11 = 0 THEN '{"text": ' ELSE '{"text": "' || w || ' ' || n || '"}' END END AS arguments
FROM (SELECT conv_id, turn, n, w, CASE n % 5 WHEN 0 THEN 'count' WHEN 1 THEN 'note' WHEN 2 THEN 'other' ELSE 'search' END AS name
      FROM (SELECT conv_id, turn, length(regexp_replace(coalesce(text, ''), '[^ ]', '', 'g')) + 1 AS n,
                   regexp_extract(coalesce(text, ''), '[A-Za-z]+', 0) AS w FROM conversations WHERE role = 'assistant'))
"""
RESULTS = r"""
SELECT conv_id AS conv, turn, CASE WHEN n % 13 = 0 THEN 'x' ELSE 'c' END || (turn - 1) AS call_id, w || ' ' || n AS content
FROM (SELECT conv_id, turn, length(regexp_replace(coalesce(text, ''), '[^ ]', '', 'g')) + 1 AS n,
             regexp_extract(coalesce(text, ''), '[A-Za-z]+', 0) AS w FROM conversations WHERE role = 'user' AND turn >= 2)
"""


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of the turns (``CALLS``, ``RESULTS``)."""
    view = f"conversations_{uuid.uuid4().hex}"
    conversations.createOrReplaceTempView(view)

    def run(sql: str) -> DataFrame:
        return conversations.sparkSession.sql(sql.replace(", 'g')", ")").replace("FROM conversations", f"FROM {view}"))
    return run(CALLS), run(RESULTS)


def digest(conversations: DataFrame) -> DataFrame:
    calls, results = from_conversations(conversations)
    out = link(calls, results)
    return out.select(F.col("conv").alias("conv_id"), "turn", "call_id", "status", "level", F.array_join("errors", "; ").alias("errors"), "result_turn", "canonical")


ORACLE = rf"""
WITH RECURSIVE c AS ({CALLS}), r AS ({RESULTS}),
a AS (SELECT conv, call_id, min(turn) AS result_turn, arg_min(content, turn) AS content FROM r GROUP BY ALL),
j AS (SELECT *, CASE WHEN json_valid(arguments) THEN arguments::JSON END AS args FROM c),
e AS (SELECT conv, call_id, args->>'after' AS dep FROM j WHERE (args->>'after') IS NOT NULL),
k AS (SELECT e.* FROM e JOIN c ON c.conv = e.conv AND c.call_id = e.dep),
l(conv, call_id, level) AS (
  SELECT conv, call_id, 0 FROM c ANTI JOIN k USING (conv, call_id)
  UNION ALL SELECT k.conv, k.call_id, level + 1 FROM l JOIN k ON k.conv = l.conv AND k.dep = l.call_id),
v AS (SELECT j.*, level, result_turn, content, k.dep AS known, args->>'after' AS dep,
  CASE WHEN args IS NULL THEN 'malformed'
       WHEN name = 'count' THEN concat_ws('; ', CASE WHEN (args->'exact') IS NULL THEN 'missing exact' END,
            CASE WHEN json_type(args, '$.of') <> 'VARCHAR' THEN 'not STRING: of' END, CASE WHEN (args->'by') IS NOT NULL THEN 'unknown by' END)
       WHEN name IN ('search', 'note') THEN '' ELSE 'unknown tool' END AS wrong
  FROM j LEFT JOIN l USING (conv, call_id) LEFT JOIN a USING (conv, call_id) LEFT JOIN k USING (conv, call_id))
SELECT conv AS conv_id, turn, call_id, CASE WHEN result_turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status, level,
  concat_ws('; ', nullif(wrong, ''), CASE WHEN dep IS NOT NULL AND known IS NULL THEN 'unknown reference ' || dep END) AS errors, result_turn,
  '{{"arguments":' || CASE WHEN args IS NULL THEN 'null'
     WHEN name = 'search' THEN '{{' || CASE WHEN dep IS NULL THEN '' ELSE '"after":"' || dep || '",' END || '"limit":' || (args->>'limit') || ',"query":' || (args->'query')::VARCHAR || '}}'
     WHEN (args->'by') IS NOT NULL THEN '{{"by":[1,{{"a":1,"b":2}}],"of":5}}'
     WHEN name = 'count' THEN '{{"exact":true,"of":' || (args->'of')::VARCHAR || '}}'
     ELSE '{{"text":' || (args->'text')::VARCHAR || '}}' END
  || ',"call_id":"' || call_id || '","name":"' || name || '","result":' || CASE WHEN content IS NULL THEN 'null' ELSE '"' || content || '"' END || '}}' AS canonical
FROM v
UNION ALL
SELECT conv, turn, call_id, 'orphan result', NULL, NULL, turn, '{{"call_id":"' || call_id || '","result":"' || content || '"}}'
FROM r ANTI JOIN c USING (conv, call_id)
"""
