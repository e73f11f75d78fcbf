"""Chat formatting with tool calls: link, order, validate, serialise. Columns only.

* `link` joins calls and results by conversation and identifier. Per identifier the first call and the
  first result (by turn, then by content) are the pair; the rest are told as duplicates. The firsts
  are minima, so a hot identifier is combined before it is shuffled.
* `order` gives each call a level: the most references to a later call that a chain of references
  behind it has. Sorting by conversation, level, turn and identifier is a topological order: a
  reference to an earlier call never needs a higher level, one to a later call always does. So a
  conversation of any length in which calls refer back is in order at once, without a window over
  it; only conversations with a reference to a later call take rounds, as many as the longest chain
  behind one has. Calls in or behind a cycle have no level.
* `validate` checks the arguments against the tool's schema.
* `serialise` writes canonical JSON: keys in order, no blanks, numbers in their shortest exact form.

Defined cases: a row without conversation or identifier is linked with nothing (`no_id`); a call
without a result is `no_result`, a result without a call `orphan_result`; a reference to an unknown
identifier is an error of its call and no edge; arguments that are no JSON object are the error
`not_an_object`; an unknown tool is the error `unknown_tool`; equal rows are duplicates of one
another; empty tables give an empty result; extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ventide.llm.tables import stored

REFERENCE = r"\$\{([^}]+)\}"
KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN"}

#: tool, parameter, kind, required
SCHEMAS = (
    ("search", "query", "string", True), ("search", "limit", "integer", True), ("search", "after", "string", False),
    ("translate", "query", "string", True), ("translate", "lang", "string", True),
    ("translate", "after", "string", False), ("translate", "limit", "integer", False),
)


def schema_table(spark: SparkSession, schemas=SCHEMAS) -> DataFrame:
    """One row per tool with its parameters: name -> kind and whether it is required."""
    rows = spark.createDataFrame(list(schemas), "tool string, parameter string, kind string, required boolean")
    entry = F.struct("parameter", F.struct("kind", "required").alias("rule"))
    return rows.groupBy("tool").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("parameters"))


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """calls: conv, id, turn, name, arguments; results: conv, id, turn, content.

    Returns conv, id, turn, name, arguments, result, result_turn and status.
    """
    named = F.col("conv").isNotNull() & F.col("id").isNotNull()
    calls = calls.select("conv", "id", "turn", "name", "arguments")
    results = results.select("conv", "id", "turn", "content")
    counted_calls = calls.where(named).groupBy("conv", "id", "turn", "name", "arguments").agg(F.count("*").alias("n"))
    counted_results = results.where(named).groupBy("conv", "id", "turn", "content").agg(F.count("*").alias("n"))
    first_call = counted_calls.groupBy("conv", "id").agg(F.min(F.struct("turn", "name", "arguments")).alias("call"))
    first_result = counted_results.groupBy("conv", "id").agg(F.min(F.struct("turn", "content")).alias("answer"))
    pairs = first_call.join(first_result, ["conv", "id"], "full_outer").select(
        "conv", "id", F.coalesce("call.turn", "answer.turn").alias("turn"), "call.name", "call.arguments",
        F.col("answer.content").alias("result"), F.col("answer.turn").alias("result_turn"),
        F.when(F.col("call").isNull(), "orphan_result").when(F.col("answer").isNull(), "no_result")
        .otherwise("ok").alias("status"))

    def extra(counted: DataFrame, first: DataFrame, field: str, parts: list[str], status: str) -> DataFrame:
        """All but one of the first, and all that are not the first."""
        is_first = F.struct(*parts).eqNullSafe(F.col(field))
        return (
            counted.join(first, ["conv", "id"])
            .withColumn("n", F.col("n") - is_first.cast("int")).where("n > 0")
            .withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).withColumn("status", F.lit(status))
        )

    none = F.lit(None).cast("string")
    shape = ["conv", "id", "turn", "name", "arguments", "result", "result_turn", "status"]
    more_calls = extra(counted_calls, first_call, "call", ["turn", "name", "arguments"], "duplicate_call").select(
        "conv", "id", "turn", "name", "arguments", none.alias("result"), F.lit(None).cast("long").alias("result_turn"), "status")
    more_results = extra(counted_results, first_result, "answer", ["turn", "content"], "duplicate_result").select(
        "conv", "id", "turn", none.alias("name"), none.alias("arguments"), F.col("content").alias("result"),
        F.col("turn").alias("result_turn"), "status")
    lost_calls = calls.where(~named).select(
        "conv", "id", "turn", "name", "arguments", none.alias("result"), F.lit(None).cast("long").alias("result_turn"),
        F.lit("no_id").alias("status"))
    lost_results = results.where(~named).select(
        "conv", "id", "turn", none.alias("name"), none.alias("arguments"), F.col("content").alias("result"),
        F.col("turn").alias("result_turn"), F.lit("no_id").alias("status"))
    out = pairs.select(*shape)
    for other in (more_calls, more_results, lost_calls, lost_results):
        out = out.unionByName(other.select(*shape))
    return out


def references(arguments: Column) -> Column:
    """Identifiers that a JSON text refers to as ${identifier}."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(arguments, F.lit("")), F.lit(REFERENCE), F.lit(1)))


def order(linked: DataFrame) -> DataFrame:
    """Adds `level` to the calls that are linked, and `unknown`, the references to no call."""
    nodes = linked.where("status IN ('ok', 'no_result')").select("conv", "id", "turn", "arguments")
    wanted = nodes.select("conv", "id", "turn", F.explode(references(F.col("arguments"))).alias("needs"))
    known = nodes.select(F.col("conv").alias("_conv"), F.col("id").alias("_id"), F.col("turn").alias("_turn"))
    met = wanted.join(known, (F.col("conv") == F.col("_conv")) & (F.col("needs") == F.col("_id")), "left")
    ahead = F.struct(F.col("_turn").alias("turn"), F.col("_id").alias("id")) >= F.struct("turn", "id")
    met = stored(met.select("conv", "id", "needs", F.col("_id").isNotNull().alias("found"),
                            F.coalesce(ahead, F.lit(False)).cast("int").alias("ahead")), "references")
    unknown = met.where("not found").groupBy("conv", "id").agg(F.sort_array(F.collect_list("needs")).alias("unknown"))
    out = linked.join(unknown, ["conv", "id"], "left")
    is_call = F.col("status").isin("ok", "no_result")
    crossed = met.where("found AND ahead = 1").groupBy("conv").agg(F.count("*").alias("most"))
    edges = stored(met.where("found").join(crossed, "conv").select("conv", "id", "needs", "ahead", "most"), "ahead")
    level, before = None, -1
    while True:
        if level is None:
            reached = edges.withColumn("level", F.col("ahead").cast("long"))
        else:
            parent = level.select("conv", F.col("id").alias("needs"), F.col("level").alias("_of"))
            reached = edges.join(parent, ["conv", "needs"], "left").withColumn(
                "level", F.coalesce("_of", F.lit(0)) + F.col("ahead"))
        # Only a cycle takes a chain over all references ahead of its conversation.
        level = stored(reached.groupBy("conv", "id").agg(
            F.least(F.max("level"), F.max("most") + 1).alias("level"), F.max("most").alias("most")), "levels")
        total = level.agg(F.sum("level")).first()[0] or 0
        if total == before:
            break
        before = total
    told = level.select("conv", "id", F.when(F.col("level") <= F.col("most"), F.col("level")).alias("level"),
                        F.lit(True).alias("_told"))
    return (
        out.join(told, ["conv", "id"], "left")
        .withColumn("level", F.when(is_call, F.when(F.col("_told"), F.col("level")).otherwise(F.lit(0))).cast("int"))
        .drop("_told")
    )


def validate(ordered: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds `errors`, sorted; empty for a call that fits its schema and for what is no call."""
    args = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant(args).startswith("OBJECT"), F.lit(False))
    kinds = F.transform_values(
        F.when(is_object, F.try_variant_get(args, "$", "map<string, variant>")),
        lambda _, value: F.schema_of_variant(value))
    tools = schemas.select(F.col("tool").alias("_tool"), "parameters")
    wanted = {k: F.lit(v) for k, v in KINDS.items()}
    kind_of = F.create_map(*(x for k, v in wanted.items() for x in (F.lit(k), v)))
    given, rules = F.map_keys("_kinds"), F.map_entries("parameters")
    missing = F.transform(
        F.filter(rules, lambda r: r["value"]["required"] & ~F.array_contains(given, r["key"])),
        lambda r: F.concat(F.lit("missing:"), r["key"]))
    wrong = F.transform(
        F.filter(rules, lambda r: F.array_contains(given, r["key"])
                 & (F.element_at("_kinds", r["key"]) != F.element_at(kind_of, r["value"]["kind"]))),
        lambda r: F.concat(F.lit("type:"), r["key"]))
    surplus = F.transform(F.filter(given, lambda k: ~F.map_contains_key("parameters", k)),
                          lambda k: F.concat(F.lit("unexpected:"), k))
    unknown = F.transform(F.coalesce("unknown", F.array().cast("array<string>")), lambda u: F.concat(F.lit("reference:"), u))
    none = F.array().cast("array<string>")
    checks = (
        F.when(F.col("_kinds").isNull(), F.array(F.lit("not_an_object")))
        .when(F.col("parameters").isNull(), F.array(F.lit("unknown_tool")))
        .otherwise(F.concat(missing, wrong, surplus))
    )
    return (
        ordered.withColumn("_kinds", kinds).join(tools, F.col("name") == F.col("_tool"), "left")
        .withColumn("errors", F.when(F.col("status").isin("ok", "no_result"), F.sort_array(F.concat(checks, unknown)))
                    .otherwise(none))
        .drop("_kinds", "_tool", "parameters", "unknown")
    )


def quoted(text: Column) -> Column:
    """A JSON string, or null."""
    inner = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(inner, F.lit(6), F.length(inner) - 6))


def serialise(checked: DataFrame) -> DataFrame:
    """Adds `json`, one canonical object per row; arguments that are no JSON stay as text."""
    args = F.coalesce(F.to_json(F.try_parse_json("arguments")), quoted(F.col("arguments")))
    return checked.withColumn("json", F.concat(
        F.lit('{"arguments":'), args, F.lit(',"id":'), quoted(F.col("id")), F.lit(',"name":'), quoted(F.col("name")),
        F.lit(',"result":'), quoted(F.col("result")), F.lit("}")))


def format_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv, level, turn, id, name, status, errors, result_turn and json, one row per call or result."""
    linked = stored(link(calls, results), "linked")
    return serialise(validate(order(linked), schemas)).select(
        "conv", "level", "turn", "id", "name", "status", "errors", "result_turn", "json")


# --- from conversations ---------------------------------------------------------------------------

def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations read as tool use: a user's turn calls a tool, the assistant's turn after it
    is the result. A call refers to the one two turns before; in every seventh conversation one of
    four waits for the call after it instead, which then refers to none. Every fifth turn writes its
    limit as text, and languages are given in every second conversation, so that checks find
    something."""
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"))
    tool = F.element_at(F.array(F.lit("search"), F.lit("translate"), F.lit("lookup")),
                        (F.floor(F.col("turn") / 2) % 3 + 1).cast("int"))
    swapped, eighth = F.col("conv_id") % 7 == 3, F.floor(F.col("turn") % 8 / 2)
    other = F.when(swapped & (eighth == 1), F.col("turn") + 2).when(
        ~swapped | (eighth != 2), F.when(F.col("turn") >= 2, F.col("turn") - 2))
    after = F.concat(F.lit("${"), name, other.cast("string"), F.lit("}"))
    lang = F.when(F.col("conv_id") % 2 == 0, F.lit("en"))
    common = [F.col("text").alias("query"), after.alias("after"), lang.alias("lang")]
    arguments = F.when(F.col("turn") % 5 == 4, F.to_json(F.struct(F.col("turn").cast("string").alias("limit"), *common))
                       ).otherwise(F.to_json(F.struct(F.col("turn").alias("limit"), *common)))
    calls = turns.where("role = 'user'").select(
        F.col("conv_id").alias("conv"), F.concat(name, F.col("turn").cast("string")).alias("id"),
        F.col("turn"), tool.alias("name"), arguments.alias("arguments"))
    results = turns.where("role = 'assistant'").select(
        F.col("conv_id").alias("conv"), F.concat(name, (F.col("turn") - 1).cast("string")).alias("id"),
        F.col("turn"), F.col("text").alias("content"))
    return calls, results


#: The same rows in another engine's SQL.
ORACLE = r"""
WITH calls AS (
  SELECT conv_id AS conv, 'c' || conv_id || '-' || turn AS id, turn, text,
    (['search', 'translate', 'lookup'])[1 + (turn // 2) % 3] AS name,
    'c' || conv_id || '-' || CASE
      WHEN conv_id % 7 = 3 AND turn % 8 IN (2, 3) THEN turn + 2
      WHEN conv_id % 7 = 3 AND turn % 8 IN (4, 5) THEN NULL
      WHEN turn >= 2 THEN turn - 2 END AS needs
  FROM conversations WHERE role = 'user'),
results AS (
  SELECT conv_id AS conv, 'c' || conv_id || '-' || (turn - 1) AS id, turn, text
  FROM conversations WHERE role = 'assistant'),
known AS (
  SELECT c.*, c.needs IS NOT NULL AND p.id IS NULL AS lost, CASE WHEN p.turn > c.turn THEN 1 ELSE 0 END AS level
  FROM calls c LEFT JOIN calls p ON p.conv = c.conv AND p.id = c.needs),
pairs AS (
  SELECT coalesce(c.conv, r.conv) AS conv, coalesce(c.id, r.id) AS id, coalesce(c.turn, r.turn) AS turn, c.name, c.level,
    CASE WHEN c.id IS NULL THEN 'orphan_result' WHEN r.id IS NULL THEN 'no_result' ELSE 'ok' END AS status,
    r.turn AS result_turn, r.text AS result, c.lost, c.needs, c.id IS NOT NULL AS is_call, c.text AS query
  FROM known c FULL JOIN results r ON c.conv = r.conv AND c.id = r.id)
SELECT conv, level, turn, id, name, status,
  CASE WHEN NOT is_call THEN '' ELSE concat_ws(',',
    CASE WHEN name = 'translate' AND conv % 2 <> 0 THEN 'missing:lang' END,
    CASE WHEN name <> 'lookup' AND query IS NULL THEN 'missing:query' END,
    CASE WHEN lost THEN 'reference:' || needs END,
    CASE WHEN name <> 'lookup' AND turn % 5 = 4 THEN 'type:limit' END,
    CASE WHEN name = 'search' AND conv % 2 = 0 THEN 'unexpected:lang' END,
    CASE WHEN name = 'lookup' THEN 'unknown_tool' END) END AS errors,
  result_turn,
  '{"arguments":' || CASE WHEN NOT is_call THEN 'null' ELSE '{' || concat_ws(',',
      CASE WHEN needs IS NOT NULL THEN '"after":"${' || needs || '}"' END,
      CASE WHEN conv % 2 = 0 THEN '"lang":"en"' END,
      '"limit":' || CASE WHEN turn % 5 = 4 THEN '"' || turn || '"' ELSE turn::VARCHAR END,
      '"query":' || to_json(query)::VARCHAR) || '}' END
    || ',"id":"' || id || '","name":' || coalesce('"' || name || '"', 'null')
    || ',"result":' || coalesce(to_json(result)::VARCHAR, 'null') || '}' AS json
FROM pairs
"""
