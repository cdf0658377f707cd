"""Session logs of the two formats as record tables, and assertions about them. Record classes are CASE expressions over parsed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip


def records(lines: DataFrame) -> DataFrame:
    """(line_id, file_id, line_no, category, rec_type, payload_type, role, call_id, tool_name, call_side, ordinal, live) of format-two lines.

    category: meta, context, message, reasoning, call, result, event, compacted, unknown, or malformed. Lines before the last
    ``compacted`` record of a file are not live, but for session_meta.
    """
    v = F.when(strip(F.col("raw")).startswith("{"), F.try_parse_json(strip(F.col("raw"))))
    get = lambda p, t="string": F.try_variant_get(v, p, t)
    x = lines.select(
        "line_id", "file_id", "line_no", v.isNotNull().alias("ok"), get("$.type").alias("rec_type"), get("$.payload.type").alias("payload_type"), get("$.payload.role").alias("role"),
        F.coalesce(get("$.payload.call_id"), get("$.payload.callId"), get("$.payload.call_ref")).alias("call_id"), F.coalesce(get("$.payload.name"), get("$.payload.tool_name")).alias("tool_name"), get("$.ordinal", "int").alias("ordinal"),
    )
    kind = F.col("payload_type")
    category = (
        F.when(~F.col("ok"), "malformed").when(F.col("rec_type") == "session_meta", "meta").when(F.col("rec_type") == "turn_context", "context").when(F.col("rec_type") == "compacted", "compacted")
        .when(F.col("rec_type") == "event_msg", "event").when((F.col("rec_type") == "response_item") & (kind == "message"), "message").when((F.col("rec_type") == "response_item") & (kind == "reasoning"), "reasoning")
        .when((F.col("rec_type") == "response_item") & kind.isin("function_call", "custom_tool_call", "local_shell_call"), "call")
        .when((F.col("rec_type") == "response_item") & kind.isin("function_call_output", "custom_tool_call_output"), "result").otherwise("unknown")
    )
    x = x.withColumn("category", category).withColumn("call_side", F.when(F.col("category") == "call", "call").when(F.col("category") == "result", "result"))
    last = x.where("category = 'compacted'").groupBy("file_id").agg(F.max("line_no").alias("cut"))
    x = x.join(last, "file_id", "left")
    live = (F.col("category") != "malformed") & (F.col("cut").isNull() | (F.col("line_no") >= F.col("cut")) | (F.col("category") == "meta"))
    return x.withColumn("live", live).drop("cut", "ok")


def chat_records(rows: DataFrame) -> DataFrame:
    """(row_id, session_id, category, role) of format-one rows: side, meta, user, assistant, attachment, system, or unknown."""
    role = F.get_json_object("payload", "$.role")
    category = (
        F.when(F.coalesce("is_sidechain", F.lit(False)), "side").when(F.coalesce("is_meta", F.lit(False)), "meta").when(F.col("rec_type") == "user", F.when(role == "tool", "result").otherwise("user"))
        .when(F.col("rec_type") == "assistant", "assistant").when(F.col("rec_type") == "attachment", "attachment").when(F.col("rec_type").isin("system", "file-history-snapshot"), "system").otherwise("unknown")
    )
    return rows.where("uuid is not null").select("row_id", "session_id", category.alias("category"), role.alias("role"))


def exchanges(rec: DataFrame) -> DataFrame:
    """Records with exchange: how many user messages stand at or before each in its file."""
    w = Window.partitionBy("file_id").orderBy("line_no", "line_id")
    return rec.withColumn("exchange", F.sum(F.when((F.col("category") == "message") & (F.col("role") == "user"), 1).otherwise(0)).over(w))


def unanswered_calls(rec: DataFrame) -> DataFrame:
    """(file_id, call_id): live calls whose result is not in the file."""
    live = rec.where("live and call_id is not null")
    return live.where("call_side = 'call'").select("file_id", "call_id").distinct().join(live.where("call_side = 'result'").select("file_id", "call_id").distinct(), ["file_id", "call_id"], "left_anti")


def validate(rec: DataFrame) -> DataFrame:
    """(file_id, rule, n): broken rules of each file: first (does not begin with session_meta), parse, ordinals (not rising by one over
    distinct lines), results without a call, unknown records."""
    w = Window.partitionBy("file_id").orderBy("line_no", "line_id")
    first = rec.withColumn("r", F.row_number().over(w)).where("r = 1 and category <> 'meta'").select("file_id", F.lit("first").alias("rule"))
    parse = rec.where("category = 'malformed'").select("file_id", F.lit("parse").alias("rule"))
    ords = rec.where("ordinal is not null").select("file_id", "ordinal").distinct().groupBy("file_id").agg(F.count("*").alias("n"), F.min("ordinal").alias("a"), F.max("ordinal").alias("b")).where("a <> 0 or b - a + 1 <> n")
    ords = ords.select("file_id", F.lit("ordinals").alias("rule"))
    has = rec.where("call_id is not null")
    orphans = has.where("call_side = 'result'").join(has.where("call_side = 'call'").select("file_id", "call_id").distinct(), ["file_id", "call_id"], "left_anti").select("file_id", F.lit("result-without-call").alias("rule"))
    unknown = rec.where("category = 'unknown'").select("file_id", F.lit("unknown").alias("rule"))
    return first.unionByName(parse).unionByName(ords).unionByName(orphans).unionByName(unknown).groupBy("file_id", "rule").agg(F.count("*").alias("n"))


def newer_than(version: F.Column, tested: str) -> F.Column:
    """Whether a dotted version is above the tested one, by its numbers; null for one without numbers."""
    parts = F.transform(F.regexp_extract_all(version, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    mine = F.array(*[F.lit(int(x)) for x in tested.split(".")])
    return F.when(F.size(parts) > 0, parts > mine)
