"""Transcripts from files and to files: session logs by line, message lists, and the engine's own block lines.

Readers are tolerant: what is unknown is left out and counted by reason. All parsing is done by built-in functions over text lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import blank, strip

ROLES = ("user", "assistant", "system", "tool")
KINDS = ("text", "code", "tool_use", "tool_result", "thinking")
_PART = "type string, text string, thinking string, name string, input string, content string"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw): the lines of text files in their order within the file; lines are numbered from 0.

    A file is read whole by one task in order, so that numbers need no shuffle; files are spread over the tasks.
    """
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    return t.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("line", "raw"))


def _json(raw: Column) -> Column:
    return F.when(strip(raw).startswith("{"), F.try_parse_json(strip(raw)))


def _field(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def flat_text(content: Column) -> Column:
    """The text of a tool result: a string, or the text parts of a list joined by line feeds."""
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    listed = F.array_join(F.filter(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), lambda x: x != ""), "\n")
    return F.when(F.ltrim(content).startswith("["), F.coalesce(listed, content)).otherwise(content)


def split_fences(text: Column) -> Column:
    """Array of (kind, text, lang): text around code fences and the code within them, stripped, none empty; an open fence is text."""
    marked = F.regexp_replace(text, r"(?s)```([\w+#.-]*)[ \t]*\n(.*?)```", "\x01C$1\x02$2\x01T")
    pieces = F.split(F.concat(F.lit("T"), marked), "\x01")
    body = lambda p: F.substring(p, 2, F.length(p))
    code = lambda p: F.struct(F.lit("code").alias("kind"), strip(F.substring_index(p, "\x02", -1)).alias("text"), F.nullif(F.substring_index(body(p), "\x02", 1), F.lit("")).alias("lang"))
    plain = lambda p: F.struct(F.lit("text").alias("kind"), strip(body(p)).alias("text"), F.lit(None).cast("string").alias("lang"))
    return F.filter(F.transform(pieces, lambda p: F.when(p.startswith("C"), code(p)).otherwise(plain(p))), lambda s: s["text"] != "")


def _blocks(role: Column, content: Column) -> tuple[Column, Column]:
    """(blocks, skipped): a message's content as blocks, and the kinds of parts that were left out."""
    meta = lambda k, v: F.when(v.isNotNull(), F.create_map(F.lit(k), v)).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    make = lambda kind, text, m: F.struct(kind.alias("kind"), text.alias("text"), m.alias("meta"))
    fenced = lambda t: F.transform(split_fences(t), lambda p: make(F.when(role == "tool", F.lit("tool_result")).otherwise(p["kind"]), p["text"], meta("lang", p["lang"])))
    none = F.lit(None).cast("string")
    parts = F.from_json(content, f"array<struct<{', '.join(f'{x.split()[0]}:{x.split()[1]}' for x in _PART.split(', '))}>>")

    def one(p):
        return (
            F.when(p["type"].isin("text", "input_text", "output_text"), fenced(p["text"]))
            .when(p["type"] == "thinking", F.array(make(F.lit("thinking"), strip(p["thinking"]), meta("name", none))))
            .when(p["type"] == "tool_use", F.array(make(F.lit("tool_use"), F.coalesce(p["input"], F.lit("{}")), meta("name", p["name"]))))
            .when(p["type"] == "tool_result", F.array(make(F.lit("tool_result"), flat_text(p["content"]), meta("name", none))))
        )

    known = ("text", "input_text", "output_text", "thinking", "tool_use", "tool_result")
    listed = F.flatten(F.filter(F.transform(parts, one), lambda b: b.isNotNull()))
    is_list = F.ltrim(content).startswith("[") & parts.isNotNull()
    out = F.filter(F.when(is_list, listed).otherwise(fenced(content)), lambda b: ~blank(b["text"]))
    skipped = F.when(is_list, F.transform(F.filter(parts, lambda p: ~F.coalesce(p["type"], F.lit("")).isin(*known)), lambda p: F.concat(F.lit("block:"), F.coalesce(p["type"], F.lit("none")))))
    return out, F.coalesce(skipped, F.array().cast("array<string>"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Kept turns numbered from 0 by file and line."""
    w = Window.partitionBy("file").orderBy("line")
    return rows.withColumn("turn", (F.row_number().over(w) - 1).cast("int")).select("file", "turn", "role", "blocks")


def session_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, skipped) of a log with one record a line: file, turn, role, blocks; and file, reason, n.

    Records of type user and assistant hold messages; malformed lines, lines that are no object and other types are counted. A turn
    without a block is no turn.
    """
    v = _json(F.col("raw"))
    x = lines.select("file", "line", v.isNotNull().alias("ok"), _field(v, "$.type").alias("type"), _field(v, "$.message.role").alias("role"), F.get_json_object("raw", "$.message.content").alias("content"), strip(F.col("raw")).alias("raw"))
    whole = F.try_parse_json("raw").isNotNull()
    reason = F.when(F.col("raw") == "", None).when(~F.col("ok"), F.when(whole, "non-object").otherwise("malformed")).when(~F.coalesce(F.col("type").isin("user", "assistant"), F.lit(False)), F.concat(F.lit("type:"), F.coalesce("type", F.lit("none"))))
    x = x.withColumn("reason", reason)
    blocks, skipped = _blocks(F.coalesce("role", "type"), F.col("content"))
    good = x.where("reason is null and ok").select("file", "line", F.coalesce("role", "type").alias("role"), blocks.alias("blocks"), skipped.alias("skipped"))
    gone = x.where("reason is not null").select("file", "reason").unionByName(good.select("file", F.explode("skipped").alias("reason")))
    return _numbered(good.where(F.size("blocks") > 0)), gone.groupBy("file", "reason").agg(F.count("*").alias("n"))


def message_list(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, skipped) of JSON documents (file, raw) that are a list of messages or have one under "messages"."""
    text = strip(F.col("raw"))
    found = F.when(text.startswith("["), text).otherwise(F.get_json_object(text, "$.messages"))
    items = docs.select("file", F.posexplode(F.from_json(found, "array<string>")).alias("line", "item"))
    v = _json(F.col("item"))
    x = items.select("file", "line", v.isNotNull().alias("ok"), _field(v, "$.role").alias("role"), F.get_json_object("item", "$.content").alias("content"))
    reason = F.when(~F.col("ok"), "message:non-dict").when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), F.concat(F.lit("role:"), F.coalesce("role", F.lit("none"))))
    x = x.withColumn("reason", reason)
    blocks, skipped = _blocks(F.col("role"), F.col("content"))
    good = x.where("reason is null").select("file", "line", "role", blocks.alias("blocks"), skipped.alias("skipped"))
    gone = x.where("reason is not null").select("file", "reason").unionByName(good.select("file", F.explode("skipped").alias("reason")))
    return _numbered(good.where(F.size("blocks") > 0)), gone.groupBy("file", "reason").agg(F.count("*").alias("n"))


_LINE = "struct<turn:int,role:string,blocks:array<struct<kind:string,text:string,meta:map<string,string>>>>"


def write_block_lines(turns: DataFrame, path: str, header: dict[str, str]) -> None:
    """Text files of a header object and a line for each turn, a folder for each conversation, turns in order within a file."""
    head = F.to_json(F.create_map(*[F.lit(x) for kv in header.items() for x in kv])) if header else F.lit("{}")
    rows = turns.select("conv_id", F.col("turn").alias("at"), F.to_json(F.struct("turn", "role", "blocks")).alias("value"))
    heads = turns.select("conv_id").distinct().select("conv_id", F.lit(-1).alias("at"), head.alias("value"))
    rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "at").select("conv_id", "value").write.mode("overwrite").partitionBy("conv_id").text(path)


def read_block_lines(lines: DataFrame) -> DataFrame:
    """(file, turn, role, blocks) of lines that write_block_lines made; the header and lines of another shape are passed over."""
    x = lines.select("file", "line", F.from_json("raw", _LINE).alias("t")).where("t.role is not null and t.blocks is not null")
    return x.select("file", "t.turn", "t.role", F.filter("t.blocks", lambda b: b["kind"].isin(*KINDS) & ~blank(b["text"])).alias("blocks")).where(F.size("blocks") > 0)


def from_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Turns and what was skipped, by the suffix: .jsonl is a session log, .json a list of messages; others are refused."""
    if path.endswith(".jsonl"):
        return session_log(text_lines(spark, path))
    if path.endswith(".json"):
        return message_list(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("raw")))
    raise ValueError("neither .jsonl nor .json: " + path)


def spread(rows: DataFrame, order: str, n: int, group: str) -> DataFrame:
    """Of each group about n rows at even places of an order, first and last among them; fewer rows are all taken."""
    w = Window.partitionBy(group)
    r = rows.withColumn("_r", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    # row r is chosen where it is the rounding of some i * (n - 1) / (k - 1)
    k = F.least(F.lit(n), F.col("_n"))
    place = F.when(k > 1, F.rint(F.rint(F.col("_r") * (k - 1) / F.greatest(F.col("_n") - 1, F.lit(1))) * (F.col("_n") - 1) / F.greatest(k - 1, F.lit(1)))).otherwise(0)
    return r.where(F.col("_r") == place).drop("_r", "_n")


def missing(planned: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What is planned and not yet done, by identity."""
    return planned.join(done.select(*keys).distinct(), list(keys), "left_anti")


def latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Of an append-only table the last row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("r")).select(*keys, "r.*")
