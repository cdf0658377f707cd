"""Supersession: segments whose information a later one makes redundant. Window functions and one anti-join; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip

# fixed values: names of tools and keys of their payloads
READ_TOOLS = ("Read", "NotebookRead", "view", "str_replace_editor:view")
WRITE_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit", "create", "str_replace")
PATH_KEYS = ("file_path", "path", "notebook_path")
WRITE_COMMANDS = ("create", "str_replace", "insert", "undo_edit")
BODY_KEYS = ("new_string", "content", "edits", "new_str", "file_text")
READ_KEYS = (*PATH_KEYS, "offset", "limit", "view_range", "pages")


def payload(text: Column) -> Column:
    """A tool call's arguments as a map of JSON texts: of a JSON object, or of XML-like parameters; null for neither."""
    v = F.try_parse_json(strip(text))
    is_object = strip(text).startswith("{") & v.isNotNull()
    names = F.regexp_extract_all(text, F.lit(r"(?s)<parameter=([\w.-]+)>(.*?)</parameter>"), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(r"(?s)<parameter=([\w.-]+)>(.*?)</parameter>"), F.lit(2))
    quoted = F.transform(values, lambda x: F.to_json(F.struct(strip(x).alias("v"))))
    quoted = F.transform(quoted, lambda j: F.substring(j, 6, F.length(j) - 6))
    return F.when(is_object, F.from_json(strip(text), "map<string,string>")).when(F.size(names) > 0, F.map_from_arrays(names, quoted))


def _string(text: Column, key: str) -> Column:
    """A key's value where it is a string."""
    v = F.try_variant_get(F.try_parse_json(strip(text)), f"$.{key}", "variant")
    from_json = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(F.try_parse_json(strip(text)), f"$.{key}", "string"))
    from_xml = F.regexp_extract(text, rf"(?s)<parameter={key}>\s*(.*?)\s*</parameter>", 1)
    return F.when(strip(text).startswith("{"), from_json).otherwise(F.when(from_xml != "", from_xml))


def file_op(segments: DataFrame) -> DataFrame:
    """segments with op (read, write or null) and path of each tool call: by the tool's name, or without one by the payload's keys."""
    t = F.col("text")
    keys = F.when(strip(t).startswith("{"), F.map_keys(F.from_json(F.when(F.try_parse_json(strip(t)).isNotNull(), strip(t)), "map<string,string>"))).otherwise(
        F.regexp_extract_all(t, F.lit(r"<parameter=([\w.-]+)>"), F.lit(1))
    )
    path = F.coalesce(*[F.nullif(_string(t, k), F.lit("")) for k in PATH_KEYS])
    command = _string(t, "command")
    keyed = (
        F.when(command == "view", "read")
        .when(command.isin(*WRITE_COMMANDS), "write")
        .when(F.arrays_overlap(keys, F.array(*map(F.lit, BODY_KEYS))), "write")
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, READ_KEYS)))) == 0, "read")
    )
    name = F.nullif(F.col("tool_name"), F.lit(""))
    op = F.when(name.isin(*WRITE_TOOLS), "write").when(name.isin(*READ_TOOLS), "read").when(name.isNull(), keyed)
    call = F.col("kind") == "tool_use"
    return segments.withColumn("path", F.when(call, path)).withColumn("op", F.when(call & F.col("path").isNotNull(), op))


def attribute_results(segments: DataFrame) -> DataFrame:
    """(conv_id, result_id, call_id): results in the turn behind their calls: all of them of a single call, else by place where the numbers agree."""
    calls = segments.where("kind = 'tool_use'").select("conv_id", "turn", F.col("seg_id").alias("call_id"))
    results = segments.where("kind in ('tool_result', 'code')").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("seg_id").alias("result_id"))
    w = Window.partitionBy("conv_id", "turn")
    calls = calls.withColumn("c_at", F.row_number().over(w.orderBy("call_id"))).withColumn("c_n", F.count("*").over(w))
    results = results.withColumn("r_at", F.row_number().over(w.orderBy("result_id"))).withColumn("r_n", F.count("*").over(w))
    met = calls.join(results, ["conv_id", "turn"]).where("c_n = 1 or (c_n = r_n and c_at = r_at)")
    return met.select("conv_id", "result_id", "call_id")


def features(segments: DataFrame) -> DataFrame:
    """segments with what supersession needs of their texts: op and path of calls, and copy_key, a digest that copies share; null for blank
    and null texts. Worked out before any shuffle, these let the texts stay behind."""
    bare = strip(F.col("text"))
    return file_op(segments).withColumn("copy_key", F.when(bare != "", F.md5(bare)))


def find_superseded(segments: DataFrame) -> DataFrame:
    """(conv_id, seg_id, reason, by_id): a write by the next write of its path, a read by the next use of its path and with it its results,
    and a text by its last copy, even where that is superseded itself. Blank and null texts have no copies. segments may have features
    in place of texts."""
    segments = segments if "copy_key" in segments.columns else features(segments)
    ops = segments.where("kind = 'tool_use' and op is not null").select("conv_id", "seg_id", "path", "op")
    w = Window.partitionBy("conv_id", "path").orderBy("seg_id")
    next_write = F.min(F.when(F.col("op") == "write", F.col("seg_id"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    ops = ops.withColumn("by_id", F.when(F.col("op") == "write", next_write).otherwise(F.lead("seg_id").over(w))).where("by_id is not null")
    direct = ops.select("conv_id", "seg_id", F.when(F.col("op") == "write", "edit_superseded").otherwise("read_superseded").alias("reason"), "by_id", F.lit(1).alias("rank"))
    reads = direct.where("reason = 'read_superseded'").select("conv_id", F.col("seg_id").alias("call_id"), "by_id")
    dragged = attribute_results(segments).join(reads, ["conv_id", "call_id"]).select("conv_id", F.col("result_id").alias("seg_id"), F.lit("read_superseded").alias("reason"), "by_id", F.lit(2).alias("rank"))
    texts = segments.select("conv_id", "seg_id", "copy_key").where("copy_key is not null")
    last = texts.groupBy("conv_id", "copy_key").agg(F.max("seg_id").alias("by_id"))
    copies = texts.join(last, ["conv_id", "copy_key"]).where("seg_id < by_id").select("conv_id", "seg_id", F.lit("duplicate").alias("reason"), "by_id", F.lit(3).alias("rank"))
    first = direct.unionByName(dragged).unionByName(copies).groupBy("conv_id", "seg_id").agg(F.min(F.struct("rank", "by_id", "reason")).alias("s"))
    return first.select("conv_id", "seg_id", "s.reason", "s.by_id")


def apply_supersession(segments: DataFrame, superseded: DataFrame | None = None) -> DataFrame:
    """The segments that are not superseded."""
    gone = find_superseded(segments) if superseded is None else superseded
    return segments.join(gone.select("conv_id", "seg_id"), ["conv_id", "seg_id"], "left_anti")


def by_reason(segments: DataFrame) -> DataFrame:
    """(reason, n_segments, tokens, part of all tokens), and a row ALL of what any reason removes."""
    total = segments.agg(F.sum("tokens").alias("total"))
    s = find_superseded(segments).join(segments.select("conv_id", "seg_id", "tokens"), ["conv_id", "seg_id"])
    g = s.rollup("reason").agg(F.count("*").alias("n_segments"), F.sum("tokens").alias("tokens"))
    return g.join(F.broadcast(total)).select(F.coalesce("reason", F.lit("ALL")).alias("reason"), "n_segments", "tokens", F.round(F.col("tokens") / F.col("total"), 6).alias("part"))
