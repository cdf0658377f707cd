"""Planning the handoff of a session: what stays verbatim, what may be compressed, and what a marker says of it.

Calls and their results form units that are kept or dropped together. Units, the protected tail and the region are found by windows and
aggregations over record tables; only the fixed point that keeps units whole is a loop, and it ends after as many rounds as units straddle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import blank
from tessera.runtime import cut

TAIL_TOKENS = 4000
#: This engine's own marks, each with its fields.
MARKER = "[tessera: compressed from session "
GAP = "[tessera: lines trimmed]"
TRIMMED = "[tessera: output trimmed]"


def marker_text(source: Column, date: Column, kept: Column, total: Column, tail: Column) -> Column:
    """The marker that stands where compressed turns begin."""
    return F.format_string(MARKER + "%s on %s; kept %d of %d tokens before the last %d tokens, which are verbatim]", source, date, kept, total, tail)


def prior_fork(text: Column, tokens_after: Column) -> Column:
    """(source, date, added) that a marker's text tells; null for other text. added is never below 0."""
    p = r"^\[tessera: compressed from session (\S+) on ([^;]+); kept (\d+) of \d+ tokens before the last (\d+) tokens"
    part = lambda i: F.regexp_extract(text, p, i)
    added = F.greatest(F.lit(0), tokens_after - part(3).try_cast("int") - part(4).try_cast("int"))
    return F.when(text.rlike(p), F.struct(part(1).alias("source"), part(2).alias("date"), added.alias("added")))


def strip_placeholders(text: Column) -> Column:
    """Text without this engine's trim marks and the lines that hold nothing else."""
    bare = lambda x: F.replace(F.replace(x, F.lit(GAP), F.lit("")), F.lit(TRIMMED), F.lit(""))
    kept = F.filter(F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("was"), bare(x).alias("now"))), lambda x: ~blank(x["now"]) | blank(x["was"]))
    return F.when(F.contains(text, F.lit(GAP)) | F.contains(text, F.lit(TRIMMED)), F.array_join(F.transform(kept, lambda x: x["now"]), "\n")).otherwise(text)


def clean(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, blocks) without markers and trim marks (calls and thinking are never touched), without emptied turns, renumbered."""
    fixed = F.transform("blocks", lambda b: F.struct(b["kind"].alias("kind"), F.when(b["kind"].isin("tool_use", "thinking"), b["text"]).otherwise(strip_placeholders(b["text"])).alias("text"), b["meta"].alias("meta")))
    kept = turns.withColumn("blocks", F.filter(fixed, lambda b: ~blank(b["text"]) & ~b["text"].startswith(MARKER))).where(F.size("blocks") > 0)
    w = Window.partitionBy("conv_id").orderBy("turn")
    return kept.withColumn("turn", F.row_number().over(w) - 1)


def units(rec: DataFrame) -> DataFrame:
    """(file_id, pos, unit): records that share a call id, by any chain, have one unit, named by its first position.

    Labels of the smallest position spread over shared call ids until none changes.
    """
    members = cut(rec.where("call_id is not null").select("file_id", "pos", "call_id").distinct())
    label = members.groupBy("file_id", "pos").agg(F.min("pos").alias("unit"))
    while True:
        by_call = members.join(label, ["file_id", "pos"]).groupBy("file_id", "call_id").agg(F.min("unit").alias("m"))
        new = cut(members.join(by_call, ["file_id", "call_id"]).groupBy("file_id", "pos").agg(F.min("m").alias("unit")))
        changed = new.join(label.withColumnRenamed("unit", "old"), ["file_id", "pos"]).where("unit <> old").limit(1).count()
        label = new
        if not changed:
            break
    return rec.select("file_id", "pos").join(label, ["file_id", "pos"], "left").withColumn("unit", F.coalesce("unit", "pos"))


def live_records(rec: DataFrame, tokens: DataFrame) -> DataFrame:
    """Live records with pos (from 0 in their file) and tokens."""
    w = Window.partitionBy("file_id").orderBy("line_no", "line_id")
    return rec.where("live").join(tokens, "line_id", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("pos", F.row_number().over(w) - 1)


def split_region(live: DataFrame, protect: int = TAIL_TOKENS) -> DataFrame:
    """(file_id, tail_from, end): the tail begins with the last user message, is extended back to protect tokens and to the beginning of
    every unit that reaches into it; all before it may be compressed."""
    w = Window.partitionBy("file_id").orderBy("pos")
    total = Window.partitionBy("file_id")
    x = live.withColumn("after", F.sum("tokens").over(total) - F.sum("tokens").over(w) + F.col("tokens")).withColumn("prompt", (F.col("category") == "message") & (F.col("role") == "user"))
    # records from which on there are protect tokens or more; the last of them begins the tail, if it is not behind the last prompt
    found = x.groupBy("file_id").agg(F.max(F.when(F.col("after") >= protect, F.col("pos"))).alias("by_tokens"), F.max(F.when(F.col("prompt"), F.col("pos"))).alias("by_prompt"), (F.max("pos") + 1).alias("end"))
    start = found.select("file_id", F.least(F.coalesce("by_tokens", F.lit(0)), F.coalesce("by_prompt", F.lit(0))).alias("tail_from"), "end")
    u = units(live)
    spans = cut(u.groupBy("file_id", "unit").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).where("a < b"))
    start = cut(start)
    while True:
        moved = spans.join(start, "file_id").where("a < tail_from and b >= tail_from").groupBy("file_id").agg(F.min("a").alias("to"))
        new = cut(start.join(moved, "file_id", "left").select("file_id", F.coalesce("to", "tail_from").alias("tail_from"), "end"))
        changed = new.join(start.withColumnRenamed("tail_from", "old"), "file_id").where("tail_from <> old").limit(1).count()
        start = new
        if not changed:
            return start


def fork_plan(live: DataFrame, region: DataFrame, kept: DataFrame) -> DataFrame:
    """(file_id, pos, line_id, keep, why): the tail verbatim; before it meta records, kept messages (file_id, pos) and every record of a unit
    of which any is kept; thinking goes with what follows it in its exchange, here with the next kept record's unit, else it is dropped."""
    x = live.join(region, "file_id").join(units(live), ["file_id", "pos"]).join(kept.select("file_id", "pos", F.lit(True).alias("chosen")), ["file_id", "pos"], "left")
    tail = F.col("pos") >= F.col("tail_from")
    w = Window.partitionBy("file_id", "unit")
    any_kept = F.max(F.coalesce("chosen", F.lit(False))).over(w)
    why = F.when(tail, "tail").when(F.col("category").isin("meta", "compacted"), "meta").when(F.coalesce("chosen", F.lit(False)), "chosen").when(any_kept, "unit")
    return x.select("file_id", "pos", "line_id", why.isNotNull().alias("keep"), why.alias("why"))


def relinked(rows: DataFrame) -> DataFrame:
    """Kept rows (session_id, pos, uuid) with parent_uuid: each names the one before it in its session, the first none."""
    return rows.withColumn("parent_uuid", F.lag("uuid").over(Window.partitionBy("session_id").orderBy("pos")))
