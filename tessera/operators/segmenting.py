"""Turns to segments: the units of selection."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import atoms as at
from tessera.functions import text as tx

MAX_PROSE = 12_000
MAX_RESULT = 600


def transcripts(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, blocks): of turns delivered more than once the one with the least turn_uid. Null keys are left out."""
    return _first(turns, "conv_id", "turn", by="turn_uid").select("conv_id", "turn", "role", "blocks")


def _first(rows: DataFrame, *keys: str, by: str) -> DataFrame:
    """The row of the least ``by`` for each key; a window, so that only columns in use are read and shuffled."""
    held = rows.where(" and ".join(f"{k} is not null" for k in keys))
    return held.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).where("_nth = 1").drop("_nth")


def blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, block, kind, text, meta): one row for each block, numbered from 0."""
    return turns.select("conv_id", "turn", "role", F.posexplode("blocks").alias("block", "b")).select("conv_id", "turn", "role", "block", "b.kind", "b.text", "b.meta")


def delivered_once(segments: DataFrame) -> DataFrame:
    """Segments by (conv_id, seg_id), of several deliveries the one with the least seg_uid."""
    return _first(segments, "conv_id", "seg_id", by="seg_uid")


def _wrap(piece: str, most: int) -> Iterator[str]:
    """Parts of an over-long run: to the last line end or space within reach, or hard."""
    while len(piece) > most:
        at_ = max(piece.rfind("\n", 0, most), piece.rfind(" ", 0, most))
        at_ = at_ if at_ > 0 else most
        if part := piece[:at_].strip():
            yield part
        piece = piece[at_:].lstrip()
    if piece := piece.strip():
        yield piece


_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[`])")


def _fill(parts: Iterator[str], most: int, joint: str) -> list[str]:
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + len(joint) + len(p) <= most:
            out[-1] += joint + p
        else:
            out.append(p)
    return out


def long_paragraph(text: str, most: int = MAX_PROSE) -> list[str]:
    """A paragraph over most characters as runs of whole sentences."""
    return _fill((w for s in _SENTENCE.split(text.strip()) if s for w in ([s] if len(s) <= most else _wrap(s, most))), most, " ")


def line_chunks(text: str, most: int = MAX_RESULT) -> list[str]:
    """Runs of whole lines of most characters; a line that is longer is taken apart and ends the run before it at the next full one."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for line in text.splitlines():
        if held and size + len(line) + 1 > most:
            out.append("\n".join(held))
            held, size = [], 0
        if len(line) > most:
            out.extend(_wrap(line, most))
        else:
            held.append(line)
            size += len(line) + 1
    return [*out, "\n".join(held)] if held else out


def _python(fn, most: int):
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else fn(t, most))

    return run


def prose_pieces(c: Column, most: int = MAX_PROSE) -> Column:
    """Paragraphs; only those over the cap leave the JVM."""
    parts = tx.paragraphs(c)
    longest = F.array_max(F.transform(parts, F.length))
    done = _python(lambda t, m: [x for p in t.split("\x00") for x in (long_paragraph(p, m) if len(p) > m else [p])], most)
    return F.when(F.coalesce(longest, F.lit(0)) <= most, parts).otherwise(done(F.when(longest > most, F.array_join(parts, "\x00"))))


def _fits(c: Column, most: int) -> Column:
    """Lines gathered into runs, in the JVM, where no line is over the limit."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("held"), F.lit(0).alias("size"))

    def take(s, line):
        n = F.length(line) + 1
        full = s["held"].isNotNull() & (s["size"] + n > most)
        return F.struct(
            F.when(full, F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"]).alias("out"),
            F.when(full | s["held"].isNull(), line).otherwise(F.concat(s["held"], F.lit("\n"), line)).alias("held"),
            F.when(full, n).otherwise(s["size"] + n).alias("size"),
        )

    return F.aggregate(tx.lines(c), start, take, lambda s: F.when(s["held"].isNotNull(), F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"]))


def result_pieces(c: Column, most: int = MAX_RESULT) -> Column:
    """Runs of lines; only texts with a line over the limit leave the JVM."""
    wide = F.coalesce(F.array_max(F.transform(tx.lines(c), F.length)), F.lit(0)) > most
    return F.when(wide, _python(line_chunks, most)(F.when(wide, c))).otherwise(_fits(c, most))


def segment(turns: DataFrame, max_prose: int = MAX_PROSE, max_result: int = MAX_RESULT) -> DataFrame:
    """(conv_id, seg_id, turn, block, role, kind, text, protected, atoms, tool_name, tokens) of transcripts, dense seg_id from 0 in order.

    text and thinking blocks are cut at blank lines, tool results into runs of lines unless they are dumps of code, others stay whole.
    Blank pieces are left out; null texts have none.
    """
    b = blocks(turns).where(~tx.blank(F.col("text")))
    dump = (F.col("kind") == "tool_result") & tx.is_code_dump(tx.without_numbers(F.col("text")))
    kind = F.when(F.col("kind") == "text", "prose").when(dump, "code").otherwise(F.col("kind"))
    whole = F.array("text")
    b = b.withColumn("out", kind)
    pieces = F.when(F.col("out").isin("prose", "thinking"), prose_pieces(F.when(F.col("out").isin("prose", "thinking"), F.col("text")), max_prose)).when(
        F.col("out") == "tool_result", result_pieces(F.when(F.col("out") == "tool_result", F.col("text")), max_result)
    ).otherwise(whole)
    s = b.withColumn("pieces", pieces).select("conv_id", "turn", "block", "role", F.col("out").alias("kind"), "meta", F.posexplode("pieces").alias("part", "text")).where(~tx.blank(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "block", "part")
    return s.select(
        "conv_id",
        (F.row_number().over(order) - 1).alias("seg_id"),
        "turn",
        "block",
        "role",
        "kind",
        "text",
        F.col("kind").isin("code", "tool_use").alias("protected"),
        at.extract(F.col("text")).alias("atoms"),
        F.when(F.col("kind") == "tool_use", F.col("meta")["name"]).alias("tool_name"),
        tx.token_count(F.col("text")).alias("tokens"),
    )


def to_turns(segments: DataFrame) -> DataFrame:
    """Segments back to (conv_id, turn, role, blocks): those of one block joined, by line feeds in tool results and blank lines elsewhere."""
    by_block = segments.groupBy("conv_id", "turn", "block").agg(
        F.first("role").alias("role"), F.first("kind").alias("kind"), F.first("tool_name").alias("tool_name"), F.array_sort(F.collect_list(F.struct("seg_id", "text"))).alias("p")
    )
    kind = F.when(F.col("kind") == "prose", "text").otherwise(F.col("kind"))
    meta = F.when(F.col("tool_name").isNotNull(), F.create_map(F.lit("name"), F.col("tool_name"))).otherwise(F.create_map().cast("map<string,string>"))
    parts = F.transform("p", lambda x: x["text"])
    text = F.when(F.col("kind") == "tool_result", F.array_join(parts, "\n")).otherwise(F.array_join(parts, "\n\n"))
    one = by_block.select("conv_id", "turn", "role", "block", F.struct(kind.alias("kind"), text.alias("text"), meta.alias("meta")).alias("b"))
    # a map cannot be ordered, so blocks are ordered by their number alone
    gathered = one.groupBy("conv_id", "turn").agg(F.first("role").alias("role"), F.map_from_entries(F.collect_list(F.struct("block", "b"))).alias("m"))
    return gathered.select("conv_id", "turn", "role", F.transform(F.array_sort(F.map_keys("m")), lambda k: F.col("m")[k]).alias("blocks"))


def rendered(segments: DataFrame) -> DataFrame:
    """(conv_id, text): kept segments in order, blank lines between, and a gap mark where segments of the same block were left out."""
    order = Window.partitionBy("conv_id").orderBy("seg_id")
    before = F.lag(F.struct("turn", "block", "seg_id")).over(order)
    gap = (before["turn"] == F.col("turn")) & (before["block"] == F.col("block")) & (before["seg_id"] < F.col("seg_id") - 1)
    s = segments.withColumn("piece", F.when(F.coalesce(gap, F.lit(False)), F.concat(F.lit("[…]\n\n"), F.col("text"))).otherwise(F.col("text")))
    return s.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_id", "piece"))), lambda x: x["piece"]), "\n\n").alias("text"))
