"""Token budgets and greedy fills.

A greedy fill takes items in the order of (score descending, id) and skips those that do not fit. It is a fold over sorted rows that
keeps one number for each group, so rows are sorted by the engine, within partitions, and streamed; no group is gathered in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("all", "code_only", "none")


def token_budget(segments: DataFrame, keep: float, group: str = "conv_id", cost: str = "tokens") -> DataFrame:
    """(group, total, budget): the budget is the total times keep, rounded up; null costs count 0."""
    if not 0.0 < keep <= 1.0:
        raise ValueError("keep must be in (0, 1]")
    total = F.sum(F.coalesce(F.col(cost), F.lit(0))).cast("long")
    return segments.groupBy(group).agg(total.alias("total")).withColumn("budget", F.ceil(F.col("total") * F.lit(float(keep))).cast("long"))


def forced(protect: str) -> Column:
    """Whether a segment is kept whatever it costs."""
    if protect not in POLICIES:
        raise ValueError(f"unknown policy: {protect!r}")
    return {"all": F.coalesce("protected", F.lit(False)), "code_only": F.coalesce(F.col("kind") == "code", F.lit(False)), "none": F.lit(False)}[protect]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, budget, forced, score, id, cost), sorted by g, forced first, score descending, id: the kept rows' g and id."""
    g, used, room = object(), 0, 0
    for b in batches:
        out_g, out_id = [], []
        for group, budget, must, _, i, cost in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if group != g:
                g, used, room, open_ = group, 0, budget, None
            if must:
                used += cost
                out_g.append(group)
                out_id.append(i)
                continue
            if open_ is None:
                open_ = used < room
            if open_ and used + cost <= room:
                used += cost
                out_g.append(group)
                out_id.append(i)
        yield pa.record_batch([pa.array(out_g, b.column(0).type), pa.array(out_id, b.column(4).type)], names=["g", "id"])


def greedy_fill(items: DataFrame, budgets: DataFrame, group: str = "conv_id", item: str = "seg_id", score: str = "score", cost: str = "tokens", must: Column | None = None) -> DataFrame:
    """(group, item): what a greedy fill keeps. items: group, item, score, cost; budgets: group, budget.

    Forced items are kept first and may exceed the budget; nothing else is then added. Null scores rank last, null costs are 0, ties go
    to the smaller item. Items without a budget are not kept. Repeated items each count.
    """
    x = items.join(budgets.select(group, "budget"), group).select(
        F.col(group).alias("g"), F.col("budget").cast("long"), (F.lit(False) if must is None else must).alias("forced"), F.col(score).cast("double").alias("score"), F.col(item).alias("id"), F.coalesce(F.col(cost), F.lit(0)).cast("long").alias("cost")
    )
    x = x.repartition("g").sortWithinPartitions("g", F.desc("forced"), F.desc_nulls_last("score"), "id")
    types = dict(x.dtypes)
    kept = x.mapInArrow(_fold, f"g {types['g']}, id {types['id']}")
    return kept.select(F.col("g").alias(group), F.col("id").alias(item))


def blended(scores: DataFrame, recency: float, group: str = "conv_id", item: str = "seg_id") -> DataFrame:
    """scores with score scaled to 0..1 within its group and mixed with the place in the group; equal scores are all 0."""
    if not 0.0 <= recency <= 1.0:
        raise ValueError("recency must be in [0, 1]")
    w = Window.partitionBy(group)
    low, high = F.min("score").over(w), F.max("score").over(w)
    norm = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(0.0)
    place = (F.row_number().over(w.orderBy(item)) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))
    return scores.withColumn("score", F.lit(1.0 - recency) * norm + F.lit(float(recency)) * place)


def select_by_score(segments: DataFrame, keep: float, protect: str = "all", recency: float = 0.0) -> DataFrame:
    """The segments (with a score column) that fit the budget of their conversation."""
    kept = greedy_fill(blended(segments, recency), token_budget(segments, keep), must=forced(protect))
    return segments.join(kept, ["conv_id", "seg_id"], "left_semi")


def select_with_budget(segments: DataFrame, budgets: DataFrame, protect: str = "none") -> DataFrame:
    """The same against given budgets (conv_id, budget), on the scores as they are."""
    return segments.join(greedy_fill(segments, budgets, must=forced(protect)), ["conv_id", "seg_id"], "left_semi")


MIN_KIND = 5


def kind_shares(segments: DataFrame, budgets: DataFrame, min_segments: int = MIN_KIND) -> DataFrame:
    """(conv_id, kind, budget): the budget by the kinds' part of the tokens, rounded down; kinds of few segments have none."""
    by = segments.groupBy("conv_id", "kind").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    total = F.sum("t").over(Window.partitionBy("conv_id"))
    s = by.withColumn("total", total).join(budgets.select("conv_id", F.col("budget").alias("b")), "conv_id")
    return s.where(F.col("n") >= min_segments).where("t > 0 and b > 0").select("conv_id", "kind", F.floor(F.col("b").cast("double") * F.col("t") / F.col("total")).cast("long").alias("budget"))


def kind_budget_select(segments: DataFrame, budgets: DataFrame, min_segments: int = MIN_KIND) -> DataFrame:
    """A fill for each kind within its share, then one fill of what is left over all kinds."""
    keyed = segments.withColumn("ck", F.struct("conv_id", "kind"))
    shares = kind_shares(segments, budgets, min_segments).withColumn("ck", F.struct("conv_id", "kind"))
    first = greedy_fill(keyed, shares, group="ck").select("ck.conv_id", "seg_id")
    spent = segments.join(first, ["conv_id", "seg_id"], "left_semi").groupBy("conv_id").agg(F.sum("tokens").alias("spent"))
    left = budgets.join(spent, "conv_id", "left").select("conv_id", (F.col("budget") - F.coalesce("spent", F.lit(0))).alias("budget"))
    rest = segments.join(first, ["conv_id", "seg_id"], "left_anti")
    second = greedy_fill(rest, left)
    return segments.join(first.unionByName(second), ["conv_id", "seg_id"], "left_semi")


def split_chunks(segments: DataFrame, size: int = 4000) -> DataFrame:
    """segments with chunk: consecutive runs of at most size tokens, an item over size by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, chunk, used = object(), 0, 0
        for b in batches:
            out = []
            for c, _, t in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != conv:
                    conv, chunk, used = c, 0, 0
                elif used + t > size:
                    chunk, used = chunk + 1, 0
                used += t
                out.append(chunk)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.int32())], names=["conv_id", "seg_id", "chunk"])

    s = segments.select("conv_id", "seg_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("t")).repartition("conv_id").sortWithinPartitions("conv_id", "seg_id")
    types = dict(s.dtypes)
    return s.mapInArrow(run, f"conv_id {types['conv_id']}, seg_id {types['seg_id']}, chunk int")


def chunk_budgets(chunked: DataFrame, keep: float) -> DataFrame:
    """(conv_id, chunk, budget): the budget of each chunk as a difference of rounded cumulative budgets, so that they add up to the whole."""
    by = chunked.groupBy("conv_id", "chunk").agg(F.sum("tokens").alias("t"))
    cum = F.sum("t").over(Window.partitionBy("conv_id").orderBy("chunk"))
    upto = F.round(cum * F.lit(float(keep))).cast("long")
    w = Window.partitionBy("conv_id").orderBy("chunk")
    return by.withColumn("upto", upto).select("conv_id", "chunk", (F.col("upto") - F.coalesce(F.lag("upto").over(w), F.lit(0))).alias("budget"))


def chunked_select(segments: DataFrame, keep: float, size: int = 4000) -> DataFrame:
    """Each chunk filled within its budget, then what all chunks left over filled once more over the whole conversation."""
    s = segments.join(split_chunks(segments, size), ["conv_id", "seg_id"]).withColumn("cc", F.struct("conv_id", "chunk"))
    budgets = chunk_budgets(s, keep).withColumn("cc", F.struct("conv_id", "chunk"))
    first = greedy_fill(s, budgets, group="cc").select("cc.conv_id", "seg_id")
    spent = segments.join(first, ["conv_id", "seg_id"], "left_semi").groupBy("conv_id").agg(F.sum("tokens").alias("spent"))
    whole = budgets.groupBy("conv_id").agg(F.sum("budget").alias("budget")).join(spent, "conv_id", "left")
    left = whole.select("conv_id", (F.col("budget") - F.coalesce("spent", F.lit(0))).alias("budget"))
    second = greedy_fill(segments.join(first, ["conv_id", "seg_id"], "left_anti"), left)
    return segments.join(first.unionByName(second), ["conv_id", "seg_id"], "left_semi")
