"""Reports over selections, plans and logs of work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import budget as bud
from tessera.runtime import cut


def kept_flags(segments: DataFrame, kept: dict[str, DataFrame]) -> DataFrame:
    """segments with a boolean column for each selection (conv_id, seg_id) by name."""
    out = segments
    for name, k in kept.items():
        out = out.join(k.select("conv_id", "seg_id", F.lit(True).alias(name)), ["conv_id", "seg_id"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def kept_counters(flags: DataFrame, levels: tuple[str, ...] = ("light", "medium", "heavy"), share: str = "medium") -> DataFrame:
    """(kind, n, one count for each level, the kind's part of the tokens that ``share`` keeps)."""
    flags = cut(flags)
    total = flags.where(F.col(share)).agg(F.sum("tokens").alias("total"))
    by = flags.groupBy("kind").agg(F.count("*").alias("n"), *[F.count(F.when(F.col(x), 1)).alias(x) for x in levels], F.sum(F.when(F.col(share), F.col("tokens")).otherwise(0)).alias("t"))
    return by.join(F.broadcast(total)).select("kind", "n", *levels, F.round(F.col("t") / F.col("total"), 6).alias(f"{share}_share"))


def bundle_invariants(flags: DataFrame) -> DataFrame:
    """(rule, broken): ids unique, tokens not negative, heavy budgets within medium ones within light ones."""
    flags = cut(flags)
    ids = flags.groupBy("conv_id", "seg_id").count().where("count > 1").agg(F.count("*").alias("broken")).select(F.lit("unique").alias("rule"), "broken")
    tokens = flags.agg(F.count(F.when(F.col("tokens") < 0, 1)).alias("broken")).select(F.lit("tokens").alias("rule"), "broken")
    sums = flags.groupBy("conv_id").agg(*[F.sum(F.when(F.col(x), F.col("tokens")).otherwise(0)).alias(x) for x in ("light", "medium", "heavy")], F.sum("tokens").alias("all"))
    order = sums.agg(F.count(F.when((F.col("light") > F.ceil(F.col("all") * 0.5)) | (F.col("medium") > F.ceil(F.col("all") * 0.33)) | (F.col("heavy") > F.ceil(F.col("all") * 0.25)), 1)).alias("broken")).select(F.lit("budgets").alias("rule"), "broken")
    return ids.unionByName(tokens).unionByName(order)


def reply_chains(rows: DataFrame) -> DataFrame:
    """(session_id, n_chain, ring) over parents from the last message that is no side row to the end of the chain, by pointer doubling:
    n_chain counts each uuid once, ring tells whether one recurs."""
    one = rows.where("uuid is not null").groupBy("session_id", "uuid").agg(F.min(F.struct("row_id", "parent_uuid", "logged_at", F.coalesce("is_sidechain", F.lit(False)).alias("side"))).alias("m")).select("session_id", "uuid", "m.*")
    one = cut(one)
    known = one.select("session_id", F.col("uuid").alias("to"))
    steps = [cut(one.select("session_id", "uuid", F.col("parent_uuid").alias("to")).join(known, ["session_id", "to"], "left_semi").select("session_id", "uuid", "to"))]
    # with 2^i steps more than a session has messages, only a ring still leads anywhere
    largest = one.groupBy("session_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(largest).bit_length()):
        if not steps[-1].limit(1).count():
            break
        a = steps[-1]
        b = a.select("session_id", F.col("uuid").alias("to"), F.col("to").alias("further"))
        steps.append(cut(a.join(b, ["session_id", "to"]).select("session_id", "uuid", F.col("further").alias("to"))))
    last = cut(one.where("not side").groupBy("session_id").agg(F.max_by("uuid", F.struct("logged_at", "row_id")).alias("uuid")))
    line = last
    for s in reversed(steps):
        line = cut(line.union(line.join(s, ["session_id", "uuid"]).select("session_id", F.col("to").alias("uuid"))).distinct())
    rings = last.join(steps[-1], ["session_id", "uuid"]).select("session_id", F.lit(True).alias("ring"))
    return line.groupBy("session_id").agg(F.count("*").alias("n_chain")).join(rings, "session_id", "left").select("session_id", "n_chain", F.coalesce("ring", F.lit(False)).alias("ring"))


def planned_against_done(cells: DataFrame, variants: DataFrame, records: DataFrame, keys: list[str], variant: str) -> DataFrame:
    """(first key, variant, planned, done): every cell with every variant is planned; variants are few and counted before they are sent out."""
    from tessera.runtime import small_side

    planned = cells.join(small_side(variants, 10_000))
    done = records.groupBy(*keys, variant).agg(F.count("*").alias("n"))
    return planned.join(done, [*keys, variant], "left").groupBy(keys[0], variant).agg(F.count("*").alias("planned"), F.count("n").alias("done"))


def median_of_medians(rows: DataFrame, value: str, outer: str, inner: str) -> DataFrame:
    """(outer, median): the median over inner groups of their medians."""
    m = rows.groupBy(outer, inner).agg(F.percentile(value, F.lit(0.5)).alias("m"))
    return m.groupBy(outer).agg(F.round(F.percentile("m", F.lit(0.5)), 6).alias("median"))


def recent_rate(rows: DataFrame, at: str, by: str) -> DataFrame:
    """(by, n_last_hour, per_minute) within the hour before the last record."""
    last = rows.agg(F.max(at).alias("last"))
    x = rows.join(F.broadcast(last)).where(F.col(at) >= F.col("last") - F.expr("INTERVAL 1 HOUR"))
    return x.groupBy(by).agg(F.count("*").alias("n_last_hour"), F.round(F.count("*") / 60.0, 6).alias("per_minute"))


def stalls(rows: DataFrame, at: str, id_col: str, by: str, times: float = 10.0) -> DataFrame:
    """(by, typical_gap, stalls): the median gap in seconds, and how many gaps are more than ``times`` that."""
    w = Window.partitionBy(by).orderBy(at, id_col)
    us = F.unix_micros(F.col(at).cast("timestamp"))
    g = rows.withColumn("gap", (us - F.lag(us).over(w)) / 1e6).where("gap is not null")
    m = g.groupBy(by).agg(F.percentile("gap", F.lit(0.5)).alias("m"))
    return g.join(m, by).groupBy(by).agg(F.round(F.first("m"), 3).alias("typical_gap"), F.count(F.when(F.col("gap") > times * F.col("m"), 1)).alias("stalls"))


def force_code(scored: DataFrame, budgets: DataFrame, share: float) -> DataFrame:
    """Code segments of most atoms for their tokens, up to share of the budget, are forced; all else fills what is left by score."""
    scored = cut(scored)
    density = F.coalesce(F.size("atoms"), F.lit(0)) / F.greatest(F.col("tokens"), F.lit(1))
    code = scored.where("kind = 'code'").withColumn("score", density)
    first = bud.greedy_fill(code, budgets.withColumn("budget", F.floor(F.col("budget") * F.lit(share)).cast("long")))
    marked = scored.join(first.withColumn("must", F.lit(True)), ["conv_id", "seg_id"], "left").withColumn("must", F.coalesce("must", F.lit(False)))
    return scored.join(bud.greedy_fill(marked, budgets, must=F.col("must")), ["conv_id", "seg_id"], "left_semi")
