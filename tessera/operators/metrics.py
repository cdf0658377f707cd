"""Rate and distortion: compression ratio, recall of atoms in its variants, coverage by embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.supersede import apply_supersession


def mentions(segments: DataFrame, *keys: str) -> DataFrame:
    """(conv_id, *keys, atom): the distinct atoms. Sets of atoms stay rows, so that no conversation's set is gathered."""
    return segments.select("conv_id", *keys, F.explode("atoms").alias("atom")).where("atom is not null").distinct()


def _share(top: Column, of: Column) -> Column:
    """top / of; 1 where nothing is wanted."""
    return F.when(F.coalesce(of, F.lit(0)) > 0, F.coalesce(top, F.lit(0)) / of).otherwise(1.0)


def compression(original: DataFrame, kept: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(conv_id, total_tokens, kept_tokens, ratio); extra (conv_id, extra_tokens) is charged to the output. 1 where the total is 0."""
    t = original.groupBy("conv_id").agg(F.sum("tokens").alias("total_tokens"))
    k = kept.groupBy("conv_id").agg(F.sum("tokens").alias("kept_tokens"))
    out = t.join(k, "conv_id", "left")
    if extra is not None:
        out = out.join(extra, "conv_id", "left")
    more = F.coalesce("extra_tokens", F.lit(0)) if extra is not None else F.lit(0)
    got = F.coalesce("kept_tokens", F.lit(0))
    return out.select("conv_id", F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"), got.alias("kept_tokens"), F.when(F.col("total_tokens") > 0, (got + more) / F.col("total_tokens")).otherwise(1.0).alias("ratio"))


def recall(wanted: DataFrame, have: DataFrame, *keys: str) -> DataFrame:
    """(conv_id, *keys, n_wanted, n_have): wanted and have are rows of (conv_id[, keys], atom)."""
    h = have.select("conv_id", "atom").distinct().withColumn("got", F.lit(1))
    return wanted.join(h, ["conv_id", "atom"], "left").groupBy("conv_id", *keys).agg(F.count("*").alias("n_wanted"), F.count("got").alias("n_have"))


def evaluate(original: DataFrame, kept: DataFrame, guaranteed: DataFrame | None = None, superseded: DataFrame | None = None) -> DataFrame:
    """One row for each conversation: ratio, atom_recall, atom_recall_earned, atom_recall_final, atom_recall_final_earned, guaranteed_share.

    guaranteed (conv_id, atom) are atoms a side table hands over: they count as kept, and the earned variants leave them out of what is
    wanted. final counts what supersession leaves. A recall of nothing is 1; a share of nothing is 0.
    """
    all_atoms, kept_atoms = mentions(original), mentions(kept)
    final = mentions(apply_supersession(original, superseded))
    g = guaranteed.select("conv_id", "atom").distinct() if guaranteed is not None else None
    flags = all_atoms.join(kept_atoms.withColumn("k", F.lit(True)), ["conv_id", "atom"], "left").join(final.withColumn("f", F.lit(True)), ["conv_id", "atom"], "left")
    flags = flags.join(g.withColumn("g", F.lit(True)), ["conv_id", "atom"], "left") if g is not None else flags.withColumn("g", F.lit(None).cast("boolean"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    have = yes("k") | yes("g")
    sums = flags.groupBy("conv_id").agg(
        F.count("*").alias("w"), n(have).alias("w_have"), n(~yes("g")).alias("e"), n(~yes("g") & yes("k")).alias("e_have"),
        n(yes("f")).alias("f"), n(yes("f") & have).alias("f_have"), n(yes("f") & ~yes("g")).alias("fe"), n(yes("f") & ~yes("g") & yes("k")).alias("fe_have"), n(yes("g")).alias("g"),
    )
    out = compression(original, kept).join(sums, "conv_id", "left")
    c = F.col
    return out.select(
        "conv_id", "total_tokens", "kept_tokens", "ratio", _share(c("w_have"), c("w")).alias("atom_recall"), _share(c("e_have"), c("e")).alias("atom_recall_earned"),
        _share(c("f_have"), c("f")).alias("atom_recall_final"), _share(c("fe_have"), c("fe")).alias("atom_recall_final_earned"),
        F.when(c("w") > 0, c("g") / c("w")).otherwise(0.0).alias("guaranteed_share"),
    )


def recall_by_kind(original: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, kind, atom_recall): of each kind's atoms those that any kept segment has; a kind without atoms has 1."""
    r = recall(mentions(original, "kind"), mentions(kept), "kind")
    kinds = original.select("conv_id", "kind").distinct()
    return kinds.join(r, ["conv_id", "kind"], "left").select("conv_id", "kind", _share(F.col("n_have"), F.col("n_wanted")).alias("atom_recall"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def coverage(original: DataFrame, kept: DataFrame, group: str, item: str, vector: str = "vector") -> DataFrame:
    """(group, item, best): for each original its greatest cosine with a kept one of its group, vectors of unit length; 0 without any.

    The kept vectors of a group are packed into blocks of BLOCK rows and each original meets the blocks of its group, one product of
    matrices for each, so no pair becomes a row.
    """
    sizes = kept.groupBy(group).agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    block = F.pmod(F.xxhash64(item), F.col("blocks"))
    packed = kept.join(sizes, group).select(F.col(group), block.alias("blk"), F.col(vector).cast("array<double>").alias("v")).groupBy(group, "blk").agg(F.collect_list("v").alias("vs"))

    @F.pandas_udf("double")
    def best(x: pd.Series, vs: pd.Series) -> pd.Series:
        return pd.Series([float((np.stack(b) @ np.asarray(a)).max()) for a, b in zip(x, vs, strict=True)])

    met = original.select(group, item, F.col(vector).cast("array<double>").alias("v")).join(packed, group).withColumn("c", best("v", "vs"))
    top = met.groupBy(group, item).agg(F.max("c").alias("best"))
    return original.select(group, item).join(top, [group, item], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))


#: About so many kept vectors stand in one block.
BLOCK = 512


def mean_vector(vectors: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """(group, pos, mean): the mean of each dimension."""
    return vectors.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def doc_cosine(original: DataFrame, kept: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """(group, doc_cosine): cosine of the mean vectors; 0 where one has no length or nothing is kept."""
    a = mean_vector(original, group, vector).withColumnRenamed("mean", "a")
    b = mean_vector(kept, group, vector).withColumnRenamed("mean", "b")
    s = a.join(b, [group, "pos"], "left").groupBy(group).agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    return s.select(group, F.coalesce(F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))), F.lit(0.0)).alias("doc_cosine"))


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """(conv_id, jaccard): of the segments in either selection those in both."""
    both = a.select("conv_id", "seg_id", F.lit(1).alias("a")).join(b.select("conv_id", "seg_id", F.lit(1).alias("b")), ["conv_id", "seg_id"], "full")
    return both.groupBy("conv_id").agg((F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)) / F.count("*")).alias("jaccard"))


def quantiles(rows: DataFrame, *keys: str, column: str = "tokens") -> DataFrame:
    """(keys, n, sum, p50, p90, p90_nearest): interpolated quantiles, and the 0.9 quantile by the nearest lower rank.

    The nearest rank is found on counts by value, so that no group's values are gathered.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    by = rows.groupBy(*keys, column).agg(F.count("*").alias("c"))
    by = by.withColumn("upto", F.sum("c").over(w.orderBy(column))).withColumn("all", F.sum("c").over(w))
    near = by.where(F.col("upto") > F.floor(0.9 * (F.col("all") - 1))).groupBy(*keys).agg(F.min(column).alias("p90_nearest"))
    q = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(column).alias(column), F.round(F.percentile(column, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(column, F.lit(0.9)), 6).alias("p90"))
    return q.join(near, list(keys))


def gini(rows: DataFrame, group: str, column: str) -> DataFrame:
    """(group, gini) of a column; groups whose sum is 0 are left out."""
    from pyspark.sql import Window

    w = Window.partitionBy(group)
    r = rows.select(group, F.col(column).alias("x"), F.row_number().over(w.orderBy(column)).alias("r"), F.count("*").over(w).alias("n"))
    g = r.groupBy(group, "n").agg(F.sum((2 * F.col("r") - F.col("n") - 1) * F.col("x")).alias("s"), F.sum("x").alias("t")).where("t > 0")
    return g.select(group, F.round(F.col("s") / (F.col("n") * F.col("t")), 6).alias("gini"))
