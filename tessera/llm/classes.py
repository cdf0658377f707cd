"""Classes of exact copies in operators on pairs: joined by one representative each, and brought back at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import cut

#: About how many records of a group are in one part; pairs of parts are spread over tasks, and a task holds two parts at a time.
PART = 1024


def _parts(groups: DataFrame) -> DataFrame:
    """(g, id) to (g, part, ids): the ids of each group in parts of about PART."""
    sizes = groups.groupBy("g").agg(F.ceil(F.count("*") / F.lit(PART)).cast("int").alias("of"))
    return groups.join(sizes, "g").groupBy("g", F.pmod(F.xxhash64("id"), F.col("of")).cast("int").alias("part")).agg(F.collect_list("id").alias("ids"))


def _side(parts: DataFrame, x: str) -> DataFrame:
    return parts.select(F.col("g").alias(x), F.col("part").alias(f"p{x}"), F.col("ids").alias(f"ids_{x}"))


def _paired(blocks: DataFrame) -> DataFrame:
    """Pairs (a < b) of the ids of two parts, or within one; the blocks are spread over all tasks first."""
    spread = blocks.repartition("a", "pa", "b", "pb").select("a", "pa", "b", "pb", F.explode("ids_a").alias("ia"), "ids_b")
    pairs = spread.select("a", "pa", "b", "pb", "ia", F.explode("ids_b").alias("ib")).where("a <> b or pa <> pb or ia < ib")
    return pairs.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))


def _near(parts: DataFrame) -> DataFrame:
    return _side(parts, "a").join(_side(parts, "b"), F.col("a") == F.col("b")).where("pa <= pb and (pa < pb or size(ids_a) > 1)")


def pairs_within(groups: DataFrame) -> DataFrame:
    """Pairs (a < b) of ids that stand in one group of (g, id) at least; each pair comes once. Groups may be of any size."""
    return _paired(_near(cut(_parts(groups)))).distinct()


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (a < b) of records: of linked classes and of copies. members: (id, rep), links: (a, b) of reps; each pair comes once."""
    parts = cut(_parts(members.select(F.col("rep").alias("g"), "id")))
    far = links.select("a", "b").join(_side(parts, "a"), "a").join(_side(parts, "b"), "b")
    return _paired(far.unionByName(_near(parts)))
