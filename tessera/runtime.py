"""Session helpers shared by all operators: table access, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a narrow (key-only) table that may be broadcast; above it a shuffle join is used.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a scale directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named in spark.checkpoint.dir; a local one only where that is unset (tests)."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared
    if sc.master.startswith("local[") or sc.master == "local":
        return os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """Write df once into the shared checkpoint folder and return it with its lineage cut."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if its counted rows are within max_rows; otherwise leave the join to shuffle.

    df must be cheap to count (a checkpointed or narrow table).
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it lies in fewer partitions than there are cores, such as a small file of one row group; larger inputs are
    left as they lie. For scans whose work per row is heavy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ranked(df: DataFrame, *order, name: str = "idx") -> DataFrame:
    """df with its rank from 0 in a total order, by a range sort and the sizes of its partitions; no task sees all rows.

    The sorted rows are written once; the sizes that reach the driver are one number for each partition.
    """
    held = cut(df.orderBy(*order)).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    before, total = {}, 0
    for r in sorted(held.groupBy("_part").count().collect(), key=lambda r: r["_part"]):
        before[r["_part"]], total = total, total + r["count"]
    offsets = F.create_map(*[F.lit(x) for kv in (before or {0: 0}).items() for x in kv])
    return held.withColumn(name, F.col("_at") + F.try_element_at(offsets, F.col("_part")).cast("long")).drop("_part", "_at")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if not f.endswith(".pyc"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    sc._tessera_shipped = True
