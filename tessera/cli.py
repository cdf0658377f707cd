"""spark-submit entry: compress transcripts of a folder.

    spark-submit tessera/cli.py INPUT OUTPUT [--keep R | --target-tokens N | --level light|medium|heavy] [--no-novelty] [--band Q] [--paths N]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import token_count
from tessera.operators.segmenting import blocks, to_turns
from tessera.plans.pipeline import LEVELS, Options, compress, resolve_rate
from tessera.runtime import ship
from tessera.sources.transcripts import from_files, write_block_lines


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Compress transcripts to a part of their tokens.")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--keep", type=float)
    p.add_argument("--target-tokens", type=int)
    p.add_argument("--level", choices=sorted(LEVELS))
    p.add_argument("--no-novelty", action="store_true")
    p.add_argument("--band", type=float)
    p.add_argument("--paths", type=int)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    turns, skipped = from_files(spark, a.input)
    turns = turns.withColumnRenamed("file", "conv_id")
    total = blocks(turns).agg(F.sum(token_count(F.col("text")))).first()[0] if a.target_tokens else None
    rate = resolve_rate(a.keep, a.target_tokens, a.level, total)
    kept, header = compress(turns, Options(keep=rate.keep, novelty=None if a.no_novelty else 0.5, band=a.band, paths=a.paths))
    write_block_lines(to_turns(kept).withColumn("conv_id", F.sha2("conv_id", 256)), a.output + "/turns", {"keep": f"{rate.keep:g}", "rate": rate.source})
    header.write.mode("overwrite").json(a.output + "/header")
    skipped.write.mode("overwrite").json(a.output + "/skipped")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
