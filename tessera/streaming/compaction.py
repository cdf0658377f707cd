"""Compaction while turns arrive, in Structured Streaming, with the Compactor of operators.continuous as keyed state.

Turns of a conversation are taken in order of arrival. A turn at or below the last one seen has been handled before and is passed over.
State holds numbers of turns only: texts of frozen chunks go to the sink and are never kept.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tessera.operators.continuous import CHUNK_TOKENS, EVENTS, MERGE, TAIL_TOKENS, Compactor

_STATE = "last_turn int, held string"


def compaction_stream(turns: DataFrame, chunk: int = CHUNK_TOKENS, tail: int = TAIL_TOKENS, merge: int = MERGE) -> DataFrame:
    """Streaming (conv_id, turn, tokens) to streaming events (see EVENTS), append mode."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, c = -1, Compactor()
        if state.exists:
            last, held = state.get
            d = json.loads(held)
            c = Compactor(d["seen"], d["upto"], [tuple(x) for x in d["pending"]], [[tuple(x) for x in t] for t in d["tiers"]])
        rows = []
        for turn, tokens in sorted((int(t), int(n)) for b in batches for t, n in zip(b["turn"], b["tokens"], strict=True)):
            if turn <= last:
                continue
            last = turn
            rows += [(key[0], c.seen - 1, *e) for e in c.add(tokens, chunk, tail, merge)]
        state.update((last, json.dumps({"seen": c.seen, "upto": c.upto, "pending": c.pending, "tiers": c.tiers})))
        yield pd.DataFrame(rows, columns=["conv_id", "t", "event", "tier", "from_turn", "to_turn"])

    return turns.groupBy("conv_id").applyInPandasWithState(run, EVENTS, _STATE, "append", "NoTimeout")


def run_once(spark: SparkSession, source: str, target: str, schema: str = "conv_id bigint, turn int, tokens bigint", **sizes: int) -> DataFrame:
    """Everything that lies in the folder source (Parquet of conv_id, turn, tokens) through the stream into the folder target."""
    stream = spark.readStream.schema(schema).parquet(source)
    q = compaction_stream(stream, **sizes).writeStream.format("parquet").option("checkpointLocation", os.path.join(target, "_progress")).outputMode("append").trigger(availableNow=True).start(os.path.join(target, "events"))
    q.awaitTermination()
    return spark.read.schema(EVENTS).parquet(os.path.join(target, "events"))
