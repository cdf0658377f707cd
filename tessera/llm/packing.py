"""Problem 7: texts packed into containers of a fixed number of tokens.

Packing is planned over the histogram of lengths, not over documents: best fit, longest first, moves counts of equal containers at a
time. Documents then take the planned slots by joining on their rank within their length. The plan depends on at most as many
different lengths as a container has tokens, so the driver's part has a fixed size.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.runtime import cut

CAPACITY = 2048
#: A file of the public tokenizers; a parameter of token_counts.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pattern that parts a text before byte-pair merging (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Parts into which each length is split by document for ranking.
SALT = 256

_encodings: dict[str, object] = {}


def _encoding(path: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encodings[path] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens) of each document, null texts with 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(tokenizer)
        for b in batches:
            n = [0 if not t else len(enc.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_tokens long")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit, longest first, over counts: (number of containers, lengths in each of them).

    Containers that are filled alike are one entry; room[r] holds the entries with r tokens left.
    """
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} does not fit")
        while left:
            r = next((r for r in range(length, capacity) if room.get(r)), None)
            if r is None:
                each = capacity // length
                full, rest = divmod(left, each)
                for n, k in ((full, each), (1 if rest else 0, rest)):
                    if n:
                        room[capacity - k * length].append((n, (length,) * k))
                left = 0
            else:
                # as many of the length as fit go into one container, before the next one is taken
                n, held = room[r].pop()
                each = r // length
                take = min(n, left // each) or 1
                k = min(each, left)
                if n > take:
                    room[r].append((n - take, held))
                room[r - k * length].append((take, held + (length,) * k))
                left -= take * k
    return [e for r in sorted(room) for e in room[r]]


def _slots(spark: SparkSession, planned: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """(n_tokens, first_rank, last_rank, container, place, at): ranks of a length and the containers, counted on from container, that they take."""
    rows, base, given = [], 0, defaultdict(int)
    for n, held in planned:
        at = 0
        for place, length in enumerate(held):
            rows.append((length, given[length], given[length] + n - 1, base, place, at))
            given[length] += n
            at += length
        base += n
    return spark.createDataFrame(rows, "n_tokens long, first_rank long, last_rank long, container long, place int, at int")


def pieces_of(counts: DataFrame, capacity: int) -> DataFrame:
    """(id, piece, first_token, n_tokens): a document over capacity as full pieces and a rest, others whole; none for a document without tokens."""
    return counts.where("id is not null and n_tokens > 0").select("id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / capacity))).alias("piece")).select(
        "id", F.col("piece").cast("int"), (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece") * capacity).alias("n_tokens")
    )


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, piece, first_token, n_tokens, container_id, place, offset): where each document, or piece of one over capacity, goes.

    Null ids, null texts and empty texts have no tokens to place and are left out; a blank text has tokens. Repeated rows each take a
    place. Ranks within a length follow a hash part of the id, then the id, so that no length is sorted in one task. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    pieces = cut(pieces_of(token_counts(docs, id_col, text_col, tokenizer), capacity))
    counts = pieces.groupBy("n_tokens").count().collect()  # at most capacity rows
    slots = _slots(spark, plan({r.n_tokens: r["count"] for r in counts}, capacity))
    parts = pieces.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)))
    sizes = parts.groupBy("n_tokens", "salt").agg(F.count("*").alias("c"))
    before = sizes.withColumn("before", F.sum("c").over(Window.partitionBy("n_tokens").orderBy("salt")) - F.col("c")).drop("c")
    ranked = parts.withColumn("r", F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("id", "piece")) - 1)
    ranked = ranked.join(before, ["n_tokens", "salt"]).withColumn("rank", F.col("r") + F.col("before"))  # partitioned by these keys already
    placed = ranked.join(F.broadcast(slots), "n_tokens").where("rank between first_rank and last_rank")  # as the plan: bounded by capacity
    return placed.select(F.col("id").alias(id_col), "piece", "first_token", "n_tokens", (F.col("container") + F.col("rank") - F.col("first_rank")).alias("container_id"), "place", F.col("at").alias("offset"))


def container_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row for each number of tokens left over: room, n_containers, n_pieces, and the part of all containers' tokens that is used."""
    c = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"))
    by = c.groupBy((F.lit(capacity) - F.col("used")).alias("room")).agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("used").alias("used"))
    total = by.agg(F.sum("used").alias("u"), F.sum("n_containers").alias("c"))
    return by.join(F.broadcast(total)).select("room", "n_containers", "n_pieces", F.round(F.col("u") / (F.col("c") * capacity), 6).alias("used_part"))
