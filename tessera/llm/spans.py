"""Problem 9: long exact spans shared between records, by sliding sentence spans.

A text is cut into sentences at line ends and after sentence marks; a sentence of PIECE characters or more is cut further at
content-defined places (winnowing), so that equal stretches are cut equally wherever they stand. Every run of consecutive pieces that
covers RUN characters is hashed, and runs with equal hashes meet in one global join. Around the runs that more than one text holds, every
stretch of SPAN characters is hashed; those that more than one text holds are the shared spans. Both queries read this one table.

Why no stretch of 300 characters is missed: each of its first 64 and of the characters up to its last 74 holds a boundary that depends
on the stretch alone, which leaves 162 characters between two boundaries that both records have. A run from the first ends within
96 + 64 characters, hence inside; so the run is repeated, and the stretch is among those around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import vectext as v
from tessera.llm.classes import expand, pairs_within
from tessera.runtime import cut, small_side

PIECE = 64
GRAM = 8
RUN = 96
SPAN = 300


def _space() -> np.ndarray:
    t = np.zeros(0x110000, bool)
    t[[9, 10, 13, 32, 0xA0]] = True
    return t


_SPACE = _space()
_STOP = np.zeros(0x110000, bool)
_STOP[[ord(c) for c in ".!?:;。！？"]] = True


def piece_starts(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: v.RangeHash) -> np.ndarray:
    """Positions at which a piece begins, the first of each text among them, in order."""
    n = len(codes)
    inside = np.zeros(n + 1, bool)
    inside[1:n] = (codes[: n - 1] == 10) | (_STOP[codes[: n - 1]] & _SPACE[codes[1:]]) if n > 1 else False
    inside[starts] = True
    inside[ends] = True
    natural = np.flatnonzero(inside)
    length = np.diff(np.append(natural, n + 1))
    if n > GRAM:
        at = np.arange(n - GRAM + 1)
        cuts = np.flatnonzero(v.winnow(hashed(at, at + GRAM), PIECE))
        owner = np.searchsorted(natural, cuts, "right") - 1
        inside[cuts[length[owner] >= PIECE]] = True
    return np.flatnonzero(inside)


def runs_of(texts: list[str], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, end (in the text) and hash of each run of pieces that covers run characters; one per piece start."""
    codes, starts, ends = v.codes_of(texts)
    hashed = v.RangeHash(codes)
    at = piece_starts(codes, starts, ends, hashed)
    to = np.searchsorted(at, at + run)
    ok = to < len(at)
    begin, stop = at[ok], at[to[ok]]
    text = np.searchsorted(starts, begin, "right") - 1
    ok = stop <= ends[text]
    begin, stop, text = begin[ok], stop[ok], text[ok]
    return text, begin - starts[text], stop - starts[text], hashed(begin, stop)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, text) to (h, c, at): each run's hash and place (start in the upper half, stop in the lower)."""
    for b in batches:
        for ids, texts in v.chunks([b.column(0).to_pylist(), b.column(1).to_pylist()], 1):
            text, begin, stop, h = runs_of(texts)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(np.asarray(ids, np.int64)[text]), pa.array((begin << 32) | stop)], names=["h", "c", "at"])


def _windows(span: int):
    """(class, text, places of runs) to (h, c, start): hash and start of every stretch of span characters that holds one of the runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts, places in v.chunks([c.to_pylist() for c in b.columns], 1):
                codes, starts, ends = v.codes_of(texts)
                text = np.repeat(np.arange(len(texts)), [len(x) for x in places])
                at = np.fromiter((x for p in places for x in p), np.int64, len(text))
                low = starts[text] + np.maximum((at & 0xFFFFFFFF) - span, 0)
                high = np.minimum(starts[text] + (at >> 32), ends[text] - span)
                ok = low <= high
                turn = np.zeros(len(codes) + 2, np.int64)
                np.add.at(turn, low[ok], 1)
                np.add.at(turn, high[ok] + 1, -1)
                first = np.flatnonzero(np.cumsum(turn) > 0)
                text = np.searchsorted(starts, first, "right") - 1
                h = v.RangeHash(codes)(first, first + span)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(np.asarray(ids, np.int64)[text]), pa.array((first - starts[text]).astype(np.int32))], names=["h", "c", "start"])

    return run


def _held_by_many(rows: DataFrame, place: str) -> DataFrame:
    """The rows (h, c, place) whose h more than one class holds. The hashes are counted before they meet the rows, so a hash that a third
    of all texts hold is one row on its side of the join.

    The rows are shuffled once for both sides: each side needs all columns, and a filter that Catalyst can neither move nor leave out keeps
    the join from planning a shuffle of its own in place of the one that both sides name.
    """
    parts = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # each part is read twice
    held = rows.where(F.col("h").isNotNull()).repartition(parts, "h")
    many = held.groupBy("h").agg(F.min("c").alias("_a"), F.max("c").alias("_b"), F.count(place).alias("_n")).where("_a < _b and _n > 1").select("h")
    return held.where(F.monotonically_increasing_id() >= 0).join(many.hint("shuffle_hash"), "h", "left_semi")


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, texts, around). members (id, c): the class of each record's text, named by a 64-bit hash of it; texts (c, text, places):
    those of classes that hold a repeated run, and where; around (h, c, start): every stretch of span characters around those runs, by its
    hash, the shared ones among them.

    Null ids and texts, and texts under span characters, are in none; of rows with one id, one text counts.
    """
    if span < SPAN:
        raise ValueError("runs are laid out for spans of 300 characters or more")
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and length(text) >= %d" % span)
    d = d.withColumn("c", F.xxhash64("text"))
    members = cut(d.groupBy("id").agg(F.min("c").alias("c")))
    runs = _held_by_many(d.select("c", "text").mapInArrow(_runs, "h long, c long, at long"), "at")
    places = runs.groupBy("c").agg(F.collect_set("at").alias("places"))
    wanted = cut(places.join(members.groupBy("c").agg(F.min("id").alias("id")), "c"))
    ids = small_side(wanted.select("c", "id"))
    texts = cut(d.join(ids, ["c", "id"], "left_semi").select("c", "text").dropDuplicates(["c"]).join(wanted.select("c", "places"), "c"))
    return members, texts, texts.mapInArrow(_windows(span), "h long, c long, start int")


def _links(texts: DataFrame, around: DataFrame, span: int) -> DataFrame:
    """(a, b): classes that hold a common stretch. Stretches of the same classes, such as those along one long passage, count once, and
    are compared as texts, not by hash alone. The stretches are shuffled once, by hash."""
    once = around.where(F.col("h").isNotNull()).repartition("h").groupBy("h", "c").agg(F.min("start").alias("start"))
    sets = once.groupBy("h").agg(F.count("start").alias("n"), F.bit_xor(F.xxhash64("c")).alias("mixed"), F.min("c").alias("least"), F.max("c").alias("most")).where("n > 1")
    chosen = sets.groupBy("n", "mixed", "least", "most").agg(F.min("h").alias("h")).select("h")
    at = once.join(chosen, "h", "left_semi").groupBy("c").agg(F.collect_list("start").alias("starts"))
    held = texts.select("c", "text").join(at, "c").select("c", "text", F.explode("starts").alias("start"))
    return pairs_within(held.select(F.sha2(F.substring("text", F.col("start") + 1, F.lit(span)), 256).alias("g"), F.col("c").alias("id")).distinct())


def shared_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """Pairs (doc_id_a < doc_id_b) of records whose texts have a verbatim stretch of span (300 or more) characters in common.

    Records with equal texts form one class, which takes part in the join once; its members are brought back at the end, in classes of
    every size. Null ids and texts and texts under span characters have no pairs; repeated ids are one record; empty tables give no rows.
    """
    members, texts, around = windows(docs, id_col, text_col, span)
    return expand(members.select("id", F.col("c").alias("rep")), _links(texts, around, span)).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def _covered(starts: str, span: int) -> F.Column:
    """Characters covered by stretches of span characters at an array of starts, overlaps counted once."""
    return F.expr(f"aggregate(array_sort({starts}), named_struct('n', 0L, 'to', 0), (s, x) -> named_struct('n', s.n + {span} - greatest(0, s.to - x), 'to', x + {span}), s -> s.n)")


def shared_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """One row for each record: doc_id, n_chars, shared_chars (in any stretch of span characters that stands in another record, too),
    removed_chars (in a stretch of which this record is not the first holder, by id), shared_part.

    Stretches that recur within one record alone do not count. A null text has 0 characters and a null shared_part. Repeated ids are one
    record each by id, with their longest text; null ids are one record with nothing shared.
    """
    members, _, around = windows(docs, id_col, text_col, span)
    shared = cut(_held_by_many(around, "start"))
    classes = cut(members.groupBy("c").agg(F.min("id").alias("least"), F.max("id").alias("most")))
    held = shared.join(classes.select("c", "least"), "c")
    first = held.groupBy("h").agg(F.min("least").alias("first"))
    cover = held.join(first, "h").groupBy("c").agg(F.collect_set("start").alias("s"), F.collect_set(F.when(F.col("first") < F.col("least"), F.col("start"))).alias("r"))
    cover = classes.join(cover.select("c", _covered("s", span).alias("s"), _covered("r", span).alias("r")), "c", "left")
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.length(text_col), F.lit(0)).alias("n"))
    hit = members.join(cover, "c").join(d.groupBy("id").agg(F.max("n").alias("n")), "id")
    # of a class of copies every member shares all it has, and all but the first are removed whole
    copies, other = F.col("least") < F.col("most"), F.col("id") > F.col("least")
    hit = hit.groupBy("id").agg(F.max(F.when(copies, F.col("n")).otherwise(F.col("s"))).alias("shared_chars"), F.max(F.when(other, F.col("n")).otherwise(F.col("r"))).alias("removed_chars"))
    out = d.groupBy("id").agg(F.max("n").alias("n_chars")).join(hit, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = out.select(F.col("id").alias(id_col), "n_chars", zero("shared_chars"), zero("removed_chars"))
    return out.withColumn("shared_part", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)))
