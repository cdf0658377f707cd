"""Problem 8: evaluation passages that leak into documents, by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import vectext as v
from tessera.runtime import cut

#: Words in a row that make a leak.
SPAN = 13
#: Fixed masks over SPAN words; a zero is a word position that the hash ignores. Positions are taken modulo 7, and each mask ignores the
#: residues of one line of the plane of seven points; any two residues lie on a line, so any two substitutions in a window are ignored by
#: one mask at least.
MASKS = tuple("".join("0" if p % 7 in {i, (i + 1) % 7, (i + 3) % 7} else "1" for p in range(SPAN)) for i in range(7))
#: Substitutions in a window that some mask is sure to ignore.
TOLERATED = 2
#: Most test hashes that are sent to every task to filter the training windows; beyond it all of them meet in a shuffle join.
KNOWN_HASHES = 500_000


def seeds(words: np.ndarray, offsets: np.ndarray, masks: tuple[str, ...] = MASKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of SPAN words: its text, its first word, and a row of hashes, one for each mask."""
    n = len(masks[0])
    counts = np.maximum(np.diff(offsets) - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    out = np.concatenate(([0], np.cumsum(counts)))
    first = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], counts)
    hashes = np.empty((len(masks), len(first)), np.uint64)
    for m, mask in enumerate(masks):
        h = np.full(len(first), m + 1, np.uint64)
        for k, bit in enumerate(mask):
            if bit == "1":
                h = h * np.uint64(0x9E3779B97F4A7C15) + words[first + k]
        hashes[m] = v.mix(h)
    return text, first, hashes


def _emit(masks: tuple[str, ...], known: np.ndarray | None):
    """mapInArrow body: (id, text) to (h, id, at), one row per window and mask hash. known: sorted test hashes; windows that meet none
    are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in v.chunks([b.column(0).to_pylist(), b.column(1).to_pylist()], 1):
                words, offsets = v.words_of(texts)
                text, first, hashes = seeds(words, offsets, masks)
                for h in hashes:
                    pick = np.arange(len(h))
                    if known is not None:
                        at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                        pick = np.flatnonzero(known[at] == h) if len(known) else pick[:0]
                    if len(pick):
                        yield pa.record_batch([pa.array(h[pick].view(np.int64)), pa.array(np.asarray(ids, np.int64)[text[pick]]), pa.array((first[pick] - offsets[text[pick]]).astype(np.int32))], names=["h", "id", "at"])

    return run


def _words_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, places) to (id, at, w): the words of the window at each place."""
    for b in batches:
        for ids, texts, places in v.chunks([c.to_pylist() for c in b.columns], 1):
            words, offsets = v.words_of(texts)
            text = np.repeat(np.arange(len(texts)), [len(p) for p in places])
            at = np.fromiter((x for p in places for x in p), np.int64, len(text))
            ok = at + SPAN <= np.diff(offsets)[text]
            text, at = text[ok], at[ok]
            w = words[(offsets[text] + at)[:, None] + np.arange(SPAN)].view(np.int64)
            yield pa.record_batch([pa.array(np.asarray(ids, np.int64)[text]), pa.array(at.astype(np.int32)), pa.ListArray.from_arrays(np.arange(len(text) + 1, dtype=np.int32) * SPAN, pa.array(w.ravel()))], names=["id", "at", "w"])


def _with_words(hits: DataFrame, texts: DataFrame, id_col: str, at_col: str, out: str) -> DataFrame:
    """hits with the words of the window at (id_col, at_col); only texts that are hit are read for them."""
    places = hits.groupBy(F.col(id_col).alias("id")).agg(F.collect_set(at_col).alias("places"))
    met = texts.join(places, "id").select("id", "text", "places").mapInArrow(_words_at, "id long, at int, w array<long>")
    return hits.join(met.select(F.col("id").alias(id_col), F.col("at").alias(at_col), F.col("w").alias(out)), [id_col, at_col])


def leak_hits(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, known_hashes: int = KNOWN_HASHES) -> DataFrame:
    """Hits of test windows in training windows: doc_id, item_id, doc_at, item_at (word positions), same (equal words of SPAN).

    docs has doc_id and text, items has item_id and passage; other columns are ignored. Null texts have no words.
    A hit has equal words at all positions of one mask at least; every window with TOLERATED substitutions or fewer is one, and others by
    chance; ``same`` counts the equal words. The test hashes filter the training windows within the scan where they are counted as at most
    known_hashes; otherwise all hashes are shuffled, without their words, which are fetched for hits alone. Repeated rows each have their
    hits; empty tables give no rows.
    """
    schema = "h long, id long, at int"
    i = items.select(F.col("item_id").cast("long").alias("id"), F.col("passage").alias("text")).where("text is not null and id is not null")
    test = cut(i.mapInArrow(_emit(masks, None), schema))
    known = None
    if test.limit(known_hashes + 1).count() <= known_hashes:
        known = np.unique(np.asarray([r.h for r in test.select("h").distinct().collect()], np.int64).view(np.uint64))
    d = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text")).where("text is not null and id is not null")
    train = d.mapInArrow(_emit(masks, known), schema)
    met = cut(train.join(test.select("h", F.col("id").alias("item_id"), F.col("at").alias("item_at")), "h").select(F.col("id").alias("doc_id"), "item_id", F.col("at").alias("doc_at"), "item_at").distinct())
    both = _with_words(_with_words(met, i, "item_id", "item_at", "iw"), d, "doc_id", "doc_at", "w")
    return both.select("doc_id", "item_id", "doc_at", "item_at", F.expr("size(filter(zip_with(w, iw, (x, y) -> x = y), z -> z))").alias("same")).distinct()


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of documents that hold SPAN consecutive words of an item: hits whose words all agree."""
    return leak_hits(docs, items).where(F.col("same") == SPAN).select("doc_id", "item_id").distinct()


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and item with a hit: n_windows, n_exact, most words agreeing, first word position in the document.

    Hits with more than TOLERATED substitutions are passed over: of those not every one is found.
    """
    return (
        leak_hits(docs, items)
        .where(F.col("same") >= SPAN - TOLERATED)
        .groupBy("doc_id", "item_id")
        .agg(F.count("*").alias("n_windows"), F.sum((F.col("same") == SPAN).cast("int")).alias("n_exact"), F.max("same").alias("best_same"), F.min("doc_at").alias("first_word"))
    )
