"""Problem 3: oversized items cut into pieces by content-defined chunking.

A hash rolls over the text; places where it meets a mask are landmarks. A cut is made at the natural boundary nearest to the first
landmark between the least and the greatest size of a piece, so that where an edit changes the text, the cuts behind it fall back into
step at the next landmark, and only neighbouring pieces differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import vectext as v
from tessera.runtime import small_side

#: Characters under the rolling hash.
WINDOW = 24
_STOPS = np.isin(np.arange(0x3002 + 1), [ord(c) for c in ".!?…。"])
_BLANKS = np.isin(np.arange(0x3000 + 1), [9, 10, 13, 32, 0xA0, 0x3000])

_PARAGRAPH, _LINE, _SENTENCE, _WORD = 4, 3, 2, 1


def _is(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return table[np.minimum(codes, len(table) - 1)] & (codes < len(table))


def boundaries(codes: np.ndarray) -> np.ndarray:
    """For each position 0..n the grade of the boundary before it: paragraph, line, sentence, word, or 0 for none."""
    n = len(codes)
    grade = np.zeros(n + 1, np.int8)
    if n < 2:
        return grade
    blank = _is(_BLANKS, codes)
    before, after = blank[:-1], blank[1:]
    grade[1:n][before & ~after] = _WORD  # a piece begins with a word
    stop = _is(_STOPS, codes)
    last_seen = np.maximum.accumulate(np.where(~blank, np.arange(n), -1))[:-1]
    ended = (last_seen >= 0) & stop[np.maximum(last_seen, 0)] & before & ~after
    grade[1:n][ended] = _SENTENCE
    # an end of line holds for all white space up to the next text, or for the place right behind it where the next line is indented
    feed = codes == 10
    grade[1:n][feed[:-1] & ~(after & (codes[1:] == 10))] = _LINE
    count = np.cumsum(feed)
    gap = count[:-1] - np.where(last_seen >= 0, count[np.maximum(last_seen, 0)], 0)
    grade[1:n][(grade[1:n] == _LINE) & (gap >= 2)] = _PARAGRAPH
    return grade


def cuts(text: str, most: int, overlap: int) -> list[int]:
    """Ends of the pieces of text, in order; piece k is text[max(0, cuts[k-1] - overlap) : cuts[k]], and none has over most characters.

    A text of most characters or fewer is one piece. overlap is taken as most // 2 at the utmost.
    """
    n = len(text)
    if n <= most:
        return [n]
    overlap = max(0, min(overlap, most // 2))
    core = most - overlap
    least = max(1, core // 4)
    codes, _, _ = v.codes_of([text])
    grade = boundaries(codes)
    at = np.arange(n + 1)
    rolled = v.RangeHash(codes)(np.maximum(at - WINDOW, 0), at)
    bits = max(1, int(np.log2(max(2, core // 4))))
    landmarks = np.flatnonzero(rolled >> np.uint64(64 - bits) == 0)
    natural = np.flatnonzero(grade >= _SENTENCE)
    words = np.flatnonzero(grade == _WORD)
    out, done = [], 0
    while True:
        room = most if not out else core
        if n - done <= room:
            return [*out, n]
        lo, hi = done + least, min(done + room, n - 1)
        i = np.searchsorted(landmarks, lo)
        mark = int(landmarks[i]) if i < len(landmarks) and landmarks[i] <= hi else lo + int(np.argmin(rolled[lo : hi + 1]))
        for places in (natural, words):
            a, b = np.searchsorted(places, lo), np.searchsorted(places, hi, "right")
            if a < b:
                inside = places[a:b]
                mark = int(inside[np.argmin(np.abs(inside - mark))])
                break
        else:
            if codes[mark - 1] == 13 and codes[mark] == 10 and mark > done + 1:
                mark -= 1  # a line end is not taken apart
        out.append(mark)
        done = mark


_OUT = "src string, item_uid bigint, block int, kind string, piece int, start_pos int, new_pos int, end_pos int, text string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, item_uid, block, kind, text, most, overlap) to one row for each piece."""
    for b in batches:
        rows = []
        for src, uid, block, kind, text, most, overlap in zip(*(c.to_pylist() for c in b.columns), strict=True):
            done = 0
            for k, end in enumerate(cuts(text, most, overlap)):
                start = max(0, done - max(0, min(overlap, most // 2))) if k else 0
                rows.append((src, uid, block, kind, k, start, done, end, text[start:end]))
                done = end
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        names = ("src", "item_uid", "block", "kind", "piece", "start_pos", "new_pos", "end_pos", "text")
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=list(names))


def items(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """Segment texts and block texts as (src, item_uid, block, kind, text); null texts and texts without an id are left out."""
    s = segments.select(F.lit("segments").alias("src"), F.col("seg_uid").cast("long").alias("item_uid"), F.lit(0).alias("block"), "kind", "text")
    t = turns.select(F.col("turn_uid").cast("long").alias("item_uid"), F.posexplode("blocks").alias("block", "b"))
    t = t.select(F.lit("turns").alias("src"), "item_uid", "block", F.col("b.kind").alias("kind"), F.col("b.text").alias("text"))
    return s.unionByName(t).where("text is not null and item_uid is not null")


def split_oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces, in order, of each item whose text without white space at its ends is longer than max_chars of its kind.

    items: src, item_uid, block, kind, text. limits: kind, max_chars, overlap_chars. Result: src, item_uid, block, kind, piece (from 0),
    start_pos, new_pos (where that begins which the piece before has not), end_pos, text; positions count in the text without white
    space at its ends. Items of a kind without a limit, or whose limit is null or under 1, are whole; a null overlap is 0; of several
    limits of a kind the least holds. Repeated items are each cut. A text without any boundary is cut at the landmarks.
    """
    lim = limits.where("kind is not null and max_chars >= 1").groupBy("kind").agg(F.min(F.struct("max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("o"))).alias("l"))
    lim = lim.select("kind", F.col("l.max_chars").cast("int").alias("most"), F.col("l.o").cast("int").alias("overlap"))
    text = F.expr(r"trim(BOTH ' \t\r\n' FROM text)")
    long = items.select("src", "item_uid", F.col("block").cast("int"), "kind", text.alias("text")).join(small_side(lim), "kind").where(F.length("text") > F.col("most"))
    return long.select("src", "item_uid", "block", "kind", "text", "most", "overlap").mapInArrow(_cut, _OUT)


def oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """(src, item_uid, block) of the items that split_oversized takes apart."""
    return split_oversized(items, limits).where("piece = 0").select("src", "item_uid", "block")
