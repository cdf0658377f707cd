"""Selectors whose gain depends on what is kept already: novelty of words, and compressed length.

Both need a conversation's candidates side by side: each conversation, of any size, is one run with one budget and one state. A task holds
its word numbers, costs and scores (codecs: its texts).
"""

from __future__ import annotations

import heapq
import lzma
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import plain_words


def word_sets(segments: DataFrame) -> DataFrame:
    """(conv_id, seg_id, word): plain words, without those in more than half of the conversation's segments."""
    w = segments.select("conv_id", "seg_id", F.explode(plain_words(F.col("text"))).alias("word"))
    n = segments.groupBy("conv_id").agg(F.count("*").alias("n"))
    common = w.groupBy("conv_id", "word").agg(F.count("*").alias("df")).join(n, "conv_id").where(F.col("df") > F.col("n") / 2).select("conv_id", "word")
    return w.join(common, ["conv_id", "word"], "left_anti")


def _budgeted(segments: DataFrame, budgets: DataFrame) -> DataFrame:
    """segments with their conversation's budget."""
    return segments.join(budgets.select("conv_id", "budget"), "conv_id")


def pick_novel(scores: np.ndarray, costs: np.ndarray, words: list[np.ndarray], forced: np.ndarray, budget: int, alpha: float, per_token: bool) -> list[int]:
    """Indices kept by a greedy fill of score times the unseen share of words to the power alpha; exact by lazy re-evaluation, since
    gains only fall. Ties go to the smaller index."""
    if alpha < 0 or (alpha > 0 and (scores < 0).any()):
        raise ValueError("alpha and scores must not be negative")
    seen = np.zeros(1 + max((int(w.max()) for w in words if len(w)), default=0), bool)
    keep = [int(i) for i in np.flatnonzero(forced)]
    for i in keep:
        seen[words[i]] = True
    left = budget - int(costs[keep].sum())
    if left <= 0:
        return keep

    def gain(i: int) -> float:
        share = 1.0 if not len(words[i]) else 1.0 - float(seen[words[i]].mean())
        g = float(scores[i]) * share**alpha
        return g / max(int(costs[i]), 1) if per_token else g

    heap = [(-gain(i), i) for i in range(len(scores)) if not forced[i]]
    heapq.heapify(heap)
    while heap:
        bound, i = heapq.heappop(heap)
        if costs[i] > left:
            continue
        now = -gain(i)
        if now > bound and heap and (now, i) > heap[0]:
            heapq.heappush(heap, (now, i))
            continue
        keep.append(i)
        left -= int(costs[i])
        seen[words[i]] = True
    return keep


def word_hashes() -> Column:
    """The plain words of a segment's text, hashed; none for null."""
    return F.coalesce(F.transform(plain_words(F.col("text")), lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def novelty_select(segments: DataFrame, budgets: DataFrame, alpha: float = 0.5, protect: str = "none", per_token: bool = False) -> DataFrame:
    """segments (with score) that a novelty-discounted fill keeps; alpha 0 is the plain greedy fill. Null scores count 0.

    Words in more than half of the conversation's segments are boilerplate and do not count. segments may have their word_hashes() as words
    in place of texts."""
    from tessera.operators.budget import forced as must

    s = segments if "words" in segments.columns else segments.withColumn("words", word_hashes())
    s = _budgeted(s.withColumn("forced", must(protect)), budgets)
    types = dict(segments.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg_id", ignore_index=True)
        lens = pdf["words"].map(len).to_numpy()
        _, numbers, df = np.unique(np.concatenate([np.asarray(w, np.int64) for w in pdf["words"]]), return_inverse=True, return_counts=True)
        words = [w[df[w] <= len(pdf) / 2] for w in np.split(numbers, np.cumsum(lens)[:-1])]
        kept = pick_novel(pdf["score"].fillna(0).to_numpy(float), pdf["tokens"].to_numpy(np.int64), words, pdf["forced"].to_numpy(bool), int(pdf["budget"].iloc[0]), alpha, per_token)
        return pdf.loc[sorted(kept), ["conv_id", "seg_id"]]

    kept = s.select("conv_id", "seg_id", "score", "tokens", "forced", "budget", "words").groupBy("conv_id").applyInPandas(run, f"conv_id {types['conv_id']}, seg_id {types['seg_id']}")
    return segments.join(kept, ["conv_id", "seg_id"], "left_semi")


class _Zlib:
    """How many bytes a text adds to what was compressed before."""

    def __init__(self) -> None:
        self._c = zlib.compressobj(6, zlib.DEFLATED, -15)

    def gain(self, text: bytes) -> int:
        c = self._c.copy()
        return len(c.compress(text)) + len(c.flush(zlib.Z_SYNC_FLUSH))

    def add(self, text: bytes) -> None:
        self._c.compress(text)
        self._c.flush(zlib.Z_SYNC_FLUSH)


class _Lzma:
    # fixed values: the settings of the codec
    _FILTERS = [{"id": lzma.FILTER_LZMA2, "preset": 1 | lzma.PRESET_EXTREME, "dict_size": 1 << 24}]

    def __init__(self) -> None:
        self._held, self._size = b"", self._length(b"")

    def _length(self, data: bytes) -> int:
        return len(lzma.compress(data, format=lzma.FORMAT_RAW, filters=self._FILTERS))

    def gain(self, text: bytes) -> int:
        return self._length(self._held + text) - self._size

    def add(self, text: bytes) -> None:
        self._held += text
        self._size = self._length(self._held)


def pick_dense(texts: list[str], costs: np.ndarray, budget: int, codec: str = "zlib") -> list[int]:
    """Indices kept by most new compressed bytes per token, with lazy re-evaluation."""
    state = {"zlib": _Zlib, "lzma": _Lzma}[codec]()
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    heap = [(-state.gain(r) / max(int(c), 1), i) for i, (r, c) in enumerate(zip(raw, costs, strict=True))]
    heapq.heapify(heap)
    keep, left = [], budget
    while heap:
        bound, i = heapq.heappop(heap)
        if costs[i] > left:
            continue
        now = -state.gain(raw[i]) / max(int(costs[i]), 1)
        if now > bound and heap and (now, i) > heap[0]:
            heapq.heappush(heap, (now, i))
            continue
        keep.append(i)
        left -= int(costs[i])
        state.add(raw[i])
    return keep


def codec_select(segments: DataFrame, budgets: DataFrame, codec: str = "zlib") -> DataFrame:
    """segments that add most to a compressor's output for their tokens, within the budget. Null texts add nothing."""
    types = dict(segments.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg_id", ignore_index=True)
        kept = pick_dense(pdf["text"].fillna("").tolist(), pdf["tokens"].to_numpy(np.int64), int(pdf["budget"].iloc[0]), codec)
        return pdf.loc[sorted(kept), ["conv_id", "seg_id"]]

    s = _budgeted(segments, budgets).select("conv_id", "seg_id", "text", "tokens", "budget")
    kept = s.groupBy("conv_id").applyInPandas(run, f"conv_id {types['conv_id']}, seg_id {types['seg_id']}")
    return segments.join(kept, ["conv_id", "seg_id"], "left_semi")
