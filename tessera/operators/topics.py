"""Topics: singular directions of a conversation's positive pointwise mutual information, their sparsity, and scores by them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.cooccur import path_tokens


@dataclass(frozen=True)
class TopicConfig:
    window: int = 2
    min_count: int = 2
    shift: float = 1.0
    cds: float = 0.75
    k: int | None = None
    drop_top: int = 1
    ipr_weight: bool = True


#: Words up to which a matrix is decomposed as a dense one; beyond them its leading directions come from its cells alone.
DENSE = 1500
#: Directions that a step of leading() adds, those that it holds above the k that are asked for, and words and cells that it takes at a time.
_BLOCK, _SPARE, _TURN, _CELLS = 16, 80, 4096, 1 << 16


def default_rank(n_words: int, n_segments: int, cap: int = 200) -> int:
    return max(1, min(cap, n_words // 4, n_segments - 1, n_words - 1))


def participation(vectors: np.ndarray) -> np.ndarray:
    """Sum of fourth powers of each unit column."""
    squares = ((v * v, v @ v) for v in vectors.T)
    return np.array([(x @ x) / (norm * norm) if norm > 0 else 0.0 for x, norm in squares])


def _by_row(rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """The cells in their order in runs of about _CELLS, each (rows that have cells, where each begins, columns, values)."""
    o = np.lexsort((cols, rows))
    rows, cols, values = rows[o], cols[o].astype(np.intp), values[o]
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    cuts = np.append(np.unique(np.searchsorted(starts, np.arange(0, len(cols), _CELLS))), len(starts))
    ends = np.append(starts, len(cols))
    return [(rows[starts[a:b]], starts[a:b] - starts[a], cols[starts[a] : ends[b]], values[starts[a] : ends[b]]) for a, b in zip(cuts[:-1], cuts[1:]) if a < b]


def _times(cells: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    """The matrix of the cells times each row of x, a vector at a time, which stays in the cache with what is summed up."""
    out, most = np.zeros_like(x), np.empty(max(len(cols) for _, _, cols, _ in cells))
    for v, to in zip(x, out):
        for rows, starts, cols, values in cells:
            each = most[: len(cols)]
            np.take(v, cols, out=each, mode="clip")
            each *= values
            to[rows] = np.add.reduceat(each, starts)
    return out


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """Orthonormal rows of the same span; by their products, unless these are too close to singular."""
    try:
        return np.linalg.inv(np.linalg.cholesky(x @ x.T)) @ x
    except np.linalg.LinAlgError:
        return np.linalg.qr(x.T)[0].T


def leading(n: int, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, k: int, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(U, s): the first k left singular directions and values of the n x n matrix of the cells, by block Lanczos steps on A A' with full
    orthogonalisation, until each direction's residual is within tol of the largest eigenvalue or the steps span the whole space.

    No more than k + _SPARE directions are held: then the steps go on from the best of what they span (thick restart)."""
    forth, back = _by_row(rows, cols, values), _by_row(cols, rows, values)
    rng = np.random.default_rng(0)
    most = min(n, k + _SPARE)
    q = np.empty((most, n))  # a direction to a row; rows take memory as they are filled
    t = np.zeros((0, 0))
    new = _orthonormal(_orthonormal(rng.standard_normal((min(_BLOCK, n), n))))
    m = step = 0
    while True:
        left = _times(forth, _times(back, new))
        b = len(new)
        q[m : m + b] = new
        c = q[: m + b] @ left.T
        t = np.block([[t, c[:m]], [c[:m].T, (c[m:] + c[m:].T) / 2]])
        m += b
        left -= c.T @ q[:m]
        step += 1
        whole, filled = m >= n, m + _BLOCK > most
        if whole or filled or (m >= k + _BLOCK and step % 8 == 0):
            theta, y = np.linalg.eigh(t)
            theta, y = theta[::-1], y[:, ::-1]
            end = y[m - b :, :k]
            done = whole or (((left @ left.T) @ end * end).sum(0) <= (tol * theta[0]) ** 2).all()
            if done or (filled and most < n):
                held = k if done else min(k + _SPARE // 4, m - _BLOCK)
                for at in range(0, n, _TURN):
                    q[:held, at : at + _TURN] = y[:, :held].T @ q[:m, at : at + _TURN]
                if done:
                    q.resize((k, n), refcheck=False)
                    return q.T, np.sqrt(np.maximum(theta[:k], 0))
                t, m = np.diag(theta[:held]), held
        # a direction that is used up is replaced by a random one, so that equal values are all found
        scale = np.linalg.norm(left, axis=1)
        spent = scale <= 1e-12 * max(float(np.abs(t).max()), 1e-300)
        left[spent] = rng.standard_normal((int(spent.sum()), n))
        left[~spent] /= scale[~spent, None]
        left = left[: n - m]
        for _ in range(2):
            left -= (q[:m] @ left.T).T @ q[:m]
            left = _orthonormal(left)
        new = np.ascontiguousarray(left)


def _cells(ids: np.ndarray, of: np.ndarray, n: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, values): both ways, how often two words stand within the window of one list, by 1/distance.

    Pairs are counted one way and a distance at a time, so that only their keys are ever sorted."""
    keys, values = [], []
    for d in range(1, window + 1):
        same = of[:-d] == of[d:]
        a, b = ids[:-d][same], ids[d:][same]
        key = np.minimum(a, b) * n + np.maximum(a, b)
        key.sort()
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        keys.append(key[starts])
        values.append(np.diff(starts, append=len(key)) / d)
    key, cell = np.unique(np.concatenate(keys), return_inverse=True)
    m = np.bincount(cell, np.concatenate(values), len(key))
    low, high = key // n, key % n
    m[low == high] *= 2
    two = low != high
    low, high = low.astype(np.int32), high.astype(np.int32)
    return np.concatenate([low, high[two]]), np.concatenate([high, low[two]]), np.concatenate([m, m[two]])


def _model(ids: np.ndarray, of: np.ndarray, n_lists: int, config: TopicConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """fit() over word numbers in the order of the words, and the list that each stands in."""
    counts = np.bincount(ids)
    kept = np.flatnonzero(counts >= config.min_count)
    n = len(kept)
    if n < 3:
        return None
    kept = kept[np.argsort(-counts[kept], kind="stable")]
    place = np.full(len(counts), -1, np.int64)
    place[kept] = np.arange(n)
    at = place[ids]
    rows, cols, m = _cells(at[at >= 0], of[at >= 0], n, config.window)
    del at
    if not len(rows):
        return None
    r = np.bincount(rows, m, n)
    c = np.bincount(cols, m, n) ** config.cds
    pmi = np.log(m * c.sum() / (r[rows] * c[cols])) - (np.log(config.shift) if config.shift > 1 else 0.0)
    rows, cols, pmi = rows[pmi > 0], cols[pmi > 0], pmi[pmi > 0]
    del m
    k = max(1, min(config.k or default_rank(n, n_lists), n - 1))
    if not len(pmi):
        u, s = np.eye(n, k), np.zeros(k)
    elif n <= DENSE:
        full = np.zeros((n, n))
        full[rows, cols] = pmi
        theta, u = np.linalg.eigh(full @ full.T)
        u, s = u[:, ::-1][:, :k], np.sqrt(np.maximum(theta[::-1][:k], 0))
    else:
        u, s = leading(n, rows, cols, pmi, k)
    return kept, u, s, participation(u)


def fit(token_lists: list, config: TopicConfig = TopicConfig()) -> tuple[list, np.ndarray, np.ndarray, np.ndarray] | None:
    """(words, W, singular values, participation ratios) over all words of min_count or more; None under three words or without pairs.

    Words may be texts or numbers. The matrix is held by its cells; only one of up to DENSE words is ever spread out."""
    filled = [np.asarray(t) for t in token_lists if len(t)]
    if not filled:
        return None
    words, ids = np.unique(np.concatenate(filled), return_inverse=True)
    model = _model(ids, np.repeat(np.arange(len(filled)), [len(t) for t in filled]), len(token_lists), config)
    return model and (words[model[0]].tolist(), *model[1:])


def scores(token_lists: list[list[str]], model, drop_top: int = 1, ipr_weight: bool = True) -> np.ndarray:
    """Length of each segment's mean word vector, without the densest directions and weighted by sparsity."""
    words, w, _, ipr = model
    index = {x: i for i, x in enumerate(words)}
    weight = np.ones(w.shape[1])
    weight[np.argsort(ipr, kind="stable")[: min(drop_top, len(weight))]] = 0.0
    if ipr_weight and ipr.max() > 0:
        weight *= ipr / ipr.max()
    out = np.zeros(len(token_lists))
    for i, t in enumerate(token_lists):
        ids = [index[x] for x in t if x in index]
        if ids:
            out[i] = np.linalg.norm(w[ids].mean(0) * weight)
    return out


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns of least total cost (shortest augmenting paths)."""
    n, m = cost.shape
    if n > m:
        return sorted((i, j) for j, i in assign(cost.T))
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[owner[j0] - 1, free - 1] - u[owner[j0]] - v[free]
            better = reduced < low[free]
            low[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[np.argmin(low[free])]
            d = low[j1]
            u[owner[used]] += d
            v[used] -= d
            low[~used] -= d
            j0 = j1
            if not owner[j0]:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def aligned_cosines(a, b) -> np.ndarray:
    """Cosines of the best matching of two models' directions over their common words, whatever the sign; 0 for a direction that has none of
    these words, of which there is only what rounding left."""
    both, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return np.zeros(0)
    c, nx, ny = np.zeros((a[1].shape[1], b[1].shape[1])), np.zeros(a[1].shape[1]), np.zeros(b[1].shape[1])
    for at in range(0, len(both), _TURN):
        x, y = a[1][ia[at : at + _TURN]], b[1][ib[at : at + _TURN]]
        c += x.T @ y
        nx += (x * x).sum(0)
        ny += (y * y).sum(0)
    x, y = (np.where(squares > 1e-12, 1 / np.sqrt(np.maximum(squares, 1e-12)), 0.0) for squares in (nx, ny))
    c = np.abs(c) * np.outer(x, y)
    return np.array([c[i, j] for i, j in assign(-c)])


def _numbered(batches: Iterator[pa.RecordBatch], min_count: int) -> tuple[pa.Array, np.ndarray, np.ndarray, int]:
    """(words, ids, of, lists): the sorted words of min_count or more, the number of each of their tokens, and of its list by seg_id.

    Each batch's texts are dropped once its words are numbered."""
    dictionaries, ids, segments, lengths = [], [], [], []
    for batch in batches:
        tokens = batch.column("tokens")
        each = tokens.flatten().dictionary_encode()
        dictionaries.append(each.dictionary)
        ids.append(each.indices.to_numpy(zero_copy_only=False))
        segments.append(batch.column("seg_id").to_numpy(zero_copy_only=False))
        lengths.append(tokens.value_lengths().to_numpy(zero_copy_only=False))
    total = pa.chunked_array(dictionaries, pa.string()).combine_chunks().dictionary_encode()
    words, place = total.dictionary, np.split(total.indices.to_numpy(), np.cumsum([len(x) for x in dictionaries])[:-1])
    tokens = np.concatenate([p[i] for p, i in zip(place, ids)])
    segment, length = np.concatenate(segments), np.concatenate(lengths)
    rank = np.empty(len(segment), np.int64)
    rank[np.argsort(segment, kind="stable")] = np.arange(len(segment))
    of = np.repeat(rank, length)
    frequent = np.bincount(tokens, minlength=len(words)) >= min_count
    words = words.filter(pa.array(frequent))
    number = np.full(len(frequent), -1)
    order = pc.sort_indices(words).to_numpy()
    number[np.flatnonzero(frequent)[order]] = np.arange(len(order))
    tokens, of = tokens[at := np.argsort(of, kind="stable")], of[at]
    tokens = number[tokens]
    kept = tokens >= 0
    return words.take(pa.array(order)), tokens[kept].astype(np.int32), of[kept].astype(np.int32), len(segment)


def _largest(x: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest, the first of equal ones first."""
    if len(x) <= n:
        return np.argsort(-x, kind="stable")
    some = np.flatnonzero(x >= np.partition(x, len(x) - n)[len(x) - n])
    return some[np.argsort(-x[some], kind="stable")][:n]


def _grouped(segments: DataFrame, numbers: bool = False) -> DataFrame:
    """Tokens by conversation, as 64-bit hashes where words are not named in the end."""
    tokens = path_tokens(F.col("text"))
    tokens = F.transform(tokens, lambda w: F.xxhash64(w)) if numbers else tokens
    return segments.where("text is not null").select("conv_id", "seg_id", tokens.alias("tokens")).groupBy("conv_id")


def topic_scores(segments: DataFrame, config: TopicConfig = TopicConfig()) -> DataFrame:
    """(conv_id, seg_id, score); 0 where a conversation is too small for topics."""
    types = dict(segments.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg_id")
        lists = list(pdf["tokens"])
        model = fit(lists, config)
        s = scores(lists, model, config.drop_top, config.ipr_weight) if model else np.zeros(len(lists))
        return pdf[["conv_id", "seg_id"]].assign(score=s)

    return _grouped(segments, True).applyInPandas(run, f"conv_id {types['conv_id']}, seg_id {types['seg_id']}, score double")


def topic_report(segments: DataFrame, config: TopicConfig = TopicConfig(), n_words: int = 8, folds: int = 2) -> DataFrame:
    """(conv_id, run, topic, singular_value, ipr, words, stability): one model for each conversation (run is 0); directions from the densest; words by weight; stability is the mean
    cosine with the directions of interleaved parts."""
    kind = dict(segments.dtypes)["conv_id"]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, of, n = _numbered(batches, config.min_count)
        model = _model(ids, of, n, config)
        if not model:
            return
        cosines = []
        for f in range(folds):
            here = of % folds == f
            if m := _model(ids[here], of[here], len(range(f, n, folds)), config):
                cosines.append(aligned_cosines(model, m))
            m = None  # before the next is made
        stability = float(np.mean(np.concatenate(cosines))) if cosines and sum(map(len, cosines)) else None
        kept, w, s, ipr = model
        order = np.argsort(ipr, kind="stable")
        top = words.take(pa.array(kept[np.concatenate([_largest(np.abs(w[:, j]), n_words) for j in order])]))
        k = len(order)
        columns = [pa.array([key[0].as_py()] * k, key[0].type), pa.array(np.zeros(k, np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(s[order]), pa.array(ipr[order])]
        columns += [pa.ListArray.from_arrays(np.arange(0, len(top) + 1, len(top) // k, dtype=np.int32), top), pa.array([stability] * k, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "run", "topic", "singular_value", "ipr", "words", "stability"])

    return _grouped(segments).applyInArrow(run, f"conv_id {kind}, run int, topic int, singular_value double, ipr double, words array<string>, stability double")
