"""Scores of segments: tf-idf and other baselines, normalisation within kinds, and the spectral family on embeddings.

tf-idf, ranks and z-scores are plain aggregations. The spectral scores need only a d x d Gram matrix of each conversation, which is summed
in the cluster, so that no task holds a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tessera.functions import vectext as v
from tessera.runtime import cut

DIM = 64


def recency(segments: DataFrame) -> DataFrame:
    """score: the place in the conversation."""
    return segments.withColumn("score", F.col("seg_id").cast("double"))


def random_scores(segments: DataFrame, seed: int = 0) -> DataFrame:
    """score: uniform in [0, 1), by a hash of seed, conversation and segment, the same on any partitioning."""
    return segments.withColumn("score", F.pmod(F.xxhash64(F.lit(seed), "conv_id", "seg_id"), F.lit(1 << 40)) / float(1 << 40))


#: Tokens of the tf-idf baseline.
TFIDF_TOKEN = r"[A-Za-z_][A-Za-z0-9_./-]+|[0-9]+"


def term_counts(segments: DataFrame, pattern: str = TFIDF_TOKEN) -> DataFrame:
    """(conv_id, seg_id, term, tf): lower-case terms of each segment."""
    t = segments.select("conv_id", "seg_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("term"))
    return t.groupBy("conv_id", "seg_id", "term").agg(F.count("*").alias("tf"))


def term_hashes(pattern: str = TFIDF_TOKEN) -> Column:
    """The lower-case terms of a segment's text, hashed, repeats kept; none for null."""
    return F.transform(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0)), lambda t: F.xxhash64(t))


def tfidf(segments: DataFrame, pattern: str = TFIDF_TOKEN, mean: bool = True) -> DataFrame:
    """segments with score: the mean (or sum) of a segment's weights, with sublinear term and smoothed document frequency within its
    conversation and unit length; 0 for a segment without terms. Rounded to 9 places, so that equal scores tie on any partitioning.

    Terms are compared by their 64-bit hashes; segments may have them as terms (term_hashes) in place of texts."""
    # one shuffle, by conversation and term, serves the counts within segments and the document frequencies alike
    t = segments.select("conv_id", "seg_id", F.explode(F.col("terms") if "terms" in segments.columns else term_hashes(pattern)).alias("term"))
    tf = t.repartition("conv_id", "term").groupBy("conv_id", "seg_id", "term").agg(F.count("*").alias("tf"))
    df = F.count("*").over(Window.partitionBy("conv_id", "term"))
    n = segments.groupBy("conv_id").agg(F.count("*").alias("n"))
    w = tf.withColumn("df", df).join(n, "conv_id").withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1.0))
    total = F.sum("w") / F.sqrt(F.sum(F.col("w") * F.col("w")))
    s = w.groupBy("conv_id", "seg_id").agg(F.round(total / F.count("*") if mean else total, 9).alias("score"))
    return segments.join(s, ["conv_id", "seg_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def kind_norm(scored: DataFrame, norm: str, min_segments: int = 5) -> DataFrame:
    """scored with score normalised within its kind (a kind of few segments: against the whole conversation): "rank", the average rank on
    0..1, where one alone is 0.5, or "z", the distance from the mean by the population deviation, 0 without one."""
    if norm not in ("rank", "z"):
        raise ValueError(f"unknown normalisation: {norm!r}")

    def within(*keys: str) -> Column:
        w = Window.partitionBy(*keys)
        n = F.count("*").over(w)
        if norm == "z":
            mean, dev = F.avg("score").over(w), F.stddev_pop("score").over(w)
            return F.when(dev > 0, (F.col("score") - mean) / dev).otherwise(0.0)
        ties = F.count("*").over(Window.partitionBy(*keys, "score"))
        average = F.rank().over(w.orderBy("score")) + (ties - 1) / 2.0
        return F.when(n > 1, (average - 1) / (n - 1)).otherwise(0.5)

    many = F.count("*").over(Window.partitionBy("conv_id", "kind")) >= min_segments
    return scored.withColumn("score", F.when(many, within("conv_id", "kind")).otherwise(within("conv_id")))


def vectors_of(texts: list[str], seed: str, dim: int = DIM) -> np.ndarray:
    """A row of unit length for each text: its words and their groups of three letters, in lower case, hashed to places under random
    signs. Hashes are those of ranges of one array of code points, so nothing runs per word."""
    codes, starts, ends = v.codes_of([t.lower() for t in texts])
    h = v.RangeHash(codes)
    gap = np.ones(len(codes) + 2, bool)
    gap[1:-1] = _GAPS[np.minimum(codes, len(_GAPS) - 1)]
    at = np.flatnonzero(gap[1:] != gap[:-1])
    first, last = at[::2], at[1::2]
    inside = ~gap[1:-1]
    three = np.flatnonzero(inside[:-2] & inside[1:-1] & inside[2:]) if len(codes) > 2 else np.zeros(0, np.int64)
    salt = np.uint64(int.from_bytes(hashlib.blake2b(seed.encode(), digest_size=8).digest(), "little"))
    out = np.zeros(len(texts) * dim)
    for begin, end in ((first, last), (three, three + 3)):
        g = v.mix(h(begin, end) ^ salt)
        place = (np.searchsorted(starts, begin, "right") - 1) * dim + (g % np.uint64(dim)).astype(np.int64)
        out += np.bincount(place, np.where(g >> np.uint64(63), 1.0, -1.0), len(out))
    rows = out.reshape(len(texts), dim)
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=rows, where=norm > 0)


#: White space, as code points.
_GAPS = np.fromiter((chr(i).isspace() for i in range(0x3002)), bool, 0x3002)


def embed(segments: DataFrame, seed: str = "select", dim: int = DIM, keep_text: bool = True) -> DataFrame:
    """segments with vector: hashed three-letter groups and words under random signs of the whole text, of unit length; of a text without
    words, zeros. Without keep_text the text ends here, so that what follows moves vectors only.

    A stand-in for an embedding model; use different seeds to select and to score. All columns pass through the one Arrow pass.
    """
    names = [c for c in segments.columns if c not in ("text", "vector")]
    kept = [*names, "text"] if keep_text else names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["" if t is None else t for t in b.column(len(names)).to_pylist()]
            rows = [vectors_of(part, seed, dim) for (part,) in v.chunks([texts], 0)]
            flat = np.concatenate(rows).ravel() if rows else np.zeros(0)
            vector = pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * dim, pa.array(flat))
            yield pa.record_batch([*(b.column(i) for i in range(len(kept))), vector], names=[*kept, "vector"])

    schema = StructType([*(segments.schema[c] for c in kept), StructField("vector", ArrayType(DoubleType()))])
    return segments.select(*names, "text").mapInArrow(run, schema)


def rank_for_energy(s: np.ndarray, share: float) -> int:
    """Number of leading singular values that carry share of the energy."""
    power = np.asarray(s, np.float64) ** 2
    if not power.size:
        return 0
    if power.sum() <= 0:
        return 1
    return int(min(np.searchsorted(np.cumsum(power) / power.sum(), share - 1e-12) + 1, power.size))


def spectral_from_gram(n: int, total: np.ndarray, gram: np.ndarray, energy: float = 0.95, drop_top: int = 0, ridge: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(mean, M) such that a row x of the matrix has the score |(x - mean) M|²: leverage within the directions that carry the energy, or
    ridge leverage with the given penalty. Only sums over rows go in: their number, total and Gram matrix."""
    mean = total / n
    values, vectors = np.linalg.eigh(gram - n * np.outer(mean, mean))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    s = np.sqrt(values[: min(n, len(values))])
    live = s > (s.max() if s.size else 0.0) * max(n, len(values)) * np.finfo(np.float64).eps ** 0.5
    if ridge is not None:
        weight = np.where(live, 1.0 / (s * s + ridge), 0.0) if ridge > 0 else np.where(live, 1.0 / np.where(live, s * s, 1.0), 0.0)
        k = int(live.sum())
    else:
        k = rank_for_energy(s, energy)
        weight = np.where(live & (np.arange(len(s)) < k), 1.0 / np.where(live, s * s, 1.0), 0.0)
    weight[: min(drop_top, max(k - 1, 0))] = 0.0
    return mean, vectors[:, : len(s)] * np.sqrt(weight)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, without Python numbers between."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(vectors), -1)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    """Arrays of any lengths as a list column, without Python numbers between."""
    flat = [np.asarray(r, np.float64).ravel() for r in rows]
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(r) for r in flat]))).astype(np.int32), pa.array(np.concatenate(flat) if flat else np.zeros(0)))


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, vector) to partial (g, n, total, root) of this task, where root'root is the Gram matrix of its rows of the group: the rows
    themselves while they are few, else as many as the vectors are long. Groups are sent on before they fill the task's memory."""
    sums: dict = {}
    kind, held = None, 0

    def made() -> pa.RecordBatch:
        roots = [np.concatenate(r) for _, _, r in sums.values()]
        roots = [np.linalg.qr(r, "r") if len(r) > r.shape[1] else r for r in roots]
        return pa.record_batch([pa.array(list(sums), kind), pa.array([x[0] for x in sums.values()], pa.int64()), _lists([x[1] for x in sums.values()]), _lists(roots)], names=["g", "n", "total", "root"])

    for b in batches:
        if not b.num_rows:
            continue
        kind = b.schema.field(0).type
        keys, x = b.column(0).dictionary_encode(), _matrix(b.column(1))
        code = keys.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
            rows = x[part]
            n, t, r = sums.get(k := keys.dictionary[code[part[0]]].as_py(), (0, 0.0, []))
            r.append(rows)
            if sum(map(len, r)) > 4 * x.shape[1]:
                r = [np.linalg.qr(np.concatenate(r), "r")]
            sums[k] = (n + len(rows), t + rows.sum(0), r)
        held += len(x)
        if held > 20_000 and len(sums) > 500:
            yield made()
            sums, held = {}, 0
    if sums:
        yield made()


def solved(segments: DataFrame, energy: float = 0.95, drop_top: int = 0, ridge: float | None = None, group: str = "conv_id") -> DataFrame:
    """(g, n, mean, w): of each group the number of rows and what spectral_from_gram gives, w by rows. Rows are reduced to what their Gram
    matrix needs within tasks before they are shuffled."""
    types = dict(segments.dtypes)
    part = segments.select(F.col(group).alias("g"), "vector").mapInArrow(_gram, f"g {types[group]}, n long, total array<double>, root array<double>")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for i, (g, n) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                t = b.column(2)[i].values.to_numpy()
                r = b.column(3)[i].values.to_numpy().reshape(-1, len(t))
                n0, t0, m0 = held.get(g, (0, 0.0, 0.0))
                held[g] = (n0 + n, t0 + t, m0 + r.T @ r)
        done = list(held.items())
        for at in range(0, len(done), 200):
            some = [(g, n, *spectral_from_gram(n, t, m, energy, drop_top, ridge)) for g, (n, t, m) in done[at : at + 200]]
            yield pa.record_batch([pa.array([x[0] for x in some], kind), pa.array([x[1] for x in some], pa.int64()), _lists([x[2] for x in some]), _lists([x[3].T for x in some])], names=["g", "n", "mean", "w"])

    return part.repartition("g").mapInArrow(solve, f"g {types[group]}, n long, mean array<double>, w array<double>")


def _beside(segments: DataFrame, solution: DataFrame, group: str, fn, out: str) -> DataFrame:
    """segments without vector and with column out: fn(n, mean, w, rows) of the rows of each group, which are streamed behind the group's
    solution, so that groups may be of any size and rows meet nothing in a join."""
    rest = [c for c in segments.columns if c not in ("vector", out)]
    held = StructType([segments.schema[c] for c in rest])
    none = lambda t: F.lit(None).cast(t)
    heads = solution.select("g", F.lit(0).alias("part"), F.col("mean").alias("x"), "n", "w", none(held).alias("row"))
    rows = segments.select(F.col(group).alias("g"), F.lit(1).alias("part"), F.col("vector").cast("array<double>").alias("x"), none("bigint").alias("n"), none("array<double>").alias("w"), F.struct(*rest).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, w = 0, None, None
        for b in batches:
            parts, xs = b.column(1).to_numpy(), _matrix(b.column(2))
            got = np.zeros(len(parts))
            heads_at = np.flatnonzero(parts == 0)
            for at, to in zip(np.concatenate(([0], heads_at)), np.concatenate((heads_at, [len(parts)])), strict=True):
                if at < len(parts) and parts[at] == 0:
                    n, mean = b.column(3)[at].as_py(), xs[at]
                    w = b.column(4)[at].values.to_numpy().reshape(-1, len(mean))
                    at += 1
                if at < to:
                    got[at:to] = fn(n, mean, w, xs[at:to])
            mine = pa.array(parts == 1)
            yield pa.record_batch([b.column(5).filter(mine), pa.array(got).filter(mine)], names=["row", out])

    streamed = heads.unionByName(rows).repartition("g").sortWithinPartitions("g", "part")
    return streamed.mapInArrow(run, StructType([StructField("row", held), StructField(out, DoubleType())])).select("row.*", out)


def _leverage(n: int, mean: np.ndarray, w: np.ndarray, x: np.ndarray) -> np.ndarray:
    y = (x - mean) @ w.T
    return np.ones(len(x)) if n == 1 else (y * y).sum(1)


def spectral(segments: DataFrame, energy: float = 0.95, drop_top: int = 0, ridge: float | None = None, group: str = "conv_id") -> DataFrame:
    """segments with score in place of vector: leverage of each row in the centred matrix of its group, within the directions that carry
    ``energy``, or ridge leverage. A group of one scores 1.

    Only Gram matrices are summed and solved (d x d for each group), and the rows are shuffled once to meet the solution of their group.
    """
    return _beside(segments, solved(segments, energy, drop_top, ridge, group), group, _leverage, "score")


def cur_order(z: np.ndarray, tol: float = 1e-9) -> tuple[list[int], np.ndarray]:
    """Rows by the size of what is left of them after those before are projected out, and these sizes."""
    a = np.array(z, np.float64)
    order, norms = [], []
    scale = float(np.sqrt((a * a).sum(1).max())) if a.size else 0.0
    for _ in range(min(a.shape) if a.size else 0):
        sq = (a * a).sum(1)
        sq[order] = -1.0
        i = int(sq.argmax())
        norm = float(np.sqrt(max(sq[i], 0.0)))
        if norm <= tol * (scale or 1.0):
            break
        q = a[i] / norm
        a -= np.outer(a @ q, q)
        a[i] = 0.0
        order.append(i)
        norms.append(norm)
    return order, np.asarray(norms)


def cur_scores(x: np.ndarray, energy: float = 0.95, drop_top: int = 0) -> np.ndarray:
    """Scores of rows by pivoted projection within the directions that carry the energy; the rest below them, by leverage."""
    n = len(x)
    if n <= 1:
        return np.ones(n)
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    k = rank_for_energy(s, energy)
    start = min(drop_top, max(k - 1, 0))
    order, norms = cur_order(u[:, start:k] * s[start:k])
    out = np.zeros(n)
    out[order] = norms
    rest = np.setdiff1d(np.arange(n), order)
    if len(rest):
        lev = (u[rest, start:k] ** 2).sum(1)
        out[rest] = 0.5 * (norms.min() if len(norms) else 1.0) * (lev / lev.max() if lev.max() > 0 else 0.0)
    return out


def cur_residual(segments: DataFrame, energy: float = 0.95, drop_top: int = 0) -> DataFrame:
    """segments with score in place of vector, by cur_scores. Each step depends on all rows of the conversation, so a conversation of any
    size is one run; a task holds its vectors (512 bytes a segment) and nothing else of it."""
    import pandas as pd

    types = dict(segments.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg_id")
        return pdf[["conv_id", "seg_id"]].assign(score=cur_scores(np.stack(pdf["vector"].to_numpy()), energy, drop_top))

    got = segments.select("conv_id", "seg_id", "vector").groupBy("conv_id").applyInPandas(run, f"conv_id {types['conv_id']}, seg_id {types['seg_id']}, score double")
    return segments.drop("vector").join(got, ["conv_id", "seg_id"])


def kind_space(segments: DataFrame, min_segments: int = 5, **options) -> DataFrame:
    """Leverage within each kind's own rows, scaled to mean 1; kinds of few segments by the whole conversation's, scaled likewise."""
    segments = cut(segments)
    shared = spectral(segments, **options)
    scaled = F.when(F.avg("score").over(Window.partitionBy("conv_id")) > 0, F.col("score") / F.avg("score").over(Window.partitionBy("conv_id"))).otherwise(0.0)
    shared = shared.select("conv_id", "seg_id", scaled.alias("shared"))
    keyed = segments.withColumn("ck", F.concat_ws("|", F.col("conv_id").cast("string"), "kind"))
    own = spectral(keyed, group="ck", **options)
    w = Window.partitionBy("ck")
    own = own.select("conv_id", "seg_id", F.when(F.avg("score").over(w) > 0, F.col("score") / F.avg("score").over(w)).otherwise(0.0).alias("own"), F.count("*").over(w).alias("n"))
    both = own.join(shared, ["conv_id", "seg_id"]).select("conv_id", "seg_id", F.when(F.col("n") >= min_segments, F.col("own")).otherwise(F.col("shared")).alias("score"))
    return segments.drop("vector").join(both, ["conv_id", "seg_id"])


def centred(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, centred): each vector less the mean of all, rounded to 6 places; the mean is one row."""
    means = vectors.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("mean"))
    return vectors.join(F.broadcast(mean)).select(id_col, F.zip_with(vector, "mean", lambda x, m: F.round(x.cast("double") - m, 6)).alias("centred"))
