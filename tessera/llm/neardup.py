"""Problem 1: near-duplicate records by rare-first prefix filtering.

Each record is the set of its runs of three words. Sets with equal members form one class. Classes are joined on the rarest members of
their sets, and pruned by length, position and suffix before a pair is verified once on its whole sets.

Frequent members, such as those of a template that a third of all records share, come last in that order, and a record is not posted
under them unless they alone could make it similar to another; so a template without a near duplicate pairs nothing.

The order "rare first" is that of a table of hashed counts over all records, of BUCKETS to MOST_BUCKETS places by the number of records: any
order common to all records gives right results, and this one costs a bounded amount of memory at any size of the corpus. By the same
counts a member that many records post is split: its larger sides lie in parts, and each smaller side visits all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import vectext as v
from tessera.llm.classes import expand
from tessera.runtime import cut, small_side

BUCKETS, MOST_BUCKETS = 1 << 20, 1 << 24
_BLOCK = 1 << 12
#: Records under a member from which on its postings are split into parts of about so many.
HEAVY = 4096
#: A member is frequent where its bucket's count is above this and four times the mean.
OFTEN = 64
SHINGLE = 3
THRESHOLD = 0.7
MIN_WORDS = 25


def _salts(tools: list) -> np.ndarray:
    """A hash for each tool name; null has one of its own."""
    codes, starts, ends = v.codes_of(["" if t is None else t for t in tools])
    null = np.fromiter((t is None for t in tools), bool, len(tools))
    return v.mix(v.RangeHash(codes)(starts, ends) ^ np.where(null, np.uint64(0x5BD1E995), np.uint64(1)))


def _sets(tools: list, texts: list[str], shingle: int, min_words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number and sorted distinct shingle hashes of each text with words enough; the tool name is part of each hash."""
    words, offsets = v.words_of(texts)
    grams, at = v.ngrams(words, offsets, shingle)
    n_words, salts = np.diff(offsets), _salts(tools)
    for i in np.flatnonzero(n_words >= max(min_words, shingle)):
        yield i, np.unique(v.mix(grams[at[i] : at[i + 1]] ^ salts[i]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    for b in batches:
        yield from v.chunks([c.to_pylist() for c in b.columns], 2)


def _place(s: np.ndarray, buckets: int) -> np.ndarray:
    return (s & np.uint64(buckets - 1)).astype(np.int64)


def _counts(shingle: int, min_words: int, buckets: int):
    """(id, tool, text) to (block, counts): for this task, the number of sets with a member in each bucket, in blocks of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, tools, texts in _rows(batches):
            sets = [s for _, s in _sets(tools, texts, shingle, min_words)]
            if sets:
                at, n = np.unique(_place(np.concatenate(sets), buckets), return_counts=True)
                total[at] += n
        if total.any():
            yield _blocks(total)

    return run


def _blocks(total: np.ndarray) -> pa.RecordBatch:
    """Counts as one row for each block, each as narrow as its largest count allows."""
    rows = total.reshape(-1, _BLOCK)
    kinds = [next(t for t in (np.uint8, np.uint16, np.int64) if r.max() <= np.iinfo(t).max) for r in rows]
    return pa.record_batch([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array([r.astype(t).tobytes() for r, t in zip(rows, kinds, strict=True)], pa.binary())], names=["block", "counts"])


def _read_block(counts: bytes) -> np.ndarray:
    return np.frombuffer(counts, {_BLOCK: np.uint8, 2 * _BLOCK: np.uint16, 8 * _BLOCK: np.int64}[len(counts)]).astype(np.int64)


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts by block, one row at a time."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for block, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            sums[block] = sums.get(block, 0) + _read_block(counts)
    yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.astype(np.int64).tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"])


def _prefixes(shingle: int, min_words: int, threshold: float, order: np.ndarray, heavy: int = HEAVY):
    """(id, tool, text) to (id, sig, size, bits, solid, prefix, parts): the class, the size of the set, its parity bitmap, its rarest members in
    order, under how many of them it is looked up by larger sets (under all by smaller ones), and into how many parts the postings of each
    are split; null where none is.

    A class that this task has met before comes without its prefix, so that copies cost one narrow row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, met = np.uint64(1), set()
        often = OFTEN + 4.0 * float(order.mean(dtype=np.float64))
        for ids, tools, texts in _rows(batches):
            out: list[list] = [[], [], [], [], [], [], []]
            for i, s in _sets(tools, texts, shingle, min_words):
                counts = order[_place(s, len(order))]
                rank = np.lexsort((s, counts))
                bits = np.bitwise_xor.reduce(one << (s >> np.uint64(58)))
                sig = v.mix(np.bitwise_xor.reduce(v.mix(s)) + v.mix(np.sum(s, keepdims=True)) + np.uint64(len(s)))
                need = ceil(threshold * len(s) - 1e-9)
                keep = len(s) - need + 1
                # frequent members stand last. Where they are fewer than a partner must share, it shares a rarer one too, by which it is
                # found: a partner that is no larger shares need or more, one that is no smaller 2t/(1+t) of the size or more
                rarer = len(s) - int((counts > often).sum())
                keep = min(keep, rarer) if len(s) - rarer < need else keep
                solid = min(keep, rarer) if len(s) - rarer < ceil(2 * threshold / (1 + threshold) * len(s) - 1e-9) else keep
                name = int(sig.view(np.int64)[0])
                parts = -(-counts[rank[:keep]] // heavy)
                new = name not in met
                for o, x in zip(out, (ids[i], name, len(s), bits.view(np.int64), solid, s[rank[:keep]].view(np.int64) if new else None, parts if new and (parts > 1).any() else None), strict=True):
                    o.append(x)
                met.add(name)
            yield pa.record_batch(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.list_(pa.int64())), pa.array(out[6], pa.list_(pa.int32()))],
                names=["id", "sig", "size", "bits", "solid", "prefix", "parts"],
            )

    return run


def _verify(shingle: int, threshold: float):
    """(a, b, tool, text_a, text_b) to the pairs whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for a, b, tool, x, y in v.chunks(cols, 3):
                sa = {int(i): s for i, s in _sets(tool, x, shingle, 0)}
                sb = {int(i): s for i, s in _sets(tool, y, shingle, 0)}
                found, share = [], []
                for i in range(len(a)):
                    if i in sa and i in sb:
                        both = len(np.intersect1d(sa[i], sb[i], assume_unique=True))
                        of = len(sa[i]) + len(sb[i]) - both
                        if both >= threshold * of - 1e-9:
                            found.append(i)
                            share.append(both / of)
                yield pa.record_batch([pa.array([a[i] for i in found], pa.int64()), pa.array([b[i] for i in found], pa.int64()), pa.array(share, pa.float64())], names=["a", "b", "similarity"])

    return run


def _buckets(records: int) -> int:
    """A power of two of about twice the records, within bounds."""
    return min(max(1 << (2 * max(records, 1) - 1).bit_length(), BUCKETS), MOST_BUCKETS)


def _order(base: DataFrame, shingle: int, min_words: int, buckets: int = BUCKETS) -> np.ndarray:
    """Counts by bucket over all records, summed in the cluster; at the driver 8 bytes a bucket."""
    counts = base.mapInArrow(_counts(shingle, min_words, buckets), "block int, counts binary").repartition("block").mapInArrow(_sum_blocks, "block int, counts binary")
    order = np.zeros(buckets, np.int64)
    for r in counts.collect():
        order[r.block * _BLOCK : (r.block + 1) * _BLOCK] = _read_block(bytes(r.counts))
    return np.minimum(order, np.iinfo(np.int32).max).astype(np.int32)


def similar_classes(
    records: DataFrame, id_col: str = "seg_uid", tool_col: str = "tool_name", text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, min_words: int = MIN_WORDS,
    heavy: int = HEAVY,
) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, rep) name for each record with words enough the smallest id with the same set; links (a, b,
    similarity), a < b, are the pairs of such representatives with equal tool_name (null equals null) and similarity of threshold or more.

    Null texts and ids and records under min_words words are in neither. Repeated ids count once. Empty tables give empty results.
    """
    base = records.select(F.col(id_col).cast("long").alias("id"), F.col(tool_col).cast("string").alias("tool"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    spark = base.sparkSession
    order = spark.sparkContext.broadcast(_order(base, shingle, min_words, _buckets(records.count())))
    body = _prefixes_from(shingle, min_words, threshold, order, heavy)
    sets = cut(base.mapInArrow(body, "id long, sig long, size int, bits long, solid int, prefix array<long>, parts array<int>"))
    members = sets.select("id", "sig").distinct().join(sets.groupBy("sig").agg(F.min("id").alias("rep")), "sig")
    # one row for each class and member of its prefix; a class has one set, so any of its rows will do
    each = sets.where("prefix is not null").select(F.posexplode("prefix").alias("pos", "gram"), F.col("sig").alias("c"), "size", "solid", "parts")
    at = F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.col("pos").cast("long") * 2 + (F.col("pos") < F.col("solid")).cast("long"))
    of = F.coalesce(F.get("parts", F.col("pos")), F.lit(1))
    solid = F.col("at").bitwiseAND(F.lit(1)) == 1  # the smaller of two sets is looked up here
    posts = each.where(of == 1).select("gram", "c", at.alias("at")).repartition("gram").dropDuplicates(["gram", "c"])
    # a member that many post is split: larger sets lie in parts, smaller ones are sent to each
    many = each.where(of > 1).select("gram", "c", at.alias("at"), of.alias("of")).dropDuplicates(["gram", "c"])
    lying = many.select("gram", F.pmod(F.xxhash64("c"), F.col("of")).cast("int").alias("p"), "c", "at")
    sent = many.where(solid).select("gram", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("p"), "c", "at")
    size = lambda t: F.shiftright(F.col(f"{t}.at"), 32)
    pos = lambda t: F.shiftright(F.col(f"{t}.at").bitwiseAND(F.lit(0xFFFFFFFF)), 1)
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (size("x") + size("y")) - 1e-9)
    left = F.least(size("x") - pos("x"), size("y") - pos("y"))
    sides = [F.struct("x.c", "x.at").alias("x"), F.struct("y.c", "y.at").alias("y")]
    light = posts.where(solid).alias("x").join(posts.alias("y"), "gram").select(*sides)
    split = sent.alias("x").join(lying.alias("y"), ["gram", "p"]).select(*sides)
    met = (
        light.unionByName(split)
        .where((size("x") < size("y")) | ((size("x") == size("y")) & (F.col("x.c") < F.col("y.c"))))
        .where(size("x") >= threshold * size("y") - 1e-9)
        .groupBy(F.col("x.c").alias("ca"), F.col("y.c").alias("cb"))
        .agg(F.count("*").alias("met"), F.max(left).alias("left"), F.min(left).alias("least_left"), F.first(need).alias("need"), F.first(size("x") + size("y")).alias("sum"))
        # at the first common member all that is left may agree; after the last one only what is left behind it
        .where((F.col("left") >= F.col("need")) & (F.col("met") + F.col("least_left") - 1 >= F.col("need")))
    )
    pairs = cut(met.select("ca", "cb", "need", "sum"))
    wanted = pairs.select(F.explode(F.array("ca", "cb")).alias("sig")).distinct()
    reps = cut(sets.join(small_side(cut(wanted)), "sig", "left_semi").groupBy("sig").agg(F.min(F.struct("id", "bits")).alias("r")).select("sig", "r.id", "r.bits"))
    side = lambda n: reps.select(F.col("sig").alias(f"c{n}"), F.col("id").alias(n), F.col("bits").alias(f"b{n}"))
    # suffix filter: a partition of odd size against one of even size differs by one member at least
    near = pairs.join(side("a"), "ca").join(side("b"), "cb").where(F.col("sum") - F.bit_count(F.col("ba").bitwiseXOR(F.col("bb"))) >= 2 * F.col("need")).select("a", "b")
    near = cut(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    ids = small_side(cut(near.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    texts = base.join(ids, "id", "left_semi").dropDuplicates(["id"])
    both = near.join(texts.select(F.col("id").alias("a"), "tool", F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    links = cut(both.select("a", "b", "tool", "ta", "tb").mapInArrow(_verify(shingle, threshold), "a long, b long, similarity double"))
    members = members.select("id", "rep")
    return members, links


def _prefixes_from(shingle: int, min_words: int, threshold: float, order, heavy: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _prefixes(shingle, min_words, threshold, order.value, heavy)(batches)

    return run


def similar_pairs(records: DataFrame, id_col: str = "seg_uid", **options) -> DataFrame:
    """Pairs (id_a < id_b) of records that similar_classes links, and of records with the same set, in classes of every size."""
    members, links = similar_classes(records, id_col, **options)
    return expand(members, links).select(F.col("a").alias(f"{id_col}_a"), F.col("b").alias(f"{id_col}_b"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable over edges (a, b) from each of nodes (id).

    Min-label hooking with pointer jumping: each round takes the least label among neighbours, then the label of that label, so that
    chains shorten by half; labels are cut each round and the rounds end when none changes.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")).select(F.col("a").alias("id"), "l"))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "l"), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("m"))
        hooked = label.join(near, "id").select("id", "l", F.least("l", "m").alias("m"))
        jumped = cut(hooked.alias("x").join(label.select(F.col("id").alias("k"), F.col("l").alias("kl")), F.col("m") == F.col("k"), "left").select("id", "l", F.least("m", "kl").alias("m")))
        changed = jumped.where("l <> m").limit(1).count()
        label = jumped.select("id", F.col("m").alias("l"))
        if not changed:
            break
    return nodes.select("id").join(label, "id", "left").select("id", F.coalesce("l", "id").alias("root"))


def similar_groups(records: DataFrame, id_col: str = "seg_uid", **options) -> DataFrame:
    """One row for each record with words enough: id, class_id (smallest id with the same set), group_id (smallest id over any chain of
    links), n_links (classes linked to its own), n_copies (records of its class)."""
    members, links = similar_classes(records, id_col, **options)
    members = cut(members)
    reps = members.groupBy("rep").agg(F.count("*").alias("n_copies")).withColumnRenamed("rep", "id")
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    info = reps.join(components(reps, links), "id").join(degree, "id", "left").select(F.col("id").alias("rep"), "root", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return members.join(info, "rep").select(F.col("id").alias(id_col), F.col("rep").alias("class_id"), F.col("root").alias("group_id"), "n_links", "n_copies")
