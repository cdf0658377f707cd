"""Vocabulary, co-occurrence and positive pointwise mutual information, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import ranked

#: Words of the plain tokenizer: lower-case letters first, then letters, digits and underscores.
PLAIN = r"[a-z][a-z0-9_]+"


def tokens(text: Column, pattern: str = PLAIN) -> Column:
    """Lower-case tokens in order; escapes of line feeds and tabs in JSON texts are white space."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), r"(?<!\\)\\[ntr]", " "), F.lit(pattern), F.lit(0))


def path_tokens(text: Column) -> Column:
    """Like tokens, but paths and file names stay whole."""
    ext = "py|js|ts|tsx|jsx|json|md|txt|yml|yaml|toml|cs|rs|go|java|sql|sh|ps1|csv|ipynb|html|css|xml|cfg|ini|lock|pdf|png|jpg|jsonl"  # fixed values
    found = tokens(text, rf"(?U)(?:[a-z]:)?(?:[\w.-]+[\\/])+[\w.-]+|[\w-]+\.(?:{ext})\b|[a-z][a-z0-9_]+")
    return F.transform(found, lambda t: F.regexp_replace(t, r"[.,;:]+$", ""))


def vocabulary(docs: DataFrame, min_count: int = 2, by: str = "tokens") -> DataFrame:
    """(word, cnt, idx): words of min_count or more, idx from 0 by count descending, then word."""
    counts = docs.select(F.explode(by).alias("word")).groupBy("word").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= min_count)
    return ranked(counts, F.desc("cnt"), "word")


def kept_tokens(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", by: str = "tokens") -> DataFrame:
    """(id, tokens): each document's tokens without those outside the vocabulary, in order."""
    each = docs.select(id_col, F.posexplode(by).alias("pos", "word")).join(vocab.select("word"), "word")
    return each.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("tokens"))


def cooccurrence(docs: DataFrame, window: int = 2, dynamic: bool = True, by: str = "tokens") -> DataFrame:
    """(a, b, v): both ways, how often two tokens stand within the window, by 1/distance where dynamic.

    Pairs are made within each document's array and summed before the shuffle.
    """
    pair = lambda d: F.transform(F.slice(by, 1, F.greatest(F.size(by) - d, F.lit(0))), lambda x, i: F.struct(x.alias("a"), F.get(F.col(by), i + d).alias("b"), F.lit(1.0 / d if dynamic else 1.0).alias("v")))
    p = docs.select(F.explode(F.concat(*[pair(d) for d in range(1, window + 1)])).alias("p")).select("p.*")
    half = p.groupBy("a", "b").agg(F.sum("v").alias("v"))
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "v")).groupBy("a", "b").agg(F.sum("v").alias("v"))


def ppmi(cooc: DataFrame, cds: float = 0.75, shift: float = 1.0) -> DataFrame:
    """(a, b, v): the positive log of v * total / (row * column^cds), less the log of a shift above 1."""
    rows = cooc.groupBy("a").agg(F.sum("v").alias("r"))
    cols = cooc.groupBy("b").agg(F.pow(F.sum("v"), F.lit(cds)).alias("c"))
    total = cols.agg(F.sum("c").alias("t"))
    x = cooc.join(rows, "a").join(cols, "b").join(F.broadcast(total))
    value = F.log(F.col("v") * F.col("t") / (F.col("r") * F.col("c"))) - (F.log(F.lit(float(shift))) if shift > 1 else F.lit(0.0))
    return x.select("a", "b", value.alias("v")).where("v > 0")


def differential(front: DataFrame, back: DataFrame) -> DataFrame:
    """(a, b, v): what the front's cells have above the background's; cells the background lacks stay."""
    b = back.select("a", "b", F.col("v").alias("bv"))
    return front.join(b, ["a", "b"], "left").select("a", "b", (F.col("v") - F.coalesce("bv", F.lit(0.0))).alias("v")).where("v > 0")


def excluding(total: DataFrame, own: DataFrame) -> DataFrame:
    """Background counts without one's own."""
    o = own.select("a", "b", F.col("v").alias("ov"))
    return total.join(o, ["a", "b"], "left").select("a", "b", (F.col("v") - F.coalesce("ov", F.lit(0.0))).alias("v")).where("v > 1e-12")


def align(source: DataFrame, target: DataFrame) -> DataFrame:
    """(idx, target_idx): a vocabulary's places in another, -1 where it lacks the word."""
    t = target.select("word", F.col("idx").alias("t"))
    return source.join(t, "word", "left").select("idx", F.coalesce("t", F.lit(-1)).alias("target_idx"))


def ipr(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, ipr, participation): sum of fourth powers of the unit vector, and 1 / (ipr * n)."""
    sq = F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    four = F.aggregate(F.transform(vector, lambda x: F.pow(x.cast("double"), F.lit(4.0))), F.lit(0.0), lambda s, x: s + x)
    v = F.when(sq > 0, four / (sq * sq)).otherwise(0.0)
    return vectors.select(id_col, v.alias("ipr"), F.when(v > 0, 1.0 / (v * F.size(vector))).alias("participation"))
