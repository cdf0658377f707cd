"""The compression pipeline as one plan, its rates, and the registry of methods that can be swept.

Order is fixed: segment, supersede, band, substitute paths, score, select. The budget comes from the original segments.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import banding, metrics, pathtable, scoring, selecting
from tessera.operators import budget as bud
from tessera.operators import segmenting as seg
from tessera.operators import supersede as sup
from tessera.runtime import cut

#: Parts of the tokens that the levels keep (fixed values), and the bounds of any part.
LEVELS = {"light": 0.50, "medium": 0.33, "heavy": 0.25}
KEEP_MIN, KEEP_MAX = 0.10, 0.80


@dataclass(frozen=True)
class Rate:
    keep: float
    source: str
    clamped: bool = False


def resolve_rate(keep: float | None = None, target_tokens: int | None = None, level: str | None = None, total: int | None = None) -> Rate:
    """keep goes before a target, a target before a level, and medium holds without any; targets are clamped to the bounds."""
    if keep is not None:
        if not 0.0 < keep <= 1.0:
            raise ValueError("keep must be in (0, 1]")
        return Rate(keep, "keep")
    if target_tokens is not None:
        if target_tokens < 1 or not total:
            raise ValueError("a target needs a positive number and the tokens there are")
        want = target_tokens / total
        held = min(max(want, KEEP_MIN), KEEP_MAX)
        return Rate(held, "target", held != want)
    return Rate(LEVELS[level or "medium"], "level")


@dataclass(frozen=True)
class Options:
    """keep: part of the tokens; novelty: discount of repeated words (None: plain leverage); band: quality of code lines (None: verbatim);
    paths: mentions from which a path is tabulated (None: no table); protect: what is kept whatever it costs."""

    keep: float = LEVELS["medium"]
    novelty: float | None = 0.5
    per_token: bool = True
    band: float | None = None
    paths: int | None = None
    protect: str = "none"


def selector_label(o: Options) -> str:
    parts = ["supersede", *(["band"] if o.band is not None else []), *(["paths"] if o.paths is not None else []), "leverage"]
    return "+".join(parts) + (f" novelty {o.novelty:g}" if o.novelty and o.band is None and o.paths is None else "")


def compress_segments(original: DataFrame, o: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(kept, header): kept segments with their emitted text; header conv_id, budget, total_tokens, kept_tokens, table_tokens, ratio, recalls."""
    original = cut(original)
    budgets = bud.token_budget(original, o.keep)
    pool = sup.apply_supersession(original)
    table = None
    if o.band is not None:
        pool = banding.quantize(pool, o.band)
    if o.paths is not None:
        table = cut(pathtable.table(original, o.paths))
        text = pathtable.substitute(pool, table).withColumnRenamed("text", "new")
        pool = pool.join(text, ["conv_id", "seg_id"]).withColumn("text", F.coalesce("new", "text")).drop("new")
        pool = pool.withColumn("tokens", banding.tx.token_count(F.col("text")))
        spent = pathtable.rendered(table).select("conv_id", F.col("tokens").alias("table_tokens"))
        budgets = budgets.join(spent, "conv_id", "left").withColumn("budget", F.greatest(F.lit(0), F.col("budget") - F.coalesce("table_tokens", F.lit(0)))).drop("table_tokens")
    scored = cut(scoring.spectral(cut(scoring.embed(pool))))
    plain = o.novelty is None or o.band is not None or o.paths is not None
    kept = cut(bud.select_with_budget(scored, budgets, o.protect) if plain else selecting.novelty_select(scored, budgets, o.novelty, o.protect, o.per_token))
    handed = pathtable.guaranteed(table) if table is not None else None
    header = metrics.evaluate(original, kept, handed).join(budgets.select("conv_id", "budget"), "conv_id")
    return kept, header.withColumn("method", F.lit(selector_label(o)))


def compress(turns: DataFrame, o: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """compress_segments from transcripts (conv_id, turn, role, blocks)."""
    return compress_segments(seg.segment(turns), o)


Method = Callable[[DataFrame, DataFrame], DataFrame]


def _fill(score: Callable[[DataFrame], DataFrame], superseded: bool = False, band: float | None = None) -> Method:
    def run(original: DataFrame, budgets: DataFrame) -> DataFrame:
        pool = sup.apply_supersession(original) if superseded else original
        if band is not None:
            pool = banding.quantize(pool, band)
        return bud.select_with_budget(score(pool), budgets)

    return run


def _leverage(pool: DataFrame) -> DataFrame:
    return scoring.spectral(cut(scoring.embed(pool)))


def _novelty(alpha: float, per_token: bool) -> Method:
    return lambda original, budgets: selecting.novelty_select(_leverage(sup.apply_supersession(original)), budgets, alpha, "none", per_token)


def _normed(kind: str) -> Method:
    return _fill(lambda s: scoring.kind_norm(_leverage(s), kind), True)


#: Methods by name: (original segments, budgets) to the kept ones.
METHODS: dict[str, Method] = {
    "random": _fill(scoring.random_scores),
    "recency": _fill(scoring.recency),
    "tfidf": _fill(scoring.tfidf),
    "leverage": _fill(_leverage),
    "ridge": _fill(lambda s: scoring.spectral(cut(scoring.embed(s)), ridge=1.0)),
    "cur_residual": _fill(lambda s: scoring.cur_residual(cut(scoring.embed(s)))),
    "supersede+tfidf": _fill(scoring.tfidf, True),
    "supersede+leverage": _fill(_leverage, True),
    "band+leverage": _fill(_leverage, band=0.33),
    "supersede+band+leverage": _fill(_leverage, True, 0.33),
    "kind_space": _fill(lambda s: scoring.kind_space(cut(scoring.embed(s))), True),
    "kind_rank": _normed("rank"),
    "kind_z": _normed("z"),
    "kind_budget": lambda original, budgets: bud.kind_budget_select(_leverage(sup.apply_supersession(original)), budgets),
    "novelty": _novelty(0.5, False),
    "novelty per token": _novelty(0.5, True),
    "zlib": lambda original, budgets: selecting.codec_select(original, budgets),
    "supersede+zlib": lambda original, budgets: selecting.codec_select(sup.apply_supersession(original), budgets),
}


def sweep(original: DataFrame, methods: tuple[str, ...], keeps: tuple[float, ...]) -> DataFrame:
    """(method, keep, metrics by conversation) of each method at each rate."""
    original = cut(original)
    gone = cut(sup.find_superseded(original))
    out = None
    for name in methods:
        for keep in keeps:
            kept = METHODS[name](original, bud.token_budget(original, keep))
            rows = metrics.evaluate(original, kept, superseded=gone).select(F.lit(name).alias("method"), F.lit(keep).alias("keep"), "*")
            out = rows if out is None else out.unionByName(rows)
    return out
