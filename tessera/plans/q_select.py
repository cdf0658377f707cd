"""Queries of supersession, scores and selection under a budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import budget as bud
from tessera.operators import scoring, selecting, supersede
from tessera.plans.common import SQL_SEG, SQL_SUPERSEDE, Registry, segs, sql_greedy, terms, vectors
from tessera.runtime import cut

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query(f"WITH {SQL_SUPERSEDE} SELECT conv_id, seg_id, path, op FROM ops WHERE op IS NOT NULL")
def file_operations(spark, sf_dir):
    return supersede.file_op(segs(spark, sf_dir)).where("op is not null").select("conv_id", "seg_id", "path", "op")


@query(f"WITH {SQL_SUPERSEDE} SELECT conv_id, result_id, call_id FROM owner")
def attribute_results(spark, sf_dir):
    return supersede.attribute_results(segs(spark, sf_dir))


@query(f"WITH {SQL_SUPERSEDE} SELECT conv_id, seg_id, reason, by_id FROM gone")
def supersede_find(spark, sf_dir):
    return supersede.find_superseded(segs(spark, sf_dir))


@query(f"WITH {SQL_SUPERSEDE} SELECT conv_id, seg_id, kind, tokens FROM final")
def supersede_apply(spark, sf_dir):
    return supersede.apply_supersession(segs(spark, sf_dir)).select("conv_id", "seg_id", "kind", "tokens")


@query(
    f"""WITH {SQL_SUPERSEDE} SELECT coalesce(reason, 'ALL') AS reason, count(*) AS n_segments, sum(tokens) AS tokens, round(sum(tokens) / (SELECT sum(tokens) FROM seg), 6) AS part
    FROM gone JOIN seg USING (conv_id, seg_id) GROUP BY ROLLUP (reason) HAVING count(*) > 0"""
)
def supersede_by_reason(spark, sf_dir):
    return supersede.by_reason(segs(spark, sf_dir))


@query(f"WITH {SQL_SEG} SELECT conv_id, sum(tokens) AS total, CAST(ceil(sum(tokens) * 0.33::DOUBLE) AS BIGINT) AS budget FROM seg GROUP BY conv_id")
def token_budgets(spark, sf_dir):
    return bud.token_budget(segs(spark, sf_dir), 0.33)


_TFIDF = r"""tf AS (SELECT conv_id, seg_id, term, count(*) AS tf FROM (SELECT conv_id, seg_id, unnest(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_./-]+|[0-9]+')) AS term FROM {src}) GROUP BY ALL),
n AS (SELECT conv_id, count(*) AS n FROM {src} GROUP BY conv_id),
df AS (SELECT conv_id, term, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT conv_id, seg_id, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (conv_id, term) JOIN n USING (conv_id)),
scored AS (SELECT s.*, coalesce(x.score, 0) AS score FROM {src} s LEFT JOIN (SELECT conv_id, seg_id, round(sum(w) / sqrt(sum(w * w)) / count(*), 9) AS score FROM w GROUP BY ALL) x USING (conv_id, seg_id))"""


@query(f"WITH {SQL_SEG}, {_TFIDF.format(src='seg')} SELECT conv_id, seg_id, round(score, 6) AS score FROM scored")
def tfidf_scores(spark, sf_dir):
    return scoring.tfidf(segs(spark, sf_dir)).select("conv_id", "seg_id", F.round("score", 6).alias("score"))


_BUDGET = "SELECT conv_id, CAST(ceil(sum(tokens) * {keep}::DOUBLE) AS BIGINT) AS budget FROM seg GROUP BY conv_id"


@query(f"WITH {SQL_SEG} {sql_greedy('SELECT conv_id, seg_id, seg_id::DOUBLE AS score, tokens, protected AS forced FROM seg', _BUDGET.format(keep=0.5))}")
def greedy_recency_protected(spark, sf_dir):
    """The newest segments that fit half the budget, protected ones first."""
    s = scoring.recency(segs(spark, sf_dir))
    return bud.greedy_fill(s, bud.token_budget(s, 0.5), must=bud.forced("all"))


@query(f"WITH {SQL_SUPERSEDE}, {_TFIDF.format(src='final')} {sql_greedy('SELECT conv_id, seg_id, score, tokens, false AS forced FROM scored', _BUDGET.format(keep=0.33))}")
def compress_tfidf(spark, sf_dir):
    """The flagship: supersession, tf-idf scores, and a greedy fill of a third of the original tokens."""
    s = cut(terms(spark, sf_dir))
    kept = scoring.tfidf(cut(supersede.apply_supersession(s).select("conv_id", "seg_id", "tokens", "terms")))
    return bud.greedy_fill(kept, bud.token_budget(s, 0.33))


@query(
    f"""WITH {SQL_SEG}, {_TFIDF.format(src="seg")}, b AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, row_number() OVER (PARTITION BY conv_id ORDER BY seg_id) - 1 AS pos, count(*) OVER w AS n FROM scored WINDOW w AS (PARTITION BY conv_id))
    SELECT conv_id, seg_id, round(0.75 * (CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END) + 0.25 * (pos / greatest(n - 1, 1)), 6) AS score FROM b"""
)
def recency_blend(spark, sf_dir):
    return bud.blended(scoring.tfidf(segs(spark, sf_dir)), 0.25).select("conv_id", "seg_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {SQL_SEG}, k AS (SELECT conv_id, kind, sum(tokens) AS t, count(*) AS n FROM seg GROUP BY ALL), b AS ({_BUDGET.format(keep=0.33)})
    SELECT conv_id, kind, CAST(floor(budget::DOUBLE * t / total) AS BIGINT) AS budget FROM (SELECT *, sum(t) OVER (PARTITION BY conv_id) AS total FROM k) JOIN b USING (conv_id) WHERE n >= 5 AND t > 0 AND budget > 0"""
)
def kind_budget_shares(spark, sf_dir):
    s = segs(spark, sf_dir)
    return bud.kind_shares(s, bud.token_budget(s, 0.33))


_SHARES = f"""b AS ({_BUDGET.format(keep=0.33)}), k AS (SELECT conv_id, kind, sum(tokens) AS t, count(*) AS n FROM seg GROUP BY ALL),
    shares AS (SELECT conv_id, kind, CAST(floor(budget::DOUBLE * t / total) AS BIGINT) AS budget FROM (SELECT *, sum(t) OVER (PARTITION BY conv_id) AS total FROM k) JOIN b USING (conv_id) WHERE n >= 5 AND t > 0 AND budget > 0)"""


def _sql_two_fills(part: str, budgets: str) -> str:
    """A fill for each part of a conversation within its own budget, then one of what is left over all parts. budgets: (conv_id, part, budget)
    as a table; whole: (conv_id, budget)."""
    first = sql_greedy(f"SELECT conv_id || '|' || {part} AS conv_id, seg_id, score, tokens, false AS forced FROM scored", f"SELECT conv_id || '|' || {part} AS conv_id, budget FROM {budgets}")
    second = sql_greedy("SELECT conv_id, seg_id, score, tokens, false AS forced FROM scored s WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.conv_id = s.conv_id AND o.seg_id = s.seg_id)", "SELECT * FROM rest")
    return f"""one AS (SELECT CAST(split_part(conv_id, '|', 1) AS BIGINT) AS conv_id, seg_id FROM ({first})),
    rest AS (SELECT w.conv_id, (w.budget - coalesce(s.spent, 0))::BIGINT AS budget FROM whole w LEFT JOIN (SELECT conv_id, sum(tokens) AS spent FROM scored JOIN one USING (conv_id, seg_id) GROUP BY conv_id) s USING (conv_id))
    SELECT * FROM one UNION ALL {second}"""


@query(f"WITH {SQL_SEG}, {_TFIDF.format(src='seg')}, {_SHARES}, whole AS (SELECT * FROM b), {_sql_two_fills('kind', 'shares')}")
def kind_budget_select(spark, sf_dir):
    s = cut(scoring.tfidf(cut(segs(spark, sf_dir))))
    return bud.kind_budget_select(s, bud.token_budget(s, 0.33)).select("conv_id", "seg_id")


_NORM = """{base} SELECT conv_id, seg_id, round(CASE WHEN kn >= 5 THEN {k} ELSE {c} END, 6) AS score FROM (
    SELECT *, count(*) OVER (PARTITION BY conv_id, kind) AS kn, count(*) OVER (PARTITION BY conv_id) AS cn,
        rank() OVER (PARTITION BY conv_id, kind ORDER BY score) AS kr, count(*) OVER (PARTITION BY conv_id, kind, score) AS kt, rank() OVER (PARTITION BY conv_id ORDER BY score) AS cr, count(*) OVER (PARTITION BY conv_id, score) AS ct,
        avg(score) OVER (PARTITION BY conv_id, kind) AS km, stddev_pop(score) OVER (PARTITION BY conv_id, kind) AS ks, avg(score) OVER (PARTITION BY conv_id) AS cm, stddev_pop(score) OVER (PARTITION BY conv_id) AS cs FROM scored)"""
_BASE = f"WITH {SQL_SEG}, scored AS (SELECT *, tokens::DOUBLE AS score FROM seg)"


@query(_NORM.format(base=_BASE, k="CASE WHEN kn > 1 THEN (kr + (kt - 1) / 2.0 - 1) / (kn - 1) ELSE 0.5 END", c="CASE WHEN cn > 1 THEN (cr + (ct - 1) / 2.0 - 1) / (cn - 1) ELSE 0.5 END"))
def kind_norm_rank(spark, sf_dir):
    s = segs(spark, sf_dir).withColumn("score", F.col("tokens").cast("double"))
    return scoring.kind_norm(s, "rank").select("conv_id", "seg_id", F.round("score", 6).alias("score"))


@query(_NORM.format(base=_BASE, k="CASE WHEN ks > 0 THEN (score - km) / ks ELSE 0 END", c="CASE WHEN cs > 0 THEN (score - cm) / cs ELSE 0 END"))
def kind_norm_z(spark, sf_dir):
    s = segs(spark, sf_dir).withColumn("score", F.col("tokens").cast("double"))
    return scoring.kind_norm(s, "z").select("conv_id", "seg_id", F.round("score", 6).alias("score"))


_CHUNKS = """SELECT conv_id, unnest(r.k) AS p FROM (SELECT conv_id, list_reduce(list_prepend({'u': 0::BIGINT, 'c': -1, 'k': []::STRUCT(i INTEGER, c INTEGER)[]}, l), lambda a, x:
    CASE WHEN a.c >= 0 AND a.u + x.u <= 4000 THEN {'u': a.u + x.u, 'c': a.c, 'k': list_append(a.k, {'i': x.k[1].i, 'c': a.c})} ELSE {'u': x.u, 'c': a.c + 1, 'k': list_append(a.k, {'i': x.k[1].i, 'c': a.c + 1})} END) AS r
    FROM (SELECT conv_id, list({'u': tokens::BIGINT, 'c': 0, 'k': [{'i': seg_id::INTEGER, 'c': 0}]} ORDER BY seg_id) AS l FROM seg GROUP BY conv_id))"""


@query(f"WITH {SQL_SEG} SELECT conv_id, p.i AS seg_id, p.c AS chunk FROM ({_CHUNKS})")
def split_chunks(spark, sf_dir):
    return bud.split_chunks(segs(spark, sf_dir))


@query(
    f"""WITH {SQL_SEG}, {_TFIDF.format(src="seg").replace("scored AS", "plain AS")}, ch AS (SELECT conv_id, p.i AS seg_id, p.c AS chunk FROM ({_CHUNKS})),
    scored AS (SELECT plain.*, chunk FROM plain JOIN ch USING (conv_id, seg_id)),
    upto AS (SELECT conv_id, chunk, CAST(round(sum(t) OVER (PARTITION BY conv_id ORDER BY chunk) * 0.33::DOUBLE) AS BIGINT) AS upto FROM (SELECT conv_id, chunk, sum(tokens) AS t FROM scored GROUP BY ALL)),
    shares AS (SELECT conv_id, chunk, upto - coalesce(lag(upto) OVER (PARTITION BY conv_id ORDER BY chunk), 0) AS budget FROM upto), whole AS (SELECT conv_id, sum(budget)::BIGINT AS budget FROM shares GROUP BY conv_id),
    {_sql_two_fills("chunk", "shares")}"""
)
def chunked_select(spark, sf_dir):
    return bud.chunked_select(cut(scoring.tfidf(cut(segs(spark, sf_dir)))), 0.33).select("conv_id", "seg_id")


def _vectors(spark, sf_dir, *more):
    """Keys and vectors only, written once."""
    return cut(vectors(spark, sf_dir).select("conv_id", "seg_id", *more, "vector"))


@query()
def leverage_scores(spark, sf_dir):
    return scoring.spectral(_vectors(spark, sf_dir)).select("conv_id", "seg_id", F.round("score", 6).alias("score"))


@query()
def ridge_scores(spark, sf_dir):
    return scoring.spectral(_vectors(spark, sf_dir), ridge=1.0).select("conv_id", "seg_id", F.round("score", 6).alias("score"))


@query()
def cur_residual_scores(spark, sf_dir):
    return scoring.cur_residual(_vectors(spark, sf_dir)).select("conv_id", "seg_id", F.round("score", 6).alias("score"))


@query()
def kind_space_scores(spark, sf_dir):
    return scoring.kind_space(_vectors(spark, sf_dir, "kind")).select("conv_id", "seg_id", F.round("score", 6).alias("score"))


@query()
def novelty_select(spark, sf_dir):
    """The default selector: supersession, leverage, novelty per token."""
    s = cut(vectors(spark, sf_dir))
    pool = supersede.apply_supersession(s).select("conv_id", "seg_id", "kind", "protected", "tokens", "words", "vector")
    return selecting.novelty_select(scoring.spectral(cut(pool)), bud.token_budget(s, 0.33), 0.5, per_token=True).select("conv_id", "seg_id")


@query()
def codec_select(spark, sf_dir):
    s = segs(spark, sf_dir)
    return selecting.codec_select(s, bud.token_budget(s, 0.33)).select("conv_id", "seg_id")


@query(
    rf"""WITH {SQL_SEG}, w AS (SELECT conv_id, seg_id, unnest(list_distinct(regexp_extract_all(lower(text), '\p{{L}}{{3,}}'))) AS word FROM seg),
    n AS (SELECT conv_id, count(*) AS n FROM seg GROUP BY conv_id), df AS (SELECT conv_id, word, count(*) AS df FROM w GROUP BY ALL)
    SELECT conv_id, seg_id, count(*) AS n_words FROM w JOIN df USING (conv_id, word) JOIN n USING (conv_id) WHERE df <= n / 2 GROUP BY ALL"""
)
def word_sets(spark, sf_dir):
    return selecting.word_sets(segs(spark, sf_dir)).groupBy("conv_id", "seg_id").agg(F.count("*").alias("n_words"))


def _kept_checks(kept, s, keep):
    """(conv_id, within_budget, n_twice): whether the kept tokens of each conversation are within its budget, and segments kept twice."""
    t = kept.join(s.select("conv_id", "seg_id", "tokens"), ["conv_id", "seg_id"]).groupBy("conv_id").agg(F.sum("tokens").alias("kept"), (F.count("*") - F.countDistinct("seg_id")).alias("n_twice"))
    b = bud.token_budget(s, keep).join(t, "conv_id", "left")
    return b.select("conv_id", (F.coalesce("kept", F.lit(0)) <= F.col("budget")).alias("within_budget"), F.coalesce("n_twice", F.lit(0)).alias("n_twice"))


_ALL_WITHIN = f"WITH {SQL_SEG} SELECT conv_id, true AS within_budget, 0::BIGINT AS n_twice FROM seg GROUP BY conv_id"


@query(_ALL_WITHIN)
def novelty_checks(spark, sf_dir):
    return _kept_checks(novelty_select(spark, sf_dir), segs(spark, sf_dir).select("conv_id", "seg_id", "tokens"), 0.33)


@query(_ALL_WITHIN)
def codec_checks(spark, sf_dir):
    return _kept_checks(codec_select(spark, sf_dir), segs(spark, sf_dir).select("conv_id", "seg_id", "tokens"), 0.33)


@query(f"WITH {SQL_SEG} SELECT conv_id, count(*) AS n_segments, 0::BIGINT AS n_outside, true AS whole FROM seg GROUP BY conv_id")
def leverage_checks(spark, sf_dir):
    """Leverage of each conversation: every score lies within 0 and 1, and the scores add up to a whole number, the rank that was kept."""
    s = scoring.spectral(_vectors(spark, sf_dir)).groupBy("conv_id").agg(F.count("*").alias("n_segments"), F.count(F.when((F.col("score") < -1e-9) | (F.col("score") > 1 + 1e-6), 1)).alias("n_outside"), F.sum("score").alias("sum"))
    return s.select("conv_id", "n_segments", "n_outside", (F.abs(F.col("sum") - F.round("sum")) < 1e-4).alias("whole"))


@query(f"WITH {SQL_SEG} SELECT conv_id, count(*) AS n_segments, 0::BIGINT AS n_above FROM seg GROUP BY conv_id")
def ridge_checks(spark, sf_dir):
    """Ridge leverage is never above leverage of all directions."""
    v = _vectors(spark, sf_dir)
    both = scoring.spectral(v, ridge=1.0).withColumnRenamed("score", "ridge").join(scoring.spectral(v, energy=1.0), ["conv_id", "seg_id"])
    return both.groupBy("conv_id").agg(F.count("*").alias("n_segments"), F.count(F.when(F.col("ridge") > F.col("score") + 1e-6, 1)).alias("n_above"))
