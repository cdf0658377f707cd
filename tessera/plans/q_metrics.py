"""Queries of metrics, set operations and rate-distortion curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import curves, metrics, scoring, supersede
from tessera.operators import budget as bud
from tessera.plans.common import SQL_SEG, SQL_SUPERSEDE, Registry, segs
from tessera.runtime import cut, table

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query(
    f"""WITH {SQL_SUPERSEDE}, o AS (SELECT conv_id, sum(tokens) AS t FROM seg GROUP BY ALL), k AS (SELECT conv_id, sum(tokens) AS t FROM final GROUP BY ALL)
    SELECT conv_id, o.t AS total_tokens, coalesce(k.t, 0) AS kept_tokens, CASE WHEN o.t > 0 THEN coalesce(k.t, 0) / o.t ELSE 1 END AS ratio FROM o LEFT JOIN k USING (conv_id)"""
)
def compression_ratio(spark, sf_dir):
    s = segs(spark, sf_dir)
    return metrics.compression(s, supersede.apply_supersession(s))


_KEPT = "kept AS (SELECT * FROM seg WHERE kind IN ('prose', 'code'))"
_WANT = "want AS (SELECT DISTINCT conv_id, unnest(atoms) AS atom FROM seg), have AS (SELECT DISTINCT conv_id, unnest(atoms) AS atom FROM kept)"


@query(
    f"""WITH {SQL_SEG}, {_KEPT}, {_WANT} SELECT conv_id, count(*) AS n_wanted, count(h) AS n_have FROM want LEFT JOIN (SELECT *, 1 AS h FROM have) USING (conv_id, atom) WHERE atom IS NOT NULL GROUP BY conv_id"""
)
def atom_recall(spark, sf_dir):
    s = segs(spark, sf_dir)
    return metrics.recall(metrics.mentions(s), metrics.mentions(s.where("kind in ('prose', 'code')")))


@query(
    f"""WITH {SQL_SEG}, {_KEPT}, {_WANT}, k AS (SELECT DISTINCT conv_id, kind, unnest(atoms) AS atom FROM seg)
    SELECT conv_id, kind, coalesce(r, 1) AS atom_recall FROM (SELECT DISTINCT conv_id, kind FROM seg) LEFT JOIN (
        SELECT conv_id, kind, count(h) / count(*) AS r FROM k LEFT JOIN (SELECT *, 1 AS h FROM have) USING (conv_id, atom) WHERE atom IS NOT NULL GROUP BY ALL) USING (conv_id, kind)"""
)
def atom_recall_by_kind(spark, sf_dir):
    s = segs(spark, sf_dir)
    return metrics.recall_by_kind(s, s.where("kind in ('prose', 'code')"))


@query(
    f"""WITH {SQL_SUPERSEDE}, {_KEPT}, w AS (SELECT DISTINCT conv_id, unnest(atoms) AS atom FROM seg), k AS (SELECT DISTINCT conv_id, unnest(atoms) AS atom FROM kept), f AS (SELECT DISTINCT conv_id, unnest(atoms) AS atom FROM final),
    g AS (SELECT DISTINCT conv_id, atom FROM (SELECT conv_id, unnest(atoms) AS atom FROM seg WHERE kind = 'tool_use') WHERE contains(atom, '/')),
    x AS (SELECT conv_id, (k.atom IS NOT NULL) AS k, (f.atom IS NOT NULL) AS f, (g.atom IS NOT NULL) AS g FROM (SELECT * FROM w WHERE atom IS NOT NULL) w LEFT JOIN k USING (conv_id, atom) LEFT JOIN f USING (conv_id, atom) LEFT JOIN g USING (conv_id, atom)),
    s AS (SELECT conv_id, count(*) AS w, count(*) FILTER (k OR g) AS wh, count(*) FILTER (NOT g) AS e, count(*) FILTER (k AND NOT g) AS eh, count(*) FILTER (f) AS f, count(*) FILTER (f AND (k OR g)) AS fh, count(*) FILTER (f AND NOT g) AS fe, count(*) FILTER (f AND k AND NOT g) AS feh, count(*) FILTER (g) AS g FROM x GROUP BY conv_id)
    SELECT o.conv_id, CAST(total_tokens AS BIGINT) AS total_tokens, CAST(coalesce(kt, 0) AS BIGINT) AS kept_tokens, CASE WHEN total_tokens > 0 THEN coalesce(kt, 0) / total_tokens ELSE 1 END AS ratio,
        CASE WHEN w > 0 THEN wh / w ELSE 1 END AS atom_recall, CASE WHEN e > 0 THEN eh / e ELSE 1 END AS atom_recall_earned, CASE WHEN f > 0 THEN fh / f ELSE 1 END AS atom_recall_final,
        CASE WHEN fe > 0 THEN feh / fe ELSE 1 END AS atom_recall_final_earned, CASE WHEN w > 0 THEN g / w ELSE 0 END AS guaranteed_share
    FROM (SELECT conv_id, sum(tokens) AS total_tokens FROM seg GROUP BY ALL) o LEFT JOIN (SELECT conv_id, sum(tokens) AS kt FROM kept GROUP BY ALL) USING (conv_id) LEFT JOIN s USING (conv_id)"""
)
def evaluate(spark, sf_dir):
    """All metrics of keeping prose and code, where a side table hands over the paths of tool calls."""
    s = cut(segs(spark, sf_dir))
    handed = metrics.mentions(s.where("kind = 'tool_use'")).where(F.contains("atom", F.lit("/")))
    return metrics.evaluate(s, s.where("kind in ('prose', 'code')"), handed)


@query(
    """SELECT label, vec_id, round(max(list_dot_product(a, b)), 5) AS best FROM (SELECT label, vec_id, embedding::DOUBLE[] AS a FROM embeddings)
    JOIN (SELECT label, embedding::DOUBLE[] AS b FROM embeddings WHERE embedding[1] > 0) USING (label) GROUP BY label, vec_id
    UNION ALL SELECT label, vec_id, 0 FROM embeddings WHERE label NOT IN (SELECT label FROM embeddings WHERE embedding[1] > 0)"""
)
def semantic_coverage(spark, sf_dir):
    """How near each vector's label has a kept one, where the vectors with a positive first part are kept."""
    e = table(spark, sf_dir, "embeddings")
    return metrics.coverage(e, e.where("embedding[0] > 0"), "label", "vec_id", "embedding").withColumn("best", F.round("best", 5))


@query(
    """WITH a AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS a FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL),
    b AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS b FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings WHERE embedding[1] > 0) GROUP BY ALL)
    SELECT label, round(coalesce(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 0), 6) AS doc_cosine FROM a LEFT JOIN b USING (label, i) GROUP BY label"""
)
def doc_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return metrics.doc_cosine(e, e.where("embedding[0] > 0"), "label", "embedding").withColumn("doc_cosine", F.round("doc_cosine", 6))


@query(
    """SELECT vec_id, list(round(x - m, 6) ORDER BY i) AS centred FROM (SELECT vec_id, i, embedding[i]::DOUBLE AS x, avg(embedding[i]::DOUBLE) OVER (PARTITION BY i) AS m FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)) GROUP BY vec_id"""
)
def center_embeddings(spark, sf_dir):
    return scoring.centred(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query(f"WITH {SQL_SEG}, {_KEPT}, {_WANT} SELECT conv_id, atom FROM (SELECT * FROM want EXCEPT SELECT * FROM have) WHERE atom IS NOT NULL")
def atoms_lost(spark, sf_dir):
    s = segs(spark, sf_dir)
    return metrics.mentions(s).join(metrics.mentions(s.where("kind in ('prose', 'code')")), ["conv_id", "atom"], "left_anti")


@query(
    f"""WITH {SQL_SEG}, a AS (SELECT * FROM seg WHERE kind IN ('prose', 'code')), b AS (SELECT * FROM seg WHERE tokens >= 40)
    SELECT conv_id, count(*) FILTER (a AND b) / count(*) AS jaccard FROM (SELECT conv_id, seg_id, bool_or(x = 1) AS a, bool_or(x = 2) AS b FROM (SELECT conv_id, seg_id, 1 AS x FROM a UNION ALL SELECT conv_id, seg_id, 2 FROM b) GROUP BY ALL) GROUP BY conv_id"""
)
def selection_jaccard(spark, sf_dir):
    """How far two selections agree: of prose and code, and of what has forty tokens or more."""
    s = segs(spark, sf_dir)
    return metrics.jaccard(s.where("kind in ('prose', 'code')"), s.where("tokens >= 40"))


@query(
    f"""WITH {SQL_SEG} SELECT conv_id, kind, count(*) AS n, sum(tokens) AS tokens, round(quantile_cont(tokens, 0.5), 6) AS p50, round(quantile_cont(tokens, 0.9), 6) AS p90,
        list_sort(list(tokens))[1 + CAST(floor(0.9 * (count(*) - 1)) AS INTEGER)] AS p90_nearest FROM seg GROUP BY conv_id, kind"""
)
def token_quantiles(spark, sf_dir):
    return metrics.quantiles(segs(spark, sf_dir), "conv_id", "kind")


@query(
    f"""WITH {SQL_SEG} SELECT conv_id, round(sum((2 * r - n - 1) * tokens) / (n * sum(tokens)), 6) AS gini FROM (SELECT conv_id, tokens, row_number() OVER (PARTITION BY conv_id ORDER BY tokens) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM seg) GROUP BY conv_id, n HAVING sum(tokens) > 0"""
)
def token_gini(spark, sf_dir):
    return metrics.gini(segs(spark, sf_dir), "conv_id", "tokens")


# curves: how a part of each shipment's price follows the part of its lines, with the return flag as method and the ship month as label
_RUNS = """runs AS (SELECT l_returnflag AS method, CAST(extract(month FROM l_shipdate) AS INTEGER) AS label, CAST(extract(year FROM l_shipdate) AS INTEGER) AS y, count(*) AS n, sum(l_extendedprice) AS p, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
points AS (SELECT method, label, round(sum(n) OVER w / sum(n) OVER (PARTITION BY method, label), 9) AS rate, round(sum(p) OVER w / sum(p) OVER (PARTITION BY method, label), 9) AS recall, round(sum(q) OVER w / sum(q) OVER (PARTITION BY method, label), 9) AS coverage, sum(n) OVER (PARTITION BY method, label) AS weight FROM runs WINDOW w AS (PARTITION BY method, label ORDER BY y)),
curve AS (SELECT * FROM points QUALIFY coalesce(rate - lag(rate) OVER (PARTITION BY method, label ORDER BY rate) > 1e-9, true))"""


def points(spark, sf_dir):
    return curves.points_from_lines(table(spark, sf_dir, "lineitem"))


@query(f"WITH {_RUNS} SELECT method, label, round(rate, 6) AS rate, round(recall, 6) AS recall FROM curve")
def curve_points(spark, sf_dir):
    return curves.curve(points(spark, sf_dir)).select("method", "label", F.round("rate", 6).alias("rate"), F.round("recall", 6).alias("recall"))


_AT = f"""WITH {_RUNS}, seg2 AS (SELECT *, lead(rate) OVER w AS r2, lead(recall) OVER w AS v2 FROM curve WINDOW w AS (PARTITION BY method, label ORDER BY rate)),
    atr AS (SELECT method, label, weight, x AS at_rate, min(CASE WHEN rate = x THEN recall ELSE recall + (v2 - recall) * (x - rate) / (r2 - rate) END) AS value
    FROM seg2, (SELECT unnest([0.25, 0.33, 0.5, 0.75]) AS x) WHERE rate = x OR (rate < x AND r2 > x) GROUP BY ALL)"""


@query(f"{_AT} SELECT method, label, at_rate::DOUBLE AS at_rate, round(value, 6) AS value FROM atr")
def curve_at_rates(spark, sf_dir):
    return curves.at_rates(curves.curve(points(spark, sf_dir)), (0.25, 0.33, 0.5, 0.75)).select("method", "label", "at_rate", F.round("value", 6).alias("value"))


@query(f"{_AT} SELECT method, at_rate::DOUBLE AS at_rate, round(sum(value * weight) / sum(weight), 6) AS value, count(*) AS n FROM atr GROUP BY ALL")
def weighted_at_rates(spark, sf_dir):
    v = curves.at_rates(curves.curve(points(spark, sf_dir)), (0.25, 0.33, 0.5, 0.75))
    return curves.weighted_mean(v, "value", "weight", "method", "at_rate")


@query(f"WITH {_RUNS} SELECT method, label, round(min(rate), 6) AS knee FROM (SELECT *, max(CASE WHEN recall < 0.9 THEN rate END) OVER (PARTITION BY method, label) AS low FROM curve) WHERE rate > coalesce(low, -1) GROUP BY ALL")
def knees(spark, sf_dir):
    return curves.knee(curves.curve(points(spark, sf_dir))).withColumn("knee", F.round("knee", 6))


@query(f"{_AT} SELECT a.label, a.at_rate::DOUBLE AS at_rate, round(a.value - b.value, 6) AS delta FROM atr a JOIN atr b ON a.label = b.label AND a.at_rate = b.at_rate AND a.method = 'R' AND b.method = 'N'")
def matched_rate_deltas(spark, sf_dir):
    v = curves.at_rates(curves.curve(points(spark, sf_dir)), (0.25, 0.33, 0.5, 0.75))
    return curves.deltas(v, "R", "N").withColumn("delta", F.round("delta", 6))


@query(f"""{_AT} SELECT method, label, round((ln(a.value) - ln(b.value)) / (ln(0.75) - ln(0.25)), 6) AS elasticity FROM (SELECT * FROM atr WHERE at_rate = 0.75) a JOIN (SELECT * FROM atr WHERE at_rate = 0.25) b USING (method, label) WHERE a.value > 0 AND b.value > 0""")
def elasticity(spark, sf_dir):
    return curves.elasticity(curves.curve(points(spark, sf_dir)), 0.25, 0.75).withColumn("elasticity", F.round("elasticity", 6))


@query(
    f"""WITH {_RUNS}, f AS (SELECT method, label, avg(recall) AS x, avg(coverage) AS y FROM curve GROUP BY ALL),
    r AS (SELECT method, rank() OVER (PARTITION BY method ORDER BY x) + (count(*) OVER (PARTITION BY method, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY method ORDER BY y) + (count(*) OVER (PARTITION BY method, y) - 1) / 2.0 AS ry FROM (SELECT method, round(x, 9) AS x, round(y, 9) AS y FROM f))
    SELECT method, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r GROUP BY method"""
)
def spearman(spark, sf_dir):
    f = curves.curve(points(spark, sf_dir)).groupBy("method", "label").agg(F.round(F.avg("recall"), 9).alias("x"), F.round(F.avg("coverage"), 9).alias("y"))
    return curves.spearman(f, "x", "y", "method")


@query(
    f"""{_AT}, d AS (SELECT a.at_rate, a.value - b.value AS d FROM atr a JOIN atr b ON a.label = b.label AND a.at_rate = b.at_rate AND a.method = 'R' AND b.method = 'N'), s AS (SELECT at_rate, count(*) FILTER (round(d, 9) > 0) AS up, count(*) FILTER (round(d, 9) < 0) AS down FROM d GROUP BY ALL)
    SELECT at_rate::DOUBLE AS at_rate, up, down, round(least(1.0, 2 * list_sum(list_transform(range(0, least(up, down) + 1), lambda k: exp(lgamma(up + down + 1) - lgamma(k + 1) - lgamma(up + down - k + 1) - (up + down) * ln(2))))), 6) AS p FROM s WHERE up + down > 0"""
)
def sign_test(spark, sf_dir):
    v = curves.at_rates(curves.curve(points(spark, sf_dir)), (0.25, 0.33, 0.5, 0.75))
    return curves.sign_test(curves.deltas(v, "R", "N"), "at_rate")


@query()
def bootstrap_means(spark, sf_dir):
    v = curves.at_rates(curves.curve(points(spark, sf_dir)), (0.25, 0.33, 0.5, 0.75))
    return curves.bootstrap(v, "value", "method", "at_rate")


@query(f"{_AT} SELECT method, round(min(CASE WHEN at_rate = 0.25 THEN v END), 6) AS \"r0.25\", round(min(CASE WHEN at_rate = 0.33 THEN v END), 6) AS \"r0.33\", round(min(CASE WHEN at_rate = 0.5 THEN v END), 6) AS \"r0.5\", round(min(CASE WHEN at_rate = 0.75 THEN v END), 6) AS \"r0.75\" FROM (SELECT method, at_rate, sum(value * weight) / sum(weight) AS v FROM atr GROUP BY ALL) GROUP BY method")
def aggregate_table(spark, sf_dir):
    v = curves.at_rates(curves.curve(points(spark, sf_dir)), (0.25, 0.33, 0.5, 0.75))
    return curves.aggregate_table(v, (0.25, 0.33, 0.5, 0.75))
