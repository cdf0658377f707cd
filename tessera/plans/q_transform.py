"""Queries of path tables, code transforms and continuous compaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import banding, continuous, pathtable
from tessera.operators.segmenting import blocks
from tessera.plans.common import SQL_BLOCK, SQL_SEG, Registry, segs, sql_tokens, turns
from tessera.runtime import cut

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query()
def path_table(spark, sf_dir):
    return pathtable.table(segs(spark, sf_dir))


@query()
def path_table_guaranteed(spark, sf_dir):
    return pathtable.guaranteed(pathtable.table(segs(spark, sf_dir)))


@query()
def path_substitute(spark, sf_dir):
    s = segs(spark, sf_dir)
    return pathtable.substitute(s, pathtable.table(s))


@query(f"WITH {SQL_SEG} SELECT count(*) AS n, 0::BIGINT AS changed FROM seg WHERE text IS NOT NULL")
def path_round_trip(spark, sf_dir):
    """Texts that come back changed from substitution and expansion: none. JSON objects, which are written anew, are compared as values."""
    s = segs(spark, sf_dir).where("text is not null")
    t = cut(pathtable.table(s))
    back = pathtable.expand(pathtable.substitute(s, t), t).withColumnRenamed("text", "back")
    value = lambda c: F.try_parse_json(tx.strip(F.col(c)))
    is_object = tx.strip(F.col("text")).startswith("{") & value("text").isNotNull()
    same = (F.col("text") == F.col("back")) | F.coalesce(is_object & (F.to_json(value("text")) == F.to_json(value("back"))), F.lit(False))
    return s.join(back, ["conv_id", "seg_id"]).agg(F.count("*").alias("n"), F.count(F.when(~same, 1)).alias("changed"))


@query()
def path_survey(spark, sf_dir):
    return pathtable.survey(segs(spark, sf_dir))


@query(
    rf"""WITH {SQL_BLOCK}, ln AS (SELECT conv_id, turn, block, i, l[i] AS line, length(l[i]) - length(regexp_replace(l[i], '^\s+', '')) AS w, regexp_matches(l[i], '[^\s\p{{Z}}\x1c-\x1f\x85]') AS live
        FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT conv_id, turn, block, string_split(text, chr(10)) AS l FROM blk WHERE kind = 'code' AND text IS NOT NULL))),
    r AS (SELECT conv_id, turn, block, w, row_number() OVER (PARTITION BY conv_id, turn, block ORDER BY w) - 1 AS rank FROM (SELECT DISTINCT conv_id, turn, block, w FROM ln WHERE live)),
    b AS (SELECT ln.*, CASE WHEN live THEN rank END AS rank FROM ln LEFT JOIN r USING (conv_id, turn, block, w))
    SELECT conv_id, turn, block, list(coalesce(f, 0) ORDER BY i) AS bands FROM (SELECT *, first_value(rank IGNORE NULLS) OVER (PARTITION BY conv_id, turn, block ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM b) GROUP BY conv_id, turn, block"""
)
def indent_bands(spark, sf_dir):
    b = blocks(turns(spark, sf_dir)).where("kind = 'code' and text is not null")
    return b.select("conv_id", "turn", "block", banding.indent_band_expr(F.col("text")).alias("bands"))


@query()
def quantize_code(spark, sf_dir):
    return banding.quantize(segs(spark, sf_dir), 0.33).select("conv_id", "seg_id", "kind", "text", "tokens")


@query()
def carrying_lines(spark, sf_dir):
    s = segs(spark, sf_dir).where("kind in ('code', 'tool_result') and text is not null")
    return s.select("conv_id", "seg_id", banding.carrying_lines(F.col("text")).alias("lines"))


@query()
def thin_words(spark, sf_dir):
    return banding.thin(segs(spark, sf_dir), 0.6).select("conv_id", "seg_id", "text", "tokens")


_TT = rf"""{SQL_BLOCK}, tk AS (SELECT conv_id, turn, sum({sql_tokens("text")}) AS tokens FROM blk GROUP BY ALL),
tt AS (SELECT conv_id, turn, role, coalesce(tokens, 0) AS tokens, row_number() OVER w - 1 AS t, sum(coalesce(tokens, 0)) OVER w - coalesce(tokens, 0) AS before FROM trn LEFT JOIN tk USING (conv_id, turn) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@query(f"WITH {_TT} SELECT conv_id, turn, t, role, tokens, before FROM tt")
def turn_tokens(spark, sf_dir):
    return continuous.turn_tokens(turns(spark, sf_dir))


@query(
    f"""WITH {_TT}, c AS (SELECT conv_id, t, before FROM tt UNION ALL SELECT conv_id, max(t) + 1, sum(tokens) FROM tt GROUP BY conv_id)
    SELECT c.conv_id, c.t, coalesce(max(tt.t), 0) AS tail_from FROM c LEFT JOIN tt ON tt.conv_id = c.conv_id AND tt.t <= c.t AND tt.before <= c.before - 400 GROUP BY c.conv_id, c.t"""
)
def tail_starts(spark, sf_dir):
    return continuous.tail_starts(continuous.turn_tokens(turns(spark, sf_dir)), 400)


@query(f"WITH {_TT} SELECT conv_id, t FROM (SELECT conv_id, t, role, lag(role) OVER (PARTITION BY conv_id ORDER BY t) AS p FROM tt) WHERE t > 0 AND role = 'assistant' AND p <> 'assistant' UNION ALL SELECT conv_id, max(t) + 1 FROM tt GROUP BY conv_id")
def action_boundaries(spark, sf_dir):
    return continuous.boundaries(continuous.turn_tokens(turns(spark, sf_dir)))


@query(
    f"""WITH {_TT}, s AS (SELECT conv_id, sum(tokens) AS total FROM tt GROUP BY ALL)
    SELECT conv_id, share::DOUBLE AS share, min(t + 1) AS t FROM tt JOIN s USING (conv_id), (SELECT unnest([0.5, 0.75, 1.0]) AS share) WHERE before + tokens >= share::DOUBLE * total GROUP BY conv_id, share"""
)
def checkpoint_turns(spark, sf_dir):
    return continuous.checkpoints(continuous.turn_tokens(turns(spark, sf_dir)))


@query(
    f"""WITH RECURSIVE {_TT}, n AS (SELECT conv_id, max(t) AS m, sum(tokens) AS total FROM tt GROUP BY ALL), e AS (SELECT tt.conv_id, t, before + tokens AS upto FROM tt),
    chunk AS (
        SELECT conv_id, 0::BIGINT AS from_turn, min(t) + 1 AS to_turn, min(upto) AS upto FROM e WHERE upto >= 300 GROUP BY conv_id
        UNION ALL SELECT c.conv_id, any_value(c.to_turn), min(e.t) + 1, min(e.upto) FROM chunk c JOIN e ON e.conv_id = c.conv_id AND e.t >= c.to_turn AND e.upto >= c.upto + 300 GROUP BY c.conv_id)
    SELECT c.conv_id, (SELECT min(e.t) FROM e WHERE e.conv_id = c.conv_id AND e.upto >= c.upto + 500 AND e.t >= c.to_turn - 1)::INTEGER AS t, c.from_turn::INTEGER AS from_turn, c.to_turn::INTEGER AS to_turn
    FROM chunk c JOIN n USING (conv_id) WHERE n.total >= c.upto + 500"""
)
def freeze_chunks(spark, sf_dir):
    e = continuous.compaction_events(continuous.turn_tokens(turns(spark, sf_dir)), 300, 500)
    return e.where("event = 'freeze'").select("conv_id", "t", "from_turn", "to_turn")


@query()
def decay_schedule(spark, sf_dir):
    return continuous.compaction_events(continuous.turn_tokens(turns(spark, sf_dir)), 300, 500)


_THRESHOLD = rf"""WITH {_TT}, tot AS (SELECT conv_id, sum(tokens) AS total, max(t) + 1 AS n FROM tt GROUP BY conv_id),
    upto AS (SELECT conv_id, t, before FROM tt UNION ALL SELECT conv_id, n, total FROM tot),
    at_ AS (SELECT conv_id, t FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY t) AS p FROM tt) WHERE t > 0 AND role = 'assistant' AND p <> 'assistant' UNION ALL SELECT conv_id, n FROM tot),
    x AS (SELECT a.conv_id, a.t, any_value(u.before) AS before, coalesce(max(s.t) FILTER (s.before <= u.before - 300), 0) AS f FROM at_ a JOIN upto u USING (conv_id, t) JOIN tt s ON s.conv_id = a.conv_id GROUP BY a.conv_id, a.t),
    y AS (SELECT x.conv_id, x.t, x.before, least(f, x.t) AS tail_from, b.before AS tail_before, total FROM x JOIN tot USING (conv_id) JOIN upto b ON b.conv_id = x.conv_id AND b.t = least(f, x.t)),
    r AS (SELECT conv_id, list_reduce(list_prepend({{'t': 0, 'b': 0::BIGINT, 'f': 0, 'tb': 0::BIGINT, 'n': 0::BIGINT, 'held': 0::BIGINT, 'ev': []::STRUCT(k INTEGER, t INTEGER, tail_from INTEGER, target BIGINT)[]}},
            list({{'t': t::INTEGER, 'b': before::BIGINT, 'f': tail_from::INTEGER, 'tb': tail_before::BIGINT, 'n': total::BIGINT, 'held': 0::BIGINT, 'ev': []::STRUCT(k INTEGER, t INTEGER, tail_from INTEGER, target BIGINT)[]}} ORDER BY t)),
        lambda a, z: CASE WHEN a.held + z.b - a.tb > floor(0.4::DOUBLE * z.n) AND z.f > a.f
            THEN {{'t': z.t, 'b': z.b, 'f': z.f, 'tb': z.tb, 'n': z.n, 'held': floor(floor(0.4::DOUBLE * z.n) * 0.33::DOUBLE)::BIGINT, 'ev': list_append(a.ev, {{'k': len(a.ev)::INTEGER, 't': z.t, 'tail_from': z.f, 'target': floor(floor(0.4::DOUBLE * z.n) * 0.33::DOUBLE)::BIGINT}})}}
            ELSE a END) AS s FROM y GROUP BY conv_id)
    SELECT conv_id, e.k AS k, e.t AS t, e.tail_from AS tail_from, e.target AS target FROM (SELECT conv_id, unnest(s.ev) AS e FROM r)"""


@query(_THRESHOLD)
def threshold_schedule(spark, sf_dir):
    return continuous.threshold_events(continuous.turn_tokens(turns(spark, sf_dir)), tail=300)


@query()
def stream_compaction(spark, sf_dir):
    """The schedule of decay_schedule, from a stream of turns."""
    import os
    import uuid

    from tessera.runtime import shared_folder
    from tessera.streaming.compaction import run_once

    base = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    tt = continuous.turn_tokens(turns(spark, sf_dir)).select(F.col("conv_id").cast("long"), F.col("t").alias("turn"), F.col("tokens").cast("long"))
    tt.write.parquet(os.path.join(base, "turns"))
    return run_once(spark, os.path.join(base, "turns"), os.path.join(base, "out"), chunk=300, tail=500)
