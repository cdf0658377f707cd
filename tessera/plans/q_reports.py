"""Queries of reports: kept flags by level, shares, survival of atoms, planned against done, rates of work, chains of replies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import budget as bud
from tessera.operators import cooccur, reports, scoring
from tessera.plans.common import SQL_BLOCK, SQL_SEG, Registry, segs, sql_greedy, sql_strip, sql_tokens, turns
from tessera.plans.q_select import _BUDGET, _TFIDF
from tessera.plans.pipeline import LEVELS
from tessera.operators.segmenting import blocks
from tessera.runtime import cut, table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _level(keep: float) -> str:
    return sql_greedy("SELECT conv_id, seg_id, seg_id::DOUBLE AS score, tokens, false AS forced FROM seg", f"SELECT conv_id, CAST(ceil(sum(tokens) * {keep}::DOUBLE) AS BIGINT) AS budget FROM seg GROUP BY conv_id")


_FLAGS = f"""WITH {SQL_SEG}, l AS ({_level(0.5)}), m AS ({_level(0.33)}), h AS ({_level(0.25)}), f AS (
    SELECT conv_id, seg_id, kind, tokens, (l.k IS NOT NULL) AS light, (m.k IS NOT NULL) AS medium, (h.k IS NOT NULL) AS heavy
    FROM seg LEFT JOIN (SELECT *, 1 AS k FROM l) l USING (conv_id, seg_id) LEFT JOIN (SELECT *, 1 AS k FROM m) m USING (conv_id, seg_id) LEFT JOIN (SELECT *, 1 AS k FROM h) h USING (conv_id, seg_id))"""


@query(f"{_FLAGS} SELECT conv_id, seg_id, kind, tokens, light, medium, heavy FROM f")
def kept_flags(spark, sf_dir):
    """Which segments the newest-first fill keeps at each level."""
    s = cut(scoring.recency(segs(spark, sf_dir)))
    return reports.kept_flags(s, {k: bud.greedy_fill(s, bud.token_budget(s, r)) for k, r in LEVELS.items()}).select("conv_id", "seg_id", "kind", "tokens", *LEVELS)


@query(f"{_FLAGS} SELECT kind, count(*) AS n, count(*) FILTER (light) AS light, count(*) FILTER (medium) AS medium, count(*) FILTER (heavy) AS heavy, round(sum(CASE WHEN medium THEN tokens ELSE 0 END) / (SELECT sum(tokens) FROM f WHERE medium), 6) AS medium_share FROM f GROUP BY kind")
def kept_counters(spark, sf_dir):
    """How many segments of each kind each level keeps, and the kind's part of what medium keeps."""
    return reports.kept_counters(kept_flags(spark, sf_dir))


@query(f"WITH {SQL_SEG} SELECT conv_id, seg_id, len(atoms) AS n_atoms, len(list_filter(atoms, lambda a: contains(text, a))) AS n_verbatim FROM seg WHERE atoms IS NOT NULL AND text IS NOT NULL")
def atoms_verbatim(spark, sf_dir):
    """How many of a segment's recorded atoms stand in its text."""
    s = segs(spark, sf_dir).where("atoms is not null and text is not null")
    return s.select("conv_id", "seg_id", F.size("atoms").alias("n_atoms"), F.size(F.filter("atoms", lambda a: F.contains(F.col("text"), a))).alias("n_verbatim"))


@query(
    rf"""SELECT doc_id, CASE WHEN length(f) <= 80 THEN f ELSE substr(f, 1, 79) || '…' END AS head FROM (SELECT doc_id, {sql_strip(r"regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')")} AS f FROM documents WHERE text IS NOT NULL)"""
)
def clipped(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", tx.clip(F.col("text"), 80).alias("head"))


@query("SELECT sha256('select' || chr(10) || text) AS cache_key, count(*) AS n, min(seg_uid) AS first_uid FROM segments WHERE text IS NOT NULL GROUP BY text")
def embedding_cache_keys(spark, sf_dir):
    """The key under which each text's vector is cached, by content, and how often it would be found."""
    s = table(spark, sf_dir, "segments").where("text is not null")
    return s.groupBy(F.sha2(F.concat(F.lit("select\n"), "text"), 256).alias("cache_key")).agg(F.count("*").alias("n"), F.min("seg_uid").alias("first_uid"))


@query(
    f"""WITH {SQL_BLOCK}, {SQL_SEG} SELECT seg.conv_id, seg.seg_id, lang FROM seg JOIN (SELECT DISTINCT conv_id, turn, text, meta['lang'] AS lang FROM blk WHERE kind = 'code') b ON b.conv_id = seg.conv_id AND b.turn = seg.turn AND b.text = seg.text WHERE seg.kind = 'code' AND lang IS NOT NULL"""
)
def language_hints(spark, sf_dir):
    """The fence's language of code segments, found by their turn and text."""
    b = blocks(turns(spark, sf_dir)).where("kind = 'code'").select("conv_id", "turn", "text", F.try_element_at("meta", F.lit("lang")).alias("lang")).where("lang is not null").distinct()
    return segs(spark, sf_dir).where("kind = 'code'").join(b, ["conv_id", "turn", "text"]).select("conv_id", "seg_id", "lang")


@query(f"WITH {SQL_BLOCK}, {SQL_SEG} SELECT seg.kind, blk.kind AS block_kind, count(*) AS n, count(*) FILTER (contains(blk.text, seg.text)) AS n_verbatim FROM seg JOIN blk USING (conv_id, turn, block) GROUP BY ALL")
def segment_block_map(spark, sf_dir):
    """Segments beside the blocks they come from, and how many stand in them word for word."""
    b = blocks(turns(spark, sf_dir)).select("conv_id", "turn", "block", F.col("kind").alias("block_kind"), F.col("text").alias("block_text"))
    j = segs(spark, sf_dir).join(b, ["conv_id", "turn", "block"])
    return j.groupBy("kind", "block_kind").agg(F.count("*").alias("n"), F.count(F.when(F.contains("block_text", F.col("text")), 1)).alias("n_verbatim"))


@query(
    r"""WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z0-9_]+') AS t FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, i, t[i] AS word FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM tok)),
    v AS (SELECT word FROM e GROUP BY word HAVING count(*) >= 2) SELECT doc_id, count(*) AS n_kept, md5(string_agg(word, ' ' ORDER BY i)) AS sequence FROM e JOIN v USING (word) GROUP BY doc_id"""
)
def vocabulary_encoding(spark, sf_dir):
    """Documents without words outside the vocabulary, in order, as a digest."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(cooccur.PLAIN), F.lit(0)).alias("tokens"))
    return cooccur.kept_tokens(d, cooccur.vocabulary(d)).select("doc_id", F.size("tokens").cast("long").alias("n_kept"), F.md5(F.array_join("tokens", " ")).alias("sequence"))


@query(
    """WITH RECURSIVE one AS (SELECT session_id, uuid, parent_uuid, logged_at, row_id, coalesce(is_sidechain, false) AS side FROM chat_rows WHERE uuid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, uuid ORDER BY row_id) = 1),
    line AS (SELECT session_id, uuid, parent_uuid, 0 AS back FROM (SELECT * FROM one WHERE NOT side QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY logged_at DESC, row_id DESC) = 1)
        UNION ALL SELECT o.session_id, o.uuid, o.parent_uuid, back + 1 FROM line l JOIN one o ON o.session_id = l.session_id AND o.uuid = l.parent_uuid WHERE back < 200)
    SELECT session_id, count(DISTINCT uuid) AS n_chain, max(back) >= 200 AS ring FROM line GROUP BY session_id"""
)
def reply_chains(spark, sf_dir):
    """The whole chain of parents from each session's last message: how long it is and whether it runs in a ring."""
    return reports.reply_chains(table(spark, sf_dir, "chat_rows"))


@query(
    """WITH planned AS (SELECT DISTINCT set_name, label, m AS gen_model FROM probe_pairs, (SELECT DISTINCT gen_model AS m FROM probe_pairs WHERE gen_model IS NOT NULL)), done AS (SELECT set_name, label, gen_model, count(*) AS n FROM probe_pairs GROUP BY ALL)
    SELECT p.set_name, p.gen_model, count(*) AS planned, count(n) AS done FROM planned p LEFT JOIN done d ON d.set_name = p.set_name AND d.label = p.label AND d.gen_model = p.gen_model GROUP BY ALL"""
)
def planned_against_done(spark, sf_dir):
    """Cells of labels and models that are planned, and how many of them have any record."""
    p = table(spark, sf_dir, "probe_pairs")
    return reports.planned_against_done(p.select("set_name", "label").distinct(), p.select("gen_model").where("gen_model is not null").distinct(), p, ["set_name", "label"], "gen_model")


@query("SELECT event_type, round(quantile_cont(m, 0.5), 6) AS typical FROM (SELECT event_type, user_id, quantile_cont(value, 0.5) AS m FROM events GROUP BY ALL) GROUP BY event_type")
def median_of_medians(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return reports.median_of_medians(e, "value", "event_type", "user_id").withColumnRenamed("median", "typical")


@query("SELECT event_type, count(*) AS n_last_hour, round(count(*) / 60.0, 6) AS per_minute FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY event_type")
def recent_rate(spark, sf_dir):
    """Work done within the hour before the last record."""
    return reports.recent_rate(table(spark, sf_dir, "events"), "ts", "event_type")


@query(
    """SELECT event_type, round(quantile_cont(gap, 0.5), 3) AS typical_gap, count(*) FILTER (gap > 10 * m) AS stalls FROM (
        SELECT *, quantile_cont(gap, 0.5) OVER (PARTITION BY event_type) AS m FROM (SELECT event_type, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id))) / 1e6 AS gap FROM events) WHERE gap IS NOT NULL) GROUP BY event_type"""
)
def stalls(spark, sf_dir):
    """The usual gap between records, and gaps of more than ten times that."""
    return reports.stalls(table(spark, sf_dir, "events"), "ts", "event_id", "event_type")


@query(f"WITH {SQL_SEG} SELECT conv_id, seg_id, kind FROM seg WHERE kind = 'tool_use' AND tokens > (SELECT quantile_cont(tokens, 0.9) FROM seg s WHERE s.kind = 'tool_use')")
def heavy_calls(spark, sf_dir):
    s = segs(spark, sf_dir).where("kind = 'tool_use'")
    limit = s.agg(F.percentile("tokens", F.lit(0.9)).alias("q"))
    return s.join(F.broadcast(limit)).where("tokens > q").select("conv_id", "seg_id", "kind")


@query(
    f"""WITH {SQL_BLOCK}, x AS (SELECT conv_id, turn, role, sum({sql_tokens("text")}) AS tokens FROM blk GROUP BY ALL), l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM x),
    r AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM role THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM l)
    SELECT conv_id, CAST(run AS BIGINT) AS run, role, min(turn) AS first_turn, max(turn) AS last_turn, sum(tokens) AS tokens FROM r GROUP BY conv_id, run, role"""
)
def action_runs(spark, sf_dir):
    """Runs of turns of one role: where an action begins and ends, and what it costs."""
    x = blocks(turns(spark, sf_dir)).groupBy("conv_id", "turn", "role").agg(F.sum(tx.token_count(F.col("text"))).alias("tokens"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = x.withColumn("run", F.sum(F.when(F.lag("role").over(w).eqNullSafe(F.col("role")), 0).otherwise(1)).over(w))
    return x.groupBy("conv_id", "run", "role").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum("tokens").alias("tokens"))


_FIRST = sql_greedy("SELECT conv_id, seg_id, coalesce(len(atoms), 0) / greatest(tokens, 1) AS score, tokens, false AS forced FROM scored WHERE kind = 'code'", "SELECT conv_id, CAST(floor(budget * 0.5) AS BIGINT) AS budget FROM b")
_SECOND = sql_greedy("SELECT conv_id, seg_id, score, tokens, (conv_id, seg_id) IN (SELECT (conv_id, seg_id) FROM code) AS forced FROM scored", "SELECT * FROM b")


@query(f"WITH {SQL_SEG}, {_TFIDF.format(src='seg')}, b AS ({_BUDGET.format(keep=0.33)}), code AS ({_FIRST}) {_SECOND}")
def forced_code(spark, sf_dir):
    """Code of most atoms for its tokens forced up to half of the budget, then the plain fill."""
    s = cut(segs(spark, sf_dir))
    return reports.force_code(scoring.tfidf(s), bud.token_budget(s, 0.33), 0.5).select("conv_id", "seg_id")


@query("SELECT unnest(['unique', 'tokens', 'budgets']) AS rule, 0::BIGINT AS broken")
def bundle_invariants(spark, sf_dir):
    """Rules that kept flags must obey, with how many rows break each: none."""
    return reports.bundle_invariants(kept_flags(spark, sf_dir))


