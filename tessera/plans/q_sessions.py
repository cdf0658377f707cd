"""Queries of sources, session records, handoff planning and the pipeline as a whole."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tessera.functions.text import token_count
from tessera.operators import handoff
from tessera.plans import pipeline
from tessera.plans.common import SQL_BLOCK, SQL_SEG, Registry, segs, sql_tokens, turns
from tessera.runtime import cut, shared_folder, table
from tessera.sources import sessions, transcripts

query = Registry()
QUERIES, SQL = query.queries, query.sql

_REC = r"""v AS (SELECT line_id, file_id, line_no, CASE WHEN starts_with(s, '{') AND json_valid(s) THEN s END AS j FROM (SELECT *, regexp_replace(raw, '^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$', '', 'g') AS s FROM session_lines)),
f AS (SELECT line_id, file_id, line_no, j IS NOT NULL AS ok, json_extract_string(j, '$.type') AS rec_type, json_extract_string(j, '$.payload.type') AS payload_type, json_extract_string(j, '$.payload.role') AS role,
    coalesce(json_extract_string(j, '$.payload.call_id'), json_extract_string(j, '$.payload.callId'), json_extract_string(j, '$.payload.call_ref')) AS call_id, TRY_CAST(json_extract_string(j, '$.ordinal') AS INTEGER) AS ordinal FROM v),
c AS (SELECT *, CASE WHEN NOT ok THEN 'malformed' WHEN rec_type = 'session_meta' THEN 'meta' WHEN rec_type = 'turn_context' THEN 'context' WHEN rec_type = 'compacted' THEN 'compacted' WHEN rec_type = 'event_msg' THEN 'event'
    WHEN rec_type = 'response_item' AND payload_type = 'message' THEN 'message' WHEN rec_type = 'response_item' AND payload_type = 'reasoning' THEN 'reasoning'
    WHEN rec_type = 'response_item' AND payload_type IN ('function_call', 'custom_tool_call', 'local_shell_call') THEN 'call' WHEN rec_type = 'response_item' AND payload_type IN ('function_call_output', 'custom_tool_call_output') THEN 'result' ELSE 'unknown' END AS category FROM f)"""


@query(f"WITH {_REC} SELECT line_id, file_id, category, role, call_id FROM c")
def session_records(spark, sf_dir):
    return sessions.records(table(spark, sf_dir, "session_lines")).select("line_id", "file_id", "category", "role", "call_id")


@query(f"WITH {_REC} SELECT file_id, category, count(*) AS n FROM c GROUP BY ALL")
def session_tally(spark, sf_dir):
    return sessions.records(table(spark, sf_dir, "session_lines")).groupBy("file_id", "category").agg(F.count("*").alias("n"))


@query(f"WITH {_REC} SELECT line_id, file_id, CAST(sum(CASE WHEN category = 'message' AND role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no, line_id) AS BIGINT) AS exchange FROM c")
def session_exchanges(spark, sf_dir):
    return sessions.exchanges(sessions.records(table(spark, sf_dir, "session_lines"))).select("line_id", "file_id", "exchange")


@query(f"WITH {_REC} SELECT DISTINCT file_id, call_id FROM c x WHERE category = 'call' AND call_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c y WHERE y.file_id = x.file_id AND y.call_id = x.call_id AND y.category = 'result')")
def unanswered_calls(spark, sf_dir):
    return sessions.unanswered_calls(sessions.records(table(spark, sf_dir, "session_lines")))


@query(
    f"""WITH {_REC}, b AS (
        SELECT file_id, 'first' AS rule FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY line_no, line_id) = 1) WHERE category <> 'meta'
        UNION ALL SELECT file_id, 'parse' FROM c WHERE category = 'malformed'
        UNION ALL SELECT file_id, 'ordinals' FROM (SELECT DISTINCT file_id, ordinal FROM c WHERE ordinal IS NOT NULL) GROUP BY file_id HAVING min(ordinal) <> 0 OR max(ordinal) - min(ordinal) + 1 <> count(*)
        UNION ALL SELECT file_id, 'result-without-call' FROM c x WHERE category = 'result' AND call_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c y WHERE y.file_id = x.file_id AND y.call_id = x.call_id AND y.category = 'call')
        UNION ALL SELECT file_id, 'unknown' FROM c WHERE category = 'unknown')
    SELECT file_id, rule, count(*) AS n FROM b GROUP BY ALL"""
)
def session_rules(spark, sf_dir):
    return sessions.validate(sessions.records(table(spark, sf_dir, "session_lines")))


@query(
    """SELECT row_id, session_id, CASE WHEN coalesce(is_sidechain, false) THEN 'side' WHEN coalesce(is_meta, false) THEN 'meta' WHEN rec_type = 'user' THEN CASE WHEN json_extract_string(payload, '$.role') = 'tool' THEN 'result' ELSE 'user' END
        WHEN rec_type = 'assistant' THEN 'assistant' WHEN rec_type = 'attachment' THEN 'attachment' WHEN rec_type IN ('system', 'file-history-snapshot') THEN 'system' ELSE 'unknown' END AS category, json_extract_string(payload, '$.role') AS role
    FROM chat_rows WHERE uuid IS NOT NULL"""
)
def chat_records(spark, sf_dir):
    return sessions.chat_records(table(spark, sf_dir, "chat_rows"))


def _live(spark, sf_dir):
    lines = table(spark, sf_dir, "session_lines")
    return cut(handoff.live_records(sessions.records(lines), lines.select("line_id", token_count(F.col("raw")).alias("tokens"))))


_LIVE = rf"""{_REC}, live AS (
        SELECT line_id, file_id, category, role, call_id, {sql_tokens("raw")} AS tokens, row_number() OVER (PARTITION BY file_id ORDER BY c.line_no, line_id) - 1 AS pos
        FROM (SELECT *, max(CASE WHEN category = 'compacted' THEN line_no END) OVER (PARTITION BY file_id) AS cut FROM c) c JOIN (SELECT line_id, raw FROM session_lines) USING (line_id)
        WHERE category <> 'malformed' AND (cut IS NULL OR line_no >= cut OR category = 'meta')),
    unit AS (SELECT *, CASE WHEN call_id IS NULL THEN pos ELSE min(pos) OVER (PARTITION BY file_id, call_id) END AS unit FROM live)"""


@query(f"WITH {_LIVE} SELECT file_id, pos::INTEGER AS pos, unit::INTEGER AS unit FROM unit")
def handoff_units(spark, sf_dir):
    return handoff.units(_live(spark, sf_dir))


_REGION = rf"""WITH RECURSIVE {_LIVE},
    x AS (SELECT *, sum(tokens) OVER (PARTITION BY file_id) - sum(tokens) OVER (PARTITION BY file_id ORDER BY pos) + tokens AS after FROM unit),
    begin_ AS (SELECT file_id, least(coalesce(max(CASE WHEN after >= 300 THEN pos END), 0), coalesce(max(CASE WHEN category = 'message' AND role = 'user' THEN pos END), 0)) AS tail_from, max(pos) + 1 AS end_ FROM x GROUP BY file_id),
    spans AS (SELECT file_id, min(pos) AS a, max(pos) AS b FROM unit GROUP BY file_id, unit HAVING min(pos) < max(pos)),
    moved(file_id, tail_from) AS (SELECT file_id, tail_from FROM begin_ UNION SELECT m.file_id, s.a FROM moved m JOIN spans s ON s.file_id = m.file_id AND s.a < m.tail_from AND s.b >= m.tail_from),
    region AS (SELECT m.file_id, min(m.tail_from) AS tail_from, any_value(end_) AS end_ FROM moved m JOIN begin_ b ON b.file_id = m.file_id GROUP BY m.file_id)"""


@query(f'{_REGION} SELECT file_id, tail_from::INTEGER AS tail_from, end_::INTEGER AS "end" FROM region')
def handoff_regions(spark, sf_dir):
    return handoff.split_region(_live(spark, sf_dir), 300)


@query(
    f"""{_REGION}, p AS (
        SELECT u.file_id, pos, line_id, CASE WHEN pos >= tail_from THEN 'tail' WHEN category IN ('meta', 'compacted') THEN 'meta' WHEN category = 'message' AND tokens >= 80 THEN 'chosen'
            WHEN bool_or(category = 'message' AND tokens >= 80) OVER (PARTITION BY u.file_id, unit) THEN 'unit' END AS why FROM unit u JOIN region r ON r.file_id = u.file_id)
    SELECT file_id, pos::INTEGER AS pos, line_id, why IS NOT NULL AS keep, why FROM p"""
)
def handoff_plan(spark, sf_dir):
    live = _live(spark, sf_dir)
    region = cut(handoff.split_region(live, 300))
    long = live.where("category = 'message'").where(F.col("tokens") >= 80)
    return handoff.fork_plan(live, region, long)


@query()
def compress_default(spark, sf_dir):
    """The whole pipeline from turns with default options: one header row for each conversation."""
    _, header = pipeline.compress(turns(spark, sf_dir))
    return header.select("conv_id", "budget", "total_tokens", "kept_tokens", F.round("ratio", 6).alias("ratio"), F.round("atom_recall", 6).alias("atom_recall"), F.round("atom_recall_final", 6).alias("atom_recall_final"))


@query()
def compress_paths(spark, sf_dir):
    _, header = pipeline.compress_segments(segs(spark, sf_dir), pipeline.Options(paths=2))
    return header.select("conv_id", "budget", "kept_tokens", F.round("guaranteed_share", 6).alias("guaranteed_share"))


@query()
def method_sweep(spark, sf_dir):
    """Metrics of five methods at two rates over all conversations."""
    r = pipeline.sweep(segs(spark, sf_dir), ("random", "recency", "tfidf", "supersede+tfidf", "supersede+leverage"), (0.25, 0.5))
    return r.groupBy("method", "keep").agg(F.round(F.sum("kept_tokens") / F.sum("total_tokens"), 6).alias("rate"), F.round(F.avg("atom_recall_final"), 6).alias("recall"))


@query(rf"WITH {SQL_BLOCK} SELECT role, count(DISTINCT (conv_id, turn)) AS n_turns, count(*) AS n_blocks FROM blk WHERE regexp_matches(text, '[^\s\p{{Z}}\x1c-\x1f\x85]') GROUP BY role")
def block_lines_round_trip(spark, sf_dir):
    """Turns written as lines of text and read again: as many turns and blocks as were written."""
    t = turns(spark, sf_dir)
    path = os.path.join(shared_folder(spark), f"lines-{uuid.uuid4().hex}")
    transcripts.write_block_lines(t, path, {"made_by": "round trip"})
    back = transcripts.read_block_lines(transcripts.text_lines(spark, path))
    return back.groupBy("role").agg(F.count("*").alias("n_turns"), F.sum(F.size("blocks")).alias("n_blocks"))


@query("SELECT doc_id, source, rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE rank = CASE WHEN least(5, n) > 1 THEN round_even(round_even(rank * (least(5, n) - 1) / greatest(n - 1, 1), 0) * (n - 1) / (least(5, n) - 1), 0) ELSE 0 END")
def spread_sample(spark, sf_dir):
    """Five documents at even places of each source: a sampling operator."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").select("doc_id", "source").withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1)
    return transcripts.spread(d, "doc_id", 5, "source")


@query(f"WITH {SQL_SEG} SELECT conv_id, seg_id FROM seg WHERE (conv_id, turn, block) NOT IN (SELECT (conv_id, turn, i - 1) FROM (SELECT conv_id, turn, unnest(range(1, len(blocks) + 1)) AS i FROM turns))")
def segments_without_block(spark, sf_dir):
    """What is planned and not there: segments whose block is in no turn."""
    b = table(spark, sf_dir, "turns").select("conv_id", "turn", F.posexplode("blocks").alias("block", "b"))
    return transcripts.missing(segs(spark, sf_dir), b, "conv_id", "turn", "block").select("conv_id", "seg_id")


@query("SELECT label, idx, set_name, a FROM probe_pairs QUALIFY row_number() OVER (PARTITION BY set_name, label, idx ORDER BY probe_id DESC) = 1")
def latest_probes(spark, sf_dir):
    """Of probes delivered more than once the last delivery."""
    return transcripts.latest(table(spark, sf_dir, "probe_pairs").select("probe_id", "set_name", "label", "idx", "a"), ["set_name", "label", "idx"], "probe_id").select("label", "idx", "set_name", "a")


@query(
    r"""SELECT set_name, label, count(*) AS n, count(*) FILTER (x) AS n_exact FROM (SELECT set_name, label, len(list_filter(regexp_extract_all(coalesce(a, ''), '[\p{L}\p{N}_]+'), lambda w: regexp_matches(w, '^(?:[a-z0-9]+(?:_[a-z0-9]+)+|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[a-z]+(?:[A-Z][a-z0-9]+)+|[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)$'))) > 0 AS x FROM probe_pairs) GROUP BY ALL"""
)
def probe_classes(spark, sf_dir):
    """Probes of each label whose answer holds a name (exact) or none (gist)."""
    from tessera.functions.atoms import NAMES, names

    a = F.coalesce("a", F.lit(""))
    exact = F.size(F.concat(*[names(a, n) for n, _ in NAMES[:4]])) > 0
    return table(spark, sf_dir, "probe_pairs").groupBy("set_name", "label").agg(F.count("*").alias("n"), F.count(F.when(exact, 1)).alias("n_exact"))


@query("SELECT set_name, gen_model, count(*) AS n, sum(length(q)) AS q_chars, sum(length(coalesce(a, ''))) AS a_chars FROM probe_pairs GROUP BY ROLLUP (set_name, gen_model)")
def usage_by_set(spark, sf_dir):
    """Volume by set and model with totals."""
    return table(spark, sf_dir, "probe_pairs").rollup("set_name", "gen_model").agg(F.count("*").alias("n"), F.sum(F.length("q")).alias("q_chars"), F.sum(F.length(F.coalesce("a", F.lit("")))).alias("a_chars"))
