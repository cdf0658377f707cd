"""Inputs and SQL fragments that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import token_count
from tessera.operators.scoring import embed, term_hashes
from tessera.operators.segmenting import blocks, delivered_once, transcripts
from tessera.operators.selecting import word_hashes
from tessera.operators.supersede import features
from tessera.runtime import spread, table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries of a module with their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def segs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments, each delivery once, with the fallback tokenizer's counts; texts are counted before they are shuffled."""
    return delivered_once(spread(table(spark, sf_dir, "segments")).withColumn("tokens", token_count(F.col("text"))))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with vectors, op, path, copy_key and words in place of texts, which are read once and never shuffled."""
    raw = spread(table(spark, sf_dir, "segments").drop("atoms", "atom_source", "ingested_at")).withColumn("tokens", token_count(F.col("text"))).withColumn("words", word_hashes())
    return delivered_once(embed(features(raw), keep_text=False))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments with op, path, copy_key and terms in place of texts."""
    raw = spread(table(spark, sf_dir, "segments").drop("atoms", "atom_source", "ingested_at")).withColumn("tokens", token_count(F.col("text")))
    return delivered_once(features(raw).withColumn("terms", term_hashes()).drop("text"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts(table(spark, sf_dir, "turns"))


def turn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(turns(spark, sf_dir))


SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"


def sql_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_tokens(c: str) -> str:
    return rf"coalesce(len(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')), 0)"


#: segments by (conv_id, seg_id), first delivery, with token counts.
SQL_SEG = rf"""seg AS (
    SELECT conv_id, seg_id, turn, block, role, kind, text, coalesce(protected, false) AS protected, atoms, tool_name, {sql_tokens("text")} AS tokens
    FROM segments WHERE conv_id IS NOT NULL AND seg_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY conv_id, seg_id ORDER BY seg_uid) = 1)"""

#: blocks of the first delivery of each turn.
SQL_BLOCK = r"""trn AS (
    SELECT conv_id, turn, role, blocks FROM turns WHERE conv_id IS NOT NULL AND turn IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY turn_uid) = 1),
blk AS (
    SELECT conv_id, turn, role, CAST(i - 1 AS INTEGER) AS block, blocks[i].kind AS kind, blocks[i].text AS text, blocks[i].meta AS meta
    FROM (SELECT *, unnest(range(1, len(blocks) + 1)) AS i FROM trn))"""


def _path(key: str) -> str:
    s = sql_strip("text")
    return rf"""CASE WHEN starts_with({s}, '{{') THEN CASE WHEN json_valid({s}) AND json_type({s}, '$.{key}') = 'VARCHAR' THEN json_extract_string({s}, '$.{key}') END
        ELSE nullif(regexp_extract(text, '(?s)<parameter={key}>\s*(.*?)\s*</parameter>', 1), '') END"""


_KEYS = rf"""CASE WHEN starts_with({sql_strip("text")}, '{{') THEN CASE WHEN json_valid({sql_strip("text")}) THEN json_keys({sql_strip("text")}) END
    ELSE regexp_extract_all(text, '<parameter=([\w.-]+)>', 1) END"""

#: file operations, result owners and supersession over seg.
SQL_SUPERSEDE = rf"""{SQL_SEG},
calls AS (
    SELECT conv_id, seg_id, nullif(tool_name, '') AS tool, {_path("command")} AS command, {_KEYS} AS keys,
        coalesce(nullif({_path("file_path")}, ''), nullif({_path("path")}, ''), nullif({_path("notebook_path")}, '')) AS path
    FROM seg WHERE kind = 'tool_use'),
ops AS (
    SELECT conv_id, seg_id, path, CASE
        WHEN tool IN ('Edit', 'Write', 'MultiEdit', 'NotebookEdit', 'create', 'str_replace') THEN 'write'
        WHEN tool IN ('Read', 'NotebookRead', 'view', 'str_replace_editor:view') THEN 'read'
        WHEN tool IS NOT NULL THEN NULL
        WHEN command = 'view' THEN 'read'
        WHEN command IN ('create', 'str_replace', 'insert', 'undo_edit') THEN 'write'
        WHEN list_has_any(keys, ['new_string', 'content', 'edits', 'new_str', 'file_text']) THEN 'write'
        WHEN list_has_all(['file_path', 'path', 'notebook_path', 'offset', 'limit', 'view_range', 'pages'], keys) THEN 'read' END AS op
    FROM calls WHERE path IS NOT NULL),
owner AS (
    SELECT c.conv_id, r.seg_id AS result_id, c.seg_id AS call_id
    FROM (SELECT conv_id, turn, seg_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY seg_id) AS k, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM seg WHERE kind = 'tool_use') c
    JOIN (SELECT conv_id, turn, seg_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY seg_id) AS k, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM seg WHERE kind IN ('tool_result', 'code')) r
    ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 AND (c.n = 1 OR (c.n = r.n AND c.k = r.k))),
direct AS (
    SELECT conv_id, seg_id, CASE op WHEN 'write' THEN 'edit_superseded' ELSE 'read_superseded' END AS reason,
        CASE op WHEN 'write' THEN min(CASE WHEN op = 'write' THEN seg_id END) OVER (PARTITION BY conv_id, path ORDER BY seg_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
        ELSE lead(seg_id) OVER (PARTITION BY conv_id, path ORDER BY seg_id) END AS by_id
    FROM ops WHERE op IS NOT NULL),
copies AS (
    SELECT conv_id, seg_id, 'duplicate' AS reason, max(seg_id) OVER (PARTITION BY conv_id, t) AS by_id
    FROM (SELECT conv_id, seg_id, {sql_strip("text")} AS t FROM seg) WHERE t <> ''),
gone AS (
    SELECT conv_id, seg_id, reason, by_id FROM (
        SELECT *, 1 AS rank FROM direct WHERE by_id IS NOT NULL
        UNION ALL SELECT o.conv_id, o.result_id, d.reason, d.by_id, 2 FROM owner o JOIN direct d ON d.conv_id = o.conv_id AND d.seg_id = o.call_id WHERE d.reason = 'read_superseded' AND d.by_id IS NOT NULL
        UNION ALL SELECT *, 3 FROM copies WHERE seg_id < by_id)
    QUALIFY row_number() OVER (PARTITION BY conv_id, seg_id ORDER BY rank, by_id) = 1),
final AS (SELECT * FROM seg WHERE (conv_id, seg_id) NOT IN (SELECT (conv_id, seg_id) FROM gone))"""


def sql_greedy(items: str, budgets: str) -> str:
    """A table expression (conv_id, seg_id) of a greedy fill over items (conv_id, seg_id, score, tokens, forced) and budgets (conv_id, budget)."""
    return f"""SELECT conv_id, unnest(kept.k) AS seg_id FROM (
        SELECT conv_id, list_reduce(list_prepend({{'u': 0::BIGINT, 'k': []::INTEGER[], 'f': false, 'open': true}}, l),
            lambda a, x: CASE WHEN x.f OR (a.u + x.u <= b AND (CASE WHEN a.f THEN a.u < b ELSE a.open END))
                THEN {{'u': a.u + x.u, 'k': list_concat(a.k, x.k), 'f': x.f, 'open': CASE WHEN x.f THEN true WHEN a.f THEN a.u < b ELSE a.open END}}
                ELSE {{'u': a.u, 'k': a.k, 'f': x.f, 'open': CASE WHEN a.f THEN a.u < b ELSE a.open END}} END) AS kept
        FROM (SELECT i.conv_id, any_value(g.budget)::BIGINT AS b, list({{'u': tokens::BIGINT, 'k': [seg_id::INTEGER], 'f': forced, 'open': true}} ORDER BY forced DESC, score DESC NULLS LAST, seg_id) AS l
              FROM ({items}) i JOIN ({budgets}) g ON g.conv_id = i.conv_id GROUP BY i.conv_id))"""
