"""All queries of the core by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import q_drift, q_metrics, q_reports, q_select, q_sessions, q_text, q_topics, q_transform


_PARTS = (q_drift, q_text, q_select, q_metrics, q_topics, q_transform, q_sessions, q_reports)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _part in _PARTS:
    QUERIES.update(_part.QUERIES)
    SQL.update(_part.SQL)

#: Columns whose type in SQL is wider than the query's.
_TYPES = {
    "INTEGER": {
        "action_boundaries": "t", "atoms_verbatim": "n_atoms n_verbatim", "checkpoint_turns": "t", "kept_flags": "tokens", "paragraphs": "part", "sentence_counts": "n_sentences", "spread_sample": "rank", "supersede_apply": "tokens",
        "tail_starts": "t tail_from", "token_counts": "n_tokens", "token_quantiles": "p90_nearest", "turn_tokens": "t",
    },
    "INTEGER[]": {"indent_bands": "bands"},
    "BIGINT": {
        "action_runs": "tokens", "compression_ratio": "total_tokens kept_tokens", "corpus_stats": "n_tokens text_tokens code_tokens tool_use_tokens tool_result_tokens thinking_tokens", "supersede_by_reason": "tokens", "token_budgets": "total",
        "token_quantiles": "tokens", "token_stats_by_role": "n_tokens", "tool_output_survey": "n_tokens n_lines", "turn_tokens": "tokens before", "usage_by_set": "q_chars a_chars",
    },
}
for _kind, _of in _TYPES.items():
    for _name, _columns in _of.items():
        _casts = ", ".join(f"CAST({c} AS {_kind}) AS {c}" for c in _columns.split())
        SQL[_name] = f"SELECT * REPLACE ({_casts}) FROM ({SQL[_name]})"

flagship = q_select.compress_tfidf
