"""Queries of text functions and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import atoms as at
from tessera.functions import text as tx
from tessera.operators import segmenting
from tessera.plans.common import SQL_BLOCK, SQL_SEG, Registry, segs, sql_strip, sql_tokens, turn_blocks, turns
from tessera.runtime import table

query = Registry()
QUERIES, SQL = query.queries, query.sql
_W = r"[\p{L}\p{N}_]+"


def _re2(pattern: str) -> str:
    """A pattern as DuckDB reads it: word characters of any script, quotes doubled."""
    return pattern.replace(r"\w", r"\p{L}\p{N}_").replace("'", "''")


@query(f"SELECT seg_uid, {sql_tokens('text')} AS n_tokens FROM segments")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "segments").select("seg_uid", tx.token_count(F.col("text")).alias("n_tokens"))


@query(f"""SELECT role, kind, count(*) AS n_blocks, sum({sql_tokens("text")}) AS n_tokens FROM (WITH {SQL_BLOCK} SELECT * FROM blk) GROUP BY role, kind""")
def token_stats_by_role(spark, sf_dir):
    return turn_blocks(spark, sf_dir).groupBy("role", "kind").agg(F.count("*").alias("n_blocks"), F.sum(tx.token_count(F.col("text"))).alias("n_tokens"))


@query(
    r"""SELECT doc_id, len(list_filter(string_split(regexp_replace(t, '([.!?])\s+([A-Z0-9"''(\[`])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '')) AS n_sentences
    FROM (SELECT doc_id, """
    + sql_strip("text")
    + " AS t FROM documents WHERE text IS NOT NULL)"
)
def sentence_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(tx.sentences(F.col("text"))).alias("n_sentences"))


@query(
    rf"""SELECT doc_id, i - 1 AS part, parts[i] AS paragraph FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
        SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: {sql_strip("x")}), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')) AS parts FROM documents WHERE text IS NOT NULL))"""
)
def paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(tx.paragraphs(F.col("text"))).alias("part", "paragraph"))


@query(r"SELECT seg_uid, list_sort(list_distinct(regexp_extract_all(lower(text), '\p{L}{3,}'))) AS words FROM segments WHERE text IS NOT NULL")
def plain_words(spark, sf_dir):
    return table(spark, sf_dir, "segments").where("text is not null").select("seg_uid", F.array_sort(tx.plain_words(F.col("text"))).alias("words"))


#: DuckDB knows word boundaries of ASCII only, so families are matched against whole runs of word characters.
_FAMILIES = {n: f"^{p[2:-2]}$" for n, p in at.NAMES}


@query(
    "SELECT seg_uid, family, atom FROM ("
    + " UNION ALL ".join(f"SELECT seg_uid, '{n}' AS family, unnest(list_distinct(list_filter(regexp_extract_all(text, '{_W}'), lambda w: regexp_matches(w, '{p}')))) AS atom FROM segments" for n, p in _FAMILIES.items())
    + ")"
)
def atoms_by_family(spark, sf_dir):
    s = table(spark, sf_dir, "segments")
    each = F.array(*[F.struct(F.lit(n).alias("family"), at.names(F.col("text"), n).alias("atoms")) for n in _FAMILIES])
    return s.select("seg_uid", F.explode(each).alias("f")).select("seg_uid", "f.family", F.explode("f.atoms").alias("atom"))


@query(f"SELECT seg_uid, list_sort(list_distinct(regexp_extract_all(text, '{_re2(at.URL)}'))) AS urls FROM segments WHERE text IS NOT NULL")
def url_atoms(spark, sf_dir):
    return table(spark, sf_dir, "segments").where("text is not null").select("seg_uid", F.array_sort(F.array_distinct(at.all_of(F.col("text"), at.URL))).alias("urls"))


@query()
def atoms_all(spark, sf_dir):
    return table(spark, sf_dir, "segments").select("seg_uid", at.extract(F.col("text")).alias("atoms"))


@query()
def path_mentions(spark, sf_dir):
    return table(spark, sf_dir, "segments").where("text is not null").select("seg_uid", F.posexplode(at.paths(at.scannable(F.col("text")))).alias("pos", "path"))


@query(
    r"""SELECT seg_uid, hits >= 3 AND hits >= 0.8 * live AS numbered FROM (
        SELECT seg_uid, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*\d+(?:→|\t)'))) AS hits,
            len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s\p{Z}\x1c-\x1f\x85]'))) AS live FROM segments WHERE text IS NOT NULL)"""
)
def numbered_dumps(spark, sf_dir):
    return table(spark, sf_dir, "segments").where("text is not null").select("seg_uid", tx.is_numbered(F.col("text")).alias("numbered"))


_LIVE = r"list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s\p{Z}\x1c-\x1f\x85]'))"


@query(rf"SELECT seg_uid, round(CASE WHEN len(l) >= 2 THEN 1 - len(list_distinct(l)) / len(l) ELSE 0 END, 9) AS repetition FROM (SELECT seg_uid, {_LIVE} AS l FROM segments WHERE text IS NOT NULL)")
def line_repetition(spark, sf_dir):
    return table(spark, sf_dir, "segments").where("text is not null").select("seg_uid", F.round(tx.repetition(F.col("text")), 9).alias("repetition"))


def _most(shape: str, mark: str) -> str:
    return f"(len(l) > 0 AND len(list_filter(l, lambda x: regexp_matches(x, '{_re2(mark)}'))) / len(l) >= {tx.SHARES[shape]})"


_SHAPE = f"""CASE WHEN s = '' THEN 'empty' WHEN length(s) < {tx.SHORT_CHARS} AND len(l) <= {tx.SHORT_LINES} THEN 'short' WHEN {_most("numbered_file", tx.NUMBERED)} THEN 'numbered_file'
    WHEN regexp_matches(text, '{_re2(tx.DIFF)}') OR ({_most("diff", tx.DIFF_LINES[0])} AND {_most("diff", tx.DIFF_LINES[1])}) THEN 'diff'
    WHEN regexp_matches(text, '{_re2(tx.TRACEBACK)}') THEN 'traceback' WHEN regexp_matches(text, '(?i){_re2(tx.TEST_SUMMARY)}') THEN 'test_output' WHEN {_most("grep_hits", tx.GREP_HIT)} THEN 'grep_hits'
    WHEN (left(s, 1) IN ('{{', '[') AND right(s, 1) IN ('}}', ']')) OR {_most("json", tx.JSON_LINE)} THEN 'json' WHEN {_most("path_listing", tx.LISTING)} THEN 'path_listing'
    WHEN regexp_matches(substr(s, 1, {tx.ERROR_CHARS}), '(?i){_re2(tx.ERROR_MARK)}') THEN 'error_text' ELSE 'other' END"""


@query(rf"SELECT seg_uid, {_SHAPE} AS shape FROM (SELECT seg_uid, text, {sql_strip('text')} AS s, {_LIVE} AS l FROM segments WHERE text IS NOT NULL)")
def output_shapes(spark, sf_dir):
    return table(spark, sf_dir, "segments").where("text is not null").select("seg_uid", tx.output_shape(F.col("text")).alias("shape"))


@query(
    rf"""SELECT shape, count(*) AS n_blocks, sum(tok) AS n_tokens, sum(lines) AS n_lines, round(avg(rep), 6) AS repetition FROM (
        SELECT {_SHAPE} AS shape, {sql_tokens("text")} AS tok, len(string_split(text, chr(10))) AS lines, CASE WHEN len(l) >= 2 THEN 1 - len(list_distinct(l)) / len(l) ELSE 0 END AS rep
        FROM (WITH {SQL_BLOCK} SELECT text, {sql_strip("text")} AS s, {_LIVE} AS l FROM blk WHERE kind = 'tool_result' AND text IS NOT NULL)) GROUP BY shape"""
)
def tool_output_survey(spark, sf_dir):
    b = turn_blocks(spark, sf_dir).where("kind = 'tool_result' and text is not null")
    t = F.col("text")
    s = b.select(tx.output_shape(t).alias("shape"), tx.token_count(t).alias("tok"), F.size(F.split(t, "\n")).alias("lines"), tx.repetition(t).alias("rep"))
    return s.groupBy("shape").agg(F.count("*").alias("n_blocks"), F.sum("tok").alias("n_tokens"), F.sum("lines").alias("n_lines"), F.round(F.avg("rep"), 6).alias("repetition"))


def _sql_language() -> str:
    s = sql_strip("text")
    known = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.LANGUAGES.items())
    marks = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in tx.LANGUAGE_MARKS)
    return f"""coalesce(CASE lower(trim(try_cast(meta['lang'] AS VARCHAR))) {known} END, CASE WHEN json_valid(text) AND regexp_matches({s}, '^[{{\\[]') THEN 'json' {marks} END)"""


@query(f"WITH {SQL_BLOCK} SELECT {_sql_language()} AS language, count(*) AS n_blocks FROM blk WHERE kind = 'code' AND text IS NOT NULL GROUP BY ALL")
def languages(spark, sf_dir):
    b = turn_blocks(spark, sf_dir).where("kind = 'code' and text is not null")
    return b.groupBy(tx.language(F.try_element_at("meta", F.lit("lang")), F.lit(None).cast("string"), F.col("text")).alias("language")).agg(F.count("*").alias("n_blocks"))


@query(
    rf"""WITH {SQL_BLOCK}, parts AS (
        SELECT conv_id, turn, block, kind, unnest(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: {sql_strip("x")}), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]'))) AS text
        FROM blk WHERE kind IN ('text', 'thinking') AND text IS NOT NULL)
    SELECT conv_id, turn, block, CASE kind WHEN 'text' THEN 'prose' ELSE kind END AS kind, text FROM parts
    UNION ALL SELECT conv_id, turn, block, kind, text FROM blk WHERE kind IN ('code', 'tool_use') AND regexp_matches(text, '[^\s\p{{Z}}\x1c-\x1f\x85]')"""
)
def segment_prose_and_calls(spark, sf_dir):
    s = segmenting.segment(turns(spark, sf_dir).withColumn("blocks", F.filter("blocks", lambda b: b["kind"] != "tool_result")))
    return s.select("conv_id", "turn", "block", "kind", "text")


@query()
def segment_all(spark, sf_dir):
    return segmenting.segment(turns(spark, sf_dir))


@query(
    rf"""WITH {SQL_SEG}, f AS (SELECT *, first_value(role) OVER w AS r, first_value(kind) OVER w AS k FROM seg WINDOW w AS (PARTITION BY conv_id, turn, block ORDER BY seg_id)),
    b AS (
        SELECT conv_id, turn, block, any_value(r) AS role, CASE any_value(k) WHEN 'prose' THEN 'text' ELSE any_value(k) END AS kind,
            CASE any_value(k) WHEN 'tool_result' THEN string_agg(text, chr(10) ORDER BY seg_id) ELSE string_agg(text, chr(10) || chr(10) ORDER BY seg_id) END AS text FROM f GROUP BY ALL)
    SELECT conv_id, turn, arg_min(role, block) AS role, count(*)::INTEGER AS n_blocks, list({{'kind': kind, 'text': coalesce(text, '')}} ORDER BY block) AS parts FROM b GROUP BY ALL"""
)
def segments_to_turns(spark, sf_dir):
    return segmenting.to_turns(segs(spark, sf_dir)).select("conv_id", "turn", "role", F.size("blocks").alias("n_blocks"), F.transform("blocks", lambda b: F.struct(b["kind"].alias("kind"), b["text"].alias("text"))).alias("parts"))


@query(
    rf"""WITH {SQL_SEG}, g AS (SELECT *, lag(turn) OVER w = turn AND lag(block) OVER w = block AND lag(seg_id) OVER w < seg_id - 1 AS gap FROM seg WHERE kind = 'prose' AND text IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY seg_id))
    SELECT conv_id, string_agg(CASE WHEN gap THEN '[…]' || chr(10) || chr(10) || text ELSE text END, chr(10) || chr(10) ORDER BY seg_id) AS text FROM g GROUP BY conv_id"""
)
def rendered_prose(spark, sf_dir):
    return segmenting.rendered(segs(spark, sf_dir).where("kind = 'prose' and text is not null"))


@query(
    rf"""WITH {SQL_BLOCK} SELECT conv_id, count(DISTINCT turn) AS n_turns, count(*) AS n_blocks, sum({sql_tokens("text")}) AS n_tokens,
        sum(CASE WHEN kind = 'text' THEN {sql_tokens("text")} ELSE 0 END) AS text_tokens, sum(CASE WHEN kind = 'code' THEN {sql_tokens("text")} ELSE 0 END) AS code_tokens,
        sum(CASE WHEN kind = 'tool_use' THEN {sql_tokens("text")} ELSE 0 END) AS tool_use_tokens, sum(CASE WHEN kind = 'tool_result' THEN {sql_tokens("text")} ELSE 0 END) AS tool_result_tokens,
        sum(CASE WHEN kind = 'thinking' THEN {sql_tokens("text")} ELSE 0 END) AS thinking_tokens FROM blk GROUP BY conv_id"""
)
def corpus_stats(spark, sf_dir):
    b = turn_blocks(spark, sf_dir).withColumn("t", tx.token_count(F.col("text")))
    kinds = ("text", "code", "tool_use", "tool_result", "thinking")
    return b.groupBy("conv_id").agg(
        F.countDistinct("turn").alias("n_turns"), F.count("*").alias("n_blocks"), F.sum("t").alias("n_tokens"), *[F.sum(F.when(F.col("kind") == k, F.col("t")).otherwise(0)).alias(f"{k}_tokens") for k in kinds]
    )
