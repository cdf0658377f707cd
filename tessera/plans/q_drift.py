"""Queries of schemas that drift between files, with their SQL."""

from __future__ import annotations

from tessera.plans.common import Registry
from tessera.runtime import cut, table
from tessera.sources import drift

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: leaf: every path of every record with its type, kind and JSON; change: the report of changes.
SQL_DRIFT = r"""rec AS (
    SELECT line_id, file_id, line_no, raw, CASE WHEN json_type(raw, '$.type') = 'VARCHAR' THEN json_extract_string(raw, '$.type') ELSE coalesce(json_extract(raw, '$.type')::VARCHAR, 'null') END
        || CASE WHEN json_type(raw, '$.payload') <> 'OBJECT' OR coalesce(json_type(raw, '$.payload.type'), 'NULL') = 'NULL' THEN ''
            WHEN json_type(raw, '$.payload.type') = 'VARCHAR' THEN ':' || json_extract_string(raw, '$.payload.type') ELSE ':' || json_extract(raw, '$.payload.type')::VARCHAR END AS rec_type
    FROM session_lines WHERE json_valid(raw) AND json_type(raw) = 'OBJECT'),
node AS (
    SELECT line_id, file_id, rec_type, substr(regexp_replace(x.fullkey, '\[\d+\]', '[]', 'g'), 3) AS path, x.type AS json_kind, x.value AS v, CASE WHEN x.type = 'VARCHAR' THEN json_extract_string(x.value, '$') END AS s
    FROM rec, json_tree(rec.raw) x WHERE x.fullkey <> '$' AND x.type <> 'NULL'),
leaf AS (
    SELECT line_id, file_id, rec_type, path, v, s, CASE json_kind WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS type,
        CASE json_kind WHEN 'VARCHAR' THEN CASE
            WHEN contains(s, ' ') AND NOT regexp_matches(s, '^[\s{\[0-9]') THEN 'text' WHEN regexp_full_match(s, '\s*') THEN 'empty' WHEN regexp_full_match(s, '\s*[{\[].*[}\]]\s*', 's') THEN 'json'
            WHEN regexp_matches(s, '^\d{4}-\d\d-\d\d[T ]\d\d:\d\d') THEN 'time' WHEN regexp_full_match(s, 'v?\d+(\.\d+)+\w*') THEN 'version' WHEN regexp_full_match(s, '[-+]?\d+(\.\d+)?') THEN 'number'
            WHEN regexp_full_match(s, '([A-Za-z]:)?[/\\~]\S*') THEN 'path' WHEN regexp_full_match(s, '[0-9a-fA-F-]{7,}') AND regexp_matches(s, '\d') THEN 'hex'
            WHEN regexp_full_match(s, '[A-Za-z]+[_-]\w*\d\w*') THEN 'id ' || lower(regexp_extract(s, '^[A-Za-z]+')) WHEN regexp_matches(s, '\s') THEN 'text' ELSE 'word' END
        WHEN 'OBJECT' THEN 'object ' || array_to_string(list_sort(json_keys(v)), ',')
        WHEN 'ARRAY' THEN 'array ' || coalesce(json_type(v, '$[0]'), '') || CASE WHEN json_type(v, '$[0]') = 'OBJECT' THEN array_to_string(list_sort(json_keys(v, '$[0]')), ',') ELSE '' END
        WHEN 'BOOLEAN' THEN 'bool' WHEN 'DOUBLE' THEN 'float' ELSE 'int' END AS kind
    FROM node),
kinds AS (SELECT file_id, rec_type, path, type, kind, count(DISTINCT line_id) AS n FROM leaf WHERE file_id IS NOT NULL GROUP BY ALL),
shape AS (
    SELECT file_id, rec_type, path, type, kind FROM (SELECT *, sum(n) OVER (PARTITION BY file_id, rec_type, path, type) AS total FROM kinds)
    QUALIFY row_number() OVER (PARTITION BY file_id, rec_type, path ORDER BY total DESC, type, n DESC, kind) = 1),
steps AS (
    SELECT file_id, next_id FROM (
        SELECT file_id, lead(file_id) OVER (PARTITION BY project ORDER BY started_at NULLS FIRST, file_id) AS next_id
        FROM (SELECT * FROM session_files WHERE file_id IS NOT NULL AND project IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY file_id) = 1)) WHERE next_id IS NOT NULL),
types AS (SELECT DISTINCT file_id, rec_type FROM shape),
step AS (SELECT s.file_id AS old_id, s.next_id AS file_id, a.rec_type FROM steps s JOIN types a ON a.file_id = s.file_id JOIN types b ON b.file_id = s.next_id AND b.rec_type = a.rec_type),
old AS (SELECT s.file_id, s.rec_type, path, type, kind FROM step s JOIN shape x ON x.file_id = s.old_id AND x.rec_type = s.rec_type),
new AS (SELECT s.file_id, s.rec_type, path, type, kind FROM step s JOIN shape x ON x.file_id = s.file_id AND x.rec_type = s.rec_type),
both_ AS (
    SELECT file_id, rec_type, path, o.type AS old_type, o.kind AS old_kind, n.type AS new_type, n.kind AS new_kind FROM old o FULL JOIN new n USING (file_id, rec_type, path)),
differ AS (SELECT * FROM both_ WHERE old_type IS DISTINCT FROM new_type),
top AS (
    SELECT *, regexp_extract(path, '^(.*)\.[^.]*$', 1) AS parent FROM differ d
    WHERE NOT EXISTS (SELECT 1 FROM differ c WHERE c.file_id = d.file_id AND c.rec_type = d.rec_type AND (starts_with(d.path, c.path || '.') OR starts_with(d.path, c.path || '[')))),
pairs AS (
    SELECT g.file_id, g.rec_type, g.path AS a, c.path AS b, levenshtein(lower(regexp_replace(regexp_extract(g.path, '[^.]*$'), '[_-]', '', 'g')), lower(regexp_replace(regexp_extract(c.path, '[^.]*$'), '[_-]', '', 'g'))) AS d
    FROM top g JOIN top c ON c.file_id = g.file_id AND c.rec_type = g.rec_type AND c.parent = g.parent AND g.new_type IS NULL AND c.old_type IS NULL AND g.old_type = c.new_type AND g.old_kind = c.new_kind),
renamed AS (
    SELECT file_id, rec_type, unnest(list_reduce(list_prepend([]::STRUCT(a VARCHAR, b VARCHAR)[], l), lambda done, x: CASE WHEN list_bool_or(list_transform(done, lambda y: y.a = x[1].a OR y.b = x[1].b)) THEN done ELSE list_concat(done, x) END)) AS p
    FROM (SELECT file_id, rec_type, list([{'a': a, 'b': b}] ORDER BY d, a, b) AS l FROM pairs GROUP BY ALL)),
names AS (SELECT file_id, rec_type, list(DISTINCT s) AS vs FROM leaf WHERE path = 'payload.content[].type' AND type = 'string' GROUP BY ALL),
change AS (
    SELECT file_id, rec_type, p.a AS field_path, 'renamed' AS change, p.b AS new_path FROM renamed
    UNION ALL SELECT file_id, rec_type, path, CASE WHEN new_type IS NULL THEN 'removed' WHEN old_type IS NULL THEN 'added' ELSE 'type_changed' END, ''
    FROM top t WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_id = t.file_id AND r.rec_type = t.rec_type AND ((new_type IS NULL AND r.p.a = path) OR (old_type IS NULL AND r.p.b = path)))
    UNION ALL SELECT s.file_id, s.rec_type, 'payload.content[].type', 'value_renamed', '' FROM step s JOIN names o ON o.file_id = s.old_id AND o.rec_type = s.rec_type LEFT JOIN names n ON n.file_id = s.file_id AND n.rec_type = s.rec_type
    WHERE NOT list_has_any(o.vs, coalesce(n.vs, [])) AND EXISTS (SELECT 1 FROM both_ b WHERE b.file_id = s.file_id AND b.rec_type = s.rec_type AND path = 'payload.content[].type' AND old_type = new_type)
        AND NOT EXISTS (SELECT 1 FROM differ c WHERE c.file_id = s.file_id AND c.rec_type = s.rec_type AND c.path IN ('payload', 'payload.content', 'payload.content[]')))"""


@query(f"WITH {SQL_DRIFT} SELECT file_id, rec_type, field_path, change, new_path FROM change")
def p4_found(spark, sf_dir):
    return drift.changes(table(spark, sf_dir, "session_files"), drift.ingest(table(spark, sf_dir, "session_lines")))


_TARGET = ", ".join(f"('{f.name}', '{f.kind}', '{p}')" for f in drift.TARGET for p in f.paths)
_CAST = {"string": "t", "bigint": "t::BIGINT", "timestamp": "t::TIMESTAMPTZ AT TIME ZONE 'UTC'"}
_COLUMNS = ", ".join(f"""{_CAST[f.kind].replace("t", f"max(CASE WHEN name = '{f.name}' THEN t END)", 1)} AS "{f.name}\"""" for f in drift.TARGET)


@query(
    rf"""WITH RECURSIVE {SQL_DRIFT}, target(name, kind, path) AS (VALUES {_TARGET}),
    moves AS (SELECT DISTINCT field_path, new_path FROM change WHERE change = 'renamed'),
    up(name, kind, path, later) AS (
        SELECT name, kind, path, false FROM target
        UNION SELECT u.name, u.kind, m.new_path, true FROM up u JOIN moves m ON m.field_path = u.path WHERE m.new_path NOT IN (SELECT path FROM target)),
    met AS (
        SELECT line_id, name, path, later, CASE u.kind
            WHEN 'timestamp' THEN CASE WHEN regexp_matches(s, '(Z|[+-]\d\d:?\d\d)$') THEN try_cast(s AS TIMESTAMPTZ)::VARCHAR END
            WHEN 'bigint' THEN CASE WHEN l.kind = 'int' THEN v::VARCHAR WHEN regexp_full_match(trim(s), '[-+]?\d{{1,18}}') THEN trim(s) END
            ELSE coalesce(s, v::VARCHAR) END AS t
        FROM leaf l JOIN up u USING (path) WHERE NOT contains(path, '[')),
    taken AS (SELECT * FROM met WHERE t IS NOT NULL QUALIFY row_number() OVER (PARTITION BY line_id, name ORDER BY later, path) = 1),
    wide AS (
        SELECT line_id, {_COLUMNS}, list('"' || path || '":null') FILTER (NOT contains(path, '.')) AS tops, list('"' || substr(path, 9) || '":null') FILTER (starts_with(path, 'payload.')) AS inner_ FROM taken GROUP BY line_id),
    cleared AS (
        SELECT r.line_id, r.rec_type, coalesce(len(inner_), 0) AS n_inner, json_merge_patch(raw, '{{' || array_to_string(list_concat(coalesce(tops, []), CASE WHEN len(inner_) > 0 THEN ['"payload":{{' || array_to_string(inner_, ',') || '}}'] ELSE [] END), ',') || '}}') AS j
        FROM rec r LEFT JOIN wide w USING (line_id))
    SELECT l.line_id, l.file_id, l.line_no, c.rec_type, w.* EXCLUDE (line_id, tops, inner_), CASE WHEN n_inner > 0 AND json_extract(j, '$.payload')::VARCHAR = '{{}}' THEN json_merge_patch(j, '{{"payload":null}}') ELSE j END::VARCHAR AS _rescued
    FROM session_lines l LEFT JOIN cleared c USING (line_id) LEFT JOIN wide w USING (line_id)"""
)
def p4_table(spark, sf_dir):
    """All records under the target's columns, with what the report of changes approves replayed into them."""
    lines = cut(drift.ingest(table(spark, sf_dir, "session_lines")))
    return drift.promote(lines, drift.approvals(drift.changes(table(spark, sf_dir, "session_files"), lines)))
