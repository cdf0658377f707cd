"""The queries of the problems on training text, each over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import chunking, conversations, leakage, neardup, packing, pairs, pii, spans
from tessera.runtime import cut, table


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.items(table(spark, sf_dir, "segments"), table(spark, sf_dir, "turns"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, sf_dir, "segments"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_groups(table(spark, sf_dir, "segments"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_items(spark, sf_dir), table(spark, sf_dir, "given_names")).drop("end_pos")


def p2_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.mask(_items(spark, sf_dir), table(spark, sf_dir, "given_names"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.oversized(_items(spark, sf_dir), table(spark, sf_dir, "size_limits"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_oversized(_items(spark, sf_dir), table(spark, sf_dir, "size_limits"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defective(table(spark, sf_dir, "probe_pairs"))


def p5_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.all_defects(table(spark, sf_dir, "probe_pairs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversations(table(spark, sf_dir, "chat_rows")).drop("role")


def p6_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversations(table(spark, sf_dir, "chat_rows"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p7_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.container_report(packing.pack(table(spark, sf_dir, "documents")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_pairs(table(spark, sf_dir, "documents"))


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_report(table(spark, sf_dir, "documents"))


def p3_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each oversized text: whether its pieces cover it from end to end, each within the limit and each with the overlap (half the limit
    at most) from the piece before."""
    limits = table(spark, sf_dir, "size_limits").groupBy("kind").agg(F.min("max_chars").alias("most"), F.max("overlap_chars").alias("overlap"))
    pieces = chunking.split_oversized(_items(spark, sf_dir), table(spark, sf_dir, "size_limits"))
    w = Window.partitionBy("src", "item_uid", "block").orderBy("piece")
    p = pieces.withColumn("end", F.col("start_pos") + F.length("text")).withColumn("before", F.lag("end").over(w))
    whole = _items(spark, sf_dir).select("src", "item_uid", "block", "kind", F.length(F.trim(F.col("text"), F.lit(" \t\r\n"))).alias("n"))
    j = p.join(whole, ["src", "item_uid", "block"]).join(F.broadcast(limits), "kind")  # six kinds
    back = F.col("before") - F.col("start_pos")
    return j.groupBy("src", "item_uid", "block").agg(
        F.bool_and(F.length("text") <= F.col("most")).alias("within"),
        F.bool_and(F.coalesce((back >= 0) & (back <= F.col("overlap")), F.lit(True))).alias("overlaps"),
        (F.max(F.col("end")) - F.min("start_pos") >= F.first("n")).alias("covered"),
    )


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the packing: containers over capacity, containers with gaps or overlaps, documents of which a token is not placed exactly as often
    as the table has it, by another count of all tokens, and whether there is at most one container more than the tokens need at least."""
    docs = table(spark, sf_dir, "documents")
    packed = cut(packing.pack(docs))
    w = Window.partitionBy("container_id").orderBy("offset")
    c = packed.withColumn("end", F.col("offset") + F.col("n_tokens")).withColumn("gap", F.col("offset") != F.coalesce(F.lag("end").over(w), F.lit(0))).groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.max("end").alias("end"), F.bool_or("gap").alias("gap"))
    a = c.agg(F.count(F.when(F.col("end") > packing.CAPACITY, 1)).alias("n_over"), F.count(F.when(F.col("gap"), 1)).alias("n_gaps"), F.count("*").alias("n"), F.coalesce(F.sum("used"), F.lit(0)).alias("t"))
    # where what is placed begins and ends, against where the documents do
    ends = lambda x, first, n, d: x.select("doc_id", F.explode(F.array(F.struct(first.alias("at"), F.lit(d).alias("d")), F.struct((first + n).alias("at"), F.lit(-d).alias("d"))))).select("doc_id", "col.at", "col.d")
    counts = packing.token_counts(docs).where("id is not null and n_tokens > 0").withColumnRenamed("id", "doc_id")
    both = ends(packed, F.col("first_token"), F.col("n_tokens"), 1).unionByName(ends(counts, F.lit(0).cast("long"), F.col("n_tokens"), -1))
    b = both.groupBy("doc_id", "at").agg(F.sum("d").alias("d")).groupBy("doc_id").agg(F.bool_or(F.col("d") != 0).alias("bad")).agg(F.count(F.when(F.col("bad"), 1)).alias("n_broken"))
    return a.join(F.broadcast(b)).select("n_over", "n_gaps", "n_broken", (F.col("n") <= F.ceil(F.col("t") / packing.CAPACITY) + 1).alias("tight"))  # one row each


QUERIES = {f.__name__: f for f in (p3_checks, p7_checks, p1_found, p1_groups, p2_found, p2_masked, p3_found, p3_pieces, p5_found, p5_defects, p6_found, p6_turns, p7_packed, p7_room, p8_found, p8_report, p9_found, p9_shared)}

SQL: dict[str, str] = {
    "p3_found": r"""
        WITH items AS (
            SELECT 'segments' AS src, seg_uid AS item_uid, 0 AS block, kind, text FROM segments
            UNION ALL
            SELECT 'turns', turn_uid, CAST(i - 1 AS INTEGER), blocks[i].kind, blocks[i].text
            FROM (SELECT turn_uid, blocks, unnest(range(1, len(blocks) + 1)) AS i FROM turns))
        SELECT src, item_uid, block FROM items JOIN size_limits USING (kind)
        WHERE length(trim(text, ' ' || chr(9) || chr(13) || chr(10))) > max_chars""",
    "p1_found": r"""
        WITH w AS (SELECT seg_uid, tool_name, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM segments),
        g AS (SELECT seg_uid, tool_name, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda k: hash(w[k], w[k + 1], w[k + 2])))) AS g FROM w WHERE len(w) >= 25),
        n AS (SELECT seg_uid, count(*) AS n FROM g GROUP BY ALL),
        p AS (SELECT x.seg_uid AS a, y.seg_uid AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.seg_uid < y.seg_uid AND x.tool_name IS NOT DISTINCT FROM y.tool_name GROUP BY ALL)
        SELECT a AS seg_uid_a, b AS seg_uid_b FROM p JOIN n x ON x.seg_uid = a JOIN n y ON y.seg_uid = b WHERE c >= 0.7 * (x.n + y.n - c) - 1e-9""",
    "p6_found": r"""
        WITH RECURSIVE one AS (
            SELECT session_id, uuid, parent_uuid, coalesce(is_sidechain, false) AS side, rec_type IN ('user', 'assistant') AND NOT coalesce(is_meta, false) AS kind, payload, logged_at, row_id
            FROM chat_rows WHERE uuid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, uuid ORDER BY row_id) = 1),
        ends AS (
            SELECT session_id, uuid FROM one x WHERE NOT side AND NOT EXISTS (SELECT 1 FROM one y WHERE y.session_id = x.session_id AND y.parent_uuid = x.uuid AND NOT y.side)
            QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY logged_at DESC, row_id DESC) = 1),
        line AS (
            SELECT session_id, uuid, 0 AS back FROM ends
            UNION ALL SELECT l.session_id, o.parent_uuid, back + 1 FROM line l JOIN one o ON o.session_id = l.session_id AND o.uuid = l.uuid WHERE o.parent_uuid IS NOT NULL AND back < 3000),
        sound AS (SELECT l.session_id FROM line l LEFT JOIN one o ON o.session_id = l.session_id AND o.uuid = l.uuid GROUP BY 1 HAVING count(*) = count(o.uuid) AND count(*) = count(DISTINCT l.uuid)),
        two AS (
            SELECT session_id, ordinal, payload, rec_type = 'response_item' AS kind, row_id FROM chat_rows x
            WHERE session_id NOT IN (SELECT session_id FROM one) QUALIFY row_number() OVER (PARTITION BY session_id, ordinal, payload ORDER BY row_id) = 1),
        whole AS (SELECT session_id FROM two GROUP BY 1 HAVING count(*) = count(DISTINCT ordinal) AND count(*) = count(ordinal) AND min(ordinal) = 0 AND max(ordinal) = count(*) - 1),
        m AS (
            SELECT session_id, -back AS pos, row_id, payload FROM line JOIN one USING (session_id, uuid) WHERE kind AND session_id IN (SELECT session_id FROM sound)
            UNION ALL SELECT session_id, ordinal, row_id, payload FROM two WHERE kind AND session_id IN (SELECT session_id FROM whole)),
        t AS (
            SELECT session_id, row_id, json_extract_string(payload, '$.role') AS role, pos FROM m WHERE regexp_matches(CASE json_type(payload, '$.content') WHEN 'VARCHAR' THEN json_extract_string(payload, '$.content')
                ELSE coalesce(array_to_string(json_extract_string(payload, '$.content[*].text'), ' '), '') || coalesce(array_to_string(json_extract_string(payload, '$.content[*].content'), ' '), '') END, '[^\s\p{Z}\p{C}]')),
        bad AS (
            SELECT session_id FROM (SELECT session_id, role, lead(role) OVER (PARTITION BY session_id ORDER BY pos) AS next FROM t WHERE role IN ('user', 'assistant')) WHERE role = 'user' AND next IS DISTINCT FROM 'assistant')
        SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS INTEGER) AS turn_index, row_id FROM t WHERE session_id NOT IN (SELECT session_id FROM bad)""",
    "p8_found": r"""
        WITH i AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_items),
        d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        iw AS (SELECT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i)),
        dw AS (SELECT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d))
        SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)""",
    "p9_found": r"""
        WITH d AS (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300),
        h AS (SELECT DISTINCT doc_id, md5(substr(text, i, 300)) AS h FROM d)
        SELECT DISTINCT x.doc_id AS doc_id_a, y.doc_id AS doc_id_b FROM h x JOIN h y ON x.h = y.h AND x.doc_id < y.doc_id""",
}
SQL["p6_turns"] = SQL["p6_found"].replace("AS turn_index, row_id FROM t", "AS turn_index, row_id, role FROM t")
SQL["p9_shared"] = r"""
    WITH d AS (SELECT doc_id, text, unnest(range(0, length(text) - 299)) AS i FROM documents WHERE length(text) >= 300),
    h AS (SELECT doc_id, i, md5(substr(text, i + 1, 300)) AS h FROM d),
    f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
    s AS (SELECT doc_id, i, first < doc_id AS again FROM h JOIN f USING (h)),
    a AS (SELECT doc_id, sum(least(300, coalesce(i - before, 300))) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM s) GROUP BY 1),
    r AS (SELECT doc_id, sum(least(300, coalesce(i - before, 300))) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM s WHERE again) GROUP BY 1)
    SELECT doc_id, coalesce(length(text), 0)::INTEGER AS n_chars, coalesce(a.n, 0)::BIGINT AS shared_chars, coalesce(r.n, 0)::BIGINT AS removed_chars,
        CASE WHEN length(text) > 0 THEN round(coalesce(a.n, 0) / length(text), 6) END AS shared_part
    FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN r USING (doc_id)"""
SQL["p8_report"] = r"""
    WITH i AS (SELECT item_id, list_transform(regexp_extract_all(lower(passage), '[\p{L}\p{N}]+'), lambda x: hash(x)) AS w FROM eval_items),
    d AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: hash(x)) AS w FROM documents),
    iw AS (SELECT item_id, k - 1 AS item_at, w[k:k + 12] AS x, unnest([0, 1, 2]) AS part FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i)),
    dw AS (SELECT doc_id, k - 1 AS doc_at, w[k:k + 12] AS y, unnest([0, 1, 2]) AS part FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
    -- two substitutions leave one of three parts of a window untouched
    hit AS (SELECT DISTINCT doc_id, item_id, doc_at, item_at, len(list_filter(list_zip(x, y), lambda z: z[1] = z[2])) AS same
        FROM (SELECT *, hash(x[4 * part + 1:4 * part + 4]) AS h FROM iw) JOIN (SELECT *, hash(y[4 * part + 1:4 * part + 4]) AS h FROM dw) USING (part, h))
    SELECT doc_id, item_id, count(*) AS n_windows, sum((same = 13)::INTEGER)::BIGINT AS n_exact, max(same)::INTEGER AS best_same, min(doc_at)::INTEGER AS first_word FROM hit WHERE same >= 11 GROUP BY doc_id, item_id"""
SQL["p7_checks"] = "SELECT 0::BIGINT AS n_over, 0::BIGINT AS n_gaps, 0::BIGINT AS n_broken, true AS tight"
SQL["p3_checks"] = SQL["p3_found"].replace("SELECT src, item_uid, block FROM items", "SELECT src, item_uid, block, true AS within, true AS overlaps, true AS covered FROM items")
SQL["p1_groups"] = r"""
    WITH RECURSIVE w AS (SELECT seg_uid, tool_name, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM segments),
    s AS (SELECT seg_uid, tool_name, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda k: hash(w[k], w[k + 1], w[k + 2])))) AS s FROM w WHERE len(w) >= 25),
    m AS (SELECT seg_uid, tool_name, s, min(seg_uid) OVER (PARTITION BY tool_name, s) AS rep, count(*) OVER (PARTITION BY tool_name, s) AS n_copies FROM s),
    r AS (SELECT seg_uid, tool_name, len(s) AS n, s FROM m WHERE seg_uid = rep),
    g AS (SELECT seg_uid, tool_name, n, unnest(s) AS g FROM r),
    p AS (SELECT x.seg_uid AS a, y.seg_uid AS b FROM g x JOIN g y ON x.g = y.g AND x.seg_uid < y.seg_uid AND x.tool_name IS NOT DISTINCT FROM y.tool_name GROUP BY x.seg_uid, y.seg_uid, x.n, y.n HAVING count(*) >= 0.7 * (x.n + y.n - count(*)) - 1e-9),
    e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
    way(id, root) AS (SELECT seg_uid, seg_uid FROM r UNION SELECT e.b, way.root FROM way JOIN e ON e.a = way.id AND way.root < e.b),
    group_ AS (SELECT id, min(root) AS root FROM way GROUP BY id), links AS (SELECT a, count(*) AS n FROM e GROUP BY a)
    SELECT m.seg_uid, rep AS class_id, root AS group_id, coalesce(links.n, 0)::BIGINT AS n_links, n_copies FROM m JOIN group_ ON group_.id = rep LEFT JOIN links ON links.a = rep"""
