"""Queries of vocabulary, co-occurrence, topics, path tables, code transforms and continuous compaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cooccur, topics
from tessera.plans.common import SQL_SEG, Registry, segs
from tessera.runtime import cut, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_TOK = r"tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z0-9_]+') AS t FROM documents WHERE text IS NOT NULL)"
_COOC = f"""{_TOK}, half AS (SELECT t[i] AS a, t[i + d] AS b, sum(1.0 / d) AS v FROM (SELECT t, d, unnest(range(1, len(t) - d + 1)) AS i FROM tok, (SELECT unnest([1, 2]) AS d)) GROUP BY ALL),
cooc AS (SELECT a, b, sum(v)::DOUBLE AS v FROM (SELECT a, b, v FROM half UNION ALL SELECT b, a, v FROM half) GROUP BY ALL)"""
_PPMI = """{n}_r AS (SELECT a, sum(v) AS r FROM {n} GROUP BY ALL), {n}_c AS (SELECT b, pow(sum(v), 0.75) AS c FROM {n} GROUP BY ALL),
{n}_p AS (SELECT a, b, ln(v * (SELECT sum(c) FROM {n}_c) / (r * c)) AS v FROM {n} JOIN {n}_r USING (a) JOIN {n}_c USING (b) WHERE ln(v * (SELECT sum(c) FROM {n}_c) / (r * c)) > 0)"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", F.regexp_extract_all(F.lower("text"), F.lit(cooccur.PLAIN), F.lit(0)).alias("tokens"))


@query(f"WITH {_TOK} SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, word) - 1 AS idx FROM (SELECT word, count(*) AS cnt FROM (SELECT unnest(t) AS word FROM tok) GROUP BY ALL) WHERE cnt >= 2")
def vocabulary(spark, sf_dir):
    return cooccur.vocabulary(_docs(spark, sf_dir))


@query(f"WITH {_COOC} SELECT a, b, round(v, 6) AS v FROM cooc")
def cooccurrence(spark, sf_dir):
    return cooccur.cooccurrence(_docs(spark, sf_dir)).withColumn("v", F.round("v", 6))


@query(f"WITH {_COOC}, {_PPMI.format(n='cooc')} SELECT a, count(*) AS n_cells, round(sum(v), 4) AS weight FROM cooc_p WHERE v > 1e-9 GROUP BY a")
def ppmi(spark, sf_dir):
    return cooccur.ppmi(cut(cooccur.cooccurrence(_docs(spark, sf_dir)))).where("v > 1e-9").groupBy("a").agg(F.count("*").alias("n_cells"), F.round(F.sum("v"), 4).alias("weight"))


_FRONT = _COOC.replace("text IS NOT NULL)", "text IS NOT NULL AND source = 'design_notes')").replace("tok AS", "ftok AS").replace("FROM tok", "FROM ftok").replace("half", "fhalf").replace("cooc AS", "fcooc AS")


@query(
    f"""WITH {_COOC}, {_FRONT}, {_PPMI.format(n="cooc")}, {_PPMI.format(n="fcooc")}
    SELECT a, count(*) AS n_cells, round(sum(v), 4) AS weight FROM (SELECT f.a, f.b, f.v - coalesce(p.v, 0) AS v FROM fcooc_p f LEFT JOIN cooc_p p ON p.a = f.a AND p.b = f.b) WHERE v > 1e-9 GROUP BY a"""
)
def differential_ppmi(spark, sf_dir):
    """What the design notes associate more than all documents do."""
    d = _docs(spark, sf_dir)
    front, back = (cooccur.ppmi(cut(cooccur.cooccurrence(x))) for x in (d.where("source = 'design_notes'"), d))
    return cooccur.differential(front, back).where("v > 1e-9").groupBy("a").agg(F.count("*").alias("n_cells"), F.round(F.sum("v"), 4).alias("weight"))


@query(f"WITH {_COOC}, {_FRONT} SELECT a, b, round(v, 6) AS v FROM (SELECT c.a, c.b, c.v - coalesce(f.v, 0) AS v FROM cooc c LEFT JOIN fcooc f ON f.a = c.a AND f.b = c.b) WHERE v > 1e-6")
def background_excluding(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return cooccur.excluding(cooccur.cooccurrence(d), cooccur.cooccurrence(d.where("source = 'design_notes'"))).where("v > 1e-6").withColumn("v", F.round("v", 6))


_FV = "SELECT word, row_number() OVER (ORDER BY cnt DESC, word) - 1 AS idx FROM (SELECT word, count(*) AS cnt FROM (SELECT unnest(t) AS word FROM {t}) GROUP BY ALL) WHERE cnt >= 2"


_FTOK = _TOK.replace("text IS NOT NULL)", "text IS NOT NULL AND source = 'design_notes')").replace("tok AS", "ftok AS")


@query(f"WITH {_TOK}, {_FTOK} SELECT s.idx, coalesce(t.idx, -1) AS target_idx FROM ({_FV.format(t='tok')}) s LEFT JOIN ({_FV.format(t='ftok')}) t USING (word)")
def align_vocabularies(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return cooccur.align(cooccur.vocabulary(d), cooccur.vocabulary(d.where("source = 'design_notes'")))


@query(
    """SELECT vec_id, round(s4 / (s2 * s2), 6) AS ipr, round(1 / ((s4 / (s2 * s2)) * 64), 6) AS participation FROM (SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS s2, list_sum(list_transform(embedding, lambda x: pow(x::DOUBLE, 4))) AS s4 FROM embeddings)"""
)
def participation_ratios(spark, sf_dir):
    r = cooccur.ipr(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return r.select("vec_id", F.round("ipr", 6).alias("ipr"), F.round("participation", 6).alias("participation"))


@query()
def topic_scores(spark, sf_dir):
    return topics.topic_scores(segs(spark, sf_dir)).select("conv_id", "seg_id", F.round("score", 6).alias("score"))


@query()
def topic_report(spark, sf_dir):
    return topics.topic_report(segs(spark, sf_dir)).select("conv_id", "run", "topic", F.round("singular_value", 4).alias("singular_value"), F.round("ipr", 4).alias("ipr"))


@query(
    rf"""WITH {SQL_SEG}, w AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM seg), c AS (SELECT conv_id, word, count(*) AS c FROM w GROUP BY ALL)
    SELECT conv_id, word, round(-log2(c / sum(c) OVER (PARTITION BY conv_id)), 6) AS bits FROM c"""
)
def unigram_bits(spark, sf_dir):
    w = segs(spark, sf_dir).select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("word"))
    c = w.groupBy("conv_id", "word").agg(F.count("*").alias("c"))
    total = c.groupBy("conv_id").agg(F.sum("c").alias("t"))
    return c.join(total, "conv_id").select("conv_id", "word", F.round(-F.log2(F.col("c") / F.col("t")), 6).alias("bits"))
