from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import banding, continuous, cooccur, curves, handoff, metrics, pathtable, scoring, segmenting, selecting, supersede, topics
from tessera.operators import budget as bud
from tessera.plans import pipeline

SEG = "conv_id bigint, seg_id int, turn int, block int, role string, kind string, text string, protected boolean, atoms array<string>, tool_name string, tokens int"


def segs(spark, rows):
    """rows: (seg_id, turn, kind, text[, tool_name]) of conversation 1."""
    from tessera.functions.atoms import extract
    from tessera.functions.text import token_count

    full = [(1, r[0], r[1], 0, "assistant", r[2], r[3], r[2] in ("code", "tool_use"), None, r[4] if len(r) > 4 else None, None) for r in rows]
    return spark.createDataFrame(full, SEG).withColumn("atoms", extract(F.col("text"))).withColumn("tokens", token_count(F.col("text")))


def edit(path):
    return f'{{"file_path": "{path}", "new_string": "x"}}'


def gone(df):
    return {r.seg_id: (r.reason, r.by_id) for r in supersede.find_superseded(df).collect()}


def test_later_write_supersedes_earlier(spark):
    s = segs(spark, [(0, 0, "tool_use", edit("a.py"), "Edit"), (1, 2, "tool_use", edit("b.py"), "Edit"), (2, 4, "tool_use", edit("a.py") + " ", "Edit")])
    assert gone(s) == {0: ("edit_superseded", 2)}


def test_read_is_superseded_by_any_use_and_drags_its_result(spark):
    s = segs(spark, [(0, 0, "tool_use", '{"file_path": "a.py"}', "Read"), (1, 1, "tool_result", "old text"), (2, 2, "tool_use", edit("a.py"), "Edit")])
    assert gone(s) == {0: ("read_superseded", 2), 1: ("read_superseded", 2)}


def test_duplicates_keep_the_last_and_blank_is_none(spark):
    s = segs(spark, [(0, 0, "prose", "same"), (1, 1, "prose", " same\n"), (2, 2, "prose", " "), (3, 3, "prose", ""), (4, 4, "prose", None)])
    assert gone(s) == {0: ("duplicate", 1)}


def test_unnamed_calls_go_by_their_keys_and_unknown_tools_do_nothing(spark):
    s = segs(spark, [(0, 0, "tool_use", '{"path": "a", "limit": 3}'), (1, 2, "tool_use", '{"path": "a", "content": "z"}'), (2, 4, "tool_use", edit("a"), "Other"), (3, 6, "tool_use", "<parameter=command>\ncreate\n</parameter><parameter=path>a</parameter>")])
    ops = {r.seg_id: r.op for r in supersede.file_op(s).collect()}
    assert ops == {0: "read", 1: "write", 2: None, 3: "write"}


def test_ambiguous_results_stay_without_owner(spark):
    s = segs(spark, [(0, 0, "tool_use", "{}", "A"), (1, 0, "tool_use", "{}", "B"), (2, 1, "tool_result", "x"), (3, 1, "tool_result", "y"), (4, 1, "tool_result", "z")])
    assert supersede.attribute_results(s).count() == 0


def greedy(items, budget):
    used, kept = sum(c for i, s, c, f in items if f), [i for i, s, c, f in items if f]
    if used < budget:
        for i, s, c, f in sorted((x for x in items if not x[3]), key=lambda x: (-x[1], x[0])):
            if used + c <= budget:
                used += c
                kept.append(i)
    return sorted(kept)


@pytest.mark.parametrize("seed", range(4))
def test_greedy_fill_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for conv in range(6):
        items = [(i, rng.choice([1.0, 2.0, 3.5, rng.random()]), rng.randint(0, 9), rng.random() < 0.15) for i in range(rng.randint(1, 40))]
        want[conv] = greedy(items, 25)
        rows += [(conv, *x) for x in items]
    items = spark.createDataFrame(rows, "conv_id bigint, seg_id int, score double, tokens int, must boolean")
    got = {c: [] for c in want}
    for r in bud.greedy_fill(items, spark.createDataFrame([(c, 25) for c in want], "conv_id bigint, budget bigint"), must=F.col("must")).collect():
        got[r.conv_id].append(r.seg_id)
    assert {c: sorted(x) for c, x in got.items()} == want


def test_greedy_fill_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id bigint, seg_id int, score double, tokens int")
    assert bud.greedy_fill(none, spark.createDataFrame([], "conv_id bigint, budget bigint")).count() == 0


def test_budget_rounds_up_in_doubles(spark):
    s = spark.createDataFrame([(1, 100)], "conv_id bigint, tokens int")
    assert bud.token_budget(s, 0.07).first().budget == 8
    with pytest.raises(ValueError):
        bud.token_budget(s, 0)


def test_novelty_with_alpha_zero_is_the_greedy_fill():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(1, 30))
        scores, costs = rng.random(n), rng.integers(1, 9, n)
        words = [rng.integers(0, 20, int(rng.integers(0, 6))) for _ in range(n)]
        words = [np.unique(w) for w in words]
        got = selecting.pick_novel(scores, costs, words, np.zeros(n, bool), 30, 0.0, False)
        assert sorted(got) == greedy([(i, float(scores[i]), int(costs[i]), False) for i in range(n)], 30)


def test_lazy_novelty_equals_exhaustive():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = int(rng.integers(1, 25))
        scores, costs = rng.random(n), rng.integers(1, 9, n)
        words = [np.unique(rng.integers(0, 15, int(rng.integers(0, 6)))) for _ in range(n)]
        seen, left, want, rest = set(), 40, [], set(range(n))
        while True:
            best = [(-(scores[i] * ((1 - sum(int(w) in seen for w in words[i]) / len(words[i])) if len(words[i]) else 1.0) ** 0.5) / costs[i], i) for i in rest if costs[i] <= left]
            if not best:
                break
            i = min(best)[1]
            rest.remove(i)
            want.append(i)
            left -= int(costs[i])
            seen |= {int(w) for w in words[i]}
        assert sorted(selecting.pick_novel(scores, costs, words, np.zeros(n, bool), 40, 0.5, True)) == sorted(want)


def test_leverage_sums_to_the_rank_and_matches_svd(spark):
    x = np.random.default_rng(11).normal(size=(40, 6))
    rows = [(1, i, v.tolist()) for i, v in enumerate(x)] + [(2, 0, [1.0] * 6)]
    s = spark.createDataFrame(rows, "conv_id bigint, seg_id int, vector array<double>")
    got = {(r.conv_id, r.seg_id): r.score for r in scoring.spectral(s).collect()}
    u, sv, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    k = scoring.rank_for_energy(sv, 0.95)
    want = (u[:, :k] ** 2).sum(1)
    assert got[2, 0] == 1.0
    assert np.allclose([got[1, i] for i in range(40)], want, atol=1e-8)
    ridge = {r.seg_id: r.score for r in scoring.spectral(s.where("conv_id = 1"), ridge=1.0).collect()}
    assert np.allclose([ridge[i] for i in range(40)], (u**2 * (sv**2 / (sv**2 + 1))).sum(1), atol=1e-8)


def test_cur_order_never_grows():
    order, norms = scoring.cur_order(np.random.default_rng(0).normal(size=(30, 8)))
    assert len(order) == 8 and len(set(order)) == 8 and (np.diff(norms) <= 1e-9).all()


def test_recall_of_the_literal_corpus(spark):
    s = segs(spark, [
        (0, 0, "prose", "We should refactor the parser before adding new features to it."), (1, 0, "code", "def parse(x):\n    return load_config(x)"),
        (2, 1, "prose", "The build failed 42 times because of config.toml being stale."), (3, 1, "tool_use", '{"tool": "Read", "path": "src/main.py"}'),
        (4, 2, "prose", "Finally the tests passed and we shipped it."), (5, 2, "prose", "One more note about the release process for next week."),
    ])
    e = metrics.evaluate(s, s.where("seg_id in (1, 2)")).first()
    assert e.atom_recall == pytest.approx(3 / 4)
    by = {r.kind: r.atom_recall for r in metrics.recall_by_kind(s, s.where("seg_id in (1, 2)")).collect()}
    assert by == {"prose": 1.0, "code": 1.0, "tool_use": 0.0}
    none = metrics.evaluate(s, s.where("false")).first()
    assert none.atom_recall == 0.0 and none.kept_tokens == 0


def test_coverage_matches_matrix_product(spark):
    x = np.random.default_rng(2).normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "g bigint, i int, vector array<double>")
    got = {r.i: r.best for r in metrics.coverage(df, df.where("i < 20"), "g", "i").collect()}
    assert np.allclose([got[i] for i in range(60)], (x @ x[:20].T).max(1))


def test_segment_and_back(spark):
    blocks = [("text", "One.\n\n---\n\nTwo is here.", {}), ("tool_use", '{"a": 1}', {"name": "Read"}), ("tool_result", "\n".join(f"line {i} of the output" for i in range(60)), {}), ("text", " ", {}), ("text", None, {})]
    t = spark.createDataFrame([(7, 0, "user", blocks)], "conv_id bigint, turn int, role string, blocks array<struct<kind:string,text:string,meta:map<string,string>>>")
    s = segmenting.segment(t).orderBy("seg_id").collect()
    assert [x.seg_id for x in s] == list(range(len(s)))
    assert [x.text for x in s[:2]] == ["One.", "Two is here."]
    assert s[2].tool_name == "Read" and s[2].protected
    assert all(len(x.text) <= 600 for x in s if x.kind == "tool_result")
    assert "\n".join(x.text for x in s if x.kind == "tool_result") == blocks[2][1]
    back = segmenting.to_turns(segmenting.segment(t)).first().blocks
    assert [b.kind for b in back] == ["text", "tool_use", "tool_result"]


def test_line_chunks_in_both_engines_agree(spark):
    texts = ["a" * 10 + "\n" + "b" * 590 + "\nc", "\n".join("x" * n for n in range(1, 60)), "only", "p" * 1500 + "\nq", "a b " * 400]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.p for r in df.select("i", segmenting.result_pieces(F.col("text")).alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == segmenting.line_chunks(t), i


def test_long_paragraphs_are_cut_at_sentences(spark):
    text = "This is a sentence of words. " * 900
    got = spark.createDataFrame([(text,)], "text string").select(segmenting.prose_pieces(F.col("text")).alias("p")).first().p
    assert len(got) == 3 and all(len(p) <= 12000 and p.endswith(".") for p in got) and " ".join(got) == text.strip()


def test_path_table_round_trip(spark):
    s = segs(spark, [(0, 0, "prose", "see src/a.py and main.c, also [P0] once"), (1, 1, "prose", "src/a.py again; src/a.pyx is other, main.cpp"), (2, 2, "tool_use", '{"file_path": "src/a.py"}', "Read")])
    t = pathtable.table(s)
    rows = {r.path: (r.idx, r.mentions, r.marker) for r in t.collect()}
    assert rows == {"src/a.py": (0, 3, "[PP")}
    sub = pathtable.substitute(s, t)
    texts = {r.seg_id: r.text for r in sub.collect()}
    assert texts[1] == "[PP0] again; src/a.pyx is other, main.cpp" and texts[2] == '{"file_path": "[PP0]"}'
    back = {r.seg_id: r.text for r in pathtable.expand(sub, t).collect()}
    assert back == {r.seg_id: r.text for r in s.collect()}


def test_bands_and_quantization():
    code = 'import os\n\n\ndef f(x):\n    """Doc."""\n    if x:\n        y = 1\n        z = 2\n        print(y, z, "and more words to make it long")\n    return x\n'
    bands = banding.band_lines(code, "python")
    assert bands[0] == 0 and bands[3] == 0 and bands[4] == 0 and bands[9] == 0 and bands[6] == 2
    assert banding.quantized(code, "python", 1.0) == code
    out = banding.quantized(code, "python", 0.0)
    assert "def f(x):" in out and "y = 1" not in out and "lines elided" in out
    assert banding.indent_bands(["a", "  b", "", "    c", ""]) == [0, 1, 2, 2, 0]
    call = '{"file_path": "a.py", "old_string": "gone", "new_string": "short"}'
    assert "gone" not in banding.quantized_call(call, 0.0)


def test_indent_bands_in_both_engines_agree(spark):
    texts = ["a\n  b\n\n    c\n", "x", "\n\n", "  a\nb\n\tc"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", banding.indent_band_expr(F.col("text")).alias("b")).collect():
        assert r.b == banding.indent_bands(r.text.split("\n"))


def test_thinning_keeps_protected_words():
    out = banding.thinned("the old parser of load_config is the old one", {"the": 1.0, "old": 1.0}, ["load_config"], 4)
    assert "load_config" in out and banding.count_tokens(out) <= 4


def test_curves(spark):
    rows = [("a", "t", r, v, 1.0, 10) for r, v in ((0.2, 0.5), (0.2 + 1e-12, 0.6), (0.6, 0.9), (1.0, 1.0))] + [("b", "t", 0.2, 0.4, 1.0, 10), ("b", "t", 1.0, 0.8, 1.0, 10)]
    p = spark.createDataFrame(rows, "method string, label string, rate double, recall double, coverage double, weight int")
    c = curves.curve(p)
    assert c.where("method = 'a'").count() == 3
    v = {(r.method, r.at_rate): r.value for r in curves.at_rates(c, (0.1, 0.4, 0.6)).collect()}
    assert v == pytest.approx({("a", 0.4): 0.7, ("a", 0.6): 0.9, ("b", 0.4): 0.5, ("b", 0.6): 0.6})
    assert [(r.method, r.knee) for r in curves.knee(c).collect()] == [("a", 0.6)]


def test_sign_test(spark):
    d = spark.createDataFrame([("x", float(v)) for v in (1, 1, 1, 1, 1, 0, -1)], "k string, delta double")
    r = curves.sign_test(d, "k").first()
    assert (r.up, r.down) == (5, 1) and r.p == pytest.approx(2 * (1 + 6) / 64)


def test_cooccurrence_and_ppmi(spark):
    d = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["a"]), (2, [])], "doc_id int, tokens array<string>")
    got = {(r.a, r.b): r.v for r in cooccur.cooccurrence(d).collect()}
    assert got == {("a", "b"): 1.0, ("b", "a"): 1.0, ("b", "c"): 1.0, ("c", "b"): 1.0, ("a", "c"): 0.5, ("c", "a"): 0.5}
    assert all(r.v > 0 for r in cooccur.ppmi(cooccur.cooccurrence(d)).collect())


def test_selection_takes_a_large_conversation_as_one_run(spark):
    n = 20_010
    last = F.col("id") >= n - 5
    text = F.when(last, F.sha2(F.col("id").cast("string"), 512)).otherwise("same")
    s = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("seg_id"), F.lit("text").alias("kind"), F.lit("user").alias("role"), F.lit(0).alias("turn"), F.lit(False).alias("protected"), text.alias("text"), F.lit(1).alias("tokens"), last.cast("double").alias("score"))
    budgets = spark.createDataFrame([(1, 5)], "conv_id bigint, budget bigint")
    for kept in (selecting.novelty_select(s, budgets), selecting.codec_select(s, budgets)):
        assert sorted(r.seg_id for r in kept.select("seg_id").collect()) == list(range(n - 5, n))


def test_vectors_take_the_whole_text(spark):
    s = segs(spark, [(0, 0, "text", "same " * 500 + "one end"), (1, 0, "text", "same " * 500 + "other words")])
    a, b = (r.vector for r in scoring.embed(s).orderBy("seg_id").collect())
    assert a != b


def test_assignment_and_topics():
    cost = np.random.default_rng(1).random((5, 7))
    best = min(sum(cost[i, p[i]] for i in range(5)) for p in __import__("itertools").permutations(range(7), 5))
    assert sum(cost[i, j] for i, j in topics.assign(cost)) == pytest.approx(best)
    lists = [["red", "green", "blue"] * 3, ["one", "two", "three"] * 3, ["red", "blue", "green"] * 2]
    model = topics.fit(lists)
    assert model is not None and len(topics.scores(lists, model)) == 3
    assert topics.fit([["a", "a"]]) is None


def test_leading_directions_are_those_of_the_dense_matrix(monkeypatch):
    rng = random.Random(6)
    lists = [[f"w{min(int(rng.expovariate(0.02)), 400)}" for _ in range(60)] for _ in range(60)]
    twins = [[f"x{i}", f"y{i}"] * 2 for i in range(20)]  # many equal values, whose directions are free to turn
    config = topics.TopicConfig(k=30)
    dense, equal = topics.fit(lists, config), topics.fit(lists + twins, config)
    monkeypatch.setattr(topics, "DENSE", 0)
    cells = topics.fit(lists, config)
    assert dense[0] == cells[0] and np.allclose(dense[2], cells[2], rtol=1e-8)
    assert np.allclose(dense[1] @ dense[1].T, cells[1] @ cells[1].T, atol=1e-6)
    assert np.allclose(equal[2], topics.fit(lists + twins, config)[2], rtol=1e-8)


def test_leading_directions_are_held_within_a_bound():
    n, k = 1500, 60
    rng = np.random.default_rng(3)
    rows, cols = np.divmod(rng.choice(n * n, 12 * n, replace=False), n)
    values = rng.random(len(rows)) + 0.5
    full = np.zeros((n, n))
    full[rows, cols] = values
    tracemalloc.start()
    u, s = topics.leading(n, rows, cols, values, k)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6  # all the steps' directions are three times this
    assert np.allclose(s, np.linalg.svd(full, compute_uv=False)[:k], rtol=1e-8) and np.allclose(u.T @ u, np.eye(k), atol=1e-10)
    assert np.allclose(np.linalg.norm(full.T @ u, axis=0), s, rtol=1e-8)


def test_directions_without_common_words_have_no_cosine():
    full = (["a", "b", "c", "d"], np.array([[1, 1e-17], [0, -2e-17], [0, 1], [0, 0]]), None, None)
    part = (["a", "b"], np.eye(2), None, None)
    assert sorted(topics.aligned_cosines(full, part)) == [0, 1]


def test_topic_report_keeps_no_text_for_a_token(monkeypatch):
    """One long path among short words must not widen each of a conversation's tokens."""
    rng = random.Random(8)
    lists = [["src/" + "deep/" * 400 + "file.py", *(f"w{min(int(rng.expovariate(0.05)), 90)}" for _ in range(200))] for _ in range(150)]
    seg = list(range(150))
    rng.shuffle(seg)

    class Group:
        def applyInPandas(self, run, schema):
            return run(pd.DataFrame({"conv_id": 7, "seg_id": seg, "tokens": [lists[i] for i in seg]})).to_dict("records")

        def applyInArrow(self, run, schema):
            t = pa.table({"conv_id": pa.array([7] * 150, pa.int64()), "seg_id": seg, "tokens": [lists[i] for i in seg]})
            return [r for b in run((pa.scalar(7, pa.int64()),), iter(t.to_batches(max_chunksize=40))) for r in b.to_pylist()]

    monkeypatch.setattr(topics, "_grouped", lambda segments: Group())
    tracemalloc.start()
    got = topics.topic_report(type("Segments", (), {"dtypes": [("conv_id", "bigint"), ("seg_id", "int")]}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5e7  # a cell of the longest word's width for each token is 240 MB
    words, w, s, ipr = model = topics.fit(lists)
    order = np.argsort(ipr, kind="stable")
    assert [r["topic"] for r in got] == list(range(len(s))) and {r["conv_id"] for r in got} == {7}
    assert np.allclose([r["singular_value"] for r in got], s[order]) and np.allclose([r["ipr"] for r in got], ipr[order])
    assert [r["words"][0] for r in got] == [words[np.argmax(np.abs(w[:, j]))] for j in order] and {len(r["words"]) for r in got} == {8}
    want = np.concatenate([topics.aligned_cosines(model, topics.fit(lists[f::2])) for f in range(2)]).mean()
    assert {round(r["stability"], 6) for r in got} == {round(float(want), 6)}


def test_topics_take_all_words_and_segments_of_a_conversation(spark):
    lists = [[f"w{i}", f"w{i + 1}", f"w{i}", f"w{i + 2}"] for i in range(1700)]
    assert len(topics.fit(lists, topics.TopicConfig(k=3))[0]) > 1500
    s = segs(spark, [(i, i, "text", "alpha beta gamma delta epsilon") for i in (0, 1, 4999, 5000, 9000)])
    report = topics.topic_report(s).collect()
    assert {r.run for r in report} == {0} and len(report) == len({r.topic for r in report})
    got = {r.seg_id: r.score for r in topics.topic_scores(s).collect()}
    assert set(got) == {0, 1, 4999, 5000, 9000} and len(set(got.values())) == 1


def test_compaction_schedule_by_brute_force(spark):
    rng = random.Random(4)
    tokens = [rng.randint(0, 200) for _ in range(80)]
    tt = spark.createDataFrame([(1, i, n) for i, n in enumerate(tokens)], "conv_id bigint, t int, tokens bigint")
    events = continuous.compaction_events(tt, 300, 500, 2).orderBy("t").collect()
    chunks, upto = [], 0
    for t in range(1, len(tokens) + 1):
        while True:
            end = upto
            while end < t and sum(tokens[upto:end]) < 300:
                end += 1
            if sum(tokens[upto:end]) < 300 or sum(tokens[end:t]) < 500:
                break
            chunks.append((t - 1, upto, end))
            upto = end
    assert [(e.t, e.from_turn, e.to_turn) for e in events if e.event == "freeze"] == chunks
    merges = [e for e in events if e.event == "merge"]
    assert merges and all(e.from_turn < e.to_turn for e in merges)


def test_stream_equals_batch(spark, tmp_path):
    from tessera.streaming.compaction import run_once

    rng = random.Random(9)
    rows = [(c, t, rng.randint(10, 300)) for c in range(5) for t in range(60)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, tokens bigint")
    df.write.parquet(str(tmp_path / "in"))
    got = run_once(spark, str(tmp_path / "in"), str(tmp_path / "out"), chunk=400, tail=600)
    want = continuous.compaction_events(df.withColumnRenamed("turn", "t"), 400, 600)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_marker_round_trip_and_cleaning(spark):
    df = spark.createDataFrame([("s1", "2026-01-02", 30, 100, 40)], "a string, d string, k int, n int, t int")
    m = df.select(handoff.marker_text(F.col("a"), F.col("d"), F.col("k"), F.col("n"), F.col("t")).alias("m"))
    p = m.select(handoff.prior_fork(F.col("m"), F.lit(100)).alias("p")).first().p
    assert (p.source, p.date, p.added) == ("s1", "2026-01-02", 30)
    text = "keep\n[tessera: lines trimmed]\n\nmore [tessera: output trimmed]"
    assert spark.createDataFrame([(text,)], "t string").select(handoff.strip_placeholders(F.col("t")).alias("x")).first().x == "keep\n\nmore "


def test_units_and_region_keep_calls_whole(spark):
    rows = [(1, 0, "meta", None, None, 5), (1, 1, "message", "user", None, 50), (1, 2, "call", None, "c1", 50), (1, 3, "result", None, "c1", 50), (1, 4, "call", None, "c2", 50), (1, 5, "message", "user", None, 5), (1, 6, "result", None, "c2", 5)]
    live = spark.createDataFrame(rows, "file_id bigint, pos int, category string, role string, call_id string, tokens int").withColumn("line_id", F.col("pos").cast("long"))
    u = {r.pos: r.unit for r in handoff.units(live).collect()}
    assert u == {0: 0, 1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 4}
    region = handoff.split_region(live, 8)
    assert region.first().tail_from == 4
    plan = {r.pos: r.why for r in handoff.fork_plan(live, region, live.where("pos = 3")).collect()}
    assert plan == {0: "meta", 1: None, 2: "unit", 3: "chosen", 4: "tail", 5: "tail", 6: "tail"}


def test_rates():
    assert pipeline.resolve_rate().keep == 0.33
    assert pipeline.resolve_rate(keep=0.9).keep == 0.9
    r = pipeline.resolve_rate(target_tokens=5, total=1000)
    assert r.keep == 0.10 and r.clamped
    with pytest.raises(ValueError):
        pipeline.resolve_rate(keep=1.5)


@pytest.mark.parametrize("options", [pipeline.Options(), pipeline.Options(novelty=None), pipeline.Options(band=0.33), pipeline.Options(paths=1)])
def test_pipeline_stays_within_its_budget(spark, options):
    s = segs(spark, [(i, i, "prose" if i % 3 else "code", f"Step {i} reads src/mod_{i % 4}.py and then calls handler_{i} with value {i * 7}.") for i in range(30)])
    kept, header = pipeline.compress_segments(s, options)
    h = header.first()
    assert 0 < h.kept_tokens <= h.budget and 0 <= h.atom_recall <= 1
    ids = [r.seg_id for r in kept.orderBy("seg_id").collect()]
    assert len(ids) == len(set(ids))
