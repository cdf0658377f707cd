from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.sources import drift, sessions, transcripts


def test_session_log(spark, tmp_path):
    lines = [
        {"type": "user", "message": {"role": "user", "content": "Look:\n```py\nx = 1\n```\ndone"}}, "not json", [1], {"type": "summary"},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "Hi"}, {"type": "tool_use", "name": "Read", "input": {"path": "a"}}, {"type": "image"}, {"type": "thinking", "thinking": "hm"}]}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "r1"}, {"type": "text", "text": "r2"}]}]}}, {"type": "user", "message": {"role": "user", "content": " "}},
    ]
    p = tmp_path / "s.jsonl"
    p.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    turns, skipped = transcripts.from_files(spark, str(p))
    got = turns.orderBy("turn").collect()
    assert [(t.turn, t.role, [(b.kind, b.text) for b in t.blocks]) for t in got] == [
        (0, "user", [("text", "Look:"), ("code", "x = 1"), ("text", "done")]), (1, "assistant", [("text", "Hi"), ("tool_use", '{"path":"a"}'), ("thinking", "hm")]), (2, "user", [("tool_result", "r1\nr2")]),
    ]
    assert got[0].blocks[1].meta == {"lang": "py"} and got[1].blocks[1].meta == {"name": "Read"}
    assert {r.reason: r.n for r in skipped.collect()} == {"malformed": 1, "non-object": 1, "type:summary": 1, "block:image": 1}


def test_message_list(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"messages": [{"role": "user", "content": "a"}, 3, {"role": "robot", "content": "b"}, {"role": "tool", "content": "out"}]}))
    turns, skipped = transcripts.from_files(spark, str(p))
    assert [(t.role, t.blocks[0].kind) for t in turns.orderBy("turn").collect()] == [("user", "text"), ("tool", "tool_result")]
    assert {r.reason: r.n for r in skipped.collect()} == {"message:non-dict": 1, "role:robot": 1}


def test_block_lines_round_trip(spark, tmp_path):
    schema = "conv_id bigint, turn int, role string, blocks array<struct<kind:string,text:string,meta:map<string,string>>>"
    t = spark.createDataFrame([(1, 0, "user", [("text", "a\n\"b\" é", {})]), (1, 1, "assistant", [("code", "x", {"lang": "py"})]), (2, 0, "user", [("text", "z", {})])], schema)
    transcripts.write_block_lines(t, str(tmp_path / "o"), {"k": "v"})
    back = transcripts.read_block_lines(transcripts.text_lines(spark, str(tmp_path / "o")))
    assert sorted((r.turn, r.role, r.blocks[0].text) for r in back.collect()) == sorted((r.turn, r.role, r.blocks[0].text) for r in t.collect())


def test_spread(spark):
    d = spark.range(10).withColumn("g", F.lit(1))
    assert sorted(r.id for r in transcripts.spread(d, "id", 4, "g").collect()) == [0, 3, 6, 9]
    assert transcripts.spread(d, "id", 50, "g").count() == 10


FILES = "file_id bigint, project string, started_at string"
LINES = "line_id bigint, file_id bigint, line_no int, raw string"


def changes(spark, files, records):
    f = spark.createDataFrame(files, FILES).withColumn("started_at", F.to_timestamp("started_at"))
    rows, n = [], 0
    for file_id, rs in records.items():
        for i, r in enumerate(rs):
            rows.append((n, file_id, i, r if r is None or isinstance(r, str) else json.dumps(r)))
            n += 1
    lines = spark.createDataFrame(rows, LINES)
    return {(r.file_id, r.rec_type, r.field_path, r.change, r.new_path) for r in drift.changes(f, drift.ingest(lines)).collect()}


def rec(**payload):
    return {"type": "item", "payload": {"type": "m", **payload}}


def test_changes(spark):
    files = [(1, "p", "2026-01-02"), (2, "p", "2026-01-01"), (3, "q", "2026-01-01"), (4, "p", "2026-01-03")]
    records = {
        2: [rec(call_id="call_1a", n=1, note="some words here", gone=True, o={"a": 1}), "cut {", None, "[]", "", "null", rec(call_id="call_2b", n=2, content=[{"type": "in", "t": "x"}])],
        1: [rec(callId="call_9c", n="1", note="other words", more=[1], o="x", content=[{"type": "out", "t": "x"}])],
        3: [rec(n=1)],
        4: [rec(callId="call_9c", n="1", note=None, more=[1], o="x", content=[{"type": "out", "t": "x"}])],
    }
    assert changes(spark, files, records) == {
        (1, "item:m", "payload.call_id", "renamed", "payload.callId"), (1, "item:m", "payload.n", "type_changed", ""), (1, "item:m", "payload.gone", "removed", ""), (1, "item:m", "payload.more", "added", ""),
        (1, "item:m", "payload.o", "type_changed", ""), (1, "item:m", "payload.content[].type", "value_renamed", ""), (4, "item:m", "payload.note", "removed", ""),
    }


def test_record_types_in_one_file_only_and_empty_tables(spark):
    assert changes(spark, [(1, "p", "2026-01-01"), (2, "p", None)], {1: [rec(a=1)], 2: [{"type": "other"}]}) == set()
    assert changes(spark, [], {1: [rec(a=1)]}) == set()
    assert changes(spark, [(1, "p", "2026-01-01")], {}) == set()


def test_changes_are_read_from_the_rescue_column(spark):
    f = spark.createDataFrame([(1, "p", "2026-01-01"), (2, "p", "2026-01-02")], "file_id bigint, project string, started_at string")
    raw = [(0, 1, 0, json.dumps(rec(role="user", odd=1))), (1, 2, 0, json.dumps(rec(role="user", new=[1])))]
    t = drift.ingest(spark.createDataFrame(raw, LINES))
    got = lambda t: {(r.field_path, r.change) for r in drift.changes(f, t).collect()}
    assert got(t) == {("payload.odd", "removed"), ("payload.new", "added")}
    assert got(t.withColumn("_rescued", F.lit("{}"))) == set()
    assert got(t.withColumn("role", F.when(F.col("file_id") == 1, F.col("role")))) == {("payload.odd", "removed"), ("payload.new", "added"), ("payload.role", "removed")}


def test_ingest_rescues_and_promotes(spark):
    record = {"timestamp": "2026-01-01T00:00:00Z", "ordinal": "7", "type": "t", "payload": {"role": "user", "tool_name": "Read", "turn_id": 1, "model": {"name": "m"}, "x": {"y": None, "z": [1]}, "deep": {}}}
    raw = [json.dumps(record), "{broken", None, "[" * 3000, '{"type": "\\ud800", "\\ud800": 1}', '{"type": 5, "ordinal": 99999999999999999999, "payload": "p"}']
    t = drift.ingest(spark.createDataFrame([(i, 1, i, r) for i, r in enumerate(raw)], LINES))
    a, b, c, d, e, f = t.orderBy("line_id").collect()
    assert a.ordinal is None and a.turn_id is None and a.name is None and a.role == "user" and a.timestamp is not None
    assert json.loads(a._rescued) == {"ordinal": "7", "payload": {"tool_name": "Read", "turn_id": 1, "model": {"name": "m"}, "x": {"y": None, "z": [1]}, "deep": {}}}
    assert b.rec_type is None and b._rescued is None and c._rescued is None and d._rescued is None
    assert e.type is None and json.loads(e._rescued) == {"type": "\ud800", "\ud800": 1}
    assert f.rec_type == "5" and json.loads(f._rescued) == {"type": 5, "ordinal": 99999999999999999999, "payload": "p"}
    assert drift.profile(t).count() > 0
    approved = (drift.Field("ordinal", "bigint", ("ordinal",)), drift.Field("name", "string", ("payload.tool_name",)), drift.Field("turn_id", "string", ("payload.turn_id",)), drift.Field("model", "string", ("payload.model.name", "payload.model")))
    p = drift.promote(t, approved).orderBy("line_id").first()
    assert p.ordinal == 7 and p.name == "Read" and p.turn_id == "1" and p.model == "m" and json.loads(p._rescued) == {"payload": {"x": {"y": None, "z": [1]}, "deep": {}}}


def test_approvals_follow_renames(spark):
    report = spark.createDataFrame([("payload.name", "renamed", "payload.n2"), ("payload.n2", "renamed", "payload.n3"), ("payload.n3", "renamed", "payload.name"), ("payload.zzz", "renamed", "payload.y")], "field_path string, change string, new_path string")
    by = {f.name: f.paths for f in drift.approvals(report)}
    assert by["name"] == ("payload.name", "payload.n2", "payload.n3") and by["cwd"] == ("payload.cwd",)


def test_records_rules(spark):
    raw = [{"type": "session_meta", "ordinal": 0}, {"type": "response_item", "ordinal": 2, "payload": {"type": "function_call_output", "call_id": "c"}}, "x{"]
    lines = spark.createDataFrame([(i, 1, i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(raw)], LINES)
    assert {r.rule for r in sessions.validate(sessions.records(lines)).collect()} == {"parse", "ordinals", "result-without-call"}


def test_newer_than(spark):
    df = spark.createDataFrame([("0.105.0",), ("0.9",), ("x",)], "v string")
    assert [r.n for r in df.select(sessions.newer_than(F.col("v"), "0.104.2").alias("n")).collect()] == [True, False, None]


def test_reply_chains_are_followed_to_their_end(spark):
    from tessera.operators.reports import reply_chains

    rows = [("long", f"u{i}", f"u{i - 1}" if i else None, i) for i in range(450)]
    rows += [("ring", f"u{i}", f"u{(i - 1) % 7}" if i < 7 else f"u{i - 1}", i) for i in range(10)] + [("self", "a", "a", 0), ("lost", "b", "gone", 0)]
    df = spark.createDataFrame([(s, u, p, i, i, False) for s, u, p, i in rows], "session_id string, uuid string, parent_uuid string, row_id bigint, logged_at bigint, is_sidechain boolean")
    got = {r.session_id: (r.n_chain, r.ring) for r in reply_chains(df).collect()}
    assert got == {"long": (450, False), "ring": (10, True), "self": (1, True), "lost": (1, False)}
