"""Problem 6: conversations rebuilt from message rows.

Sessions of up to GROUP rows are streamed, sorted by session, through Kahn's algorithm: the reply graph is sorted topologically, ties by
time, and nodes left over lie on or behind a cycle. Larger sessions, of which one could hold a third of all rows, take pointer doubling
over the same nodes instead, which never brings a session into one task. Both give the same turns.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import cut, small_side

#: Most rows of a session that one task holds at a time (ids, flags and times only).
GROUP = 100_000
_VISIBLE = r"[^\s\p{Z}\p{C}]"
_OUT = "session_id string, turn_index int, row_id bigint, role string"


def message_rows(rows: DataFrame) -> DataFrame:
    """Each row as a node: session_id, row_id, uuid, parent, side, turn (holds a message that counts), role, at, ordinal, same (payload hash)."""
    msg = F.from_json("payload", "role string, content string")
    parts = F.from_json(msg["content"], "array<struct<text:string,content:string>>")
    inner = lambda c: F.array_join(F.transform(F.from_json(c, "array<struct<text:string>>"), lambda y: F.coalesce(y["text"], F.lit(""))), " ")
    listed = F.array_join(F.transform(parts, lambda x: F.concat_ws(" ", x["text"], F.when(x["content"].startswith("["), inner(x["content"])).otherwise(x["content"]))), " ")
    text = F.when(F.ltrim(msg["content"]).startswith("["), F.coalesce(listed, msg["content"])).otherwise(msg["content"])
    kind = (F.col("uuid").isNotNull() & F.col("rec_type").isin("user", "assistant") & ~F.coalesce("is_meta", F.lit(False))) | (F.col("uuid").isNull() & (F.col("rec_type") == "response_item"))
    return rows.where("session_id is not null and row_id is not null").select(
        F.col("session_id").cast("string"),
        F.col("row_id").cast("long"),
        "uuid",
        F.col("parent_uuid").alias("parent"),
        F.coalesce("is_sidechain", F.lit(False)).alias("side"),
        F.coalesce(kind & text.rlike(_VISIBLE), F.lit(False)).alias("turn"),
        msg["role"].alias("role"),
        F.unix_micros("logged_at").alias("at"),
        F.col("ordinal").cast("long"),
        F.xxhash64("payload").alias("same"),
    )


def _first_format(rows: list[tuple]) -> list[tuple]:
    """The line of a session of reply links, by Kahn's algorithm; [] for a broken one. rows: (row_id, uuid, parent, side, turn, role, at, ...)."""
    nodes: dict = {}
    for r in rows:
        key = r[1] if r[1] is not None else ("row", r[0])
        if key not in nodes or r[0] < nodes[key][0]:
            nodes[key] = r
    children: dict = {}
    open_to = []
    answered = set()
    for key, r in nodes.items():
        if r[2] is not None and r[2] in nodes:
            children.setdefault(r[2], []).append(key)
        else:
            open_to.append(key)
        if not r[3] and r[2] is not None:
            answered.add(r[2])
    rank = lambda key: (nodes[key][6] if nodes[key][6] is not None else -(1 << 62), nodes[key][0])
    heap = [(rank(k), i, k) for i, k in enumerate(open_to)]
    heapq.heapify(heap)
    order, count = [], len(heap)
    while heap:
        _, _, key = heapq.heappop(heap)
        order.append(key)
        for c in children.get(key, ()):
            heapq.heappush(heap, (rank(c), count, c))
            count += 1
    ends = [k for k, r in nodes.items() if not r[3] and k not in answered]
    if not ends:
        return []
    end = max(ends, key=rank)
    on_line = {end}
    line = []
    for key in reversed(order):
        if key in on_line:
            line.append(key)
            on_line.add(nodes[key][2])
    if not line or line[0] != end or nodes[line[-1]][2] is not None:
        return []  # the end is left over behind a cycle, or its line leads out of the session
    return [nodes[k] for k in reversed(line)]


def _second_format(rows: list[tuple]) -> list[tuple]:
    """The line of a session of ordinals; [] for a broken one."""
    at: dict = {}
    for r in rows:
        if r[7] is None:
            return []
        if r[7] in at and at[r[7]][8] != r[8]:
            return []
        if r[7] not in at or r[0] < at[r[7]][0]:
            at[r[7]] = r
    return [at[i] for i in range(len(at))] if all(i in at for i in range(len(at))) else []


def _turns(rows: list[tuple]) -> list[tuple[int, str]]:
    """(row_id, role) of each turn of a session that is kept."""
    line = _first_format(rows) if any(r[1] is not None for r in rows) else _second_format(rows)
    turns = [(r[0], r[5]) for r in line if r[4]]
    waiting = False
    for _, role in turns:
        if role == "user":
            if waiting:
                return []
            waiting = True
        elif role == "assistant":
            waiting = False
    return [] if waiting else turns


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by session to turns, a session at a time."""
    name, held = None, []
    out: list[list] = [[], [], [], []]

    def close() -> None:
        for i, (row_id, role) in enumerate(_turns(held)):
            for o, x in zip(out, (name, i, row_id, role), strict=True):
                o.append(x)

    def made() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string())
        b = pa.record_batch([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=["session_id", "turn_index", "row_id", "role"])
        for o in out:
            o.clear()
        return b

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[0] != name:
                if held:
                    close()
                name, held = row[0], []
            held.append(row[1:])
        yield made()
    if held:
        close()
    yield made()


def _double(nodes: DataFrame) -> DataFrame:
    """Turns of any number of sessions by pointer doubling; no session is brought into one task.

    A session of ordinals is a chain in which each ordinal names the one before it.
    """
    first = nodes.groupBy("session_id").agg(F.max(F.col("uuid").isNotNull()).alias("linked"))
    n = nodes.join(first, "session_id")
    key = F.when(F.col("linked"), F.coalesce("uuid", F.concat(F.lit("row "), F.col("row_id").cast("string")))).otherwise(F.coalesce(F.col("ordinal").cast("string"), F.lit("none")))
    up = F.when(F.col("linked"), F.col("parent")).otherwise(F.when(F.col("ordinal") > 0, (F.col("ordinal") - 1).cast("string")))
    n = n.select("session_id", "row_id", key.alias("k"), up.alias("up"), F.when(F.col("linked"), F.col("side")).otherwise(False).alias("side"), "turn", "role", F.when(F.col("linked"), F.col("at")).otherwise(F.col("ordinal")).alias("at"), "linked", "ordinal", "same")
    bad = n.where(~F.col("linked")).groupBy("session_id", "k").agg(F.min("same").alias("s"), F.max("same").alias("t"), F.max(F.col("ordinal").isNull() | (F.col("ordinal") < 0)).alias("none")).where("s <> t or none").select("session_id").distinct()
    n = n.join(bad, "session_id", "left_anti")
    n = n.groupBy("session_id", "k").agg(F.min(F.struct("row_id", "up", "side", "turn", "role", "at", "linked")).alias("m")).select("session_id", "k", "m.*")
    talk = F.when(F.col("turn") & F.col("role").isin("user", "assistant"), F.col("role"))
    n = cut(n.withColumn("talk", talk))
    known = n.select("session_id", F.col("k").alias("up"), F.lit(True).alias("there"))
    # a step leads to the parent: how many turns the way passes there, and who speaks last on it
    step = n.join(known, ["session_id", "up"], "left").join(n.select("session_id", F.col("k").alias("up"), F.col("turn").cast("int").alias("n"), F.col("talk").alias("near")), ["session_id", "up"], "left")
    step = cut(step.select("session_id", "k", F.when(F.col("there"), F.col("up")).alias("to"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "near", (F.col("up").isNotNull() & F.col("there").isNull()).alias("lost")))
    largest = n.groupBy("session_id").count().agg(F.max("count")).first()[0] or 1
    steps = [step]
    for _ in range(int(largest).bit_length()):
        if not steps[-1].where("to is not null").limit(1).count():
            break
        a = steps[-1]
        b = a.select("session_id", F.col("k").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"), F.col("near").alias("near2"), F.col("lost").alias("lost2"))
        steps.append(cut(a.join(b, ["session_id", "to"], "left").select("session_id", "k", F.col("to2").alias("to"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.coalesce("near", "near2").alias("near"), (F.col("lost") | F.coalesce("lost2", F.lit(False))).alias("lost"))))
    whole = steps[-1]  # the whole way up; with a place left to go it runs in a circle
    child = n.where("not side").select("session_id", F.col("up").alias("k")).where("k is not null").distinct()
    ends = n.where("not side").join(child, ["session_id", "k"], "left_anti").groupBy("session_id").agg(F.max_by("k", F.struct(F.coalesce("at", F.lit(-(1 << 62))), "row_id")).alias("k"))
    sound = cut(ends.join(whole, ["session_id", "k"]).where("to is null and not lost").select("session_id", "k"))
    line = sound
    for s in reversed(steps):
        line = cut(line.union(line.join(s, ["session_id", "k"]).where("to is not null").select("session_id", F.col("to").alias("k"))).distinct())
    turns = line.join(n, ["session_id", "k"]).join(whole.select("session_id", "k", F.col("n").alias("before"), "near"), ["session_id", "k"])
    # a question right behind a question, or at the end
    unanswered = turns.where("talk = 'user' and near = 'user'").select("session_id")
    last = sound.join(turns, ["session_id", "k"]).where(F.coalesce("talk", "near") == "user").select("session_id")
    gaps = line.join(n.where("not linked"), ["session_id", "k"]).groupBy("session_id").agg(F.count("*").alias("c"))
    short = n.where("not linked").groupBy("session_id").agg(F.count("*").alias("all")).join(gaps, "session_id", "left").where("c is null or c < all").select("session_id")
    out = turns.where("turn").join(unanswered.union(last).union(short).distinct(), "session_id", "left_anti")
    return out.select("session_id", F.col("before").cast("int").alias("turn_index"), "row_id", "role")


def conversations(rows: DataFrame, group: int = GROUP) -> DataFrame:
    """(session_id, turn_index, row_id, role): the turns, in order, of each sound session.

    - A message delivered again counts by its smallest row_id (format one: same uuid; format two: same ordinal and payload).
    - Ties of logged_at at the end of a session go to the larger row_id; a null logged_at is the earliest.
    - Rows without session_id or row_id are passed over. A payload that is no JSON has no text. Null flags are false.
    - A session with any uuid is format one; a null ordinal breaks a session of format two. Empty tables give no rows.
    """
    nodes = message_rows(rows)
    sizes = nodes.groupBy("session_id").count()
    large = cut(sizes.where(F.col("count") > group).select("session_id"))
    small, more = nodes, None
    if large.limit(1).count():
        large = small_side(large)
        small, more = nodes.join(large, "session_id", "left_anti"), nodes.join(large, "session_id", "left_semi")
    cols = ("session_id", "row_id", "uuid", "parent", "side", "turn", "role", "at", "ordinal", "same")
    out = small.select(*cols).repartition("session_id").sortWithinPartitions("session_id").mapInArrow(_stream, _OUT)
    return out if more is None else out.unionByName(_double(cut(more)))
