"""Schemas that drift between files (problem 4): rescue-column ingestion, and a report of each change.

``ingest`` parses every line once and enforces a target schema: a value that has a column and fits its type goes there, all else stays, as
JSON, in one rescue column. Nothing is lost: typed columns and ``_rescued`` make up the record again, and ``changes`` reads the paths,
types and kinds of values of each file from these alone. ``promote`` takes approvals, such as those that ``approvals`` draws from the report
of changes, and replays rescued values into typed columns, new or old.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import cut


@dataclass(frozen=True)
class Field:
    """A column of the target: its SQL type (string, bigint, double, boolean or timestamp) and the dotted paths, in order of preference,
    that are approved for it."""

    name: str
    kind: str
    paths: tuple[str, ...] = field(default=())


#: The fields that the session logs had from the start.
TARGET = (
    Field("timestamp", "timestamp", ("timestamp",)),
    Field("ordinal", "bigint", ("ordinal",)),
    Field("type", "string", ("type",)),
    Field("payload_type", "string", ("payload.type",)),
    Field("payload_id", "string", ("payload.id",)),
    Field("role", "string", ("payload.role",)),
    Field("name", "string", ("payload.name",)),
    Field("call_id", "string", ("payload.call_id",)),
    Field("arguments", "string", ("payload.arguments",)),
    Field("output", "string", ("payload.output",)),
    Field("cwd", "string", ("payload.cwd",)),
    Field("cli_version", "string", ("payload.cli_version",)),
    Field("turn_id", "string", ("payload.turn_id",)),
)

_TYPES = {str: "string", int: "number", float: "number", bool: "boolean", dict: "object", list: "array"}
_KINDS = (
    ("empty", re.compile(r"\s*\Z")),
    ("json", re.compile(r"\s*[{\[].*[}\]]\s*\Z", re.S)),
    ("time", re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d")),
    ("version", re.compile(r"v?\d+(\.\d+)+\w*\Z")),
    ("number", re.compile(r"[-+]?\d+(\.\d+)?\Z")),
    ("path", re.compile(r"(?:[A-Za-z]:)?[/\\~]\S*\Z")),
    ("hex", re.compile(r"(?=[0-9a-fA-F-]*\d)[0-9a-fA-F-]{7,}\Z")),
)
_ID = re.compile(r"([A-Za-z]+)[_-](?=\w*\d)\w+\Z")


def _kind(v) -> str:
    """What kind of value it is, finer than its JSON type; of a list, the kind of its first element."""
    depth = 0
    while isinstance(v, list) and v:
        v, depth = v[0], depth + 1
    return "array " * depth + _simple_kind(v)


def _simple_kind(v) -> str:
    if isinstance(v, str):
        if " " in v and v[0] not in " \t\r\n{[0123456789":
            return "text"  # no other kind begins so and holds a space
        for name, pattern in _KINDS:
            if pattern.match(v):
                return name
        if m := _ID.match(v):
            return f"id {m[1].lower()}"
        return "text" if re.search(r"\s", v) else "word"
    if isinstance(v, dict):
        return "object " + ",".join(sorted(v))
    if isinstance(v, list):
        return "array "
    return type(v).__name__


def _refuse(_: str):
    raise ValueError


def _parse(raw: str | None) -> dict | None:
    """The record of a line; None for a line that is no JSON object."""
    try:
        r = json.loads(raw, parse_constant=_refuse) if raw else None
    except (ValueError, RecursionError):
        return None
    return r if isinstance(r, dict) else None


def _rec_type(r: dict) -> str:
    name = r.get("type")
    name = name if isinstance(name, str) else json.dumps(name)
    inner = r["payload"].get("type") if isinstance(r.get("payload"), dict) else None
    return f"{name}:{inner if isinstance(inner, str) else json.dumps(inner)}" if inner is not None else name


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", tz="UTC")}


def _moment(v) -> datetime | None:
    """The time that a text of date, time and offset names."""
    try:
        t = datetime.fromisoformat(v) if isinstance(v, str) and len(v) > 15 and v.isascii() else None
        return t.astimezone(UTC) if t is not None and t.tzinfo is not None else None
    except (ValueError, OverflowError):
        return None


def _whole(v) -> bool:
    return type(v) is int and -(1 << 63) <= v < 1 << 63


def _safe(v: str | None) -> str | None:
    """A text that UTF-8 can hold: halves of surrogate pairs are spelled out."""
    return v if v is None or v.isascii() else v.encode("utf-8", "backslashreplace").decode()


def _text(v) -> str | None:
    """A text that UTF-8 can hold as it is."""
    return v if type(v) is str and (v.isascii() or _safe(v) == v) else None


#: By type of column, the value to store for a JSON value that has this very type; None for one that does not fit.
_FITS = {
    "string": _text,
    "bigint": lambda v: v if _whole(v) else None,
    "double": lambda v: float(v) if type(v) is float or _whole(v) else None,
    "boolean": lambda v: v if type(v) is bool else None,
    "timestamp": _moment,
}


def _compact(v) -> str:
    """JSON without spaces; characters are spelled out only where UTF-8 cannot hold one of them."""
    text = json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    return text if _text(text) is not None else json.dumps(v, separators=(",", ":"))


def _number(v):
    return int(v) if isinstance(v, str) and re.fullmatch(r"[-+]?\d{1,18}", v.strip()) else None


#: The same where an approval allows to convert: texts of numbers and booleans, and other values to their JSON text.
_CONVERTS = {
    "string": lambda v: _text(v) if type(v) is str else _compact(v),
    "bigint": lambda v: v if _whole(v) else _number(v),
    "double": lambda v: float(v) if type(v) is float or _whole(v) else _number(v),
    "boolean": lambda v: v if type(v) is bool else {"true": True, "false": False}.get(v) if type(v) is str else None,
    "timestamp": _moment,
}


def _taken(r: dict, steps: tuple[str, ...], fits) -> object:
    """The value at a path, taken out of the record where it fits; objects that are left empty by it go, too."""
    at, way = r, []
    for k in steps[:-1]:
        way.append(at)
        at = at.get(k)
        if type(at) is not dict:
            return None
    v = at.get(steps[-1])
    v = None if v is None else fits(v)
    if v is not None:
        del at[steps[-1]]
        for k, above in zip(reversed(steps[:-1]), reversed(way), strict=True):
            if above[k]:
                break
            del above[k]
    return v


def _steps(fields: tuple[Field, ...]) -> list[tuple[Field, list[tuple[str, ...]]]]:
    return [(f, [tuple(p.split(".")) for p in f.paths]) for f in fields]


def _column(name: str, kind: str) -> str:
    return f"`{name}` {kind}"


def ingest(lines: DataFrame, target: tuple[Field, ...] = TARGET) -> DataFrame:
    """One row for each line: line_id, file_id, line_no, rec_type, the columns of target, and ``_rescued``: the rest of the record, as JSON.

    A column takes values of its own JSON type only (a timestamp: texts with an offset); a value of another type is rescued. Lines that
    are no JSON object, or nested beyond Python's limit, have null in every column and in ``_rescued``. Null ids pass through; repeated lines stay repeated.
    """
    plan = _steps(target)

    none = [None] * (len(plan) + 2)

    def one(raw: str | None) -> list:
        r = _parse(raw)
        if r is None:
            return none
        try:
            kind = _safe(_rec_type(r))
            values = [next((v for w in ways if (v := _taken(r, w, _FITS[f.kind])) is not None), None) for f, ways in plan]
            return [kind, *values, _compact(r)]
        except RecursionError:
            return none

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), *(_ARROW[f.kind] for f in target), pa.string())
        for b in batches:
            cols = list(zip(*(one(x) for x in b.column(3).to_pylist()), strict=True)) or [()] * len(none)
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), *made], names=["line_id", "file_id", "line_no", "rec_type", *(f.name for f in target), "_rescued"])

    cols = [F.col("line_id").cast("long"), F.col("file_id").cast("long"), F.col("line_no").cast("int"), F.col("raw").cast("string")]
    return lines.select(*cols).mapInArrow(run, ", ".join(["line_id long, file_id long, line_no int, rec_type string", *(_column(f.name, f.kind) for f in target), "_rescued string"]))


def promote(table: DataFrame, approved: tuple[Field, ...]) -> DataFrame:
    """Replay rescued values into typed columns, new or old, and take them out of ``_rescued``.

    Only null cells are filled, from the first path of the approval that has a value which fits, or is of another type and converts; a value
    that does neither stays rescued. Nothing is read again but the table itself.
    """
    plan = _steps(approved)
    schema = {f.name: f.dataType.simpleString() for f in table.schema} | {f.name: f.kind for f in approved if f.name not in table.columns}
    if wrong := [f.name for f in approved if schema[f.name] != f.kind]:
        raise ValueError(f"approved with another type than the column's: {wrong}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(n).to_pylist() if n in b.schema.names else [None] * b.num_rows for n in {f.name for f in approved}}
            rest = b.column("_rescued").to_pylist()
            for i, text in enumerate(rest):
                if text is None or text == "{}":
                    continue
                r, moved = json.loads(text), False
                for f, ways in plan:
                    if cols[f.name][i] is None:
                        v = next((v for w in ways if (v := _taken(r, w, _CONVERTS[f.kind])) is not None), None)
                        cols[f.name][i] = v
                        moved |= v is not None
                if moved:
                    rest[i] = _compact(r)
            new = {n: pa.array(c, _ARROW[schema[n]]) for n, c in cols.items()} | {"_rescued": pa.array(rest, pa.string())}
            yield pa.record_batch([new[n] if n in new else b.column(n) for n in schema], names=list(schema))

    return table.mapInArrow(run, ", ".join(_column(n, k) for n, k in schema.items()))


#: The path at which new names of values are reported.
NAMED_VALUES = "payload.content[].type"
_PROFILE = "file_id long, rec_type string, path string, type string, kind string, value string, n long"


def _count(counts: dict, r: dict) -> None:
    """Adds each distinct (path, JSON type, kind of value, value at NAMED_VALUES) of a record, objects and lists themselves among them."""
    found = set()
    todo = [("", r)]
    while todo:
        path, v = todo.pop()
        t = type(v)
        if path:
            found.add((path, _TYPES[t], _kind(v), v if t is str and path == NAMED_VALUES else None))
        if t is dict:
            todo += [(f"{path}.{k}" if path else k, x) for k, x in v.items() if x is not None]
        elif t is list:
            todo += [(f"{path}[]", x) for x in v if x is not None]
    for x in found:
        counts[x] = counts.get(x, 0) + 1


def profile(table: DataFrame, target: tuple[Field, ...] = TARGET) -> DataFrame:
    """(file_id, rec_type, path, type, kind, value, n) of an ingested table: in how many records of a file each path stands, by type and
    kind of value. A record is made up of its typed columns and ``_rescued``; each task sends one row for each distinct one it has met in a
    batch."""
    plan = [(f.kind == "timestamp", f.paths[0].split(".")) for f in target]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict = {}
            files, types, rest, *cols = (c.to_pylist() for c in b.columns)
            for i, (f, t, text) in enumerate(zip(files, types, rest, strict=True)):
                if text is None:
                    continue
                r = json.loads(text)
                for (moment, steps), c in zip(plan, cols, strict=True):
                    if c[i] is not None:
                        at = r
                        for k in steps[:-1]:
                            at = at.setdefault(k, {})
                        at[steps[-1]] = "2000-01-01 00:00" if moment else c[i]
                _count(counts.setdefault((f, t), {}), r)
            rows = [(*of, _safe(path), t, _safe(kind), _safe(value), n) for of, by in counts.items() for (path, t, kind, value), n in by.items()]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file_id", "rec_type", "path", "type", "kind", "value", "n"])

    each = table.where("file_id is not null and rec_type is not null").select("file_id", "rec_type", "_rescued", *(f.name for f in target)).mapInArrow(run, _PROFILE)
    return each.groupBy("file_id", "rec_type", "path", "type", "kind", "value").agg(F.sum("n").alias("n"))


def _parent(path: str) -> str:
    return path.rpartition(".")[0]


def _distance(a: str, b: str) -> int:
    """Least number of single characters to change, add or leave out to make b of a."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _unlike(a: str, b: str) -> int:
    """How unlike two field names are, case and separators aside."""
    return _distance(*(re.sub(r"[_-]", "", x.rpartition(".")[2]).lower() for x in (a, b)))


_REPORT = "file_id long, rec_type string, field_path string, change string, new_path string"


def _dominant(paths: list[dict]) -> tuple[dict[str, tuple[str, str]], set[str]]:
    """The type and kind that most of each path's values have (ties: the first by name), and the values at NAMED_VALUES."""
    counts: dict[str, dict[tuple[str, str], int]] = {}
    for p in paths:
        by = counts.setdefault(p["path"], {})
        key = (p["type"], p["kind"])
        by[key] = by.get(key, 0) + p["n"]
    out = {}
    for path, by in counts.items():
        types: dict[str, int] = {}
        for (t, _), n in by.items():
            types[t] = types.get(t, 0) + n
        best = min(types, key=lambda t: (-types[t], t))
        out[path] = (best, min((k for k in by if k[0] == best), key=lambda k: (-by[k], k))[1])
    return out, {p["value"] for p in paths if p["value"] is not None}


def report(before: list[dict], after: list[dict]) -> list[tuple[str, str, str]]:
    """(field_path, change, new_path) between two shapes of a record type: what is below a changed path is left out, and renames are
    paired, best likeness of names first."""
    (old, old_values), (new, new_values) = _dominant(before), _dominant(after)
    gone, come = sorted(set(old) - set(new)), sorted(set(new) - set(old))
    typed = sorted(p for p in set(old) & set(new) if old[p][0] != new[p][0])
    changed = {*gone, *come, *typed}

    def above(p: str) -> bool:
        return any(p[:i] in changed for i, c in enumerate(p) if c in ".[" and i)

    gone, come = [p for p in gone if not above(p)], [p for p in come if not above(p)]
    places: dict[tuple, list[str]] = {}
    for p in come:
        places.setdefault((_parent(p), *new[p]), []).append(p)
    pairs = sorted((_unlike(a, b), a, b) for a in gone for b in places.get((_parent(a), *old[a]), ()))
    renamed: dict[str, str] = {}
    taken: set[str] = set()
    for _, a, b in pairs:
        if a not in renamed and b not in taken:
            renamed[a] = b
            taken.add(b)
    rows = [(p, "renamed", renamed[p]) if p in renamed else (p, "removed", "") for p in gone]
    rows += [(p, "added", "") for p in come if p not in taken] + [(p, "type_changed", "") for p in typed if not above(p)]
    if old_values and not old_values & new_values and NAMED_VALUES in old and NAMED_VALUES in new and NAMED_VALUES not in typed and not above(NAMED_VALUES):
        rows.append((NAMED_VALUES, "value_renamed", ""))
    return rows


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_id, rec_type, before, after) to the rows of the report."""
    for b in batches:
        rows = [(f, r, *x) for f, r, old, new in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in report(old, new)]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["file_id", "rec_type", "field_path", "change", "new_path"])


def changes(files: DataFrame, table: DataFrame, target: tuple[Field, ...] = TARGET) -> DataFrame:
    """Every change between a file and the one before it in its project, from the ingested table: file_id, rec_type, field_path, change,
    new_path.

    Files are in the order of (started_at, file_id), null starts first; files without a project or lines are compared with none.
    A record type counts where both files have it. Lines that are no JSON object, null lines and null ids are passed over; repeated
    lines change nothing. A path has the type and kind that most of its values have (ties: the first by name). Empty tables give no rows.

    A file's shape is one row for each record type, as long as its schema, so files of any number of lines are compared by one join.
    """
    order = Window.partitionBy("project").orderBy(F.col("started_at").asc_nulls_first(), "file_id")
    known = files.select(F.col("file_id").cast("long"), "project", "started_at").where("file_id is not null and project is not null").dropDuplicates(["file_id"])
    steps = known.select("file_id", F.lead("file_id").over(order).alias("next_id")).where("next_id is not null")
    shapes = cut(profile(table, target).groupBy("file_id", "rec_type").agg(F.collect_list(F.struct("path", "type", "kind", "value", "n")).alias("paths")))
    before = shapes.join(steps, "file_id").select(F.col("next_id").alias("file_id"), "rec_type", F.col("paths").alias("before"))
    both = before.join(shapes.select("file_id", "rec_type", F.col("paths").alias("after")), ["file_id", "rec_type"])
    return both.select("file_id", "rec_type", "before", "after").mapInArrow(_reports, _REPORT)


#: Most names of renamed fields of the target's own paths that one approval may hold.
MAX_APPROVED = 10_000


def approvals(report: DataFrame, target: tuple[Field, ...] = TARGET) -> tuple[Field, ...]:
    """Approvals that follow from a report of changes: for each column of target its own path, whose values of another type are converted, and
    every path that it was renamed to, over any number of renames, in the order of names.

    What reaches the driver is the distinct pairs of names, as many as schemas have; more than MAX_APPROVED are refused.
    """
    pairs = report.where("change = 'renamed'").select("field_path", "new_path").distinct().limit(MAX_APPROVED + 1).collect()
    if len(pairs) > MAX_APPROVED:
        raise ValueError("too many renamed fields to approve at once")
    after: dict[str, set[str]] = {}
    for p in pairs:
        after.setdefault(p.field_path, set()).add(p.new_path)
    own = {p for f in target for p in f.paths}
    out = []
    for f in target:
        met, todo = set(f.paths), list(f.paths)
        while todo:
            new = after.get(todo.pop(), set()) - met - (own - set(f.paths))
            met |= new
            todo += new
        out.append(Field(f.name, f.kind, (*f.paths, *sorted(x for x in met - set(f.paths) if "[" not in x))))
    return tuple(out)
