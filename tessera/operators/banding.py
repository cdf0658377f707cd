"""Lossy transforms of code and calls: lines by structural depth, elision of runs, thinning of words."""

from __future__ import annotations

import ast
import json
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx

# fixed value
ELISION = "… ({n} lines elided)"
_NUMBER = re.compile(tx.NUMBERED)
_TOKEN = re.compile(r"\w+|[^\w\s]")


def count_tokens(text: str) -> int:
    """The fallback tokenizer of functions.text, in Python."""
    return len(_TOKEN.findall(text))


def indent_bands(lines: list[str]) -> list[int]:
    """Rank of each line's indent among those that occur; a blank line has the rank of the next."""
    widths = [len(x) - len(x.lstrip()) if x.strip() else None for x in lines]
    rank = {w: i for i, w in enumerate(sorted({w for w in widths if w is not None}))}
    out, after = [], 0
    for w in reversed(widths):
        after = after if w is None else rank[w]
        out.append(after)
    return out[::-1]


_HEADS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_SHOWN = (ast.Import, ast.ImportFrom, ast.Return)


def python_bands(text: str) -> list[int] | None:
    """Depth of each line by Python's own parser: 0 for definitions with their decorators and docstrings, imports and returns; else the
    number of blocks around its statement. None where the text does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines = text.split("\n")
    band: list[int | None] = [None] * len(lines)

    def put(first: int, last: int, value: int) -> None:
        for i in range(first - 1, min(last, len(band))):
            band[i] = value

    todo: list[tuple[ast.stmt, int]] = [(s, 0) for s in reversed(tree.body)]
    while todo:
        node, depth = todo.pop()
        body = getattr(node, "body", None)
        if isinstance(node, _HEADS):
            top = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            put(node.lineno, node.end_lineno or node.lineno, depth + 1)
            put(top, max(node.body[0].lineno - 1, node.lineno), 0)
            doc = node.body[0] if ast.get_docstring(node, clean=False) is not None else None
            if doc is not None:
                put(doc.lineno, doc.end_lineno or doc.lineno, 0)
        else:
            doc = None
            put(node.lineno, node.end_lineno or node.lineno, 0 if isinstance(node, _SHOWN) else depth)
        inner = [s for part in ("body", "orelse", "finalbody") for s in (getattr(node, part, None) or []) if isinstance(s, ast.stmt)]
        inner += [s for h in getattr(node, "handlers", []) for s in h.body] + [s for c in getattr(node, "cases", []) for s in c.body]
        if body is not None:
            todo += [(s, depth + 1) for s in reversed(inner) if s is not doc]
    out, after = [], 0
    for i in range(len(lines) - 1, -1, -1):
        if lines[i].strip():
            after = band[i] if band[i] is not None else 0
        out.append(after)
    return out[::-1]


def band_lines(text: str, lang: str | None) -> list[int]:
    """Structural depth of each line: by a parser for Python, by indent for all else."""
    found = python_bands(text) if lang == "python" else None
    return indent_bands(text.split("\n")) if found is None else found


def elided(lines: list[str], keep: list[bool]) -> str:
    """Kept lines; each run of others as one mark, where that is cheaper."""
    out, i = [], 0
    while i < len(lines):
        if keep[i]:
            out.append(lines[i])
            i += 1
            continue
        j = next((k for k in range(i, len(lines)) if keep[k]), len(lines))
        run = lines[i:j]
        first = next((x for x in run if x.strip()), "")
        mark = first[: len(first) - len(first.lstrip())] + ELISION.format(n=j - i)
        out += [mark] if count_tokens("\n".join(run)) > count_tokens(mark) else run
        i = j
    return "\n".join(out)


def _numbered(text: str) -> tuple[list[str], list[str]]:
    """Line numbers of a numbered dump and the lines without them; else empty prefixes."""
    lines = text.split("\n")
    found = [_NUMBER.match(x) for x in lines]
    hits = sum(m is not None for m in found)
    if hits < 3 or hits < 0.8 * sum(1 for x in lines if x.strip()):
        return [""] * len(lines), lines
    prefixes = [m[0] if m else "" for m in found]
    return prefixes, [x[len(p) :] for x, p in zip(lines, prefixes, strict=True)]


def quantized(text: str, lang: str | None, quality: float, carries=None) -> str:
    """Code whose lines deeper than quality allows are elided: 1 is verbatim, 0 leaves the interface. Lines for which carries holds stay."""
    if not 0.0 <= quality <= 1.0:
        raise ValueError("quality must be in [0, 1]")
    if quality >= 1.0 or not text.strip():
        return text
    prefixes, lines = _numbered(text)
    bands = band_lines("\n".join(lines), lang)
    most = max(bands, default=0)
    limit = min(most, math.floor(quality * (most + 1)))
    keep = [b <= limit or (carries is not None and carries(x)) for b, x in zip(bands, lines, strict=True)]
    return elided([p + x for p, x in zip(prefixes, lines, strict=True)], keep)


_STALE = ("old_string", "old_str")
_PATHS = ("file_path", "path", "notebook_path")
_BY_EXT = tx.LANGUAGES


def _call(payload: dict, quality: float) -> dict:
    """A call's arguments without stale ones, with code-like strings quantized, to a depth of three."""
    path = next((payload[k] for k in _PATHS if isinstance(payload.get(k), str)), "")
    lang = _BY_EXT.get(path.rpartition(".")[2].lower()) if "." in path else None

    def of(v, depth: int):
        if isinstance(v, str) and v.count("\n") >= 2:
            return quantized(v, lang, quality)
        if depth and isinstance(v, dict):
            return {k: of(x, depth - 1) for k, x in v.items() if k not in _STALE}
        if depth and isinstance(v, list):
            return [of(x, depth - 1) for x in v]
        return v

    return {k: v if k in _PATHS else of(v, 2) for k, v in payload.items() if k not in _STALE}


def quantized_call(text: str, quality: float) -> str:
    """A tool call shrunk to its arguments' interface, or as it was where that is not cheaper."""
    if quality >= 1.0:
        return text
    try:
        payload = json.loads(text)
    except (ValueError, RecursionError):
        payload = None
    if not isinstance(payload, dict):
        return quantized(text, None, quality)
    out = "\n".join(f"{k}: {v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)}" for k, v in _call(payload, quality).items())
    return out if out.strip() and count_tokens(out) < count_tokens(text) else text


def quantize(segments: DataFrame, quality: float, tool_quality: float | None = None) -> DataFrame:
    """segments with text and tokens of code and calls quantized and nothing protected; other kinds and null texts as they are."""

    @F.pandas_udf("string")
    def run(kind: pd.Series, lang: pd.Series, text: pd.Series) -> pd.Series:
        depth = quality if tool_quality is None else tool_quality
        return pd.Series([None if t is None else quantized_call(t, depth) if k == "tool_use" else quantized(t, g, quality) for k, g, t in zip(kind, lang, text, strict=True)], dtype=object)

    mine = F.col("kind").isin("code", "tool_use")
    lang = tx.language(F.lit(None).cast("string"), F.lit(None).cast("string"), tx.without_numbers(F.col("text")))
    text = F.when(mine, run(F.col("kind"), F.when(F.col("kind") == "code", lang), F.when(mine, F.col("text")))).otherwise(F.col("text"))
    return segments.withColumn("text", text).withColumn("tokens", tx.token_count(F.col("text"))).withColumn("protected", F.when(mine, F.lit(False)).otherwise(F.col("protected")))


def indent_band_expr(c: Column) -> Column:
    """indent_bands as an expression: an array of ranks by line."""
    lines = F.split(c, "\n")
    width = F.transform(lines, lambda x: F.when(~tx.blank(x), F.length(x) - F.length(F.regexp_replace(x, r"^\s+", ""))))
    known = F.array_sort(F.array_distinct(F.filter(width, lambda w: w.isNotNull())))
    rank = F.transform(width, lambda w: F.when(w.isNotNull(), F.array_position(known, w).cast("int") - 1))
    filled = F.aggregate(
        F.reverse(rank), F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("after")),
        lambda s, r: F.struct(F.concat(s["out"], F.array(F.coalesce(r, s["after"]))).alias("out"), F.coalesce(r, s["after"]).alias("after")), lambda s: F.reverse(s["out"]),
    )
    return filled


#: Lines of tool output that speak of trouble.
ERROR_LINE = r"(?i)\b(?:error|exception|failed|failure|fatal|traceback|warning|cannot|not found|denied)\b"


def carrying_lines(c: Column) -> Column:
    """The lines that hold an atom or speak of an error."""
    from tessera.functions import atoms as at

    return F.filter(F.split(tx.without_numbers(c), "\n"), lambda x: (F.size(at.in_decoded(x)) > 0) | x.rlike(ERROR_LINE))


_WORDS = re.compile(r"\S+")


def thinned(text: str, bits: dict[str, float], protected: list[str], budget: int) -> str:
    """Text without its least surprising words, until it costs budget at most; words that hold a protected string stay.

    Words go by their bits per token, ties from the front; gaps close up to one space.
    """
    words = [(m.start(), m.end()) for m in _WORDS.finditer(text)]
    cost = count_tokens(text)
    gone: set[int] = set()
    free = [i for i, (a, b) in enumerate(words) if not any(p in text[a:b] for p in protected)]
    for i in sorted(free, key=lambda i: (bits.get(text[words[i][0] : words[i][1]].lower(), 0.0) / max(1, count_tokens(text[words[i][0] : words[i][1]])), i)):
        if cost <= budget:
            break
        gone.add(i)
        cost -= count_tokens(text[words[i][0] : words[i][1]])
    out = ""
    for i, (a, b) in enumerate(words):
        if i in gone:
            continue
        gap = text[words[i - 1][1] : a] if i and i - 1 not in gone else ("\n" if i and "\n" in text[words[i - 1][1] : a] else " " if out else "")
        out += (gap if out else "") + text[a:b]
    return out


def thin(segments: DataFrame, keep: float, kinds: tuple[str, ...] = ("prose", "tool_result")) -> DataFrame:
    """segments whose texts of the given kinds are thinned to keep of their tokens, by the words' frequency in their conversation."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\S+"), F.lit(0))).alias("word")
    counts = segments.select("conv_id", word).groupBy("conv_id", "word").agg(F.count("*").alias("c"))
    total = counts.groupBy("conv_id").agg(F.sum("c").alias("t"))
    bits = counts.join(total, "conv_id").select("conv_id", "word", (-F.log2(F.col("c") / F.col("t"))).alias("bits"))
    mine = segments.where(F.col("kind").isin(*kinds) & F.col("text").isNotNull())
    per = mine.select("conv_id", "seg_id", word).distinct().join(bits, ["conv_id", "word"]).groupBy("conv_id", "seg_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"))
    types = dict(segments.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            conv, seg, text, atoms, known = (c.to_pylist() for c in b.columns)
            out = [thinned(t, dict(k or []), a or [], math.ceil(keep * count_tokens(t))) for t, a, k in zip(text, atoms, known, strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.string())], names=["conv_id", "seg_id", "thin"])

    done = mine.select("conv_id", "seg_id", "text", "atoms").join(per, ["conv_id", "seg_id"], "left").select("conv_id", "seg_id", "text", "atoms", "bits").mapInArrow(run, f"conv_id {types['conv_id']}, seg_id {types['seg_id']}, thin string")
    out = segments.join(done, ["conv_id", "seg_id"], "left").withColumn("text", F.coalesce("thin", "text")).drop("thin")
    return out.withColumn("tokens", tx.token_count(F.col("text")))
