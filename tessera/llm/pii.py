"""Problem 2: personal details in free text, by a character-level bidirectional LSTM with CRF transitions, in numpy.

Every text is cut into overlapping windows from its first character to its last. The LSTM scores each character of a window; where
windows overlap, their scores are averaged by distance from the window's edge, and the best tags of the whole text reconcile them.
Found spans are checked for the form of their type and their ends moved to ends of words.
The weights are trained by ``python -m tessera.llm.pii_train`` and lie beside this module.
"""

from __future__ import annotations

import functools
import io
import math
import pkgutil
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import vectext as v

TYPES = ("email", "phone", "id_number", "address", "person")
#: Tags: outside, then begin and inside of each type.
K = 1 + 2 * len(TYPES)
WINDOW, OVERLAP = 128, 48
#: Windows scored at a time, and characters whose scores are held at a time.
BATCH, BLOCK = 384, 1 << 19
#: Characters whose scores are compared at a time.
PART = 1 << 13
#: Characters, padding included, of a batch of runs.
AREA = 1 << 16
#: Most given names that are sent to the tasks.
MAX_NAMES = 100_000

_OTHER = ("space", "digit", "upper", "lower", "letter", "mark")
V = 1 + 128 + len(_OTHER)
_cache: dict = {}
#: Which classes are of words: letters, digits and the underscore.
_WORD = np.array([130 <= c <= 133 or (c <= 128 and (chr(max(0, c - 1)).isalnum() or c - 1 == 95)) for c in range(V)])


def _char_table() -> np.ndarray:
    """Class of each code point: ASCII by itself, others by their kind."""
    if "chars" not in _cache:
        kind = lambda c: "space" if c[0] == "Z" else "digit" if c == "Nd" else "upper" if c == "Lu" else "lower" if c == "Ll" else "letter" if c[0] == "L" else "mark"
        cats = [*map(unicodedata.category, map(chr, range(sys.maxunicode + 1)))]
        of = {c: 129 + _OTHER.index(kind(c)) for c in set(cats)}
        t = np.fromiter(map(of.__getitem__, cats), np.uint8, len(cats))
        t[:128] = np.arange(1, 129)
        _cache["chars"] = t
    return _cache["chars"]


def _automaton(names: tuple[str, ...]):
    """Finds given names in lower-case text."""
    if ("automaton", names) not in _cache:
        import ahocorasick

        a = ahocorasick.Automaton()
        for n in names:
            a.add_word(n, len(n))
        a.make_automaton()
        _cache["automaton", names] = a
    return _cache["automaton", names]


def lowered(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def inputs(joined: str, codes: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    """Input ids of all texts' characters: their class, and whether they belong to a known given name."""
    cls = _char_table()[codes]
    word = np.zeros(len(codes) + 2, bool)
    word[1:-1] = _WORD[cls]
    ids = cls.astype(np.int64)
    if names and len(codes):
        hits = list(_automaton(names).iter(lowered(joined)))
        if hits:
            last, length = np.array(hits).T
            first = last - length + 1
            whole = ~word[first] & ~word[last + 2]
            step = np.zeros(len(codes) + 1, np.int64)
            np.add.at(step, first[whole], 1)
            np.add.at(step, last[whole] + 1, -1)
            ids[np.cumsum(step[:-1]) > 0] += V
    return ids


def windows(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the windows that cover the texts from end to end, in order, and the place of each within its text."""
    n = np.where(ends > starts, 1 + np.maximum(0, -((WINDOW - (ends - starts)) // (WINDOW - OVERLAP))), 0)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(starts, n) + place * (WINDOW - OVERLAP)
    return begin, np.minimum(begin + WINDOW, np.repeat(ends, n)), place


def lines(size: int) -> np.ndarray:
    """An array of floats to be filled that begins with a line of the cache: arithmetic over others reads most lines twice."""
    held = np.empty(size + 16, np.float32)
    skip = -held.ctypes.data // 4 % 16
    return held[skip : skip + size]


def in_lines(x: np.ndarray) -> np.ndarray:
    """A copy of x in such an array."""
    y = lines(x.size).reshape(x.shape)
    y[:] = x
    return y


@functools.lru_cache(1024)
def shares(n: int, before: bool, behind: int) -> np.ndarray | None:
    """What the scores of a window of n characters count for (n, K), by distance from the window's edge against that of the other window over
    a character; None: all of them whole. before: whether one precedes it in its text, which is never a shorter one; behind: characters of the next, or 0.

    At most two windows hold a character.
    """
    if not before and not behind:
        return None
    weight = lambda m: np.minimum(np.arange(1, m + 1), np.arange(m, 0, -1))
    own, step = weight(n), WINDOW - OVERLAP
    total = own.copy()
    if before:
        total[: WINDOW - step] += weight(WINDOW)[step : step + n]
    if behind:
        total[step:] += weight(behind)[: n - step]
    return np.repeat((own / total).astype(np.float32)[:, None], K, 1)


def room(n: int) -> int:
    """Rows in which the scores of n characters are made: whole windows, one before and one behind them."""
    return (2 + -(-n // WINDOW)) * WINDOW


def groups(starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The n characters in stretches of whole texts, as many as BLOCK holds; a longer text by itself."""
    out, lo, starts = [], 0, np.append(starts, n)
    while lo < n:
        hi = int(starts[np.searchsorted(starts, lo + BLOCK, "right") - 1])
        hi = hi if hi > lo else int(starts[np.searchsorted(starts, lo, "right")])
        out.append((lo, hi))
        lo = hi
    return out


class Tagger:
    """The trained network. Weights: table_f, table_b (2V x 4H, gates i f o g), hid_f, hid_b (H x 4H), out (2H x K), bias, trans, first, last.

    A sigmoid is (tanh(x / 2) + 1) / 2. States are kept doubled and the halves are in the weights, which powers of two leave exact.
    """

    def __init__(self, w: dict[str, np.ndarray]):
        self.h = n = w["hid_f"].shape[0]
        half = np.ones(4 * n, np.float32)
        half[: 3 * n] = 0.5
        by_gate = lambda x: x.reshape(-1, 4, n).transpose(1, 0, 2)
        # for each gate the rows of the first direction, behind them those of the second
        self.tables = in_lines(np.concatenate([by_gate(w[f"table_{d}"].astype(np.float32) * half) for d in "fb"], 1))
        self.hidden = in_lines(np.stack([by_gate(w[f"hid_{d}"].astype(np.float32) * half * np.float32(0.5)) for d in "fb"]))
        # scores beyond those of the tag outside, which leaves the best tags as they are
        self.out, self.bias = ((x - x[..., :1]) * scale for x, scale in ((w["out"].astype(np.float32), np.float32(0.5)), (w["bias"].astype(np.float32), np.float32(1))))
        self.trans, self.first, self.last = (w[k].astype(np.float32) for k in ("trans", "first", "last"))
        self._held: dict[str, np.ndarray] = {}

    @classmethod
    def load(cls) -> Tagger:
        if "tagger" not in _cache:
            with np.load(io.BytesIO(pkgutil.get_data("tessera.llm", "pii_model.npz"))) as f:
                _cache["tagger"] = cls({k: f[k] for k in f.files})
        return _cache["tagger"]

    def _space(self, name: str, *shape: int) -> np.ndarray:
        """An array to be filled, in memory that is kept; valid until the next call with the name."""
        size = math.prod(shape)
        if name not in self._held or self._held[name].size < size:
            self._held[name] = lines(size)
        return self._held[name][:size].reshape(shape)

    def _run(self, ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What either direction gives to the scores (batch, step, K) over ids (step, direction, batch), which the second direction has from the
        end; the shortest first. Places of the first count from the first step, those of the second back from the last; valid until the next call."""
        t, _, b = ids.shape
        n, half, one = self.h, np.float32(0.5), np.float32(1)
        ahead, back = self._space("ahead", b, t, K), self._space("back", b, t, K)
        ids = ids + np.array([[0], [self.tables.shape[1] // 2]])
        h, c = (np.zeros((2, b, n), np.float32) for _ in range(2))
        s, was = 0, -1
        for i in range(t):
            if lens[s] <= i:
                s = int(np.searchsorted(lens, i, "right"))  # those that have a character here
            if s != was:  # arrays of these alone, each in one piece
                gone, was = s - max(was, 0), s
                of = h[:, gone:].copy(), c[:, gone:].copy()
                h, c, x = (self._space(k, 2, b - s, n) for k in "hcx")
                h[:], c[:] = of
                z = self._space("z", 4, 2, b - s, n)
                zi, zf, zo, zg = z
                gates, states, by_direction = z[:3], h[:, None], z.transpose(1, 0, 2, 3)
                adds = [(table.take, to) for table, to in zip(self.tables, z, strict=True)]
            np.matmul(states, self.hidden, out=by_direction)
            at = ids[i, :, s:]
            for take, to in adds:
                take(at, 0, x, "clip")
                to += x
            np.tanh(z, out=z)
            gates += one
            c *= zf
            zi *= zg
            c += zi
            c *= half
            np.tanh(c, out=h)
            h *= zo
            np.matmul(h[0], self.out[:n], out=ahead[s:, i])
            np.matmul(h[1], self.out[n:], out=back[s:, t - 1 - i])
        return ahead, back

    def scores(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray, place: np.ndarray, lo: int, hi: int, sums: np.ndarray | None = None) -> np.ndarray:
        """Emission scores (hi - lo, K) of the characters from lo to hi by the windows over them, averaged by distance from the window's edge; outside has 0.

        sums: (room(hi - lo), K) in which they are made, else new memory.
        """
        pad = WINDOW
        if sums is None:
            sums = np.empty((room(hi - lo), K), np.float32)
        sums.reshape(-1, WINDOW, K)[:] = np.tile(self.bias, (WINDOW, 1))
        lens = end - begin
        before, behind = place > 0, np.zeros(len(lens), np.int64)
        behind[:-1] = np.where(before[1:], lens[1:], 0)
        order = np.argsort(lens, kind="stable")
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            n = lens[some]
            t = int(n[-1])
            time = np.arange(t)[:, None]
            first, last = begin[some], end[some] - 1
            e, back = self._run(np.stack((ids[np.minimum(first + time, last)], ids[np.maximum(last - time, first)]), 1), n)
            if same := n[0] == t:
                e += back
            for k, (m, x, *others) in enumerate(zip(n.tolist(), (first - lo + pad).tolist(), before[some].tolist(), behind[some].tolist(), strict=True)):
                own = e[k, :m]
                if not same:
                    own += back[k, t - m :]
                if (share := shares(m, *others)) is not None:
                    own *= share
                sums[x : x + m] += own
        return sums[pad : pad + hi - lo]

    def viterbi(self, emissions: list[np.ndarray], first: np.ndarray | None = None, last: np.ndarray | None = None) -> list[np.ndarray]:
        """The best tags of each run, given the scores of first and last tags for each run, else those of whole texts."""
        first = np.broadcast_to(self.first, (len(emissions), K)) if first is None else first
        last = np.broadcast_to(self.last, (len(emissions), K)) if last is None else last
        out: list = [None] * len(emissions)
        # longest first, as many at a time as keep the padded batch small
        order = sorted(range(len(emissions)), key=lambda i: -len(emissions[i]))
        at = 0
        while at < len(order):
            some = order[at : at + max(1, min(512, AREA // len(emissions[order[at]])))]
            at += len(some)
            lens = np.array([len(emissions[i]) for i in some])
            t = lens.max()
            e = np.zeros((t, len(some), K), np.float32)
            for k, i in enumerate(some):
                e[: lens[k], k] = emissions[i]
            s = first[some] + e[0]
            back = np.zeros((t, len(some), K), np.int8)
            final = np.empty((len(some), K), np.float32)
            final[lens == 1] = s[lens == 1]
            for i in range(1, t):
                x = s[:, :, None] + self.trans
                back[i] = x.argmax(1)
                s = np.take_along_axis(x, back[i][:, None, :].astype(np.int64), 1)[:, 0] + e[i]
                done = lens == i + 1
                final[done] = s[done]
            tag = (final + last[some]).argmax(1)
            tags = np.zeros((t, len(some)), np.int8)
            for i in range(t - 1, -1, -1):
                tags[i] = np.where(i < lens, tag, 0)
                step = back[i][np.arange(len(some)), tag]
                tag = np.where((i < lens) & (i > 0), step, tag)
            for k, i in enumerate(some):
                out[i] = tags[: lens[k], k]
        return out

    def _bounds(self) -> tuple[float, float, float]:
        """What transitions give at most to a run of other tags, against outside throughout: for each character, and once at its end; and the
        most at a text's first character beyond the first of these.

        With potentials of the longest ways from outside, every transition within a run gives at most the greatest mean of a circle.
        """
        w = (self.trans - self.trans[0, 0]).astype(np.float64)
        inner, power, each = w[1:, 1:], w[1:, 1:], -np.inf
        for n in range(1, K):
            each = max(each, power.diagonal().max() / n)
            power = (power[:, :, None] + inner[None]).max(1)
        phi = w[0, 1:] - each
        for _ in range(K):
            phi = np.maximum(phi, (phi[:, None] + inner).max(0) - each)
        leave = max((w[1:, 0] + phi).max(), (self.last[1:] - self.last[0] + phi).max())
        return each, leave, max(0.0, (self.first[1:] - self.first[0] - phi).max() - each)

    def outside(self, gain: np.ndarray, opens: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Which characters the best tags surely leave outside, where no run of other tags over them can be better than outside throughout.

        gain: the greatest score of another tag; opens, text: which characters are the first of their text, and which are of a text.
        """
        each, leave, enter = self._bounds()
        gain = gain + np.float32(each)
        gain[opens] += np.float32(enter)
        gain[~text] = -1e6  # no run goes over a gap
        total = np.zeros(len(gain) + 1)
        np.cumsum(gain, dtype=np.float64, out=total[1:])
        run = np.maximum.accumulate(total[:0:-1])[::-1]
        run -= np.minimum.accumulate(total[:-1])  # the best sum of a run over each character
        return ~text | (run + leave < -1e-3)

    def tag(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The best tags of texts that lie at starts to ends of ids; 0 between them.

        The best path passes the tag outside wherever that is sure, so what lies between such places is decided by itself. Scores of a group
        of texts are dropped as soon as that is known for all of it.
        """
        begin, end, place = windows(starts, ends)
        tags = np.zeros(len(ids), np.int8)
        n = len(ids)
        text, opens, closes = np.zeros(n + 1, np.int8), np.zeros(n, bool), np.zeros(n, bool)
        some = ends > starts
        text[starts[some]], text[ends[some]] = 1, -1
        text = np.cumsum(text[:-1], dtype=np.int8) > 0
        opens[starts[some]] = closes[ends[some] - 1] = True
        places, kept = [np.zeros(0, np.int64)], [np.zeros((0, K), np.float32)]
        for lo, hi in groups(starts, n):
            gain, parts = np.empty(hi - lo, np.float32), []
            for at in range(lo, hi, BLOCK):
                to = min(hi, at + BLOCK)
                a, b = np.searchsorted(end, at, "right"), np.searchsorted(begin, to)
                e = self.scores(ids, begin[a:b], end[a:b], place[a:b], at, to, self._space("sums", room(to - at), K))
                for k in range(0, to - at, PART):
                    some = e[k : k + PART]
                    g = gain[at - lo + k :][: len(some)]
                    np.maximum(some[:, 1], some[:, 2], out=g)
                    for tag in range(3, K):
                        np.maximum(g, some[:, tag], out=g)
                parts.append(e if to == hi else e.copy())
            open_ = np.flatnonzero(~self.outside(gain, opens[lo:hi], text[lo:hi]))
            places.append(open_ + lo)
            cuts = np.searchsorted(open_, np.arange(BLOCK, hi - lo, BLOCK))
            kept += [e[x - i * BLOCK] for i, (e, x) in enumerate(zip(parts, np.split(open_, cuts), strict=True))]
        at, e = np.concatenate(places), np.concatenate(kept)
        if len(at):
            cuts = np.flatnonzero(np.diff(at) > 1) + 1
            first, last = at[np.concatenate(([0], cuts))], at[np.concatenate((cuts - 1, [len(at) - 1]))]
            before = np.where(opens[first][:, None], self.first, self.trans[0])
            behind = np.where(closes[last][:, None], self.last, self.trans[:, 0])
            tags[at] = np.concatenate(self.viterbi(np.split(e, cuts), before, behind))
        return tags


_LETTERS = re.compile(r"[^\W\d_]")
_FORMS = {
    "email": re.compile(r"(?:.*(?:@|%40|[\[(]at[\])]).+)\Z", re.S | re.I),
    "phone": re.compile(r"(?=(?:\D*\d){7})(?:[+(]|0|\d{3}[\s.\-/]\d{3}[\s.\-/]\d)[\d\s().\-/]*(?:\D{0,8}\d{1,5})?\Z", re.S),
    "id_number": re.compile(r"(?:(?=(?:\D*\d){9})|(?=.*[A-Z])(?=(?:\D*\d){6}))[A-Z0-9][\w\s.\-/]*\Z", re.S),
    "address": re.compile(r"(?=.*\d)(?=.*[A-ZÀ-Þ][^\W\d_]{2}|.*[^\W\d_]{3,} [^\W\d_]{3,}).{6,}\Z", re.S),
    "person": re.compile(r"(?!.*[^\W\d_A-Z]{3}[A-Z])[^\W\d_][^\d_@/\\{}()<>=;:]*[\s ][^\d_@/\\{}()<>=;:]*[^\W\d_]\Z", re.S),
}
#: Words before a name that are no part of it (fixed values): titles, greetings, thanks.
_BEFORE_NAME = re.compile(
    r"(?:mr|mrs|ms|miss|dr|prof|sir|herr|frau|mme|mlle|monsieur|madame|sr|sra|srta|don|doña|thanks|thank you|hello|hi|hey|dear|danke|hallo|liebe[rn]?|merci|bonjour|cher|chère|gracias|hola|estimad[oa])\b\.?,?\s+",
    re.I,
)


def _checked(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The span with its ends at ends of words, or None where it has not the form of its type."""
    while a > 0 and (text[a - 1].isalnum() or text[a - 1] == "_") and (text[a].isalnum() or text[a] == "_") and kind != "email":
        a -= 1
    while a < b and not (text[a].isalnum() or (kind == "phone" and text[a] in "+(")):
        a += 1
    while b > a and not (text[b - 1].isalnum() or (kind == "person" and text[b - 1] == ".")):
        b -= 1
    while b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
        b += 1
    if kind == "person":
        while m := _BEFORE_NAME.match(text, a, b):
            a = m.end()
    if kind in ("phone", "id_number") and a and (text[a - 1] in ".@_/" or text[a - 1].isalnum()):
        return None
    return (a, b) if b > a and _FORMS[kind].match(text[a:b]) else None


def detect(texts: list[str], names: tuple[str, ...], tagger: Tagger | None = None) -> list[tuple[int, int, int, str]]:
    """(text number, start, end, type) of each detail, in order; texts of any length."""
    tagger = tagger or Tagger.load()
    codes, starts, ends = v.codes_of(texts)
    tags = tagger.tag(inputs("\n".join(texts), codes, names), starts, ends)
    kinds = np.where(tags > 0, (tags + 1) // 2, 0)
    # a span begins with any tag that does not go on with the one before, and ends where the next is no inside of its type
    goes_on = np.zeros(len(tags) + 1, bool)
    goes_on[1:-1] = (tags[1:] > 0) & (tags[1:] % 2 == 0) & (kinds[1:] == kinds[:-1])
    goes_on[starts] = False
    first, last = np.flatnonzero((tags > 0) & ~goes_on[:-1]), np.flatnonzero((tags > 0) & ~goes_on[1:])
    out = []
    for a, b, i in zip(first, last + 1, np.searchsorted(starts, first, "right") - 1, strict=True):
        base, kind = int(starts[i]), TYPES[kinds[a] - 1]
        if span := _checked(texts[i], int(a) - base, int(b) - base, kind):
            out.append((int(i), *span, kind))
    out.sort()
    kept: list[tuple[int, int, int, str]] = []
    for x in out:
        if not kept or x[0] != kept[-1][0] or x[1] >= kept[-1][2]:
            kept.append(x)
    return kept


def name_list(given_names: DataFrame) -> tuple[str, ...]:
    """The given names in lower case; a table of more than MAX_NAMES names is refused."""
    rows = given_names.where("length(trim(given_name)) > 1").select(F.lower(F.trim("given_name")).alias("n")).distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} given names")
    return tuple(sorted(r.n for r in rows))


def _beside(items: DataFrame) -> DataFrame:
    """The rows with copies of a text in one task, one behind the other: a copy costs its way there, far less than to be gone through."""
    return items.repartition("text").sortWithinPartitions(F.xxhash64("text"))


def _detected(texts: list[str], names: tuple[str, ...]) -> list[list[tuple[int, int, str]]]:
    """The details of each text; equal texts are gone through once."""
    by: dict[str, list[tuple[int, int, str]]] = {t: [] for t in texts}
    each = list(by)
    for i, a, e, kind in detect(each, names):
        by[each[i]].append((a, e, kind))
    return [by[t] for t in texts]


def _find(names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for src, uid, block, text in v.chunks([c.to_pylist() for c in b.columns], 3):
                f = [(i, *x) for i, found in enumerate(_detected(text, names)) for x in found]
                at = [x[0] for x in f]
                yield pa.record_batch(
                    [pa.array([src[i] for i in at], pa.string()), pa.array([uid[i] for i in at], pa.int64()), pa.array([block[i] for i in at], pa.int32()), pa.array([x[3] for x in f], pa.string()), pa.array([x[1] for x in f], pa.int32()), pa.array([x[2] for x in f], pa.int32())],
                    names=["src", "item_uid", "block", "pii_type", "start_pos", "end_pos"],
                )

    return run


def find(items: DataFrame, given_names: DataFrame) -> DataFrame:
    """One row for each personal detail: src, item_uid, block, pii_type, start_pos, end_pos (characters from 0).

    items: src, item_uid, block, text, other columns are ignored. Null texts have none; repeated items each have their rows; texts of any length are gone through whole.
    """
    cols = ["src", F.col("item_uid").cast("long"), F.col("block").cast("int"), "text"]
    return _beside(items.where("text is not null").select(*cols)).mapInArrow(_find(name_list(given_names)), "src string, item_uid bigint, block int, pii_type string, start_pos int, end_pos int")


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    """text with each span of (start, end, type) as a placeholder like [EMAIL]; spans in order, none overlapping."""
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def mask(items: DataFrame, given_names: DataFrame) -> DataFrame:
    """items' src, item_uid, block and ``masked``: the text with every detail as a typed placeholder and otherwise unchanged, n_found; a null text stays null."""
    names = name_list(given_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for src, uid, block, text in v.chunks([c.to_pylist() for c in b.columns], 3):
                found = _detected(text, names)
                made = [masked(t, x) for t, x in zip(text, found, strict=True)]
                yield pa.record_batch([pa.array(src, pa.string()), pa.array(uid, pa.int64()), pa.array(block, pa.int32()), pa.array(made, pa.string()), pa.array(list(map(len, found)), pa.int32())], names=["src", "item_uid", "block", "masked", "n_found"])

    done = _beside(items.select("src", F.col("item_uid").cast("long"), F.col("block").cast("int"), "text").where("text is not null")).mapInArrow(run, "src string, item_uid bigint, block int, masked string, n_found int")
    none = items.where("text is null").select("src", F.col("item_uid").cast("long"), F.col("block").cast("int"), F.lit(None).cast("string").alias("masked"), F.lit(0).alias("n_found"))
    return done.unionByName(none)
