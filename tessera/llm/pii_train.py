"""Training of the tagger of ``pii`` in numpy: ``python -m tessera.llm.pii_train SCALE_DIR [MINUTES [on]]``; on: from the weights that are there.

Labels come from ``pii_labels`` on at most ROWS texts, half segments and half blocks of turns; windows are those that the tagger sees, over all the text. A tenth of the
texts is held out; the weights with the best held-out score are kept in pii_model.npz.
"""

from __future__ import annotations

import functools
import random
import sys
import time
from pathlib import Path

import numpy as np
import pyarrow.dataset as ds

from tessera.llm import pii, pii_labels
from tessera.llm import vectext as v

#: Bound of the labelled sample.
ROWS = 40_000
HIDDEN = 32
BATCH = 192


_spans = functools.lru_cache(2 * ROWS)(pii_labels.spans)


def _digits(form: str, rng: random.Random) -> str:
    return "".join(rng.choice("0123456789") if c == "#" else c for c in form)


#: Forms of numbers, in which # is a digit.
PHONES = (
    "+1 ### 555 01##", "(###) 555-01##", "###-555-01##", "###.555.01##", "### 555 01##", "###-555-01## ext. ##", "+44 1632 960###", "01632 960 ###", "01632 960###", "+44 (0)1632 960 ###",
    "+49 30 23125 ###", "030 23125 ###", "+33 1 99 00 ## ##", "01 99 00 ## ##", "+34 91# ### ###", "+1###55501##", "+44163296####", "+4930231250##", "(###) 555-01## ext. ##",
)
IDS = ("9##-##-####", "9## ## ####", "QQ######C", "QQ ## ## ## A", "QQ ## ## ## C", "QQ######B", "X########", "00 ### ### ###")


def _person(x: str, rng: random.Random, names: list[str], surnames: list[str]) -> str:
    """Another name in one of the forms: given and surname in either order, with initials, in other case."""
    given = rng.choice(names).capitalize() if rng.random() < 0.7 else rng.choice("BCDFGHJKLMNOPRSTVWYZ") + "".join(rng.choice("aeiouylnrstmdk") for _ in range(rng.randint(3, 6)))
    last = rng.choice(surnames)
    if rng.random() < 0.12:
        last += "-" + rng.choice(surnames)
    n = rng.random()
    middle = rng.choice("ABCDEFGHIJKLMNOPRSTVWZ") + ". " if rng.random() < 0.12 else ""
    x = f"{last}, {given}" if n < 0.28 else f"{rng.choice('ABCDEFGHIJKLMNOPRSTVWYZ')}. {last}" if n < 0.45 else f"{given} {middle}{last}"
    n = rng.random()
    return x.upper() if n < 0.08 else x.lower() if n < 0.16 else x


def _vary(text: str, spans: list, rng: random.Random, names: list[str], pool: dict[str, list[str]]) -> tuple[str, list]:
    """The text with half of its details replaced by others of their type, in other forms, cases and with other white space."""
    out, made, at, size = [], [], 0, 0
    for a, b, kind in spans:
        x = text[a:b]
        if rng.random() < 0.6:
            if kind == "person":
                x = _person(x, rng, names, pool["surname"])
            elif kind == "phone" and not text[:a].endswith(("tel:", "+")):
                x = _digits(rng.choice(PHONES), rng)
            elif kind == "id_number" and x[0] in "9Q":
                x = _digits(rng.choice(IDS[:6]), rng)
            else:
                x = "".join(rng.choice("0123456789") if c.isdigit() and kind != "email" and i > 1 else c for i, c in enumerate(rng.choice(pool[kind]) if kind in ("email", "address") and "%40" not in x else x))
        if rng.random() < 0.15 and kind != "email":
            at_ = [i for i, c in enumerate(x) if c == " "]
            if at_:
                i = rng.choice(at_)
                x = x[:i] + rng.choice(" \n") + x[i + 1 :]
        if kind == "email" and rng.random() < 0.1 and "%40" not in x:
            x = x.upper()
        out += [text[at:a], x]
        size += a - at
        made.append((size, size + len(x), kind))
        size += len(x)
        at = b
    return "".join([*out, text[at:]]), made


def pools(texts: list[str]) -> dict[str, list[str]]:
    """Values of each type that stand in texts, and surnames."""
    pool: dict[str, list[str]] = {k: [] for k in (*pii.TYPES, "surname")}
    for t in texts:
        for a, b, kind in pii_labels.spans(t):
            x = t[a:b]
            pool[kind].append(x)
            if kind == "person" and not x.isupper() and not x.islower():
                last = x.split(",")[0] if "," in x else x.split()[-1]
                pool["surname"] += [p for p in last.split("-") if p[:1].isupper() and len(p) > 3]
    pool["email"] = [x for x in pool["email"] if "%40" not in x]
    return pool


def windows(texts: list[str], names: tuple[str, ...], rng: random.Random | None, pool: dict[str, list[str]] | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Input ids and tags of the windows of texts; details vary where rng is given."""
    spans = [_spans(t) for t in texts]
    if rng:
        varied = [_vary(t, s, rng, list(names), pool) if s else (t, s) for t, s in zip(texts, spans, strict=True)]
        texts, spans = [t for t, _ in varied], [s for _, s in varied]
    xs, ys = [], []
    for some, labels in v.chunks([texts, spans], 0):
        codes, starts, ends = v.codes_of(some)
        ids = pii.inputs("\n".join(some), codes, names)
        tags = np.zeros(len(codes), np.int64)
        for s, found in zip(starts, labels, strict=True):
            for a, b, kind in found:
                t = pii.TYPES.index(kind)
                tags[s + a : s + b] = 2 + 2 * t
                tags[s + a] = 1 + 2 * t
        begin, end, _ = pii.windows(starts, ends)
        for a, b in zip(begin, end, strict=True):
            xs.append(ids[a:b])
            ys.append(tags[a:b])
    return xs, ys


def new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    h, k = HIDDEN, pii.K
    w = {}
    for d in "fb":
        w[f"table_{d}"] = rng.normal(0, 0.1, (2 * pii.V, 4 * h))
        w[f"table_{d}"][:, h : 2 * h] += 1.0  # forget less at first
        w[f"hid_{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h)) * 0.5
    w |= {"out": rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, k)), "bias": np.zeros(k), "trans": np.zeros((k, k)), "first": np.zeros(k), "last": np.zeros(k)}
    return {n: x.astype(np.float32) for n, x in w.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(w, ids, d):
    t, b = ids.shape
    h = HIDDEN
    hs, cs = np.zeros((t + 1, b, h), np.float32), np.zeros((t + 1, b, h), np.float32)
    gates = np.empty((t, b, 4 * h), np.float32)
    for i in range(t):
        z = w[f"table_{d}"][ids[i]] + hs[i] @ w[f"hid_{d}"]
        z[:, : 3 * h] = _sigmoid(z[:, : 3 * h])
        z[:, 3 * h :] = np.tanh(z[:, 3 * h :])
        gates[i] = z
        cs[i + 1] = z[:, h : 2 * h] * cs[i] + z[:, :h] * z[:, 3 * h :]
        hs[i + 1] = z[:, 2 * h : 3 * h] * np.tanh(cs[i + 1])
    return hs, cs, gates


def _backward(w, grads, ids, d, hs, cs, gates, dh_out):
    t, b = ids.shape
    h = HIDDEN
    dh, dc = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
    dz = np.empty((t, b, 4 * h), np.float32)
    for i in range(t - 1, -1, -1):
        g = gates[i]
        tc = np.tanh(cs[i + 1])
        dh = dh + dh_out[i]
        dc = dc + dh * g[:, 2 * h : 3 * h] * (1 - tc * tc)
        z = dz[i]
        z[:, :h] = dc * g[:, 3 * h :] * g[:, :h] * (1 - g[:, :h])
        z[:, h : 2 * h] = dc * cs[i] * g[:, h : 2 * h] * (1 - g[:, h : 2 * h])
        z[:, 2 * h : 3 * h] = dh * tc * g[:, 2 * h : 3 * h] * (1 - g[:, 2 * h : 3 * h])
        z[:, 3 * h :] = dc * g[:, :h] * (1 - g[:, 3 * h :] ** 2)
        dc = dc * g[:, h : 2 * h]
        dh = z @ w[f"hid_{d}"].T
    flat = dz.reshape(-1, 4 * h)
    grads[f"hid_{d}"] = hs[:-1].reshape(-1, h).T @ flat
    order = np.argsort(ids.ravel(), kind="stable")
    sorted_ids = ids.ravel()[order]
    at = np.flatnonzero(np.concatenate(([True], sorted_ids[1:] != sorted_ids[:-1])))
    table = np.zeros_like(w[f"table_{d}"])
    table[sorted_ids[at]] = np.add.reduceat(flat[order], at)
    grads[f"table_{d}"] = table


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def _crf(w, e, tags, lens):
    """Loss, and gradients by emissions, transitions, first and last."""
    t, b, k = e.shape
    alpha = np.empty_like(e)
    alpha[0] = w["first"] + e[0]
    for i in range(1, t):
        alpha[i] = _lse(alpha[i - 1][:, :, None] + w["trans"], 1) + e[i]
    rows = np.arange(b)
    z = _lse(alpha[lens - 1, rows] + w["last"], 1)
    beta = np.zeros_like(e)
    beta[lens - 1, rows] = w["last"]
    d_trans = np.zeros((k, k), np.float32)
    for i in range(t - 1, 0, -1):
        x = (beta[i] + e[i])[:, None, :] + w["trans"]
        live = i < lens
        pair = np.exp(alpha[i - 1][:, :, None] + x - z[:, None, None])
        d_trans += pair[live].sum(0)
        beta[i - 1] = np.where(live[:, None], _lse(x, 2), beta[i - 1])
    live = (np.arange(t)[:, None] < lens)[:, :, None]
    d_e = np.where(live, np.exp(alpha + beta - z[:, None]), 0).astype(np.float32)
    d_first, d_last = d_e[0].sum(0), d_e[lens - 1, rows].sum(0)
    gold = w["first"][tags[0]] + w["last"][tags[lens - 1, rows]]
    np.subtract.at(d_first, tags[0], 1)
    np.subtract.at(d_last, tags[lens - 1, rows], 1)
    ti, bi = np.nonzero(live[:, :, 0])
    d_e[ti, bi, tags[ti, bi]] -= 1
    np.add.at(gold, bi, e[ti, bi, tags[ti, bi]])
    ti, bi = np.nonzero(live[1:, :, 0])
    np.add.at(gold, bi, w["trans"][tags[ti, bi], tags[ti + 1, bi]])
    np.subtract.at(d_trans, (tags[ti, bi], tags[ti + 1, bi]), 1)
    return float((z - gold).sum()), d_e, d_trans, d_first, d_last


def step(w, xs, ys) -> tuple[float, dict[str, np.ndarray]]:
    """Loss of a batch by sequence, and the gradients of all weights."""
    lens = np.array([len(x) for x in xs])
    t, b = lens.max(), len(xs)
    ids, back, tags = (np.zeros((t, b), np.int64) for _ in range(3))
    for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
        ids[: lens[k], k], back[: lens[k], k], tags[: lens[k], k] = x, x[::-1], y
    flip = np.where(np.arange(t)[:, None] < lens, lens - 1 - np.arange(t)[:, None], np.arange(t)[:, None])
    cols = np.arange(b)
    f, bk = _forward(w, ids, "f"), _forward(w, back, "b")
    both = np.concatenate([f[0][1:], bk[0][1:][flip, cols]], axis=2)
    e = both @ w["out"] + w["bias"]
    loss, d_e, d_trans, d_first, d_last = _crf(w, e, tags, lens)
    d_both = d_e @ w["out"].T
    grads = {"out": both.reshape(-1, 2 * HIDDEN).T @ d_e.reshape(-1, pii.K), "bias": d_e.sum((0, 1)), "trans": d_trans, "first": d_first, "last": d_last}
    _backward(w, grads, ids, "f", *f, d_both[:, :, :HIDDEN])
    _backward(w, grads, back, "b", *bk, d_both[:, :, HIDDEN:][flip, cols])
    return loss / b, {n: g / b for n, g in grads.items()}


def score(texts: list[str], names: tuple[str, ...], w) -> dict[str, tuple[int, int, int]]:
    """By type: labelled, found, and both, as (text, start, type)."""
    tagger = pii.Tagger(w)
    out = {k: [0, 0, 0] for k in pii.TYPES}
    for (some,) in v.chunks([texts], 0):
        got = {(i, a, k) for i, a, _, k in pii.detect(some, names, tagger)}
        want = {(i, a, k) for i, t in enumerate(some) for a, _, k in pii_labels.spans(t)}
        for j, s in enumerate((want, got, got & want)):
            for x in s:
                out[x[2]][j] += 1
    return {k: tuple(x) for k, x in out.items()}


def main(folder: str, minutes: float = 6, on: bool = False) -> None:
    texts = ds.dataset(f"{folder}/segments.parquet").head(ROWS // 2, columns=["text"]).column("text").to_pylist()
    turns = ds.dataset(f"{folder}/turns.parquet").head(ROWS // 2, columns=["blocks"]).column("blocks").to_pylist()
    texts += [b["text"] for t in turns for b in t or []][: ROWS // 2]
    texts = sorted({t for t in texts if t})
    names = tuple(sorted({n.lower() for n in ds.dataset(f"{folder}/given_names.parquet").to_table(columns=["given_name"]).column(0).to_pylist() if n}))
    rng, nrng = random.Random(7), np.random.default_rng(7)
    rng.shuffle(texts)
    held, texts = texts[: len(texts) // 10], texts[len(texts) // 10 :]
    rich = [t for t in texts if pii_labels.spans(t)]
    pool = pools(texts)
    w = new_weights(nrng)
    if on:
        with np.load(Path(__file__).with_name("pii_model.npz")) as f:
            w = {n: f[n].astype(np.float32) for n in w}
    m, s = ({n: np.zeros_like(x) for n, x in w.items()} for _ in range(2))
    best = -1.0
    if on:
        by = score(held, names, w)
        best = 2 * sum(x[2] for x in by.values()) / max(1, sum(x[0] + x[1] for x in by.values()))
        print(f"held-out F1 before {best:.4f}", by, flush=True)
    began, n, round_ = time.time(), 0, 0
    while (gone := (time.time() - began) / 60 / minutes) < 1:
        # texts with details come twice, in two variants
        xs, ys = windows(texts + rich, names, rng, pool)
        pos = [i for i, y in enumerate(ys) if y.any()]
        neg = [i for i, y in enumerate(ys) if not y.any()]
        rng.shuffle(neg)
        use = pos + neg[: 2 * len(pos)] if round_ % 4 != 3 else pos + neg
        use.sort(key=lambda i: (len(xs[i]) // 16, rng.random()))
        batches = [use[i : i + BATCH] for i in range(0, len(use), BATCH)]
        rng.shuffle(batches)
        total = 0.0
        for batch in batches:
            rate = (0.002 if on else 0.006) * max(0.03, 0.5 * (1 + np.cos(np.pi * min(1.0, (time.time() - began) / 60 / minutes))))
            loss, grads = step(w, [xs[i] for i in batch], [ys[i] for i in batch])
            total += loss
            n += 1
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            clip = min(1.0, 5.0 / (size + 1e-9))
            for k, g in grads.items():
                g = g * clip
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(s[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
        round_ += 1
        by = score(held, names, w)
        a, b, c = (sum(x[j] for x in by.values()) for j in range(3))
        f1 = 2 * c / max(1, a + b)
        print(f"{gone:.2f} round {round_} loss {total / len(batches):.4f} held-out F1 {f1:.4f}", by, flush=True)
        if f1 >= best:
            best = f1
            np.savez_compressed(Path(__file__).with_name("pii_model.npz"), **{k: x.astype(np.float16) if k.startswith(("table", "hid")) else x for k, x in w.items()})


if __name__ == "__main__":
    main(sys.argv[1], *map(float, sys.argv[2:3]), on=sys.argv[3:4] == ["on"])
