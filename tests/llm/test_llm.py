from __future__ import annotations

import itertools
import json
import os
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chunking, conversations, leakage, neardup, packing, pairs, pii, spans
from tessera.llm import vectext as v

WORDS = regex.compile(r"[\p{L}\p{N}]+")


def words(t):
    return WORDS.findall(t.lower())


# vectext


@given(st.lists(st.text(st.characters(max_codepoint=0x2FF), max_size=40), max_size=6))
@settings(max_examples=80, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    hashes, offsets = v.words_of(texts) if texts else (np.zeros(0), np.zeros(1, int))
    flat = [w for t in texts for w in words(t)]
    assert [len(words(t)) for t in texts] == np.diff(offsets).tolist()
    assert len(set(hashes.tolist())) == len(set(flat))
    by = dict(zip(flat, hashes.tolist(), strict=True))
    assert [by[w] for w in flat] == hashes.tolist()


def test_range_hash_depends_on_the_text_alone():
    codes, starts, ends = v.codes_of(["abcXYZ", "__XYZ", ""])
    h = v.RangeHash(codes)
    assert h(np.array([3]), np.array([6])) == h(np.array([starts[1] + 2]), np.array([ends[1]]))
    assert h(np.array([0]), np.array([3])) != h(np.array([3]), np.array([6]))


def test_winnow_leaves_no_window_without_a_choice():
    h = np.random.default_rng(0).integers(0, 50, 500).astype(np.uint64)
    m = v.winnow(h, 13)
    assert all(m[i : i + 13].any() for i in range(len(h) - 12))


# problem 1


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta one two three four five six seven eight nine ten red green blue".split()) + str(rng.randint(0, 30)) for _ in range(n))


def edited(rng, t):
    w = t.split()
    for _ in range(rng.randint(0, 4)):
        w[rng.randrange(len(w))] = "edit%d" % rng.randint(0, 99)
    return " ".join(w)


def close(rows):
    sets = {i: (tool, frozenset(zip(words(t), words(t)[1:], words(t)[2:]))) for i, tool, t in rows if t and len(words(t)) >= 25}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a][0] == sets[b][0] and len(sets[a][1] & sets[b][1]) >= 0.7 * len(sets[a][1] | sets[b][1]) - 1e-9}


SEG = "seg_uid bigint, tool_name string, text string, a int, id string, gram string"


def seg_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", None) for r in rows], SEG)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(0, None, None), (1, "t", ""), (2, None, "short text")]
    for base in range(12):
        t = sentence(rng, rng.randint(25, 60))
        rows += [(len(rows) + k, rng.choice([None, "Read", ""]), edited(rng, t)) for k in range(6)]
    rows = [(i, tool, t) for i, (_, tool, t) in enumerate(rows)]
    rows.append((500, None, sentence(rng, 3000)))
    got = [tuple(r) for r in neardup.similar_pairs(seg_frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == close(rows) and len(got) > 8


def test_near_duplicates_with_a_third_of_copies_and_the_report(spark):
    rng = random.Random(2)
    hot = sentence(rng, 40)
    rows = [(i, None, hot) for i in range(40)] + [(100 + i, None, sentence(rng, 40)) for i in range(80)] + [(300, None, hot + " more")]
    assert {tuple(r) for r in neardup.similar_pairs(seg_frame(spark, rows)).collect()} == close(rows)
    g = {r.seg_uid: r for r in neardup.similar_groups(seg_frame(spark, rows)).collect()}
    assert len(g) == 121 and g[39].class_id == 0 and g[39].n_copies == 40 and g[39].n_links == 1 and g[300].group_id == 0 and g[300].class_id == 300


def test_a_shared_template_pairs_nothing(spark, monkeypatch):
    rng = random.Random(9)
    head, tail = sentence(rng, 14), sentence(rng, 14)
    rows = [(i, None, f"{head} unique{i} other{i} third{i} {sentence(rng, 2)} {tail}") for i in range(60)]
    rows += [(100 + i, None, f"{head} same {i} {tail}") for i in range(6)]
    monkeypatch.setattr(neardup, "OFTEN", 10)
    order = np.zeros(neardup.BUCKETS, np.int64)
    sets = [s for _, s in neardup._sets([None] * len(rows), [t for _, _, t in rows], 3, 25)]
    np.add.at(order, (np.concatenate(sets) & np.uint64(neardup.BUCKETS - 1)).astype(np.int64), 1)
    batch = neardup.pa.record_batch([[r[i] for r in rows] for i in range(3)], names=["id", "tool", "text"])
    posted = Counter(g for b in neardup._prefixes(3, 25, 0.7, order)([batch]) for n, p in zip(b.column("solid").to_pylist(), b.column("prefix").to_pylist(), strict=True) for g in p[:n])
    assert max(posted.values()) <= 6
    assert {tuple(r) for r in neardup.similar_pairs(seg_frame(spark, rows)).collect()} == close(rows)


@pytest.mark.parametrize("heavy", [2, 5])
def test_split_members_lose_no_pair(spark, heavy):
    rng = random.Random(heavy)
    hot = sentence(rng, 40)
    rows = [(i, None, f"{hot} tail{i} {sentence(rng, 2)}") for i in range(30)] + [(100 + i, None, sentence(rng, 30)) for i in range(10)]
    got = [tuple(r) for r in neardup.similar_pairs(seg_frame(spark, rows), heavy=heavy).collect()]
    assert len(got) == len(set(got)) and set(got) == close(rows) and len(got) == 30 * 29 // 2


def test_large_classes_pair_all_their_members(spark, monkeypatch):
    from tessera.llm import classes

    members = [(i, 0) for i in range(130)] + [(200 + i, 200) for i in range(3)] + [(300, 300)]
    rep = dict(members)
    want = {(a, b) for a, b in itertools.combinations(sorted(rep), 2) if rep[a] == rep[b] or {rep[a], rep[b]} in ({0, 200}, {200, 300})}
    m, links = spark.createDataFrame(members, "id bigint, rep bigint"), spark.createDataFrame([(0, 200), (200, 300)], "a bigint, b bigint")
    for part in (classes.PART, 20):
        monkeypatch.setattr(classes, "PART", part)
        got = [tuple(r) for r in classes.expand(m, links).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_class_of_more_than_a_hundred_differing_texts_keeps_its_pairs(spark):
    rng = random.Random(3)
    hot = sentence(rng, 40)
    rows = [(i, None, hot.upper() if i % 2 else hot + "." * i) for i in range(110)] + [(300 + i, None, hot + f" more{i}") for i in range(2)]
    assert {tuple(r) for r in neardup.similar_pairs(seg_frame(spark, rows)).collect()} == close(rows)


def test_near_duplicates_of_nothing(spark):
    assert neardup.similar_pairs(seg_frame(spark, [])).count() == 0
    assert neardup.similar_groups(seg_frame(spark, [(1, None, None)])).count() == 0


def test_components_follow_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    got = neardup.components(spark.range(43), edges).collect()
    assert {r.id: r.root for r in got} == {i: 0 if i <= 40 else i for i in range(43)}


# problem 2

NAMES = ("greta", "marta", "tobias", "will")


def found(text):
    return {(text[a:b], k) for _, a, b, k in pii.detect([text], NAMES)}


def test_details_of_each_type():
    assert found("My name is Greta Lindholt and I own the parser in src/a.py.") == {("Greta Lindholt", "person")}
    assert found("You can reach Dr. Marta Wexberg at +49 30 23125 641 if the line band stops again.") == {("Marta Wexberg", "person"), ("+49 30 23125 641", "phone")}
    assert found("The ticket came from mailto:wexquist_t@inbox.test, id on file 948-52-1177.") == {("wexquist_t@inbox.test", "email"), ("948-52-1177", "id_number")}
    assert found("Ship the spare reader to 712 Saltergate Avenue, Coldmere, attention Marta Pellberg.") >= {("Marta Pellberg", "person")}


@pytest.mark.parametrize("text", ["Build 972-93-5818 of render_folder passed, build 944-96-1777 did not.", "Thanks Greta, the side branch is cleared and sessions/handle.rs is empty.", "The remote is git@forge.example:team/inlet_loom.git and the word counter is late.", "Pin ring@5443.66.4178 until the spill pass is moved.", "Trace id 48383-4033-1918-1706 belongs to the message row, not to gate_lock.", "Will SPAN_VIEW be skipped before the call ledger starts?", "", " \n", "14:05:30 ERROR stage_codec pinned 6211 in src/a.sql"])
def test_no_details(text):
    assert found(text) == set()


def test_long_texts_are_read_whole_and_masked_in_place():
    filler = "Only 44 of the diff view entries mention codec_anchor; the others point at `grids/tail.ts`. "
    text = filler * 300 + "Please send the report to greta.lindholt@mail.example once it is done. " + filler * 300
    hits = pii.detect([text, "", text], NAMES)
    assert [(i, text[a:b], k) for i, a, b, k in hits] == [(0, "greta.lindholt@mail.example", "email"), (2, "greta.lindholt@mail.example", "email")]
    _, a, b, k = hits[0]
    assert pii.masked(text, [(a, b, k)]) == text[:a] + "[EMAIL]" + text[b:]


def test_find_and_mask_frames(spark):
    items = spark.createDataFrame([("segments", 1, 0, None), ("turns", 2, 3, "Call (818) 555-0111 before you restart the cache."), ("turns", 2, 4, "")], "src string, item_uid bigint, block int, text string")
    names = spark.createDataFrame([("Greta", 3), (None, 1), ("", 0)], "given_name string, n_people int")
    assert [tuple(r) for r in pii.find(items, names).drop("end_pos").collect()] == [("turns", 2, 3, "phone", 5)]
    assert {(r.block, r.masked, r.n_found) for r in pii.mask(items, names).collect()} == {(0, None, 0), (3, "Call [PHONE] before you restart the cache.", 1), (4, "", 0)}
    assert pii.find(items.limit(0), names.limit(0)).count() == 0


def test_details_without_cue_or_dense_digits():
    assert found("Insurance: AB123456C.") == {("AB123456C", "id_number")}


def test_every_character_is_scored():
    scored = []

    class Seen(pii.Tagger):
        def scores(self, ids, begin, end, *rest):
            scored.extend(zip(begin.tolist(), end.tolist(), strict=True))
            return super().scores(ids, begin, end, *rest)

    texts = ["no digits, names or signs here", "", "x" * 127, "y" * 128, "plain words again " * 40, "z"]
    with np.load(f"{os.path.dirname(pii.__file__)}/pii_model.npz") as f:
        pii.detect(texts, NAMES, Seen({k: f[k] for k in f.files}))
    want, at = set(), 0
    for t in texts:
        want |= set(range(at, at + len(t)))
        at += len(t) + 1
    assert {i for a, b in scored for i in range(a, b)} == want


@pytest.mark.parametrize("block", [1 << 18, 300])
def test_tags_are_those_of_one_pass_over_each_text(monkeypatch, block):
    monkeypatch.setattr(pii, "BLOCK", block)
    filler = "Only 44 of the diff view entries mention codec_anchor. "
    texts = ["Insurance: AB123456C.", filler * 9 + "My name is Greta Lindholt and I own it. " + filler * 3 + "Call (818) 555-0111", "", "Q", "greta.lindholt@mail.example" * 30, filler * 20]
    codes, starts, ends = pii.v.codes_of(texts)
    ids, tagger = pii.inputs("\n".join(texts), codes, NAMES), pii.Tagger.load()
    e = tagger.scores(ids, *pii.windows(starts, ends), 0, len(ids))
    tags = tagger.tag(ids, starts, ends)
    some = [(a, b) for a, b in zip(starts, ends, strict=True) if b > a]
    for (a, b), want in zip(some, tagger.viterbi([e[a:b] for a, b in some]), strict=True):
        assert tags[a:b].tolist() == want.tolist()
    assert tags.any()


def test_scores_are_those_of_the_plain_network():
    texts = ["Call (818) 555-0111 before you restart the cache. " * 7, "", "Q", "My name is Greta Lindholt. ", "x" * 128, "plain words again " * 12]
    with np.load(f"{os.path.dirname(pii.__file__)}/pii_model.npz") as f:
        w = {k: f[k].astype(float) for k in f.files}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def states(ids, d):
        h, c, out = np.zeros(w["hid_f"].shape[0]), 0, []
        for i in ids:
            a, f, o, g = np.split(w[f"table_{d}"][i] + h @ w[f"hid_{d}"], 4)
            c = sigmoid(f) * c + sigmoid(a) * np.tanh(g)
            h = sigmoid(o) * np.tanh(c)
            out.append(h)
        return np.array(out)

    codes, starts, ends = pii.v.codes_of(texts)
    ids = pii.inputs("\n".join(texts), codes, NAMES)
    begin, end, place = pii.windows(starts, ends)
    sums, weights = np.zeros((len(ids), pii.K)), np.zeros((len(ids), 1))
    for a, b in zip(begin, end, strict=True):
        weight = np.minimum(np.arange(1, b - a + 1), np.arange(b - a, 0, -1))[:, None]
        sums[a:b] += weight * (np.hstack((states(ids[a:b], "f"), states(ids[a:b][::-1], "b")[::-1])) @ w["out"] + w["bias"])
        weights[a:b] += weight
    text, want = weights[:, 0] > 0, sums / np.maximum(weights, 1)
    got = pii.Tagger.load().scores(ids, begin, end, place, 0, len(ids))
    assert np.abs(got - (want - want[:, :1]))[text].max() < 1e-4


def test_scores_of_what_is_outside_are_not_kept(monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 1 << 15)
    texts = ["Only 44 of the diff view entries mention codec_anchor. " * 20, "Call (818) 555-0111 before you restart the cache."] * 400
    codes, starts, ends = pii.v.codes_of(texts)
    ids, tagger = pii.inputs("\n".join(texts), codes, NAMES), pii.Tagger.load()
    tracemalloc.start()
    try:
        tags = tagger.tag(ids, starts, ends)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert all(tags[a:b].any() for a, b in zip(starts[1::2], ends[1::2], strict=True))
    assert peak < 44 * len(ids)  # bytes of the scores of all characters


def test_copies_of_a_text_each_have_their_rows(spark):
    text = "Only 44 of the diff view entries mention codec_anchor. " * 4 + "Call (818) 555-0111 before you restart the cache."
    items = spark.createDataFrame([("segments", 1, 0, text), ("turns", 2, 3, text), ("turns", 2, 3, text), ("turns", 4, 0, text[:220])], "src string, item_uid bigint, block int, text string")
    names = spark.createDataFrame([("Greta", 3)], "given_name string, n_people int")
    assert sorted((r.src, r.item_uid, r.pii_type, text[r.start_pos : r.end_pos]) for r in pii.find(items, names).collect()) == [("segments", 1, "phone", "(818) 555-0111")] + [("turns", 2, "phone", "(818) 555-0111")] * 2


def test_gradients_by_differences():
    from tessera.llm import pii_train as t

    rng = np.random.default_rng(0)
    w = t.new_weights(rng)
    xs, ys = [rng.integers(1, 100, n) for n in (5, 3)], [rng.integers(0, pii.K, n) for n in (5, 3)]
    _, grads = t.step(w, xs, ys)
    for name, at in (("out", (3, 2)), ("trans", (1, 4)), ("hid_f", (2, 7)), ("hid_b", (4, 40)), ("table_f", (int(xs[0][1]), 3)), ("first", (int(ys[0][0]),))):
        values = []
        for d in (1e-2, -1e-2):
            v2 = {k: x.copy() for k, x in w.items()}
            v2[name][at] += d
            values.append(t.step(v2, xs, ys)[0])
        assert grads[name][at] == pytest.approx((values[0] - values[1]) / 2e-2, abs=2e-3), name


# problem 3

ITEMS = "src string, item_uid bigint, block int, kind string, text string"
LIMITS = "kind string, max_chars int, overlap_chars int"


@given(st.text(alphabet="ab .\n\r!é", min_size=0, max_size=700), st.integers(5, 120), st.integers(0, 80))
@settings(max_examples=120, deadline=None)
def test_pieces_cover_the_text_within_the_limit(text, most, overlap):
    ends = chunking.cuts(text, most, overlap)
    o = min(overlap, most // 2)
    assert ends[-1] == len(text) and ends == sorted(set(ends) | {len(text)})
    begins = [0, *[max(0, e - o) for e in ends[:-1]]]
    assert all(e - b <= most for b, e in zip(begins, ends, strict=True))


def test_cuts_are_at_natural_ends():
    text = " ".join(f"Sentence number {i} has a few words in it." for i in range(200))
    ends = chunking.cuts(text, 400, 40)
    assert all(text[e - 2 : e] == ". " for e in ends[:-1])


def test_an_edit_changes_only_near_pieces():
    rng = random.Random(3)
    text = " ".join(f"Line {rng.randint(0, 9999)} of {rng.choice('abcdefgh') * 5} says {rng.random():.4f}." for _ in range(600))
    changed = text[:6000] + "INSERTED WORDS " + text[6000:]
    a, b = ({t[x:y] for x, y in zip([0, *c[:-1]], c, strict=True)} for t, c in ((text, chunking.cuts(text, 600, 0)), (changed, chunking.cuts(changed, 600, 0))))
    assert len(a - b) <= 0.2 * len(a)


def test_oversized_frame(spark):
    items = spark.createDataFrame([("s", 1, 0, "code", " \r\n" + "x" * 10 + "\t\n"), ("s", 2, 0, "code", "y" * 11), ("s", 2, 0, "code", "y" * 11), ("s", 3, 0, "other", "z" * 99), ("s", 4, 0, None, "z" * 99), ("s", 5, 0, "code", None)], ITEMS)
    limits = spark.createDataFrame([("code", 10, None), ("code", 20, 3), ("other", None, 1), (None, 1, 1)], LIMITS)
    assert [tuple(r) for r in chunking.oversized(items, limits).collect()] == [("s", 2, 0)] * 2
    assert chunking.split_oversized(items.limit(0), limits).count() == 0


# problem 5


@pytest.mark.parametrize(
    ("q", "a", "want"),
    [
        ("What is it?", None, ["empty"]), ("What is it?", "​ \n", ["empty"]), ("What is it?", "<answer></answer>", ["empty"]), ("What is it?", "N/A", ["empty"]), ("What is it?", "(no answer)", ["empty"]), ("What is it?", "...", ["empty"]),
        ("Does it return null for x_y?", "No", []), ("What value does x_y have at the end?", "None", []), ("What is the limit of a?", "75 tokens", []), ("Which file holds it?", "`src/a.py`", []), ("How many?", "43!", []),
        ("Why was it cut?", "Because the line band was", ["truncated"]), ("Why was it cut?", "It was cut. See `vector_gly", ["truncated"]), ("Why was it cut?", "It was cut. The list (a_b", ["truncated"]), ("Why was it cut?", "```py\nx = 1", ["truncated"]), ("Why?", "Two things remain, and,", ["truncated"]),
        ("Why?", "I'm sorry, but I can't answer that.", ["refusal"]), ("Warum?", "Dabei möchte ich lieber nicht helfen.", ["refusal"]), ("Pourquoi ?", "Je préfère ne pas répondre.", ["refusal"]), ("¿Por qué?", "No me es posible ayudar con a_b.", ["refusal"]),
        ("Why was it moved?", "It can't, since a_b holds the lock and is not able to let go before step 3.", []), ("Why was it moved?", "It refused and said it could not open a/b.py while it was late.", []), ("Which error?", '"Sorry, a_b is not available", followed by KeyError.', []),
        ("Why was it cut?", "I'm sorry, but I can't answer that, bec", ["refusal", "truncated"]), ("Which file holds the value that a_b reads?", "Das ist src/a.py, direkt neben der Datei für die", ["other_language", "truncated"]), ("What is it?", "[no answer", ["empty", "truncated"]),
        ("Why was x_y moved in the late run?", "why was x_y moved in the late run", ["copied_question"]), ("Why was x_y moved in the late run?", "Why was x_y moved in the", ["copied_question", "truncated"]), ("Why was x_y moved in the late run?", "Q: Why was x_y moved in the late run?", ["copied_question"]), ("Why was x_y moved?", "Why was x_y moved? Why was x_y moved?", ["copied_question"]), ("What is the limit of a_b?", "What is the limit of a_b: 85 tokens", []),
        ("Which file holds the value that a_b reads?", "Das ist src/a.py, direkt neben der Datei für die Bewertung.", ["other_language"]), ("Which German message does it log?", 'It logs "Der Wert fehlt noch" and then stops the side branch at line 86.', []), ("Why was it late?", "Потому что файл был занят.", ["other_language"]),
    ],
)
def test_defects(spark, q, a, want):
    df = spark.createDataFrame([(1, q, a, "own", 3)], "probe_id bigint, q string, a string, defects string, _d_q int")
    assert pairs.with_defects(df).first().defects == want


def test_defects_without_a_question_or_rows(spark):
    df = spark.createDataFrame([(1, None, "Fine, it is so."), (2, None, None), (2, None, None)], "probe_id bigint, q string, a string")
    assert sorted(tuple(r) for r in pairs.defective(df).collect()) == [(2, "empty"), (2, "empty")]
    assert pairs.all_defects(df.limit(0)).count() == 0


# problem 6

CHAT = "row_id bigint, session_id string, uuid string, parent_uuid string, rec_type string, is_sidechain boolean, is_meta boolean, ordinal int, payload string, logged_at timestamp"


def chat(spark, rows):
    import datetime as dt

    full = []
    for i, r in enumerate(rows):
        s, u, p, kind, role, text = r[:6]
        x = r[6] if len(r) > 6 else {}
        at = dt.datetime(2026, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=x.get("at", i))
        full.append((x.get("row", i), s, u, p, kind, x.get("side", False), x.get("meta"), x.get("ord"), None if role is None else json.dumps({"role": role, "content": text}), at))
    return spark.createDataFrame(full, CHAT)


def both(df):
    a, b = (sorted(tuple(r) for r in conversations.conversations(df, g).collect()) for g in (conversations.GROUP, 0))
    assert a == b
    return [(s, i, r) for s, i, r, _ in a]


def test_conversations_of_the_first_format(spark):
    rows = [
        ("a", "1", None, "user", "user", "q"), ("a", "2", "1", "assistant", "assistant", [{"type": "text", "text": "r"}]), ("a", "2", "1", "assistant", "assistant", [{"type": "text", "text": "r"}], {"row": 90}), ("a", "3", "2", "system", None, None, {"meta": True}), ("a", "x", "1", "assistant", "assistant", "left", {"at": -5}), ("a", "s", "3", "assistant", "assistant", "side", {"side": True, "at": 500}),
        ("lost", "1", "gone", "user", "user", "q"), ("lost", "2", "1", "assistant", "assistant", "r"), ("ring", "1", "2", "user", "user", "q"), ("ring", "2", "1", "assistant", "assistant", "r"), ("tail", "1", "2", "user", "user", "q"), ("tail", "2", "1", "user", "user", "q"), ("tail", "3", "2", "assistant", "assistant", "r"),
        ("blank", "1", None, "user", "user", " "), ("open", "1", None, "user", "user", "q"), ("twice", "1", None, "user", "user", "q"), ("twice", "2", "1", "user", "user", "q"), ("twice", "3", "2", "assistant", "assistant", "r"), ("self", "1", "1", "user", "user", "q"),
        ("tool", "1", None, "user", "user", "q"), ("tool", "2", "1", "user", "tool", [{"type": "tool_result", "content": "x"}]), ("tool", "3", "2", "assistant", "assistant", "r"),
    ]
    assert both(chat(spark, rows)) == [("a", 0, 0), ("a", 1, 1), ("tool", 0, 19), ("tool", 1, 20), ("tool", 2, 21)]


def test_conversations_of_the_second_format(spark):
    r = lambda s, o, role, t, **x: (s, None, None, x.pop("kind", "response_item"), role, t, {"ord": o, **x})
    rows = [r("a", 1, "assistant", "r"), r("a", 0, "user", "q"), r("a", 0, "user", "q"), r("a", 2, None, None, kind="event_msg"), r("gap", 0, "user", "q"), r("gap", 2, "assistant", "r"), r("two", 0, "user", "q"), r("two", 1, "assistant", "r"), r("two", 1, "assistant", "other"), r("null", None, "user", "q"), r("late", 1, "user", "q"), r("late", 2, "assistant", "r")]
    assert both(chat(spark, rows)) == [("a", 0, 1), ("a", 1, 0)]
    assert both(chat(spark, [])) == []


def test_random_sessions_agree(spark):
    rng = random.Random(8)
    rows = []
    for s in range(40):
        n = rng.randint(1, 9)
        for k in range(n):
            parent = None if k == 0 else str(rng.randrange(k)) if rng.random() < 0.9 else str(rng.randrange(n + 1))
            role = "user" if k % 2 == 0 else "assistant"
            rows.append((f"s{s}", str(k), parent, role, role, rng.choice(["text", "text", " "]), {"side": rng.random() < 0.1, "at": rng.randrange(50)}))
    both(chat(spark, rows))


# problem 7


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=15))
@settings(max_examples=80, deadline=None)
def test_plan_places_everything_once(histogram):
    planned = packing.plan(histogram, 40)
    placed = Counter()
    for n, held in planned:
        assert n > 0 and sum(held) <= 40
        for length in held:
            placed[length] += n
    assert placed == Counter(histogram)
    rooms = []  # best fit, longest first, one item at a time
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 40) - length)
    assert sum(n for n, _ in planned) == len(rooms)


def test_pack_frame(spark):
    texts = ["word " * n for n in (3000, 700, 700, 700, 10, 10)] + [None, "", " "]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, rank int")
    rows = packing.pack(d, capacity=1024).collect()
    counts = {r.id: r.n_tokens for r in packing.token_counts(d).collect()}
    by = Counter()
    for r in rows:
        by[r.doc_id] += r.n_tokens
    assert by == Counter({i: n for i, n in counts.items() if n})
    room = {}
    for r in sorted(rows, key=lambda r: (r.container_id, r.place)):
        assert r.offset == room.get(r.container_id, 0)
        room[r.container_id] = r.offset + r.n_tokens
    assert max(room.values()) <= 1024 and len({r.container_id for r in rows}) == 6
    assert packing.pack(d.limit(0)).count() == 0


def test_pack_with_a_third_of_one_length(spark):
    d = spark.createDataFrame([(i, "same words here" if i % 3 == 0 else "w " * (i % 50 + 1)) for i in range(600)], "doc_id bigint, text string")
    rows = packing.pack(d, capacity=64).collect()
    assert len(rows) == 600 and len({(r.container_id, r.place) for r in rows}) == 600
    assert packing.container_report(packing.pack(d, capacity=64), 64).first().used_part > 0.95


def test_checks_of_packings_see_what_is_lost_or_displaced(spark, tmp_path, monkeypatch):
    from tessera.llm.queries import p7_checks

    rows = [(i, f"word number {i} " * (i + 1)) for i in range(9)] + [(3, "word number 3 " * 4), (20, None), (21, ""), (None, "lost"), (22, "x y " * 5000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    pack = packing.pack
    assert [tuple(r) for r in p7_checks(spark, str(tmp_path)).collect()] == [(0, 0, 0, True)]  # document 3 comes twice
    monkeypatch.setattr(packing, "pack", lambda docs: pack(docs).where("doc_id != 5"))
    assert p7_checks(spark, str(tmp_path)).first().n_broken == 1
    # a piece moved onto another: as many tokens as before and the same end
    moved = F.when((F.col("doc_id") == 22) & (F.col("piece") == 0), F.col("first_token") + 7).otherwise(F.col("first_token"))
    monkeypatch.setattr(packing, "pack", lambda docs: pack(docs).withColumn("first_token", moved))
    assert p7_checks(spark, str(tmp_path)).first().n_broken == 1


# problem 8


def leaks(docs, items):
    grams = {}
    for i, p in items:
        w = words(p or "")
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(i)
    return {(d, i) for d, t in docs for k in range(len(words(t or "")) - 12) for i in grams.get(tuple(words(t)[k : k + 13]), ())}


@pytest.mark.parametrize("known", [10**6, 0])
def test_leaks_match_brute_force(spark, known):
    rng = random.Random(6)
    items = [(i, sentence(rng, rng.randint(5, 40))) for i in range(20)] + [(50, None), (51, "")]
    docs = [(100, None), (101, "")]
    for d in range(40):
        w = sentence(rng, 30).split()
        p = rng.choice(items)[1] or ""
        n = rng.randint(10, 16)
        k = rng.randint(0, 10)
        part = p.upper().split()[k : k + n]
        docs.append((d, " ".join([*w[:15], ", ".join(part), *w[15:]])))
    df = spark.createDataFrame([(*d, 0, 0) for d in docs], "doc_id bigint, text string, h int, item_id int")
    it = spark.createDataFrame(items, "item_id bigint, passage string")
    hits = leakage.leak_hits(df, it, known_hashes=known)
    got = {(r.doc_id, r.item_id) for r in hits.where("same = 13").collect()}
    assert got == leaks(docs, items) and got
    assert leakage.leaked(df.limit(0), it).count() == 0 and leakage.leaked(df, it.limit(0)).count() == 0


def test_substitutions_are_tolerated(spark):
    p = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    d = spark.createDataFrame([(1, p.replace("three", "THREE!").replace("nine", "changed"))], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, p)], "item_id bigint, passage string")
    r = leakage.leak_report(d, i).collect()
    assert [(x.doc_id, x.item_id, x.n_exact, x.best_same) for x in r] == [(1, 7, 0, 12)]


def test_any_two_substitutions_are_ignored_by_some_mask():
    pairs_of = itertools.combinations(range(13), 2)
    assert all(any(m[a] == m[b] == "0" for m in leakage.MASKS) for a, b in pairs_of) and {len(m) for m in leakage.MASKS} == {13}


@pytest.mark.parametrize("known", [10**6, 0])
def test_planted_substitutions_are_all_found(spark, known):
    rng = random.Random(11)
    items = [(k, sentence(rng, rng.randint(13, 30))) for k in range(60)]
    docs = []
    for k, p in items:
        w = p.split()
        for at in rng.sample(range(13), 2):
            w[at] = f"changed{rng.randint(0, 10**9)}"
        docs.append((k, f"{sentence(rng, 5)} {' '.join(w)} {sentence(rng, 7)}"))
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")
    hits = leakage.leak_hits(d, i, known_hashes=known).where("doc_id = item_id and same >= 11").select("doc_id").distinct()
    assert hits.count() == len(items)


# problem 9


def shared(docs, n=300):
    grams = {}
    for d, t in docs:
        for k in range(len(t or "") - n + 1):
            grams.setdefault(t[k : k + n], set()).add(d)
    return {p for g in grams.values() for p in itertools.combinations(sorted(g), 2)}


def prose(rng, n):
    return "".join(rng.choice(["word ", "next. ", "a ", "long_identifier_here ", "x1, ", "end!\n", "b64QQzz", "\n"]) + str(rng.randint(0, 999)) + " " for _ in range(n))


def report_of(docs, n=300):
    """doc_id to (shared_chars, removed_chars), by brute force."""
    first = {}
    for d, t in docs:
        for k in range(len(t or "") - n + 1):
            first.setdefault(t[k : k + n], set()).add(d)
    out = {}
    for d, t in docs:
        both = [set(), set()]
        for k in range(len(t or "") - n + 1):
            held = first[t[k : k + n]]
            for chars, hit in zip(both, (len(held) > 1, min(held) < d), strict=True):
                chars.update(range(k, k + n) if hit else ())
        out[d] = (len(both[0]), len(both[1]))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_shared_spans_match_brute_force(spark, monkeypatch, seed):
    from tessera.llm import classes

    monkeypatch.setattr(classes, "PART", [1024, 3][seed % 2])
    rng = random.Random(seed)
    pool = [prose(rng, 60) for _ in range(6)] + ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789abcdef") for _ in range(900))]
    docs = [(900, None), (901, "")]
    for d in range(30):
        src = rng.choice(pool)
        k = rng.randrange(max(1, len(src) - 330))
        cut = src[k : k + rng.choice([290, 299, 300, 301, 320, 500])]
        docs.append((d, prose(rng, rng.randint(0, 20)) + cut + prose(rng, rng.randint(0, 20))))
    docs += [(500, docs[5][1]), (501, "remark " * 10), (502, "remark " * 10), (503, "=" * 700), (504, "=" * 400)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, c int")
    got = [tuple(r) for r in spans.shared_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == shared(docs)
    assert {r.doc_id: (r.shared_chars, r.removed_chars) for r in spans.shared_report(df).collect()} == report_of(docs)


def test_shared_report(spark):
    rng = random.Random(4)
    a, b = prose(rng, 60), prose(rng, 60)
    df = spark.createDataFrame([(1, a + b), (2, a), (3, prose(rng, 50)), (4, None), (5, ""), (6, "tiny")], "doc_id bigint, text string")
    r = {x.doc_id: x for x in spans.shared_report(df).collect()}
    assert len(r) == 6 and r[1].removed_chars == 0 and r[1].shared_chars == len(a) and r[2].removed_chars == r[2].shared_chars == len(a)
    assert r[3].shared_chars == 0 and r[4].n_chars == 0 and r[4].shared_part is None and r[5].shared_part is None and r[6].shared_part == 0


def test_shared_spans_with_a_hot_remark_and_of_nothing(spark):
    rng = random.Random(5)
    remark = "This note was written by the compaction step. Verbatim segments follow in their order, and figures are left as they are. "
    remark = (remark * 3)[:285]
    docs = [(i, f"{rng.random()}{remark}{rng.random()}" + prose(rng, 40)) for i in range(90)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert spans.shared_pairs(df).count() == len(shared(docs)) == 0
    assert spans._held_by_many(spans.windows(df)[2], "start").count() == 0
    hot = [(100 + i, f"{rng.random()}{remark}. And so on to the end." + prose(rng, 4)) for i in range(70)]
    df2 = spark.createDataFrame(hot, "doc_id bigint, text string")
    assert spans._held_by_many(spans.windows(df2)[2], "start").count() >= 70 and {tuple(r) for r in spans.shared_pairs(df2).collect()} == shared(hot) and len(shared(hot)) == 70 * 69 // 2
    assert spans.shared_pairs(df.limit(0)).count() == 0
    assert spans.shared_report(df.limit(0)).count() == 0


def test_queries_are_registered():
    from tessera.llm.queries import QUERIES

    assert {f"p{n}_found" for n in (1, 2, 3, 5, 6, 8, 9)} | {"p7_packed"} <= set(QUERIES)


def test_nothing_else_imports_this_subpackage():
    import pathlib

    import tessera

    root = pathlib.Path(tessera.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "tessera.llm" in p.read_text()]
    _ = F
