"""Vector codes, resampling and decontamination against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import common, decontaminate, resampling, vector_codes
from tests.llm.data import awkward, empty, prose


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


@pytest.mark.parametrize("text", ["", "A-b_c 9x\x00y", "ÉtÉ 日本　x y \U0001f600", "don't [x]{y}~z|", "\x7f\x1f@`"])
def test_byte_words(text):
    assert [w.decode() for w in common.byte_words(text.encode())] == plain_words(text)


# vector codes


def plain_nearest(entries, x):
    return min((sum((a - b) ** 2 for a, b in zip(e, x)), i) for i, e in enumerate(entries))


@pytest.mark.parametrize("k,width,spread", [(1, 4, 100), (2, 1, 3), (64, 4, 300), (64, 2, 4), (17, 3, 1), (64, 4, 0), (64, 4, 1 << 27)])
def test_slices_and_masks_find_the_nearest_entry(k, width, spread):
    r = random.Random(k * width + spread)
    entries = [[r.randint(-spread, spread) for _ in range(width)] for _ in range(k)]
    points = [[r.randint(-2 * spread - 1, 2 * spread + 1) if spread < 1 << 27 else r.randint(-spread, spread) for _ in range(width)] for _ in range(400)] + entries
    index, distance = vector_codes.Nearest(np.array(entries)).find(np.array(points))
    assert list(zip(distance.tolist(), index.tolist())) == [plain_nearest(entries, p) for p in points]


def test_cube_holds_just_the_entries_within_the_radius():
    entries = np.array([[0, 0], [3, 1], [3, 9], [-4, 2]])
    mask = vector_codes.Nearest(entries).within(np.array([[1, 1], [50, 50]]), np.array([2, 2]))
    assert mask.tolist() == [0b0011, 0]


def plain_codes(rows, parts, entries, rounds):
    """rows: (id, vector, label)."""
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(x * 256))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fit = sorted((i, len(v)) for i, v, _ in kept if i is not None and v and len(v) % parts == 0)
    if not fit:
        return kept, None, {}
    size = fit[0][1]
    width = size // parts
    used = [v for _, v, _ in kept if len(v) == size]
    starts = sorted({i: min(v for j, v, _ in kept if j == i and len(v) == size) for i, v, _ in kept if i is not None and len(v) == size}.items())[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in starts] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in used:
                groups.setdefault(plain_nearest(books[p], cut(v, p))[1], []).append(cut(v, p))
            for e, g in groups.items():
                books[p][e] = [sum(c) // len(g) for c in zip(*g)]
    codes = {}
    for v in used:
        best = [plain_nearest(books[p], cut(v, p)) for p in range(parts)]
        codes[tuple(v)] = ("".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best))
    return kept, books, codes


def vectors(spark, rows, repeat=3):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, ints string, code string").repartition(repeat)


def awkward_vectors():
    r = random.Random(4)
    rows = [(i, [float(np.float32(r.gauss(0, 1))) for _ in range(8)], r.choice((0, 1, None))) for i in range(120)]
    rows += [rows[3], rows[3], (7, rows[9][1], 5), (None, rows[2][1], 1), (200, None, 1), (201, [1.0] * 7 + [None], 1), (202, [1.0] * 7 + [float("nan")], 2), (203, [float("inf")] + [0.0] * 7, 2)]
    rows += [(-1, [], 3), (-2, [0.5] * 7, 3), (204, [0.25] * 12, 4), (205, [3e38, -3e38] + [0.0] * 6, None), (206, rows[0][1], None)]
    return rows


@pytest.mark.parametrize("parts,entries,rounds", [(4, 16, 2), (2, 64, 1), (8, 3, 3)])
def test_codes_equal_plain_version(spark, parts, entries, rounds):
    rows = awkward_vectors()
    kept, books, codes = plain_codes(rows, parts, entries, rounds)
    got, got_books = vector_codes.compress(vectors(spark, [(*row, "x", "y") for row in rows]), parts=parts, entries=entries, rounds=rounds)
    assert got_books.tolist() == books
    want = Counter((i, lab, *codes.get(tuple(v), (None, None))) for i, v, lab in kept)
    assert Counter(tuple(r) for r in got.collect()) == want
    back = vector_codes.decode(got, got_books).collect()
    assert all((r.approx is None) == (r.code is None) for r in back)
    ints = {(i, tuple(v)) for i, v, _ in kept}
    for r in back:
        if r.code is not None and r.vec_id not in (None, 3, 7):
            v = next(v for i, v in ints if i == r.vec_id)
            assert sum((a - round(b * 256)) ** 2 for a, b in zip(v, r.approx)) == r.error


def test_codes_of_nothing_and_of_one_row(spark):
    assert vector_codes.compress(vectors(spark, [], 1))[0].count() == 0
    out, books = vector_codes.compress(vectors(spark, [(None, [1.0] * 16, 1, "", "")], 1))
    assert len(books) == 0 and [tuple(r) for r in out.collect()] == [(None, 1, None, None)]
    out, books = vector_codes.compress(vectors(spark, [(9, [1.0] * 16, None, "", "")], 1))
    assert books.shape == (16, 1, 1) and [tuple(r) for r in out.collect()] == [(9, None, "00" * 16, 0)]


def test_many_equal_vectors_are_one_code(spark):
    rows = [(i, [0.5] * 16 if i % 3 else [i / 100] * 16, i % 2, "", "") for i in range(600)]
    _, _, codes = plain_codes([r[:3] for r in rows], 16, 64, 2)
    got = vector_codes.compress(vectors(spark, rows))[0].collect()
    assert {(r.vec_id, r.code) for r in got} == {(i, codes[tuple(math.floor(float(np.float32(x)) * 256) for x in v)][0]) for i, v, *_ in rows}


# resampling


def plain_importance(docs, target, max_n, buckets, seed, min_words, percent):
    def features(text):
        ws = plain_words(text)
        return ws, [zlib.crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(ws) - n + 1)]

    raw, want = Counter(), Counter()
    for _, t in docs:
        raw.update(features(t)[1])
    for t in target:
        want.update(features(t)[1])
    s_all, t_all = sum(raw.values()) + buckets, sum(want.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * s_all / ((raw[b] + 1) * t_all)))
    out = []
    for i, t in docs:
        ws, fs = features(t)
        weight = sum(map(gain, fs)) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(ws), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((o for o in out if o[1] >= min_words), key=lambda o: (-o[4], o[0] is None, o[0] or 0))
    drawn = [(*o, k + 1) for k, o in enumerate(able[: percent * len(able) // 100])]
    return out, able, drawn


@pytest.mark.parametrize("max_n,buckets,percent", [(1, 10_000, 10), (2, 50, 40), (3, 997, 100)])
def test_importance_equals_plain_version(spark, max_n, buckets, percent):
    docs, rows = awkward(spark)
    target = [rows[0][1], None, "", prose(random.Random(5), 80)]
    out, able, drawn = plain_importance([r[:2] for r in rows], target, max_n, buckets, 9, 20, percent)
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.importance(docs, frame, max_n=max_n, buckets=buckets, seed=9, percent=percent).drop("h").collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(out)
    have = sorted((r.rank, r.score) for r in got if r.rank is not None)
    assert have == [(d[5], d[4]) for d in drawn]
    unique = {i for i, n in Counter(o[0] for o in out).items() if n == 1 and i is not None}
    assert {(r.doc_id, r.rank) for r in got if r.doc_id in unique} == {(o[0], {d[0]: d[5] for d in drawn}.get(o[0])) for o in out if o[0] in unique}


def test_resample_returns_drawn_rows_of_documents(spark):
    docs, _ = awkward(spark)
    target = docs.select("text").limit(3)
    drawn = resampling.importance(docs, target, percent=30).filter("rank is not null")
    got = resampling.resample(docs, target, percent=30)
    assert got.schema == docs.schema
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in drawn.collect()}


def test_resample_of_nothing(spark):
    docs, rows = awkward(spark)
    assert resampling.importance(empty(spark), docs).count() == 0
    assert resampling.importance(docs, empty(spark)).count() == len(rows)


def test_chosen_documents_lean_to_the_target(spark):
    """A tenth of the documents has the target's words; of the drawn ones far more do."""
    r = random.Random(3)
    near, far = [f"target{i}" for i in range(50)], [f"plain{i}" for i in range(500)]
    docs = [(i, " ".join(r.choice(near if i % 10 == 0 and r.random() < 0.8 else far) for _ in range(60))) for i in range(600)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    target = spark.createDataFrame([(" ".join(r.choice(near) for _ in range(20_000)),)], "text string")
    drawn = [x.doc_id for x in resampling.resample(frame, target).collect()]
    assert len(drawn) == 60 and sum(i % 10 == 0 for i in drawn) >= 50


# decontamination


def plain_hits(docs, items, window):
    wins = {}
    for item, text in items:
        ws = plain_words(text)
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1 if ws else 0):
            wins.setdefault(tuple(ws[i : i + n]), set()).add(item)
    sizes = {len(w) for w in wins}
    out = []
    for i, text in docs:
        ws = plain_words(text)
        hit, names = set(), set()
        for n in sizes:
            for k in range(len(ws) - n + 1):
                found = wins.get(tuple(ws[k : k + n]))
                if found:
                    hit.update(range(k, k + n))
                    names |= found
        out.append((i, len(ws), tuple(sorted(hit)), tuple(sorted(str(x) for x in names if x is not None))))
    return out


def leaky(spark):
    _, rows = awkward(spark)
    r = random.Random(8)
    items = [(i, prose(r, r.randint(1, 60))) for i in range(30)] + [(30, ""), (31, None), (32, "été 日本"), (33, "word"), (34, "x y"), (None, rows[5][1]), (3, prose(r, 15))]
    items += [(40, rows[0][1]), (41, rows[1][1]), (40, rows[0][1]), (35, "and the"), (36, items[4][1])]
    docs = [x[:2] for x in rows]
    for k in range(60):
        a, b = prose(r, r.randint(0, 80)), prose(r, r.randint(0, 80))
        t = plain_words(items[r.randrange(30)][1])
        cut = t[r.randint(0, max(0, len(t) - 12)) :]
        docs.append((1000 + k, " ".join([a, *(w.upper() for w in cut), "!", b])))
    docs.append((2000, " ".join(prose(r, 200) + " " + items[7][1] for _ in range(20))))
    return docs, items


@pytest.mark.parametrize("window,shingle", [(10, 3), (5, 1), (3, 3), (13, 4)])
def test_hits_equal_plain_version(spark, window, shingle):
    docs, items = leaky(spark)
    frame = spark.createDataFrame([(*d, "a", "b") for d in docs], "doc_id long, text string, row string, near string").repartition(4)
    got = decontaminate.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"), window=window, shingle=shingle).collect()
    flat = [(r.doc_id, r.n_words, tuple(k for s in r.spans for k in range(s.start, s.end)), tuple(r["items"])) for r in got]
    want = plain_hits(docs, items, window)
    assert Counter(flat) == Counter(want) and sum(bool(w[2]) for w in want) > 60


def test_filter_that_lets_all_pass_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BITS", 3)
    monkeypatch.setattr(decontaminate, "HELD", 5)
    docs, items = leaky(spark)
    frame = spark.createDataFrame(docs[:60], "doc_id long, text string")
    got = decontaminate.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r.doc_id, tuple(r["items"])) for r in got) == Counter((w[0], w[3]) for w in plain_hits(docs[:60], items, 10))


def test_decontamination_of_nothing(spark):
    docs, rows = awkward(spark)
    items = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.decontaminate(docs, items).collect()
    assert len(got) == len(rows) and not any(r.spans or r["items"] for r in got)
    assert decontaminate.decontaminate(empty(spark), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_very_long_text(spark):
    """One text of 5 MB, with a passage at its end."""
    r = random.Random(2)
    passage = prose(r, 40)
    text = "lorem ipsum dolor sit " * 240_000 + passage
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    items = spark.createDataFrame([(5, passage)], "item_id long, text string")
    got = {x.doc_id: x for x in decontaminate.decontaminate(docs, items).collect()}
    assert [tuple(s) for s in got[1].spans] == [(960_000, 960_000 + len(plain_words(passage)))] and got[1]["items"] == ["5"] and not got[2].spans
    assert {x.doc_id: x.n_features for x in resampling.importance(docs, items).collect()} == {1: 960_000 + len(plain_words(passage)), 2: 1}
