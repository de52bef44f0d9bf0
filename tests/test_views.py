"""Permutation diagnostics against a direct computation; the source index against a walk over each text."""

import math
import random
import re

import pytest

from grainmill.operators import permutation as V
from grainmill.operators import source_index as X

VIEW = "q string, type string, view int, display array<int>, p array<double>, y array<double>, k int"


def orders(k):
    same = list(range(k))
    return [list(o) for o in dict.fromkeys(map(tuple, (same, same[::-1], same[1:] + same[:1])))]


def shown(q, kind, canonical, y):
    return [(q, kind, v, o, [canonical[v][i] for i in o], [y[i] for i in o], 9) for v, o in enumerate(orders(len(y)))]


def test_diagnostics(spark):
    random.seed(15)
    rows, want = [], {}
    for n in range(40):
        kind, k = [("choice", 4), ("noul", 2), ("score", 5), ("choice", 1)][n % 4]
        views = len(orders(k))
        raw = [[random.random() for _ in range(k)] for _ in range(views)]
        p = [[x / sum(r) for x in r] for r in raw]
        gold = n % k
        y = [float(i == gold) for i in range(k)]
        rows += shown(f"q{n}", kind, p, y)
        tops = [max(range(k), key=v.__getitem__) for v in p]
        want[f"q{n}"] = (
            views,
            max(max(v[i] for v in p) - min(v[i] for v in p) for i in range(k)),
            max(0.5 * sum(abs(a - b) for a, b in zip(v, w)) for v in p for w in p),
            sum(t != tops[0] for t in tops[1:]),
            min(-math.log(v[gold]) for v in p),
            max(-math.log(v[gold]) for v in p),
        )
    df = spark.createDataFrame(rows, VIEW).repartition(4)
    got = {r["q"]: (r["views"], r["label_range"], r["total_variation"], r["flips"], r["nll_least"], r["nll_most"]) for r in V.permutation_diagnostics(df, "q").collect()}
    assert got.keys() == want.keys()
    for q, v in want.items():
        assert got[q] == pytest.approx(v, abs=1e-12)
    score = V.permutation_diagnostics(df, "q").where("type = 'score'").first()
    assert score["rps_most"] is not None and score["correct_most"] is None


def test_faults(spark):
    p = [[0.5, 0.3, 0.2]] * 3
    y = [1.0, 0.0, 0.0]
    good = shown("good", "choice", p, y)
    rows = list(good)
    rows += shown("incomplete", "choice", p, y)[:2]
    rows += shown("repeated", "choice", p, y) + shown("repeated", "choice", p, y)[:1]
    rows += [(*r[:3], [2, 0, 1] if r[2] == 2 else r[3], *r[4:]) for r in shown("unplanned", "choice", p, y)]
    rows += [(*r[:3], [0, 0, 1] if r[2] == 2 else r[3], *r[4:]) for r in shown("order", "choice", p, y)]
    rows += [(*r[:4], [0.5, 0.3, 0.3] if r[2] == 1 else r[4], *r[5:]) for r in shown("sum", "choice", p, y)]
    rows += [(*r[:4], None if r[2] == 1 else r[4], *r[5:]) for r in shown("null", "choice", p, y)]
    rows += [(*r[:4], [1.5, -0.5, 0.0] if r[2] == 1 else r[4], *r[5:]) for r in shown("negative", "choice", p, y)]
    rows += [(*r[:5], [0.0, 1.0, 0.0] if r[2] == 2 else r[5], r[6]) for r in shown("gold", "choice", p, y)]
    rows += [("empty", "choice", 0, [], [], [], 9)]
    df = spark.createDataFrame(rows, VIEW)
    got = {r["q"]: r["fault"] for r in V.checked_views(df, "q").collect()}
    assert got == {"good": None, "incomplete": "incomplete", "repeated": "repeated", "unplanned": "incomplete", "order": "order", "sum": "probabilities", "null": "probabilities", "negative": "probabilities", "gold": "gold", "empty": "order"}
    assert [r["q"] for r in V.permutation_diagnostics(df, "q").collect()] == ["good"]
    assert V.permutation_diagnostics(df.limit(0), "q").count() == 0


def walk(text, most):
    """Spans and fields of a text, one after the other."""
    pieces, fields, number = [], [], 0
    bounds = [0] + [m.end() for m in re.finditer(X.BOUNDARY, text)] + [len(text)]
    for left, right in zip(bounds, bounds[1:]):
        while left < right:
            end = min(right, left + most)
            if end < right and text.rfind(" ", left + most // 2, end) >= 0:
                end = text.rfind(" ", left + most // 2, end) + 1
            piece = text[left:end]
            if piece.strip():
                bare = piece
                for m in re.finditer(X.DATE, piece):
                    fields.append((f"d{len(fields)}", number, "date", m[0]))
                    bare = bare[: m.start()] + " " * len(m[0]) + bare[m.end() :]
                fields += [(f"n{len(fields) + j}", number, "number", v.replace(",", "")) for j, v in enumerate(re.findall(X.NUMBER, bare))]
                number += 1
            pieces.append(piece)
            left = end
    return pieces, fields


def test_index_equals_walk(spark):
    random.seed(16)
    bits = ["due 2024-01-02", "at 2024-01-02T10:20 ", "2024-01-02T10:20:30.", "2024-01-02T10:2", "1,234.50", "-7", "v1.2", "1.2.3", "x9", "9x", "a.5", "12,34", "½", "٣", "é5", "5é", "\n", "\n\n ", ". Next", "! a", "? \nÉ", "word " * 30, "x" * 200, "  "]
    texts = ["".join(random.choice(["", " "]) + random.choice(bits) for _ in range(random.randrange(60))) for _ in range(200)]
    texts += [None, "", " \n ", "a" * 5000, "w " * 40_000 + "2020-02-02 3"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    spans, fields = {}, {}
    for r in X.source_spans(df, most=90).orderBy("id", "place").collect():
        spans.setdefault(r["id"], []).append(r)
    for r in X.source_fields(df, most=90).collect():
        fields.setdefault(r["id"], set()).add((r["name"], r["span"], r["kind"], r["value"]))
    for i, text in enumerate(texts):
        pieces, found = walk(text or "", 90)
        mine = spans.get(i, [])
        assert [r["text"] for r in mine] == pieces and "".join(pieces) == (text or "")
        assert [(r["start"], r["stop"]) for r in mine] == [(sum(map(len, pieces[:j])), sum(map(len, pieces[: j + 1]))) for j in range(len(pieces))] if len(pieces) < 500 else True
        assert [r["span"] for r in mine if r["span"] is not None] == list(range(sum(bool(p.strip()) for p in pieces)))
        assert fields.get(i, set()) == set(found)


def test_short_spans_are_refused():
    with pytest.raises(ValueError):
        X.spans("text", 79)
