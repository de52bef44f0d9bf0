"""BM25 over whole documents against a brute-force version."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from grainmill.functions import text as T
from grainmill.operators import retrieval as R
from grainmill.plans import registry
from grainmill.plans.tables import table


def brute_bm25(text):
    spans = [[w for w in re.findall("[a-z0-9]+", x.casefold()) if len(w) > 1 and w not in T.STOP_WORDS] for x in text.split("\n")]
    counts = [Counter(w) for w in spans]
    n, mean = len(spans), max(sum(map(len, spans)) / len(spans), 1)
    df = Counter(t for c in counts for t in c)
    return [sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in c) for w, c in zip(spans, counts, strict=True)]


def test_bm25_of_every_document_and_its_whole_text(spark, data):
    docs = table(spark, data, "documents").collect()
    assert len({r.lang for r in docs}) > 1 and any(len(r.text) > 200 for r in docs)
    want = {(r.doc_id, i): x for r in docs for i, x in enumerate(brute_bm25(r.text))}
    rows = registry.queries()["bm25_spans"](spark, data).collect()
    assert len(rows) == len(want) and {(r.doc_id, r.span): r.score for r in rows} == pytest.approx(want, abs=2e-6)
    whole = table(spark, data, "documents")
    joined = R.bm25(whole.select("doc_id", F.posexplode(F.split("text", "\n")).alias("span", "text")), whole.selectExpr("doc_id", "text AS query")).collect()
    assert {(r.doc_id, r.span): r.score for r in joined} == pytest.approx(want, abs=2e-6)


def test_bm25_in_row_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, "word"), (2, [], "word"), (3, ["", None, "word other"], None), (4, ["word", "word word", "zz"], "Word")], "id int, s array<string>, q string")
    got = {r.id: r.x for r in rows.select("id", R.bm25_in_row(F.col("s"), F.col("q")).alias("x")).collect()}
    assert got[1] is None and got[2] == [] and got[3] == [0, 0, 0] and 0 < got[4][0] < got[4][1] and got[4][2] == 0


def test_spans_tile_their_blocks(spark):
    texts = ["", " \n\n ", "One. Two! three; Four", "x" * 1000, ("word " * 300).strip(), "a" * 481, "a" * 480, "A b.\n\n" + "c " * 400 + "\n \nD", "é" * 221 + " " + "z" * 700]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", T.evidence_spans("t").alias("s")).collect()
    for r in rows:
        t, end = texts[r.id], 0
        for s in r.s:
            assert 0 < s.stop - s.start <= 480 and s.start >= end
            gap = t[end : s.start]
            assert gap.strip() == "" or len(gap) == 1
            if s.stop < len(t) and t[s.stop] == " " and s.stop - s.start >= 220 and not re.search(r"[.!?;\s]$", t[: s.stop]):
                assert " " not in t[s.stop + 1 : s.start + 480]
            end = s.stop
        assert t[end:].strip() == "" or len(t) - end == 1
    got = {r.id: [(s.start, s.stop) for s in r.s] for r in rows}
    assert got[0] == got[1] == [] and got[2] == [(0, 5), (5, 17), (17, 21)]
    assert got[3] == [(0, 480), (481, 961), (962, 1000)] and got[5] == [(0, 480)] and got[6] == [(0, 480)] and got[8] == [(0, 221), (222, 702), (703, 922)]


def test_selection_keeps_head_tail_best_and_neighbours(spark):
    n, size = 60, 200
    spans = spark.range(n).selectExpr("1L AS doc_id", "cast(id AS int) AS span", f"cast(id * {size} AS int) AS start", f"cast((id + 1) * {size} AS int) AS stop", f"{n * size} AS length")
    best = [30, 20, 10, 40, 25, 3, 4, 5, 6, 7, 8, 9, 50]
    scores = spark.createDataFrame([(1, i, float(100 - best.index(i)) if i in best else 0.0) for i in range(n)], "doc_id long, span int, score double")
    tail = [i for i in range(n) if i * size >= n * size - 1100]
    want = [0, *tail, *best[:12]]
    for b in best[:5]:
        want += [b - 1, b + 1]
    taken = list(dict.fromkeys(want))[: 5800 // size]
    r = R.select_spans(spans, scores).first()
    assert r.spans == sorted(taken) and r.chars == size * len(taken)
    assert R.select_spans(spans.withColumn("length", F.lit(5000)), scores).count() == 0


def test_selection_shuffles_places_of_spans_only(spark, data):
    """One exchange, without texts or words; the spans are those that the join of terms gives."""
    got = registry.queries()["evidence_selection"](spark, data)
    plan = got._jdf.queryExecution().optimizedPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    docs = table(spark, data, "documents")
    spans = docs.select("doc_id", F.length("text").alias("length"), "text", F.posexplode(T.evidence_spans("text")).alias("span", "s")).select("doc_id", "length", "span", "s.*", F.expr("substring(text, s.start + 1, s.stop - s.start)").alias("text"))
    want = R.select_spans(spans.drop("text"), R.bm25(spans, docs.selectExpr("doc_id", "concat_ws(' ', source, lang) AS query")))
    rows = sorted(map(tuple, got.collect()))
    assert rows and rows == sorted((r.doc_id, r.chars, ",".join(map(str, r.spans))) for r in want.collect())


def test_scored_spans_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, "word"), (2, "", "word"), (3, "Word. Other", None), (4, "é zz. Word word? Else; Word", "WORD")], "id int, t string, q string")
    got = {r.id: [tuple(s) for s in r.x] for r in rows.select("id", R.scored_evidence_spans(F.col("t"), F.col("q")).alias("x")).collect()}
    assert got[1] == got[2] == [] and got[3] == [(0, 6, 0.0), (6, 11, 0.0)]
    assert [s[:2] for s in got[4]] == [(0, 6), (6, 17), (17, 23), (23, 27)] and got[4][1][2] > got[4][3][2] > 0 == got[4][0][2] == got[4][2][2]


def test_evidence_rules(spark):
    none = F.array().cast("array<string>")
    r = spark.range(1).select(
        T.needs_evidence(F.lit("override applies")), T.needs_evidence(F.lit("no"), F.lit("Which Policy?")), T.needs_evidence(F.lit("1 and 2.5")), T.needs_evidence(F.lit("1 2 3")),
        T.strip_level_marker(F.lit("[2] partly")), T.strip_level_marker(F.lit("2- x")), T.strip_level_marker(F.lit("(0) no")), T.strip_level_marker(F.lit("plain")),
        T.needs_calculation(F.lit("1 2 3"), F.lit("What is the total?"), none, F.lit("choice")), T.needs_calculation(F.lit("1 2 3"), F.lit("Good?"), F.array(F.lit("0: bad"), F.lit("1: good 5")), F.lit("score")),
        T.needs_calculation(F.lit("1 2 3"), F.lit("Good?"), F.array(F.lit("0: bad"), F.lit("1: good 5")), F.lit("choice")), T.needs_calculation(F.lit("1 2"), F.lit("total"), none, F.lit("choice")),
        *T.surface_features(F.lit("Due 2020-1-2 or 2020/03/04, 5% of USD"), F.lit("More than most")).values(),
    ).first()
    assert list(r)[:12] == [True, True, False, True, "partly", "x", "no", "plain", True, False, True, False]
    assert list(r)[12:16] == [15, 2, 2, 3] and abs(r[16] - math.log(38)) < 1e-9
