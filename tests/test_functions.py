import math

import pytest
from pyspark.sql import functions as F

from grainmill.functions import dates as D
from grainmill.functions import probability as P
from grainmill.functions import text as T
from grainmill.operators import inference as I
from grainmill.operators import scoring as S
from grainmill.operators import splits
from grainmill.operators.components import connected_components
from grainmill.operators.groups import connected_rows
from grainmill.sources import transforms as TR


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_probability_edges(spark):
    r = one(spark, P.renormalize(arr(0, 0)), P.temperature_scale(arr(0.8, 0.2, 0), 2.0), P.margin(arr(1.0)), P.argmax(arr(0.4, 0.4, 0.2)), P.rps(arr(1.0), arr(1.0)), P.jsd(arr(1, 0), arr(0, 1)), P.clip_renormalize(arr(-1, 1)))
    assert r[0] == [0.5, 0.5] and r[1][2] == 0 and abs(sum(r[1]) - 1) < 1e-12
    assert r[2] == 1.0 and r[3] == 0 and r[4] is None and abs(r[5] - math.log(2)) < 1e-12 and r[6] == [0, 1]


def test_candidate_edits(spark):
    c = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(i).alias("description")) for i in ("a", "b", "__nota__")])
    t = F.expr("map('a', 0.8D, 'b', 0.1D, '__nota__', 0.1D)")
    r = one(spark, P.remove_candidate(c, t, F.lit("a")), P.split_parent(t, F.lit("a"), F.expr("map('x', 0.25D, 'y', 0.75D)")), P.add_candidate(c, t, F.struct(F.lit("z").alias("id"), F.lit("z").alias("description"))), F.size(P.permute(c, 3)))
    assert abs(r[0].target["__nota__"] - 0.9) < 1e-12 and len(r[0].candidates) == 2
    assert abs(r[1]["y"] - 0.6) < 1e-12 and "a" not in r[1]
    assert r[2].target["z"] == 0 and r[3] == 3


def read(kind, p, y, tier="easy"):
    return (kind, tier, [float(x) for x in p], [float(x) for x in y])


READ = "type string, tier string, p array<double>, y array<double>"


def competence(spark, rows):
    return S.typed_rows(spark.createDataFrame(rows, READ)).agg(S.competence().alias("c")).first().c


def test_competence_by_hand(spark):
    assert competence(spark, [read("choice", (0.6, 0.4), (1, 0)), read("choice", (0.4, 0.3, 0.2, 0.1), (0, 1, 0, 0))]) == pytest.approx(20)
    noul = [read("noul", (0.8, 0.2), (1, 0)), read("noul", (0.2, 0.8), (0, 1)), read("noul", (0.5, 0.5), (0, 1)), read("noul", (0.9, 0.1), (0, 1))]
    assert competence(spark, noul) == pytest.approx(0) and competence(spark, noul[:2]) == pytest.approx(100)
    assert competence(spark, [read("score", (0.5, 0.25, 0.25), (1, 0, 0)), read("score", (0, 0.25, 0.75), (0, 1, 0))]) == pytest.approx(10)


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([("g", 0.2, 0), ("g", 0.5, 1), ("g", 0.5, 0), ("g", 0.9, 1), ("h", 0.5, 1)], "k string, p_true double, gold int")
    got = {r.k: r.auc for r in S.auc(rows, ["k"]).collect()}
    assert got["g"] == pytest.approx(3.5 / 4) and got["h"] is None


def test_composite_penalty(spark):
    r = one(spark, S.composite([F.lit(x) for x in (80.0, 80.0, 80.0, 80.0)], (0.25,) * 4), S.composite([F.lit(x) for x in (25.0, 80.0, 80.0, 80.0)], (0.25,) * 4), S.composite([F.lit(x) for x in (0.0, 80.0, 80.0, 80.0)], (0.25,) * 4), S.mcnemar(F.lit(1), F.lit(5)), S.mcnemar(F.lit(0), F.lit(0)))
    assert r[0] == pytest.approx(80) and r[1] == pytest.approx(0.25 / (0.25 / 25 + 0.75 / 80)) and r[2] == 0
    assert r[3] == pytest.approx(2 * 7 / 64) and r[4] == 1


def test_text(spark):
    r = one(spark, T.fold(F.lit(" Straße\n x ")), T.normalize_text(F.lit("ﬁN ß")), T.canonical_json(F.lit('{"b":1.0,"a":[true,1]}')), T.canonical_json(F.lit("{")), T.state_texts(F.lit('{"a":"x","b":2}')), T.sentences(F.lit("A b. C! D")), T.head_and_tail(F.lit("x" * 100), 20), T.query_tokens(F.lit("The cat is A 12")))
    assert r[0] == "strasse x" and r[1] == "fin ss" and r[2] == '{"a":[true,1],"b":1}' and r[3] is None
    assert r[4][1:] == ["x", "2"] and r[5] == ["A b.", "C!", "D"] and len(r[6]) == 20 and r[7] == ["cat", "12"]


def test_dates(spark):
    day = lambda s: F.lit(s).cast("date")
    r = one(spark, D.add_months(day("2024-01-31"), 1).cast("string"), D.business_days(day("2024-03-01"), day("2024-03-04")), D.business_days(day("2024-03-04"), day("2024-03-01")), D.nth_workday(day("2024-03-01"), 2, F.array(day("2024-03-04"))).cast("string"), D.combinations(F.lit(5), F.lit(2)), D.combinations(F.lit(2), F.lit(5)), D.convert(F.lit(2), "hours", "minutes").cast("double"), D.parse_date(F.lit("29 February 2024")).cast("string"), D.parse_date(F.lit("31 February 2024")))
    assert list(r) == ["2024-02-29", 1, -1, "2024-03-06", 10.0, None, 120.0, "2024-02-29", None]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (3, 1), (7, 7)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got[3] == 1 and got[5] == 4 and 7 not in got and {got[i] for i in range(100, 141)} == {100}
    assert connected_components(edges.limit(0)).count() == 0


def test_groups_by_alias(spark):
    rows = spark.createDataFrame([(1, "x", None), (2, "y", "k"), (3, "x", "k"), (4, None, None)], "id long, a string, b string")
    assert {r.id: r.group for r in connected_rows(rows, "id", ["a", "b"]).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_weights_and_router(spark):
    w = splits.language_weights({"en": 1000, "ko": 50, "ja": 50})
    assert w["en"] <= 0.6001 and w["ko"] >= 0.1999 and abs(sum(w.values()) - 1) < 1e-9
    rows = spark.range(200).selectExpr("cast(id % 17 AS double) AS x", "cast(id % 5 AS double) AS z").withColumn("y", F.expr("2 * x - z + 3"))
    r = I.fit_ridge(rows, ["x", "z"], "y", 1e-9)
    assert rows.select(F.max(F.abs(r.score(["x", "z"]) - F.col("y")))).first()[0] < 1e-6


def test_transforms(spark):
    df = spark.createDataFrame([("p", "h", 2), ("p", "h", -1)], "premise string, hypothesis string, label int")
    got = TR.nli_choice(df).collect()
    assert len(got) == 1 and got[0].questions[0].target["c2"] == 1
    intent = TR.intent_choice(spark.createDataFrame([("t", "oos"), ("t", "pay"), ("t", "zz")], "t string, l string"), "t", "l", ["pay", "get_card"]).collect()
    assert len(intent) == 2 and intent[0].questions[0].target["__nota__"] == 1
    score = TR.real_score(spark.createDataFrame([("t", 3.4), ("t", 5.0), ("t", 9.0)], "t string, s double"), "t", "s", 6, "?").collect()
    assert score[0].questions[0].target["l3"] == pytest.approx(0.6) and score[1].questions[0].target["l5"] == 1 and len(score) == 2
    mark = "\n\nAssistant:"
    pair = spark.createDataFrame([(f"Hi{mark} a", f"Hi{mark} b"), (f"Hi{mark} a", f"Ho{mark} b"), (f"Hi{mark} a", f"Hi{mark} a")], "chosen string, rejected string")
    assert TR.preference_choice(pair).count() == 1
    assert TR.validate(TR.nli_choice(df)).count() == 0


def test_bootstrap_is_repeatable(spark):
    rows = spark.range(100).selectExpr("id % 10 AS c", "cast(id % 3 = 0 AS int) AS n", "1 AS d", "'s' AS s")
    a, b = (I.cluster_bootstrap(rows, "n", "d", "c", ["s"], 100).first() for _ in range(2))
    assert a == b and a.low <= a.estimate <= a.high
