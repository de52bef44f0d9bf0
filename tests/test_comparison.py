"""Operators without a registered query: choice of variants, applied temperatures, typed rows and candidate order."""

import math

import pytest
from pyspark.sql import functions as F

from grainmill.operators import comparison as C
from grainmill.sources import transforms as TR


def test_variant_choice(spark):
    rows = spark.createDataFrame([("b", 5.0, 10.0), ("a", 5.0, 20.0), ("c", 4.0, 1.0)], "variant string, composite double, mean_input_tokens double")
    assert tuple(C.variant_choice(rows, 0.1, 0.2).first()) == ("a", "a", False)
    assert tuple(C.variant_choice(rows, -0.1, 0.2).first()) == ("a", "b", True)


def test_finest_temperature_is_applied(spark):
    rows = spark.createDataFrame([("choice", "long"), ("choice", "short"), ("score", "long")], "type string, at string").withColumn("p", F.array(F.lit(0.8), F.lit(0.2)))
    temps = spark.createDataFrame([("choice", 2.0), ("choice@long", 1.0)], "key string, temperature double")
    got = {(r.type, r.at): r.p[0] for r in C.apply_temperatures(rows, temps, [F.col("type"), F.concat_ws("@", "type", "at")]).collect()}
    half = math.sqrt(0.8) / (math.sqrt(0.8) + math.sqrt(0.2))
    assert got == pytest.approx({("choice", "long"): 0.8, ("choice", "short"): half, ("score", "long"): 0.8})


def test_typed_rows_and_candidate_order(spark):
    kind = "array<struct<id:string,type:string,instruction:string,candidates:array<struct<id:string,description:string,ordinal:int,is_nota:boolean>>,target:map<string,float>>>"
    question = (None, "noul", "Is it?", [("b1", "true", None, None), ("b0", "false", None, None)], {"b1": 1.0, "b0": 0.0})
    rows = TR.typed_passthrough(spark.createDataFrame([("s", [question]), ("none", [])], f"state string, questions {kind}"))
    q = rows.first().questions[0]
    assert rows.count() == 1 and q.id == "q0" and [c.is_nota for c in q.candidates] == [False, False]
    ordered = rows.select(TR.canonical_order(F.col("questions")).alias("q")).first().q[0]
    assert [c.id for c in ordered.candidates] == ["b0", "b1"]
