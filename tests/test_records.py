"""Benchmark and canonical records into items and back; tiers; questions as sent."""

import json

import pytest
from pyspark.sql import functions as F

from grainmill.sources import records as R


def items(spark, made, read=R.benchmark_items, source="inline"):
    df = spark.createDataFrame([(json.dumps(m) if isinstance(m, dict) else m, 1) for m in made], "record string, id int")
    return [r.asDict() for r in read(df, source=source).collect()]


BASE = {"id": "a1", "state": "text", "question": {"type": "choice", "instructions": "Pick.", "criteria": {"x": "first", "y": ""}}, "labels": ["x", "y"], "expected": "y", "family": "easy-math"}


def test_choice_record(spark):
    (r,) = items(spark, [BASE])
    assert r["labels"] == ["x", "y"] and r["descriptions"] == ["first", ""] and r["gold"] == {"y": 1.0} and r["fault"] is None
    assert (r["tier"], r["public"], r["identity"], r["instruction"], r["lineage"]) == ("easy", False, "a1", "Pick.", [])
    (r,) = items(spark, [BASE | {"question": {"type": "choice", "criteria": ["one", "two"]}}])
    assert r["descriptions"] == ["one", "two"] and r["instruction"] == ""
    (r,) = items(spark, [BASE | {"question": {"type": "choice"}}])
    assert r["descriptions"] == ["x", "y"]


def test_noul_and_score_records(spark):
    noul = BASE | {"question": {"type": "noul", "instructions": "So?", "criteria": {"yes": "it is"}}, "labels": ["Yes", "No"], "expected": "Yes", "group": "g", "lineage_ids": ["l"]}
    score = BASE | {"question": {"type": "score", "criteria": ["bad", "good", "best"]}, "labels": ["0", "1", "2"], "expected": "1", "gold_distribution": {"1": 0.75, "2": 0.25}}
    a, b = items(spark, [noul, score])
    assert (a["labels"], a["descriptions"], a["gold"], a["identity"], a["lineage"], a["fault"]) == (["false", "true"], ["false", "it is"], {"true": 1.0}, "g", ["l"], None)
    assert (b["labels"], b["descriptions"], b["gold"], b["fault"]) == (["0", "1", "2"], ["bad", "good", "best"], {"1": 0.75, "2": 0.25}, None)


def test_identities_and_public(spark):
    case = BASE | {"case_id": "c", "metadata": {"case_id": "m", "split": "public"}}
    a, b, c, d = items(spark, [case, case | {"metadata": {"case_id": "m"}}, BASE | {"metadata": {"case_id": "m"}}, BASE | {"public": True, "case_id": "c"}])
    assert [(r["public"], r["identity"]) for r in (a, b, c, d)] == [(True, "a1"), (False, "c"), (False, "m"), (True, "a1")]
    assert items(spark, [BASE], source="data/Public/hard.jsonl")[0]["public"]


@pytest.mark.parametrize(
    "change, source, tier",
    [
        ({"tier": "Hard"}, "x", "hard"),
        ({"family": None, "metadata": {"tier": "original"}}, "x", "standard"),
        ({"id": "judge_hard-3"}, "set/hard.jsonl", "hard"),
        ({"id": "judge_hard-3"}, "set/other.jsonl", "judge"),
        ({"family": "hardness"}, "x", "standard"),
        ({"family": "hard/er"}, "x", "hard"),
        ({"family": "law", "id": "original_7"}, "x", "standard"),
        ({"family": None}, "a/easy-set.jsonl", "easy"),
        ({"family": None}, "a/b", "standard"),
    ],
)
def test_tiers(spark, change, source, tier):
    assert items(spark, [BASE | change], source=source)[0]["tier"] == tier


def test_faults(spark):
    noul = {"type": "noul", "criteria": {}}
    cases = {
        "record": "not json",
        "noul labels": BASE | {"question": noul, "labels": ["yes", "no", "?"], "expected": "yes"},
        "no false label": BASE | {"question": noul, "labels": ["a", "b"], "expected": "a"},
        "noul criteria": BASE | {"question": {"type": "noul", "criteria": {"maybe": "x"}}, "labels": ["no", "yes"], "expected": "no"},
        "number of options": BASE | {"labels": ["x"], "expected": "x"},
        "repeated label": BASE | {"labels": ["x", "x"], "expected": "x"},
        "number of levels": BASE | {"question": {"type": "score", "criteria": ["one"]}, "labels": ["0"], "expected": "0"},
        "blank level": BASE | {"question": {"type": "score", "criteria": ["one", ""]}, "labels": ["0", "1"], "expected": "0"},
        "unknown type": BASE | {"question": {"type": "essay"}},
        "gold outside labels": BASE | {"expected": "z"},
        "gold is no distribution": BASE | {"gold_distribution": {"x": 0.9, "y": 0.3}},
    }
    assert [r["fault"] for r in items(spark, list(cases.values()))] == list(cases)
    assert items(spark, ["{}"])[0]["fault"] == "record"
    assert items(spark, [None])[0]["fault"] == "record" and items(spark, [BASE | {"labels": ["x", None]}])[0]["fault"] == "record"


SAMPLE = {
    "id": "s", "state": "text", "metadata": {"source": "src", "source_lineage": "l2", "lineage_ids": ["l1"], "task_family": "fam", "tier": "original"},
    "questions": [
        {"id": "q", "type": "noul", "instruction": "So?", "candidates": [{"id": "yes", "description": "it is"}, {"id": "no", "description": ""}], "target_distribution": {"yes": 0.8, "no": 0.2}},
        {"type": "score", "tier": "hard", "candidates": [{"id": "a", "ordinal": 3, "description": "three"}, {"id": "b", "ordinal": 1, "description": "one"}], "target_distribution": {"a": 1.0}},
        {"id": "c", "type": "choice", "candidates": [{"id": "a"}, {"id": "b"}], "target_distribution": {"a": 1.0, "b": 0.0}},
        {"id": "d", "type": "score", "candidates": [{"id": "a"}, {"id": "b", "ordinal": 1}], "target_distribution": {"a": 1.0}},
        {"id": "e", "type": "choice", "candidates": [{"id": "a"}, {"id": "a"}], "target_distribution": {"a": 1.0}},
    ],
}


def test_canonical_items(spark):
    got = items(spark, [SAMPLE, SAMPLE | {"metadata": {"modality": "image"}}, SAMPLE | {"media": ["x.png"]}, "no json"], R.canonical_items)
    assert [r["id"] for r in got] == ["s/q", "s/1", "s/c", "s/d", "s/e"]
    a, b, c, d, e = got
    assert (a["labels"], a["descriptions"], a["gold"], a["tier"], a["fault"]) == (["false", "true"], ["false", "it is"], {"true": 0.8, "false": 0.2}, "standard", None)
    assert (b["labels"], b["gold"], b["tier"], b["fault"]) == (["3", "1"], {"3": 1.0}, "hard", None)
    assert (c["descriptions"], c["identity"], c["lineage"], c["family"], c["source"]) == (["a", "b"], "l2", ["l1", "l2"], "fam", "src")
    assert (d["fault"], e["fault"]) == ("no ordinal", "repeated label")


def test_items_and_back(spark):
    df = spark.createDataFrame([(json.dumps(SAMPLE),), (json.dumps(SAMPLE | {"id": "t", "metadata": {}}),)], "record string")
    first = R.canonical_items(df).where("fault IS NULL")
    again = R.benchmark_items(R.benchmark_records(first))
    key = lambda rows: sorted((r.id, r.type, r.labels, r.descriptions, sorted(r.gold.items()), r.tier, r.identity, r.state, r.lineage) for r in rows.collect())
    assert key(again) == key(first) and again.where("fault IS NOT NULL").count() == 0


def test_questions_as_sent(spark):
    rows = [("score", '{"10": "x", "9": "y"}'), ("choice", '["a", "b"]'), ("noul", None), ("noul", '{"true": "so"}'), (None, "{}")]
    df = spark.createDataFrame(rows, "kind string, criteria string")
    got = [r.w for r in df.select(R.wire_question(F.col("kind"), F.col("criteria"), sort_score=True).alias("w")).collect()]
    assert (got[0].labels, got[0].descriptions) == (["9", "10"], ["y", "x"])
    assert (got[1].labels, got[1].descriptions) == (["a", "b"], ["a", "b"])
    assert got[2].descriptions == ["false", "true"] and got[3].descriptions == ["false", "so"] and got[4].fault == "unknown type"
