"""Decontamination: the lookup in the row and the join find the same documents."""

from grainmill.operators import decontam as D
from grainmill.plans.tables import table

LINE = "the quick brown fox jumps over the lazy dog and runs away from here today"
CJK = "\u6f22\u5b57" * 20


def test_lookup_equals_join(spark, data):
    docs, index = table(spark, data, "documents"), D.gram_index(table(spark, data, "benchmark"))
    found = lambda rows: sorted(r.id for r in rows.collect())
    got = found(D.hits(docs, index, "doc_id"))
    assert got and got == found(D.joined_hits(docs, index, "doc_id"))


def test_kinds_and_odd_texts(spark, monkeypatch):
    protected = spark.createDataFrame([(LINE,), ("four words are enough",), (CJK,), (None,), ("",)], "text string")
    texts = ["say: " + LINE + ".", "Four words, are ENOUGH!", "now four words are enough", "x" + CJK[3:36] + "y", None, "", LINE[:40], "a " * 5000 + LINE]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    index = D.gram_index(protected)
    found = lambda rows: sorted(r.id for r in rows.collect())
    assert found(D.hits(docs, index, "doc_id")) == found(D.joined_hits(docs, index, "doc_id")) == [0, 1, 3, 7]
    monkeypatch.setattr(D, "MOST_KEYS", 1)
    assert found(D.hits(docs, index, "doc_id")) == [0, 1, 3, 7]
    assert D.hits(docs.limit(0), index, "doc_id").count() == 0
    assert D.hits(docs, index.limit(0), "doc_id").count() == 0
