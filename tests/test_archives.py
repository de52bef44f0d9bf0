"""Archives read by their directories: round trip, pins, names, repeated keys."""

import hashlib
import json
import zipfile

import pytest
from pyspark.errors import PySparkException

from grainmill.plans.tables import table
from grainmill.sources import archives as A


def zipped(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in members:
            z.writestr(zipfile.ZipInfo(name), content)
    return str(path)


def test_pages_join_to_their_table(spark, data, tmp_path):
    pages = table(spark, data, "pages")
    path = zipped(tmp_path / "pages.zip", [(f"{r.page_id}.html", r.html.encode()) for r in pages.collect()])
    got = A.read_archive(spark, path, sha256=A.file_sha256(path), partitionBytes="20000")
    assert got.rdd.getNumPartitions() > 3
    back = got.selectExpr("cast(replace(member, '.html', '') AS long) AS page_id", "cast(content AS string) AS found", "n_bytes")
    assert back.join(pages, "page_id").where("found = html AND n_bytes = octet_length(html)").count() == pages.count() == got.count()


def test_written_archives(spark, tmp_path):
    rows = spark.createDataFrame([(f"a/{i}", bytes([i % 256]) * i) for i in range(300)] + [("null", None)], "member string, content binary").repartition(4)
    A.write_archives(rows, str(tmp_path / "out"))
    assert {p.suffix for p in (tmp_path / "out").iterdir()} == {".zip"}
    got = {r["member"]: bytes(r["content"]) for r in A.read_archive(spark, str(tmp_path / "out")).collect()}
    assert got == {f"a/{i}": bytes([i % 256]) * i for i in range(300)} | {"null": b""}
    with pytest.raises(PySparkException, match="repeats"):
        A.write_archives(spark.createDataFrame([("x", b"1"), ("x", b"2")], "member string, content binary").coalesce(1), str(tmp_path / "twice"))
    assert not list((tmp_path / "twice").glob("part-*"))


def test_pins_and_members(spark, tmp_path):
    path = zipped(tmp_path / "a.zip", [("train.json", b"{}"), ("LICENSE", b"free"), ("raw/x", b"")])
    pin = hashlib.sha256(b"free").hexdigest()
    got = A.read_archive(spark, path, members='["train.json", "LICENSE"]', pins=json.dumps({"LICENSE": pin}))
    assert sorted(r["member"] for r in got.collect()) == ["LICENSE", "train.json"]
    for options, message in (({"sha256": "0" * 64}, "pinned"), ({"pins": json.dumps({"LICENSE": "0" * 64})}, "pinned"), ({"members": '["none"]'}, "lacks")):
        with pytest.raises(PySparkException, match=message):
            A.read_archive(spark, path, **options).collect()


@pytest.mark.parametrize("name", ["/etc/x", "../x", "a/../../x", "a\\b"])
def test_unsafe_names(spark, tmp_path, name):
    path = zipped(tmp_path / "a.zip", [("ok", b"1"), (name, b"2")])
    with pytest.raises(PySparkException, match="unsafe"):
        A.read_archive(spark, path).collect()
    inside = zipped(tmp_path / "b.zip", [("raw/" + name, b"2")])
    assert A.read_archive(spark, inside, exempt="raw/").count() == 1


def test_repeated_names_and_empty_archives(spark, tmp_path):
    with pytest.warns(UserWarning):
        path = zipped(tmp_path / "a.zip", [("x", b"1"), ("x", b"2")])
    with pytest.raises(PySparkException, match="repeats"):
        A.read_archive(spark, path).collect()
    assert A.read_archive(spark, zipped(tmp_path / "e.zip", [])).collect() == []
    with pytest.raises(PySparkException, match="none.zip"):
        A.read_archive(spark, str(tmp_path / "none.zip")).collect()


def test_nested_documents(spark, tmp_path):
    good = {"documents": [{"id": "1", "text": "tëxt", "annotation_sets": [{"annotations": {"q": {"choice": "Entailment"}, "z": {"choice": "x"}}}]}, {"id": "2", "text": None, "annotation_sets": []}], "labels": {"q": {"hypothesis": "h"}}}
    members = [("a", json.dumps(good)), ("b", '{"documents": [], "documents": []}'), ("c", "{"), ("d", "null"), ("e", '{"x": {"y": 1, "y": 2}}')]
    read = A.read_archive(spark, zipped(tmp_path / "a.zip", members))
    assert [tuple(r) for r in A.document_questions(read).collect()] == [("1", "tëxt", "q", "h", "Entailment")]
    assert sorted(r["member"] for r in A.malformed(read).collect()) == ["b", "c", "e"]
