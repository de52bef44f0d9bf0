"""Null and repeated ids, values without end, and every stage of the pipeline on odd tables."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from grainmill.llm.jaccard_join import jaccard_components
from grainmill.llm.packed_ids import packed_documents, read_packed, write_packed
from grainmill.llm.pii_pseudonyms import pseudonymise
from grainmill.llm.span_dedup import dedup_spans
from grainmill.operators.removal import without_keys

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def masked(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.text, [v["kind"] for v in r.pii]) for r in pseudonymise(df, "k").collect()}


def test_values_without_end(spark):
    """No pattern repeats a group by recursion, so long runs of its parts end no task."""
    many = 100_000
    texts = ["x@" + "a." * many + "a", "see x@" + "a-b." * many + "org now", "1.2" * 2000, "+1 " + "5 " * 2000, "AB12 " + "ABCD " * 3000, "4111 " * 3000, "12-34-" * 5000, "a" * 40 + "f" * many]
    got = masked(spark, *texts)
    assert [len(got[i][0]) for i in range(len(texts))] == [len(t) for t in texts]
    assert got[0][1] == ["email"] and got[1][1] == ["email"] and got[1][0].startswith("see ") and got[1][0].endswith(" now")


def test_one_phone_in_two_spellings(spark):
    got = masked(spark, "call +1 415 555 0100.", "call +14155550100.", "call +351 912 345 678", "call +351912345678")
    digits = ["".join(c for c in got[i][0] if c.isdigit()) for i in range(4)]
    assert digits[0] == digits[1] != "14155550100" and digits[0][0] == "1"
    assert digits[2] == digits[3] != "351912345678" and digits[2][:3] == "351"


def test_capitals_stay(spark):
    key = "0123456789ABCDEF" * 2
    got = masked(spark, f"key {key}", f"key {key.lower()}")
    assert got[0][0].isascii() and got[0][0][4:] == got[0][0][4:].upper() == got[1][0][4:].upper() != key
    assert got[1][0][4:] == got[1][0][4:].lower()


def test_spans_of_rows_that_share_an_id(spark):
    passage = " ".join(f"Sentence {i} has some words of its own." for i in range(8))
    rows = [(1, passage), (2, passage), (2, "Keep me whole. And me too."), (2, None), (None, "x y. " + passage), (None, "Alone here. With another.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.id, r.text) for r in dedup_spans(df).collect()), key=str)
    # the row without an id comes first, so it keeps the passage
    assert got == sorted([(1, ""), (2, ""), (2, "Keep me whole. And me too."), (2, None), (None, "x y. " + passage), (None, "Alone here. With another.")], key=str)


def test_packed_null_ids(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    rows = [(None, "first of all"), (5, "five"), (None, None), (-3, "minus"), (5, "five again")]
    write_packed(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "ids"), file)
    got = sorted(((r.id, r.n_tokens, r.ids_crc32) for r in packed_documents(read_packed(spark, str(tmp_path / "ids"))).collect()), key=str)
    tok = Tokenizer.from_file(file)

    def line(i, text):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        return (i, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))

    assert got == sorted((line(i, t) for i, t in rows), key=str)


def test_components_with_null_ids(spark):
    near = " ".join(f"n{i}" for i in range(60))
    df = spark.createDataFrame([(None, near), (4, near + " tail"), (7, "some other words stand here now"), (None, None)], "doc_id long, text string")
    got = {(r.id, r.n_shingles): r.component for r in jaccard_components(df).collect()}
    assert got == {(None, 56): None, (4, 57): None, (7, 2): 7, (None, 0): None}


def good(seed):
    words = "the of and to in that it with for as on be at by this have from or one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
    return ". ".join(" ".join(words[(seed * 31 + 7 * i + j * (1 + seed % 5)) % len(words)] for j in range(9)).capitalize() for i in range(14)) + "."


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, good(i), "en", f"s{i % 3}", 1) for i in range(12)] + [(2, good(50), "en", "s0", 1), (2, good(2), "en", "s0", 1), (3, good(51), "en", None, 1), (None, good(52), None, None, None), (None, good(53), "en", "s1", 1), (20, None, "en", "s1", 0), (21, "", "en", "s1", 0), (22, good(5) + " End.", "en", "s2", 1), (23, good(60) + " " + "very long text here. " * 20_000, "en", "s2", 1)]
    return spark.createDataFrame(rows, DOCS)


def test_near_duplicates_lose_no_text(spark, odd_docs, data):
    kept = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_duplicates(spark, odd_docs, data).collect())
    texts = [t for _, _, t in kept]
    for seed in (2, 50, 3, 51, 52, 53):
        assert texts.count(good(seed)) == 1  # rows of one id are kept by their texts
    assert good(5) in texts and good(5) + " End." not in texts
    assert len(kept) == odd_docs.count() - 2  # one equal row, one near copy


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, odd_docs, data, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    wide = odd_docs.withColumns({c: F.lit(1) for c in ("id", "n", "cls", "component", "token", "_n", "size", "key", "word", "n_words_")})
    for df in (odd_docs, wide):
        got = stage(spark, df, data)
        assert got.columns[: len(df.columns)] == df.columns
        known = {(r.doc_id, r.text) for r in df.collect()}
        assert {(r.doc_id, r.text) for r in got.collect()} <= known
    assert stage(spark, odd_docs.limit(0), data).count() == 0


def test_near_duplicates_shuffle_listed_rows_only(spark, data):
    """However many are dropped, rows that stay are not shuffled to be told apart from them."""
    near = " ".join(f"n{i}" for i in range(60))
    df = spark.createDataFrame([(i, f"{near} {i % 50}" if i % 2 else f"{good(i)} {i}.", "en", "s", 1) for i in range(200)], DOCS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = corpus_pipeline.near_duplicates(spark, df, data)
        plan = got._jdf.queryExecution().executedPlan().toString()
        kept = {r.doc_id for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.split("Union\n", 1)[-1].splitlines()
    stays = [line for line in lines if line.startswith(lines[0].split(":")[0] + ":")]  # the first side of the union
    assert stays and not any("hashpartitioning(doc_id" in line for line in stays)
    assert {i for i in kept if i % 2} == {1}


@pytest.mark.parametrize("words", [(0, 0), (0, 2), (4, 18)])
def test_rows_without_keys(spark, words):
    rows = spark.createDataFrame([(i % 700 if i % 9 else None, f"t{i}") for i in range(1000)], "k int, text string")
    keys = spark.createDataFrame([(i,) for i in range(0, 700, 3)] * 2 + [(None,), (5000,)], "k long")
    want = sorted(r.text for r in rows.collect() if r.k is None or r.k % 3)
    got = without_keys(rows, keys, "k", words)
    assert got.schema == rows.schema and sorted(r.text for r in got.collect()) == want
    assert without_keys(rows, keys.limit(0), "k", words).count() == 1000
