"""Evidence blockers against a scan by every width; paragraph closure and roles against a walk."""

import random

import pytest

from grainmill.operators import evidence_block as B

CJK = "漢字仮名交じり文の例示"


def brute_kinds(text, protected, reserved):
    """Every protected text in turn, by slicing."""
    found, w = set(), B.folded_words(text or "")
    joined = "".join(w)
    cjk = lambda s: len(B._CJK.findall(s))
    for p in protected:
        v = B.folded_words(p or "")
        whole = "".join(v)
        runs = lambda n: {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
        mine = lambda n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        if len(v) >= 13 and runs(13) & mine(13):
            found.add("gram")
        if 4 <= len(v) < 13:
            if reserved and tuple(v) in mine(len(v)):
                found.add("run")
            if not reserved and v == w:
                found.add("exact")
        if any(cjk(whole[i : i + 32]) >= 8 and whole[i : i + 32] in joined for i in range(len(whole) - 31)):
            found.add("cjk_gram")
        if len(whole) < 32 and cjk(whole) >= 12 and whole in joined:
            found.add("cjk_text")
        if reserved and any(cjk(whole[i : i + 12]) == 12 and whole[i : i + 12] in joined for i in range(len(whole) - 11)):
            found.add("cjk_run")
    return found


@pytest.mark.parametrize("reserved", [True, False])
@pytest.mark.parametrize("block_bytes", [8 << 20, 400])
def test_hits_equal_brute_force(spark, reserved, block_bytes):
    random.seed(12)
    word = lambda: random.choice(["a", "b", "ß", "STRASSE", "ﬁne", "é", "x1", "_y"])
    protected = [" ".join(word() for _ in range(random.choice([3, 4, 5, 8, 12, 13, 15, 30]))) for _ in range(12)]
    protected += [None, "", "abc", CJK + "です。" + CJK, "短い漢字仮名交文章例示", "x" * 20 + CJK, CJK[:11] + "です", "漢字" * 6]
    texts = [" ".join(word() for _ in range(random.randrange(40))) for _ in range(150)]
    texts += [f"say: {p}!" for p in protected if p] + [p for p in protected] + [f"前{CJK}です{CJK}後", CJK, "x " + CJK * 3, "漢 字 " * 6, "a " * 20_000 + protected[0], None, ""]
    parts = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "id long, text string, key string, n int").repartition(3)
    patterns = B.protected_patterns(spark.createDataFrame([(p,) for p in protected], "text string"), reserved=reserved)
    got = {}
    for r in B.part_hits(parts, patterns, ["id"], block_bytes=block_bytes).collect():
        got.setdefault(r["id"], []).append(r["kind"])
    want = {i: brute_kinds(t, protected, reserved) for i, t in enumerate(texts)}
    assert {i: sorted(k) for i, k in got.items()} == {i: sorted(k) for i, k in want.items() if k}


def test_one_part_blocks_a_sample(spark):
    parts = spark.createDataFrame([("s", "state", "nothing here"), ("s", "candidate", "One two THREE four five"), ("t", "state", None), (None, "state", "one two three four")], "sample string, part string, text string")
    patterns = B.protected_patterns(spark.createDataFrame([("one two three four",)], "text string"))
    rows = B.blocked_samples(parts, B.part_hits(parts, patterns, ["sample"]), "sample").collect()
    assert {r["sample"]: (r["n_parts"], r["kinds"], r["blocked"]) for r in rows} == {"s": (2, "run", True), "t": (1, "", False), None: (1, "run", True)}
    none = B.protected_patterns(spark.createDataFrame([], "text string"))
    assert B.part_hits(parts, none, ["sample"]).count() == 0 and B.part_hits(parts.limit(0), patterns, ["sample"]).count() == 0
