"""Joins over texts: n-gram Jaccard, decontamination, sentence spans."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainmill.llm import _bytes as B
from grainmill.llm import jaccard_join as J
from grainmill.llm.decontaminate import benchmark_overlap, contamination
from grainmill.llm.span_dedup import dedup_spans


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < width else (tuple(w[k : k + width]) for k in range(len(w) - width + 1)))


def brute_components(rows, num=3, den=4):
    """Union-find over all pairs of (row number, id, set)."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def got_components(df, **kw):
    return sorted((r.id, r.n_shingles, r.component) for r in J.jaccard_components(df, **kw).collect())


def test_word_tables():
    texts = ["Hello  world", None, "", "hello", "WORLD hello\nx\x0bé ü", "a", "b"]
    found = []
    for _, w in B.chunks(pa.array(texts), B.SPACED, size=16):
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            found.append([bytes(w.raw[s:e]).lower() for s, e in zip(w.start[a:b], w.stop[a:b], strict=True)])
    assert found == [(t or "").encode().lower().split() for t in texts]
    whole = np.concatenate([w.hash for _, w in B.chunks(pa.array(texts), B.SPACED)])
    parts = np.concatenate([w.hash for _, w in B.chunks(pa.array(texts), B.SPACED, size=1)])
    assert (whole == parts).all() and whole[0] == whole[2] == whole[4] and whole[1] == whole[3] and len(set(whole.tolist())) == 7


def test_jaccard_on_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got_components(odd) == brute_components(rows)
    assert got_components(empty) == []


@pytest.mark.parametrize("group", [256, 4])
def test_jaccard_on_chains_and_near_misses(spark, monkeypatch, group):
    """Copies with growing edits: chains of links, and sets just below the threshold; short and long; also with many heads a list."""
    monkeypatch.setattr(J, "LIST_GROUP", group)
    rng = np.random.default_rng(5)
    rows = []
    for size in (3, 5, 7, 9, 12, 30, 80):
        base = [f"b{size}_{i}" for i in range(size)]
        for k in range(14):
            w = list(base)
            for at in rng.integers(0, size, size=k % 5):
                w[at] = f"e{rng.integers(3)}"
            rows.append((len(rows) * 3 + 1, " ".join(w[k % 3 :])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert len({c for _, _, c in want}) < len(rows)
    assert got_components(df) == want


@pytest.mark.parametrize("threshold", [(1, 2), (3, 5), (2, 3), (9, 10)])
def test_jaccard_at_other_thresholds(spark, threshold):
    """Down to a half, where a set of one shingle links with one of two."""
    rng = np.random.default_rng(8)
    texts = ["a b c d e", "a b c d e f", "a b c d e f g", "b c d e f g h", "x a b c d e"]
    for size in (6, 8, 11, 25):
        base = [f"t{size}_{i}" for i in range(size)]
        for k in range(10):
            w = list(base)
            for at in rng.integers(0, size, size=k % 4):
                w[at] = f"e{rng.integers(3)}"
            texts.append(" ".join(w[k % 3 :]))
    rows = list(enumerate(texts))
    assert got_components(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold) == brute_components(rows, *threshold)


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(9)
    for _ in range(200):
        base = rng.integers(0, 2**63, rng.integers(1, 900), dtype=np.int64).astype(np.uint64)
        x, y = (np.unique(base[rng.random(len(base)) < rate]) for rate in rng.random(2))
        if len(x) and len(y):
            a, b = (pa.py_buffer(J._signature(s)) for s in (x, y))
            assert J._differing(a, b) <= len(set(x.tolist()) ^ set(y.tolist()))


def test_boundary_follows_cost():
    assert J.choose_boundary([(500, 100)], 0.0, (3, 4)) == 0
    assert J.choose_boundary([(6, 1000)], 50.0, (3, 4)) >= 8


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def brute_overlap(docs, items, window=13):
    out = []
    for d, t in docs:
        w, hit, who = WORD.findall(lower(t)), set(), set()
        for i, it in items:
            iw = WORD.findall(lower(it))
            m = min(window, len(iw))
            for k in range(len(iw) - m + 1 if m else 0):
                for s in range(len(w) - m + 1):
                    if w[s : s + m] == iw[k : k + m]:
                        hit.update(range(s, s + m))
                        who.add(str(i))
        out.append((d, len(w), len(hit), sorted(who)))
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_overlap(spark, odd, empty, block):
    near = " ".join(f"n{i}" for i in range(60))
    items = [(1, "two Three"), (2, near[20:90]), (3, ""), (4, None), (5, "absent words here"), (6, "One two-three!"), (6, "One two-three!"), (None, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id not in (4, 10)]
    docs = odd.where("doc_id NOT IN (4, 10)")
    got = contamination(benchmark_overlap(docs, bench, block_bytes=block)).collect()
    assert sorted((r.id, r.n_words, r.n_hit, list(r["items"])) for r in got) == brute_overlap(rows, [i for i in items if i[0] is not None])
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)
    assert benchmark_overlap(empty, bench).count() == 0
    assert {r.n_hit for r in contamination(benchmark_overlap(odd, bench.limit(0))).collect()} == {0}


def brute_spans(rows, least=2, words=20):
    docs = []
    for d, t in rows:
        b, sents, last = (t or "").encode(), [], None
        for m in re.finditer(rb"[^\x20\x09-\x0d]+", b):
            new = last is None or b"\n" in b[last.end() : m.start()]
            if not new:
                w = last[0]
                for _ in range(2):
                    w = w[:-1] if len(w) > 1 and w[-1:] in b"\"')]" else w
                new = w[-1:] in b".!?"
            if new:
                sents.append([m.start(), []])
            sents[-1][1].append(m[0].lower())
            last = m
        docs.append((d, b, sents))
    runs = {}
    for d, _, s in docs:
        size, n = [len(x[1]) for x in s], len(s)
        spans = set()
        for i in range(n):
            for step in (1, -1):
                j = i
                while 0 <= j < n and not (abs(j - i) + 1 >= least and sum(size[min(i, j) : max(i, j) + 1]) >= words):
                    j += step
                if 0 <= j < n:
                    spans.add((min(i, j), max(i, j)))
        for i, j in spans:
            runs.setdefault(tuple(w for x in s[i : j + 1] for w in x[1]), set()).add((d, i, j))
    drop = {}
    for places in runs.values():
        for d, i, j in sorted(places)[1:]:
            drop.setdefault(d, set()).update(range(i, j + 1))
    out = []
    for (d, b, s), (_, t) in zip(docs, rows, strict=True):
        edges = [x[0] for x in s] + [len(b)]
        out.append((d, t if not s else (b[: edges[0]] + b"".join(b[edges[i] : edges[i + 1]] for i in range(len(s)) if i not in drop.get(d, ()))).decode()))
    return sorted(out, key=str)


def test_spans(spark, odd, empty, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert sorted(((r.id, r.text) for r in dedup_spans(documents).collect()), key=str) == brute_spans(rows)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(((r.id, r.text) for r in dedup_spans(odd).collect()), key=str) == brute_spans(rows)
    assert dedup_spans(empty).count() == 0
    passage = " ".join(f"Sentence {i} has some words of its own." for i in range(8))
    texts = spark.createDataFrame([(1, "Start. " + passage), (2, "Other start here.\n" + passage + " End of it.")], "doc_id long, text string")
    got = {r.id: r for r in dedup_spans(texts).collect()}
    assert got[1].text == "Start. " + passage and got[2].text == "Other start here.\nEnd of it." and len(got[2].removed) == 1


def test_spans_of_one_sentence_and_whole_texts(spark, odd, tmp_path):
    """The query also removes a long passage that is one sentence, and whole copies of any length."""
    from grainmill.llm.queries import op7_sentence_span_dedup

    passage = " ".join(f"w{i}" for i in range(51)) + "."
    below = " ".join(f"v{i}" for i in range(49)) + "."
    texts = ["One. " + passage + " Two.", "Three. " + passage.upper() + " Four.", passage, "Five. " + below, "Six. " + below, "Short one.", "short  ONE.", "Short one. More.", "é", "é", "", None, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op7_sentence_span_dedup(spark, str(tmp_path)).collect()}
    assert [got[i].text for i in range(len(texts))] == [texts[0], "Three. Four.", "", texts[3], texts[4], texts[5], "", texts[7], "é", "", "", None, "", None]
    left = {r.id: r.text for r in dedup_spans(odd, alone=50, whole=True).collect()}
    whole = {r.doc_id: r.text for r in odd.collect()}
    assert left == whole | {8: "", 10: ""}


def test_digest(documents, spark, data):
    from grainmill.llm.queries import op8_benchmark_decontamination

    assert {r.items_sha256 for r in op8_benchmark_decontamination(spark, data).where("n_items = 0").collect()} == {hashlib.sha256(b"").hexdigest()}


def test_long_lists_are_compared_in_cells(spark, monkeypatch):
    """A stray meets every member of another component once or, if both are strays, in one order; no cell holds a whole list and no rows are pairs."""
    rng = np.random.default_rng(5)
    rows, sets = [], {}
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for c in range(300):
        s = base[rng.permutation(400)[: int(rng.integers(60, 130))]] if c % 3 else np.unique(np.concatenate([base[: 40 + c % 80], rng.integers(0, 1 << 63, c % 7, dtype=np.uint64)]))
        sets[c] = s
        rows.append((7, c, len(s), int(rng.integers(0, 9)), c % 40 if c % 5 else 1000, 300, 1000, J._signature(s)))
    monkeypatch.setattr(J, "CELL", 64)
    members = spark.createDataFrame(rows, "token long, cls long, n int, pos int, comp long, size long, main_comp long, sign binary").repartition(3)
    cells = J._cells(members)
    assert cells.groupBy("i", "j").count().agg(F.max("count")).first()[0] <= 4 * 64
    got = [tuple(r) for r in cells.groupBy("token", "i", "j").applyInArrow(J._meet((3, 4)), "cls long, other long").collect()]
    want = []
    for _, a, n, p, comp, *_ in rows:
        for _, b, m, q, other, *_ in rows:
            if other != 1000 and comp != other and (comp == 1000 or a < b) and 4 * min(n, m) >= 3 * max(n, m) and 7 * min(n - p, m - q) >= 3 * (n + m):
                if 7 * J._differing(pa.py_buffer(J._signature(sets[a])), pa.py_buffer(J._signature(sets[b]))) <= n + m:
                    want.append((a, b))
    assert want and sorted(got) == sorted(want)
