"""Operators on single rows and sums: pseudonyms, toxicity, mixture, shards, packed ids, chat lines, quality."""

import json
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.llm import packed_ids as K
from grainmill.llm import quality_rules as QR
from grainmill.llm import queries as Q
from grainmill.llm import source_mixture as M
from grainmill.llm import toxic_spans as TX
from grainmill.llm.extendible_shards import assign_shards
from grainmill.llm.pii_pseudonyms import luhn_sum, permute_digits, pseudonymise
from grainmill.llm.tool_calls import chat_lines

# pseudonyms


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10


def test_pseudonyms_keep_format_and_links(spark):
    text = [
        "a.b@x.org A.B@X.org 10.20.30.40 card 4111 1111 1111 1111; 4111111111111111 and 4111111111111112",
        "+1 (136) 555-7479% 136-555-7479 ssn 123-45-6789 2024-02-29 02/29/2024 February 29, 2024, not 2024-02-30 or v1.2.3.4.5",
        "GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765432 7536784127813050 4845168114407329",
    ]
    df = spark.createDataFrame(list(enumerate(text)), "doc_id int, text string")
    out = [r for r in pseudonymise(df, "k").orderBy("doc_id").collect()]
    for r, t in zip(out, text, strict=True):
        assert re.sub("[0-9]", "9", re.sub("[A-Za-z0-9.]+@[^ ]+", "@", r.text))[:3] == re.sub("[0-9]", "9", re.sub("[A-Za-z0-9.]+@[^ ]+", "@", t))[:3]
        for p in r.pii:
            assert p.value not in t
    v = [[p.value for p in r.pii] for r in out]
    assert v[0][0] == v[0][1] and v[0][3].replace(" ", "") == v[0][4] and luhn(v[0][4]) == 0
    assert v[1][0][3:] == "(" + v[1][1][:3] + ") " + v[1][1][4:] and "2024-02-30" in out[1].text and "v1.2.3.4.5" in out[1].text
    day = {p.kind: p.value for p in out[1].pii}["date"]
    assert re.fullmatch("[A-Z][a-z]+ [0-9]{1,2}, [0-9]{4}", day)
    assert v[2][0].replace(" ", "") == v[2][1] and len(v[2]) == 4
    moved = v[2][1][4:] + v[2][1][:4]
    assert int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
    assert pseudonymise(df, "other").orderBy("doc_id").first().pii[2].value != v[0][2]


def test_pseudonyms_are_a_permutation(spark):
    for n in (1, 2, 3):
        d = spark.range(10**n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("d")).select(permute_digits(F.col("d"), "k", F.lit("t")).alias("p"))
        assert d.distinct().count() == 10**n
    assert spark.range(1).select(luhn_sum(F.lit("4111111111111111"))).first()[0] % 10 == 0


def test_pseudonyms_on_odd_rows(odd, empty):
    got = {r.doc_id: r for r in pseudonymise(odd, "k").where("doc_id <> 4 AND doc_id <> 10").collect()}
    assert all(got[r.doc_id].text == r.text and got[r.doc_id].pii == [] for r in odd.collect() if r.doc_id in got)
    assert pseudonymise(empty, "k").count() == 0


def test_pseudonyms_beside_other_numbers(spark):
    """A value is found, and linked to the same value elsewhere, whatever number stands beside it."""
    values = {"+1 (826) 555-4081": "phone", "555-123-4567": "phone", "+44 20 7946 0958": "phone", "4111 1111 1111 1111": "card", "4111111111111111": "card", "123-45-6789": "ssn", "190.137.223.204": "ip", "2024-02-29": "date", "02/29/2024": "date", "12.03.2024": "date", "GB82 WEST 1234 5698 7654 32": "iban"}
    # a group of four is as good a first group as any to a card, hence its own order
    beside = ["{} 10 items", "row 12 {}", "{} 12/25", "2024 {}", "10 {} 20", *(f"{v} {{}}" for v in values), "{} 1234567890123456"]
    rows = [v for v in values] + [b.format(v) for v in values for b in beside]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    out = [r for r in pseudonymise(df, "k").orderBy("doc_id").collect()]
    alone = {}
    for v, r in zip(values, out, strict=False):
        assert [p.kind for p in r.pii] == [values[v]] and r.text == r.pii[0].value
        alone[v] = r.pii[0].value
    at = len(values)
    for v in values:
        for b in beside:
            other = [w for w in values if b.startswith(w)]
            want = alone[v] if not other else None
            text = b.format(v)
            shown = f"{alone[other[0]]} {alone[v]}" if other else b.replace("{}", want)
            got = out[at].text if "1234567890123456" not in b else out[at].text[: len(alone[v]) + 1]
            assert got == (shown if "1234567890123456" not in b else alone[v] + " "), (text, out[at])
            at += 1
    numbers = " ".join(str(10 + i % 90) for i in range(5000))
    r = pseudonymise(spark.createDataFrame([(1, numbers)], "doc_id int, text string"), "k").first()
    assert r.text == numbers and r.pii == []


# toxicity


def brute_marginals(field, score):
    step, emit = np.exp(field.steps), np.stack([np.ones(len(score)), np.exp(score)], 1)
    f = [np.exp(field.start) * emit[0]]
    for e in emit[1:]:
        f.append(f[-1] @ step * e)
    b = [np.ones(2)]
    for e in emit[:0:-1]:
        b.append(step @ (e * b[-1]))
    both = np.array(f) * np.array(b[::-1])
    return both[:, 1] / both.sum(1)


def test_sparse_chain_equals_dense():
    rng = np.random.default_rng(3)
    field = TX.Field(np.zeros(0, np.uint64), np.zeros(0), rng.normal(size=2), rng.normal(size=(2, 2)))
    sizes = [1, 30, 0, 7, 1, 60]
    score = np.where(rng.random(sum(sizes)) < 0.3, rng.normal(size=sum(sizes)) * 2, 0.0)
    first = np.r_[0, np.cumsum(sizes)]
    place, got = TX.marginals(field, score, first)
    want = np.concatenate([brute_marginals(field, score[a:b]) if b > a else [] for a, b in zip(first[:-1], first[1:], strict=True)])
    assert np.allclose(got, want[place]) and (place == np.flatnonzero(score)).all()


def test_toxicity_held_out(spark, odd, empty):
    rng = np.random.default_rng(1)
    plain, bad = [f"word{i}" for i in range(400)], ["zarg", "blorp", "vextous", "vexting"]
    rows, labels = [], []
    for i in range(900):
        w = list(rng.choice(plain, 60))
        y = int(i % 4 == 0)
        for at in rng.integers(0, 60, 3 if y else 0):
            w[at] = str(rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    field = TX.train_on(docs, known.where("doc_id < 600"))
    got = {r.id: r for r in TX.score_toxicity(docs, field).collect()}
    assert all((got[i].score >= 0.7) == bool(y) for i, y in labels[600:])
    text = dict(rows)[600].encode()
    assert {text[s.start : s.stop].decode() for s in got[600].spans} <= set(bad) and got[600].spans
    assert {r.id: r.score for r in TX.score_toxicity(odd, field).collect()}[1] == 0.0
    assert TX.score_toxicity(empty, field).count() == 0
    none = TX.train_on(docs, known.limit(0))
    assert TX.score_toxicity(docs, none).agg(F.count_distinct("score")).first()[0] == 1


def test_toxicity_of_short_texts_and_tails(spark):
    """Texts under the length of a piece, and words only behind the last full one, are learnt from."""
    rng = np.random.default_rng(4)
    for size in (7, TX.PIECE + 7):
        rows, labels = [], []
        for i in range(400):
            w = [f"{k}word" for k in rng.integers(0, 300, size)]
            if i % 4 == 0:
                w[-1 - i % 5] = ["zarg", "blorp"][i // 4 % 2]
            rows.append((i, " ".join(w)))
            labels.append((i, int(i % 4 == 0)))
        docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
        field = TX.train_on(docs, known.where("doc_id < 300"))
        got = {r.id: r.score for r in TX.score_toxicity(docs, field).collect()}
        assert all((got[i] >= 0.7) == bool(y) for i, y in labels[300:]), size


def test_padding_does_not_change_the_fit():
    rng = np.random.default_rng(6)
    index, toxic = rng.integers(-1, 4, (30, 5, 2)), rng.random((30, 5)) < 0.3
    features = np.arange(1, 5, dtype=np.uint64)
    want = TX.fit_field(features, index, toxic)
    padded = np.pad(index, ((0, 0), (0, 3), (0, 0)), constant_values=-1)
    got = TX.fit_field(features, padded, np.pad(toxic, ((0, 0), (0, 3))), real=np.arange(8) < np.full((30, 1), 5))
    assert np.allclose(got.weights, want.weights) and np.allclose(got.start, want.start) and np.allclose(got.steps, want.steps)


# mixture


def test_waterfill_and_tree():
    assert M.waterfill([10, 10, 100], [5, 2, 1], 120, 3) == pytest.approx([30, 30, 60])
    assert sum(M.waterfill([3, 4, 5, 6], [5, 2, 1, 5], 18, 3)) == pytest.approx(18)
    dealt = M.split_draws([1000, 10, 0], 7, 1)
    assert dealt.sum(0).tolist() == [1000, 10, 0] and dealt.sum(1).max() - dealt.sum(1).min() <= 3


def test_mixture(spark, documents, odd, empty):
    rows = M.mix_sources(documents, block_words=500).collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    by = defaultdict(list)
    for r in rows:
        assert r._mix_size == size[r.doc_id] and r._mix_taken == r._mix_size * len(r._mix_shards) <= 3 * r._mix_size
        by[r.source].append(r)
    for own in by.values():
        assert own[0]._mix_source_size == sum(r._mix_size for r in own)
        target = own[0]._mix_target
        assert abs(sum(r._mix_taken for r in own) - target) <= 0.1 * target + 60
    assert sum(own[0]._mix_target for own in by.values()) == pytest.approx(sum(size.values()))
    again = M.mix_sources(documents.repartition(7), block_words=500)
    assert sorted((r.doc_id, r._mix_taken, r._mix_shards) for r in again.collect()) == sorted((r.doc_id, r._mix_taken, r._mix_shards) for r in rows)
    assert M.mixed_rows(again).count() == sum(len(r._mix_shards) for r in rows)
    got = M.mix_sources(odd).collect()
    assert len(got) == odd.count() and all(r._mix_size == 0 for r in got if r.doc_id < 4)
    assert M.mix_sources(empty).count() == 0


# shards


def test_shards(spark, odd, empty, documents):
    import duckdb

    from grainmill.llm import sql

    for limit in (200, 20_000):
        got = assign_shards(documents, limit).select("doc_id", "n_bytes", "shard", "shard_depth", "shard_bytes", "shard_docs")
        c = duckdb.connect()
        c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
        assert sorted(tuple(r) for r in got.collect()) == sorted(c.execute(sql.extendible_sharding(limit)).fetchall())
    rows = assign_shards(odd, 100).collect()
    total = defaultdict(int)
    for r in rows:
        total[r.shard] += r.n_bytes
    assert len(rows) == odd.count() and all(total[r.shard] == r.shard_bytes for r in rows)
    assert all(r.shard_bytes <= 100 or len({x.doc_id for x in rows if x.shard == r.shard}) == 1 for r in rows)
    assert assign_shards(empty, 100).count() == 0


def test_shards_keep_columns_named_as_the_directory(spark):
    names = ["depth", "prefix", "cell", "h", "h0", "b"]
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 10).alias("text"), *[F.col("id").alias(n) for n in names])
    got = assign_shards(rows, 50).collect()
    assert len(got) == 40 and all(r[n] == r.doc_id for r in got for n in names)
    assert len({r.shard for r in got}) > 1 and all(len(r.shard) == r.shard_depth for r in got)


# packed ids


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 20, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype(np.uint32)
    packed = K.pack(ids, bits)
    assert len(packed) == -(-1001 * bits // 8) and (K.unpack(packed, bits, 0, 1001) == ids).all()
    assert (K.unpack(packed, bits, 333, 100) == ids[333:433]).all() and K.width_of(2**bits) == bits


def test_encoder_equals_library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    raw = open(P.path("word_bpe_49k.json"), "rb").read()
    library, own = Tokenizer.from_str(raw.decode()), K.Encoder(raw)
    odd_ = ["a<|endoftext|>b c", "don't, 'tis it's!!'s ,'s", "É…, é.x x≠ y", "a b　c d\x1ce", "ΣΑΣ, ΑΣ.", "١٢3 4.5,6", "", "  ", "x́, é.", "İstanbul ẞ ß K", "\x00a\x01.b \x85 a b", "a.̸b", "naïve ª º ÿ Ÿ ×÷", "﻿a ​b"]
    for t in odd_ * 2:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_plain_words_are_cut_without_expressions(monkeypatch):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    raw = open(P.path("word_bpe_49k.json"), "rb").read()
    library, own = Tokenizer.from_str(raw.decode()), K.Encoder(raw)
    monkeypatch.setattr(K._Words, "_cut", None)
    monkeypatch.setattr(K._Words, "_capitals", None)
    marks = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    text = " ".join(["Plain", "WORDS", "end.", "Zq***", "so?!", *("Ab" + m for m in marks), "x" + marks])
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_packed_files(spark, odd, empty, documents, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for i, df in enumerate((documents, odd.where("doc_id NOT IN (4, 10)"))):
        path = str(tmp_path / str(i))
        K.write_packed(df, path, P.path("word_bpe_49k.json"), block_ids=700)
        got = sorted(tuple(r) for r in K.packed_documents(K.read_packed(spark, path)).collect())
        at, want = 0, []
        for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.text or "")):
            ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
            want.append((r.doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
            at += len(ids)
        assert got == sorted(want)
    K.write_packed(empty, str(tmp_path / "none"), P.path("word_bpe_49k.json"))
    assert K.packed_documents(K.read_packed(spark, str(tmp_path / "none"))).count() == 0


# chat lines


def test_chat_lines(spark, data):
    call = lambda **kw: json.dumps(kw)
    rows = [
        (1, 0, "user", "weather?"),
        (1, 1, "assistant", call(content="let me", tool_calls=[{"id": "b", "name": "sum", "arguments": {"x": {"$ref": "a"}, "n": "3"}}, {"id": "a", "function": {"name": "get", "arguments": '{"z":1,"city":"Oslo"}'}}])),
        (1, 2, "tool", call(tool_call_id="a", content={"t": 3, "b": [1, 2]})),
        (1, 3, "tool", call(tool_call_id="b", content="6")),
        (1, 4, "tool", call(tool_call_id="zz", content="6")),
        (1, 5, "tool", call(tool_call_id="b", content="7")),
        (2, 0, "assistant", call(tool_calls=[{"id": "p", "name": "get", "depends_on": ["q"], "arguments": {}}, {"id": "q", "name": "nope", "depends_on": ["p"]}, {"id": "p", "name": "get", "arguments": {"city": 5}}])),
        (2, 1, "user", None),
        (2, 2, None, "{bad json"),
        (None, 0, "user", "x"),
        (None, 0, "user", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("level", F.lit(9)).withColumn("status", F.lit("clash"))
    schemas = {"get": {"properties": {"city": "string", "z": "integer"}, "required": ["city"]}, "sum": {"properties": {"x": "object", "n": "number"}, "required": ["x"]}}
    got = chat_lines(df, schemas).orderBy("conv_id", "turn", "level", "json").collect()
    first = [(r.kind, r.call_id, r.status) for r in got if r.conv_id == 1]
    assert first == [("message", None, None), ("message", None, None), ("call", "a", "linked"), ("result", "a", "linked"), ("call", "b", "linked"), ("result", "b", "linked"), ("result", "zz", "orphan"), ("result", "b", "duplicate_result")]
    assert [r.json for r in got if r.call_id == "a"][0] == '{"arguments":{"city":"Oslo","z":1},"id":"a","name":"get"}'
    assert [r.errors for r in got if r.call_id == "b" and r.kind == "call"] == [["not number: n"]]
    second = sorted((r.call_id, r.status, tuple(r.errors)) for r in got if r.conv_id == 2 and r.kind == "call")
    assert second == [("p", "cycle", ("missing city",)), ("p", "duplicate_call", ("not string: city",)), ("q", "cycle", ("unknown tool nope",))]
    assert sum(r.conv_id is None for r in got) == 2
    assert chat_lines(df.limit(0)).count() == 0
    plain = spark.read.parquet(f"{data}/conversations.parquet")
    want = sorted((r.conv_id, r.turn, r.text) for r in plain.collect())
    assert sorted((r.conv_id, r.turn, json.loads(r.json)["content"]) for r in chat_lines(plain).collect()) == want


def test_call_query_runs_every_step(spark, data):
    """Calls are linked, put after what they depend on and checked in the registered query; every turn keeps its message."""
    turns = spark.read.parquet(f"{data}/conversations.parquet").collect()
    want = []
    for r in turns:
        want.append((r.conv_id, r.turn, 0, "message", None, None, (), {"content": r.text, "role": r.role}))
        if r.role != "assistant":
            continue
        t, n, draw = r.turn, len(r.text), zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 10
        filed = {"measured": {"$ref": f"{t}m"}, "size": str(n) if draw == 1 else n} | ({} if draw == 0 else {"title": f"turn {t}"})
        faults = ("missing title",) if draw == 0 else ("not integer: size",) if draw == 1 else ()
        want.append((r.conv_id, t, 1, "call", f"{t}m", "no_result" if draw == 2 else "linked", (), {"arguments": {"turn": t, "unit": "characters"}, "id": f"{t}m", "name": "measure"}))
        want.append((r.conv_id, t, 3, "call", f"{t}f", "linked", faults, {"arguments": filed, "id": f"{t}f", "name": "file"}))
        answers = [(t, 2, "m", "linked")] * (draw != 2) + [(t, 4, "f", "linked")] + [(t + 1, 2, "f", "duplicate_result")] * (draw == 3) + [(t, 2, "x", "orphan")] * (draw == 4)
        want += [(r.conv_id, at, level, "result", f"{t}{k}", status, (), {"content": n, "tool_call_id": f"{t}{k}"}) for at, level, k, status in answers]
    got = [(r.conv_id, r.turn, r.level, r.kind, r.call_id, r.status, tuple(r.errors), r.json) for r in Q.op6_tool_call_linking(spark, data).collect()]
    dumped = [(*w[:-1], json.dumps(w[-1], sort_keys=True, separators=(",", ":"), ensure_ascii=False)) for w in want]
    assert sorted(got, key=str) == sorted(dumped, key=str)
    assert {w[5] for w in want} == {None, "linked", "no_result", "duplicate_result", "orphan"} and {e for w in want for e in w[6]} == {"missing title", "not integer: size"}


def test_tool_turns_without_an_id_are_orphans(spark):
    rows = [(1, 0, "tool", "plain \u00e9 text"), (1, 1, "tool", None), (1, 2, "tool", '{"content":3}'), (1, 3, "user", "x")]
    got = sorted((r.turn, r.kind, r.status, json.loads(r.json).get("content")) for r in chat_lines(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect())
    assert got == [(0, "result", "orphan", "plain \u00e9 text"), (1, "result", "orphan", None), (2, "result", "orphan", '{"content":3}'), (3, "message", None, "x")]


# quality


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    where = defaultdict(list)
    for i in range(len(w) - 2):
        where[tuple(w[i : i + 3])].append(i)
    again = {k for v in where.values() if len(v) > 1 for i in v for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_counts(spark, odd, empty):
    more = ["a b c a b c", "x x x x x", "one\ntwo\n one\none\n\n", "a#b *c | <d>", "q r s t q r s z q r"]
    df = odd.drop("n").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"), allowMissingColumns=True).withColumn("n_words", F.lit(-1))
    got = QR.quality_counts(df).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(r.text), r.doc_id
    judged = {r.doc_id: r for r in QR.judge_quality(df).collect()}
    assert not judged[1].kept and judged[1].base_failed and judged[5].base_failed is False
    assert QR.judge_quality(empty).count() == 0


def test_repeats_of_a_very_long_text(spark):
    """Above 2^20 words unlike windows share the bits that are sorted; every repeat still counts."""
    n = 300_000
    words = F.expr(f"flatten(transform(sequence(0, {2 * n - 1}), i -> array('a' || (i % {n}), 'b' || (i % {n}), 'c' || (i % {n}), 'u' || i)))")
    assert spark.range(1).select(QR.repeat_words(words).alias("r")).first().r == 6 * n


def test_em_recovers_rates():
    rng = np.random.default_rng(2)
    good, bad = (0.999, 0.998, 0.999), (0.8, 0.6, 0.4)
    seen = defaultdict(int)
    for _ in range(20_000):
        y = rng.random() < 0.75
        v = tuple(None if rng.random() < 0.1 else int((rng.random() < a) == y) if y else int(rng.random() >= b) for a, b in zip(good, bad, strict=True))
        seen[v] += 1
    prior, a, b = QR.fit_accuracies(list(seen.items()), 3, 200)
    assert abs(prior - 0.75) < 0.05 and np.allclose(a, good, atol=0.05) and np.allclose(b, bad, atol=0.1)
    assert QR.posterior((1, 1, 1), prior, a, b) > 0.95 > QR.posterior((0, 0, 0), prior, a, b)


def test_verdicts_follow_labels(spark, documents, data):
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rows = QR.judge_quality(documents).where("NOT base_failed").join(labels, "doc_id").collect()
    assert sum(r.kept == bool(r.label) for r in rows) >= 0.95 * len(rows)


# pipeline


def test_pipeline_against_brute_force(spark, data):
    import corpus_pipeline as CP
    from test_text_joins import brute_components, brute_overlap

    docs = spark.read.parquet(f"{data}/documents.parquet")
    one = CP.quality_rules(spark, docs, data)
    rows = sorted((r.doc_id, r.text) for r in one.collect())
    assert one.columns == docs.columns
    two = CP.near_duplicates(spark, one, data)
    assert sorted(r.doc_id for r in two.collect()) == [d for d, _, c in brute_components(rows) if d == c]
    three = CP.decontamination(spark, two, data)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    left = {d for d, n, hit, _ in brute_overlap([(r.doc_id, r.text) for r in two.collect()], items) if not (hit and 20 * hit >= n)}
    assert {r.doc_id for r in three.collect()} == left
    final = CP.run(spark, data)
    assert {r.doc_id for r in final.collect()} <= left and set(docs.columns) <= set(final.columns)
