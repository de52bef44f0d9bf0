"""Line deduplication, spelling variants and conversation repair against brute force, on odd rows and on hot keys."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest

from grainmill.llm.conversation_repair import damage_turns, repair_turns, repaired_conversations
from grainmill.llm.line_dedup import dedup_lines
from grainmill.llm.spelling_variants import count_words, near_pairs, spelling_variants

WS = " \t\n\x0b\x0c\r"
UPPER = {c: c + 32 for c in range(65, 91)}


# -- lines


def brute_lines(rows, least_length, least_documents):
    key = lambda line: line.strip(WS).translate(UPPER)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_length:
                holders[key(line)].add(i)
    gone = {k: max(h, key=lambda v: (v is not None, v)) for k, h in holders.items() if len(h) >= least_documents}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if gone.get(key(line), i) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1 << 29, 1 << 15])
def test_lines_equal_brute_force(spark, bits):
    random.seed(3)
    pool = [f"{'Ä' * (n % 5)}line number {n} " * (1 + n % 4) for n in range(60)]
    rows = []
    for i in range(400):
        lines = random.choices(pool, weights=[1 / (1 + n) for n in range(60)], k=random.randrange(6))
        lines = [random.choice(["", " ", "\t\r"]) + (x.upper() if random.random() < 0.2 else x) + random.choice(["", "\r", "  "]) for x in lines]
        rows.append((random.choice([None, i, i, i, i // 9]), random.choice([None, "", "\n\n"]) if not lines else "\n".join(lines)))
    df = spark.createDataFrame([(i, t, "x", b"y") for i, t in rows], "doc_id long, text string, id string, digest binary").repartition(5)
    got = sorted(map(tuple, dedup_lines(df, least_length=20, least_documents=3, filter_bits=bits).collect()), key=str)
    assert got == brute_lines(rows, 20, 3)


def test_lines_odd(odd, empty, spark):
    assert dedup_lines(empty).collect() == []
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted(map(tuple, dedup_lines(odd, least_documents=2).collect()), key=str)
    assert got == brute_lines(rows, 40, 2)
    long_ = "\n".join(f"a line that many documents share {i % 700} and is long" for i in range(40_000))
    df = spark.createDataFrame([(str(i), long_) for i in range(6)], "doc_id string, text string")
    kept = {r["id"]: (len(r["text"]), r["n_dropped"]) for r in dedup_lines(df).collect()}
    assert kept == {str(i): (0, 40_000) for i in range(5)} | {"5": (len(long_), 0)}


def test_lines_count_code_points(spark):
    # 39 letters of two bytes are short, 40 are not; white space inside counts, at the ends it does not
    texts = ["é" * 39, "é" * 40, "x" * 38 + " y", "  " + "x" * 39 + "  "]
    df = spark.createDataFrame([(5 * j + i, t) for j, t in enumerate(texts) for i in range(5)], "doc_id long, text string")
    dropped = Counter(r["id"] // 5 for r in dedup_lines(df).where("n_dropped > 0").collect())
    assert dropped == {1: 4, 2: 4}


# -- words


def brute_variants(words, ratio=10):
    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        found = sorted(((-m, u) for u, m in words.items() if near(w, u)))
        form = found[0] if found and -found[0][0] >= ratio * n else None
        out[w] = (n, len(found), form[1] if form else None, -form[0] if form else None)
    rooted = {}
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        rooted[w] = (*out[w], root)
    return rooted


def test_variants_equal_brute_force(spark):
    random.seed(4)
    words = {}
    for _ in range(60):
        word = "".join(random.choices("abcdéÿ×", k=random.randrange(2, 12)))
        n = random.choice([2, 3, 10, 50, 4000])
        words[word] = n
        for _ in range(12):
            i, c = random.randrange(len(word) + 1), random.choice("abcdéÿ×Éz")
            word = random.choice([word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :]])
            if len(word) < 2:
                break
            words.setdefault(word, random.choice([1, 2, 20, 300, 5000]))
    df = spark.createDataFrame([(w, n, "k") for w, n in words.items()], "word string, n long, key string")
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling_variants(df).collect()}
    assert got == brute_variants(words)
    pairs = near_pairs(df).collect()
    assert len({frozenset((r["a"], r["b"])) for r in pairs}) == len(pairs) == sum(v[1] for v in got.values()) // 2


def test_chain_of_forms(spark):
    # each word is the next one's variant: the root is five links away
    words = {"a" * (7 + i): 3 * 10**i for i in range(6)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: r["root"] for r in spelling_variants(df).collect()}
    assert set(got.values()) == {"a" * 12}
    tie = spark.createDataFrame([("prefixe", 2), ("prefixb", 20), ("prefixa", 20), (None, 9)], "word string, n long")
    assert {r["word"]: (r["form"], r["n_near"]) for r in spelling_variants(tie).collect()} == {"prefixe": ("prefixa", 2), "prefixa": (None, 2), "prefixb": (None, 2)}
    assert spelling_variants(tie.limit(0)).collect() == []


def test_words_are_counted_whole(spark, odd, empty):
    assert count_words(empty).collect() == []
    texts = [(1, "Élan ÉLANS Banana banana BANANA x" * 3), (None, "banana-split banana"), (2, None), (3, ""), (4, " ".join(["word" + chr(97 + i % 26) * 3 for i in range(30_000)]))]
    expected = Counter()
    for i, t in texts:
        for w, n in Counter(x.translate(UPPER) for x in re.findall("[A-Za-zÀ-ÿ]+", t or "")).items():
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 3 == 0 else w
            if len(w) >= 5:
                expected[w] += n
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, n int")
    assert {r["word"]: r["n"] for r in count_words(df, least_length=5, delete_one_in=3).collect()} == {w: n for w, n in expected.items() if n >= 2}


# -- turns


def brute_repair(rows):
    """Least (cost, letters) by exhaustive recursion over every edit, without states or tight transitions."""
    text_of = lambda v: " " if v is None else str(v)
    per = defaultdict(list)
    for c, t, r, x in rows:
        h = zlib.crc32(f"{text_of(c)}:{text_of(t)}".encode()) % 20
        r, x = text_of(r), text_of(x)
        x = {1: "", 2: re.sub("[.!?]", "", x)}.get(h, x)
        per[c] += [(t, "user" if h == 4 else r, x)] * {0: 0, 3: 2}.get(h, 1)
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    out = {}
    for c, turns in per.items():
        turns.sort(key=lambda q: (q[0] is not None, q[0] or 0, q[1].encode(), q[2].encode()))
        faults, seen = [], set()
        for _, r, x in turns:
            bare = x.strip(WS)
            faults.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((r, x))

        @lru_cache(None)
        def best(i, q, inserted):
            found = [(0, "", ())] if i == len(turns) and q in ("", "a") else []

            def add(price, letter, line, rest):
                found.append((price + rest[0], letter + rest[1], line + rest[2]))

            for role in ("user", "assistant"):
                z = after.get((q, role[0]))
                if z and inserted < 3:
                    add(5, "I", (f"{role}:",), best(i, z, inserted + 1))
                if z and i < len(turns) and faults[i] in ("", "truncated"):
                    add(1 + 5 * bool(faults[i]), "R", (f"{role}:{turns[i][2]}",), best(i + 1, z, 0))
            if i < len(turns):
                add(2, "D", (), best(i + 1, q, 0))
                z = after.get((q, turns[i][1][:1]))
                if z and faults[i] in ("", "truncated"):
                    add(5 * bool(faults[i]), "K", (f"{turns[i][1]}:{turns[i][2]}",), best(i + 1, z, 0))
            return min(found, default=(1 << 40, "", ()))

        for i in range(len(turns), -1, -40):  # the recursion stays shallow
            best(max(i, 0), "", 0), best(max(i, 0), "s", 0), best(max(i, 0), "u", 0), best(max(i, 0), "a", 0)
        cost, audit, lines = best(0, "", 0)
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[c] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


TURNS = "conv_id long, turn long, role string, text string, piece int, place int, copies int"


def test_repair_equals_brute_force(spark):
    random.seed(6)
    rows = []
    for c in range(300):
        for t in range(random.randrange(9)):
            rows.append((c, random.choice([t, t, t, None, t + 3]), random.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), random.choice(["a.", "b!", "c", "c?\n", " ", "", None, "d\x0b", "e."])))
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], TURNS)
    got = {r["conv_id"]: tuple(r)[1:] for r in repaired_conversations(df, damage_turns(df)).collect()}
    assert got == brute_repair(rows)


def test_repair_on_the_table(spark, data):
    df = spark.read.parquet(f"{data}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in repaired_conversations(df, damage_turns(df)).collect()}
    assert got == brute_repair([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_conversations_that_cross_pieces(spark):
    """Two conversations hold nearly all rows, so they lie in several pieces; one id is null."""
    random.seed(7)
    rows = [(random.choice([7, 7, 7, None, 3, 9]), random.choice([None, *range(900)]), random.choice(["user", "assistant", "system", "tool", "", None]), random.choice(["a.", "b", "c!", " ", "", None, "d?\n", f"text {random.randrange(99)}."])) for _ in range(1500)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], TURNS)
    edits = repair_turns(damage_turns(df))
    assert edits.where("conv = 7").select("piece").distinct().count() > 1
    got = {r["conv_id"]: tuple(r)[1:] for r in repaired_conversations(df, damage_turns(df)).collect()}
    assert got == brute_repair(rows)


def test_repair_odd(spark):
    nothing = spark.createDataFrame([], TURNS)
    assert repaired_conversations(nothing, damage_turns(nothing)).collect() == []
    # a conversation of which every row is dropped keeps a row of zeros; many equal rows are one run of deletions
    gone = next(t for t in range(100) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    same = next(t for t in range(100) if zlib.crc32(f"2:{t}".encode()) % 20 > 4)
    df = spark.createDataFrame([(1, gone, "user", "x", 0, 0, 0)] + [(2, same, "user", "long " * 30_000 + ".", 0, 0, 0)] * 500, TURNS)
    got = {r["conv_id"]: tuple(r)[1:] for r in repaired_conversations(df, damage_turns(df)).collect()}
    assert got[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[2][:6] == (0, 0, 499, 0, 499, 2 * 500) and got[2][6] == "D" * 500
