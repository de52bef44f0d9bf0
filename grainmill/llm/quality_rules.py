"""Quality rules as weak supervision, in DataFrame operations alone.

Each rule looks at counts of one text and votes good, votes bad, or abstains.
How documents vote is summed by pattern of votes (at most 3^rules rows, however
many documents), expectation-maximisation on these sums estimates how often each
rule is right about good and about bad documents, and a document is kept if the
posterior probability that it is good reaches a half.

All counts of a document come from its own row: no text is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.plans.workspace import Workspace

_WORD = r"[^\x20\x09-\x0D]"
_GAP = r"[\x20\x09-\x0D]+"
#: Steps of expectation-maximisation at most, and the change of a rate below which it ends.
ITERATIONS, STILL = 100, 1e-10
COUNTS = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_letters", "n_stops", "n_shouts", "n_repeat_words", "n_lines", "n_dup_lines")
#: Rates stay this far from 0 and 1.
_FLOOR = 0.001
#: Prior of a rule's rate of right votes on good documents: its mean, and its weight in multiples of all
#: documents. Without it the likeliest fit takes the commonest kind of junk for a trait of good documents.
GOOD_MEAN, GOOD_WEIGHT = 0.998, 5.0


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains; SQL over the counts."""

    name: str
    bad: str
    good: str

    def vote(self) -> str:
        return f"CASE WHEN {self.bad} THEN 0 WHEN {self.good} THEN 1 END"


#: All in whole numbers, so that no vote hangs on rounding.
RULES = (
    Rule("symbols", "20 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    Rule("capitals", "100 * n_capitals > 30 * n_letters", "100 * n_capitals <= 10 * n_letters"),
    Rule("repetition", "100 * n_repeat_words > 40 * n_words", "100 * n_repeat_words <= 10 * n_words"),
    Rule("lines", "100 * n_dup_lines > 50 * n_lines", "100 * n_dup_lines <= 10 * n_lines"),
    Rule("shouting", "20 * n_shouts > n_words", "n_shouts = 0"),
    Rule("stops", "n_words > 60 * n_stops", "n_words <= 30 * n_stops"),
    Rule("word_length", "10 * word_chars > 75 * n_words OR 10 * word_chars < 25 * n_words", "10 * word_chars <= 65 * n_words AND 10 * word_chars >= 35 * n_words"),
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words of an array inside three-word windows that occur twice or more.

    Windows are compared by 64-bit hashes. In texts with any repeat the hashes are
    sorted beside their places, leading bits of the one and the place in a single
    number; neighbours are then compared by their whole hashes. Where two unlike
    hashes share those bits, whole hashes are sorted instead.
    """

    def covered(h: Column) -> Column:
        n = F.size(h)
        mask = F.expr("1L") * F.shiftleft(F.lit(1).cast("long"), 20) - 1
        mask = F.when(n < (1 << 20), mask).otherwise(F.lit((1 << 31) - 1))

        def by_place(packed_mask: Column) -> Column:
            packed, m = packed_mask["p"], packed_mask["m"]

            def same(p: Column, k: Column, step: int) -> Column:
                other = F.get(packed, k + step)
                return F.coalesce(F.get(h, p.bitwiseAND(m).cast("int")) == F.get(h, other.bitwiseAND(m).cast("int")), F.lit(False))

            def clash(p: Column, k: Column) -> Column:
                return (p.bitwiseAND(F.bitwise_not(m)) == F.get(packed, k + 1).bitwiseAND(F.bitwise_not(m))) & ~same(p, k, 1)

            def by_hash(pairs: Column) -> Column:
                equal = lambda p, k, step: F.coalesce(p["h"] == F.get(pairs, k + step)["h"], F.lit(False))
                return F.transform(F.filter(pairs, lambda p, k: equal(p, k, -1) | equal(p, k, 1)), lambda p: p["i"])

            hit = F.filter(packed, lambda p, k: same(p, k, -1) | same(p, k, 1))
            pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
            clashes = F.size(F.filter(packed, clash)) > 0
            places = F.sort_array(F.when(clashes, _let(pairs, by_hash)).otherwise(F.transform(hit, lambda p: p.bitwiseAND(m))))
            return _let(places, lambda s: F.aggregate(F.transform(s, lambda p, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(s, k + 1) - p, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, b: a + b))

        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))
        return _let(F.struct(packed.alias("p"), mask.alias("m")), by_place)

    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    hashed = F.transform(words, lambda x: F.xxhash64(x))
    return _let(_let(hashed, windows), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))


def quality_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the counts that rules use: words, their characters, symbols, capitals, letters, stops, shouts, lines and repeats.

    Names starting with ``_q_`` are reserved; input columns named as a count are
    replaced. A null text counts as an empty one, and an empty one has no words.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("long")

    trimmed = F.regexp_replace(text, "^" + _GAP, "")
    split = F.filter(F.split(trimmed, _GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))
    both = _let(split, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    per_line = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    out = docs.withColumns(
        {
            "_q_words": both,
            "_q_lines": per_line,
            "word_chars": count(_WORD),
            "n_symbols": count(r"[#*$%&|<>]"),
            "n_capitals": count("[A-Z]"),
            "n_letters": count("[A-Za-z]"),
            "n_stops": count(r"[.!?](?:[\x20\x09-\x0D]|$)"),
            "n_shouts": count("!!"),
        }
    )
    fields = {"n_words": F.col("_q_words.n"), "n_repeat_words": F.col("_q_words.r"), "n_lines": F.col("_q_lines.n"), "n_dup_lines": F.col("_q_lines.d")}
    return out.withColumns(fields).drop("_q_words", "_q_lines")


def fit_accuracies(patterns: list[tuple[tuple[int | None, ...], int]], rules: int, iterations: int = ITERATIONS) -> tuple[float, list[float], list[float]]:
    """Share of good documents, and each rule's rate of right votes on good and on bad ones, by expectation-maximisation.

    Both rates are estimated from the documents; that on good ones is drawn
    towards ``GOOD_MEAN``. Ends when no rate moves by ``STILL``, or after ``iterations``.

    ``patterns``: votes (1, 0 or None) and the number of documents that vote so.
    """
    prior, right_good, right_bad = 0.8, [GOOD_MEAN] * rules, [0.3] * rules
    total = sum(n for _, n in patterns)
    weight = GOOD_WEIGHT * total
    for _ in range(iterations if total else 0):
        mass, good, good_1, bad, bad_0 = 0.0, [0.0] * rules, [0.0] * rules, [0.0] * rules, [0.0] * rules
        for votes, n in patterns:
            p = posterior(votes, prior, right_good, right_bad)
            mass += n * p
            for j, v in enumerate(votes):
                if v is not None:
                    good[j] += n * p
                    good_1[j] += n * p * v
                    bad[j] += n * (1 - p)
                    bad_0[j] += n * (1 - p) * (1 - v)
        before = [prior, *right_good, *right_bad]
        prior = _inside((mass + 1) / (total + 2))
        right_good = [_inside((a + weight * GOOD_MEAN) / (b + weight)) for a, b in zip(good_1, good, strict=True)]
        right_bad = [_inside((a + 1) / (b + 2)) for a, b in zip(bad_0, bad, strict=True)]
        if max(abs(x - y) for x, y in zip(before, [prior, *right_good, *right_bad], strict=True)) < STILL:
            break
    return prior, right_good, right_bad


def _inside(rate: float) -> float:
    return min(1 - _FLOOR, max(_FLOOR, rate))


def posterior(votes: tuple[int | None, ...], prior: float, right_good: list[float], right_bad: list[float]) -> float:
    odds = math.log(prior / (1 - prior))
    for v, a, b in zip(votes, right_good, right_bad, strict=True):
        if v is not None:
            odds += math.log(a / (1 - b)) if v else math.log((1 - a) / b)
    return 1 / (1 + math.exp(-odds))


def vote_patterns(counts: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[tuple[tuple[int | None, ...], int]]:
    """Votes and number of documents with them, of documents with a word; at most 3^rules rows."""
    names = [f"v{i}" for i in range(len(rules))]
    votes = counts.where("n_words > 0").select(*[F.expr(r.vote()).alias(n) for r, n in zip(rules, names, strict=True)])
    return [(tuple(r[n] for n in names), r["count"]) for r in votes.groupBy(*names).count().orderBy(*names).collect()]


def judge_quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Input columns, the counts, and the verdict of the rules.

    The rules are fitted first and applied then; counts are written once, beside
    the input columns that the result needs (``keep``; all of them by default), and
    read for both.

    Adds ``quality`` (posterior probability of a good document), ``base_failed``
    (under 50 words, or more than half of them in repeated three-word windows) and
    ``kept`` (not base_failed, and ``quality`` at least ``threshold``). Rules are
    fitted on all documents with a word. Null, empty and blank texts have no
    words: base_failed. Repeated rows count each time and get equal verdicts. An
    empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c not in COUNTS] if keep is None else keep
    counts = Workspace(docs.sparkSession, "quality").table("counts", quality_counts(docs, text_col).select(*keep, *COUNTS))
    prior, right_good, right_bad = fit_accuracies(vote_patterns(counts, rules), len(rules))
    odds = F.lit(math.log(prior / (1 - prior)))
    for rule, a, b in zip(rules, right_good, right_bad, strict=True):
        odds = odds + F.expr(f"CASE ({rule.vote()}) WHEN 1 THEN {math.log(a / (1 - b))!r}D WHEN 0 THEN {math.log((1 - a) / b)!r}D ELSE 0D END")
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    out = counts.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
