"""Column functions over candidate probability arrays, in candidate order.

Arrays are ``array<double>``; a question's candidates, probabilities and targets
are aligned by position. Ties go to the first position everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(values: Col) -> Column:
    return F.aggregate(_c(values), F.lit(0.0), lambda a, x: a + x)


def dot(a: Col, b: Col) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def argmax(p: Col) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(_c(p), F.array_max(_c(p))) - 1).cast("int")


def one_hot(size: Col, at: Col) -> Column:
    """1 at a zero-based position, 0 elsewhere."""
    return F.transform(F.sequence(F.lit(0), _c(size) - 1), lambda i: F.when(i == _c(at), 1.0).otherwise(0.0))


def uniform(size: Col) -> Column:
    return F.array_repeat(1.0 / _c(size), _c(size))


def renormalize(p: Col) -> Column:
    """Scaled to a sum of 1; uniform if the sum is 0."""
    return let(F.struct(_c(p).alias("p"), total(p).alias("s")), lambda v: F.when(v["s"] > 0, F.transform(v["p"], lambda x: x / v["s"])).otherwise(uniform(F.size(v["p"]))))


def clip_renormalize(p: Col) -> Column:
    """Negative mass counts as none, then as ``renormalize``."""
    return renormalize(F.transform(_c(p), lambda x: F.greatest(x, F.lit(0.0))))


def softmax(logits: Col) -> Column:
    """Shifted by the maximum, so that no term overflows."""
    shifted = let(_c(logits), lambda v: let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m))))
    return let(shifted, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def log_sum_exp(values: Col) -> Column:
    return let(_c(values), lambda v: let(F.array_max(v), lambda m: m + F.log(total(F.transform(v, lambda x: F.exp(x - m))))))


def log_softmax(logits: Col) -> Column:
    return let(_c(logits), lambda v: let(log_sum_exp(v), lambda z: F.transform(v, lambda x: x - z)))


def temperature_scale(p: Col, temperature: Col | float) -> Column:
    """p to the power 1/T, normalised; candidates without mass stay without."""
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else _c(temperature)
    return renormalize(F.transform(_c(p), lambda x: F.when(x > 0, F.exp(F.log(x) / t)).otherwise(0.0)))


def entropy(p: Col) -> Column:
    return -total(F.transform(_c(p), lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)))


def margin(p: Col) -> Column:
    """First minus second largest; the largest itself if there is one only."""
    return let(F.sort_array(_c(p), asc=False), lambda s: F.element_at(s, 1) - F.coalesce(F.get(s, F.lit(1)), F.lit(0.0)))


def log_linear_pool(p: Col, q: Col, a: float = 0.5, b: float = 0.5) -> Column:
    """softmax(a ln p + b ln q), with probabilities floored at 1e-12."""
    log = lambda x: F.log(F.greatest(x, F.lit(1e-12)))
    return softmax(F.zip_with(_c(p), _c(q), lambda x, y: a * log(x) + b * log(y)))


def linear_fusion(base: Col, aux: Col, weight: float, cutoff: float) -> Column:
    """(1-w) base + w aux where the base's largest probability is at most the cutoff, else the base."""
    return F.when(F.array_max(_c(base)) <= cutoff, F.zip_with(_c(base), _c(aux), lambda x, y: (1 - weight) * x + weight * y)).otherwise(_c(base))


def commit_band(p_true: Col, no_margin: float, yes_margin: float) -> Column:
    """Moves a true-probability strictly inside (0.2, 0.8) to 0.199 or 0.801 once it is far enough from a half; a half itself is a yes."""
    p = _c(p_true)
    inside = (p > 0.2) & (p < 0.8)
    yes = (p >= 0.5) & (p - 0.5 >= yes_margin)
    no = (p < 0.5) & (0.5 - p >= no_margin)
    return F.when(inside & yes, 0.801).when(inside & no, 0.199).otherwise(p)


def add_bias(log_masses: Col, bias: Col) -> Column:
    """Positional offsets on log masses, as probabilities."""
    return softmax(F.zip_with(_c(log_masses), _c(bias), lambda x, b: x + F.coalesce(b, F.lit(0.0))))


def affine_sigmoid(log_margin: Col, scale: float, bias: float, temperature: float = 1.0) -> Column:
    """sigmoid(scale * margin * T + bias), inside [1e-12, 1 - 1e-12]."""
    z = F.lit(scale * temperature) * _c(log_margin) + F.lit(bias)
    return F.least(F.greatest(1 / (1 + F.exp(-z)), F.lit(1e-12)), F.lit(1 - 1e-12))


def choice_confidence(p: Col) -> Column:
    """Largest probability above chance, as a share of what is possible."""
    return let(F.size(_c(p)).cast("double"), lambda n: F.when(n > 1, (F.array_max(_c(p)) - 1 / n) / (1 - 1 / n)).otherwise(1.0))


def expected_score(p: Col, ordinals: Col) -> Column:
    return dot(p, ordinals)


def mean_absolute_deviation(p: Col, ordinals: Col) -> Column:
    return let(expected_score(p, ordinals), lambda m: total(F.zip_with(_c(p), _c(ordinals), lambda x, o: x * F.abs(o - m))))


def score_confidence(p: Col, ordinals: Col) -> Column:
    """1 minus the deviation around the mean, as a share of a uniform answer's."""
    flat = mean_absolute_deviation(uniform(F.size(_c(p))), ordinals)
    return let(flat, lambda u: F.when(u > 0, F.greatest(1 - mean_absolute_deviation(p, ordinals) / u, F.lit(0.0))).otherwise(1.0))


def shortlist_rescore(p: Col, rerank: Col, k: int) -> Column:
    """Keep the k largest of ``p`` and spread their joint mass by ``rerank`` among them; the others stay as they are."""
    ranked = F.array_sort(F.transform(_c(p), lambda x, i: F.struct((-x).alias("m"), i.alias("i"))))
    chosen = F.transform(F.slice(ranked, 1, k), lambda s: s["i"])

    def spread(c: Column) -> Column:
        mass = total(F.transform(c, lambda i: F.get(_c(p), i)))
        weight = total(F.transform(c, lambda i: F.get(_c(rerank), i)))
        return F.transform(_c(p), lambda x, i: F.when(F.array_contains(c, i), F.when(weight > 0, mass * F.get(_c(rerank), i) / weight).otherwise(x)).otherwise(x))

    return let(chosen, spread)


def split_parent(masses: Col, parent: Col, children: Col) -> Column:
    """In a map of candidate masses, replace the parent by its children's shares scaled by its mass."""
    m, kids = _c(masses), _c(children)
    scaled = F.transform_values(kids, lambda _, v: v * F.element_at(m, _c(parent)))
    return F.when(F.map_contains_key(m, _c(parent)), F.map_concat(F.map_filter(m, lambda k, _: k != _c(parent)), scaled)).otherwise(m)


# Candidate edits: arrays of struct<id, description, ...> with a map of target mass by id.


def permute(candidates: Col, seed: int) -> Column:
    """A keyed order of the candidates; the target follows the ids, so it does not change."""
    return F.transform(F.array_sort(F.transform(_c(candidates), lambda c: F.struct(F.sha2(F.concat_ws("|", F.lit(str(seed)), c["id"]), 256).alias("k"), c.alias("c")))), lambda s: s["c"])


def remove_candidate(candidates: Col, target: Col, gone: Col) -> Column:
    """Struct of candidates and target without an id; its mass goes to ``__nota__`` if there is one, else the rest is normalised."""
    kept = F.filter(_c(candidates), lambda c: c["id"] != _c(gone))
    rest = F.map_filter(_c(target), lambda k, _: k != _c(gone))
    mass = F.coalesce(F.try_element_at(_c(target), _c(gone)), F.lit(0.0))
    to_nota = F.transform_values(rest, lambda k, v: F.when(k == "__nota__", v + mass).otherwise(v))
    sum_ = total(F.map_values(rest))
    scaled = F.when(sum_ > 0, F.transform_values(rest, lambda _, v: v / sum_)).otherwise(F.transform_values(rest, lambda _, v: 1.0 / F.size(kept)))
    return F.struct(kept.alias("candidates"), F.when(F.map_contains_key(rest, "__nota__"), to_nota).otherwise(scaled).alias("target"))


def add_candidate(candidates: Col, target: Col, new: Column) -> Column:
    """Struct with one more candidate that has no mass; unchanged if its id is there."""
    there = F.exists(_c(candidates), lambda c: c["id"] == new["id"])
    return F.struct(F.when(there, _c(candidates)).otherwise(F.concat(_c(candidates), F.array(new))).alias("candidates"), F.when(there, _c(target)).otherwise(F.map_concat(_c(target), F.create_map(new["id"], F.lit(0.0)))).alias("target"))


# Row metrics: probabilities p against a target distribution y.


def accuracy(p: Col, y: Col) -> Column:
    return (argmax(p) == argmax(y)).cast("double")


def nll(p: Col, y: Col, floor: float = 1e-12) -> Column:
    return -total(F.zip_with(_c(p), _c(y), lambda a, b: b * F.log(F.greatest(a, F.lit(floor)))))


def kl(p: Col, y: Col) -> Column:
    return total(F.zip_with(_c(p), _c(y), lambda a, b: F.when(b > 0, b * (F.log(b) - F.log(F.greatest(a, F.lit(1e-12))))).otherwise(0.0)))


def brier(p: Col, y: Col) -> Column:
    return total(F.zip_with(_c(p), _c(y), lambda a, b: (a - b) * (a - b)))


def cumulative(p: Col) -> Column:
    start = F.array().cast("array<double>")
    return F.aggregate(_c(p), start, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + x)))


def rps(p: Col, y: Col) -> Column:
    """Mean squared difference of the two cumulative distributions over the first k-1 levels; null under two levels."""
    gaps = F.zip_with(cumulative(p), cumulative(y), lambda a, b: (a - b) * (a - b))
    return F.when(F.size(_c(p)) >= 2, total(F.slice(gaps, 1, F.size(_c(p)) - 1)) / (F.size(_c(p)) - 1))


def jsd(p: Col, y: Col) -> Column:
    """Jensen-Shannon divergence in nats."""
    half = lambda a, m: F.when(a > 0, a * F.log(a / m)).otherwise(0.0)
    return total(F.zip_with(_c(p), _c(y), lambda a, b: let((a + b) / 2, lambda m: 0.5 * half(a, m) + 0.5 * half(b, m))))


def total_variation(p: Col, q: Col) -> Column:
    return total(F.zip_with(_c(p), _c(q), lambda a, b: F.abs(a - b))) / 2


def largest_gap(p: Col, q: Col) -> Column:
    return F.array_max(F.zip_with(_c(p), _c(q), lambda a, b: F.abs(a - b)))


def missing_evidence_penalty(p: Col, tau: float) -> Column:
    return let(F.greatest(F.array_max(_c(p)) - tau, F.lit(0.0)), lambda x: x * x)


def log_space_nll(logits: Col, y: Col) -> Column:
    """Negative log likelihood without the detour over probabilities."""
    return -dot(y, log_softmax(logits))


def ordinal_error(p: Col, ordinals: Col, gold: Col) -> Column:
    """Absolute error of the expected score as a share of the ordinals' range."""
    spread = F.array_max(_c(ordinals)) - F.array_min(_c(ordinals))
    return F.abs(expected_score(p, ordinals) - F.get(_c(ordinals), _c(gold))) / spread


def chance_ordinal_error(ordinals: Col, gold: Col) -> Column:
    """The same error of a uniform answer's expected score."""
    return ordinal_error(uniform(F.size(_c(ordinals))), ordinals, gold)
