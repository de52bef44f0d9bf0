"""Toxic spans by a linear-chain conditional random field over tokens.

Labels are of whole documents. Tokens are labelled from them first: in a
document with label 1 a token is a toxic one if its word, or a beginning of it,
is bound to label 1 by a likelihood-ratio test over documents. The field has two
states, clean and toxic; its features are those words and beginnings, and its
weights maximise the likelihood of the labelled tokens. A document's score is
the largest marginal of the toxic state over its whole text, which does not grow
with length as a sum would; offending spans are tokens whose marginal reaches a
half.

Tokens without any feature leave the states' scores at zero, so between the
tokens that have one the chain is a power of its transition matrix. Forward and
backward passes go from one such token to the next, for many documents side by
side. The marginals are those of the whole chain, at the cost of the few tokens
that matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm._bytes import ALNUM, Lookup, Words, chunks, mix, sequence_hash

_U = np.uint64
#: Lengths, in bytes, of the word beginnings that are features.
BEGINNINGS = (3, 4, 5, 6)
#: Documents of either label that fit the field, at most, in order of a hash of their ids.
SAMPLE = 1_500
#: Pieces of text, of so many tokens, that fit the weights, at most.
PIECES, PIECE = 20_000, 16
#: Likelihood ratio above which a feature is bound to label 1; features at most.
_RATIO, _FEATURES = 25.0, 20_000
_OUT = "id long, score double, spans array<struct<start: int, stop: int, marginal: double>>"


def token_features(words: Words) -> np.ndarray:
    """Hashes [token, feature]: the word, and its first bytes where it has as many; 0 elsewhere."""
    out = np.zeros((len(words.hash), 1 + len(BEGINNINGS)), _U)
    if not len(words.hash):
        return out
    out[:, 0] = words.hash
    size = words.stop - words.start
    folded = words.raw + ((words.raw >= 0x41) & (words.raw <= 0x5A)).astype(np.uint8) * np.uint8(32)
    value, done = np.zeros(len(size), _U), 0
    for k, n in enumerate(BEGINNINGS, 1):
        while done < n:
            value = value << _U(8) | folded[np.minimum(words.start + done, len(folded) - 1)].astype(_U)
            done += 1
        out[:, k] = np.where(size >= n, mix(value ^ _U(n) << _U(56)), _U(0))
    return out


@dataclass
class Field:
    """Weights of the toxic state by feature (ascending hashes), and of the first token's state and the transitions."""

    features: np.ndarray
    weights: np.ndarray
    start: np.ndarray
    steps: np.ndarray

    def emissions(self, words: Words, lookup: Lookup) -> np.ndarray:
        """Score of the toxic state of each token; that of the clean state is 0."""
        out = np.zeros(len(words.hash))
        if len(self.features):
            for column in token_features(words).T:
                token, at = lookup.find(np.ascontiguousarray(column))
                out[token] += self.weights[at]
        return out

    def power(self, gaps: np.ndarray) -> np.ndarray:
        """Powers of the transition matrix, scaled to a leading eigenvalue of 1."""
        values, vectors = np.linalg.eig(np.exp(self.steps))
        values, inverse = values.real / values.real.max(), np.linalg.inv(vectors)
        distinct, where = np.unique(gaps, return_inverse=True)
        table = np.einsum("ik,gk,kj->gij", vectors.real, values[None, :] ** distinct[:, None], inverse.real)
        return np.maximum(table, 0)[where]


def marginals(field: Field, score: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that have a score, and the marginal of their toxic state; ``first`` are the borders of documents."""
    place = np.flatnonzero(score)
    if not len(place):
        return place, np.zeros(0)
    doc = np.searchsorted(first, place, "right") - 1
    count = np.bincount(doc, minlength=len(first) - 1)
    border = np.r_[0, np.cumsum(count)]
    head = np.r_[True, doc[1:] != doc[:-1]]
    gap = np.where(head, place - first[doc], np.diff(place, prepend=0))
    moves = field.power(gap)
    rest = first[1:] - 1 - place[np.maximum(border[1:] - 1, 0)]
    back = field.power(np.where(count > 0, rest, 0)).sum(2)
    emit = np.stack([np.ones(len(place)), np.exp(np.clip(score[place], -30, 30))], 1)
    order = np.argsort(-count, kind="stable")
    active = np.searchsorted(-count[order], -np.arange(1, count.max() + 1), "right")
    state = np.tile(np.exp(field.start), (len(count), 1))
    forward, backward = np.empty((len(place), 2)), np.empty((len(place), 2))
    for k, n in enumerate(active):
        rows = order[:n]
        at = border[rows] + k
        now = np.einsum("ni,nij->nj", state[rows], moves[at]) * emit[at]
        forward[at] = state[rows] = now / now.sum(1, keepdims=True)
    for k, n in reversed(list(enumerate(active))):
        rows = order[:n]
        at = border[rows] + k
        backward[at] = back[rows] / back[rows].sum(1, keepdims=True)
        back[rows] = np.einsum("nij,nj->ni", moves[at], emit[at] * backward[at])
    both = forward * backward
    return place, both[:, 1] / both.sum(1)


def bound_features(docs: list[np.ndarray], labels: np.ndarray, clean_weight: float = 1.0) -> np.ndarray:
    """Of the distinct features of documents those whose documents have label 1 far more often than others, ascending.

    ``clean_weight`` is the number of documents that one of label 0 stands for, to one of label 1.
    """
    if not len(docs):
        return np.zeros(0, _U)
    every = np.concatenate(docs)
    label = np.repeat(labels, [len(s) for s in docs])
    feature, where = np.unique(every, return_inverse=True)
    a, n = np.bincount(where, label, len(feature)), np.bincount(where, minlength=len(feature)).astype(float)
    na, nn = float(labels.sum()), float(len(labels))

    def part(x: np.ndarray, of: np.ndarray, rate: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-12) / np.maximum(of * rate, 1e-12))

    ratio = 2 * (part(a, n, np.full_like(n, na / nn)) + part(n - a, n, np.full_like(n, 1 - na / nn)) + part(na - a, nn - n, np.full_like(n, na / nn)) + part(nn - n - (na - a), nn - n, np.full_like(n, 1 - na / nn)))
    good = np.flatnonzero((ratio >= _RATIO) & (a >= 0.8 * (a + clean_weight * (n - a))))
    good = good[np.argsort(-ratio[good], kind="stable")[:_FEATURES]]
    return np.sort(feature[good])


def fit_field(features: np.ndarray, index: np.ndarray, toxic: np.ndarray, rounds: int = 150, penalty: float = 0.02, real: np.ndarray | None = None) -> Field:
    """Maximise the likelihood of labelled pieces [piece, token] by Adam steps over exact marginals.

    ``index`` [piece, token, slot] are positions in ``features``, or -1; ``toxic`` the tokens' labels.
    ``real`` is false behind the last token of a shorter piece; all are tokens without it.
    """
    k = len(features)
    theta = np.zeros(k + 6)
    pieces, length = toxic.shape
    if not pieces:
        return Field(features, np.zeros(k), np.array([0.0, -8.0]), np.array([[0.0, -8.0], [0.0, -8.0]]))
    used = index >= 0
    real = np.ones(toxic.shape, bool) if real is None else real
    slot = np.where(used, index, k)
    hot = np.stack([1 - toxic, toxic], 2).astype(float) * real[:, :, None]
    want = np.r_[np.bincount(slot.ravel(), np.repeat(toxic.ravel(), index.shape[2]), k + 1)[:k], hot[:, 0].sum(0), np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:]).ravel()]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for turn in range(1, rounds + 1):
        weight = np.r_[theta[:k], 0.0]
        emit = np.stack([np.ones((pieces, length)), np.exp(np.clip(weight[slot].sum(2), -30, 30))], 2)
        start, step = np.exp(theta[k : k + 2]), np.exp(theta[k + 2 :].reshape(2, 2))
        forward, backward = np.empty((pieces, length, 2)), np.ones((pieces, length, 2))
        state = start * emit[:, 0]
        for t in range(length):
            state = state if t == 0 else np.where(real[:, t, None], (forward[:, t - 1] @ step) * emit[:, t], forward[:, t - 1])
            forward[:, t] = state / state.sum(1, keepdims=True)
        for t in range(length - 2, -1, -1):
            state = np.where(real[:, t + 1, None], (emit[:, t + 1] * backward[:, t + 1]) @ step.T, backward[:, t + 1])
            backward[:, t] = state / state.sum(1, keepdims=True)
        node = forward * backward
        node /= node.sum(2, keepdims=True)
        pair = forward[:, :-1, :, None] * step * (emit * backward)[:, 1:, None, :]
        pair *= real[:, 1:, None, None] / pair.sum((2, 3), keepdims=True)
        have = np.r_[np.bincount(slot.ravel(), np.repeat(node[:, :, 1].ravel(), index.shape[2]), k + 1)[:k], node[:, 0].sum(0), pair.sum((0, 1)).ravel()]
        slope = want - have - penalty * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta + 0.3 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return Field(features, theta[:k], theta[k : k + 2], theta[k + 2 :].reshape(2, 2))


def train(texts: list[str | None], labels: list[int], pieces: int = PIECES, clean_weight: float = 1.0) -> Field:
    """Label the tokens of labelled texts and fit the field. Copies, by their least shingle, count once."""
    seen, keys = [], []
    for _, words in chunks(pa.array(texts, pa.string()), ALNUM):
        every = token_features(words)
        shingle = sequence_hash(words.hash, 5)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            own = np.unique(every[a:b])
            seen.append(own[own != 0])
            keys.append(int(shingle[a : b - 4].min()) if b - a > 5 else int(words.hash[a]) if b > a else 0)
    once = {(key, label): i for i, (key, label) in reversed(list(enumerate(zip(keys, labels, strict=True))))}
    chosen = sorted(once.values())
    features = bound_features([seen[i] for i in chosen], np.array([labels[i] for i in chosen], float), clean_weight)
    del seen
    index, toxic, plain, sizes, plain_sizes = [], [], [], [], []
    for i in chosen if len(features) else ():
        for _, words in chunks(pa.array([texts[i]], pa.string()), ALNUM):
            f = token_features(words)
            count = len(f)
            f = np.pad(f, ((0, -count % PIECE), (0, 0)))
            at = np.searchsorted(features, f)
            at[at == len(features)] = 0
            at = np.where(features[at] == f, at, -1).astype(np.int32).reshape(-1, PIECE, f.shape[1])
            has = (at >= 0).any((1, 2))
            index.append(at[has])
            toxic.append((at[has] >= 0).any(2) & (labels[i] > 0))
            plain.append(at[~has][:2])
            size = np.minimum(count - np.arange(len(at)) * PIECE, PIECE)
            sizes.append(size[has])
            plain_sizes.append(size[~has][:2])
    if not index:
        return fit_field(features, np.zeros((0, PIECE, 1), int), np.zeros((0, PIECE)))
    index = [*index, *plain]
    toxic = [*toxic, *(np.zeros(p.shape[:2], bool) for p in plain)]
    at, y = np.concatenate(index), np.concatenate(toxic)
    real = np.arange(PIECE) < np.concatenate([*sizes, *plain_sizes])[:, None]
    if len(at) > pieces:
        take = np.argsort(mix(np.arange(len(at), dtype=_U)))[:pieces]
        at, y, real = at[take], y[take], real[take]
    return fit_field(features, at, y, real=real)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = shared.value
        lookup = Lookup(field.features) if len(field.features) else None
        base = field.power(np.array([10_000]))[0].sum(0)
        base = float(base[1] / base.sum())
        for batch in batches:
            score, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for low, words in chunks(batch.column(1), ALNUM):
                score[low : low + words.docs] = np.where(words.counts() > 0, base, 0.0)
                place, marginal = marginals(field, field.emissions(words, lookup), words.first)
                if not len(place):
                    continue
                doc = np.searchsorted(words.first, place, "right") - 1
                np.maximum.at(score, low + doc, marginal)
                # the byte at which each document's text begins in the chunk
                for p, d, x in zip(place.tolist(), doc.tolist(), marginal.tolist(), strict=True):
                    if x >= 0.5:
                        origin = int(words.edge[d])
                        spans[low + d].append({"start": int(words.start[p]) - origin, "stop": int(words.stop[p]) - origin, "marginal": x})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("marginal", pa.float64())])))], ["id", "score", "spans"])

    return run


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Field:
    """Fit the field on at most ``sample`` documents of either label, chosen by a hash of their ids."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).alias("label"))
    order = F.xxhash64(F.lit(7), "id")
    ids = known.where("label = 0").orderBy(order, "id").limit(sample).unionByName(known.where("label = 1").orderBy(order, "id").limit(sample))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), F.col("doc") == F.col("id")).select("id", "label", "text").collect()
    rows.sort(key=lambda r: (r.id, r.text or ""))
    totals = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    weight = (totals.get(0, 0) / max(1, min(sample, totals.get(0, 0)))) / (totals.get(1, 0) / max(1, min(sample, totals.get(1, 0))) or 1)
    return train([r.text for r in rows], [int(r.label) for r in rows], clean_weight=max(weight, 1.0))


def score_toxicity(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score whole texts: ``id``, ``score`` and ``spans`` (byte ranges of toxic tokens, with marginals).

    One row per input row. Null, empty and wordless texts score 0 and have no
    spans. Rows that repeat an id are scored each on its own. Other columns are
    ignored. An empty table gives an empty result; without labels of both kinds
    no feature is bound, and all texts score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score(shared), _OUT)
