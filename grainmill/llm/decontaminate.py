"""Benchmark decontamination: a prefix-filtered set join of item windows.

An item window is ``window`` consecutive words of a benchmark item (all of a
shorter item). It is held by a document when all of its shingles are there, in
place, so one shingle of each window is a sufficient prefix: the rarest, by
counts over all documents. Documents are scanned for these tokens only; a match
fixes where the window would lie, which the length and place of the document
may rule out, and the remaining ones are compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm._bytes import ALNUM, Lookup, Words, chunks, sequence_hash

#: Benchmark text broadcast at once. A larger benchmark is taken in blocks of this size, one pass over the documents each.
BLOCK_BYTES = 16 << 20
_WIDTH = 5
_OUT = "id long, n_words long, spans array<struct<start: int, stop: int>>, items array<string>"


class _Windows:
    """Distinct windows of a block of items, and the items that have each."""

    def __init__(self, ids: list[str], texts: list[str], window: int) -> None:
        known: dict[bytes, int] = {}
        self.words: list[np.ndarray] = []
        owners: list[set[int]] = []
        self.ids = ids
        for low, run in chunks(pa.array(texts, pa.string()), ALNUM):
            for i, (a, b) in enumerate(zip(run.first[:-1], run.first[1:], strict=True)):
                own = run.hash[a:b]
                size = min(window, len(own))
                for k in range(len(own) - size + 1 if size else 0):
                    key = own[k : k + size].tobytes()
                    if key not in known:
                        known[key] = len(self.words)
                        self.words.append(own[k : k + size])
                        owners.append(set())
                    owners[known[key]].add(low + i)
        self.owners = [sorted(o) for o in owners]
        self.shingles = [sequence_hash(w, min(_WIDTH, len(w))) for w in self.words]

    def by_width(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            out.setdefault(min(_WIDTH, len(w)), []).append(i)
        return out

    def vocabulary(self) -> np.ndarray:
        return np.unique(np.concatenate(self.shingles)) if self.shingles else np.zeros(0, np.uint64)

    def prefixes(self, count: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each width: sorted tokens, and for each the run of (window, place in it) it stands for."""
        out = {}
        for width, windows in self.by_width().items():
            rows = []
            for i in windows:
                place = min(range(len(self.shingles[i])), key=lambda k, s=self.shingles[i]: (count.get(int(s[k]), 0), int(s[k])))
                rows.append((int(self.shingles[i][place]), i, place))
            rows.sort()
            token = np.array([r[0] for r in rows], np.uint64)
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            out[width] = (token[first], np.r_[first, len(rows)], np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        return out


def _counts(vocabulary, widths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = Lookup(np.frombuffer(vocabulary.value, np.uint64))
        total = np.zeros(len(member.table), np.int64)
        for batch in batches:
            for _, words in chunks(batch.column(0), ALNUM):
                for width in widths:
                    _, at = member.find(sequence_hash(words.hash, width))
                    total += np.bincount(at, minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["at", "n"])

    return run


def _occurrences(words: Words, index: dict, content: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and windows of all window occurrences in a chunk."""
    starts, found = [], []
    for width, (member, first, window, place) in index.items():
        at, which = member.find(sequence_hash(words.hash, width))
        if not len(at):
            continue
        many = first[which + 1] - first[which]
        entry = np.repeat(first[which] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        start, w = np.repeat(at, many) - place[entry], window[entry]
        size = border[w + 1] - border[w]
        doc = np.searchsorted(words.first, np.repeat(at, many), "right") - 1
        fits = (start >= words.first[doc]) & (start + size <= words.first[doc + 1])
        start, w, size = start[fits], w[fits], size[fits]
        same = np.ones(len(w), bool)
        for k in range(int(size.max(initial=0))):
            rest = np.flatnonzero(same & (size > k))
            same[rest] = words.hash[start[rest] + k] == content[border[w[rest]] + k]
        starts.append(start[same])
        found.append(w[same])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(found)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _scan(block, first_pass: bool, last_pass: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, prefixes = block.value
        index = {width: (Lookup(token), first, window, place) for width, (token, first, window, place) in prefixes.items()}
        content = np.concatenate(windows.words) if windows.words else np.zeros(0, np.uint64)
        border = np.r_[0, np.cumsum([len(w) for w in windows.words])].astype(np.int64)
        spans_type, items_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.list_(pa.string())
        for batch in batches:
            n, where, who = [], {}, {}
            if not first_pass:
                for i, (s, t) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                    if s:
                        where[i], who[i] = [(x["start"], x["stop"]) for x in s], set(t)
            for low, words in chunks(batch.column(1), ALNUM):
                n += words.counts().tolist()
                start, w = _occurrences(words, index, content, border)
                doc = np.searchsorted(words.first, start, "right") - 1
                for d, a, x in zip(doc.tolist(), (start - words.first[doc]).tolist(), w.tolist(), strict=True):
                    where.setdefault(low + d, []).append((a, a + int(border[x + 1] - border[x])))
                    who.setdefault(low + d, set()).update(windows.ids[i] for i in windows.owners[x])
            rows = range(len(n))
            columns = {
                "id": batch.column(0),
                "n_words": pa.array(n, pa.int64()),
                "spans": pa.array([[{"start": a, "stop": b} for a, b in _union(where[i])] if i in where else [] for i in rows], spans_type),
                "items": pa.array([sorted(who[i]) if i in who else [] for i in rows], items_type),
            }
            if not last_pass:
                columns = {"id": columns["id"], "text": batch.column(1)} | columns
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[tuple[list[str], list[str]]]:
    ids, texts, used = [], [], 0
    for row in benchmark.where("id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        if ids and used + len(row.text) > limit:
            yield ids, texts
            ids, texts, used = [], [], 0
        ids.append(row.id)
        texts.append(row.text)
        used += len(row.text)
    yield ids, texts


def benchmark_overlap(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Words of each document that lie in a window of a benchmark item.

    Words are maximal runs of letters, digits and non-ASCII characters, with A-Z
    lower-cased. Returns one row per input row: ``id``, ``n_words``, ``spans``
    (disjoint word ranges inside window occurrences, in order) and ``items``
    (distinct ids, as strings, of items with an occurring window, sorted).

    Null or empty texts have no words, so no spans. Items with a null id, a null
    text or no words are ignored; repeated items count once. An empty documents
    table gives an empty result, an empty benchmark no spans. Rows that repeat an
    id stay separate rows, and other columns are ignored. The benchmark is
    taken in blocks of ``block_bytes`` characters, so what is broadcast does not
    grow with it; each further block is one more pass over the documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    current, pending, first = rows, None, True
    for ids, texts in _blocks(items, block_bytes):
        if pending is not None:
            current = current.mapInArrow(_scan(pending, first, False), "id long, text string, " + _OUT.removeprefix("id long, "))
            first = False
        windows = _Windows(ids, texts, window)
        vocabulary = windows.vocabulary()
        count: dict[int, int] = {}
        if len(vocabulary):
            shared = spark.sparkContext.broadcast(vocabulary.tobytes())
            seen = rows.select("text").mapInArrow(_counts(shared, sorted(windows.by_width())), "at int, n long").groupBy("at").sum("n").collect()
            count = {int(vocabulary[at]): n for at, n in seen}
        pending = spark.sparkContext.broadcast((windows, windows.prefixes(count)))
    return current.mapInArrow(_scan(pending, first, True), _OUT)


def contamination(overlap: DataFrame) -> DataFrame:
    """Adds ``n_hit``, ``n_items`` and ``contaminated`` (at least a twentieth of the words are hit)."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["stop"] - s["start"]))
    return overlap.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))
