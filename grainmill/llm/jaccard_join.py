"""N-gram Jaccard join: size-aware, with a light and a heavy part.

Documents become sets of distinct word shingles; equal sets form one class and
only classes are joined. Shingles are put in one global order, rarest first by
a fixed-size count sketch over all documents, so that linked sets must share
shingles among their first few.

* Light sets (at most ``boundary`` shingles) enumerate fixed-size subsets, here
  pairs, of their leading shingles: two linked sets share a pair.
* Heavy sets enter inverted lists by their leading shingles, which are scanned;
  light sets that a heavy one may still match enter the lists as well.
* The boundary is the one with the least estimated cost over the measured
  distribution of set sizes.

Members of a list are not paired with each other. Each is first compared with
one member of its list, links are closed into components, and only members of
different components of a list are compared again, until none is left. So a
group of copies costs work in proportion to its size, and no link between
components is lost. Every comparison intersects whole sets.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm._bytes import SPACED, chunks, mix, shingle_sets
from grainmill.operators.components import connected_components
from grainmill.plans.workspace import Workspace, freeing

#: log2 of the cells of the rarity sketch; 4 MB of counters at any corpus size.
SKETCH_BITS = 20
_PIECES = 64
#: Bits of the filter that spares sets no candidate needs; at most 32 MB.
_FILTER_BITS = (20, 28)
#: Rounds that compare one member per list or component before the exhaustive one.
_STAR_ROUNDS = 2
#: Members of a list that one head is compared with.
LIST_GROUP = 256
#: Members of a long list that the last round holds in a task at a time, on either side.
CELL = 1024
_SUBSET = np.uint64(0xA0761D6478BD642F)

_SUMMARY_NAMES = ["id", "n", "cls", "sign", "piece", "cells"]
_SUMMARY = "id long, n int, cls long, sign binary, piece int, cells binary"
_POSTING = "token long, cls long, n int, pos int"


def _squeeze(x: np.ndarray) -> bytes:
    return pa.compress(pa.py_buffer(np.ascontiguousarray(x)), codec="zstd", asbytes=True)


def _expand(data: pa.Buffer | bytes, dtype: str, cells: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=cells * np.dtype(dtype).itemsize, codec="zstd"), dtype)


def _class_of(shingles: np.ndarray) -> int:
    """One signed 64-bit name of a whole set."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(shingles)) ^ np.bitwise_xor.reduce(shingles)
        return int(mix(np.array([total ^ np.uint64(len(shingles))]))[0].astype(np.int64))


def _signature(shingles: np.ndarray) -> bytes:
    """Parities: bit i is that of the number of shingles that hash to i; about as many bits as shingles."""
    bits = 1 << max(6, (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd).tobytes()


def _differing(a: pa.Buffer, b: pa.Buffer) -> int:
    """Parities that differ, the longer signature folded to the length of the shorter: at most the shingles that only one set has."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(s.reshape(-1, size)) for s in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _summaries(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            size, name, sign = [], [], []
            for _, words in chunks(batch.column(1), SPACED):
                found = list(shingle_sets(words, width))
                size += map(len, found)
                name += [_class_of(s) if len(s) else 0 for s in found]
                sign += [_signature(s) if len(s) else None for s in found]
                if found:
                    cells += np.bincount((np.concatenate(found) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(cells))
            none = pa.nulls(len(size), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(size, pa.int32()), pa.array(name, pa.int64()), pa.array(sign, pa.binary()), none, pa.nulls(len(size), pa.binary())], _SUMMARY_NAMES)
        used = [(i, part) for i, part in enumerate(np.split(cells, _PIECES)) if part.any()]
        if used:
            empty = pa.nulls(len(used), pa.int64())
            yield pa.RecordBatch.from_arrays([empty, pa.nulls(len(used), pa.int32()), empty, pa.nulls(len(used), pa.binary()), pa.array([i for i, _ in used], pa.int32()), pa.array([_squeeze(np.minimum(p, 2**31 - 1).astype("<u4")) for _, p in used], pa.binary())], _SUMMARY_NAMES)

    return run


def _add_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = _expand(cells.as_buffer(), "<u4", (1 << SKETCH_BITS) // _PIECES).astype(np.int64)
            total[piece] = total[piece] + part if piece in total else part
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 2**31 - 1).astype("<u4").tobytes() for x in total.values()], pa.binary())], ["piece", "cells"])


def _needed(n: int, threshold: tuple[int, int]) -> int:
    """Least overlap of a set of n shingles with any set that it links to."""
    num, den = threshold
    return -(-num * n // den)


def _alone(n: int, threshold: tuple[int, int]) -> bool:
    """Whether a set of n shingles links with equal sets only, which are of its own class."""
    num, den = threshold
    return den * n < num * (n + 1)


def _in_lists(n: int, boundary: int, threshold: tuple[int, int]) -> bool:
    """Whether a set may link with a heavy one, or with one so small that a single shingle is overlap enough."""
    num, den = threshold
    return n * den > boundary * num or _needed(_needed(n, threshold), threshold) < 2


def _in_pairs(n: int, boundary: int, threshold: tuple[int, int]) -> bool:
    return n <= boundary and _needed(n, threshold) >= 2


def _lead(n: int, common: int, threshold: tuple[int, int]) -> int:
    """How many leading shingles hold ``common`` of those shared with any partner."""
    return min(n, n - _needed(n, threshold) + common)


def choose_boundary(sizes: list[tuple[int, int]], repeats: float, threshold: tuple[int, int]) -> int:
    """The light/heavy boundary of least cost. ``sizes``: (set size, number of sets).

    An enumerated subset costs one row. A posting costs one row, and ``repeats``
    further ones for the members of its list that it will be compared with.
    """

    def cost(b: int) -> float:
        total = 0.0
        for n, count in sizes:
            if _alone(n, threshold):
                continue
            if _in_pairs(n, b, threshold):
                p = _lead(n, 2, threshold)
                total += count * p * (p - 1) / 2
            if _in_lists(n, b, threshold):
                total += count * _lead(n, 1, threshold) * (1 + repeats)
        return total

    return min(range(0, 65, 4), key=lambda b: (cost(b), b))


def _postings(width: int, boundary: int, threshold: tuple[int, int], sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(sketch.value, "<u4")
        seen: set[int] = set()
        for batch in batches:
            for _, words in chunks(batch.column(0), SPACED):
                tokens, owner, size, place = [], [], [], []
                for s in shingle_sets(words, width):
                    n = len(s)
                    if _alone(n, threshold):
                        continue
                    name = _class_of(s)
                    if name in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(name)
                    rare = s[np.argsort(cells[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[: _lead(n, 2, threshold)]]
                    if _in_lists(n, boundary, threshold):
                        p = _lead(n, 1, threshold)
                        tokens.append(rare[:p])
                        place.append(np.arange(p, dtype=np.int32))
                        owner.append(np.full(p, name, np.int64))
                        size.append(np.full(p, n, np.int32))
                    if _in_pairs(n, boundary, threshold):
                        i, j = np.triu_indices(len(rare), 1)
                        low, high = np.minimum(rare[i], rare[j]), np.maximum(rare[i], rare[j])
                        tokens.append(mix(low * _SUBSET ^ high))
                        place.append((j - 1).astype(np.int32))
                        owner.append(np.full(len(i), name, np.int64))
                        size.append(np.full(len(i), n, np.int32))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owner)), pa.array(np.concatenate(size)), pa.array(np.concatenate(place))], ["token", "cls", "n", "pos"])

    return run


def _bits(name: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(name.view(np.uint64) if name.dtype == np.int64 else name)
    shift = np.uint64(64 - bits)
    return (h >> shift).astype(np.int64), (mix(h) >> shift).astype(np.int64)


def _filter_pieces(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits, bool)
        for batch in batches:
            for at in _bits(batch.column(0).to_numpy(), bits):
                own[at] = True
        used = [(i, part) for i, part in enumerate(np.split(np.packbits(own), _PIECES)) if part.any()]
        if used:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in used], pa.int32()), pa.array([_squeeze(p) for _, p in used], pa.binary())], ["piece", "bits"])

    return run


def _join_bits(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = _expand(data.as_buffer(), "u1", (1 << bits >> 3) // _PIECES)
                total[piece] = total[piece] | part if piece in total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["piece", "bits"])

    return run


def _sets(width: int, bits: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            needed = np.ones(len(ids), bool)
            for at in _bits(ids, bits):
                needed &= (keep[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            for _, words in chunks(batch.column(1).filter(pa.array(needed)), SPACED):
                found = [s for s in shingle_sets(words, width) if len(s)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([_class_of(s) for s in found], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in found], pa.binary())], ["cls", "items"])

    return run


def _compare(threshold: tuple[int, int]):
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = len(q) - 1
                both = int(np.count_nonzero(q[at] == p))
                keep.append(den * both >= num * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(rows: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, threshold: tuple[int, int], space: Workspace, name: str) -> DataFrame:
    """The pairs of classes (cls, other) whose sets link.

    Sets are made again from the texts of one document of each class in a pair; a
    filter of bounded size, which may let some more pass, spares the others. They
    are written in buckets by class, so that neither join shuffles them.
    """
    spark = rows.sparkSession
    ends = pairs.select("cls").unionByName(pairs.select(F.col("other").alias("cls"))).distinct()
    needed = classes.join(ends, "cls", "left_semi").select("least")
    bits = min(max(_FILTER_BITS[0], math.ceil(math.log2(8 * max(needed.count(), 1)))), _FILTER_BITS[1])
    schema, size = "piece int, bits binary", (1 << bits >> 3) // _PIECES
    with freeing(spark):
        pieces = {r.piece: bytes(r.bits) for r in needed.mapInArrow(_filter_pieces(bits), schema).repartition("piece").mapInArrow(_join_bits(bits), schema).collect()}
    wanted = spark.sparkContext.broadcast(b"".join(pieces.get(i, bytes(size)) for i in range(_PIECES)))
    buckets, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"grainmill_sets_{uuid.uuid4().hex}"
    sets = rows.mapInArrow(_sets(width, bits, wanted), "cls long, items binary").repartition(buckets, "cls")
    with freeing(spark):
        sets.write.format("parquet").bucketBy(buckets, "cls").option("path", space.path("sets")).saveAsTable(table)
    wanted.unpersist()
    try:
        sets = spark.table(table)
        both = pairs.join(sets.select(F.col("cls").alias("other"), F.col("items").alias("right")), "other").join(sets.select("cls", F.col("items").alias("left")), "cls")
        return space.table(name, both.select(F.col("cls").alias("a"), F.col("other").alias("b"), "left", "right").mapInArrow(_compare(threshold), "a long, b long"))
    finally:
        spark.sql(f"DROP TABLE {table}")
        space.drop("sets")


def _high(column: str):
    return F.expr(f"cast(shiftright({column}, 32) AS int)")


def _low(column: str):
    return F.expr(f"cast({column} & 4294967295 AS int)")


def _may_link(a: str, b: str, threshold: tuple[int, int]) -> str:
    """Length bound, and the bound from the places of a shared shingle, were it the first one."""
    num, den = threshold
    return f"{den} * least({a}n, {b}n) >= {num} * greatest({a}n, {b}n) AND {num + den} * least({a}n - {a}pos, {b}n - {b}pos) >= {num} * ({a}n + {b}n)"


def _alike(threshold: tuple[int, int]):
    """Keeps pairs that their signatures allow to link: linked sets have few shingles that only one of them has."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            keep = [(den + num) * _differing(x.as_buffer(), y.as_buffer()) <= (den - num) * n for n, x, y in zip(both.tolist(), batch.column(4), batch.column(5), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["cls", "other"]).filter(pa.array(keep, pa.bool_()))

    return run


def _folded(signs: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(signs.reshape(len(signs), -1, size), axis=1)


def _meet(threshold: tuple[int, int]):
    """Of one cell of a long list: pairs of a stray and a member of another component that lengths, places and signatures allow to link."""
    num, den = threshold

    def run(table: pa.Table) -> pa.Table:
        cls, n, pos, comp, main = (table[c].to_numpy().astype(np.int64) for c in ("cls", "n", "pos", "comp", "main_comp"))
        left = table["stray"].to_numpy(zero_copy_only=False).astype(bool)
        signs = table["sign"].combine_chunks()
        width = np.array([len(s.as_buffer()) for s in signs])
        by_width = {int(w): (at := np.flatnonzero(~left & (width == w)), np.stack([np.frombuffer(signs[int(i)].as_buffer(), np.uint8) for i in at])) for w in np.unique(width[~left])}
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in np.flatnonzero(left):
            own = np.frombuffer(signs[int(i)].as_buffer(), np.uint8)[None]
            for w, (at, others) in by_width.items():
                m, rest = n[at], n[at] - pos[at]
                fit = (comp[at] != comp[i]) & ((comp[at] == main[i]) | (cls[at] < cls[i]))
                fit &= (den * np.minimum(m, n[i]) >= num * np.maximum(m, n[i])) & ((num + den) * np.minimum(rest, n[i] - pos[i]) >= num * (m + n[i]))
                if not fit.any():
                    continue
                at, size = at[fit], min(w, own.shape[1])
                differing = np.bitwise_count(_folded(others[fit], size) ^ _folded(own, size)).sum(axis=1, dtype=np.int64)
                at = at[(den + num) * differing <= (den - num) * (n[at] + n[i])]
                a.append(cls[at])
                b.append(np.full(len(at), cls[i]))
        return pa.table({"cls": pa.array(np.concatenate(a)), "other": pa.array(np.concatenate(b))})

    return run


def _cells(members: DataFrame) -> DataFrame:
    """Members of long lists, dealt by class into parts of about ``CELL``: a stray goes to the cells of its part with every part, and every member to those of every part with its own."""
    parts = F.expr(f"shiftleft(1L, cast(ceil(log2(greatest(size / {CELL}, 1))) AS int))")
    dealt = members.withColumn("parts", parts).withColumn("part", F.expr("pmod(xxhash64(cls), parts)")).withColumn("each", F.explode(F.expr("sequence(0L, parts - 1)")))
    right = dealt.select(*members.columns, F.lit(False).alias("stray"), F.col("each").alias("i"), F.col("part").alias("j"))
    return right.unionByName(dealt.where("comp <> main_comp").select(*members.columns, F.lit(True).alias("stray"), F.col("part").alias("i"), F.col("each").alias("j")))


_NULL_ID = -(1 << 63)


def _given(id_: str | Column) -> Column:
    return F.nullif(F.col(id_) if isinstance(id_, str) else id_, F.lit(_NULL_ID))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: tuple[int, int] = (3, 4)) -> DataFrame:
    """Group documents whose shingle sets reach a Jaccard similarity, transitively.

    Words are maximal runs outside ASCII white space, with A-Z lower-cased; a
    set holds distinct runs of ``width`` words, or the whole sequence if there
    are fewer. ``threshold`` is a ratio of integers (at least 1/2), compared
    exactly: ``den * |intersection| >= num * |union|``.

    Returns one row per input row: ``id``, ``n_shingles`` and ``component``, the
    least id that links reach. Null or empty texts, and texts without words,
    have no shingles and are linked with nothing: each is its own component.
    Rows that repeat an id stay separate rows. Ids are integers; a null id is
    before all others, and a component that holds one has none. An empty table
    gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "jaccard")
    # a null id is the least one until the end
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    summary = space.table("summary", rows.mapInArrow(_summaries(width), _SUMMARY))
    members = summary.where("piece IS NULL").select("id", "n", "cls", "sign")

    with freeing(spark):
        pieces = {r.piece: bytes(r.cells) for r in summary.where("piece IS NOT NULL").select("piece", "cells").repartition("piece").mapInArrow(_add_cells, "piece int, cells binary").collect()}
    sketch = b"".join(pieces.get(i, bytes(4 << SKETCH_BITS - 6)) for i in range(_PIECES))
    # sizes by steps of an eighth: a few hundred rows for any corpus
    sizes = members.where("n > 0").groupBy(F.expr("CASE WHEN n < 128 THEN n ELSE cast(floor(power(2, floor(log2(n) * 8) / 8)) AS int) END").alias("n")).count().collect()
    counts = np.frombuffer(sketch, "<u4").astype(float)
    repeats = max(0.0, float((counts * counts).sum() / max(counts.sum(), 1) - counts.mean() - 1))
    boundary = choose_boundary([(r["n"], r["count"]) for r in sizes], min(repeats, 64.0), threshold)

    shared = spark.sparkContext.broadcast(sketch)
    # one exchange serves both the lists' heads and the scan of the lists; both read all its columns
    postings = rows.select("text").mapInArrow(_postings(width, boundary, threshold, shared), _POSTING).select("token", "cls", F.expr("shiftleft(cast(n AS bigint), 32) | pos").alias("place")).repartition("token")
    heads = postings.groupBy("token").agg(F.min(F.struct("cls", "place")).alias("head"), F.max("cls").alias("last"), F.count(F.lit(1)).alias("size")).where("head.cls <> last").select("token", "head", "size")
    found = postings.join(heads.hint("shuffle_hash"), "token").select("token", "cls", _high("place").alias("n"), _low("place").alias("pos"), F.col("head.cls").alias("head"), _high("head.place").alias("head_n"), _low("head.place").alias("head_pos"), "size")
    found = space.table("lists", found)

    own = space.table("classes", members.where("n > 0").groupBy("cls").agg(F.min(F.struct("id", "sign")).alias("m")).select("cls", F.col("m.id").alias("least"), "m.sign"))
    signs = own.select("cls", F.col("sign").alias("left"))
    others = own.select(F.col("cls").alias("other"), F.col("sign").alias("right"))

    def allowed(pairs: DataFrame) -> DataFrame:
        both = pairs.where(_may_link("", "other_", threshold)).select("cls", "other", "n", "other_n").distinct().join(signs, "cls").join(others, "other")
        return both.select("cls", "other", "n", "other_n", "left", "right").mapInArrow(_alike(threshold), "cls long, other long")

    links = labels = None
    for turn in range(_STAR_ROUNDS + 1):
        if turn == 0:
            member = found.select("token", F.col("cls").alias("other"), F.col("n").alias("other_n"), F.col("pos").alias("other_pos"), F.col("head").alias("cls"), F.col("head_n").alias("n"), F.col("head_pos").alias("pos"), "size")
            # a long list has a head for about every LIST_GROUP members, so that none is compared with all
            part = F.expr(f"pmod(xxhash64(other), shiftleft(1L, cast(ceil(log2(size / {LIST_GROUP})) AS int)))")
            long_ = member.where(f"size > {LIST_GROUP}").drop("cls", "n", "pos").withColumn("part", part)
            head = long_.groupBy("token", "part").agg(F.min(F.struct(F.col("other").alias("cls"), F.col("other_n").alias("n"), F.col("other_pos").alias("pos"))).alias("head")).select("token", "part", "head.*")
            pairs = member.where(f"size <= {LIST_GROUP}").drop("size").unionByName(long_.join(head, ["token", "part"]).drop("part", "size"))
            pairs = allowed(pairs.where("cls <> other"))
        else:
            # lists that still hold members of several components; the largest of these is the list's main one
            # (the only pair of a list of two was compared in the first round)
            known = found.where("size > 2").select("token", "cls", "n", "pos", "size").join(labels, F.col("cls") == F.col("node"), "left").select("token", "cls", "n", "pos", "size", F.coalesce("component", "cls").alias("comp"))
            # each list and round has a member of its own stand for a component, so that a stray meets many
            groups = known.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("size"), F.min_by(F.struct("cls", "n", "pos"), F.xxhash64(F.lit(turn), "token", "cls")).alias("m"))
            main = groups.groupBy("token").agg(F.max(F.struct("size", "comp", "m")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("token", F.col("main.comp").alias("main_comp"), "main.m.*")
            if turn < _STAR_ROUNDS:
                stray = groups.select("token", "comp", F.col("m.cls").alias("other"), F.col("m.n").alias("other_n"), F.col("m.pos").alias("other_pos"))
                pairs = allowed(stray.join(main, "token").where("comp <> main_comp"))
            else:
                # all members that are not of their list's main component, against all of other components
                still = space.table("still", known.join(main.select("token", "main_comp"), "token"))
                short = still.where(f"size <= {LIST_GROUP}")
                stray = short.where("comp <> main_comp").select("token", F.col("comp").alias("other_comp"), F.col("cls").alias("other"), F.col("n").alias("other_n"), F.col("pos").alias("other_pos"))
                met = short.join(stray, "token").where("comp <> other_comp").where("comp = main_comp OR cls < other")
                # pairs of a long list are not rows: a task compares a cell of its members in arrays
                long_ = _cells(still.where(f"size > {LIST_GROUP}").join(own.select("cls", "sign"), "cls"))
                pairs = allowed(met).unionByName(long_.groupBy("token", "i", "j").applyInArrow(_meet(threshold), "cls long, other long")).distinct()
        pairs = space.table(f"pairs{turn}", pairs)
        new = _verify(rows, own, pairs, width, threshold, space, f"links{turn}")
        space.drop(f"pairs{turn}")
        if turn and new.isEmpty():
            continue
        links = new if links is None else links.unionByName(new)
        labels = space.table(f"labels{turn}", connected_components(links, name="jaccard-cc"))
    space.drop("lists", "still")

    named = own.join(labels, F.col("cls") == F.col("node"), "left").select("cls", "least", F.coalesce("component", "cls").alias("comp"))
    named = space.table("named", named)
    first = named.groupBy("comp").agg(F.min("least").alias("component"))
    classes = named.join(first, "comp").select(F.col("cls").alias("of"), "component")
    return members.join(classes, (F.col("cls") == F.col("of")) & (F.col("n") > 0), "left").select(_given("id").alias("id"), F.col("n").cast("long").alias("n_shingles"), _given(F.coalesce("component", "id")).alias("component"))
