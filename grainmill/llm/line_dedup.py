"""Line deduplication by two Bloom filters: of a line's first and of its second sighting.

A line's key is the line without white space at both ends, A-Z lower-cased.
Keys of ``least_length`` code points are hashed; their hashes, four bytes each, travel to
the segment of the filters that their leading bits name, where one task streams
them through two bit tables: a key whose bits are all set in the first table
has been seen, and its bits go into the second. Only the second table is kept.
Lines whose key tests positive there are suspects; a digest of 128 bits of each
suspect is shuffled, counted exactly by document, and the lines of a repeated
key are cut from every document but the last one that holds it.

The second table is broadcast. Its size follows the number of keys, eight bits
for each, up to ``filter_bits`` bits, which is the proven bound of what is sent;
beyond it more lines are suspected, but none is lost, since every suspect is
confirmed. Texts are never shuffled by content.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.plans.workspace import Workspace

_SPACE = b" \t\n\x0b\x0c\r"
#: Leading bits of a hash that name its segment.
SEGMENT_BITS = 9
#: Hashes that a task gathers before it hands them on.
GATHERED = 1 << 20
#: Bits of the broadcast table, at most (64 MiB).
FILTER_BITS = 1 << 29
_LEAST_BITS = 1 << 13


def _digests(text: bytes, least: int) -> list[bytes | None]:
    """Of each line its key's digest, or None where the key is short."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(_SPACE)
        # a key of so many bytes has between a quarter as many code points and as many
        if len(key) < least or (len(key) < 4 * least and len(key.decode()) < least):
            out.append(None)
        else:
            out.append(blake2b(key.lower(), digest_size=16).digest())
    return out


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _leading(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2)[:, 0].astype(np.uint64)


def _places(rest: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a segment of ``bits`` bits, a power of two, from 32 bits of a hash."""
    wide = rest.astype(np.uint64)
    first = (wide * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    second = (wide * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)
    mask = np.uint64(bits - 1)
    return (first & mask).astype(np.int64), (second & mask).astype(np.int64)


def _split(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment and the 32 bits after it."""
    return (hashes >> np.uint64(64 - SEGMENT_BITS)).astype(np.int64), ((hashes >> np.uint64(32 - SEGMENT_BITS)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _gather(least: int):
    """Hashes by segment: those of the task's keys, each once, and those that more than one of its rows holds."""

    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        segment, rest = _split(values)
        edges = np.searchsorted(segment, np.arange((1 << SEGMENT_BITS) + 1))
        rows = [(s, a, b) for s, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if b > a]
        yield pa.RecordBatch.from_pydict({
            "segment": pa.array([s for s, _, _ in rows], pa.int32()),
            "n": pa.array([b - a for _, a, b in rows], pa.int64()),
            "seen": pa.array([rest[a:b].tobytes() for _, a, b in rows], pa.binary()),
            "again": pa.array([rest[a:b][counts[a:b] > 1].tobytes() for _, a, b in rows], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for text in _texts(batch.column(0)):
                found = {d for d in _digests(text, least) if d is not None}
                if found:
                    parts.append(_leading(list(found)))
                    held += len(found)
                if held >= GATHERED:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


def _fold(bits: int):
    """The second table of each segment from rows sorted by segment; segments in which nothing repeats give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, np.zeros(0, bool), np.zeros(0, bool)

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None and twice.any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([now], pa.int32()), "bits": pa.array([zlib.compress(np.packbits(twice, bitorder="little").tobytes(), 1)], pa.binary())})

        for batch in batches:
            for segment, seen, again in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if segment != now:
                    yield from done()
                    now, once, twice = segment, np.zeros(bits, bool), np.zeros(bits, bool)
                a, b = _places(np.frombuffer(seen, np.uint32), bits)
                known = once[a] & once[b]
                twice[a[known]] = twice[b[known]] = True
                once[a] = once[b] = True
                a, b = _places(np.frombuffer(again, np.uint32), bits)
                twice[a] = twice[b] = True
        yield from done()

    return run


def _repeat_filter(spark: SparkSession, space: Workspace, texts: DataFrame, least: int, filter_bits: int):
    """Broadcast of the second table by segment, and the bits of a segment."""
    gathered = space.table("hashes", texts.mapInArrow(_gather(least), "segment int, n long, seen binary, again binary"))
    total = gathered.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wanted = max(_LEAST_BITS, 1 << (8 * total >> SEGMENT_BITS).bit_length())
    bits = min(wanted, max(64, filter_bits >> SEGMENT_BITS))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folded = gathered.repartition(tasks, "segment").sortWithinPartitions("segment").mapInArrow(_fold(bits), "segment int, bits binary")
    segments = {r["segment"]: bytes(r["bits"]) for r in folded.collect()}  # filter_bits bits at most
    space.drop("hashes")
    return spark.sparkContext.broadcast(segments), bits


def _suspects(table, bits: int, least: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = bits >> 3
        flat = np.zeros(width << SEGMENT_BITS, np.uint8)
        for segment, packed in table.value.items():
            flat[segment * width : (segment + 1) * width] = np.frombuffer(zlib.decompress(packed), np.uint8)

        def hit(base: np.ndarray, place: np.ndarray) -> np.ndarray:
            return (flat[base + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 > 0

        for batch in batches:
            owners, digests = [], []
            for i, text in enumerate(_texts(batch.column(1))):
                found = {d for d in _digests(text, least) if d is not None}
                owners += [i] * len(found)
                digests += found
            if not digests:
                continue
            segment, rest = _split(_leading(digests))
            a, b = _places(rest, bits)
            base = segment * width
            kept = np.flatnonzero(hit(base, a) & hit(base, b))
            at = np.array(owners, np.int64)[kept]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)).cast(id_type), pa.array([digests[k] for k in kept.tolist()], pa.binary())], ["id", "digest"])

    return run


def _cut(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lines, dropped = [], [], []
            for text, gone in zip(_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                every = text.split(b"\n")
                lines.append(len(every))
                if gone:
                    gone = set(gone)
                    left = [line for line, digest in zip(every, _digests(text, least), strict=True) if digest not in gone]
                    dropped.append(len(every) - len(left))
                    text = b"\n".join(left)
                else:
                    dropped.append(0)
                kept.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["id", "text", "n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 40, least_documents: int = 5, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Drop lines that many documents share, except from the document with the largest id that holds them.

    A line is what stands between ``\\n``; its key has white space (``[\\x20\\x09-\\x0D]``)
    stripped at both ends and A-Z lower-cased. Keys of at least ``least_length`` code
    points that at least ``least_documents`` documents hold lose all their lines
    but those of the last document. Keys compare by a digest of 128 bits.

    Returns one row per input row: ``id`` (of its own type), ``text`` (the other
    lines, joined by ``\\n``; null becomes empty), ``n_lines`` (before dropping; a null
    or empty text is one empty line) and ``n_dropped``. Rows that repeat an id are
    one document in the counts and each keeps its own row. Rows without an id
    are one document together, before all others. A text whose lines all go is
    empty. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "lines")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type, id_sql = rows.schema["id"].dataType, rows.schema["id"].dataType.simpleString()
    table, bits = _repeat_filter(spark, space, rows.select("text"), least_length, filter_bits)
    suspects = rows.mapInArrow(_suspects(table, bits, least_length, _arrow(id_type)), f"id {id_sql}, digest binary")
    # rows that repeat an id hold a key once; all counts are summed before each shuffle
    suspects = space.table("suspects", suspects.distinct())
    repeats = space.table("repeats", suspects.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).where(F.col("n") >= least_documents).select("digest", "last"))
    # both sides are tables, so that Spark splits a key that very many documents share
    drops = suspects.join(repeats, "digest").where(~F.col("id").eqNullSafe(F.col("last")))
    drops = space.table("drops", drops.groupBy(F.col("id").alias("of")).agg(F.collect_list("digest").alias("gone")))
    space.drop("suspects", "repeats")
    table.unpersist()
    # removals grow with the documents: texts meet them by id at every size
    joined = rows.join(drops.hint("merge"), rows["id"].eqNullSafe(drops["of"]), "left").select("id", "text", "gone")
    return joined.mapInArrow(_cut(least_length), f"id {id_sql}, text string, n_lines long, n_dropped long")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
