"""Token ids in fixed-width bit packing, with block offsets.

The file format is a Parquet folder of blocks. A block holds the ids of
consecutive whole documents, each id in the least number of bits that the
vocabulary needs, least significant bit first, in one binary column. Beside it
stand the ids' count and width, the documents and where each begins. A document
or a range of ids is found from the block offsets alone, and a block unpacks in
a few numpy operations. Files are Spark's own: they are committed whole, retried
after a lost executor, and live in any store that Spark writes.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids after which a block ends, at the next document's end.
BLOCK_IDS = 1 << 16
#: Entries of a worker's memory of words already encoded, and of their pieces.
_MEMORY = 600_000

_BLOCKS = "part int, block int, first_doc long, n_docs int, start long, n_ids long, bits int, doc_ids binary, doc_starts binary, payload binary"


def width_of(vocabulary: int) -> int:
    """Bits for ids below ``vocabulary``, 1 at least."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive ``bits``-bit little-endian fields."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes | memoryview, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from the ``start``-th on; only their bytes are read."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    low, high = start * bits, (start + count) * bits
    raw = np.unpackbits(np.frombuffer(payload, np.uint8)[low >> 3 : (high + 7) >> 3], bitorder="little")[low & 7 :][: count * bits]
    return raw.reshape(count, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of pieces without capitals, as little-endian 32-bit integers; remembers the first ones."""

    #: Lower-case letters that the normalizer leaves alone: such a run is one pre-token.
    letters = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")

    def __init__(self, library) -> None:
        super().__init__()
        self.library, self.model = library, library.model
        self.alphabet = {chr(c): "".join(map(_byte_letters().get, chr(c).encode())) for c in range(0x80, 0x100)}
        self.table = str.maketrans(self.alphabet)

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            ids = [t.id for t in self.model.tokenize(piece)]
        elif self.letters.fullmatch(piece):
            ids = [t.id for t in self.model.tokenize(piece.translate(self.table))]
        else:
            ids = self.library.encode(piece, add_special_tokens=False).ids
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < _MEMORY:
            self[piece] = out
        return out


class _Words(dict):
    """Ids of words between white space, from their pieces."""

    _cut = re.compile(r"(?<=[a-z])(?=[!-&(-/:-@\[-`{-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[a-z])")
    #: What is cut from letters before it; a run of it is one piece.
    _marks = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
    _capitals = str.maketrans({c: c.lower() for c in map(chr, [*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)])})

    def __init__(self, pieces: _Pieces) -> None:
        super().__init__()
        self.pieces = pieces

    def __missing__(self, word: str) -> bytes:
        plain = word.isascii()
        low = word.lower() if plain else word.translate(self._capitals)
        if low.isalpha():
            out = self.pieces[low]
        elif plain and (stem := low.rstrip(self._marks)).isalpha():
            # by far the most of them: letters, then marks
            out = self.pieces[stem] + self.pieces[low[len(stem) :]]
        else:
            out = b"".join([self.pieces[p] for p in self._cut.split(low)])
        if len(self) < _MEMORY:
            self[word] = out
        return out


class Encoder:
    """Encodes with the tokenizers library, each distinct word once.

    The vocabulary's pre-tokenizer never joins characters across white space, nor
    an ASCII letter with ASCII punctuation other than an apostrophe, and its
    normalizer works on characters and their combining marks. So texts are cut at
    these places, pieces that are one run of lower-case Latin letters go to the
    library's model, and all others, and texts with special tokens or separator
    controls, to its whole pipeline.
    """

    def __init__(self, vocabulary: bytes) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary.decode())
        self.library.no_padding()
        self.library.no_truncation()
        self.whole = [*(t.content for t in self.library.get_added_tokens_decoder().values()), *"\x1c\x1d\x1e\x1f"]
        self.words = _Words(_Pieces(self.library))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if any(map(text.__contains__, self.whole)):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.words.__getitem__, text.split()))


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary: bytes) -> Encoder:
    """This worker's encoder for a vocabulary; what it remembers serves later tasks too."""
    name = hash(vocabulary)
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(vocabulary)
    return _encoders[name]


def _write(vocabulary, end_id: int, bits: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, start = TaskContext.get().partitionId(), 0, 0
        docs: list[int] = []
        runs: list[np.ndarray] = []
        filled = 0
        last = struct.pack("<I", end_id)

        def flush() -> pa.RecordBatch:
            nonlocal docs, runs, filled, block, start
            ids = np.concatenate(runs)
            begins = np.r_[0, np.cumsum([len(r) for r in runs])].astype("<i8")
            row = [part, block, docs[0], len(docs), start, len(ids), bits, np.array(docs, "<i8").tobytes(), begins.tobytes(), pack(ids, bits)]
            block, start, docs, runs, filled = block + 1, start + len(ids), [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], _NAMES)

        encoder = _encoder(vocabulary.value)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(NULL_ID if doc is None else doc)
                runs.append(np.frombuffer(encoder.encode(text.as_py() or "") + last, "<u4"))
                filled += len(runs[-1])
                if filled >= block_ids:
                    yield flush()
        if docs:
            yield flush()

    return run


#: Stands for a null id in the files, which come first.
NULL_ID = -(1 << 63)
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
_NAMES = ["part", "block", "first_doc", "n_docs", "start", "n_ids", "bits", "doc_ids", "doc_starts", "payload"]


def write_packed(docs: DataFrame, path: str, vocabulary_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, block_ids: int = BLOCK_IDS) -> None:
    """Encode whole texts and write their ids under ``path``, documents in ascending id order.

    Null and empty texts give the end id alone. Rows that repeat an id are kept,
    next to each other. Rows without an id come first and are read back without
    one. An empty table writes no block. Other columns are ignored.
    ``part`` and ``block`` order the blocks; ``start`` counts ids within a part.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(vocabulary_file, "rb") as f:
        vocabulary = f.read()
    bits = width_of(Tokenizer.from_str(vocabulary.decode()).get_vocab_size())
    shared = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = rows.repartitionByRange(parts, "id").sortWithinPartitions("id")
    ordered.mapInArrow(_write(shared, end_id, bits, block_ids), _BLOCKS).write.mode("overwrite").parquet(path)


def _read_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, start, size, crc = [], [], [], []
        for base, n_ids, bits, docs, begins, payload in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            every = unpack(payload, bits, 0, n_ids).astype("<u4").tobytes()
            at = np.frombuffer(begins, "<i8").tolist()
            view = memoryview(every)
            ids += [None if d == NULL_ID else d for d in np.frombuffer(docs, "<i8").tolist()]
            start += [base + a for a in at[:-1]]
            size += [b - a for a, b in zip(at[:-1], at[1:], strict=True)]
            crc += [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, start, size, crc)], ["id", "start", "n_tokens", "ids_crc32"])


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """The blocks under ``path``, with ``start`` counted from the first id of the first part.

    The parts' sizes are summed from the block offsets, one row for each part.
    """
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    bases = list(zip([r.part for r in sizes], np.cumsum([0] + [r.n for r in sizes])[:-1].tolist(), strict=True))
    table = spark.createDataFrame(bases, "of int, base long")
    return blocks.join(F.broadcast(table), blocks.part == table.of).withColumn("start", F.expr("base + start")).drop("of", "base")


def packed_documents(blocks: DataFrame) -> DataFrame:
    """Per document of packed blocks: ``id``, ``start``, ``n_tokens`` and the CRC-32 of its ids as 32-bit integers."""
    return blocks.select("start", "n_ids", "bits", "doc_ids", "doc_starts", "payload").mapInArrow(_read_docs, "id long, start long, n_tokens long, ids_crc32 long")
