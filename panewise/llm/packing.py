"""Bounded-space online best-fit packing of token sequences.

Each packer holds a fixed number of open bins in a bitset keyed by free space: a piece goes to the open
bin with the least free space that takes it; if none does, a bin is opened, and if too many are open then
the fullest is closed. Pieces come in the order of a hash, which mixes sizes and is the same in every
attempt of a task, so a lost executor's work is done again with the same result.

A null text is an empty one: its document is the end mark alone. Documents longer than a sequence are cut
into whole sequences, the first piece taking what is left over. Rows with the same id are packed each.
An empty table gives no rows. Other columns of the documents are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from panewise.llm.common import by_size, in_batches, partitions_for, written
from panewise.llm.segments import Encoder, Vocabulary

OPEN_BINS = 512
PIECES_PER_PACKER = 100_000

_PIECES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def cuts(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % most or min(n, most)
    return [(0, first)] + [(start, most) for start in range(first, n, most)]


class Bins:
    """Open bins by free space. `place` gives the bin's number and the offset there."""

    def __init__(self, size: int, most_open: int):
        self._size, self._most = size, most_open
        self._by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self._bits = self._open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        fits = self._bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self._open == self._most:
                self._take((self._bits & -self._bits).bit_length() - 1)
            free, number = self._size, self.made
            self.made += 1
        if left := free - length:
            self._by_free[left].append(number)
            self._bits |= 1 << left
            self._open += 1
        return number, self._size - free

    def _take(self, free: int) -> int:
        bins = self._by_free[free]
        number = bins.pop()
        if not bins:
            self._bits ^= 1 << free
        self._open -= 1
        return number


def _tokenise(vocabulary: Vocabulary, most: int, end: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, mark = Encoder(vocabulary), end.to_bytes(4, "little")
        for batch in by_size(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.ids(texts)):
                ids += mark
                for k, (start, length) in enumerate(cuts(len(ids) // 4, most)):
                    rows.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            columns = list(zip(*rows))
            types = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_PIECES)

    return pieces


def _pack(most: int, open_bins: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, task = Bins(most, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            numbers = pa.array([task | number for number, _ in placed], pa.int64())
            offsets = pa.array([offset for _, offset in placed], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in _PIECES] + [numbers, offsets], names=[*_PIECES, "sequence_id", "offset"]
            )

    return pack


def pack(
    docs: DataFrame,
    tokenizer: str,
    most: int = 2048,
    end: int = 0,
    open_bins: int = OPEN_BINS,
    pieces_per_packer: int = PIECES_PER_PACKER,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """`doc_id, piece, start, length, ids_crc32, sequence_id, offset` per piece.

    Texts are tokenised where they are read; only the pieces' numbers are shuffled. At the end of a packer
    up to `open_bins` sequences are part empty, so packers get many pieces each: the number of packers
    follows the number of pieces.
    """
    vocabulary = Vocabulary.read(tokenizer)
    texts = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    doc = texts.schema["doc_id"]
    cut = StructType(
        [doc, StructField("piece", IntegerType())] + [StructField(c, LongType()) for c in _PIECES[2:]]
    )
    pieces = written(in_batches(texts, _tokenise(vocabulary, most, end), cut), "pieces")
    order = F.xxhash64(*_PIECES)
    packers = partitions_for(pieces.count(), pieces_per_packer)
    placed = StructType(cut.fields + [StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return (
        pieces.repartition(packers, order)
        .sortWithinPartitions(order, *_PIECES)
        .mapInArrow(_pack(most, open_bins), placed)
    )
