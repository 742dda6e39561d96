"""Harmonic packing of token sequences.

Classes are the reciprocals of the capacity: a piece of class k has at most C/k tokens, and a
class's sequence takes a fixed count of pieces, k. A document, or what is left of it, stays whole in
the class of its length if k such pieces leave at most a small share of a sequence empty; all pieces
of up to C/16 tokens do. Otherwise a piece of exactly C/k tokens is cut off its front, for the
smallest k that leaves no scrap, and so on with the rest. The last class takes all short pieces, as
many as fit. Every worker fills the classes of its own documents; what is left in them at its end
shares sequences, the longest pieces first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.tokens import END, encode, forget, tokenizer_path


#: Share of a sequence that whole pieces of a class may leave empty.
SLACK = 1 / 32
#: Pieces of up to C/WHOLE tokens are never cut; those of up to C/CLASSES are the last class.
WHOLE, CLASSES = 16, 64
#: No cut leaves fewer tokens than this, or than C/64.
SCRAP = 16


class HarmonicBins:
    """Places pieces of one worker; each sequence number has the worker's number above bit 40."""

    def __init__(self, capacity: int, worker: int):
        self.capacity, self.next = capacity, worker << 40
        self.open: dict[int, list[tuple[object, int]]] = {}
        self.filled = 0  # tokens waiting in the last class

    def _place(self, pieces: list[tuple[object, int]]) -> Iterator[tuple]:
        offset = 0
        for piece, length in pieces:
            yield piece, self.next, offset
            offset += length
        self.next += 1

    def add(self, piece: object, length: int) -> Iterator[tuple]:
        """Pieces (piece, sequence, offset) of the class's sequence once it has all it takes."""
        kind = min(self.capacity // length, CLASSES)
        waiting = self.open.setdefault(kind, [])
        if kind == CLASSES:
            if self.filled + length > self.capacity:
                yield from self._place(self.open.pop(kind))
                waiting, self.filled = self.open.setdefault(kind, []), 0
            self.filled += length
        waiting.append((piece, length))
        if kind < CLASSES and len(waiting) == kind:
            yield from self._place(self.open.pop(kind))

    def rest(self) -> Iterator[tuple]:
        """What waits, fewer than CLASSES ** 2 pieces and a sequence of short ones: each in the first sequence with room."""
        shared: list[tuple[list, int]] = []
        for piece, length in sorted((x for kind in sorted(self.open) for x in self.open[kind]), key=lambda x: -x[1]):
            at = next((n for n, (_, room) in enumerate(shared) if room >= length), len(shared))
            if at == len(shared):
                shared.append(([], self.capacity))
            held, room = shared[at]
            held.append((piece, length))
            shared[at] = held, room - length
        for held, _ in shared:
            yield from self._place(held)
        self.open, self.filled = {}, 0


def pieces(tokens: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Starts and lengths of the pieces that a document of so many tokens is cut into."""
    start, scrap = 0, min(SCRAP, capacity // 64)
    while start < tokens:
        left = tokens - start
        kind = max(1, -(-capacity // left))
        fits = capacity // left
        if left * WHOLE <= capacity or (fits and capacity - fits * left <= SLACK * capacity):
            length = left
        else:
            while 0 < left - capacity // kind < scrap:
                kind += 1
            length = capacity // kind
        yield start, length
        start += length


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, capacity: int = 4096, with_ids: bool = True, path: str | None = None, key: str = "doc_id", text: str = "text", keep_words: bool = True) -> DataFrame:
    """One row per piece: where it is in its document, its checksum, and its place in a sequence.

    A document is its ids and the end id, so a null or empty text is one token. ``with_ids`` adds
    the piece's ids. Sequences have up to ``capacity`` tokens, and are to be padded to that. Rows
    with one key, or with none, are packed each for itself; other columns are not read, and a table
    without rows gives none. Nothing is shuffled: sequences hold pieces of one input partition, so the
    input has to be a table that is read, whose partitions are the same in each attempt. Unless
    ``keep_words``, a task frees the words that its worker remembers, which costs the next one their merging.
    """
    path = path or tokenizer_path()
    schema = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")] + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = HarmonicBins(capacity, TaskContext.get().partitionId())

        def batch_of(placed: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([p[0][i] for p in placed], pa.int64()) for i in range(5)]
            columns += [pa.array([p[i] for p in placed], pa.int64()) for i in (1, 2)]
            if with_ids:
                columns.append(pa.array([np.frombuffer(p[0][5], "<u4").astype(np.int32) for p in placed], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        end, placed = END.to_bytes(4, "little"), []
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(value, path) + end
                tokens = len(ids) // 4
                for start, length in pieces(tokens, capacity):
                    own = ids[4 * start : 4 * (start + length)]
                    placed.extend(bins.add((doc_id, start, length, zlib.crc32(own), tokens, own if with_ids else None), length))
                if len(placed) >= 4096:
                    yield batch_of(placed)
                    placed = []
        if not keep_words:
            forget(path)
        placed.extend(bins.rest())
        yield batch_of(placed)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pack, SCHEMA + (", ids array<int>" if with_ids else ""))
