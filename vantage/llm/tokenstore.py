"""Token-id files: ids in ascending document order, coded in independent, checksummed blocks.

The format: a Parquet table with a row per chunk of whole documents: ``part`` and ``chunk`` (their
order is that of the ids), ``doc_ids``, ``doc_tokens``, ``tokens``, ``head`` and ``blocks``, the
chunk's ids in blocks as ``rangecoder`` makes them. Head and blocks begin with four bytes of CRC-32
of the rest; blocks go on with 16-bit words of the range coder, all in little-endian order. Parquet
gives atomic commits and reads on any file system.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantage.llm.rangecoder import decode_blocks, encode_blocks
from vantage.llm.tokens import END, encode, tokenizer_path

#: Ids of a chunk, about; a longer document has one of its own.
CHUNK = 4 << 20
SCHEMA = "part int, chunk int, doc_ids array<long>, doc_tokens array<long>, tokens long, head binary, blocks array<binary>"
_ARROW = pa.schema(
    [("part", pa.int32()), ("chunk", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("tokens", pa.int64()), ("head", pa.binary()), ("blocks", pa.list_(pa.binary()))]
)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> None:
    """Encodes every text (null: empty) and the end id after it, and writes them by ascending key (nulls first).

    Rows with one key go by their texts (null first), so that each attempt writes the same; rows
    that are equal in both can't be told apart. No other column is read. A table without rows
    gives files without rows. A text is never cut: a longer one than ``CHUNK`` has a chunk of its own.
    """
    tokenizer = tokenizer or tokenizer_path()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, waiting, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def coded() -> pa.RecordBatch:
            line = np.frombuffer(b"".join(waiting), "<u4")
            head, blocks = encode_blocks(line)
            return pa.RecordBatch.from_pylist(
                [{"part": part, "chunk": number, "doc_ids": ids, "doc_tokens": [len(x) // 4 for x in waiting], "tokens": len(line), "head": head, "blocks": blocks}], schema=_ARROW
            )

        end = END.to_bytes(4, "little")
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = encode(value, tokenizer) + end
                if waiting and size + len(data) > 4 * CHUNK:
                    yield coded()
                    number, waiting, ids, size = number + 1, [], [], 0
                waiting.append(data)
                ids.append(doc_id)
                size += len(data)
        if waiting:
            yield coded()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(chunks, SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, ids; checks every block."""
    stored = spark.read.parquet(path)
    out = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, chunk, doc_ids, sizes, tokens, head, blocks = (batch.column(i)[row].as_py() for i in range(7))
                line = decode_blocks(head, blocks, tokens)
                ends = np.cumsum(sizes)
                docs = [line[e - n : e] for e, n in zip(ends, sizes)]
                columns = [np.full(len(docs), part, np.int32), np.full(len(docs), chunk, np.int32), doc_ids, ends - np.array(sizes), sizes, [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]]
                if with_ids:
                    columns.append([d.astype(np.int64) for d in docs])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    docs = stored.select("part", "chunk", "doc_ids", "doc_tokens", "tokens", "head", "blocks").mapInArrow(
        decode, "part int, chunk int, doc_id long, inside long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    )
    sizes = stored.select("part", "chunk", "tokens")
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("all"))  # few rows: one for each written partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "chunk", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("ahead")).join(parts, "part")
    columns = ["doc_id", (F.col("first") + F.col("ahead") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return docs.join(starts, ["part", "chunk"]).select(*columns)
