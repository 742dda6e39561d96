"""Removal of repeated passages, to the word; passages are compared by 64-bit hashes of their 13-word windows.

Each document is cut into non-overlapping reference blocks of 7 words, the anchors; every window of
7 words, at any place of any document, probes them. Any 13 consecutive words hold one whole block,
so two documents that share 13 words meet at an anchor, whatever their alignment. Places around an
anchor that other documents have too are extended: the 13-word windows over them are compared, and
windows that a smaller doc_id has as well merge to maximal repeats.

Documents stay in groups (of neighbouring rows of the input, bounded in rows and in bytes); a group sends the hashes of its
windows once each, sorted and as differences, so that common passages arrive once from a group
however many of its documents have them. Answers are one bit for each hash sent. No pair of
documents is ever listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import U64, string_size, text_bytes, window_hashes, word_hashes

#: 2 * BLOCK - 1 words hold a whole block.
WINDOW, BLOCK = 13, 7
#: Rows of a group are 2 ** GROUP_BITS at most; their numbers are packed beside the hashes.
GROUP_BITS = 11
#: Bytes of a group's rows, unless a single row has more.
GROUP_BYTES = 16 << 20
#: Hashes that one task compares, about.
BUCKET_HASHES = 2_000_000
LAST = np.iinfo(np.int64).max


def pack_sorted(values: np.ndarray) -> bytes:
    """Increasing numbers as differences, in as many bytes as the largest needs."""
    gaps = np.diff(values, prepend=values[:1])
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return np.array([len(values), values[0], width], U64).tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack_sorted(data: bytes) -> tuple[np.ndarray, int]:
    """The numbers, and where they end in ``data``."""
    n, first, width = (int(x) for x in np.frombuffer(data, U64, 3))
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(data, np.uint8, n * width, 24).reshape(width, n).T
    return np.cumsum(gaps.view(U64)[:, 0]) + U64(first), 24 + n * width


def bits_of(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags_of(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


class Group:
    """Windows of a group of documents, the same for each reading of the group."""

    def __init__(self, texts: pa.Array, ids: np.ndarray, hash_bits: int, bucket_bits: int):
        self.ids, self.bits, self.bucket_bits = ids, hash_bits, bucket_bits
        self.words, self.bounds = word_hashes(*text_bytes(texts))
        self.row = np.repeat(np.arange(len(ids)), np.diff(self.bounds))

    def _starts(self, size: int) -> np.ndarray:
        """Where a window of ``size`` words lies within one document."""
        n = len(self.words) - size + 1
        return np.flatnonzero(self.row[:n] == self.row[size - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different window hashes; whether one is a block; whether more documents here have it."""
        self.starts = self._starts(BLOCK)
        self.hashes = window_hashes(self.words, BLOCK)[self.starts] >> U64(64 - self.bits) if len(self.starts) else np.zeros(0, U64)
        rows = self.row[self.starts]
        block = (self.starts - self.bounds[rows]) % BLOCK == 0
        keys = np.sort(self.hashes << U64(GROUP_BITS + 1) | rows.astype(U64) << U64(1) | block.astype(U64))
        hashes = keys >> U64(GROUP_BITS + 1)
        if not len(keys):
            return hashes, np.zeros(0, bool), np.zeros(0, bool)
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        last = np.r_[first[1:], len(keys)] - 1
        several = (keys[first] ^ keys[last]) >> U64(1) != 0
        return hashes[first], np.bitwise_or.reduceat(keys & U64(1), first) == 1, several

    def cuts(self, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of sorted hashes and their bounds."""
        bucket = (hashes >> U64(bits - self.bucket_bits)).astype(np.int64)
        at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        return bucket[at], np.r_[at, len(bucket)]

    def answered(self, hashes: np.ndarray, bits: int, replies: dict[int, bytes]) -> np.ndarray:
        """The answers' bits, in the order of ``hashes``."""
        out = np.zeros(len(hashes), bool)
        buckets, at = self.cuts(hashes, bits)
        for bucket, a, b in zip(buckets.tolist(), at, at[1:]):
            if bucket in replies:
                out[a:b] = flags_of(replies[bucket], b - a)
        return out

    def candidates(self, replies: dict[int, bytes]) -> None:
        """13-word windows over anchors that several documents have: starts, hashes, smallest ids here."""
        hashes, _, _ = self.probes()
        hits = hashes[self.answered(hashes, self.bits, replies)]
        near = np.zeros(len(self.words) + 1, np.int64)
        if len(hits):
            at = np.minimum(np.searchsorted(hits, self.hashes), len(hits) - 1)
            near[self.starts[hits[at] == self.hashes] + 1] = 1
        near = np.cumsum(near)
        starts = self._starts(WINDOW)
        self.wide = starts[near[starts + WINDOW - BLOCK + 1] > near[starts]]
        full = window_hashes(self.words, WINDOW)[self.wide] if len(self.wide) else np.zeros(0, U64)
        self.unique, self.which = np.unique(full, return_inverse=True)
        self.least = np.full(len(self.unique), LAST, np.int64)
        np.minimum.at(self.least, self.which, self.ids[self.row[self.wide]])

    def removed(self, replies: dict[int, bytes]) -> np.ndarray:
        """Whether each word is covered by a window that a smaller id has as well."""
        elsewhere = self.answered(self.unique, 64, replies)
        gone = self.wide[elsewhere[self.which] | (self.ids[self.row[self.wide]] > self.least[self.which])]
        change = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(change, gone, 1)
        np.add.at(change, gone + WINDOW, -1)
        return np.cumsum(change)[:-1] > 0


def _sorted_ids(table: pa.Table) -> tuple[pa.Table, pa.Array, np.ndarray]:
    table = table.sort_by("_row")
    texts = pa.chunked_array(table.column("_text")).combine_chunks() if table.num_rows else pa.array([], pa.string())
    ids = table.column("_id").to_numpy() if table.num_rows else np.zeros(0, np.int64)
    return table, texts, ids


def with_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches with _group instead of _bytes: the _row that begins a run of at most 2 ** GROUP_BITS rows and, if it has two or more, ``most`` bytes."""
    first, count, held = 0, 0, 0
    for batch in batches:
        groups = np.empty(batch.num_rows, np.int64)
        for i, (row, size) in enumerate(zip(batch.column("_row").to_pylist(), batch.column("_bytes").to_pylist())):
            if not count or count >= 1 << GROUP_BITS or held + size > most:
                first, count, held = row, 0, 0
            count, held = count + 1, held + size
            groups[i] = first
        left = batch.drop_columns(["_bytes"])
        yield pa.RecordBatch.from_arrays([*left.columns, pa.array(groups)], names=[*left.schema.names, "_group"])


def grouped(rows: DataFrame) -> DataFrame:
    """``rows``, which has _row and _bytes, by ``with_groups``; groups end with the input's partitions."""
    most = GROUP_BYTES
    return rows.mapInArrow(lambda batches: with_groups(batches, most), rows.drop("_bytes").schema.add("_group", "long"))


ADDED = ("n_words", "n_removed", "kept_text")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with n_words, n_removed and kept_text (kept words, one space between).

    A word goes if one of the 13-word windows over it also starts in a document of a smaller id.
    Null texts have no words; a null id is larger than any other; rows with one id don't repeat
    each other. The input has to be a table that is read, whose partitions are the same in each
    attempt. Columns of ``docs`` with the result's names are replaced, all others stay as they are.
    """
    own = [F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ADDED or c in (key, text)]
    return _cut(docs, key, text).select(*own, *ADDED)


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", sized: str | None = None) -> DataFrame:
    """The rows of ``docs`` with what ``remove_repeats`` keeps of each text; rows of which nothing is left go.

    A text without repeats stays as it is, its blanks too; so do null and empty texts. ``sized``
    names a column that gets the number of characters where a text was cut. All other columns stay.
    """
    cut = _cut(docs, key, text).where("n_removed = 0 or n_removed < n_words")
    shorter = F.col("n_removed") > 0

    def column(c: str) -> Column:
        if c == text:
            return F.when(shorter, F.col("kept_text")).otherwise(F.col("text")).alias(c)
        own = F.col("row").getField(c)
        return (F.when(shorter, F.length("kept_text").cast(docs.schema[c].dataType)).otherwise(own) if c == sized else own).alias(c)

    return cut.select(*map(column, docs.columns))


def _cut(docs: DataFrame, key: str, text: str) -> DataFrame:
    """row (a struct of all columns but the text, so that no name can clash), text, n_words, n_removed and kept_text."""
    words = max(1000, string_size(docs, text) // 5)
    hash_bits = min(63 - GROUP_BITS, words.bit_length() + 12)
    bucket_bits = max(4, (words // BUCKET_HASHES).bit_length())
    size = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) for f in docs.schema if f.dataType.simpleString() in ("string", "binary")), F.lit(0)).cast("long")
    kept = [c for c in docs.columns if c != text or text == key]
    rows = docs.select(
        F.struct(*kept).alias("row"), F.monotonically_increasing_id().alias("_row"), F.coalesce(F.col(key).cast("long"), F.lit(int(LAST))).alias("_id"), F.col(text).alias("_text"), size.alias("_bytes")
    )

    most = GROUP_BYTES

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def sent() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(waiting)
            group = Group(whole.column("_text").combine_chunks(), whole.column("_id").to_numpy(), hash_bits, bucket_bits)
            hashes, block, several = group.probes()
            buckets, at = group.cuts(hashes, hash_bits)
            packed = [pack_sorted(hashes[a:b]) + bits_of(np.r_[block[a:b], several[a:b]]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(np.full(len(buckets), whole.column("_group")[0].as_py())), pa.array(packed, pa.binary())], names=["bucket", "_group", "packed"])

        for batch in with_groups(batches, most):  # here, as a step of its own is one more worker for each task
            groups = batch.column("_group").to_numpy()
            cut = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else []
            for a, b in zip(cut, [*cut[1:], len(groups)]):
                if waiting and waiting[0].column("_group")[0].as_py() != groups[a]:
                    yield from sent()
                    waiting = []
                waiting.append(batch.slice(a, b - a))
        if waiting:
            yield from sent()

    def anchors(table: pa.Table) -> pa.Table:
        """Which hashes several documents have, one of them as a block."""
        sources = []
        for data in table.column("packed").to_pylist():
            values, end = unpack_sorted(data)
            both = flags_of(data[end:], 2 * len(values))
            sources.append((values, both[: len(values)], both[len(values) :]))
        values = np.concatenate([x for x, _, _ in sources])
        order = np.argsort(values, kind="stable")
        first = np.flatnonzero(np.r_[True, values[order][1:] != values[order][:-1]])
        block = np.bitwise_or.reduceat(np.concatenate([x for _, x, _ in sources])[order], first)
        several = np.bitwise_or.reduceat(np.concatenate([x for _, _, x in sources])[order], first)
        sizes = np.diff(np.r_[first, len(values)])
        hit = np.empty(len(values), bool)
        hit[order] = np.repeat(block & (several | (sizes > 1)), sizes)
        return answers(table, hit, [len(x) for x, _, _ in sources], 0)

    def answers(table: pa.Table, hit: np.ndarray, sizes: list[int], step: int) -> pa.Table:
        at = np.cumsum([0, *sizes])
        chosen = [i for i, (a, b) in enumerate(zip(at, at[1:])) if hit[a:b].any()]
        return pa.table(
            {
                "_group": pa.array([table.column("_group")[i].as_py() for i in chosen], pa.int64()),
                "bucket": pa.array([table.column("bucket")[i].as_py() for i in chosen], pa.int64()),
                "step": pa.array([step] * len(chosen), pa.int32()),
                "bits": pa.array([bits_of(hit[at[i] : at[i + 1]]) for i in chosen], pa.binary()),
            }
        )

    def replies(table: pa.Table, step: int) -> dict[int, bytes]:
        return {r["bucket"]: r["bits"] for r in table.to_pylist() if r["step"] == step}

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        _, texts, ids = _sorted_ids(left)
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            group = Group(texts, ids, hash_bits, bucket_bits)
            group.candidates(replies(right, 0))
            buckets, at = group.cuts(group.unique, 64)
            out = [(n, pack_sorted(group.unique[a:b]) + group.least[a:b].tobytes()) for n, a, b in zip(buckets.tolist(), at, at[1:])]
        number = left.column("_group")[0].as_py() if left.num_rows else 0
        return pa.table({"bucket": pa.array([n for n, _ in out], pa.int64()), "_group": pa.array([number] * len(out), pa.int64()), "packed": pa.array([x for _, x in out], pa.binary())})

    def earlier(table: pa.Table) -> pa.Table:
        """Which windows a smaller id than the group's smallest has."""
        sources = []
        for data in table.column("packed").to_pylist():
            values, end = unpack_sorted(data)
            sources.append((values, np.frombuffer(data, np.int64, len(values), end) if end % 8 == 0 else np.frombuffer(data[end:], np.int64)))
        values, least = np.concatenate([x for x, _ in sources]), np.concatenate([x for _, x in sources])
        order = np.argsort(values, kind="stable")
        first = np.flatnonzero(np.r_[True, values[order][1:] != values[order][:-1]])
        smallest = np.minimum.reduceat(least[order], first)
        hit = np.empty(len(values), bool)
        hit[order] = least[order] > np.repeat(smallest, np.diff(np.r_[first, len(values)]))
        return answers(table, hit, [len(x) for x, _ in sources], 1)

    shape = rows.select("row", F.col("_text").cast("string").alias("text")).schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")

    def cut_out(left: pa.Table, right: pa.Table) -> pa.Table:
        left, texts, ids = _sorted_ids(left)
        kept, total, removed = [], np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        if left.num_rows:
            group = Group(texts, ids, hash_bits, bucket_bits)
            total = np.diff(group.bounds)
            gone = np.zeros(len(group.words), bool)
            if right.num_rows:
                group.candidates(replies(right, 0))
                gone = group.removed(replies(right, 1))
            removed = np.diff(np.r_[0, np.cumsum(gone)][group.bounds])
            for i, value in enumerate(texts.to_pylist()):
                own = (value or "").encode().split()
                if removed[i]:
                    own = compress(own, ~gone[group.bounds[i] : group.bounds[i + 1]])
                kept.append(b" ".join(own).decode())
        columns = [left.column("row"), texts, pa.array(total), pa.array(removed), pa.array(kept, pa.string())]
        return pa.table(dict(zip(shape.names, columns)))

    own = grouped(rows).groupBy("_group")
    hits = rows.select("_row", "_bytes", "_id", "_text").mapInArrow(probe, "bucket long, _group long, packed binary").groupBy("bucket").applyInArrow(anchors, "_group long, bucket long, step int, bits binary")
    wide = own.cogroup(hits.groupBy("_group")).applyInArrow(extend, "bucket long, _group long, packed binary")
    gone = wide.groupBy("bucket").applyInArrow(earlier, "_group long, bucket long, step int, bits binary")
    return own.cogroup(hits.unionByName(gone).groupBy("_group")).applyInArrow(cut_out, shape)
