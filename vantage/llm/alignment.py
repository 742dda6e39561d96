"""Alignment of two tokenizers: which tokens of one overlap which of the other, by byte offsets.

Tokenizer A reads a space and the text, tokenizer B the text, before which it sets a space itself.
Documents of an Arrow batch are laid end to end as bytes; the ends of A's and of B's tokens are
counted over all bytes once. Bytes where both end cut groups; bytes where either ends carry one
link each, of the A and the B token that hold the byte, whose places are prefix sums of the counts.
Differences of prefix sums at the documents' bounds are the documents' results.

A pair of ids is counted by the documents that hold it linked. Links stay in blocks as numbers of
the block's different pairs. Only different pairs of blocks are shuffled and counted, the counts go
back to the blocks as one list each, and prefix sums over a block's links give its documents' sums.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from vantage.llm.common import shared_dir, slices, text_bytes

#: Bytes of text laid end to end, about; a longer document stands alone.
BLOCK_BYTES = 1 << 20
#: Texts given to a tokenizer at once, in bytes, because its answers are large.
CALL_BYTES = 1 << 18
#: Texts of these characters are cut into A's words alike by any version of Unicode.
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")
#: Words of A that a worker remembers.
MAX_WORDS = 100_000
#: Bits of a B id in a pair.
SHIFT = 32
#: The character that B writes for a space.
SPACE = "▁"
SCHEMA = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, "
    "pairs array<long>, pair_docs array<long>, links binary"
)
_LONGS = pa.list_(pa.int64())
_ARROW = pa.schema(
    [("block", pa.int64())] + [(name, _LONGS) for name in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")] + [("groups", pa.list_(pa.string())), ("pairs", _LONGS), ("pair_docs", _LONGS), ("links", pa.binary())]
)
_BLOCK = ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "counts", "bests")
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
_RESULT = pa.schema([(name, pa.int64()) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups", pa.string())])


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Pieces:
    """The bytes of a vocabulary's tokens, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.names = pa.array([str(i) for i in range(len(tokens))])

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.data[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class WordIds(dict):
    """The ids of A's words, which A cuts before it merges, by the library's model; little-endian 32-bit."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.merge = tokenizer.model.tokenize
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in (9, 10, 13, *range(0x20, 0x7F), *range(0xC0, 0x100))}

    def __missing__(self, word: str) -> bytes:
        if len(self) > MAX_WORDS:
            self.clear()
        ids = self[word] = np.array([t.id for t in self.merge(word.translate(self.alphabet))], "<i4").tobytes()
        return ids


class Pair:
    """The two tokenizers in a worker."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.words = WordIds(self.a)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            tokens[number] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.of_a = Pieces(tokens)
        b = self.b
        self.of_b = Pieces([bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace(SPACE, " ").encode() for i in range(b.get_piece_size())])

    def encode_a(self, text: str) -> np.ndarray:
        """A's ids of a space and the text; a plain text's are those of its words in order."""
        if _PLAIN.fullmatch(text):
            return np.frombuffer(b"".join(map(self.words.__getitem__, _WORDS.findall(" " + text))), "<i4").astype(np.int64)
        return np.array(self.a.encode(" " + text, add_special_tokens=False).ids, np.int64)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return [self.encode_a(t) for t in texts], [np.array(ids, np.int64) for ids in self.b.encode(texts, num_threads=1)]


@lru_cache(2)
def _pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows end to end and their bounds."""
    bounds = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=bounds[1:])
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), bounds


def _same(pieces: Pieces, rows: list[np.ndarray], texts: list[bytes]) -> np.ndarray:
    """For each document whether its tokens' bytes are its text's."""
    want = np.array([len(t) for t in texts], np.int64)
    ids, bounds = _flat(rows)
    sums = np.concatenate([[0], np.cumsum(pieces.sizes[ids])])
    fits = np.diff(sums[bounds]) == want
    chosen = np.flatnonzero(fits)
    have = pieces.joined(_flat([rows[i] for i in chosen])[0])
    differ = np.concatenate([[0], np.cumsum(have != np.frombuffer(b"".join(texts[i] for i in chosen), np.uint8))])
    edges = np.concatenate([[0], np.cumsum(want[chosen])])
    fits[chosen] = np.diff(differ[edges]) == 0
    return fits


def _lists(values: pa.Array, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def align_texts(pair: Pair, texts: list[str | None], digest: bool) -> dict[str, np.ndarray | list[str]]:
    """Of each text n_a, n_b, n_groups, n_links and groups; of all the links' pairs, by document and place."""
    n = len(texts)
    own = np.flatnonzero([bool(t) for t in texts])
    rows_a, rows_b, held = [], [], [texts[i] for i in own]
    sizes = np.concatenate([[0], np.cumsum([len(t) for t in held])]).astype(np.int64)
    for i, j in slices(sizes, CALL_BYTES):
        a, b = pair.encode(held[i:j])
        rows_a += a
        rows_b += b
    spaced = [b" " + t.encode() for t in held]
    if len(own):
        good = np.flatnonzero(_same(pair.of_a, rows_a, spaced) & _same(pair.of_b, rows_b, spaced))
        own, spaced, rows_a, rows_b = own[good], [spaced[i] for i in good], [rows_a[i] for i in good], [rows_b[i] for i in good]
    edges = np.concatenate([[0], np.cumsum([len(t) for t in spaced])]).astype(np.int64)
    (ids_a, _), (ids_b, _) = _flat(rows_a), _flat(rows_b)
    ends_a = np.bincount(np.cumsum(pair.of_a.sizes[ids_a]) - 1, minlength=edges[-1])[: edges[-1]] > 0
    ends_b = np.bincount(np.cumsum(pair.of_b.sizes[ids_b]) - 1, minlength=edges[-1])[: edges[-1]] > 0

    def before(flags: np.ndarray) -> np.ndarray:
        """How many flags are set before each byte and before the end."""
        out = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=out[1:])
        return out

    places = np.flatnonzero(ends_a | ends_b)
    sums_a, sums_b, sums_cut = before(ends_a), before(ends_b), before(ends_a & ends_b)
    links = ids_a[sums_a[places]] << SHIFT | ids_b[sums_b[places]]
    at = np.searchsorted(places, edges)
    cuts = np.flatnonzero(ends_a & ends_b) + 1
    text = [
        pc.binary_join(_lists(pieces.names.take(pa.array(ids)), np.concatenate([[0], sums[cuts]])), ",")
        for pieces, ids, sums in ((pair.of_a, ids_a, sums_a), (pair.of_b, ids_b, sums_b))
    ]
    groups = pc.binary_join(_lists(pc.binary_join_element_wise(*text, "|"), sums_cut[edges]), ";").to_pylist() if len(own) else []
    if digest:
        groups = [hashlib.sha256(g.encode()).hexdigest() for g in groups]
    out: dict[str, np.ndarray | list[str]] = {}
    for name, values in (("n_a", np.diff(sums_a[edges])), ("n_b", np.diff(sums_b[edges])), ("n_groups", np.diff(sums_cut[edges])), ("n_links", np.diff(at))):
        out[name] = np.zeros(n, np.int64)
        out[name][own] = values
    named = dict(zip(own.tolist(), groups))
    return out | {"groups": [named.get(i, "") for i in range(n)], "links": links}


def _blocks(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, digest: bool) -> Iterator[pa.RecordBatch]:
    pair, block = _pair(path_a, path_b), TaskContext.get().partitionId() << 32
    for batch in batches:
        for i, j in slices(text_bytes(batch.column(1))[1], BLOCK_BYTES):
            found = align_texts(pair, batch.column(1)[i:j].to_pylist(), digest)
            pairs, which = np.unique(found["links"], return_inverse=True)
            # each pair once for each document that holds it
            doc = np.repeat(np.arange(j - i), found["n_links"])
            once = np.unique(doc * max(len(pairs), 1) + which)
            docs = np.bincount(once % max(len(pairs), 1), minlength=len(pairs)) if len(pairs) else once
            row = [block, batch.column(0)[i:j].to_pylist(), *(found[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups")), pairs, docs]
            packed = pa.compress(which.astype("<i4").tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*row, packed], _ARROW)], schema=_ARROW)
            block += 1


def _result(table: pa.Table) -> pa.Table:
    """The rows of one block's documents."""
    doc_ids, n_a, n_b, n_groups, n_links, groups, packed, counts, best = (table.column(name)[0] for name in _BLOCK)
    bounds = np.concatenate([[0], np.cumsum(n_links.values.to_numpy())])
    links = np.frombuffer(pa.decompress(packed.as_py(), int(bounds[-1]) * 4, codec="zstd", asbytes=True), "<i4") if bounds[-1] else np.zeros(0, np.int32)
    sums = []
    for values in (best, counts):
        values = values.values.to_numpy(zero_copy_only=False).astype(np.int64) if values.is_valid else np.zeros(0, np.int64)
        sums.append(pa.array(np.diff(np.concatenate([[0], np.cumsum(values[links])])[bounds])))
    columns = [doc_ids.values, n_a.values, n_b.values, n_groups.values, n_links.values, *sums, groups.values]
    return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, _RESULT)], schema=_RESULT)


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, digest: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id (long), n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` in decimal ids, or with ``digest`` its SHA-256 in hex. A link
    is a pair of tokens whose bytes overlap; its count is the number of rows that hold its ids
    linked, ``n_best`` the links whose count is the highest of their A id (ties included),
    ``count_sum`` the sum of the counts. Texts that are null or empty, or that a tokenizer doesn't
    give back byte by byte, have no tokens: zeros, and '' for ``groups``. Repeated rows and keys,
    null ones too, are rows of their own. A table without rows gives none; other columns are not
    read. Texts are taken whole; tasks need memory for a block, or for the longest text.

    Blocks are written to the shared folder, as both passes need them; the caller may remove them after use.
    """
    spark = docs.sparkSession
    path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    place = f"{shared_dir(spark)}/links-{uuid.uuid4().hex}"
    rows = docs.select(F.col(key).cast("long"), F.col(text))
    rows.mapInArrow(partial(_blocks, path_a=path_a, path_b=path_b, digest=digest), SCHEMA).write.parquet(place)
    blocks = spark.read.schema(SCHEMA).parquet(place)
    held = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "pair_docs")).alias("at", "p")).select("block", "at", F.col("p.pairs").alias("pair"), F.col("p.pair_docs").alias("n"))
    counts = held.groupBy("pair").agg(F.sum("n").alias("count"))
    # an A id has no more pairs than B has ids
    highest = F.max("count").over(Window.partitionBy(F.shiftright("pair", SHIFT)))
    counts = counts.select("pair", "count", (F.col("count") == highest).alias("best"))
    answers = (
        held.select("block", "at", "pair").join(counts, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "count", "best"))).alias("found"))
    ).select("block", F.col("found.count").alias("counts"), F.col("found.best").alias("bests"))
    whole = blocks.drop("pairs", "pair_docs").join(answers, "block", "left")
    # the join has sorted by block: a task takes one after the other
    return whole.groupBy("block").applyInArrow(_result, RESULT)
