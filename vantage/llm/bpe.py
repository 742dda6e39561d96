"""Byte-level BPE: merges over the bytes of a block's different words at once, and decoding by joining pieces.

Texts are cut into words by the vocabulary's pattern, block by block of whole documents; a block's
different words are encoded once. A word starts as its bytes' ids. All words of a block lie end to
end in one array; each round finds every word's lowest rank of a pair and merges there, until no pair
has one. A word that is a token itself has that one id, as the tiktoken library has it. Nothing is
shuffled: blocks are cut where rows lie, so a hot word or source costs one merging in each block that
holds it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block, about; a longer document has a block of its own.
BLOCK_BYTES = 16 << 20
#: Words of more ids than this merge all pairs of the lowest rank in one round, where that is the same.
ROUNDS_FROM = 2
#: The rank of a pair that is not merged.
NONE = 2**31 - 1


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    return public_tokenizers.path(name)


@lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Splitter:
    """Words of a text as the tiktoken library cuts it.

    That library and ``regex`` know different versions of Unicode. Characters that Python's tables
    don't have are tried on the library; one that it takes for a mark, and ``regex`` for a letter
    or number, stands in as U+FFFF, which is neither, while the text is cut.
    """

    def __init__(self, pattern: str = public_tokenizers.PATTERN):
        self.pattern = regex.compile(pattern)
        doubtful = regex.findall(r"[\p{L}\p{N}]", "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn"))
        ranks = {bytes([b]): b for b in range(256)}
        for piece in (first + c for c in doubtful for first in "b1"):
            for n in range(2, len(piece.encode()) + 1):
                ranks.setdefault(piece.encode()[:n], len(ranks))
        library = tiktoken.Encoding("trial", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        marks = [c for c in doubtful if all(len(library.encode_ordinary(first + c)) > 1 for first in "b1")]
        self.stand_in = {ord(c): 0xFFFF for c in marks}
        self.marks = frozenset(marks)

    def words(self, text: str) -> list[str]:
        if text.isascii() or self.marks.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.stand_in))]


@lru_cache(4)
def splitter(pattern: str) -> Splitter:
    return Splitter(pattern)


def _literal(value: object, kind: str) -> Column:
    """``value`` as a literal: the optimizer folds the parsing of a constant."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


class Merges:
    """A vocabulary's merges, over arrays of ids in which -1 stands between words and makes no token with any id."""

    def __init__(self, ranks: dict[bytes, int], rounds_from: int):
        self.ranks, self.rounds_from, self.wide = ranks, rounds_from, max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.wide + right] = rank
        self.keys = np.array([*sorted(pairs), 2**62], np.int64)
        self.values = np.array([*(pairs[k] for k in sorted(pairs)), NONE], np.int64)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pieces = {rank: token for token, rank in ranks.items()}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of the tokens that two ids each make, NONE where there is none."""
        key = np.where((left < 0) | (right < 0), 0, left * self.wide + right)
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], NONE)

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has."""
        whole = [self.ranks.get(w) for w in words]
        rest = [i for i, rank in enumerate(whole) if rank is None and words[i]]
        known = np.array([i for i, rank in enumerate(whole) if rank is not None], np.int64)
        found = [(known, np.array([whole[i] for i in known], np.int64)), *self._merged(np.array(rest, np.int64), [words[i] for i in rest])]
        word, ids = (np.concatenate(parts) for parts in zip(*found))
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _merged(self, numbers: np.ndarray, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers and ids of words, when no pair of theirs makes a token."""
        sizes = np.array(list(map(len, words)), np.int64) + 1
        if not len(sizes):
            return
        ids, inside = np.full(sizes.sum(), -1, np.int64), np.ones(sizes.sum(), bool)
        inside[np.cumsum(sizes) - 1] = False
        ids[inside] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word, ranks = np.repeat(np.arange(len(words)), sizes), np.full(len(ids), NONE, np.int64)
        ranks[:-1] = self.rank(ids[:-1], ids[1:])
        while len(ids):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(ids)))
            lowest = np.minimum.reduceat(ranks, starts)
            low = np.repeat(lowest, sizes)
            if (lowest == NONE).any():
                done = low == NONE
                own = done & (ids >= 0)
                yield numbers[word[own]], ids[own]
                ids, word, ranks, low, sizes = ids[~done], word[~done], ranks[~done], low[~done], sizes[lowest != NONE]
                if not len(ids):
                    return
            taken = np.flatnonzero(ranks == low)
            place = np.arange(len(taken))
            run = np.maximum.accumulate(np.where(np.append(True, taken[1:] != taken[:-1] + 1), place, 0))
            taken = taken[(place - run) % 2 == 0]  # of overlapping pairs every other one
            new, of = low[taken], word[taken]
            mark = np.zeros(len(ids), bool)
            mark[taken] = True
            before = np.where(mark[taken - 2], new, ids[taken - 1])
            # a merge may make a pair of lower rank, which goes before the rest: then the first alone, as in short words
            wait = (self.rank(before, new) < new) | (self.rank(new, ids[taken + 2]) < new)
            alone = np.zeros(len(words), bool)
            alone[of[wait]] = True
            first = np.append(True, of[1:] != of[:-1])
            keep = first | ~(alone[of] | (np.repeat(sizes, sizes)[taken] - 1 <= self.rounds_from))
            taken, new = taken[keep], new[keep]
            ids[taken] = new
            stays = np.ones(len(ids), bool)
            stays[taken + 1] = False
            ids, word, ranks = ids[stays], word[stays], ranks[stays]
            moved = taken - np.arange(len(taken))
            for at in (moved, moved - 1):  # before the first there is the end of the last word
                ranks[at] = self.rank(ids[at], ids[at + 1])


_known: dict[str, Merges] = {}


def _block(doc_ids: list, numbers: list[array], words: dict[str, int], merges: Merges, schema: pa.Schema) -> pa.RecordBatch:
    """A row for each document, given the numbers of its words."""
    ids, sizes = merges.ids([w.encode() for w in words])
    starts, piece = np.cumsum(sizes) - sizes, merges.pieces.__getitem__
    columns: dict[str, list] = {name: [] for name in schema.names}
    columns["doc_id"] = doc_ids
    for own in numbers:
        at = np.frombuffer(own, np.int32)
        n = sizes[at]
        line = ids[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        if "ids" in columns:
            columns["ids"].append(line.astype(np.int32))
        if "packed" in columns:
            columns["packed"].append(line.astype("<u4").tobytes())
        if "decoded" in columns:
            columns["decoded"].append(b"".join(map(piece, line.tolist())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _joined(parts: Column) -> Column:
    """Binary values joined, as a string, in which bytes stay what they are."""
    return F.array_join(F.transform(parts, lambda b: b.cast("string")), "")


def _pieces(path: str) -> Column:
    tokens: list[str] = []
    for token, rank in sorted(read_ranks(path).items(), key=lambda item: item[1]):
        tokens += [""] * (rank - len(tokens)) + [base64.b64encode(token).decode()]
    return _literal(tokens, "array<binary>")


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, parts: tuple[str, ...] = ("ids",), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id (long) and ``parts``: ids (array of int), packed (binary: the ids as little-endian
    unsigned 32-bit integers), decoded (binary: the bytes that the ids give back).

    Null and empty texts have no ids. Repeated rows and keys, null ones too, each give a row of
    their own, in no stated order. A table without rows gives none; other columns are not read.
    Texts are taken whole, and special tokens are no more than their characters. A word of n bytes
    takes up to n - 1 rounds over its ids; one of more than ``ROUNDS_FROM`` ids merges equal pairs together.
    """
    ranks = read_ranks(path or vocabulary_path())
    name, rounds_from = hashlib.sha256(repr((sorted(ranks.items()), ROUNDS_FROM)).encode()).hexdigest(), ROUNDS_FROM
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kinds = {"ids": ("array<int>", pa.list_(pa.int32())), "packed": ("binary", pa.binary()), "decoded": ("binary", pa.binary())}
    schema = pa.schema([("doc_id", pa.int64()), *((p, kinds[p][1]) for p in parts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _known:
            _known[name] = Merges(shared.value, rounds_from)
        cut, merges = splitter(pattern).words, _known[name]
        doc_ids: list = []
        numbers: list[array] = []
        words: dict[str, int] = {}
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                if numbers and size + len(text) > BLOCK_BYTES:
                    yield _block(doc_ids, numbers, words, merges, schema)
                    doc_ids, numbers, words, size = [], [], {}, 0
                doc_ids.append(doc_id.as_py())
                numbers.append(array("i", [words.setdefault(w, len(words)) for w in cut(text)]))
                size += len(text)
        if numbers:
            yield _block(doc_ids, numbers, words, merges, schema)

    rows = docs.select(F.col(key).cast("long"), F.col(text))
    return rows.mapInArrow(run, ", ".join(["doc_id long", *(f"{p} {kinds[p][0]}" for p in parts)]))


def decode(ids: Column, path: str | None = None) -> Column:
    """The bytes of an array of ids; null for null. An id that the vocabulary lacks has no bytes."""
    pieces = _pieces(path or vocabulary_path())
    return _joined(F.transform(ids, lambda i: F.coalesce(F.get(pieces, i), F.lit(b"")))).cast("binary")
