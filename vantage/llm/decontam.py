"""Benchmark decontamination by greedy string tiling.

Texts are words (letters and digits of any script, case folded; single characters in scripts without
blanks). Seeds are the hashes of ``least`` consecutive words of a benchmark item, or of all words of
a shorter one if these are asked for (``short``); documents that share a seed with an item are tiled against it by
running Karp-Rabin: rolling hashes find matches of words not yet marked of a search length, which
starts at the item's and is halved down to ``least``; of those found the longest are marked without
overlap, and the search goes on. The item's covered share decides, so an item whose parts are in another order is found as well.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import U64, mixed, slices, text_bytes, window_hashes, word_hashes

#: Words of benchmark items that one broadcast holds; larger benchmarks go in blocks, one pass each.
BLOCK_WORDS = 2_000_000
SLICE_BYTES = 4 << 20
_LETTER = np.zeros(256, np.uint8)
_LETTER[:] = 32
_LETTER[48:58] = np.arange(48, 58)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_WORD = re.compile(rb"[^ ]+")
_BLANK, _PART, _NONE, _ALONE = range(4)
#: Code points whose letters are words: scripts written without blanks (Thai, Lao, Myanmar, Khmer, kana, Han, Yi and others).
_UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF)]


@cache
def _kinds() -> np.ndarray:
    """What each code point is: a blank, a part of a word (letter, digit, mark), nothing (formatting), or a word alone."""
    codes = {"L": _PART, "N": _PART, "M": _PART}
    kinds = np.fromiter((_NONE if (c := unicodedata.category(chr(i))) == "Cf" else codes.get(c[0], _BLANK) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    for a, b in _UNSPACED:
        kinds[a : b + 1][kinds[a : b + 1] == _PART] = _ALONE
    return kinds


def plain(text: str | None) -> bytes:
    """The text's words with blanks between: case folded, compatible forms made one, all but letters, digits and marks as blanks."""
    text = text or ""
    if text.isascii():
        return text.encode().translate(_LETTER.tobytes())
    # capitals are folded before and after, as some forms only have a compatible capital
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text.casefold()).casefold())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[points]
    points = np.where(kinds == _BLANK, np.uint32(32), points)
    if (kinds > _PART).any():
        alone = kinds == _ALONE
        spaced = np.full((len(points), 3), 32, np.uint32)
        spaced[:, 1] = points
        wanted = np.stack([alone, kinds != _NONE, alone], axis=1)
        points = spaced[wanted]
    return points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")


#: Candidate places that are looked at together.
PLACES = 1 << 20


def tile(doc: list[bytes], item: list[bytes], least: int) -> list[tuple[int, int, int]]:
    """Tiles (document word, item word, length) by greedy string tiling, longest first.

    Ties go to the first place in the item, then in the document. A word of the document that the
    item doesn't have counts as marked. Memory grows with the texts and PLACES.
    """
    numbers: dict[bytes, int] = {}
    b = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in item), np.int64, len(item))
    a = np.fromiter((numbers.get(w, 0) for w in doc), np.int64, len(doc))
    in_doc, in_item, tiles = a == 0, np.zeros(len(b), bool), []
    hashes = [mixed(x.astype(U64)) for x in (a, b)]
    size = min(len(a), len(b))
    while size >= least:
        rolled = [window_hashes(h, size) for h in hashes]
        while True:
            places = _free(in_doc, size), _free(in_item, size)
            longest = max((int(n.max()) for _, _, n in _matches(a, b, in_doc, in_item, rolled, places, size) if len(n)), default=0)
            if longest < size:
                break
            for at, to, n in _matches(a, b, in_doc, in_item, rolled, places, size):
                for i, j in zip(at[n == longest].tolist(), to[n == longest].tolist()):
                    if not in_item[j : j + longest].any() and not in_doc[i : i + longest].any():
                        in_doc[i : i + longest] = in_item[j : j + longest] = True
                        tiles.append((i, j, longest))
        if size == least:
            break
        size = max(least, size // 2)
    return tiles


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Where windows of ``size`` words without a marked one start."""
    before = np.r_[0, np.cumsum(marked)]
    return np.flatnonzero(before[size:] == before[: len(before) - size])


def _matches(a: np.ndarray, b: np.ndarray, in_doc: np.ndarray, in_item: np.ndarray, rolled: list[np.ndarray], places: tuple[np.ndarray, np.ndarray], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document and item words where matches of ``size`` or more start, with lengths, by item word, in parts.

    Only starts that can't be extended to the left are given: a longer match has one.
    """
    own, other = places
    own = own[np.isin(rolled[0][own], rolled[1][other])]
    own = own[np.argsort(rolled[0][own], kind="stable")]
    keys = rolled[0][own]
    first, last = np.searchsorted(keys, rolled[1][other], "left"), np.searchsorted(keys, rolled[1][other], "right")
    begin, total = 0, np.cumsum(last - first)
    old_doc, old_item = in_doc.copy(), in_item.copy()  # what is marked meanwhile doesn't change the matches
    while begin < len(other):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PLACES, "right")))
        counts = (last - first)[begin:end]
        j = np.repeat(other[begin:end], counts)
        i = own[np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[begin:end], counts)]
        begin = end
        inner = (i > 0) & (j > 0)
        x, y = i[inner] - 1, j[inner] - 1
        inner[inner] = (a[x] == b[y]) & ~old_doc[x] & ~old_item[y]
        i, j = i[~inner], j[~inner]
        n, alive = np.zeros(len(i), np.int64), np.arange(len(i))
        while len(alive):
            x, y = i[alive] + n[alive], j[alive] + n[alive]
            inside = (x < len(a)) & (y < len(b))
            alive, x, y = alive[inside], x[inside], y[inside]
            alive = alive[(a[x] == b[y]) & ~old_doc[x] & ~old_item[y]]
            n[alive] += 1
        yield i, j, np.where(n >= size, n, 0)


class Benchmark:
    """A block of items with the hashes of their seeds, sorted."""

    def __init__(self, items: list[tuple[int, str]], least: int, short: bool = False):
        self.ids = [n for n, _ in items]
        self.words = [_WORD.findall(plain(t)) for _, t in items]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by words of a seed: sorted hashes, their items, filter
        for size in sorted({min(least, len(words)) for words in self.words if short or len(words) >= least} - {0}):
            hashes, owners = [], []
            for n, words in enumerate(self.words):
                if min(least, len(words)) == size:
                    line = np.frombuffer(b" ".join(words), np.uint8)
                    own = window_hashes(word_hashes(line, np.array([0, len(line)]))[0], size)
                    hashes.append(own)
                    owners.append(np.full(len(own), n))
            hashes, owners = np.concatenate(hashes), np.concatenate(owners)
            order = np.argsort(hashes, kind="stable")
            first = np.zeros(1 << 22, bool)  # by the first bits; most windows of a corpus stop here
            first[(hashes >> U64(42)).astype(np.int64)] = True
            self.seeds[size] = hashes[order], owners[order], first

    def items_of(self, data: np.ndarray, bounds: np.ndarray) -> dict[int, set[int]]:
        """Items that share a seed, by row of plain text."""
        words, at = word_hashes(data, bounds)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(at))
        found: dict[int, set[int]] = {}
        for size, (seeds, owner, first) in self.seeds.items():
            hashes = window_hashes(words, size)
            starts = np.flatnonzero(first[(hashes >> U64(42)).astype(np.int64)])
            starts = starts[row[starts] == row[starts + size - 1]]
            a, b = np.searchsorted(seeds, hashes[starts], "left"), np.searchsorted(seeds, hashes[starts], "right")
            for i in np.flatnonzero(b > a):
                found.setdefault(int(row[starts[i]]), set()).update(owner[a[i] : b[i]].tolist())
        return found


def matches(texts: pa.Array, bench: Benchmark, share: float, least: int) -> Iterator[tuple[int, int, int, int, list]]:
    """Row, item_id, the item's words, covered words and tiles, where the coverage reaches ``share``."""
    _, sizes = text_bytes(texts)
    for a, b in slices(sizes, SLICE_BYTES):
        lines = [plain(t) for t in texts.slice(a, b - a).to_pylist()]
        data, bounds = np.frombuffer(b"".join(lines), np.uint8), np.cumsum([0, *map(len, lines)])
        for row, items in sorted(bench.items_of(data, bounds).items()):
            words = _WORD.findall(lines[row])
            for n in sorted(items):
                tiles = tile(words, bench.words[n], min(least, len(bench.words[n])))
                covered = sum(t[2] for t in tiles)
                if covered >= share * len(bench.words[n]):
                    yield a + row, bench.ids[n], len(bench.words[n]), covered, tiles


def _blocks(benchmark: DataFrame, item: str, item_text: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about BLOCK_WORDS words, by ranges of their hash, so that none is too large to hold."""
    rows = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL AND item_id IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = 1 + total // (6 * BLOCK_WORDS)
    for n in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n)
        yield sorted((r.item_id, r.text) for r in part.collect())


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, least: int = 4, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", short: bool = False) -> DataFrame:
    """doc_id, item_id, item_words, covered, coverage and tiles of each pair whose coverage reaches ``share``.

    A tile has its first word in the document and in the item and its length. Null texts and
    items without words match nothing, nor do those of fewer than ``least`` words, unless ``short``
    lets these match as a whole. Repeated rows give repeated pairs; rows with a null doc_id do so
    with a null, items with a null id are left out. Ties of tiles go to the first in the item, then in
    the document. Other columns are not read, so none can clash; empty tables give no rows.
    Documents aren't shuffled.
    """
    schema = "doc_id long, item_id long, item_words int, covered int, coverage double, tiles array<struct<doc_word:int,item_word:int,length:int>>"
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("length", pa.int32())]))]
    out = None
    for items in _blocks(benchmark, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(items, least, short))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [
                    (batch.column(0)[row].as_py(), number, words, covered, covered / words, [{"doc_word": i, "item_word": j, "length": k} for i, j, k in tiles])
                    for row, number, words, covered, tiles in matches(batch.column(1), shared.value, share, least)
                ]
                columns = list(zip(*found)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "item_words", "covered", "coverage", "tiles"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, least: int = 4, text: str = "text", item: str = "item_id", item_text: str = "text", short: bool = False) -> DataFrame:
    """The rows of ``docs`` that no item is covered in (see ``contaminated``), without a shuffle.

    Columns stay as they are, whatever their names; repeated rows are judged alike.
    """
    at = docs.columns.index(text)
    for items in _blocks(benchmark, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(items, least, short))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[m[0] for m in matches(batch.column(at), shared.value, share, least)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
