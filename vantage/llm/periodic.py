"""Runs: stretches of words that repeat with a period, found from Lyndon words.

A stack is scanned right to left under an order of a document's words and under the reverse order;
it gives the longest Lyndon word that starts at each word. Every run with a smallest period p has
Lyndon words of length p, one behind the other, under one of the orders, so places with enough
equal lengths in a row are the candidates. Comparing and extending ask for the longest common
extension of two places: rolling hashes and a binary search find it, and the words themselves
verify it. No suffix array is built.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import mixed

#: Words compared one by one before hashes are asked.
DIRECT = 8
#: Bytes of text in an output batch, about.
BATCH_BYTES = 8 << 20
_STEP = 0xD1342543DE82EF95
_WRAP = (1 << 64) - 1
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept_text string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("kept_text", pa.string())])


class Extensions:
    """Longest common extensions in a row of word numbers, forwards and backwards."""

    def __init__(self, words: list[int]):
        self.words = words
        self.sums: list[int] | None = None

    def _prepare(self) -> None:
        """Prefix sums of word hashes times powers of an odd number, and its inverse's powers, mod 2^64."""
        self.row = np.array(self.words, np.int64)
        n = len(self.row)
        powers = np.full(n + 1, _STEP, np.uint64)
        powers[0] = 1
        down = np.full(n + 1, pow(_STEP, -1, 1 << 64), np.uint64)
        down[0] = 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(self.row.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(powers)[:n], out=sums[1:])
        self.sums, self.down = sums.tolist(), np.multiply.accumulate(down).tolist()

    def _alike(self, i: int, j: int, n: int) -> bool:
        sums, down = self.sums, self.down
        return ((sums[i + n] - sums[i]) * down[i] - (sums[j + n] - sums[j]) * down[j]) & _WRAP == 0

    def _search(self, known: int, limit: int, alike) -> int:
        """The longest length up to ``limit`` whose hashes are equal: widening steps, then halves."""
        step, high = DIRECT, limit
        while known + step <= limit:
            if not alike(known + step):
                high = known + step - 1
                break
            known, step = known + step, 2 * step
        while known < high:
            middle = (known + high + 1) // 2
            if alike(middle):
                known = middle
            else:
                high = middle - 1
        return known

    def forward(self, i: int, j: int, limit: int) -> int:
        """How many words from i on equal those from j on, ``limit`` at most."""
        words, n = self.words, 0
        while n < limit and n < DIRECT:
            if words[i + n] != words[j + n]:
                return n
            n += 1
        if n == limit:
            return n
        if self.sums is None:
            self._prepare()
        n = self._search(n, limit, lambda m: self._alike(i, j, m))
        return self._verified(self.row[i : i + n] != self.row[j : j + n], n)

    def backward(self, i: int, j: int, limit: int) -> int:
        """How many words before i equal those before j, ``limit`` at most."""
        words, n = self.words, 0
        while n < limit and n < DIRECT:
            if words[i - n - 1] != words[j - n - 1]:
                return n
            n += 1
        if n == limit:
            return n
        if self.sums is None:
            self._prepare()
        n = self._search(n, limit, lambda m: self._alike(i - m, j - m, m))
        return self._verified((self.row[i - n : i] != self.row[j - n : j])[::-1], n)

    @staticmethod
    def _verified(differ: np.ndarray, n: int) -> int:
        """Equal words have equal hashes, so only a too long match can be wrong, and the words show where."""
        return int(differ.argmax()) if differ.any() else n


def lyndon_ends(words: list[int], forward) -> list[int]:
    """For each word the end of the longest Lyndon word that starts there, by the order of the numbers."""
    n = len(words)
    ends = [0] * n
    for i in range(n - 1, -1, -1):
        j, word = i + 1, words[i]
        while j < n:
            other = words[j]
            if word < other:
                j = ends[j]
            elif word > other:
                break
            else:
                own, its = j - i, ends[j] - j
                same = forward(i, j, min(own, its))
                if same == its or same < own and words[i + same] > words[j + same]:
                    break  # not smaller: equal, the longer of two with one beginning, or greater
                j = ends[j]
        ends[i] = j
    return ends


def runs_of(words: list[int], min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """All (start, length, period) with length >= max(min_length, min_exponent * period), by start and period.

    ``words`` are numbers, equal for equal words. A run is a longest stretch whose words a smallest
    period apart are equal; ``min_exponent`` is 2 or more. A run of exponent e holds e - 1 whole
    Lyndon words in a row at least, so that many are asked for before anything is extended.
    """
    n = len(words)
    if n < max(min_length, min_exponent):
        return []
    common = Extensions(words)
    found: set[tuple[int, int, int]] = set()
    for order in (words, [-w for w in words]):
        lengths = np.array(lyndon_ends(order, common.forward), np.int64) - np.arange(n)
        row, at = np.array(words, np.int64), np.arange(n)
        hits = np.ones(n, bool)
        for k in range(1, min_exponent - 1):
            there = at + k * lengths
            inside = there < n
            there = np.where(inside, there, 0)
            hits &= inside & (lengths[there] == lengths) & (row[there] == row)
        last: dict[int, int] = {}
        for i in np.flatnonzero(hits & (at + min_exponent * lengths <= n + lengths)).tolist():
            p = int(lengths[i])
            if i + p <= last.get(p, -1):
                continue  # within the run found before
            end = i + p + common.forward(i, i + p, n - i - p)
            start = i - common.backward(i, i + p, i)
            last[p] = end
            if end - start >= max(min_length, min_exponent * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda run: (run[0], run[2]))


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] > 0


def _found(batches: Iterator[pa.RecordBatch], min_length: int, min_exponent: int) -> Iterator[pa.RecordBatch]:
    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), _ARROW)], schema=_ARROW)

    rows, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            own = (text.as_py() or "").encode().split()  # bytes are split at ASCII white space only
            seen: dict[bytes, int] = {}
            runs = runs_of([seen.setdefault(w, len(seen) + 1) for w in own], min_length, min_exponent)
            n = len(own)
            if runs:
                own = [w for w, drop in zip(own, dropped(n, runs).tolist()) if not drop]
            kept = b" ".join(own).decode()
            rows.append((doc_id.as_py(), n, [{"start": s, "length": m, "period": p} for s, m, p in runs], kept))
            size += len(kept)
            if size > BATCH_BYTES:
                yield batch_of(rows)
                rows, size = [], 0
    if rows:
        yield batch_of(rows)


def find_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id (long), n_words, runs (start, length, period; by start, then period), kept_text.

    Words are runs without ASCII white space. ``kept_text`` has the words that no run contains after
    its first period, joined by one space. Null and empty texts have no words, no runs and an empty
    ``kept_text``. Repeated rows and keys, null ones too, each give a row of their own, in no stated
    order. A table without rows gives none; other columns are not read. A text is taken whole by one
    task, in memory proportional to it and, but for verified repeats, time proportional to n log n.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods or more")
    rows = docs.select(F.col(key).cast("long"), F.col(text))
    return rows.mapInArrow(partial(_found, min_length=min_length, min_exponent=min_exponent), SCHEMA)
