"""A range coder for token ids, many blocks at a time.

An id is coded as one of sixteen events and, where that leaves it open, a place inside a class. The
events are: the id that the last two ids predict (order 2), the id that the last one predicts
(order 1), or one of fourteen classes, into which a chunk's ids fall by their neighbours. What an id
predicts is learned block by block; events have the chunk's frequencies for each class of the last
id and each way in which the two predictions have been sure. Inside a class ids have the chunk's
frequencies; the last class is for ids too rare for that, whose bits are sent.

The ids, classes and frequencies are in the chunk's head; a block needs the head and no other block.
Blocks are coded side by side: a numpy operation takes one step in all of them. The model computes
with integers, the coder with whole numbers below 2^53, so results are the same everywhere.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

#: Ids of a block, about; slots of the tables that predict ids.
BLOCK, SLOTS = 2048, 128
#: Events: classes (the last for rare ids), the order-1 id, the order-2 id.
EVENTS, CLASSES, RARE, FIRST, SECOND = 16, 14, 13, 14, 15
#: Ids with a frequency of their own; bits of shares of events and of ids inside a class.
KNOWN, EVENT_BITS, INSIDE_BITS = 1 << 14, 12, 15
#: Contexts of events: 16 ways in which two predictions have been sure, times classes.
CONTEXTS = 16 * CLASSES
#: Steps whose shares are looked up at once.
STEPS = 64
_WHOLE = 1 << EVENT_BITS
_LEAST, _WORD = 2.0**32, 2.0**16


def _rough(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte each, on a scale of logarithms."""
    return np.minimum(255, np.round(8 * np.log2(1 + counts.astype(np.float64)))).astype(np.uint8)


#: What a byte of ``_rough`` stands for, 1 at least; a table of rounded numbers, so that all machines agree.
_SMOOTH = np.array([max(1, round(2 ** (i / 8) * 4) - 4) for i in range(256)], np.int64)


def _shares(counts: np.ndarray, whole: int) -> np.ndarray:
    """Whole numbers from 1, in proportion to ``counts`` and ``whole`` together, along the last axis."""
    n = counts.shape[-1]
    own = 1 + counts * (whole - n) // counts.sum(-1, keepdims=True)
    top = counts.argmax(-1)[..., None]
    np.put_along_axis(own, top, np.take_along_axis(own, top, -1) + whole - own.sum(-1, keepdims=True), -1)
    return own


@dataclass
class Head:
    """What all blocks of a chunk start from."""

    ids: np.ndarray  # known ids by number
    kinds: np.ndarray  # their classes
    rough: np.ndarray  # their counts, as ``_rough`` gives them
    events: np.ndarray  # how often each event comes in each context, as ``_rough`` gives it
    bits: int  # of the largest id
    rare: bool  # whether there are ids without a number

    def __post_init__(self) -> None:
        known, whole = len(self.ids), 1 << INSIDE_BITS
        self.all_kinds = np.append(self.kinds, np.uint8(RARE)).astype(np.int64)
        # Number ``known`` is any rare id; the one after it stands for events that leave nothing open.
        self.begin, self.share = np.zeros(known + 2), np.full(known + 2, float(whole))
        self.slots = np.full(EVENTS << INSIDE_BITS, known + 1, np.uint16)
        self.slots[RARE << INSIDE_BITS : FIRST << INSIDE_BITS] = known
        for kind in range(RARE):
            own = np.flatnonzero(self.kinds == kind)
            if len(own):
                share = _shares(_SMOOTH[self.rough[own]], whole)
                self.share[own], self.begin[own] = share, np.cumsum(share) - share
                self.slots[kind << INSIDE_BITS : kind + 1 << INSIDE_BITS] = np.repeat(own, share)

    def packed(self) -> bytes:
        data = zlib.compress(b"".join(x.tobytes() for x in (self.events, self.ids.astype("<u4"), self.kinds, self.rough)))
        data = bytes([self.bits, self.rare]) + len(self.ids).to_bytes(4, "little") + data
        return zlib.crc32(data).to_bytes(4, "little") + data

    @staticmethod
    def unpacked(data: bytes) -> Head:
        if len(data) < 10 or zlib.crc32(data[4:]) != int.from_bytes(data[:4], "little"):
            raise ValueError("the head of a chunk is damaged")
        n, raw = int.from_bytes(data[6:10], "little"), zlib.decompress(data[10:])
        at = np.cumsum([CONTEXTS * EVENTS, 4 * n, n])
        events, ids, kinds, rough = (np.frombuffer(x, d) for x, d in zip((raw[: at[0]], raw[at[0] : at[1]], raw[at[1] : at[2]], raw[at[2] :]), ("u1", "<u4", "u1", "u1")))
        return Head(ids.astype(np.int64), kinds, rough, events, data[4], bool(data[5]))


def _classes(line: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A class for each known number: k-means over which numbers come before and after it."""
    known, buckets, direct = len(counts), 64, 40
    numbers = np.arange(known + 1)
    where = np.where(numbers < direct, numbers, direct + numbers % (buckets - direct))
    near = where.take(line)
    line = line << 6
    sides = [np.bincount(a + b, minlength=(known + 1) * buckets).reshape(-1, buckets)[:known] for a, b in ((line[:-1], near[1:]), (line[1:], near[:-1]))]
    shape = np.sqrt(np.hstack(sides) / counts[:, None])
    mean = shape[np.linspace(0, min(known, 200) - 1, RARE).astype(int)]
    kind = np.zeros(known, np.int64)
    for _ in range(10):
        kind = np.argmax(shape @ mean.T - (mean**2).sum(1) / 2, axis=1)
        weight = np.zeros((RARE, known))
        weight[kind, np.arange(known)] = counts
        sums = weight.sum(1, keepdims=True)
        mean = np.where(sums > 0, weight @ shape / np.maximum(sums, 1), mean)
    return kind


def numbered(ids: np.ndarray) -> tuple[Head, np.ndarray]:
    """The head of a chunk, but for its events, and its ids as numbers, most frequent first; all rare ids have the last number."""
    top = int(ids.max())
    if top < 1 << 20:
        counts = np.bincount(ids)
        values = np.flatnonzero(counts)
        place, counts = ids, counts[values]
    else:
        values, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((values, -counts))[:KNOWN]
    order = order[counts[order] > 1]
    known = len(order)
    number = np.full(top + 1 if place is ids else len(values), known, np.int64)
    number[values[order] if place is ids else order] = np.arange(known)
    line = number.take(place)
    kinds = (_classes(line, counts[order]) if known else np.zeros(0)).astype(np.uint8)
    return Head(values[order].astype(np.int64), kinds, _rough(counts[order]), np.zeros(CONTEXTS * EVENTS, np.uint8), top.bit_length(), known < len(values)), line


_TOP = _WHOLE - 1
#: Which of a coded number and two guesses an event means.
_MEANT = np.maximum(np.arange(EVENTS) - RARE, 0)


class _Guesses:
    """What the last id (first half of the arrays) and the last two predict in each block, and how sure that has been (0 to 3)."""

    def __init__(self, lanes: int):
        self.table = np.zeros(2 * lanes * SLOTS, np.int32)  # number * 4 + how sure
        self.lane = np.arange(2 * lanes).reshape(2, lanes) * SLOTS
        self.one = self.two = np.zeros(lanes, np.int32)
        self.kind = np.zeros(lanes, np.uint8)

    def first(self, n: int) -> None:
        """Goes on with the first ``n`` blocks."""
        self.lane, self.one, self.two, self.kind = self.lane[:, :n], self.one[:n], self.two[:n], self.kind[:n]

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """The numbers that one id predicts and that two do (2, n), and the contexts of events, times EVENTS."""
        hashed = self.one * np.int32(40503)
        slot = np.empty(self.lane.shape, np.int32)
        np.right_shift(hashed, 4, out=slot[0])
        hashed += self.two * np.int32(30011)
        np.right_shift(hashed, 3, out=slot[1])
        slot &= SLOTS - 1
        self.spots = self.lane + slot
        self.entries = self.table.take(self.spots)
        self.sure = (self.entries & 3).astype(np.uint8)
        self.guesses = self.entries >> 2
        ways = (self.sure[1] << 2 | self.sure[0]) * np.uint8(CLASSES) + self.kind
        return self.guesses, ways.astype(np.int64) << 4

    def learn(self, now: np.ndarray, kind: np.ndarray, hit: np.ndarray) -> None:
        """``now``, of class ``kind``, came; ``hit``: whether that was guessed (2, n)."""
        some, entry = self.sure != 0, self.entries
        entry += hit & (self.sure != 3)
        entry -= some > hit
        np.copyto(entry, now << 2, where=~(some | hit))
        self.table[self.spots] = entry
        self.two, self.one, self.kind = self.one, now, kind


def _places(head: Head, sizes: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The context and event of each number: context * EVENTS + event; ``line`` has a row for each step."""
    out, guesses, known = np.zeros(line.shape, np.int16), _Guesses(len(sizes)), len(head.ids)
    kinds = head.all_kinds.astype(np.uint8).take(line)
    for t, row in enumerate(line):
        n = len(sizes) if t < sizes[-1] else int((sizes > t).sum())
        if n < len(guesses.one):
            guesses.first(n)
        guess, context = guesses.asked()
        now, kind = row[:n].astype(np.int32), kinds[t, :n]
        hit = guess == now
        told = hit & (now != known) if head.rare else hit
        event = np.maximum(kind, np.maximum(told[0].view(np.uint8) * np.uint8(FIRST), told[1].view(np.uint8) * np.uint8(SECOND)))
        out[t, :n] = context + event
        guesses.learn(now, kind, hit)
    return out


def _run(head: Head, sizes: np.ndarray, line: np.ndarray | None, raw: np.ndarray | None, places: np.ndarray | None, words: np.ndarray | None) -> tuple[np.ndarray, list[bytes]]:
    """Codes ``line`` (numbers, a row for each step; ``raw``: their ids; ``places``: their events), or decodes ``words``, to ids.

    A column is a block; sizes differ by one at most and don't rise.
    """
    lanes, steps = len(sizes), int(sizes[0])
    coding, known = line is not None, len(head.ids)
    shares = _shares(_SMOOTH[head.events].reshape(CONTEXTS, EVENTS), _WHOLE)
    starts = (np.cumsum(shares, -1) - shares).reshape(-1).astype(np.float64)
    low, span = np.zeros(lanes), np.full(lanes, _LEAST * _WORD)
    at = np.arange(lanes)  # the next word of each block, in rows of words of all blocks
    if coding:
        stream = np.zeros((4 * steps + 8) * lanes, np.int32)
        found = stream[:0]
    else:
        stream, found, guesses = words.reshape(-1), np.zeros((steps, lanes), np.uint32), _Guesses(lanes)
        extra = np.zeros((steps, lanes), np.uint32) if head.rare else None
        code = words[0] * _LEAST + words[1] * _WORD + words[2]
        at += 3 * lanes
        events = np.repeat(np.tile(np.arange(EVENTS, dtype=np.uint8), CONTEXTS), shares.reshape(-1))
    shares = shares.reshape(-1).astype(np.float64)
    kinds, lane = head.all_kinds.astype(np.uint8), np.arange(lanes)

    def settle(moved: np.ndarray) -> None:
        """Shifts words out of or into these lanes until their spans are large again."""
        while len(moved):
            where = at[moved]
            if coding:
                high = np.floor(low[moved] * (1.0 / _LEAST))
                stream[where] = high
                low[moved] = (low[moved] - high * _LEAST) * _WORD
            else:
                code[moved] = code[moved] * _WORD + stream[where]
            at[moved] = where + lanes
            grown = span[moved] * _WORD
            span[moved] = grown
            moved = moved[grown < _LEAST]

    def rare_ids(t: int, rare: np.ndarray) -> None:
        """The bits of ids without a number, 16 at a time."""
        for shift in range(16 * ((head.bits - 1) // 16), -1, -16) if head.bits else ():
            wide = min(16, head.bits - shift)
            inner = np.floor(span[rare] * 2.0**-wide)
            if coding:
                low[rare] += inner * ((raw[t, rare].astype(np.int64) >> shift) & ((1 << wide) - 1))
            else:
                value = np.minimum((code[rare] / inner).astype(np.int64), (1 << wide) - 1)
                code[rare] -= inner * value
                extra[t, rare] += (value << shift).astype(np.uint32)
            span[rare] = inner
            settle(rare[inner < _LEAST])

    n = lanes
    for t in range(steps):
        if t >= sizes[-1] and n == lanes:  # the last step of the longer blocks
            n = int((sizes > t).sum())
            if not coding:
                guesses.first(n)
        unit = np.floor(span[:n] * (1.0 / _WHOLE))
        if coding:
            i = t % STEPS
            if not i:
                some = places[t : t + STEPS]
                event = some & EVENTS - 1
                number = line[t : t + STEPS].astype(np.int64)
                np.copyto(number, known + 1, where=event >= RARE)
                some_starts, some_shares, some_begins, some_insides = starts.take(some), shares.take(some), head.begin.take(number), head.share.take(number)
                rare = event == RARE
                some_rare = rare.any(axis=1).tolist()
            inner = np.floor(unit * some_shares[i, :n] * (1.0 / (1 << INSIDE_BITS)))
            low[:n] += unit * some_starts[i, :n] + inner * some_begins[i, :n]
            size = inner * some_insides[i, :n]
            here = np.flatnonzero(rare[i, :n]) if some_rare[i] and head.rare else ()
        else:
            guess, context = guesses.asked()
            value = np.minimum(code[:n] / unit, _TOP).astype(np.int64)
            event = events.take((context << EVENT_BITS - 4) + value)
            place = context + event
            inner = np.floor(unit * shares.take(place) * (1.0 / (1 << INSIDE_BITS)))
            rest = code[:n] - unit * starts.take(place)
            slot = np.minimum(rest / inner, (1 << INSIDE_BITS) - 1).astype(np.int64)
            slot += event.astype(np.int64) << INSIDE_BITS
            number = head.slots.take(slot)
            code[:n] = rest - inner * head.begin.take(number)
            now = np.concatenate([number, guess[0], guess[1]], dtype=np.int32, casting="unsafe").take(_MEANT.take(event) * n + lane[:n])
            found[t, :n] = now
            guesses.learn(now, kinds.take(now), guess == now)
            size = inner * head.share.take(number)
            here = np.flatnonzero(event == RARE) if head.rare else ()
        span[:n] = size
        settle(np.flatnonzero(size < _LEAST))
        if len(here):
            rare_ids(t, here)
    if not coding:
        found = np.append(head.ids, 0).astype(np.uint32).take(found)
        return found + extra if head.rare else found, []
    for _ in range(3):
        high = np.floor(low * (1.0 / _LEAST))
        stream[at] = high
        low = (low - high * _LEAST) * _WORD
        at += lanes
    used = at // lanes
    stream = stream.reshape(-1, lanes)[: used.max()]
    for i in range(len(stream) - 1, 0, -1):  # carries go to the left
        stream[i - 1] += stream[i] >> 16
    return found, [row[:end].tobytes() for row, end in zip((stream & 0xFFFF).astype("<u2").T.copy(), used)]


def _sizes(tokens: int) -> np.ndarray:
    lanes = max(1, -(-tokens // BLOCK))
    sizes = np.full(lanes, tokens // lanes, np.int64)
    sizes[: tokens % lanes] += 1
    return sizes


def encode_blocks(ids: np.ndarray) -> tuple[bytes, list[bytes]]:
    """The head of a chunk and its blocks of ids (up to 32 bits); each begins with a checksum of the rest."""
    if not len(ids):
        return b"", []
    head, line = numbered(ids)
    sizes = _sizes(len(ids))
    longer, least = int((sizes > sizes[-1]).sum()), int(sizes[-1])

    def by_step(values: np.ndarray, kind: type) -> np.ndarray:
        table, cut = np.zeros((sizes[0], len(sizes)), kind), longer * int(sizes[0])
        table[:, :longer] = values[:cut].reshape(longer, int(sizes[0])).T
        table[:least, longer:] = values[cut:].reshape(len(sizes) - longer, least).T
        return table

    line = by_step(line, np.uint16)
    places = _places(head, sizes, line)
    head.events = _rough(np.bincount(places[:least].reshape(-1), minlength=CONTEXTS * EVENTS) + np.bincount(places[least:, :longer].reshape(-1), minlength=CONTEXTS * EVENTS))
    coded = _run(head, sizes, line, by_step(ids, np.uint32) if head.rare else None, places, None)[1]
    return head.packed(), [zlib.crc32(data).to_bytes(4, "little") + data for data in coded]


def decode_blocks(head: bytes, blocks: list[bytes], tokens: int) -> np.ndarray:
    """The ids; raises if the head or a block isn't what was written."""
    if not tokens:
        return np.zeros(0, np.uint32)
    sizes = _sizes(tokens)
    if len(sizes) != len(blocks) or any(zlib.crc32(b[4:]) != int.from_bytes(b[:4], "little") for b in blocks):
        raise ValueError("a block is damaged or missing")
    words = np.zeros((len(blocks), max(map(len, blocks)) // 2 + 8), np.uint16)
    for row, data in zip(words, blocks):
        row[: len(data) // 2 - 2] = np.frombuffer(data, "<u2", offset=4)
    found = _run(Head.unpacked(head), sizes, None, None, None, words.T.astype(np.float64, order="C"))[0]
    longer = int((sizes > sizes[-1]).sum())
    return np.concatenate([found[:, :longer].T.reshape(-1), found[: sizes[-1], longer:].T.reshape(-1)])
