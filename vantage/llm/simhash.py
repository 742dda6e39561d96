"""Near duplicates by SimHash fingerprints, found in a grid of segment popcounts.

A fingerprint is cut into segments and mapped to their counts of set bits. Two fingerprints differ
in at least as many bits as the Manhattan distance of their counts, so those within the distance
lie in near cells of the integer grid. Each fingerprint goes to its own cell and the next ones, so
that any two within the range meet in one; within a cell the exact distance decides. A cell gives
no list of its pairs but the edges that join its linked members, so large groups stay small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import U64, kept, mixed
from vantage.llm.components import connected_components

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
#: Cell entries that one task takes, about; and members of a cell that are compared at once.
BUCKET_ENTRIES, BLOCK = 2_000_000, 1024
#: Least Jaccard similarity of sets of shingles that counts as a near copy.
SIMILAR = 0.8
#: Smallest shingle hashes that are cells, at most; those that the bit set of parities is of, its
#: 64-bit words, and the bits that may differ.
TOKENS, SKETCH, SKETCH_WORDS, SKETCH_RADIUS = 20, 64, 4, 56
#: A set's size as an entry carries it, in the low bits of its cell's code: from 511 on the bits that may differ depend on it no more.
SIZE_BITS = 9


def shingles(text: str | None, size: int) -> list[bytes]:
    """Lower-cased (A-Z) shingles of words, repeats included; fewer words give the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    line, begins = b" ".join(words), [0, *accumulate(len(w) + 1 for w in words)]
    return [line[a : b - 1] for a, b in zip(begins, begins[size:])]


def simhashes(lists: list[list[bytes]], seed: int) -> np.ndarray:
    """A 64-bit fingerprint of each list: bits set in more than half its XXH64 hashes; empty: 0."""
    sizes = np.array([len(x) for x in lists], np.int64)
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, seed) for x in lists for s in x]), np.uint8).reshape(-1, 8)
    row = np.repeat(np.arange(len(lists)) * 256, sizes)
    out = np.zeros(len(lists), U64)
    for lane in range(8):  # the digest's first byte is the highest
        votes = np.bincount(row + hashes[:, lane], minlength=256 * len(lists)).reshape(-1, 256) @ _BITS
        out |= np.packbits(votes * 2 > sizes[:, None], axis=1, bitorder="little")[:, 0].astype(U64) << U64(8 * (7 - lane))
    return out


def fingerprints(docs: DataFrame, words: int = 3, seeds: tuple[int, ...] = (42,), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, fp0 (and fp1, .. for more seeds, as signed longs) and n_shingles of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                lists = [shingles(t, words) for t in part.column(1).to_pylist()]
                columns = [part.column(0), *(pa.array(simhashes(lists, s).view(np.int64)) for s in seeds), pa.array([len(x) for x in lists], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", *(f"fp{i}" for i in range(len(seeds))), "n_shingles"]
    schema = ", ".join(["doc_id long", *(f"fp{i} long" for i in range(len(seeds))), "n_shingles long"])
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(of, schema)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The different hashes of a text's shingles, increasing."""
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(s, 42) for s in shingles(text, words)]), ">u8")).astype(U64)


def sketch(hashes: np.ndarray, least: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a set, and the parities (SKETCH_WORDS) of its smallest SKETCH hashes by their last bits.

    Of two sets that are similar, the first size - ceil(least * size) + 1 hashes of each share one.
    So do the first TOKENS of larger sets, except for a chance of (1 - least) ** TOKENS, 1e-14.
    """
    n = len(hashes)
    cells = hashes[: min(TOKENS, n - int(np.ceil(least * n - 1e-9)) + 1)] if n else hashes
    parity = np.bincount((hashes[:SKETCH] & U64(64 * SKETCH_WORDS - 1)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return cells, np.packbits(parity.astype(np.uint8), bitorder="little").view(U64)


def sketches(docs: DataFrame, words: int, least: float) -> DataFrame:
    """key, twin, shingle_key (a hash of the set of shingles), n_shingles, cells, print (the SimHash of its three-word shingles) and fp0, fp1, .. (see ``sketch``) of every row (key, twin, text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = [shingle_hashes(t, words) for t in part.column(2).to_pylist()]
                found = [sketch(x, least) for x in sets]
                prints = np.stack([f for _, f in found]).view(np.int64)
                columns = [
                    part.column(0),
                    part.column(1),
                    pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([c.tobytes() for c, _ in found], pa.binary()),
                    pa.array(simhashes([shingles(t, 3) for t in part.column(2).to_pylist()], 42).view(np.int64)),
                    *(pa.array(np.ascontiguousarray(prints[:, i])) for i in range(SKETCH_WORDS)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    prints = [f"fp{i}" for i in range(SKETCH_WORDS)]
    names = ["key", "twin", "shingle_key", "n_shingles", "cells", "print", *prints]
    schema = "key long, twin long, shingle_key binary, n_shingles long, cells binary, print long, " + ", ".join(f"{c} long" for c in prints)
    return docs.select("key", "twin", "text").mapInArrow(of, schema)


def cell_codes(words: np.ndarray, groups: int, segment_bits: int, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells of fingerprints (n, words): arrays (row, code).

    The fingerprint's bits are dealt to ``groups``; each has a grid of its own. Reach 1 adds the
    cells one count up: cells at Manhattan distance up to 1 share one. Reach 2 adds those one
    count down as well, so that cells at distance 2 share the one between.
    """
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
    segments = bits.shape[1] // segment_bits // groups
    counts = bits.reshape(len(words), groups, segments, segment_bits).sum(3, dtype=np.uint8)
    rows = np.arange(len(words))
    for g in range(groups):
        grid = U64((g + 1) * 0x9E3779B97F4A7C15 % 2**64)
        steps = [None, *((i, d) for i in range(segments) for d in ((1,) if reach == 1 else (1, -1)) if reach)]
        for step in steps:
            if step is None:
                values, chosen = counts[:, g], rows
            else:
                i, d = step
                chosen = np.flatnonzero(counts[:, g, i] < segment_bits if d > 0 else counts[:, g, i] > 0)
                values = counts[chosen, g].copy()
                values[:, i] = values[:, i] + 1 if d > 0 else values[:, i] - 1
            yield chosen, _coded(values) ^ grid


_MULTIPLIERS = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def _coded(values: np.ndarray) -> np.ndarray:
    """One 64-bit code of each row of counts (a random linear sum, mixed)."""
    out = values.astype(U64) @ _MULTIPLIERS[: values.shape[1]]
    return (out ^ (out >> U64(29))) * U64(0xBF58476D1CE4E5B9)


@cache
def _apart(radius: int) -> np.ndarray:
    """How many parities of sketches may differ, by the sizes of two sets that are SIMILAR; -1 where none can be.

    Sets of a and b hashes that are similar share at least SIMILAR / (1 + SIMILAR) of a + b. Sketches
    of whole sets differ by the rest at most; of the others, by twice what the larger set has alone:
    the sketch that ends first misses in the other only what that set does not have at all.
    """
    a, b = np.meshgrid(*[np.arange(1 << SIZE_BITS)] * 2)
    most, both = np.maximum(a, b), a + b
    alone = both * ((1 - SIMILAR) / (1 + SIMILAR)) + np.where(most <= SKETCH, 0, 2 * most - both)
    return np.where(np.minimum(a, b) < SIMILAR * most - 1e-9, -1, np.minimum(radius, np.floor(alone + 1e-9))).astype(np.int16)


def linked_in_cells(cells: np.ndarray, words: np.ndarray, radius: int, sizes_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, row) that join what is linked within cells, few for each member.

    ``cells`` is sorted. Small cells give their pairs within ``radius``, or less where ``sizes_of`` the
    sets (up to 511) allow less; those of large cells are compared in blocks and only edges that join
    separate parts are returned.
    """
    allowed = _apart(radius) if sizes_of is not None else None
    bounds = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True]) if len(cells) else np.zeros(1, np.int64)
    sizes = np.diff(bounds)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    small, step = bounds[:-1][(sizes > 1) & (sizes <= 32)], 1
    ends = bounds[1:][(sizes > 1) & (sizes <= 32)]
    left = np.concatenate([np.arange(a, b) for a, b in zip(small, ends)]) if len(small) else np.zeros(0, np.int64)
    last = np.repeat(ends, ends - small)
    while len(left):
        alive = left + step < last
        left, last = left[alive], last[alive]
        most = radius if allowed is None else allowed[sizes_of[left], sizes_of[left + step]]
        near = np.bitwise_count(words[left] ^ words[left + step]).sum(1, dtype=np.int64) <= most
        found.append((left[near], left[near] + step))
        step += 1
    for a, n in zip(bounds[:-1][sizes > 32], sizes[sizes > 32]):
        parts = np.arange(n)
        for i in range(0, n, BLOCK):
            edges = []
            for j in range(i, n, BLOCK):
                own, other = slice(i, min(i + BLOCK, n)), slice(j, min(j + BLOCK, n))
                if (parts[own] == parts[i]).all() and (parts[other] == parts[i]).all():
                    continue  # all are joined
                x, y = words[a + i : a + own.stop], words[a + j : a + other.stop]
                apart = sum(np.bitwise_count(x[:, None, w] ^ y[None, :, w]).astype(np.int16) for w in range(words.shape[1]))
                p, q = np.nonzero(apart <= (radius if allowed is None else allowed[sizes_of[a + i : a + own.stop, None], sizes_of[None, a + j : a + other.stop]]))
                edges.append((p + i, q + j))
                if j == i or len(p) > 4 * BLOCK:
                    parts = joined(n, *(np.concatenate(e) for e in zip((np.arange(n), parts), *edges)))
                    edges = []
            if edges:
                parts = joined(n, *(np.concatenate(e) for e in zip((np.arange(n), parts), *edges)))
        at = np.flatnonzero(parts != np.arange(n))
        found.append((a + at, a + parts[at]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def joined(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest member that each of ``n`` is joined to by edges."""
    parts = np.arange(n)
    while len(p):
        u, v = parts[p], parts[q]
        p, q = p[u != v], q[u != v]
        if len(p):
            u, v = parts[p], parts[q]
            np.minimum.at(parts, np.maximum(u, v), np.minimum(u, v))
            while (parts[parts] != parts).any():
                parts = parts[parts]
    return parts


def joined_table(a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Edges (a, b) from each node to the smallest it is joined to, one at most for each."""
    ids, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    parts = joined(len(ids), which[: len(a)], which[len(a) :])
    at = np.flatnonzero(parts != np.arange(len(ids)))
    return pa.table({"a": pa.array(ids[at], pa.int64()), "b": pa.array(ids[parts[at]], pa.int64())})


def grid_links(nodes: DataFrame, radius: int, groups: int = 1, segment_bits: int = 2, reach: int = 2) -> DataFrame:
    """Edges (a, b) between nodes whose fingerprints are within ``radius`` bits and whose cells meet.

    ``nodes``: node (long) and fp0, fp1, .. (long), one row each. Nodes that bring their own cells
    (binary, of 64 bits each) and n_shingles meet in these instead of the grid's, and only those
    whose numbers of shingles have a ratio of 0.8 or more and whose parities are as near as these numbers ask for are linked. With one group and reach 2 every
    pair within two bits is found. The edges join all that is linked in a cell, and are at most as
    many as its members; unions of them have the links' components. Entries are packed by buckets
    of cells, as many as the nodes ask for.
    """
    names = [c for c in nodes.columns if c.startswith("fp")]
    n, total, own = len(names), nodes.count(), "cells" in nodes.columns
    each = 2 * TOKENS if own else groups * (1 + reach * (64 * n // groups // segment_bits))
    buckets = max(16, -(-total * each // BUCKET_ENTRIES))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 20_000):
                batch = whole.slice(start, 20_000)
                node = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                words = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False).astype(np.int64).view(U64) for i in range(n)], axis=1)
                if own:
                    held = batch.column(2 + n).to_pylist()
                    rows, codes = np.repeat(np.arange(len(held)), [len(x) // 8 for x in held]), mixed(np.frombuffer(b"".join(held), U64))
                else:
                    rows, codes = map(np.concatenate, zip(*cell_codes(words, groups, segment_bits, reach)))
                if own:  # a class of sizes goes up to twice its least; a size whose partners may be larger visits the next
                    size = np.maximum(batch.column(1 + n).to_numpy(zero_copy_only=False), 1).astype(np.float64)
                    kind = np.floor(np.log2(size) + 1e-12)
                    above = (np.floor(np.log2(size / SIMILAR) + 1e-9) > kind)[rows]
                    kind = kind.astype(np.int64).view(U64)[rows]
                    codes = np.concatenate([codes + kind * U64(0xD1342543DE82EF95), (codes + (kind + U64(1)) * U64(0xD1342543DE82EF95))[above]])
                    rows = np.concatenate([rows, rows[above]])
                    codes = codes >> U64(SIZE_BITS) << U64(SIZE_BITS) | np.minimum(size, (1 << SIZE_BITS) - 1).astype(U64)[rows]
                if not len(rows):
                    continue
                bucket = (codes >> U64(32)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                rows, codes, bucket = rows[order], codes[order], bucket[order]
                cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
                packed = [np.concatenate([codes[a:b, None], node[rows[a:b], None].view(U64), words[rows[a:b]]], axis=1).tobytes() for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]]), pa.array(packed, pa.binary())], names=["bucket", "entries"])

    def linked(group: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x, U64).reshape(-1, n + 2) for x in group.column("entries").to_pylist()])
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        cells = rows[:, 0] >> U64(SIZE_BITS if own else 0)
        alone = np.r_[True, cells[1:] != cells[:-1]] & np.r_[cells[1:] != cells[:-1], True]
        rows, cells = rows[~alone], cells[~alone]
        sizes = (rows[:, 0] & U64((1 << SIZE_BITS) - 1)).astype(np.int64) if own else None
        p, q = linked_in_cells(cells, rows[:, 2:], radius, sizes)
        ids = rows[:, 1].view(np.int64)
        return joined_table(ids[p], ids[q])

    entries = nodes.select("node", *names, *(["n_shingles", "cells"] if own else [])).mapInArrow(spread, "bucket long, entries binary")
    return entries.groupBy("bucket").applyInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's doc_id, fingerprint (hex) and component_id, the smallest doc_id reachable by links.

    Fingerprints link at up to two differing bits (``radius`` may be 0 to 2), and equal ones always.
    A text without words (also null) has fingerprint zero and links like any other. Null doc_ids
    take part but never name a component, unless all of it have none (then null).
    """
    if not 0 <= radius <= 2:
        raise ValueError("the one-group grid covers up to two bits")
    prints = kept(fingerprints(docs, words, key=key, text=text).select("doc_id", F.col("fp0")))
    distinct = kept(prints.groupBy("fp0").agg(F.min("doc_id").alias("least")))
    nodes = distinct.select(F.col("fp0").alias("node"), "fp0")
    roots = connected_components(grid_links(nodes, radius))
    named = distinct.join(roots, distinct.fp0 == roots.node, "left").select("fp0", "least", F.coalesce("root", "fp0").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return (
        prints.join(named.select("fp0", "root").join(smallest, "root").select("fp0", "component_id"), "fp0")
        .select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")
    )


def similar_pairs(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked by pairs of sorted sets of numbers with a Jaccard similarity of ``least`` or more.

    Only numbers of two sets or more can be shared; those make a matrix of bits, row against rows.
    Rows that are joined already are not compared again.
    """
    sizes = np.array([len(x) for x in sets])
    values, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(counts > 1) - 1
    width = int(place[-1]) + 1 if len(values) else 0
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[which] > 1
    bits = np.zeros((len(sets), -(-max(1, width) // 64)), U64)
    np.bitwise_or.at(bits, (row[shared], place[which[shared]] >> 6), U64(1) << (place[which[shared]] & 63).astype(U64))
    part = np.arange(len(sets))
    p, q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(sets) - 1):
        open_rows = i + 1 + np.flatnonzero(part[i + 1 :] != part[i])
        if not len(open_rows):
            continue
        both = np.concatenate([np.bitwise_count(bits[i] & bits[open_rows[a : a + 64]]).sum(1, dtype=np.int64) for a in range(0, len(open_rows), 64)])
        near = open_rows[both >= least * (sizes[i] + sizes[open_rows] - both) - 1e-9]
        if len(near):
            p.append(np.full(len(near), i))
            q.append(near)
            merged = np.unique(part[near])
            part[np.isin(part, merged)] = part[i]
    return np.concatenate(p), np.concatenate(q)


#: Members of a candidate group that one task compares with as many others.
GROUP = 1024


def _verified(rows: DataFrame, members: DataFrame, words: int, least: float) -> DataFrame:
    """Edges (a, b) of nodes of one candidate group whose shingle sets are similar.

    ``rows``: key, twin, text. ``members``: node, root, n_shingles, and the key and twin of its text. Groups of up to GROUP members are compared whole, several in a task.
    Of a larger one only sets of like sizes meet, as no others can be similar: it becomes a group for each class of sizes, and one that is still larger is cut into parts, and each two parts are compared in a task of their own. Texts travel, and sets of hashes, which
    are larger, are made where they are compared.
    """
    wanted = rows.join(members.select("node", "key", "twin"), ["key", "twin"]).select("node", "text").dropDuplicates(["node"])
    tasks = max(16, members.count() // GROUP)
    sizes, step = members.groupBy("root").agg(F.count(F.lit(1)).alias("n")), float(np.log(1 / least))
    level = F.log(F.greatest("n_shingles", F.lit(1))) / step
    classes = F.sequence(F.floor(level - 1e-9), F.floor(level + 1 + 1e-9))  # its own, and that of the largest set it can be similar to
    classed = members.join(sizes, "root").select("node", "root", "n", F.explode(F.when(F.col("n") > GROUP, classes).otherwise(F.array(F.lit(-1).cast("long")))).alias("class"))
    members = classed.withColumn("root", F.when(F.col("n") > GROUP, F.xxhash64("root", "class")).otherwise(F.col("root"))).drop("n", "class")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / GROUP)
    placed = (
        members.join(sizes, "root")
        .withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), parts))
        .withColumn("other", F.explode(F.when(parts == 1, F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), parts - 1))))
        .select("node", "root", F.when(F.col("other") < 0, F.pmod("root", F.lit(tasks))).otherwise(F.col("root")).alias("task"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    )

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("root")
        roots, nodes = table.column("root").to_numpy(), table.column("node").to_numpy()
        held = [shingle_hashes(t, words) for t in table.column("text").to_pylist()]
        cut = np.flatnonzero(np.r_[True, roots[1:] != roots[:-1], True])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y in zip(cut, cut[1:]):
            p, q = similar_pairs(held[x:y], least)
            a.append(nodes[x + p])
            b.append(nodes[x + q])
        return joined_table(np.concatenate(a), np.concatenate(b))

    met = placed.join(wanted, "node").select("node", "root", "task", "i", "j", "text")
    return met.groupBy("task", "i", "j").applyInArrow(compare, "a long, b long")


def _fingerprint_links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that join nodes (node, print) whose fingerprints are at most two bits apart."""
    distinct = kept(nodes.groupBy("print").agg(F.min("node").alias("least")))
    equal = nodes.select("node", "print").join(distinct, "print").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    apart = grid_links(distinct.select(F.col("print").alias("node"), F.col("print").alias("fp0")), 2)  # a node that is its print packs well
    named = apart
    for end in "ab":
        named = named.join(distinct.select(F.col("print").alias(end), F.col("least").alias(f"{end}_node")), end)
    return equal.unionByName(named.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))


def drop_near_copies(docs: DataFrame, words: int = 5, least: float = SIMILAR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` less near copies: of each group the one with the smallest id stays.

    Texts are near copies if their sets of five-word shingles have a Jaccard similarity of
    ``least`` or more, and so are those linked through others. Candidates have SimHash fingerprints
    at most two bits apart, as ``near_duplicates`` links them, or share one of the smallest hashes of their sets: as many as make it certain, or leave a chance of 1e-14 to miss (see
    ``sketch``). Of the parities of their SKETCH smallest hashes SKETCH_RADIUS may differ: nothing
    is missed by that among sets of up to SKETCH shingles; for larger ones at a similarity of 0.8
    the bound lies 6 standard deviations above the mean. Where the sizes of two sets let fewer differ
    (see ``_apart``), that bound holds, so a line that many short texts share makes no candidates of them. Candidates are verified on the whole sets.
    Equal sets (so equal texts, and all texts without words, null ones too) are copies; rows without
    an id lose to those with one. Different texts under one id are judged like any others; of rows
    equal in id and text one stays, chosen by a hash of all its columns. Columns stay as they are,
    whatever their names; a table without rows gives none.
    """
    keyed = F.coalesce(F.col(key).cast("long"), F.shiftrightunsigned(F.xxhash64(text), 2) + F.lit(1 << 62)), F.xxhash64(text)
    rows = docs.select(F.struct(*docs.columns).alias("row"), keyed[0].alias("key"), keyed[1].alias("twin"))
    texts = docs.select(keyed[0].alias("key"), keyed[1].alias("twin"), F.col(text).alias("text"))
    prints = kept(sketches(texts, words, least))
    sketched = [c for c in prints.columns if c not in ("key", "twin", "shingle_key", "print")]
    nodes = prints.groupBy("shingle_key").agg(F.min(F.struct("key", "twin")).alias("best"), F.min("print").alias("print"), *(F.first(c).alias(c) for c in sketched))
    nodes = kept(nodes.withColumn("node", F.monotonically_increasing_id()))
    alike = grid_links(nodes.drop("print"), SKETCH_RADIUS).unionByName(_fingerprint_links(nodes))
    roots = connected_components(alike)
    members = kept(roots.join(nodes.select("node", "best.key", "best.twin", "n_shingles"), "node"))
    verified = connected_components(_verified(texts, members, words, least))
    named = nodes.join(verified, "node", "left").select("shingle_key", "best", F.coalesce("root", "node").alias("root"))
    winners = named.groupBy("root").agg(F.min("best").alias("winner"))
    losing = named.join(winners, "root").select("shingle_key", "winner")
    lost = prints.join(losing, "shingle_key").where("struct(key, twin) <> winner").select("key", "twin").distinct()
    left = rows.join(lost, ["key", "twin"], "left_anti")
    if prints.count() > prints.select("key", "twin").distinct().count():
        left = left.groupBy("key", "twin").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return left.select("row.*")
