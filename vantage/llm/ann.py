"""Approximate nearest neighbours along shifted space-filling curves.

Vectors are projected to a few dimensions, several times, shifted, and ordered along a Hilbert
curve each time. Spark ranges the vectors by their place on each curve; a query looks at the
places around its own on all curves, and the best of all windows are merged. The window is as wide
as a sample of queries with known neighbours needs. On vectors without structure, whose neighbours
lie together in no direction, windows are wide; where they would ask for more than a stated number of
comparisons the search says so instead of starting. One curve can be searched whole, if that is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.llm.common import kept

DIMS, BITS = 4, 8
#: Vectors of a curve that one task holds, and queries, neighbours on the curve, that it compares with them.
BLOCK_ROWS, QUERY_ROWS = 8192, 16384
#: Queries compared with all vectors to choose the window.
SAMPLE = 48


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, dims) of ``bits`` bits, after Skilling."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | x[i] >> b & 1
    return key


def curve_keys(vectors: np.ndarray, curve: int) -> np.ndarray:
    """Keys on one curve: unit vectors, a random projection, a shift and a grid fixed by the curve's number."""
    size = vectors.shape[1]
    rng = np.random.default_rng(1000 + curve)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    flat = unit @ np.linalg.qr(rng.standard_normal((max(size, DIMS), DIMS)))[0][:size] * np.sqrt(size) / 3
    return hilbert_keys(np.clip((flat + 1 + rng.uniform(0, 0.25, DIMS)) / 2.25 * (1 << BITS), 0, (1 << BITS) - 1), BITS)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    if not len(column):
        return np.zeros((0, 1))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row; of those tied with the last the first ones, so columns come by rising id."""
    if scores.shape[1] <= k:
        return np.isfinite(scores)
    least = np.partition(scores, -k, axis=1)[:, -k:].min(1)
    chosen = (scores >= least[:, None]) & np.isfinite(scores)
    over = np.flatnonzero(chosen.sum(1) > k)
    if len(over):
        tied = chosen[over] & (scores[over] == least[over, None])
        room = k - (chosen[over].sum(1) - tied.sum(1))
        chosen[over] &= ~tied | (np.cumsum(tied, axis=1) <= room[:, None])
    return chosen


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector that isn't null or zero, has no null or non-finite component, and the most usual length (of several the smallest).

    Inner products need equal lengths, so vectors of other lengths have neither neighbours nor a place.
    """
    v = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.where(v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size(v) == (sizes.n if sizes else 0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, curves: int = 4, recall: float = 0.95, exact: bool = False, max_pairs: int = 10**14, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best by inner product, ties to the smaller id.

    An id is one vector: of rows with one id the smallest usable vector (as arrays are ordered)
    counts, and it asks if any of them does. Rows with a null id, or with a vector that is not
    usable (see there), neither ask nor answer. Equal vectors of several ids are searched once: each
    stands for its k + 1 smallest ids. ``recall`` is what the sample of queries must reach;
    ``exact``: one curve is searched whole in blocks, so every query meets every vector. More than
    ``max_pairs`` comparisons raise an error with the figures before any is made. Other columns are
    not read. An empty or unusable table gives no rows.
    """
    rows = usable(vectors.select(F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector).alias("v")).where("id IS NOT NULL"), "v")
    rows = kept(rows.groupBy("id").agg(F.min("v").alias("v"), F.bool_or("asks").alias("asks")))
    by_vector = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    points = kept(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("vid", F.element_at("ids", 1)))
    # a vector that many ask for is split by Spark: nothing follows the join in its stage
    asked = kept(rows.where("asks").select(F.col("id").alias("query_id"), "v").join(points.select("v", "vid"), "v").select("query_id", "vid"))
    total = points.count()
    asking = asked.select("vid").distinct()
    curves = 1 if exact else curves
    places = _places(points.join(asking.withColumn("asks", F.lit(True)), "vid", "left").withColumn("asks", F.coalesce("asks", F.lit(False))), curves)
    window = total if exact else _window(points, places, asking, k, curves, recall, total)
    pairs = asking.count() * min(2 * window, total) * curves
    if pairs > max_pairs:
        raise ValueError(f"windows of {2 * window} of {total} vectors on {curves} curves need {pairs} comparisons, more than {max_pairs}")
    reach, held = _tasks(places, window, total)

    def search(table: pa.Table) -> pa.Table:
        queries, block = table.filter(table.column("asks")), table.filter(pc.invert(table.column("asks"))).sort_by("vid")
        found = []
        if queries.num_rows and block.num_rows:
            x, ids, at = _matrix(block.column("v")), block.column("vid").to_numpy(), block.column("place").to_numpy()
            everyone, ask, where = _matrix(queries.column("v")), queries.column("vid").to_numpy(), queries.column("place").to_numpy()
            for i in range(0, len(everyone), 256):
                scores = everyone[i : i + 256] @ x.T
                scores[np.abs(where[i : i + 256, None] - at[None, :]) > window] = -np.inf
                p, q = np.nonzero(_best(scores, k + 1))
                found.append((ask[i + p], ids[q], scores[p, q]))
        columns = [np.concatenate(c) for c in zip(*found)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query": pa.array(columns[0], pa.int64()), "vid": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    hits = reach.unionByName(held).groupBy("curve", "part", "block").applyInArrow(search, "query long, vid long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vid")
    merged = hits.groupBy("query", "vid").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    named = merged.join(points.select("vid", "ids"), "vid").select("query", "score", F.explode("ids").alias("vec_id"))
    listed = named.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("found"))
    listed = kept(listed.select("query", F.slice("found", 1, k + 1).alias("found")))  # one may be the query itself
    others = F.slice(F.filter("found", lambda x: x.vec_id != F.col("query_id")), 1, k)
    ranked = asked.join(listed, asked.vid == listed["query"]).select("query_id", F.posexplode(others).alias("at", "one"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), "one.vec_id", (-F.col("one.far")).alias("score"))


def _tasks(places: DataFrame, window: int, total: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the tasks (curve, part, block): queries, and vectors.

    A part is QUERY_ROWS queries that follow each other on the curve; it meets the blocks of
    BLOCK_ROWS vectors that the windows of its first and last query reach.
    """
    own = places.where("asks").withColumn("part", F.floor(F.col("turn") / QUERY_ROWS))
    block = lambda x: F.floor(x / BLOCK_ROWS)
    span = F.sequence(block(F.greatest(F.min("place") - window, F.lit(0))), block(F.least(F.max("place") + window, F.lit(max(0, total - 1)))))
    meets = own.groupBy("curve", "part").agg(span.alias("blocks")).select("curve", "part", F.explode("blocks").alias("block"))
    queries = own.join(meets, ["curve", "part"])
    vectors = places.withColumn("block", block(F.col("place"))).join(meets, ["curve", "block"])
    columns = ["curve", "part", "block", "vid", "place", "v"]
    return queries.select(*columns, F.lit(True).alias("asks")), vectors.select(*columns, F.lit(False).alias("asks"))


def _places(points: DataFrame, curves: int) -> DataFrame:
    """curve, place (rank from 0 along it), turn (rank among those that ask), vid, v, asks: by counts of sorted ranges and ranks within them.

    Ranges hold about as many rows each, whatever the keys; what comes to the driver has a row for
    each range.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(curve_keys(x, c)), *batch.columns], names=["curve", "key", "vid", "v", "asks"])

    kind = points.schema["v"].dataType.simpleString()
    keys = points.select("vid", "v", "asks").mapInArrow(keyed, f"curve int, key long, vid long, v {kind}, asks boolean")
    line = kept(keys.repartitionByRange("curve", "key", "vid").sortWithinPartitions("curve", "key", "vid"))
    counts = line.groupBy("curve", F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asked"))
    firsts: dict[tuple[int, int], tuple[int, int]] = {}
    sums: dict[int, tuple[int, int]] = {}
    for r in sorted(counts.collect()):  # a row for each curve in a partition
        firsts[r.curve, r.part] = sums.get(r.curve, (0, 0))
        sums[r.curve] = firsts[r.curve, r.part][0] + r.n, firsts[r.curve, r.part][1] + r.asked
    shared = points.sparkSession.sparkContext.broadcast(firsts)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), {}
        for batch in batches:
            curve, asks = batch.column(0).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
            cut = np.flatnonzero(np.r_[True, curve[1:] != curve[:-1]]) if len(curve) else []
            for a, b in zip(cut, [*cut[1:], len(curve)]):
                place, turn = at.get(curve[a]) or shared.value[int(curve[a]), part]
                turns = turn + np.cumsum(asks[a:b])
                at[curve[a]] = place + b - a, int(turns[-1])
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(np.arange(place, place + b - a)), pa.array(turns - 1), own.column(2), own.column(3), own.column(4)], names=["curve", "place", "turn", "vid", "v", "asks"])

    return kept(line.mapInArrow(ranked, f"curve int, place long, turn long, vid long, v {kind}, asks boolean"))


def _window(points: DataFrame, places: DataFrame, asking: DataFrame, k: int, curves: int, recall: float, total: int) -> int:
    """The half width that gives a sample of queries ``recall`` of their true neighbours."""
    chosen = points.join(asking, "vid", "left_semi").orderBy(F.xxhash64("vid")).limit(SAMPLE).select("vid", "v").toPandas()
    if chosen.empty:
        return total
    shared = points.sparkSession.sparkContext.broadcast((chosen["vid"].to_numpy(), np.array(chosen["v"].tolist(), np.float64)))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, q = shared.value
        for batch in batches:
            if batch.num_rows:
                batch = batch.sort_by("vid")
                scores = q @ _matrix(batch.column(1)).T
                a, b = np.nonzero(_best(scores, k + 1))
                yield pa.RecordBatch.from_arrays([pa.array(ask[a]), pa.array(batch.column(0).to_numpy(zero_copy_only=False)[b]), pa.array(scores[a, b])], names=["query", "vid", "score"])

    best = Window.partitionBy("query").orderBy(F.desc("score"), "vid")
    true = points.select("vid", "v").mapInArrow(exact, "query long, vid long, score double").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    at = places.select("curve", "place", "vid")
    asks = at.join(true.select(F.col("query").alias("vid")).distinct(), "vid").select(F.col("vid").alias("query"), "curve", F.col("place").alias("from"))
    gaps = true.where("vid <> query").join(at, "vid").join(asks, ["query", "curve"]).groupBy("query", "vid").agg(F.min(F.abs(F.col("place") - F.col("from"))).alias("gap"))
    needed = gaps.select("gap").toPandas()["gap"].to_numpy()
    return int(np.ceil(np.quantile(needed, recall) * 1.02)) + k if len(needed) else total
