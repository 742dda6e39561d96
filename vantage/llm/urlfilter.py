"""URL rules by a cascade of Bloom filters, exact over the corpus's keys and without joins.

Every url yields keys: each suffix of its host that starts at a label, followed by each prefix of
its path as long as some rule's path. A rule fits a url just when the rule's own key is among
them. Level 1 encodes the listed keys; level 2 the keys of the corpus that level 1 lets through by
mistake; level 3 the listed keys that level 2 holds by mistake, and so on until a level makes no
mistake. As all keys of the corpus have been tried, membership is exact for each of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Listed keys are a parameter that the driver holds and broadcasts as bits; more than this is refused.
MAX_RULES = 5_000_000


class Bloom:
    """Bits for a set of strings; ``seed`` makes the levels independent."""

    def __init__(self, keys: Iterable[str], rate: float, seed: int):
        keys = list(keys)
        rate = min(0.5, max(rate, 1e-9))
        self.seed, self.hashes = seed, max(1, round(-math.log2(rate)))
        self.size = max(64, math.ceil(-max(1, len(keys)) * math.log(rate) / math.log(2) ** 2))
        self.bits = np.zeros((self.size + 7) // 8, np.uint8)
        for key in keys:
            for p in self._at(key):
                self.bits[p >> 3] |= 1 << (p & 7)

    def _at(self, key: str) -> Iterator[int]:
        h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), self.seed)
        a, b = h & (2**64 - 1), (h >> 64) | 1
        return ((a + i * b) % self.size for i in range(self.hashes))

    def __contains__(self, key: str) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._at(key))


class Cascade:
    """Levels of Bloom filters; a key is listed if the first level without it is an even one (from 1)."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def __contains__(self, key: str) -> bool:
        for n, level in enumerate(self.levels):
            if key not in level:
                return n % 2 == 1
        return len(self.levels) % 2 == 1


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or where there is no ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys of a url, no order: host suffixes at labels, each with the path's prefixes of the rules' lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_compact(F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]))
    return F.when(host != "", F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))).otherwise(F.array().cast("array<string>"))


def build_cascade(universe: DataFrame, listed: list[str], size: int) -> Cascade:
    """``universe``: a column ``key`` with every key of the corpus, ``size`` of them.

    The first rate leaves about 0.7 mistakes for each listed key, whatever the corpus holds, so
    what comes to the driver and is broadcast later is bounded by the list (times the logarithm
    of the corpus for the bits). All later mistakes are among those found in this one pass.
    """
    if len(listed) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} listed keys")
    own, rate, bound = set(listed), math.sqrt(0.5) * max(1, len(listed)) / max(1, size), 8 * len(listed) + 1000
    for seed in range(0, 1000, 100):
        first = Bloom(listed, rate, seed)
        shared = universe.sparkSession.sparkContext.broadcast((first, own))

        def mistaken(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            level, listed_keys = shared.value
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"key": [k for k in batch.column(0).to_pylist() if k not in listed_keys and k in level]}, pa.schema([("key", pa.string())]))

        found = [r.key for r in universe.select("key").mapInArrow(mistaken, "key string").limit(bound + 1).collect()]
        if len(found) <= bound:  # else very unlucky: another seed
            break
        rate /= 4
    else:
        raise RuntimeError("the first level keeps too many other keys")
    levels, inside, outside = [first], own, set(found)
    while outside:
        levels.append(Bloom(outside, 0.5, seed + len(levels)))
        inside, outside = outside, {k for k in inside if k in levels[-1]}
    return Cascade(levels)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", url: str = "url") -> DataFrame:
    """The rows of ``pages`` with host, path, rule (its key or null) and verdict.

    ``rules``: (action, host, path), action allow or block. A rule fits its host and all
    subdomains if the path starts with the rule's; the longest key wins, then the longer host.
    A url that no rule fits gets ``default``. Null and malformed urls have an empty host, which
    no rule fits. Columns of ``pages`` with the result's names are replaced.
    """
    host, path = host_and_path(F.col(url))
    lengths = sorted({len(p) for _, _, p in rules})
    kept = pages.drop(*[c for c in ("host", "path", "rule", "verdict", "_keys") if c != url])
    parsed = kept.withColumns({"host": host, "path": path})
    keyed = parsed.withColumn("_keys", url_keys(F.col("host"), F.col("path"), lengths))
    universe = keyed.select(F.explode("_keys").alias("key")).distinct()
    size = universe.agg(F.count(F.lit(1))).first()[0]
    lists = {action: [h + p for a, h, p in rules if a == action] for action in ("allow", "block")}
    cascades = {action: build_cascade(universe, keys, size) for action, keys in lists.items()}
    shared = pages.sparkSession.sparkContext.broadcast(cascades)
    out = keyed.drop("_keys").schema.add("rule", "string").add("verdict", "string")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = shared.value
        known: dict[str, str | None] = {}  # of this task's keys; hosts and short prefixes repeat
        for batch in batches:
            found = []
            for keys in batch.column("_keys").to_pylist():
                best = None
                for key in keys:
                    if key not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[key] = next((a for a in ("block", "allow") if key in by[a]), None)
                    if known[key] and (best is None or (len(key), key.find("/")) > (len(best[0]), best[0].find("/"))):
                        best = key, known[key]
                found.append(best or (None, default))
            kept = [c for c in batch.schema.names if c != "_keys"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=[*kept, "rule", "verdict"]
            )

    return keyed.mapInArrow(judged, out)
