"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: terms (words and their first letters) that toxic documents have far more
often than others; texts that trees are fitted on are described by terms learned without them. Features are counts and densities of its terms, how near they are to words for
"you", and rates of capitals, marks and obfuscation. Spark's trees are fitted on one part of the
labelled documents and calibrated on the other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import kept, sample_hash, sample_limit, sampled

# Words for "you" and "your" in some languages.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer usted ustedes ti tus su vosotros".split())
# Marks and digits that stand for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e"})
_TOKEN = re.compile(r"\S+")
_EDGE = ".,;:!?\"'()[]{}<>|«»„“”‘’…*&%#~_-"
PREFIXES = (5, 7)
#: Parts of the labelled texts: the first calibrates, trees are fitted on the others.
PARTS = 4
FEATURES = [
    "lexicon_hits", "lexicon_density", "lexicon_distinct", "weight_sum", "weight_density", "weight_max", "stem_hits", "stem_density", "stem_weight",
    "near_you", "you_density", "capitals", "shouted", "marks", "exclaims", "obfuscated", "obfuscated_hits", "repeated", "log_words", "mean_length",
]


def tokens(text: str) -> list[tuple[str, str, bool]]:
    """Each token as written without marks at its ends, its plain form, and whether that undid a disguise."""
    out = []
    for raw in _TOKEN.findall(text):
        bare = raw.strip(_EDGE)
        low = bare.lower()
        if low.isalpha() or not low:
            out.append((bare, low, False))
        else:
            plain = "".join(c for c in low.translate(LOOKALIKES) if c.isalpha())
            out.append((bare, plain, bool(plain) and plain != low))
    return out


def terms(words: Iterator[str]) -> set[str]:
    """Different words, and for long ones their first letters with a mark."""
    own = {w for w in words if len(w) > 1}
    return own | {f"{w[:n]}^" for w in own for n in PREFIXES if len(w) > n}


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: GBTClassificationModel
    isotonic: IsotonicRegressionModel


def _near(places: np.ndarray, others: np.ndarray, reach: int = 5) -> int:
    """How many of the places (both increasing) have one of the others within reach."""
    after = np.searchsorted(others, places)
    back = places - others[np.maximum(after - 1, 0)]
    ahead = others[np.minimum(after, len(others) - 1)] - places
    return int(((back >= 0) & (back <= reach) | (ahead >= 0) & (ahead <= reach)).sum())


def features_of(text: str | None, lexicon: dict[str, float]) -> list[float]:
    parts = tokens(text or "")
    words = [w for _, w, _ in parts]
    n = max(1, len(parts))
    hits = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    stems = [x for w in words for x in (lexicon.get(f"{w[: PREFIXES[1]]}^") or lexicon.get(f"{w[: PREFIXES[0]]}^"),) if x and w not in lexicon]
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = _near(np.array([i for i, _ in hits]), np.array(you)) if hits and you else 0
    weights = [w for _, w in hits]
    size = max(1, len(text or ""))
    disguised = sum(d for _, _, d in parts)
    return [
        len(hits), len(hits) / n, len({words[i] for i, _ in hits}), sum(weights), sum(weights) / n, max(weights, default=0.0), len(stems), len(stems) / n, sum(stems) / n,
        near / n, len(you) / n, sum(c.isupper() for c in text or "") / size, sum(len(b) > 2 and b.isupper() for b, _, _ in parts) / n,
        sum(not c.isalnum() and not c.isspace() for c in text or "") / size, (text or "").count("!") / n, disguised / n,
        sum(d and w in lexicon for _, w, d in parts), len(re.findall(r"([^\W\d_])\1\1", text or "")) / n, float(np.log1p(len(parts))), sum(map(len, words)) / n,
    ]


def featured(docs: DataFrame, lexicons: dict[int, dict[str, float]], text: str = "text", which: str | None = None) -> DataFrame:
    """row (a struct of all columns but the text, so that no name can clash) and features (a vector).

    ``which`` names a column that says which lexicon describes the row; without it, 0 does.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)
    rest = [c for c in docs.columns if c != text] or [F.lit(None).cast("int").alias("nothing")]
    base = docs.select(F.struct(*rest).alias("row"), F.col(text).alias("text"), (F.col(which) if which else F.lit(0)).alias("which"))
    schema = base.select("row", F.array(F.lit(0.0)).alias("features")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features_of(t, shared.value[n]) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            table = np.array(rows, np.float64).reshape(-1, len(FEATURES))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * len(FEATURES)), pa.array(table.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["row", "features"])

    return base.mapInArrow(run, schema).select("row", array_to_vector("features").alias("features"))


def _term_counts(docs: DataFrame, only: set[str] | None = None) -> DataFrame:
    """part, term, n: in how many of the texts (columns part, text) it is; counts are added up in each task first."""
    shared = docs.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter[str]] = {}
        for batch in batches:
            for part, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = terms(w for _, w, _ in tokens(value or ""))
                counts.setdefault(part, Counter()).update(own if shared.value is None else own & shared.value)
        for part, own in counts.items():
            yield pa.RecordBatch.from_pydict({"part": [part] * len(own), "term": list(own), "n": list(own.values())}, pa.schema([("part", pa.int64()), ("term", pa.string()), ("n", pa.int64())]))

    return docs.select(F.col("part").cast("long").alias("part"), "text").mapInArrow(run, "part long, term string, n long").groupBy("part", "term").agg(F.sum("n").alias("n"))


def learn_lexicons(labelled: DataFrame, least: int = 4, odds: float = 8.0, max_terms: int = 50_000, max_lexicon: int = 5_000) -> dict[int, dict[str, float]]:
    """By part, terms with their log-odds as learned from all other parts; 0 is from all.

    ``labelled``: text, toxic, part (from 1). A term is in at least ``least`` toxic texts and
    ``odds`` times as common there as in others. Of the ``max_terms`` terms that most toxic texts
    have, the ``max_lexicon`` with the largest log-odds stay; ties go to the last by name.
    """
    sizes = {(r.part, r.toxic): r.n for r in labelled.groupBy("part", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = labelled.where("toxic = 1"), labelled.where("toxic = 0")
    counts = kept(_term_counts(toxic))
    common = counts.groupBy("term").agg(F.sum("n").alias("all")).where(F.col("all") >= least).orderBy(F.desc("all"), "term").limit(max_terms)
    names = {r.term for r in common.select("term").collect()}
    own = [{}, {}]
    for kind, table in ((1, counts.join(common, "term", "left_semi")), (0, _term_counts(clean, names))):
        for r in table.collect():
            own[kind].setdefault(r.term, {})[r.part] = r.n
    out = {}
    for part in (0, *sorted({p for p, _ in sizes})):
        n = [sum(x for (p, t), x in sizes.items() if t == kind and p != part) for kind in (0, 1)]
        scored = []
        for term, by_part in own[1].items():
            a, b = (sum(x for p, x in counts_of.items() if p != part) for counts_of in (by_part, own[0].get(term, {})))
            if all(n) and a >= least:
                scored.append((np.log((a + 0.1) / (n[1] + 0.2)) - np.log((b + 0.5) / (n[0] + 1)), term))
        out[part] = {t: float(x) for x, t in sorted(scored, reverse=True)[:max_lexicon] if x >= np.log(odds)}
    return out


def fit(labelled: DataFrame, max_docs: int = 24_000, key: str = "doc_id", max_terms: int = 50_000, max_lexicon: int = 5_000) -> Model | None:
    """``labelled``: key, text, toxic (0 or 1; others are left out). None if a label has no rows.

    About ``max_docs`` labelled rows at most are learned from, chosen by a hash of key, text
    and label (equal rows once), so the fit costs the same for any corpus; so do the bounds of
    ``learn_lexicons``. Null texts are empty ones. Trees see three quarters, the calibration the
    rest. The trees' texts are described by a lexicon of the other two quarters, the calibration's
    by that of all three, so each lexicon is new to the texts it describes. Calibration texts of
    one raw score come to one task, at most a quarter of ``max_docs``.
    """
    rows = labelled.where(F.col("toxic").isin(0, 1)).select(key, F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    return _fit(sampled(rows, max_docs, rows.count(), key, "text", "toxic"), key, max_terms, max_lexicon)


def fit_joined(docs: DataFrame, labels: DataFrame, max_docs: int = 24_000, key: str = "doc_id", max_terms: int = 50_000, max_lexicon: int = 5_000) -> Model | None:
    """``fit`` of the join of ``docs`` (key, text) and ``labels`` (key, toxic), on the same rows.

    Texts stay where they lie: only their keys and hashes meet the labels, and what is
    chosen, about ``max_docs`` keys, is broadcast back to the texts.
    """
    texts = docs.select(key, F.coalesce("text", F.lit("")).alias("text"))
    known = labels.where(F.col("toxic").isin(0, 1)).select(key, F.col("toxic").cast("int").alias("toxic"))
    rows = texts.withColumns({f"_hash{kind}": sample_hash(key, "text", F.lit(kind)) for kind in (0, 1)})
    met = rows.drop("text").join(known, key).select(key, "toxic", F.when(F.col("toxic") == 1, F.col("_hash1")).otherwise(F.col("_hash0")).alias("_hash"))
    total = met.count()
    if total <= max_docs:
        return _fit(texts.join(known, key), key, max_terms, max_lexicon)
    chosen = met.where(F.col("_hash") < sample_limit(max_docs, total)).select(F.col(key).alias("_key"), "toxic", "_hash").distinct()
    same = (F.col(key) == F.col("_key")) & (F.when(F.col("toxic") == 1, F.col("_hash1")).otherwise(F.col("_hash0")) == F.col("_hash"))
    found = rows.join(F.broadcast(chosen), same).select(key, "text", "toxic")
    return _fit(found.dropDuplicates([key, "text", "toxic"]), key, max_terms, max_lexicon)


def _fit(rows: DataFrame, key: str, max_terms: int, max_lexicon: int) -> Model | None:
    """The model of these rows (key, text, toxic: 0 or 1)."""
    rows = kept(rows.withColumn("part", F.pmod(F.xxhash64(F.col(key), F.lit("part")), F.lit(PARTS)).cast("int")))
    lexicons = learn_lexicons(rows.where("part > 0"), max_terms=max_terms, max_lexicon=max_lexicon)
    lexicons = {p: lexicons.get(p, lexicons.get(0, {})) for p in range(PARTS)}
    table = kept(featured(rows, lexicons, which="part").select("features", F.col("row.toxic").cast("double").alias("toxic"), "row.part"))
    labels = {(r.part, r.toxic) for r in table.select((F.col("part") > 0).alias("part"), "toxic").distinct().collect()}
    if not {(True, 0.0), (True, 1.0)} <= labels:
        return None
    trees = GBTClassifier(labelCol="toxic", maxIter=16, maxDepth=3, stepSize=0.3, minInstancesPerNode=5, seed=7, cacheNodeIds=False).fit(table.where("part > 0"))
    calibration = trees.transform(table.where("part = 0") if (False, 1.0) in labels and (False, 0.0) in labels else table)
    isotonic = IsotonicRegression(featuresCol="raw", labelCol="toxic", predictionCol="calibrated").fit(calibration.select(vector_to_array("probability")[1].alias("raw"), "toxic"))
    return Model(lexicons[0], trees, isotonic)


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without the text, with score (0 to 1). Null texts count as empty; no model: 0.

    A column called score is replaced, all others stay as they are. Rows are scored each for
    itself, so repeats alike; a table without rows gives none.
    """
    if model is None:
        return docs.drop(text, "score").withColumn("score", F.lit(0.0))
    rest = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in (text, "score")]
    raw = model.trees.transform(featured(docs, {0: model.lexicon}, text)).select("row", vector_to_array("probability")[1].alias("raw"))
    return model.isotonic.copy()._set(featuresCol="raw", predictionCol="calibrated").transform(raw).select(*rest, F.least(F.greatest(F.col("calibrated"), F.lit(0.0)), F.lit(1.0)).alias("score"))
