"""Language identification that labels spans of mixed-language text.

The script of a word, by code point ranges, narrows the languages it can be in to those that use
the script. A word's scores are log-odds of its letter n-grams in each language. The best path
through a text pays a penalty for each change of language (Viterbi), which gives spans; the text's
language is the one with the most letters.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from vantage.llm.common import U64, mixed, sampled, slices

# First code points of ranges and the script that starts there ("" for none).
SCRIPTS = [
    (0x0041, "Latin"), (0x0250, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, ""), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, ""), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Kana"), (0x3100, "Han"),
    (0x3130, "Hangul"), (0x3190, "Han"), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB50, "Arabic"),
    (0xFE00, ""), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, ""), (0x20000, "Han"),
]
_FIRST = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({s for _, s in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(s) for _, s in SCRIPTS])
UNKNOWN = "und"
#: n-grams are hashed to so many features.
FEATURES = 1 << 16
#: Words of which a task remembers the scores.
MAX_WORDS = 150_000
SLICE_BYTES = 2 << 20


@cache
def _word() -> re.Pattern:
    """A letter and the letters and marks after it, by Unicode category (vowel signs are marks)."""

    def ranges(kinds: str) -> str:
        own = np.fromiter((unicodedata.category(chr(i))[0] in kinds for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        edges = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
        return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2))

    return re.compile(f"[{ranges('L')}][{ranges('LM')}]*")


#: The same for texts of the first 256 code points, whose letters are few.
_LATIN, _LATIN_WORD = re.compile("[\x00-\xff]*"), re.compile("[a-zªµºß-öø-ÿ]+")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return (_LATIN_WORD if _LATIN.fullmatch(text) else _word()).findall(text.lower())


def scripts_of(points: np.ndarray) -> np.ndarray:
    return _SCRIPT[np.maximum(np.searchsorted(_FIRST, points, "right") - 1, 0)]


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all words in a row, each word's bounds in them, and each word's script.

    A word with marks at both ends gives its n-grams of two to four letters and itself. Its script
    is the one that most of its letters have, of several the first by name.
    """
    text = "".join(f"\x02{w}\x03" for w in words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    begins = np.flatnonzero(points == 2)
    ends = np.r_[begins[1:], len(points)]
    word = np.repeat(np.arange(len(words)), ends - begins)
    hashes, owner = [], []
    rolling = points.copy()
    for n in (2, 3, 4):
        rolling = rolling[:-1] * U64(0x100000001B3) + points[n - 1 :]
        inside = np.flatnonzero(word[: len(rolling)] == word[n - 1 :]) if len(rolling) else np.zeros(0, np.int64)
        hashes.append(rolling[inside] + U64(n))
        owner.append(word[inside])
    whole = np.add.reduceat(mixed(points + np.arange(len(points), dtype=U64) * U64(0x9E3779B97F4A7C15) - begins[word].astype(U64) * U64(0x9E3779B97F4A7C15)), begins)
    hashes.append(whole)
    owner.append(np.arange(len(words)))
    owner, features = np.concatenate(owner), (mixed(np.concatenate(hashes)) % U64(FEATURES)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return features[order], np.searchsorted(owner[order], np.arange(len(words) + 1)), _main_scripts(points.astype(np.int64), word, begins)


def _main_scripts(points: np.ndarray, word: np.ndarray, begins: np.ndarray) -> np.ndarray:
    inner = points > 3
    scripts, word = scripts_of(points[inner]), word[inner]
    main = scripts[np.r_[0, np.cumsum(np.bincount(word))[:-1]]]
    mixed_words = np.unique(word[scripts != main[word]])
    if len(mixed_words):
        own = np.isin(word, mixed_words)
        counts = np.zeros((len(mixed_words), len(_NAMES)), np.int64)
        np.add.at(counts, (np.searchsorted(mixed_words, word[own]), scripts[own]), 1)
        counts[:, _NAMES.index("")] = np.minimum(counts[:, _NAMES.index("")], counts.sum(1) == counts[:, _NAMES.index("")])
        main[mixed_words] = counts.argmax(1)
    return main


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (features, languages): log-odds against the mean language
    allowed: np.ndarray  # (scripts, languages)
    used: np.ndarray  # (scripts,): some language uses it


def fit(docs: DataFrame, use: Column | None = None, max_docs: int = 20_000, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of the languages in ``lang``; null languages and texts teach nothing.

    Of the rows that ``use`` allows about ``max_docs`` at most are read, chosen by a hash of key,
    text and language; equal rows then teach once. Counts are added up by Spark; the table that comes to the driver has FEATURES numbers
    for each language at most.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.lit(True) if use is None else use))
    rows = sampled(rows.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")), max_docs, rows.count(), "k", "t", "l")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for value, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(value)
                if not words:
                    continue
                features, _, scripts = word_features(words)
                own = counts.setdefault(language, np.zeros(FEATURES + len(_NAMES), np.int64))
                np.add.at(own, features, 1)
                own[FEATURES:] += np.bincount(scripts, minlength=len(_NAMES))
        for language, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": [language] * len(at), "feature": at, "n": own[at]}, schema)

    schema = pa.schema([("lang", pa.string()), ("feature", pa.int64()), ("n", pa.int64())])
    seen = rows.select("t", "l").mapInArrow(count, "lang string, feature long, n long")
    table = seen.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique())
    counts = np.zeros((FEATURES + len(_NAMES), len(languages)))
    counts[table["feature"].to_numpy(np.int64), [languages.index(x) for x in table["lang"]]] = table["n"].to_numpy()
    grams, scripts = counts[:FEATURES], counts[FEATURES:]
    rates = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * FEATURES)) if languages else grams
    seen_at_all = grams.sum(1, keepdims=True) > 0
    weights = np.where(seen_at_all, rates - rates.mean(1, keepdims=True) if languages else 0.0, 0.0)
    allowed = scripts > 0.01 * scripts.sum(0)
    used = allowed.any(1)
    allowed[~used] = True  # no language uses the script: it narrows nothing
    return Model(languages, weights.astype(np.float32), allowed, used)


class Labeller:
    """Labels words of texts; remembers the scores of words."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, len(model.languages)), np.float32)
        self.strange = np.zeros(1024, bool)

    def _numbers(self, texts: list[list[str]]) -> np.ndarray:
        """The row in ``scores`` of each word."""
        if len(self.known) > MAX_WORDS:
            self.known, self.scores, self.strange = {}, self.scores[:1024], self.strange[:1024]
        known = self.known
        new = list({w for words in texts for w in words if w not in known})
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            features, bounds, scripts = word_features(part)
            sums = np.add.reduceat(self.model.weights[features], bounds[:-1]) / np.sqrt(np.diff(bounds))[:, None]
            strange = ~self.model.used[scripts] | ~sums.any(1)
            sums = np.where(self.model.allowed[scripts], np.clip(sums, -20, 20), -40.0).astype(np.float32)
            at = len(known)
            while len(self.scores) < at + len(part):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.strange = np.concatenate([self.strange, np.zeros_like(self.strange)])
            self.scores[at : at + len(part)], self.strange[at : at + len(part)] = sums, strange
            known.update(zip(part, range(at, at + len(part))))
        return np.fromiter((known[w] for words in texts for w in words), np.int64, sum(map(len, texts)))

    def label(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A language number for each word, the texts' bounds in the words, and which words nothing learned explains.

        Those are in a script that no language uses, or have no n-gram that a language has.

        All texts go one word forward at a time, the longest first, so that those still running
        are the first ones.
        """
        sizes = np.array([len(x) for x in texts], np.int64)
        bounds = np.r_[0, np.cumsum(sizes)]
        labels = np.zeros(bounds[-1], np.int64)
        if not bounds[-1] or not self.model.languages:
            return labels, bounds, np.ones(bounds[-1], bool)
        numbers = self._numbers(texts)
        strange = self.strange[numbers]
        if len(self.model.languages) < 2:
            return labels, bounds, strange
        scores = self.scores[numbers]
        order = np.argsort(-sizes, kind="stable")
        first, length = bounds[:-1][order], sizes[order]
        running = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
        changed = np.zeros(scores.shape, bool)
        best = np.zeros(bounds[-1], np.uint8 if len(self.model.languages) < 256 else np.int64)
        last = np.zeros(len(texts), np.int64)
        state = scores[first[: running[0]]].copy()
        for t in range(len(running)):
            n = running[t]
            if t:
                if n < len(state):
                    last[n : len(state)] = state[n:].argmax(1)
                    state = state[:n]
                top = state.argmax(1)
                floor = np.take_along_axis(state, top[:, None], 1) - self.penalty
                at = first[:n] + t
                changed[at] = state < floor
                best[at] = top
                state = np.maximum(state, floor) - floor + scores[at]
        last[: len(state)] = state.argmax(1)
        now = last
        for t in range(len(running) - 1, -1, -1):
            n = running[t]
            at = first[:n] + t
            own = now[:n]
            labels[at] = own
            now[:n] = np.where(changed[at, own], best[at], own)
        return labels, bounds, strange


def identify(docs: DataFrame, model: Model, penalty: float = 12.0, spans: bool = True, text: str = "text", strict: bool = False) -> DataFrame:
    """The rows of ``docs`` with lang_pred, score and, if asked for, spans.

    ``score`` is the share of the text's letters in words of that language. A span has its first
    and last word (runs of letters and their marks, from 0) and its language. Null texts and texts
    without a letter are ``und`` with score 0. Ties go to the first language by name. ``strict``
    counts words that nothing learned explains (see ``Labeller.label``) for no language; a text with
    more letters in these than in any language is ``und`` too, with score 0. Rows are labelled each
    for itself, repeats alike. Columns of ``docs`` with the result's names are replaced; a table
    without rows gives none.
    """
    added = ["lang_pred", "score"] + ["spans"] * spans
    base = docs.drop(*[c for c in added if c != text])
    schema = StructType([*base.schema.fields]).add("lang_pred", "string").add("score", "double")
    if spans:
        schema = schema.add("spans", ArrayType(StructType().add("first", "integer").add("last", "integer").add("lang", "string")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, languages = Labeller(shared.value, penalty), shared.value.languages
        for batch in batches:
            for a, b, top, score, labels, bounds in _judged(labeller, batch.column(names.index(text)).to_pylist(), strict):
                columns = [pa.array([languages[t] if t >= 0 else UNKNOWN for t in top], pa.string()), pa.array(score)]
                if spans:
                    columns.append(pa.array([_spans(labels[x:y], languages) for x, y in zip(bounds, bounds[1:])], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(names))), *columns], names=[*names, *added])

    return base.mapInArrow(run, schema)


def drop_unidentified(docs: DataFrame, model: Model, least: float = 0.5, penalty: float = 12.0, text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose text is in a learned language by ``identify(strict=True)`` with a score of ``least``.

    So null and empty texts go, texts without a letter, those mostly in words that nothing learned
    explains, and mixtures in which no language has that share of the letters. All columns are
    kept as they are, whatever their names; repeated rows are judged alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value, penalty)
        for batch in batches:
            for a, b, top, score, _, _ in _judged(labeller, batch.column(at).to_pylist(), True):
                yield batch.slice(a, b - a).filter(pa.array((top >= 0) & (score >= least)))

    return docs.mapInArrow(run, docs.schema)


def _judged(labeller: Labeller, values: list[str | None], strict: bool) -> Iterator[tuple]:
    """For slices of the texts: their bounds, languages (-1 for none), scores, and the words' labels with the texts' bounds in them."""
    n = len(labeller.model.languages)
    lengths = np.r_[0, np.cumsum([len(v or "") for v in values])]
    for a, b in slices(lengths, SLICE_BYTES):
        words = [words_of(v) for v in values[a:b]]
        labels, bounds, strange = labeller.label(words)
        weight = np.fromiter((len(w) for x in words for w in x), np.float64, bounds[-1])
        letters = np.zeros((b - a, n + 1))  # the last column: no language
        np.add.at(letters, (np.repeat(np.arange(b - a), np.diff(bounds)), np.where(strange & strict, n, labels)), weight)
        total, top = letters.sum(1), letters.argmax(1)
        some = (total > 0) & (top < n)
        yield a, b, np.where(some, top, -1), np.where(some, letters.max(1) / np.maximum(total, 1), 0.0), labels, bounds


def _spans(labels: np.ndarray, languages: list[str]) -> list[dict]:
    if not len(labels) or not languages:
        return []
    at = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
    return [{"first": int(a), "last": int(b) - 1, "lang": languages[labels[a]]} for a, b in zip(at, np.r_[at[1:], len(labels)])]
