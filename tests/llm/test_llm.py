"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import unicodedata
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vantage.llm import ann, common, decontam, langid, packing, queries, rangecoder, sharding, simhash, substring, tokens, toxicity, urlfilter
from vantage.llm.components import connected_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.tokenizer_path())


@given(st.lists(st.text("ab c\t\nñ\u3000", max_size=30), max_size=6))
@settings(deadline=None, max_examples=60)
def test_word_hashes_are_of_words(lines):
    import pyarrow as pa

    data, bounds = common.text_bytes(pa.array(lines, pa.string()))
    hashes, at = common.word_hashes(data, bounds)
    words = [line.encode().split() for line in lines]
    assert np.diff(at).tolist() == [len(w) for w in words]
    flat = [w for x in words for w in x]
    assert len({(w, int(h)) for w, h in zip(flat, hashes)}) == len(set(flat)) == len(set(hashes.tolist()))


def test_language_on_held_out(spark):
    rows = queries.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95


def test_language_spans(spark):
    en, ru = "the cat sat on the mat and then the dog came", "кот сидел на ковре и потом пришла собака"
    docs = spark.createDataFrame([(i, t, n) for i in range(6) for t, n in ((en, "en"), (ru, "ru"))], "doc_id long, text string, lang string")
    mixed = spark.createDataFrame([(1, f"{en} {en} {ru} {ru} {ru} {en}", None)], "doc_id long, text string, lang string")
    row = langid.identify(mixed, langid.fit(docs)).first()
    assert [s.lang for s in row.spans] == ["en", "ru", "en"] and row.lang_pred == "en"


def test_best_path_is_the_best():
    model = langid.Model(["a", "b", "c"], np.random.default_rng(1).normal(size=(langid.FEATURES, 3)).astype(np.float32), np.ones((len(langid._NAMES), 3), bool), np.ones(len(langid._NAMES), bool))
    labeller = langid.Labeller(model, 3.0)
    words = [["".join(random.Random(i * 31 + j).choices("abcdefg", k=4)) for j in range(n)] for i, n in enumerate((7, 1, 0, 5))]
    labels, bounds, _ = labeller.label(words)
    scores = labeller.scores[labeller._numbers(words)]
    for i, own in enumerate(words):
        s = scores[bounds[i] : bounds[i + 1]]
        value = lambda path: sum(s[t, k] for t, k in enumerate(path)) - 3.0 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
        best = max((value(p) for p in np.ndindex(*[3] * len(own))), default=0)
        assert value(labels[bounds[i] : bounds[i + 1]].tolist()) == pytest.approx(best, abs=1e-4)


def test_toxicity_on_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit > 0.8 * sum(r.toxic for r in rows) and hit > 0.9 * sum(r.predicted for r in rows)


def test_substring_matches_brute_force(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op3_substring_dedup(spark, SF).collect()}
    first: dict = {}
    for doc_id, text in texts:
        words = text.encode().split()
        gone = bytearray(len(words))
        for p in range(len(words) - 12):
            if first.setdefault(tuple(words[p : p + 13]), doc_id) < doc_id:
                gone[p : p + 13] = b"\1" * 13
        left = b" ".join(w for w, x in zip(words, gone) if not x)
        assert got[doc_id] == (len(words), sum(gone), hashlib.sha256(left).hexdigest())


def test_groups_are_bounded_in_bytes(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "docs")
    rng = random.Random(5)
    same = " ".join(f"s{i}" for i in range(30))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([5, 400, 3000]))) + (f" {same} end{i}" if i % 2 else "")) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    whole = {r.doc_id: (r.n_removed, r.kept_text) for r in substring.remove_repeats(docs).collect()}
    monkeypatch.setattr(substring, "GROUP_BYTES", 10_000)
    texts = dict(rows)
    placed = docs.withColumns({"_row": F.monotonically_increasing_id(), "_bytes": F.octet_length("text").cast("long")})
    groups: dict = {}
    for r in substring.grouped(placed).collect():
        groups.setdefault(r["_group"], []).append(len(texts[r.doc_id].encode()))
    assert sum(map(len, groups.values())) == 60 and len(groups) > 20
    assert all(len(g) == 1 or sum(g) <= 10_000 for g in groups.values())
    assert {r.doc_id: (r.n_removed, r.kept_text) for r in substring.remove_repeats(docs).collect()} == whole
    assert sum(n for n, _ in whole.values()) == 29 * 30


def test_letters_are_those_of_unicode():
    for i in [*range(0x3000), 0x4E00, 0x1D7D8, 0x24B6, 0x2460, 0xBD, 0x2167]:
        c = chr(i)
        assert bool(langid.words_of(c)) == any(unicodedata.category(x)[0] == "L" for x in c.lower()), hex(i)
    assert langid.words_of("हिन्दी में, ½ ² ① a1b") == ["हिन्दी", "में", "a", "b"]


def test_strict_identification_rejects_what_nothing_learned_explains(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    odd = {1: "Приветствие мир", 2: "漢字", 3: "½ ② ³", 4: None, 5: "the of and that with", 6: "de la que", 7: "the of and that with Приветствие мир и ещё много таких слов"}
    rows = spark.createDataFrame([(k, v, "x") for k, v in odd.items()], "doc_id long, text string, score string")
    strict = {r.doc_id: r.lang_pred for r in langid.identify(rows, model, strict=True, spans=False).collect()}
    plain = {r.doc_id: r.lang_pred for r in langid.identify(rows, model, spans=False).collect()}
    assert [k for k, v in strict.items() if v == "und"] == [1, 2, 3, 4, 7] and [k for k, v in plain.items() if v == "und"] == [3, 4]
    left = langid.drop_unidentified(rows, model)
    assert sorted(map(tuple, left.collect())) == [(5, odd[5], "x"), (6, odd[6], "x")] and left.columns == rows.columns
    named = docs.where("lang is not null and text rlike '\\\\p{L}'")
    assert langid.drop_unidentified(named, model).count() >= 0.99 * named.count()


@given(st.lists(st.integers(0, 2**52), min_size=1, max_size=50, unique=True))
def test_packed_numbers_come_back(values):
    values = np.array(sorted(values), np.uint64)
    data = substring.pack_sorted(values) + b"tail"
    back, end = substring.unpack_sorted(data)
    assert (back == values).all() and data[end:] == b"tail"


def _roots(n, edges):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 580)]
    roots = _roots(600, edges)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: roots[i] for e in edges if e[0] != e[1] for i in e}


def test_fingerprints_and_components_match_brute_force(spark, texts):
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.op4_simhash(spark, SF).collect()}
    prints = []
    for doc_id, text in texts:
        words = text.encode().translate(simhash._LOWER).split()
        parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(x, 42) for x in parts]
        prints.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)))
        assert got[doc_id][0] == prints[-1]
    roots = _roots(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    assert all(got[texts[i][0]][1] == texts[roots[i]][0] for i in range(len(texts)))


@pytest.mark.parametrize(("groups", "reach", "radius"), [(1, 2, 2)])
def test_grid_misses_no_link(groups, reach, radius):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = [base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) for _ in range(40)]
    prints = np.unique(np.concatenate(flips))
    rows, codes = map(np.concatenate, zip(*simhash.cell_codes(prints[:, None], groups, 2, reach)))
    order = np.argsort(codes, kind="stable")
    p, q = simhash.linked_in_cells(codes[order], prints[rows[order]][:, None], radius)
    got = simhash.joined(len(prints), rows[order][p], rows[order][q])
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    assert (got == simhash.joined(len(prints), *np.nonzero(near))).all()


def test_similar_pairs():
    rng = random.Random(2)
    base = [np.array(sorted(rng.sample(range(400), 60)), np.uint64) for _ in range(4)]
    sets = [np.array(sorted(set(rng.sample(b.tolist(), 60 - n)) | {1000 + n * 7 + i for i in range(n)}), np.uint64) for b in base for n in range(12)]
    p, q = simhash.similar_pairs(sets, 0.8)
    jaccard = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jaccard(sets[i].tolist(), sets[j].tolist()) >= 0.8}
    assert set(zip(p.tolist(), q.tolist())) <= linked and _roots(len(sets), zip(p.tolist(), q.tolist())) == _roots(len(sets), linked)


def test_near_copies_go(spark):
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(30)]
    rows = []
    for i, text in enumerate(base):
        rows.append((i * 10, text))
        for k in range(1, 4):
            words = text.split()
            for _ in range(k):
                words[rng.randrange(200)] = f"new{rng.random()}"
            rows.append((i * 10 + k, " ".join(words)))
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i * 10 for i in range(30)}


@pytest.mark.parametrize(("shared", "left", "right", "pairs"), [(4, 0, 1, 300), (5, 0, 1, 300), (6, 0, 1, 300), (12, 1, 2, 300), (80, 0, 20, 200), (80, 10, 10, 200), (800, 100, 100, 30), (800, 200, 0, 30)])
def test_lone_pairs_at_the_threshold_are_found(spark, shared, left, right, pairs):
    rng = random.Random(shared + left)
    rows, n = [], shared + 4
    for i in range(pairs):
        common = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        rows.append((2 * i, " ".join([f"a{rng.randrange(10**9)}" for _ in range(left)] + common)))
        rows.append((2 * i + 1, " ".join(common + [f"b{rng.randrange(10**9)}" for _ in range(right)])))
    for i in range(pairs, 2 * pairs):  # one shared shingle less, one own more: under the threshold where that holds
        common = [f"w{rng.randrange(10**9)}" for _ in range(n - 1)]
        own = -(-(shared - 1) // 4) + 1
        rows.append((2 * i, " ".join(common)))
        rows.append((2 * i + 1, " ".join(common + [f"b{rng.randrange(10**9)}" for _ in range(own)])))
    rng.shuffle(rows)
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert kept == {2 * i for i in range(pairs)} | set(range(2 * pairs, 4 * pairs))


def test_tiling_finds_reordered_parts():
    item = [b"w%d" % i for i in range(20)]
    doc = [b"x"] * 3 + item[10:] + [b"y"] + item[:10] + [b"z"] * 2
    assert sorted(decontam.tile(doc, item, 4)) == [(3, 10, 10), (14, 0, 10)]
    assert decontam.tile(doc[:6], item, 4) == []


def test_decontamination_matches_plain_containment(spark, texts):
    found = {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, SF).collect()}
    items = {r.item_id: decontam.plain(r.text).split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    for doc_id, text in texts:
        line = b" " + b" ".join(decontam.plain(text).split()) + b" "
        for number, words in items.items():
            if b" " + b" ".join(words) + b" " in line:
                assert (doc_id, number) in found


def test_decontamination_in_any_script(spark):
    items = [
        (1, "Die Straße führt “über” den Fluss – und zurück"),
        (2, "«L’été dernier» était très agréable à Évian"),
        (3, "東京は日本の首都であり世界最大の都市です"),
        (4, "Ответ найден"),
        (5, "Żółw"),
        (6, "हिन्दी में लिखा हुआ एक वाक्य"),
        (7, "— …"),
    ]
    rows = [
        (1, "Davor. DIE STRASSE FÜHRT ÜBER DEN FLUSS UND ZURÜCK! Danach."),
        (2, "AVANT: \"L'E\u0301TE\u0301 DERNIER\" ÉTAIT TRÈS AGRÉABLE, À ÉVIAN..."),
        (3, "その東京は日本の首都であり世界最大の都市ですよ"),
        (4, "и «ОТВЕТ найден»!"),
        (5, "to jest żółw."),
        (6, "और हिन्दी में लिखा हुआ एक वाक्य है"),
        (7, "nothing of it, Ответ не найден, 東京の都 — … żółwie"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench, short=True).collect()} == {(n, n) for n in range(1, 7)}
    assert [r.doc_id for r in decontam.drop_contaminated(docs, bench, short=True).collect()] == [7]


def test_capitals_hide_no_benchmark_item(spark):
    bench = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()
    items = [(r.item_id, r.text) for r in bench if not r.text.isascii()]
    docs = spark.createDataFrame([(n, f"xx {t.upper()} yy") for n, t in items], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(items) == 62 and {(n, n) for n, _ in items} <= found


_SOME = st.text(st.characters(codec="utf-8"), max_size=60) | st.text("aB'st ÀéßÿÞ.,'123\n#<|>endoftxt", max_size=60)


@given(st.lists(_SOME | st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "<|ENDOFTEXT|>"]), max_size=4).map("".join), st.booleans())
@settings(deadline=None, max_examples=300)
def test_ids_are_the_library_s(text, as_text):
    own = Tokenizer.from_file(tokens.tokenizer_path()) if not hasattr(test_ids_are_the_library_s, "own") else test_ids_are_the_library_s.own
    test_ids_are_the_library_s.own = own
    own.encode_special_tokens = as_text
    assert np.frombuffer(tokens.encode(text, tokens.tokenizer_path(), as_text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_special_strings_are_their_tokens():
    ids = np.frombuffer(tokens.encode("hello <|endoftext|> world <|startoftext|>", tokens.tokenizer_path()), "<u4").tolist()
    assert ids == [3306, 49407, 1002, 49406]


def test_learning_samples_are_bounded_at_any_size(spark):
    ids = F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id"))
    rows = spark.range(30_000).select(ids.alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    assert common.sampled(rows, 100_000, 30_000, "doc_id", "text").count() == 30_000
    for scale in (1, 10**7):  # a table of 3e11 rows, of which these are the ones at hand
        got = common.sampled(rows, 3_000 * scale, 30_000 * scale, "doc_id", "text")
        assert 2_600 < got.count() < 3_400 and 800 < got.where("doc_id IS NULL").count() < 1_200
    copies = spark.range(30_000).select(F.lit(5).alias("doc_id"), F.lit("one text").alias("text"))
    assert common.sampled(copies, 20_000, 30_000, "doc_id", "text").count() <= 1


def test_packing_has_each_id_once_and_little_padding(spark, texts, tokenizer):
    by: dict = {}
    sequences: dict = {}
    for r in queries.op6_packing(spark, SF).collect():
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            assert r.length > 1 or len(ids) == 1  # no piece is an end alone
            at += r.length
        assert at == len(ids)
    tokens = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
        tokens += end
    assert tokens > 0.96 * 4096 * len(sequences) and sum(map(len, by.values())) < 2.5 * len(by)


@given(st.lists(st.integers(1, 9000), max_size=300), st.sampled_from([1, 7, 64, 1000, 4096]))
@settings(deadline=None, max_examples=60)
def test_pieces_fill_classes_with_fixed_counts(lengths, capacity):
    bins, placed = packing.HarmonicBins(capacity, 3), []
    for n in lengths:
        for start, length in packing.pieces(n, capacity):
            assert 0 < length <= capacity
            placed.extend(bins.add((n, start, length), length))
    full = len(placed)
    placed.extend(bins.rest())
    assert sum(p[0][2] for p in placed) == sum(lengths)
    held: dict = {}
    for i, ((_, _, length), sequence, offset) in enumerate(placed):
        assert offset == sum(x for x, _ in held.get(sequence, []))
        held.setdefault(sequence, []).append((length, i < full))
    for members in held.values():
        assert sum(x for x, _ in members) <= capacity
        kinds = {min(capacity // x, packing.CLASSES) for x, by_class in members if by_class}
        assert not kinds or (len(kinds) == 1 and (kinds == {packing.CLASSES} or len(members) in kinds))


def test_neighbours_reach_the_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got: dict = {}
    for r in queries.op7_ann(spark, SF).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    recall = []
    for i in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[i]
        scores[i] = -np.inf
        best = np.lexsort((ids, -scores))[:20]
        recall.append(len(set(ids[best]) & set(got[ids[i]])) / 20)
        assert all(math.isclose(s, scores[np.flatnonzero(ids == v)[0]], abs_tol=1e-12) for v, s in got[ids[i]].items())
    assert np.mean(recall) >= 0.9


def test_whole_search_and_the_exit_by_figures(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    table = {r.vec_id: np.array(r.embedding) for r in rows.select("vec_id", "embedding").collect()}
    got = {(r.query_id, r.rank): r.vec_id for r in ann.nearest(rows, F.col("vec_id") % 20 == 0, exact=True).collect()}
    for q in (i for i in table if i % 20 == 0):
        best = sorted((i for i in table if i != q), key=lambda i: (-float(table[q] @ table[i]), i))[:20]
        assert [got[q, n + 1] for n in range(20)] == best
    with pytest.raises(ValueError, match="comparisons"):
        ann.nearest(rows, F.col("vec_id") % 20 == 0, max_pairs=10)


def test_tasks_of_neighbours_are_bounded_on_both_sides(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    whole = sorted(map(tuple, ann.nearest(rows, F.col("vec_id") % 2 == 0).collect()))
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ann, "QUERY_ROWS", 16)
    sizes = []
    tasks = ann._tasks

    def seen(places, window, total):
        reach, held = tasks(places, window, total)
        for side, most in ((reach, 16), (held, 64)):
            counts = [r["count"] for r in side.groupBy("curve", "part", "block").count().collect()]
            assert max(counts) <= most
            sizes.append(sum(counts))
        return reach, held

    monkeypatch.setattr(ann, "_tasks", seen)
    assert [r[:3] for r in sorted(map(tuple, ann.nearest(rows, F.col("vec_id") % 2 == 0).collect()))] == [r[:3] for r in whole]
    assert len(sizes) == 2 and min(sizes) > 0


def test_clustered_vectors_are_found_in_narrow_windows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 12)) * 4
    x = centres[np.arange(6000) % 60] + rng.standard_normal((6000, 12)) * 0.05
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    windows, tasks = [], ann._tasks
    monkeypatch.setattr(ann, "_tasks", lambda places, window, total: (windows.append(window), tasks(places, window, total))[1])
    got: dict = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for i in range(0, 6000, 20):
        scores = x @ x[i]
        scores[i] = -np.inf
        recall.append(len(set(np.lexsort((np.arange(6000), -scores))[:20].tolist()) & got[i]) / 20)
    assert windows[0] * 8 < 6000 and np.mean(recall) >= 0.9


def test_hilbert_neighbours_touch():
    keys = ann.hilbert_keys(np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)]), 3)
    points = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(512)) and (np.abs(np.diff(points, axis=0)).sum(1) == 1).all()


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 20), max_size=400))
@settings(deadline=None, max_examples=40)
def test_coded_ids_come_back(ids):
    data = np.array(ids, np.uint32)
    head, blocks = rangecoder.encode_blocks(data)
    assert (rangecoder.decode_blocks(head, blocks, len(data)) == data).all()


def test_damage_is_noticed():
    data = np.arange(5000, dtype=np.uint32)
    head, blocks = rangecoder.encode_blocks(data)
    for damaged in ((head[:9] + bytes([head[9] ^ 1]) + head[10:], blocks), (head, [blocks[0], blocks[1][:9] + bytes([blocks[1][9] ^ 1]) + blocks[1][10:], *blocks[2:]]), (head, blocks[1:])):
        with pytest.raises(ValueError, match="damaged"):
            rangecoder.decode_blocks(*damaged, len(data))


def test_coder_beats_zlib_and_order_0(texts):
    line = np.frombuffer(b"".join(tokens.encode(t, tokens.tokenizer_path()) + tokens.END.to_bytes(4, "little") for _, t in texts), "<u4")
    head, blocks = rangecoder.encode_blocks(line)
    bits = 8 * (len(head) + sum(map(len, blocks))) / len(line)
    parts = [line[i : i + rangecoder.BLOCK] for i in range(0, len(line), rangecoder.BLOCK)]
    deflated = 8 * sum(len(zlib.compress(p.astype("<u2").tobytes(), 9)) for p in parts) / len(line)
    shares = np.unique(line, return_counts=True)[1] / len(line)
    assert bits < 0.75 * deflated and bits < -(shares * np.log2(shares)).sum()


def test_blocks_stand_alone(texts):
    """Any block decodes to the same ids with the head and itself alone, as far as its size can be had alone."""
    line = np.frombuffer(tokens.encode(" ".join(t or "" for _, t in texts[:60]), tokens.tokenizer_path()), "<u4")[: 4 * rangecoder.BLOCK]
    head, blocks = rangecoder.encode_blocks(line)
    for i in (0, 3):
        assert (rangecoder.decode_blocks(head, [blocks[i]], rangecoder.BLOCK) == line[i * rangecoder.BLOCK : (i + 1) * rangecoder.BLOCK]).all()


def test_token_files_come_back(spark, texts, tokenizer):
    rows = sorted(queries.op8_token_files(spark, SF).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, (doc_id, text) in zip(rows, texts, strict=True):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_cascade_is_exact_on_its_universe(spark):
    universe = [f"host{i}.com/" for i in range(3000)]
    listed = universe[::7] + ["elsewhere/"]
    cascade = urlfilter.build_cascade(spark.createDataFrame([(k,) for k in universe], "key string"), listed, len(universe))
    assert [k for k in universe if k in cascade] == universe[::7] and len(cascade.levels) > 1


def test_jump_moves_only_into_the_new_shard(spark):
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            j = math.floor((b + 1) * 4294967296.0 / (int(hashlib.md5(f"{key}:{b}".encode()).hexdigest()[:8], 16) + 1))
        return b

    rows = spark.range(2000).select("id", *(sharding.jump_walk(F.col("id"), n)["b"].alias(f"s{n}") for n in (1, 5, 6, 40))).collect()
    for r in rows:
        assert [r[f"s{n}"] for n in (1, 5, 6, 40)] == [jump(r.id, n) for n in (1, 5, 6, 40)] and r.s6 in (r.s5, 5)


def test_sizes_and_checksums(spark, texts):
    rows = {r.doc_id: r for r in queries.op10_sharding(spark, SF).collect()}
    assert all((rows[d].size, rows[d].text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts)


def test_pipeline_runs_and_keeps_columns(spark, docs):
    import corpus_pipeline

    now, counts = docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        counts.append(now.count())
    assert counts == sorted(counts, reverse=True)
    packed = corpus_pipeline.run(spark, SF)
    assert packed.where("start = 0").count() == counts[-1]


def _tiles(doc, item, least):
    """Greedy string tiling by trying all pairs of places."""
    in_doc, in_item, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        found = {}
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not in_doc[i + n] and not in_item[j + n]:
                    n += 1
                found.setdefault(n, []).append((j, i))
        longest = max(found, default=0)
        if longest < least:
            return tiles
        for j, i in found[longest]:
            if not any(in_doc[i : i + longest]) and not any(in_item[j : j + longest]):
                in_doc[i : i + longest] = in_item[j : j + longest] = [True] * longest
                tiles.append((i, j, longest))


@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), min_size=1, max_size=24), st.integers(1, 5), st.sampled_from([1, 7, 1 << 20]))
@settings(deadline=None, max_examples=150)
def test_tiling_is_that_of_all_pairs(doc, item, least, places):
    doc, item, held = [b"%d" % x for x in doc], [b"%d" % x for x in item], decontam.PLACES
    decontam.PLACES = places
    try:
        assert decontam.tile(doc, item, least) == _tiles(doc, item, least)
    finally:
        decontam.PLACES = held


def test_tiling_of_a_repeated_word_is_quick():
    assert decontam.tile([b"a"] * 50_000, [b"a"] * 60, 4) == [(0, 0, 60)]
    assert decontam.tile([b"a"] * 50_000, ([b"a"] * 30 + [b"b"]) * 4, 4) == [(30 * k, 31 * k, 30) for k in range(4)]


def test_contaminated_documents_are_those_of_all_pairs(spark, docs):
    """Whole query against tiling of every document with every item."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, decontam.plain(r.text).split()) for r in bench.collect()]
    expected = {}
    for r in docs.collect():
        words = decontam.plain(r.text).split()
        have = set(words)
        for n, item in items:
            if item and sum(w in have for w in item) >= 0.5 * len(item):  # what isn't there can't be covered
                short = [words[k : k + len(item)] for k in range(len(words))] if len(item) < 4 else []
                covered = (len(item) if item in short else 0) if len(item) < 4 else sum(t[2] for t in _tiles_of_runs(words, item))
                if covered >= 0.5 * len(item):
                    expected[r.doc_id, n] = covered
    assert {(r.doc_id, r.item_id): r.covered for r in queries.op5_decontamination(spark, SF).collect()} == expected and expected


def _tiles_of_runs(words, item):
    """As ``_tiles`` with 4 words at least, over the document's runs of the item's words only."""
    runs, own = [], set(item)
    for w in words:
        if w in own:
            runs.append(w)
        elif runs and runs[-1] is not None:
            runs.append(None)
    return _tiles(runs, item, 4)


@given(st.lists(st.integers(0, 60), max_size=20, unique=True), st.lists(st.integers(0, 60), min_size=1, max_size=20, unique=True))
def test_near_places(places, others):
    places, others = sorted(places), sorted(others)
    assert toxicity._near(np.array(places, np.int64), np.array(others)) == sum(any(abs(p - o) <= 5 for o in others) for p in places)


def test_features_of_a_long_text_take_linear_room():
    values = dict(zip(toxicity.FEATURES, toxicity.features_of("idiot you " * 100_000, {"idiot": 1.0})))
    assert values["lexicon_hits"] == 100_000 and values["near_you"] == 0.5


def test_near_copies_of_the_corpus_go(spark, docs):
    """Recall and precision of the near-copy stage against all pairs of shingle sets, on real documents."""
    rows = {r.doc_id: frozenset(simhash.shingle_hashes(r.text, 5).tolist()) for r in docs.collect()}
    by_set: dict = {}
    for i in sorted(rows):
        by_set.setdefault(rows[i], []).append(i)
    sets = list(by_set)
    edges = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    roots = _roots(len(sets), edges)
    expected = {min(min(by_set[sets[k]]) for k in range(len(sets)) if roots[k] == root) for root in set(roots)}
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == expected


def test_texts_of_one_id_are_judged_each(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "h i j k l m n", "x"), (1, "a b c d e f g", "y"), (2, "a b c d e f g", "z"), (None, "h i j k l m n", "u"), (None, "o p q r s t u", "v")]
    left = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, key string")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in left) == [(-1, "o p q r s t u"), (1, "a b c d e f g"), (1, "h i j k l m n")]


def test_lexicon_is_of_toxic_words(spark):
    rows = [(i, ("you are a moronic fool " if i % 4 == 0 else "a pleasant day ") + f"w{i} today", int(i % 4 == 0)) for i in range(80)]
    lexicons = toxicity.learn_lexicons(spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("part", F.col("doc_id") % 3 + 1))
    assert set(lexicons) == {0, 1, 2, 3}
    lexicon = lexicons[0]
    assert {"moronic", "fool"} <= set(lexicon) and "today" not in lexicon
    assert packing.HarmonicBins(64, 0).next == 0


def test_large_groups_compare_like_sizes_only(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 16)
    words = [f"w{i}" for i in range(400)]
    texts = {100 * size + i: " ".join([*words[:size], f"end{size}x{i}"]) for size in (8, 30, 60, 75, 90, 150, 300) for i in range(8)}
    rows = spark.createDataFrame([(k, 0, t) for k, t in texts.items()], "key long, twin long, text string")
    sets = {k: set(simhash.shingle_hashes(t, 5).tolist()) for k, t in texts.items()}
    members = spark.createDataFrame([(k, 1, len(sets[k]), k, 0) for k in texts], "node long, root long, n_shingles long, key long, twin long")
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    want = simhash.joined_table(np.array([a for a, _ in near]), np.array([b for _, b in near])).to_pylist()
    edges = simhash._verified(rows, members, 5, 0.8).collect()
    got = simhash.joined_table(np.array([r.a for r in edges]), np.array([r.b for r in edges])).to_pylist()
    assert got == want and len({r["b"] for r in want}) > 2
    # without classes each of 56 members would travel once for each of 4 parts
    assert "class" in simhash._verified(rows, members, 5, 0.8)._jdf.queryExecution().analyzed().toString()


def test_texts_that_share_a_line_are_no_candidates(spark):
    """Sketches of sets of a known size differ by no more than the sizes allow, so one common line joins no group."""
    rng = np.random.default_rng(5)
    bounds = simhash._apart(simhash.SKETCH_RADIUS)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        pool = np.unique(rng.integers(0, 2**63, 3 * n, dtype=np.uint64))
        rng.shuffle(pool)
        gone, new = int(rng.integers(0, n // 9 + 1)), int(rng.integers(0, n // 9 + 1))
        x, y = np.sort(pool[:n]), np.sort(np.r_[pool[gone:n], pool[n : n + new]])
        if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)):
            apart = int(np.bitwise_count(simhash.sketch(x)[1] ^ simhash.sketch(y)[1]).sum())
            assert apart <= bounds[min(len(x), 511), min(len(y), 511)]
    line = "this one line of twelve words stands in very many short texts"
    rows = [(i, 0, line + " " + " ".join(f"w{k}" for k in rng.integers(0, 10**9, 20))) for i in range(200)]
    rows.append((200, 0, rows[0][2] + " more"))
    nodes = simhash.sketches(spark.createDataFrame(rows, "key long, twin long, text string"), 5, 0.8).withColumnRenamed("key", "node").drop("print")
    assert {(r.a, r.b) for r in simhash.grid_links(nodes, simhash.SKETCH_RADIUS).collect()} == {(200, 0)}
