"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import math

import pytest
from pyspark.sql import functions as F

from vantage.llm import ann, decontam, langid, packing, sharding, simhash, substring, tokenstore, toxicity, urlfilter

LONG = " ".join(f"word{i % 977} and{i}" for i in range(30_000))
ROWS = [
    (1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen.", "en", "a", 10),
    (2, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen.", "en", "a", 10),
    (2, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen.", "en", "a", 10),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n ", "de", "b", 3),
    (6, LONG, "en", "b", len(LONG)),
    (None, "ein kleiner Text ohne Nummer", "de", None, None),
    (None, None, None, None, None),
    (7, "12345 !!! ###", "de", "c", 13),
    (8, "Приветствие \U0001f600 e\u0301 \u3000x", None, "c", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["n_words", "n_removed", "kept_text", "score", "lang_pred", "fingerprint", "bucket", "spans", "rule", "verdict", "host", "path", "shard", "slot", "ids", "node", "root", "a", "b", "_row", "_id", "_text", "_group", "_bytes", "_key", "row", "key", "twin", "marks", "capitals", "repeated", "features", "probability", "part", "raw", "which", "start", "length", "head", "best", "winner"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Written tables: as it is, with clashing columns, and empty."""
    out = {}
    full = spark.createDataFrame(ROWS, SCHEMA).repartition(2, "doc_id")
    for name, df in {"plain": full, "clash": full.withColumns({c: F.lit("x") for c in CLASH}), "empty": full.where("false")}.items():
        path = str(tmp_path_factory.mktemp("docs") / name)
        df.write.parquet(path)
        out[name] = path
    return {k: spark.read.parquet(v) for k, v in out.items()}


KINDS = ["plain", "clash", "empty"]


@pytest.mark.parametrize("kind", KINDS)
def test_language(tables, kind):
    model = langid.fit(tables[kind])
    rows = langid.identify(tables[kind], model).collect()
    assert len(rows) == (0 if kind == "empty" else len(ROWS))
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1


def test_language_of_nothing_learned(tables):
    rows = langid.identify(tables["plain"], langid.fit(tables["empty"])).collect()
    assert {r.lang_pred for r in rows} == {"und"}


@pytest.mark.parametrize("kind", KINDS)
def test_toxicity(spark, tables, kind):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (6, 0)], "doc_id long, toxic int")
    model = toxicity.fit(tables[kind].join(labels, "doc_id"))
    scored = toxicity.score(tables[kind], model)
    rows = scored.collect()
    assert scored.columns == [c for c in tables[kind].columns if c not in ("text", "score")] + ["score"]
    assert kind != "clash" or all(r.marks == r.features == r.row == "x" for r in rows)
    assert len(rows) == (0 if kind == "empty" else len(ROWS)) and all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("kind", KINDS)
def test_substring(tables, kind):
    rows = substring.remove_repeats(tables[kind]).collect()
    assert len(rows) == (0 if kind == "empty" else len(ROWS))
    if rows:
        by = {r.doc_id: r for r in rows if r.doc_id is not None}
        assert (by[1].n_words, by[1].n_removed) == (14, 0) and (by[2].n_removed, by[2].kept_text) == (14, "")
        assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and by[6].kept_text == LONG


@pytest.mark.parametrize("kind", KINDS)
def test_simhash(tables, kind):
    rows = simhash.near_duplicates(tables[kind]).collect()
    assert len(rows) == (0 if kind == "empty" else len(ROWS))
    if rows:
        by = {r.doc_id: r for r in rows if r.doc_id is not None}
        assert by[2].component_id == 1 and by[4].component_id == by[5].component_id == 3 and by[3].fingerprint == "0" * 16


@pytest.mark.parametrize("kind", KINDS)
def test_near_copies(tables, kind):
    rows = simhash.drop_near_copies(tables[kind])
    assert rows.columns == tables[kind].columns
    ids = sorted(str(r.doc_id) for r in rows.collect())
    assert ids == ([] if kind == "empty" else ["1", "3", "6", "7", "8", "None"])  # one text without words stays


@pytest.mark.parametrize("kind", KINDS)
def test_decontamination(spark, tables, kind):
    bench = spark.createDataFrame([(1, "nine ten eleven twelve thirteen fourteen"), (2, None), (None, "x y z w"), (3, ""), (4, "two three")], "item_id long, text string")
    found = decontam.contaminated(tables[kind], bench).collect()
    assert sorted((r.doc_id, r.item_id, r.covered) for r in found) == ([] if kind == "empty" else [(1, 1, 6), (2, 1, 6), (2, 1, 6)])
    assert decontam.drop_contaminated(tables[kind], bench).count() == (0 if kind == "empty" else len(ROWS) - 3)
    assert decontam.contaminated(tables[kind], bench.where("false")).count() == 0


@pytest.mark.parametrize("kind", KINDS)
def test_packing(tables, kind):
    rows = packing.pack_documents(tables[kind], capacity=64).collect()
    docs = [r for r in rows if r.start == 0]
    assert len(docs) == (0 if kind == "empty" else len(ROWS))
    assert all(len(r.ids) == r.length <= 64 for r in rows)


@pytest.mark.parametrize("kind", KINDS)
def test_token_files(spark, tables, kind, tmp_path):
    tokenstore.write_tokens(tables[kind], str(tmp_path / "t"))
    rows = tokenstore.read_tokens(spark, str(tmp_path / "t")).collect()
    assert len(rows) == (0 if kind == "empty" else len(ROWS))
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert all(r.ids[-1] == 2 and len(r.ids) == r.n_tokens for r in rows)


@pytest.mark.parametrize("kind", KINDS)
def test_sharding(tables, kind):
    rows = sharding.assign_shards(tables[kind]).collect()
    assert len(rows) == (0 if kind == "empty" else len(ROWS))
    for n in range(16):
        own = sorted(r.slot for r in rows if r.shard == n)
        assert own == list(range(len(own)))
    assert all(r.grown_shard in (r.shard, 16) for r in rows)


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://Example.COM/en/x?q#f"), (5, "x://"), (6, "x://com?/"), (6, "x://a..com/"), (7, "x://net/fr/"), (8, "://www.example.com/en/")], "page_id long, url string"
    ).withColumns({"host": F.lit(1), "rule": F.lit(2)})
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/fr/")]
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in urlfilter.judge_urls(pages, rules).collect()}
    assert got[(1, "", "")] == got[(3, "", "")] == got[(5, "", "")] == (None, "allow")
    assert got[(4, "example.com", "/en/x")] == ("example.com/en/", "block") and got[(6, "com", "")] == (None, "allow")
    assert got[(6, "a..com", "/")] == ("com/", "allow") and got[(7, "net", "/fr/")] == ("net/fr/", "block") and got[(8, "www.example.com", "/en/")] == ("www.example.com/en/", "allow")
    assert urlfilter.judge_urls(pages.where("false"), rules).count() == 0


def test_nearest(spark):
    rows = [(i, [math.sin(i * j + 1) for j in range(1, 9)], 0) for i in range(120)] + [(200 + i, [1.0] * 8, 0) for i in range(60)]
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] * 8, 0), (303, [None] * 8, 0), (304, [1.0] * 3, 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit(1))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 60, 80, 100, 200, 220, 240}
    assert [v for _, v, _ in sorted(got[220])] == [200 + i for i in range(20)]
    assert all([n for n, _, _ in sorted(v)] == list(range(1, 21)) for v in got.values())
    assert ann.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_of_repeated_ids_and_a_hot_vector(spark):
    """Rows with one id are one vector, the smallest; a third of all rows have one vector."""
    rows = [(i, [float(i % 7), 1.0, float(i % 11)]) for i in range(300)] + [(i, [2.0, 2.0, 2.0]) for i in range(300, 450)]
    repeated = [rows[0], rows[20], rows[20], (40, [9.0, 1.0, 9.0]), rows[301], (320, [2.0, 2.0, 3.0])]
    table = spark.createDataFrame(rows + repeated, "vec_id long, embedding array<double>")
    held = {}
    for i, v in rows + repeated:
        held[i] = min(held.get(i, v), v)
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in held if i % 20 == 0}
    for i, found in got.items():
        best = sorted((-sum(x * y for x, y in zip(held[i], v)), j) for j, v in held.items() if j != i)[:20]
        assert [(j, -s) for s, j in best] == [(j, s) for _, j, s in sorted(found)]


@pytest.mark.parametrize("kind", KINDS)
def test_stages(spark, tables, kind, tmp_path):
    """Every stage of the pipeline on its own: columns and other values stay."""
    import corpus_pipeline

    spark.createDataFrame([(1, "seven eight nine ten eleven twelve"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    own = [c for c in CLASH if kind == "clash"]
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, tables[kind], str(tmp_path))
        rows = left.collect()
        if name == "packing":
            assert len([r for r in rows if r.start == 0]) == tables[kind].count()
            continue
        assert left.columns == tables[kind].columns and all(r[c] == "x" for r in rows for c in own)
        texts = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows)
        if kind == "empty":
            assert not rows
        elif name == "language_id":
            assert {r.doc_id for r in rows} >= {1, 2, 6} and all(any(c.isalpha() for c in r.text) for r in rows)
        elif name == "near_dedup":
            assert len(rows) == 6 and {r.doc_id for r in rows} == {1, 3, 6, 7, 8, None}
        elif name == "substring_dedup":
            assert len(rows) == len(ROWS) - 2 and [t for t in texts if t[1] in (1, 2)] == [(False, 1, ROWS[0][1])]
        else:
            assert len(rows) == len(ROWS) - 3 and {r.doc_id for r in rows} == {3, 4, 5, 6, 7, 8, None}
