"""Runs, byte-level BPE and tokenizer alignment against brute force and the tokenizers' own libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vantage.llm import alignment, bpe, periodic, queries

SF = "/root/testdata/sf0.001"
NEWER = "࢏꟏\U0001c8a0"  # letters of Unicode versions that libraries may not know
TEXTS = [
    None, "", " ", "\n\t ", "a", "to be or not to be", "x▁y", "a\x00b c 　d", "don't we'll I'D", "<|endoftext|> <s></s><unk> <0x41>",
    "Приветствие \U0001f600 é 中文字符 한국어", NEWER + " a" + NEWER + "1 " + NEWER, "กำั" * 9, "=" * 700 + " " * 300 + "\n" * 50, "abcabcab" * 40,
    "qzxvkjw" * 30 + "ÀÉÎõü" * 30, "one two one two one two one two one two", "so " * 9, "no \x0b\x0c no no " * 8, "two times\r\n" * 2, "word " * 30_000,
]


def brute_runs(words, min_length=6, min_exponent=4):
    row, out = np.unique(np.array(words, object), return_inverse=True)[1] if len(words) else np.zeros(0, int), []
    for p in range(1, len(row) // min_exponent + 1):
        same = np.concatenate([[0], row[p:] == row[:-p], [0]])
        step = np.diff(same.astype(int))
        for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)):
            s, e = int(s), int(e) + p
            if e - s >= max(min_length, min_exponent * p) and not any(p % q == 0 and (row[s : e - q] == row[s + q : e]).all() for q in range(1, p)):
                out.append((s, e - s, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digest(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5]), (None, "on and on and on and on and on"), (None, None)]
    full = spark.createDataFrame(rows, "doc_id long, text string")
    clash = full.withColumns({c: F.lit("x") for c in ("words", "docs", "ids", "units", "runs", "block", "pair", "pairs", "links", "count", "best", "n", "at", "found", "groups", "n_a")})
    out = {}
    for name, df in {"documents": full, "clash": clash, "empty": full.where("false")}.items():
        path = str(tmp_path_factory.mktemp("t") / f"{name}.parquet")
        df.repartition(3).write.parquet(path)
        out[name] = (spark.read.parquet(path), path.rsplit("/", 1)[0])
    return out


@given(st.lists(st.tuples(st.lists(st.integers(1, 3), min_size=1, max_size=9), st.integers(1, 6)), max_size=8), st.sampled_from([2, 3, 4, 5]), st.sampled_from([1, 2, 6]))
@settings(deadline=None, max_examples=300)
def test_runs_are_all_runs(parts, exponent, length):
    words = [w for base, n in parts for w in base * n]
    assert periodic.runs_of(words, length, exponent) == brute_runs(words, length, exponent)


def test_long_repeats_and_colliding_hashes(monkeypatch):
    for base, n in (([1], 100_000), ([1, 2], 50_000), ([1] * 50 + [2], 2_000)):
        runs = periodic.runs_of(base * n)
        assert (0, len(base) * n, len(base)) in runs
    one, two = [1], [1, 2]
    while len(two) < 3_000:
        one, two = two, two + one
    assert periodic.runs_of(two, 6, 3) == brute_runs(two, 6, 3)
    monkeypatch.setattr(periodic, "mixed", lambda h: np.zeros_like(h))  # every stretch looks like every other
    for seed in range(20):
        words = [w for _ in range(20) for w in [random.Random(seed * 99 + _).randint(1, 2) for _ in range(12)] * 5]
        assert periodic.runs_of(words) == brute_runs(words)


def check_runs(rows, texts):
    assert len(rows) == len(texts)
    want = Counter()
    for doc_id, text in texts:
        words = planted(doc_id, (text or "").encode().split())
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        drop = periodic.dropped(len(words), runs)
        assert drop.tolist() == [any(s + p <= i < s + n for s, n, p in runs) for i in range(len(words))] if len(words) < 3_000 else True
        kept = b" ".join(w for w, d in zip(words, drop) if not d)
        want[(doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{n},{p}\n" for s, n, p in runs)), digest(kept))] += 1
    assert Counter(tuple(r) for r in rows) == want


def test_runs_of_documents(spark, tables):
    for frame, folder in (tables["documents"], (spark.read.parquet(f"{SF}/documents.parquet"), SF)):
        rows = queries.op11_periodic_runs(spark, folder).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
        check_runs(rows, [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()])


def test_bpe_is_the_librarys(spark, tables):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.vocabulary_path()), special_tokens={})
    for frame, folder in (tables["documents"], (spark.read.parquet(f"{SF}/documents.parquet"), SF)):
        want = Counter()
        for doc_id, text in frame.select("doc_id", "text").collect():
            ids = own.encode_ordinary(text or "")
            want[doc_id, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(text or "")] += 1
        rows = queries.op12_byte_bpe(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
        assert Counter(map(tuple, rows)) == want


def test_words_of_a_block_merge_together(spark):
    """All words of a block at once, by arrays in the task: no fold of expressions, node by node, in the plan."""
    path = bpe.vocabulary_path()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(3)
    words = ["".join(rng.choices("aabcdeé語\U0001f600ßxyz", k=rng.randint(1, 40))) for _ in range(800)] + ["a" * 5_000, "ab" * 3_000, "", "z"]
    ids, sizes = bpe.Merges(bpe.read_ranks(path), bpe.ROUNDS_FROM).ids([w.encode() for w in words])
    ends = np.cumsum(sizes)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes)] == [own._core_bpe.encode_single_piece(w.encode()) if w else [] for w in words]
    coded = bpe.encode(spark.createDataFrame([(1, "some words")], "doc_id long, text string"))
    assert "aggregate(" not in coded._jdf.queryExecution().optimizedPlan().toString()


def test_long_words_merge_as_short_ones(spark, monkeypatch, tables):
    """Joint merges are right on small vocabularies with ranks in any order, where some have to wait."""
    rng = random.Random(5)
    for trial in range(4):
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 290:
            tokens.add(rng.choice([t for t in sorted(tokens) if set(t) <= set(b"ab")]) + rng.choice([t for t in sorted(tokens) if set(t) <= set(b"ab")]))
        order = sorted(tokens, key=lambda t: (len(t) > 1, rng.random()))
        ranks = {t: i for i, t in enumerate(order)}
        monkeypatch.setattr(bpe, "read_ranks", lambda path, ranks=ranks: ranks)
        monkeypatch.setattr(bpe, "ROUNDS_FROM", 3)
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        texts = [" ".join("".join(rng.choices("ab", k=rng.randint(1, 30))) for _ in range(30)) for _ in range(5)] + ["a" * 40, "ab" * 20]
        rows = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        assert {r.doc_id: r.ids for r in rows} == {i: own.encode_ordinary(t) for i, t in enumerate(texts)}


def brute_alignment(texts):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet, docs = alignment.byte_alphabet(), []
    for doc_id, text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        parts_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
        parts_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(parts_a) == b"".join(parts_b) == b" " + text.encode():
            docs.append((doc_id, [], [], [], ""))
            continue
        links, groups, i, j, at_a, at_b = [], [([], [])], 0, 0, 0, 0
        while i < len(ids_a):
            links.append((ids_a[i], ids_b[j]))
            end_a, end_b = at_a + len(parts_a[i]), at_b + len(parts_b[j])
            if end_a <= end_b:
                groups[-1][0].append(ids_a[i])
                i, at_a = i + 1, end_a
            if end_b <= end_a:
                groups[-1][1].append(ids_b[j])
                j, at_b = j + 1, end_b
            if end_a == end_b:
                groups.append(([], []))
        groups.pop()
        docs.append((doc_id, ids_a, ids_b, links, ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)))
    counts = Counter(pair for d in docs for pair in set(d[3]))
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    return Counter(
        (d, len(x), len(y), text.count(";") + 1 if text else 0, len(links), sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links), digest(text) if text else "")
        for d, x, y, links, text in docs
    )


def test_alignment_of_documents(spark, tables):
    for frame, folder in (tables["documents"], (spark.read.parquet(f"{SF}/documents.parquet"), SF)):
        rows = queries.op13_alignment(spark, folder).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
        assert Counter(map(tuple, rows)) == brute_alignment([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()])


def test_alignment_in_small_blocks(spark, monkeypatch, tables):
    """Blocks of a document each give what whole batches do."""
    frame = tables["documents"][0]
    columns = ["doc_id", "n_links", "n_best", "count_sum", "groups"]
    whole = Counter(map(tuple, alignment.align(frame).select(*columns).collect()))
    assert any(r[-1].startswith("1462|") or ";" in r[-1] for r in whole)
    pair = alignment._pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    texts = [t for t in TEXTS]
    together = alignment.align_texts(pair, texts, False)
    apart = [alignment.align_texts(pair, [t], False) for t in texts]
    assert together["links"].tolist() == [x for one in apart for x in one["links"].tolist()]
    for name in ("n_a", "n_b", "n_groups", "n_links", "groups"):
        assert list(together[name]) == [one[name][0] for one in apart]


@pytest.mark.parametrize("kind", ["clash", "empty"])
def test_clashes_and_nothing(spark, tables, kind):
    frame, full = tables[kind][0], tables["documents"][0]
    for run in (periodic.find_runs, bpe.encode, alignment.align):
        rows = run(frame).collect()
        assert len(rows) == (0 if kind == "empty" else full.count())
        if rows:
            assert Counter(map(repr, rows)) == Counter(map(repr, run(full).collect()))


@given(st.text("aB'sllTÀéß 12.,!\n\t\r", max_size=50) | st.text(max_size=20))
@settings(deadline=None, max_examples=300)
def test_words_of_a_are_the_librarys(text):
    pair = alignment._pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert pair.encode_a(text).tolist() == pair.a.encode(" " + text, add_special_tokens=False).ids


def test_decode_of_null_and_unknown(spark):
    rows = spark.createDataFrame([([0, 60_000, 1],), (None,), ([],)], "ids array<int>").select(bpe.decode(F.col("ids")).alias("b")).collect()
    assert [r.b if r.b is None else bytes(r.b) for r in rows] == [b"!\"", None, b""]


def test_events_of_ids_are_counted_as_they_come():
    """Contexts and events of a chunk by plain loops, with blocks of two sizes and ids too rare for a number."""
    from vantage.llm import rangecoder as R

    rng = np.random.default_rng(3)
    ids = np.r_[np.minimum(rng.geometric(0.05, R.BLOCK + 700), 60), np.arange(900, 1000), np.tile([5, 6, 7, 8, 9], 40), 3].astype(np.uint32)
    sizes, (head, line) = R._sizes(len(ids)), R.numbered(ids)
    assert len(sizes) == 2 and sizes[0] == sizes[1] + 1 and head.rare
    kinds, known, wanted = head.all_kinds, len(head.ids), np.zeros(R.CONTEXTS * R.EVENTS, np.int64)
    for part in (line[: sizes[0]], line[sizes[0] :]):
        tables = [[(0, 0)] * R.SLOTS for _ in range(2)]
        one = two = kind = 0
        for now in part.tolist():
            spots = [one * 40503 >> 4 & R.SLOTS - 1, one * 40503 + two * 30011 >> 3 & R.SLOTS - 1]
            (guess1, sure1), (guess2, sure2) = (t[s] for t, s in zip(tables, spots))
            event = R.SECOND if guess2 == now != known else R.FIRST if guess1 == now != known else int(kinds[now])
            wanted[((sure2 << 2 | sure1) * R.CLASSES + kind) * R.EVENTS + event] += 1
            for table, spot, guess, sure in zip(tables, spots, (guess1, guess2), (sure1, sure2)):
                table[spot] = (guess, min(3, sure + 1)) if guess == now else (guess, sure - 1) if sure else (now, 0)
            two, one, kind = one, now, int(kinds[now])
    head, blocks = R.encode_blocks(ids)
    assert (R.Head.unpacked(head).events == R._rough(wanted)).all()
    assert (R.decode_blocks(head, blocks, len(ids)) == ids).all()


def test_packing_leaves_no_words_in_its_worker(spark):
    """Workers live on through the other stages of a pipeline, whose memory the words would take."""
    from vantage.llm import packing, tokens

    docs = spark.createDataFrame([(i, f"word{i} and others") for i in range(50)], "doc_id long, text string").coalesce(1)

    def held(batches):
        import pyarrow as pa

        n = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_pydict({"rows": [n], "held": [sum(map(len, tokens._known.values()))]})

    row = packing.pack_documents(docs, with_ids=False, keep_words=False).mapInArrow(held, "rows long, held long").first()
    assert row.rows >= 50 and row.held == 0
