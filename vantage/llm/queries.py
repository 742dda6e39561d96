"""The operators' queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm import alignment, ann, bpe, decontam, langid, packing, periodic, sharding, simhash, substring, tokenstore, toxicity, urlfilter
from vantage.llm.common import shared_dir

#: Fixed rules of the url query: action, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, use=_fold(3) != 1)
    return langid.identify(docs.select("doc_id", "text"), model, spans=False).select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit_joined(docs, labels.where(_fold(4) != 2))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), short=True)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), with_ids=False)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokenstore.write_tokens(_table(spark, sf_dir, "documents"), path)
    return tokenstore.read_tokens(spark, path, with_ids=False)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def _with_runs_planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: where crc32(doc_id) % 10 is 0, the words from the a-th on repeat the first p of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        root = F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(root), F.lit(1), n - a)), " "))

    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, repeated)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(_with_runs_planted(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    greater = lambda x, y: F.when(y.isNull() | (x["length"] * y["period"] > y["length"] * x["period"]), x).otherwise(y)
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.aggregate("runs", none, lambda best, run: greater(run, best))  # of ties the first by start, then period
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_table(spark, sf_dir, "documents"), parts=("packed", "decoded"))
    return coded.select(
        "doc_id", F.floor(F.octet_length("packed") / 4).alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_toxicity": op2_toxicity,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_simhash": op4_simhash,
        "op5_decontamination": op5_decontamination,
        "op6_packing": op6_packing,
        "op7_ann": op7_ann,
        "op8_token_files": op8_token_files,
        "op9_url_filter": op9_url_filter,
        "op10_sharding": op10_sharding,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_byte_bpe": op12_byte_bpe,
        "op13_alignment": op13_alignment,
    }


_RULES = ", ".join(f"('{action}', '{host}', '{path}')" for action, host, path in URL_RULES)


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
windows AS (
  SELECT doc_id, i, count(*) OVER ahead AS n, string_agg(word, ' ') OVER ahead AS s FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
),
firsts AS (SELECT s, min(doc_id) AS first FROM windows WHERE n = 13 GROUP BY s),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE n = 13 AND doc_id > first),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hits, range(13) t(k)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
""",
        "op9_url_filter": rf"""
WITH rules(action, rule_host, rule_path) AS (VALUES {_RULES}),
rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
),
fits AS (
  SELECT p.page_id, p.host, p.path, rule_host || rule_path AS rule, action,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS n
  FROM parts p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE n = 1
""",
    }
