"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, langid, mixing, negatives, packing, pii, resample, ring, rules, runs, topk, url_filter
from .ngram_join import jaccard_groups

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The rules of op10: verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    """The vocabulary file of op7 and the pipeline."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products for every hundredth vector, against all."""
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where("vec_id % 100 = 0"), vectors, 10)


ORACLES["op1_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s
)
SELECT * FROM r WHERE "rank" <= 10
"""


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text: the four forms, and what their contexts add."""
    return pii.find(table(spark, sf_dir, "documents"))


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of three-word shingles at a similarity of 0.9."""
    return jaccard_groups(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from two of three folds."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(documents).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cell, raked weight, probability and draw."""
    from ..session import cut_lineage

    documents = mixing.with_topics(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).drop("text")
    return mixing.mix(cut_lineage(documents))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of powers of two up to 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(), 1024, 0, with_ids=False)


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and quality verdict of every document."""
    return rules.quality(table(spark, sf_dir, "documents"))


@query
def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight and draw of every document; targets are the documents labelled good."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule, host reputation and verdict of every page's url; pages are judged by a model of the labelled documents."""
    pages = table(spark, sf_dir, "pages")
    model = url_filter.word_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return url_filter.judge(pages, URL_RULES, url_filter.learned_outcomes(pages, model)).select(
        "page_id", "host", "path", "rule", "verdict", F.round("rate", 6).alias("rate"), F.round("bound", 6).alias("bound"))


@query
def op11_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of equally many documents, by a ring with bounded loads."""
    text = F.coalesce(F.col("text"), F.lit(""))
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return ring.shard(documents, F.col("doc_id"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hop")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives and hard negatives of every hundredth vector; every seventh row has its label turned."""
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", turned.alias("label"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)


ORACLES["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_inner_product(a.w, c.w) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS "rank",
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY "rank" <= 5
"""


def repeated_tail(key: int | None, words: list[bytes]) -> list[bytes]:
    """op13's rule: for one id in ten, the words from some place on repeat a short stretch.

    A null id has no digits to hash and leaves the words as they are.
    """
    h = 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least four periods in every text, and digests of the runs and of the text without repetitions."""
    found = runs.collapse(table(spark, sf_dir, "documents"), change=repeated_tail)
    found = found.withColumn("best", runs.strongest(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(runs.runs_text(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
