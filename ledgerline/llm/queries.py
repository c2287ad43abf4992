"""The registered query of each operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, extract, hpylm, langid, neardup, packing, secrets, shards, substrings
from .tables import load


def remainder(n: int):
    """crc32(doc_id as text) mod n; null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def tokenizer_file() -> str:
    """The vocabulary file that packing counts tokens by."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that leaked into a document."""
    return decontam.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract.extract(load(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under a model of those of remainder other than 2."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return hpylm.score(docs.withColumn("held_out", F.coalesce(remainder(7) == 2, F.lit(False))))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack(load(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document: five-word shingles, similarity 0.8 or more."""
    found = neardup.classes(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("is_first"))


def op6_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found by inner product of every vector whose id 20 divides."""
    return ann.search(load(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage of 20 words or more, single lines included, with its offsets and the document that keeps it."""
    found = substrings.repeats(load(spark, sf_dir, "documents").select("doc_id", "text"), min_words=20)
    return found.select("doc_id", "start", "end", "n_words", "first_doc_id")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: pattern counts and digest, and all spans."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.find_secrets(docs, drop_text=True).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cnn")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of near-equal bytes; equal texts stay together."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    sized = docs.select("doc_id", "text", (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    placed = shards.shard(sized, "text", 16, carry=["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by PPM code length, learned from rows of remainder 1 to 4."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("_fold", remainder(5))
    learn = docs.filter(F.col("_fold") != 0).select("doc_id", "text", "lang")
    named = langid.identify(docs.select("doc_id", "text", F.coalesce(F.col("_fold") == 0, F.lit(False)).alias("held_out")), learn)
    return named.select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_html_extraction": op2_html_extraction,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_packing": op4_packing,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_ann_search": op6_ann_search,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_sharding": op9_sharding,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {}
