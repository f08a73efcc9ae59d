"""From documents to token ids: quality rules, near-duplicates, repeated passages, benchmark leaks, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written as Parquet and
read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topolidar.llm import bpe, shared, simhash
from topolidar.llm.chunks import dedup_substrings
from topolidar.llm.contamination import contamination
from topolidar.llm.quality import quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
RANKS = "byte_bpe_multi_50k.tiktoken"

#: SimHash, gear hashes and BPE have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, keep=COLUMNS[1:]).where("kept").select(COLUMNS)


def _mark() -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``docs`` but those that ``found`` (doc_id, mark) names: by id, null ids too, and the text's hash, so that of
    rows that share an id each is judged for its own text."""
    named = found.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    marked = docs.select(COLUMNS).withColumn("mark", _mark())
    return marked.join(named, marked["doc_id"].eqNullSafe(F.col("_id")) & (marked["mark"] == F.col("_mark")), "left_anti").drop("mark")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that repeat, in five-word shingles at a similarity of 0.8 or more, one that stays."""
    found = shared.written(simhash.near_duplicates(docs, words=5, radius=6, similarity=0.8), "duplicates")
    kept = _without(docs, found)
    several = found.where("stays")
    if several.isEmpty():
        return kept
    marked = docs.select(COLUMNS).withColumn("mark", _mark())
    named = several.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    one = marked.join(named, marked["doc_id"].eqNullSafe(F.col("_id")) & (marked["mark"] == F.col("_mark")), "left_semi").dropDuplicates(["doc_id", "mark"])
    return kept.union(one.select(COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that earlier documents have; a document of nothing else goes."""
    found = dedup_substrings(docs, keep=["lang", "source"]).withColumn("n_chars", F.length("text").cast("long"))
    left = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]")) > 0
    return found.where((F.col("removed_bytes") == 0) | left).select(COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    found = contamination(docs.withColumn("mark", _mark()), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10, keep=["mark"])
    return _without(docs, found.where("n_hit > 0").select("doc_id", "mark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether decoding them gives the text's bytes back."""
    both = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=["lang", "source", "text"], round_trip=True)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
