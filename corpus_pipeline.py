"""A corpus pipeline of the llm operators: rules, near copies, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage's rows as
Parquet in the shared folder and reads them again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm import mixing, ngram_join, packing, quality_rules, suffix_dedup
from tarnwick.llm.common import discard, documents, materialize, scope


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]


def _hash() -> Column:
    return F.xxhash64(F.col("text").cast("binary"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a row is told by doc_id, source and text, so null and repeated ids are judged apart."""
    kept = quality_rules.quality_rules(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("source").alias("kept_source"), F.col("text_hash").alias("kept_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & F.col("source").eqNullSafe(F.col("kept_source")) & (F.col("hash") == F.col("kept_hash"))
    return docs.select(*_columns(docs)).withColumn("hash", _hash()).join(kept, same, "left_semi").select(*_columns(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the text of least doc_id, then text hash; rows are told by doc_id and text.

    A group of null ids alone keeps one text; of rows without a word each doc_id, null included, keeps each text once.
    """
    first = ngram_join.join(docs, with_first=True).where("is_first").select(F.col("doc_id").alias("first_id"), F.col("text_hash").alias("first_hash"))
    kept = docs.select(*_columns(docs)).join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (_hash() == F.col("first_hash")), "left_semi").select(*_columns(docs))
    return kept.dropDuplicates(["doc_id", "text"])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings of 200 bytes or more that stand elsewhere too; documents left without a word go.

    A row is told by its doc_id and whole text; after the stage before, these pairs are unique.
    """
    cut = suffix_dedup.dedup(docs, with_text=True).select(F.col("doc_id").alias("cut_id"), F.col("n_removed"), "kept_text", "text_sha256")
    whole = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    rest = docs.select(*_columns(docs)).withColumn("whole", whole).join(cut, F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("whole") == F.col("text_sha256")))
    rest = rest.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.length("text").cast("long"))
    return rest.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*_columns(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mixing.mix(docs).where("copies > 0").groupBy(F.col("doc_id").alias("mixed_id"), F.col("source").alias("mixed_source"), "text_hash").agg(F.max("copies").alias("copies"))
    rows = docs.select(*_columns(docs)).withColumn("hash", _hash()).join(taken, F.col("doc_id").eqNullSafe(F.col("mixed_id")) & F.col("source").eqNullSafe(F.col("mixed_source")) & (F.col("hash") == F.col("text_hash")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*_columns(docs))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", rules),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("source mixing", source_mix),
    ("packing", windows),
]

#: Subword ids and suffix arrays are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's own tables and its input go once its rows are written."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        with scope():
            rows = stage(spark, docs, sf_dir)
            kept, docs = docs, materialize(rows, "pipeline-" + name.replace(" ", "-"), lasting=True)
        discard(kept)
    return docs
