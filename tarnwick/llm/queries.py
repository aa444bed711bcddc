"""The subpackage's queries, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_ann, chat_format, fill_in_middle, lattice_lm, merkle, mixing, ngram_join, packing, quality_knn, quality_rules, suffix_dedup, token_counts, toxicity
from .common import documents
from .oracles import CHAT_FORMAT, FILL_IN_MIDDLE, MERKLE, NGRAM_JOIN, QUALITY_RULES, SOURCE_MIXING


def _tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir))


def op2_additive_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_karmarkar_karp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), _tokenizer_file("byte_bpe_50k.json"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir), words=3, percent=90)


def op6_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.lattice_scores(documents(spark, sf_dir), _tokenizer_file("piece_bpe_32k.model"))


def op7_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), _labels(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), _tokenizer_file("word_bpe_49k.json"))


def op9_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.quality(documents(spark, sf_dir), _labels(spark, sf_dir))


def op10_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    check = {"text": F.when(half, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    m = merkle.manifest(documents(spark, sf_dir), check=check)
    return m.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fill_in_middle.fill_in_middle(documents(spark, sf_dir))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    restored = fill_in_middle.restore(F.col("output"), F.col("form"))
    return d.select("doc_id", "n", "form", chars("prefix"), chars("middle"), sha(F.col("output")).alias("output_sha256"), sha(restored).alias("restored_sha256"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose two turns hold control strings."""
    own = spark.createDataFrame([(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.read_back(chat_format.chat_format(turns))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_suffix_array_dedup, op2_additive_neighbours, op3_karmarkar_karp_packing, op4_source_mixing, op5_ngram_jaccard_join, op6_lattice_likelihood, op7_pu_toxicity, op8_token_counts, op9_quality_neighbours, op10_host_quality_rules, op11_merkle_manifest, op12_fill_in_middle, op13_chat_format)
}

SQL: dict[str, str] = {"op4_source_mixing": SOURCE_MIXING, "op5_ngram_jaccard_join": NGRAM_JOIN, "op10_host_quality_rules": QUALITY_RULES, "op11_merkle_manifest": MERKLE, "op12_fill_in_middle": FILL_IN_MIDDLE, "op13_chat_format": CHAT_FORMAT}
