"""Operators and stages over a table that carries every column name their code uses."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnwick.llm import chat_format, fill_in_middle, merkle, mixing, ngram_join, packing, quality_rules, suffix_dedup, token_counts
from tarnwick.llm.queries import _tokenizer_file

ROOT = Path(corpus_pipeline.__file__).parent


def names_in(*files):
    """Every lower-case name that stands as a whole string, or as an alias in a schema, in the code."""
    found = set()
    for f in files:
        found |= set(re.findall(r"[\"'(, ]([a-z][a-z_0-9]*)(?=[\"' ])", (ROOT / f).read_text()))
    return sorted(found - {"doc_id", "text", "source", "lang", "n_chars"})


def crowded(df, *files):
    names = names_in(*files)
    assert len(names) > 20
    return df.select("*", *(F.lit(7).alias(n) for n in names))


def base(spark):
    words = lambda i: " ".join(f"w{(i * 7 + k * (i % 5 + 1)) % 211}" for k in range(60 + i % 40))
    passage = " ".join(f"shared{k}" for k in range(70))
    rows = [(i, f"{words(i)}.\n{passage if i % 9 == 0 else words(i + 3)}", "en", f"host{i % 3}", 1) for i in range(60)]
    rows += [(100, rows[5][1], "en", "host1", 1), (101, None, None, None, None), (102, "", "en", "host0", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


OPERATORS = {
    "suffix_dedup": lambda d: suffix_dedup.dedup(d),
    "packing": lambda d: packing.pack(d, _tokenizer_file("byte_bpe_50k.json")).groupBy("doc_id").agg(F.sum("length").alias("n")),
    "mixing": lambda d: mixing.mix(d),
    "ngram_join": lambda d: ngram_join.join(d),
    "token_counts": lambda d: token_counts.token_counts(d, _tokenizer_file("word_bpe_49k.json")),
    "quality_rules": lambda d: quality_rules.quality_rules(d),
    "merkle": lambda d: merkle.manifest(d),
    "fill_in_middle": lambda d: fill_in_middle.fill_in_middle(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator(spark, name):
    docs, f = base(spark), OPERATORS[name]
    rows = lambda df: sorted(map(str, f(df).collect()))
    assert rows(crowded(docs, f"tarnwick/llm/{name}.py")) == rows(docs)


def test_chat_format(spark):
    turns = base(spark).selectExpr("doc_id % 5 AS conv_id", "doc_id AS turn", "source AS role", "text")
    names = [n for n in names_in("tarnwick/llm/chat_format.py") if n not in ("conv_id", "turn", "role")]
    rows = lambda df: sorted(map(str, chat_format.read_back(chat_format.chat_format(df)).collect()))
    assert rows(turns.select("*", *(F.lit(7).alias(n) for n in names))) == rows(turns)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:4])
def test_stage(spark, sf, name, stage):
    docs = base(spark)
    rows = lambda df: sorted(map(str, stage(spark, df, sf).collect()))
    assert rows(crowded(docs, "corpus_pipeline.py", "tarnwick/llm/suffix_dedup.py", "tarnwick/llm/mixing.py")) == rows(docs)
