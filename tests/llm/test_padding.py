"""Packing's padding over a whole table."""

from pyspark.sql import functions as F

from tarnwick.llm import packing
from tarnwick.llm.common import documents
from tarnwick.llm.queries import _tokenizer_file


def test_little_padding(spark, sf):
    """Sequences are full, a power of two, or padded to 1024; the padding is under 3 % of the tokens."""
    rows = packing.pack(documents(spark, sf), _tokenizer_file("byte_bpe_50k.json")).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(0 < r.n <= 1024 for r in rows)
    assert packing.padding(1024, 1024) == packing.padding(64, 1024) == 0 and packing.padding(1000, 1024) == 24
    assert sum(packing.padding(r.n, 1024) for r in rows) < 0.03 * sum(r.n for r in rows)
