"""Token counts by a map-side two-tier lookup (operator 8).

Tier one: a bounded table of frequent pre-tokens with their token lengths, broadcast. Tier two: each Python worker
encodes what it misses, a batch of new pre-tokens at a time, and keeps the lengths in a bounded cache. Pre-tokens are
never shuffled. Texts with a special token's string or characters outside the range on which the pre-token pattern was
verified go to the tokenizer whole, so every count is the library's own.

Defined cases: null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern that the tokenizer file states.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Outside the characters on which the pattern and lower-casing were verified to agree (Latin, Greek without capital
#: sigma, Cyrillic, kana, ideographs, Hangul syllables, common marks, emoji), or in a special token's string.
_ODD = re.compile("[^\t\n\r -~¡-¬®-įı-žΆΈ-ΊΌΎ-ΡΤ-ΫΆ-ώЀ-џ–—‘-„…€、。ぁ-ゖァ-ヺ一-龥가-힣\U0001f300-\U0001f5ff\U0001f600-\U0001f64f]|<\\|")
_MOST_CACHED = 300_000
_worker: dict = {}


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    if _worker.get("path") != path:
        _worker.clear()
        _worker.update(path=path, tokenizer=Tokenizer.from_file(path), cache={})
    return _worker["tokenizer"]


def _findall():
    import regex

    return regex.compile(_PATTERN).findall


def frequent_lengths(docs: DataFrame, path: str, sample_docs: int, most: int) -> dict[str, int]:
    """The frequent tier from the whole texts of sample_docs ids, drawn by hash: speed depends on it, results don't."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ids = own.select(F.col("doc_id").alias("drawn")).where("drawn IS NOT NULL").distinct().orderBy(F.xxhash64("drawn"), "drawn").limit(sample_docs)
    drawn = own.join(F.broadcast(ids), F.col("doc_id") == F.col("drawn"), "left_semi").select("text")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        findall = _findall()
        for batch in batches:
            n = Counter(w for x in batch.column(0) for w in findall((x.as_py() or "").lower()) if not _ODD.search(w))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    words = drawn.mapInArrow(found, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most).select("word")
    words = [r[0] for r in words.collect()]
    return dict(zip(words, map(len, _tokenizer(path).encode_batch(words, add_special_tokens=False)), strict=True))


def token_counts(docs: DataFrame, path: str, limit: int = 2048, sample_docs: int = 500, most: int = 32_768) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit. path: a tokenizers file with the pattern above."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_lengths(docs, path, sample_docs, most))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, findall, first = _tokenizer(path), _findall(), table.value
        for batch in batches:
            cache = _worker["cache"]
            if len(cache) > _MOST_CACHED or not cache:
                cache.clear()
                cache.update(first)
            texts = [x.as_py() or "" for x in batch.column(1)]
            split = [None if _ODD.search(x) else findall(x.lower()) for x in texts]
            new = list({w for s in split if s for w in s if w not in cache})
            for i in range(0, len(new), 10_000):
                part = new[i : i + 10_000]
                cache.update(zip(part, map(len, tokenizer.encode_batch(part, add_special_tokens=False)), strict=True))
            get = cache.__getitem__
            n = [len(tokenizer.encode(x, add_special_tokens=False)) if s is None else sum(map(get, s)) for x, s in zip(texts, split, strict=True)]
            n_bytes = [len(x) if x.isascii() else len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
