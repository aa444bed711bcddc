"""Quality rules with host-level verdicts (operator 10).

Per document: counts of words, symbols, repeated lines and repeated 3-word windows, and rules on them.
Per host: rule failures are counted over all its documents and the rate is shrunk towards the corpus with a beta
prior fitted to the hosts' own rates (method of moments, sampling noise taken off). The host verdict goes back to the documents:

* a document that fails a base rule is rejected, whatever its host;
* a host whose shrunk rate is at least ``bad`` and above the prior by ``apart`` of its standard deviations is rejected;
* else the soft rules decide, their limits scaled by the host's standing, prior mean / shrunk rate: a host that fails
  half as often as the corpus may have twice the symbols, repeated lines and so on, one that fails more has less.

So every host's rate moves its documents' limits, in proportion and without a switch; at the corpus rate they are as
stated. A clean document is rejected with its host alone.

Defined cases: null or empty text has no words and fails the base rule; a null source is a host of its own; repeated
rows count as often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_NOT_CHARS = _SPACE + bytes(range(0x80, 0xC0))
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_LOWER = bytes(c for c in range(256) if not 97 <= c <= 122)
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower")


def repeated_words(words: list) -> int:
    """Words that lie in a 3-word window that occurs at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
    v = len(index)
    pair = ids[:-1] * v + ids[1:]
    if v > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * v + ids[2:]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(key, twice))
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[starts + k] = True
    return int(hit.sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    b = text or b""
    words = b.split()
    lines = [x for x in b.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(b.translate(None, _NOT_CHARS)),
        len(b) - len(b.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(b.translate(None, _NOT_UPPER)),
        len(b.translate(None, _NOT_LOWER)),
    )


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([measure(x.as_py()) for x in batch.column(2)], np.int64).reshape(-1, len(_COUNTS))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(3), *(pa.array(rows[:, i]) for i in range(len(_COUNTS)))],
            names=["doc_id", "source", "text_hash", *_COUNTS],
        )


def features(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash, the counts, base_failed and soft_failed of every document."""
    counted = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("binary"), F.xxhash64(F.col("text").cast("binary"))).mapInArrow(
        _measure_batches, "doc_id long, source string, text_hash long, " + ", ".join(f"{c} long" for c in _COUNTS)
    )
    n = F.col("n_words")
    base = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    return counted.withColumn("base_failed", base).withColumn("soft_failed", soft_rules(F.lit(1.0)))


def soft_rules(scale: Column) -> Column:
    """Whether a count exceeds its limit times scale: a tenth of the words in symbols, 30 % of the lines repeated,
    more upper than lower case, 15 characters a word."""
    n = F.col("n_words") * scale
    return (10 * F.col("n_symbols") > n) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines") * scale) | (F.col("n_upper") > F.col("n_lower") * scale) | (F.col("word_chars") > 15 * n)


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Moments of the hosts' failure rates, weighted by documents, as (mean, strength): alpha + beta is the strength.

    Of the rates' variance, the share that binomial sampling alone would give is taken off (beta-binomial moments), so
    hosts that differ by no more than chance have an infinite strength: each is taken at the corpus rate.
    hosts: n, failed.
    """
    rate = F.col("failed") / F.col("n")
    m = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("f"), F.sum(F.col("n") * rate * rate).alias("sq"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.count("*").alias("hosts")).first()
    if not m["n"]:
        return 0.5, 2.0
    mean = (m["f"] + 0.5) / (m["n"] + 1.0)
    variance = m["sq"] / m["n"] - (m["f"] / m["n"]) ** 2
    noise = (m["hosts"] - 1) / m["n"]
    between, most = variance - noise * mean * (1 - mean), mean * (1 - mean) * (1 - m["nn"] / m["n"] / m["n"] - noise)
    return mean, (max(most / between - 1, 0.0) if between > 0 and most > 0 else math.inf)


def quality_rules(docs: DataFrame, bad: float = 0.5, apart: float = 2.0) -> DataFrame:
    """docs(doc_id, source, text) -> doc_id, the counts, base_failed, kept, soft_failed, host_rate, host_scale, host_bad, source, text_hash."""
    rows = materialize(features(docs), "quality-rules")
    hosts = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("failed"))
    mean, strength = beta_prior(hosts)
    rate = F.lit(mean) if math.isinf(strength) else (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    # A host without a failure, in a table whose prior has no strength, is as good as one with half a failure.
    verdicts = hosts.select(F.col("source").alias("host"), F.greatest(rate, F.lit(0.5) / (F.col("n") + 1)).alias("host_rate"))
    deviation = (mean * (1 - mean) / (strength + 1)) ** 0.5
    verdicts = verdicts.withColumn("host_scale", F.lit(mean) / F.col("host_rate"))
    verdicts = verdicts.withColumn("host_bad", (F.col("host_rate") >= bad) & (F.col("host_rate") > mean + apart * deviation))
    kept = ~F.col("base_failed") & ~F.col("host_bad") & ~soft_rules(F.col("host_scale"))
    return rows.join(verdicts, rows["source"].eqNullSafe(verdicts["host"]), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "soft_failed", "host_rate", "host_scale", "host_bad", "source", "text_hash"
    )
