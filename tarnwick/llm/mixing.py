"""Mixing sources to target weights with Efraimidis-Spirakis sampling (operator 4), DataFrame functions only.

Targets: sources in code-point order weigh 1, 2, 3, 1, ... and share all words; a target stops at ``most`` times the
source's words and the excess is shared again by weight (solved in closed form over the sources ordered by cap/weight).
Selection: complete epochs first; for the rest each document draws an exponential key -ln(u)/quality, and within its
source the documents of smallest key are taken while their prefix sum stays nearest to the budget.

The prefix sum never gathers a source in one task: keys fall in ``BINS`` ordered bins, bins are summed with partial
aggregation, and only the one bin in which a source's budget ends is sorted row by row.

Defined cases: null or empty text has size 0 and is taken 0 words; a null source is a source of its own, last in
order; repeated rows are separate documents; equal keys are ordered by doc_id, size and a hash of the text; u depends
on doc_id and text alone, so reruns agree and null or repeated ids of unlike texts have keys of their own; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

BINS, LOW = 4096, 0.25
#: Digits and symbols, and marks that end a sentence.
ODD, MARKS = r"[0-9#*$%&|<>{}=@_/]", r"[.!?]"
_M = 2147483647


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) from the id and the text's md5, by integer arithmetic that any SQL engine repeats."""
    named = F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")
    x = (F.pmod(F.coalesce(doc_id, F.lit(-1)), F.lit(_M)) + named) % F.lit(_M)
    for k in (48271, 69621, 16807):
        x = (x * F.lit(k) + F.lit(11)) % F.lit(_M)
        x = (x * x + F.lit(12345)) % F.lit(_M)
    return (x + 1) / F.lit(_M + 1.0)


def quality(text: Column, size: Column) -> Column:
    """A weight from LOW to 1, the higher the more a text reads like prose: by its characters a word (about 6 with the
    space), its share of digits and symbols, and its sentence marks a word (about 1 in 12)."""
    share = lambda count, of: count.cast("double") / F.greatest(of, F.lit(1)).cast("double")
    chars = F.length(text)
    near = lambda x, usual, slope: F.lit(1.0) / (F.lit(1.0) + F.abs(x - F.lit(usual)) * F.lit(slope))
    length = near(share(chars, size), 6.0, 0.125)
    odd = near(share(F.regexp_count(text, F.lit(ODD)), chars), 0.0, 16.0)
    marks = near(share(F.regexp_count(text, F.lit(MARKS)), size), 0.08, 4.0)
    return F.lit(LOW) + F.lit(1.0 - LOW) * (length * odd * marks)


def key_bin(key: Column, size: Column) -> Column:
    """An ordered bin of the key, by the mean of the distributions of weights LOW and 1. A weight between them is at most
    8/3 times as dense there, so no bin is expected to hold more than three shares of a source, whatever its documents'
    weights. Documents of size 0 take no words and stand after all bins."""
    passed = 1 - (F.exp(-key) + F.exp(-LOW * key)) / 2
    return F.when(size == 0, BINS).otherwise(F.least(F.floor(passed * BINS), F.lit(BINS - 1))).cast("int")


def source_targets(sources: DataFrame, most: int = 3) -> DataFrame:
    """sources(source, source_size) -> with target. One row per source: small against the documents."""
    one = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = sources.withColumn("weight", ((F.row_number().over(one) - 1) % 3 + 1).cast("long"))
    s = s.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", left / weights)
    free = F.col("level") < F.col("ratio")
    s = s.withColumn("at", F.min_by(F.when(free, F.col("level")), F.when(free, F.struct("ratio", F.coalesce("source", F.lit(""))))).over(every))
    return s.select("source", "source_size", F.when(free, F.col("weight") * F.col("at")).otherwise(F.col("cap")).cast("double").alias("target"))


def mix(docs: DataFrame, most: int = 3) -> DataFrame:
    """docs(doc_id, source, text) -> doc_id, source, size, source_size, target, taken, copies, text_hash."""
    text, size = F.col("text").cast("string"), F.col("size")
    d = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), text.alias("text"))
    d = d.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    d = d.select("doc_id", "source", "size", F.xxhash64(F.col("text").cast("binary")).alias("text_hash"), (-F.log(uniform(F.col("doc_id"), F.col("text"))) / quality(F.coalesce("text", F.lit("")), size)).alias("key"))
    d = materialize(d.withColumn("bin", key_bin(F.col("key"), F.col("size"))), "mixing")

    bins = d.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    targets = source_targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), most)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = materialize(targets.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "s"), "mixing-targets")

    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = bins.withColumn("sum", F.sum("bin_size").over(upto)).join(targets, F.col("source").eqNullSafe(F.col("s")))
    ends = ends.where((F.col("bin") < BINS) & (F.col("sum") >= F.col("budget"))).groupBy("s").agg(F.min("bin").alias("end"), F.min_by(F.col("sum") - F.col("bin_size"), "bin").alias("passed"))
    plan = targets.join(ends.withColumnRenamed("s", "e"), F.col("s").eqNullSafe(F.col("e")), "left").drop("e")
    plan = materialize(plan.withColumn("end", F.coalesce("end", F.lit(-1))), "mixing-plan")  # no words: no bin is cut

    rows = d.join(plan, F.col("source").eqNullSafe(F.col("s")))
    out = lambda df, more: df.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") + more).alias("copies"), "text_hash")
    whole = out(rows.where(F.col("bin") != F.col("end")), (F.col("bin") < F.col("end")).cast("long"))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = rows.where(F.col("bin") == F.col("end")).withColumn("sum", F.col("passed") + F.sum("size").over(order))
    last = out(last, (F.col("sum") - F.col("size") / 2 <= F.col("budget")).cast("long"))
    mixed = whole.unionByName(last).withColumn("copies", F.least(F.col("copies"), F.lit(most)))
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "text_hash")
