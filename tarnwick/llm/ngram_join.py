"""N-gram Jaccard join with adaptive multi-match prefixes (operator 5), reduced to connected components.

Documents with equal shingle sets form a class; the join runs over classes. Shingles are ordered rare first by a count
sketch of fixed size. With similarity p %, a class of n shingles has a prefix of n - ceil(p n / 100) + l shingles, and
partners share at least the smaller l of them. Each class lengthens its prefix (l up to 4) by estimated candidate cost.

Posting lists of up to ``short`` classes give their pairs with a count of shared prefix shingles; pairs below the
smaller l go unless both classes' whole prefixes stand in enough long lists to make it up. Long lists never give all pairs: first each class meets the
list's pivot (the member with fewest rarer shingles); then, components known, only pairs of different components that
length and position still allow meet, by equality of (shingle, length), and pass on only if their bitmaps allow a link.
Every pair is verified on whole sets.

Shingles are 64-bit hashes of the words' hashes; classes are 64-bit hashes of whole sets and their size.
Defined cases: null, empty or blank text has 0 shingles and is linked with nothing; fewer words than a shingle count as
one; repeated rows fall in one class; rows with a null doc_id take part, a component's id is its least non-null doc_id.
A class's text is found by doc_id and a hash of the text, so null or repeated ids never multiply.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, even_keys, materialize, partitions
from .components import components
from .sketches import SLICES, press, summed

_A = np.uint64(0x9E3779B97F4A7C15)
_S = np.uint64(29)


class Hashes(dict):
    """word -> 64-bit hash; emptied when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes | None, words: int, cache: Hashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))], np.uint64)
    a = np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))
    n = len(w) - words + 1
    h = a[:n].copy()
    for k in range(1, words):
        h = (h ^ (h >> _S)) * _A + a[k : k + n]
    h = (h ^ (h >> _S)) * _A
    return np.unique(h ^ (h >> np.uint64(32)))


def class_of(h: np.ndarray) -> int:
    """A signed 64-bit id of a set."""
    c = xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))
    return c - (1 << 64) if c >> 63 else c


def _least(percent: int, n):
    return -(-percent * n // 100)


def _first_pass(words: int, bits: int):
    """Rows (kind 0: doc_id, n, cid, text_hash) and, at the end, slices of the sketch (kind 1: n = slice, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sketch = Hashes(), np.zeros(1 << bits, np.uint32)
        schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("text_hash", pa.int64()), ("marks", pa.list_(pa.int64())), ("payload", pa.binary())])
        for batch in batches:
            n, cid, marks = [], [], []
            for x in batch.column(1):
                h = shingles(x.as_py(), words, cache)
                n.append(len(h))
                cid.append(class_of(h) if len(h) else None)
                marks.append(bitmap(h))
                if len(h):
                    np.add.at(sketch, (h >> np.uint64(64 - bits)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column(0), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), batch.column(2), pa.ListArray.from_arrays(np.arange(0, 16 * len(n) + 1, 16, dtype=np.int32), np.concatenate([np.zeros(0, np.int64), *marks])), pa.nulls(len(n), pa.binary())], schema=schema)
        if sketch.any():
            parts = press(sketch)
            yield pa.RecordBatch.from_arrays([pa.array([1] * SLICES, pa.int32()), pa.nulls(SLICES, pa.int64()), pa.array(range(SLICES), pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.list_(pa.int64())), pa.array(parts, pa.binary())], schema=schema)

    return run


def quantised(sketch: np.ndarray) -> np.ndarray:
    """Eighths of log2 of the counts above the median cell's chance load, in a byte each."""
    over = np.maximum(sketch.astype(np.int64) - int(np.median(sketch)), 0)
    return np.minimum(np.round(8 * np.log2(over + 1)), 255).astype(np.uint8)


_COUNT = np.maximum(2 ** (np.arange(256) / 8) - 1, 1)


def bitmap(h: np.ndarray) -> np.ndarray:
    """1024 parities of a set as 16 bigints: two sets' bitmaps differ in at most as many bits as the sets in members."""
    return np.packbits((np.bincount(((h >> np.uint64(20)) & np.uint64(1023)).astype(np.int64), minlength=1024) & 1).astype(np.uint8)).view("<i8")


def prefix(h: np.ndarray, counts: np.ndarray, percent: int, longest: int = 4, verify: float = 2.0) -> tuple[np.ndarray, int]:
    """The ordered prefix of a set and its l. counts: estimated classes that hold each shingle of h."""
    order = np.lexsort((h, np.log2(counts + 1).astype(np.int64)))
    base = len(h) - _least(percent, len(h))
    costs = np.cumsum(counts[order[: base + longest]].astype(float) - 1)
    best, chosen = None, 1
    for ell in range(1, min(longest, len(h) - base) + 1):
        cost = base + ell + verify * costs[base + ell - 1] / ell
        if best is None or cost < 0.9 * best:
            best, chosen = cost, ell
    return h[order[: base + chosen]], chosen


def _prefixes(words: int, bits: int, percent: int, sent, heavy: int, n_buckets: int, keys: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sketch = Hashes(), sent.value
        for batch in batches:
            seen: set[int] = set()
            cols: list[list] = [[], [], [], [], []]
            for x in batch.column(0):
                h = shingles(x.as_py(), words, cache)
                if not len(h) or (c := class_of(h)) in seen:
                    continue
                seen.add(c)
                est = _COUNT[sketch[(h >> np.uint64(64 - bits)).astype(np.int64)]]
                p, ell = prefix(h, est, percent)
                for col, v in zip(cols, (p, np.full(len(p), c, np.int64), np.full(len(p), len(h), np.int32), np.arange(len(p), dtype=np.int32), np.full(len(p), ell, np.int32)), strict=True):
                    col.append(v)
            if not seen:
                continue
            tok, cid, n, pos, ell = map(np.concatenate, cols)
            est = _COUNT[sketch[(tok >> np.uint64(64 - bits)).astype(np.int64)]]
            bucket = (np.where(est >= heavy, (tok ^ cid.astype(np.uint64)) * _A >> _S, tok >> np.uint64(7)) % np.uint64(n_buckets)).astype(np.int64)
            by = np.lexsort((tok, bucket))
            ends = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
            rows = []
            for k in range(n_buckets):
                at = by[ends[k] : ends[k + 1]]
                if len(at):
                    rows.append((keys[k], *(zstandard.compress(v[at].tobytes(), 1) for v in (tok, cid, n, pos, ell))))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 5), strict=True)], names=["bucket", "tok", "cid", "n", "pos", "ell"])

    return run


_FOUND = "kind int, token long, a long, b long, n int, pos int, ell int, spread int"
_PART = 256


def _lists(percent: int, bits: int, sent, heavy: int, short: int):
    """A bucket's posting lists: pairs of the short ones (kind 0), members of the long ones (kind 1; kind 2 beyond the prefix of l = 1)."""

    def run(table: pa.Table) -> pa.Table:
        read = lambda c, t: np.concatenate([np.frombuffer(zstandard.decompress(x), t) for x in table[c].to_pylist()])
        tok, cid, n, pos, ell = read("tok", np.uint64), read("cid", np.int64), read("n", np.int32), read("pos", np.int32), read("ell", np.int32)
        order = np.lexsort((cid, tok))
        tok, cid = tok[order], cid[order]
        once = np.append(True, (tok[1:] != tok[:-1]) | (cid[1:] != cid[:-1]))
        order, tok, cid = order[once], tok[once], cid[once]
        n, pos, ell = n[order].astype(np.int64), pos[order].astype(np.int64), ell[order]
        starts = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
        sizes = np.diff(np.append(starts, len(tok)))
        size = np.repeat(sizes, sizes)
        est = _COUNT[sent.value[(tok >> np.uint64(64 - bits)).astype(np.int64)]]
        long = (est >= heavy) | (size > short)
        out = []
        for k in range(1, short):
            i = np.flatnonzero((size[:-k] > k) & (tok[k:] == tok[:-k]) & ~long[:-k]) if len(tok) > k else np.zeros(0, np.int64)
            j = i + k
            low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            need = -(-percent * (low + high) // (100 + percent))
            least = np.minimum(ell[i], ell[j])
            ok = (100 * low >= percent * high) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) + least - 1 >= need)
            i, j, least = i[ok], j[ok], least[ok]
            out.append((np.zeros(len(i), np.int32), tok[i].view(np.int64), np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j]), np.zeros(len(i), np.int32), np.zeros(len(i), np.int32), least, np.ones(len(i), np.int32)))
        at = np.flatnonzero(long)
        out.append((np.where(n - pos >= _least(percent, n), 1, 2)[at].astype(np.int32), tok[at].view(np.int64), cid[at], cid[at], n[at].astype(np.int32), pos[at].astype(np.int32), ell[at], np.ceil(np.maximum(est, 1) / _PART)[at].astype(np.int32)))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], names=["kind", "token", "a", "b", "n", "pos", "ell", "spread"])

    return run


def may_link(a: str, b: str, sizes: Column, percent: int) -> Column:
    """Whether two bitmaps differ in no more bits than sets of that summed size may differ in members."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return (100 + percent) * differ <= (100 - percent) * sizes


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int, most_sent: int = 2_000_000) -> DataFrame:
    """Those of pairs(a, b) whose whole sets reach the similarity.

    First the classes' bitmaps drop pairs that differ in more shingles than the similarity allows, exactly so. The
    wanted classes' texts are found by a broadcast of their ids while those are at most most_sent, else by a
    shuffle. Texts travel, not sets: they compress. Merge joins throughout, whose large keys can be split.
    """
    side = lambda x: classes.select(F.col("cid").alias(f"c{x}"), F.col("size").alias(f"n{x}"), F.col("marks").alias(f"m{x}"))
    near = pairs.hint("merge").join(side("a"), F.col("a") == F.col("ca")).hint("merge").join(side("b"), F.col("b") == F.col("cb"))
    pairs = materialize(near.where(may_link("ma", "mb", F.col("na") + F.col("nb"), percent)).select("a", "b"), "ngram-near")
    wanted = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    wanted = materialize(wanted.join(classes, F.col("c") == F.col("cid")).select("c", F.col("at.doc_id").alias("wanted_id"), F.col("at.text_hash").alias("wanted_hash")), "ngram-wanted")
    n_wanted = wanted.count()
    small = n_wanted <= most_sent
    held = docs.join(F.broadcast(wanted) if small else wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("text_hash") == F.col("wanted_hash"))).select("c", "text")
    held = materialize(held, "ngram-texts")
    if held.count() > n_wanted:  # whole rows repeat
        repeated, held = held, materialize(held.dropDuplicates(["c"]), "ngram-texts")
        discard(repeated)
    one = pairs.hint("merge").join(held.select(F.col("c").alias("cb"), F.col("text").alias("text_b")), F.col("b") == F.col("cb")).select("a", "b", "text_b")
    two = one.hint("merge").join(held.select(F.col("c").alias("ca"), F.col("text").alias("text_a")), F.col("a") == F.col("ca"))
    made = (pairs, wanted, held)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, at, last = Hashes(), None, None
        for batch in batches:
            a, b, ok = batch.column(0), batch.column(1), []
            for i in range(batch.num_rows):
                if at is None or a[i].as_py() != at:
                    at, last = a[i].as_py(), shingles(batch.column(3)[i].as_py(), words, cache)
                other = shingles(batch.column(2)[i].as_py(), words, cache)
                both = len(np.intersect1d(last, other, assume_unique=True))
                ok.append(100 * both >= percent * (len(last) + len(other) - both) and class_of(last) == at and class_of(other) == b[i].as_py())
                if class_of(last) != at:
                    at = None  # another text of the same id and hash
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links = materialize(two.select("a", "b", "text_b", "text_a").mapInArrow(check, "a long, b long"), "ngram-links")
    discard(*made)
    return links


def join(docs: DataFrame, words: int = 5, percent: int = 80, short: int = 8, heavy: int = 4096, bits: int = 22, with_first: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id (least doc_id reachable by links).

    with_first adds text_hash (xxhash64 of the text) and is_first: the row stands for its component, by least non-null
    doc_id, then hash; rows without a shingle stand for themselves.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).withColumn("text_hash", F.xxhash64("text"))
    first = docs.mapInArrow(_first_pass(words, bits), "kind int, doc_id long, n long, cid long, text_hash long, marks array<long>, payload binary")
    first = materialize(first, "ngram-classes")
    rows = first.where("kind = 0").select("doc_id", "n", "cid", "text_hash")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")  # non-null ids first
    sets = first.where("kind = 0 AND n > 0").groupBy("cid").agg(F.min(place).alias("at"), F.max("n").alias("size"), F.first("marks").alias("marks"))
    classes = materialize(sets, "ngram-reps")

    sent, p = spark.sparkContext.broadcast(quantised(summed(first.where("kind = 1").select("n", "payload"), bits))), partitions(spark)
    dealt = docs.select("text").mapInArrow(_prefixes(words, bits, percent, sent, heavy, p, even_keys(p, p)), "bucket long, tok binary, cid binary, n binary, pos binary, ell binary")
    found = materialize(dealt.groupBy("bucket").applyInArrow(_lists(percent, bits, sent, heavy, short), _FOUND), "ngram-lists")

    long = found.where("kind = 1").select("token", F.col("a").alias("cid"), F.col("n").cast("long"), F.col("pos").cast("long"), "spread")
    in_long = found.where("kind > 0").groupBy(F.col("a").alias("h")).agg(F.count("*").alias("n_long"))
    counted = found.where("kind = 0").groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("ell").alias("ell"))
    enough = lambda x: (F.col(x) == F.col("h")) & (F.col("shared") + F.col("n_long") >= F.col("ell"))
    few = counted.where("shared < ell").join(in_long, enough("a"), "left_semi").join(in_long, enough("b"), "left_semi")
    reach = F.floor((F.col("n") - F.col("pos")) * (100 + percent) / percent) - F.col("n")  # the largest partner still allowed
    long = long.withColumn("reach", reach.cast("long"))
    # A list's members meet its pivot in as many parts as its estimated length asks for: a hot list is no single task's.
    pivots = long.groupBy(F.col("token").alias("t")).agg(F.min(F.struct("pos", "cid", "n", "reach")).alias("pivot"), F.max("spread").alias("parts"))
    pivots = pivots.select("t", "pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt_long = long.withColumn("own_part", F.pmod(F.xxhash64("cid"), F.col("spread")).cast("int"))
    fits = lambda n, reach: (F.col("n") <= reach) & (n <= F.col("reach")) & (100 * F.least(F.col("n"), n) >= percent * F.greatest(F.col("n"), n))
    hub = dealt_long.join(pivots, (F.col("token") == F.col("t")) & (F.col("own_part") == F.col("part"))).where((F.col("cid") != F.col("pivot.cid")) & fits(F.col("pivot.n"), F.col("pivot.reach")))
    hub = hub.select(F.col("pivot.cid").alias("a"), F.col("cid").alias("b"))
    pairs = materialize(counted.where("shared >= ell").select("a", "b").unionByName(few.select("a", "b")).unionByName(hub).distinct(), "ngram-pairs")
    links = _verified(pairs, docs, classes, words, percent)
    labels = components(links)

    # What is left of the long lists: partners of another component, met by (token, length of the shorter).
    member = long.drop("spread").join(labels, F.col("cid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "cid")).drop("node")
    member = materialize(member, "ngram-members")
    shorter = member.where("reach >= n").select(F.col("token").alias("t"), F.col("n").alias("m"), F.col("cid").alias("b"), F.col("label").alias("label_b"), F.col("reach").alias("reach_b"))
    kinds = shorter.groupBy("t", "m").agg(F.min("label_b").alias("low"), F.max("label_b").alias("high")).select(F.col("t").alias("kt"), F.col("m").alias("km"), "low", "high")
    top = F.least(F.col("n"), F.col("reach"))
    lowest = F.ceil(F.col("n") * percent / 100).cast("long")
    met = (F.col("token") == F.col("kt")) & (F.col("km") >= lowest) & (F.col("km") <= top) & ((F.col("low") != F.col("high")) | (F.col("low") != F.col("label")))
    longer = materialize(member.join(kinds, met).select("token", F.col("km").alias("want"), "cid", "n", "label"), "ngram-longer")
    # Both sides bring their bitmaps, so a pair leaves the join only if those allow a link: comparing members of one list
    # and length is the work of a merge join, whose large keys can be split, but no such pairs are stored or shuffled.
    marks = classes.select(F.col("cid").alias("marked"), "marks")
    wanted = longer.select(F.col("token").alias("wt"), F.col("want").alias("wm")).distinct()
    asked = shorter.join(wanted, (F.col("t") == F.col("wt")) & (F.col("m") == F.col("wm")), "left_semi")
    asked = asked.hint("merge").join(marks.withColumnRenamed("marks", "marks_b"), F.col("b") == F.col("marked")).drop("marked")
    asking = longer.hint("merge").join(marks.withColumnRenamed("marks", "marks_a"), F.col("cid") == F.col("marked")).drop("marked")
    rest = asking.hint("merge").join(asked, (F.col("token") == F.col("t")) & (F.col("want") == F.col("m")))
    rest = rest.where((F.col("label") != F.col("label_b")) & (F.col("n") <= F.col("reach_b")) & may_link("marks_a", "marks_b", F.col("n") + F.col("m"), percent))
    rest = rest.select(F.least("cid", "b").alias("a"), F.greatest("cid", "b").alias("b")).distinct()
    tried = pairs.select(F.least("a", "b").alias("ta"), F.greatest("a", "b").alias("tb"))
    rest = materialize(rest.join(tried, (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left_anti"), "ngram-rest")
    if rest.take(1):
        more = _verified(rest, docs, classes, words, percent)
        if more.take(1):
            labels = components(links.unionByName(more))
        discard(more)
    discard(found, pairs, member, longer, rest, links)

    known = classes.join(labels, F.col("cid") == F.col("node"), "left").select("cid", "at", F.coalesce("label", "cid").alias("label"))
    least = known.groupBy("label").agg(F.min("at").alias("first")).select(F.col("label").alias("l"), "first")
    known = known.join(least, F.col("label") == F.col("l")).select(F.col("cid").alias("c"), "first")
    out = rows.join(known, F.col("cid") == F.col("c"), "left")
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id")]
    if with_first:
        columns += ["text_hash", F.coalesce(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")) | F.col("c").isNull(), F.lit(True)).alias("is_first")]
    return out.select(*columns)
