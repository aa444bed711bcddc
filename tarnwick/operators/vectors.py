"""Exact nearest vectors of many probes by blocked matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.sources import stored

#: Rows of either side of one product, pairs that are scored exactly at once, tasks for each core of the cluster, and rows that give the first bounds.
BLOCK, PAIRS, TASKS, FIRST = 512, 1 << 16, 3, 8192


class Best:
    """Rows of one length, and the k best of what each has met so far, by score and then the smaller id.

    Rows lie in blocks of like norms. A product of two blocks in single precision gives each score within a known error;
    pairs that this error leaves a chance are kept, and scored in the end by adding up from the first component to the last
    in double precision, as the SQL does. So a score does not depend on the block or the task a pair fell in, and equal
    vectors tie.

    members: the ids (offsets, values) that stand behind each row, which is its own id where there are none. barred: rows that
    don't meet a row of their own id.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, barred: np.ndarray | None = None, keys: np.ndarray | None = None, members: tuple[np.ndarray, np.ndarray] | None = None, least: np.ndarray | None = None):
        n, d = vectors.shape
        with np.errstate(all="ignore"):
            most = np.abs(vectors).max(1).astype(float)
            norm = most * np.sqrt(((vectors / np.where(most > 0, most, 1)[:, None]) ** 2).sum(1, dtype=float))
            least, power = np.full(n, -np.inf) if least is None else least, np.frexp(norm)[1]
            order = np.lexsort((-least, np.where(norm > 0, -power, 5000)))  # blocks of like bounds, too
            self.size = np.ldexp(1.0, power[order[::BLOCK]])
            self.near = (vectors[order] / self.size.repeat(BLOCK)[:n, None]).astype(np.float32)
        self.columns = np.ascontiguousarray(vectors[order].T)
        self.ids, self.keys, self.members, self.k = ids[order], (ids if keys is None else keys)[order], members, k
        self.barred, self.order = None if barred is None or not barred.any() else barred[order], order
        self.least = least[order]  # the k-th best score is this at least
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.hits, self.held, self.most, self.floors = [], 0, 4 * k * n + PAIRS, {}
        self.error = (d + 16) * 2.0**-23

    def block(self, i: int) -> slice:
        return slice(i * BLOCK, min((i + 1) * BLOCK, len(self.ids)))

    def floor(self, i: int, size: float, error: float) -> np.ndarray:
        """Products of block i below these have no chance."""
        if (i, size) not in self.floors:
            t = (self.least[self.block(i)] - error) / size
            self.floors[i, size] = np.nextafter(np.where(np.isnan(t), -np.inf, t).astype(np.float32), np.float32(-np.inf))
        return self.floors[i, size]

    def begin(self, other: Best) -> None:
        """First bounds, from the first blocks of other."""
        columns = slice(0, FIRST // (1 if other.barred is None else 4))
        met, sizes = other.near[columns].T, other.size[: -(-columns.stop // BLOCK)]
        for i in range(len(self.size)) if met.shape[1] >= self.k else ():
            rows = self.block(i)
            product = self.near[rows] @ met
            if other.barred is not None:
                product[other.barred[columns] & (self.ids[rows][:, None] == other.ids[columns])] = -np.inf
            product.partition(product.shape[1] - self.k, axis=1)
            kth = product[:, -self.k].astype(float)
            low = kth * self.size[i] * np.where(kth > 0, sizes.min(), sizes.max()) - self.bound(self.size[i] * sizes.max())
            self.least[rows] = np.fmax(self.least[rows], low)
        self.floors = {}

    def bound(self, size: float) -> float:
        """How far a product of blocks may be from a score: single precision, and what a score loses below the least double."""
        return self.error * size + len(self.columns) * 5e-324

    def hit(self, rows: np.ndarray, others: np.ndarray, low: np.ndarray, high: np.ndarray, other: Best) -> None:
        if len(rows):
            down, up = (np.nextafter(x.astype(np.float32), np.float32(to)) for x, to in ((low, -np.inf), (high, np.inf)))
            self.hits.append((rows.astype(np.int32), others.astype(np.int32), down, up))
            self.held += len(rows)
            if self.held > self.most:
                self.tighten()
                if self.held > self.most // 2:
                    self.settle(other)

    def tighten(self) -> None:
        """Raises the bounds to the k-th of the pairs held, and drops pairs below."""
        row, column, low, high = (np.concatenate(x) for x in zip(*self.hits, strict=True))
        code = (-low).view(np.int32)
        order = np.argsort((row.astype(np.int64) << 32) + (code ^ (code >> 31 & 0x7FFFFFFF)))  # by row and then from the highest, as whole numbers
        row, column, low, high = row[order], column[order], low[order], high[order]
        kth = np.arange(len(row)) - np.searchsorted(row, row) == self.k - 1
        self.least[row[kth]] = np.fmax(self.least[row[kth]], low[kth])
        self.floors = {}
        keep = ~(high < self.least[row])
        self.hits, self.held = [(row[keep], column[keep], low[keep], high[keep])], int(keep.sum())

    def settle(self, other: Best) -> None:
        """Scores the pairs held and keeps the k best of each row."""
        if not self.hits:
            return
        self.tighten()
        (row, column, *_), self.hits, self.held = self.hits[0], [], 0
        for at in range(0, len(row), 16 * PAIRS):
            r, c = row[at : at + 16 * PAIRS], column[at : at + 16 * PAIRS]
            score = np.concatenate([np.zeros(0), *(self._scores(other, r[x : x + PAIRS], c[x : x + PAIRS]) for x in range(0, len(r), PAIRS))])
            ids = other.ids[c]
            if other.members:
                offsets, values = other.members
                c = other.order[c]
                n = offsets[c + 1] - offsets[c]
                ids = values[np.repeat(offsets[c] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                r, score = np.repeat(r, n), np.repeat(score, n)
            r, ids, score = np.r_[self.row, r], np.r_[self.id, ids], np.r_[self.score, score]
            order = np.lexsort((ids, -score, r))
            r, ids, score = r[order], ids[order], score[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            self.row, self.id, self.score = (x[(place < self.k) & (score > -np.inf)] for x in (r, ids, score))
            kth = (place == self.k - 1) & (score > -np.inf)
            self.least[r[kth]] = np.fmax(self.least[r[kth]], score[kth])

    def _scores(self, other: Best, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for x, y in zip(self.columns, other.columns, strict=True):  # one fixed order of additions
            total += x[rows].astype(float) * y[others].astype(float)
        return total

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.keys[self.row]), pa.array(self.id), pa.array(self.score)], names=["probe_id", "id", "score"])


@np.errstate(all="ignore")
def meet(left: Best, right: Best, both: bool) -> None:
    """Every row of left meets every row of right; both: and the other way round, by the same products. left may be right.

    Blocks meet in rounds, in each of which a block takes part about once, so all bounds rise alike.
    """
    rounds, held, above = max(len(left.size), len(right.size)), np.empty((BLOCK, BLOCK), np.float32), np.empty((BLOCK, BLOCK), bool)
    for shift in range(rounds):
        for i in range(len(left.size)):
            j = (i + shift) % rounds
            if j >= len(right.size) or (left is right and j < i):
                continue
            rows, columns, size = left.block(i), right.block(j), left.size[i] * right.size[j]
            error = left.bound(size)
            whole = rows.stop - rows.start == columns.stop - columns.start == BLOCK
            product = np.matmul(left.near[rows], right.near[columns].T, out=held if whole else None)
            floor, across = left.floor(i, size, error), right.floor(j, size, error) if both and not (left is right and i == j) else None
            at = np.flatnonzero(np.greater_equal(product, (floor if across is None else np.minimum(floor, across.min()))[:, None], out=above if whole else None))
            if not len(at):
                continue
            x, y = np.divmod(at, product.shape[1])
            s = product.ravel()[at]
            if right.barred is not None:
                apart = ~(right.barred[columns][y] & (left.ids[rows][x] == right.ids[columns][y]))
                x, y, s = x[apart], y[apart], s[apart]
            score = s * size
            score[np.isnan(score)] = 0
            for one, other, own, its, least in ((left, right, x + rows.start, y + columns.start, floor[x]), (right, left, y + columns.start, x + rows.start, None if across is None else across[y])):
                if least is not None:
                    chance = s >= least
                    one.hit(own[chance], its[chance], score[chance] - error, score[chance] + error, other)
    left.settle(right)
    if both and left is not right:
        right.settle(left)


def _by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of the vectors of each length."""
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy()
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        own = np.flatnonzero(lengths == d)
        yield int(d), own, values.reshape(-1, d) if len(own) == len(lengths) else values[starts[own][:, None] + np.arange(d)]


def top_products(base: DataFrame, probes: DataFrame, k: int, other: bool = False, memory: int = 64 << 20) -> DataFrame:
    """base(id, vector), probes(id, vector) -> probe_id, rank (from 1), id, score: the k largest inner products, ties to smaller ids.

    other: not the row of the probe's own id. Vectors that are null or empty, or hold a null or a number that is not
    finite, take no part; vectors of unlike lengths don't meet. Ids are whole and not null.

    No pair is stored: a task keeps a few rows a probe and holds the product of two blocks. Probes of at most an eighth of
    ``memory`` bytes are broadcast and base is read where it lies. More probes are dealt in stripes, and base too, so that a
    stripe of either is at most ``memory`` bytes, and every stripe of one meets every stripe of the other in a task of its
    own. There, equal vectors are one row, and where base itself is asked (the same DataFrame) a pair of stripes meets once.
    """
    spark = base.sparkSession
    same, narrow = probes is base, all("float" in df.schema["vector"].dataType.simpleString() for df in (base, probes))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ready = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>" if narrow else "array<double>").alias("vector")).where(F.col("id").isNotNull() & whole & (F.size("vector") > 0))
    base, probes = ready(base), ready(probes)
    size = lambda df: df.agg(F.coalesce(F.sum(8 * F.size("vector") + 16), F.lit(0)).alias("b")).first()["b"]

    if size(probes) <= memory // 8:
        table = probes.toArrow().combine_chunks()
        packed = [(d, chunk.column(0).to_numpy()[own], q) for chunk in table.to_batches() for d, own, q in _by_length(chunk.column(1))]
        shared = spark.sparkContext.broadcast(packed)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [(d, Best(ids, q, k)) for d, ids, q in shared.value]
            for batch in batches:
                for d, own, rows in _by_length(batch.column(1)):
                    found = Best(batch.column(0).to_numpy()[own], rows, k, np.full(len(own), other))
                    for length, b in best:
                        if length == d:
                            if np.isneginf(b.least).any():
                                b.begin(found)
                            meet(b, found, False)
            for _, b in best:
                yield b.rows()

        found = base.mapInArrow(scan, "probe_id long, id long, score double")
    else:
        found = _by_stripes(base, probes, same, k, other, memory, size)
    order = Window.partitionBy("probe_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("probe_id", "rank", "id", "score")


def _by_stripes(base: DataFrame, probes: DataFrame, same: bool, k: int, other: bool, memory: int, size) -> DataFrame:
    """probe_id, id, score: rows among which are the k best of each probe.

    One more than k are looked for where a probe's own id may be among them. Ids that base holds more than once could take
    more places than one: their rows are no one else's copies, and don't meet their own id in the first place.
    """
    spark, most = base.sparkSession, k + other
    cores = spark.sparkContext.defaultParallelism
    twins = base.groupBy("id").count().where("count > 1").select("id", F.col("id").alias("twin"))
    if other and not twins.isEmpty():
        marked = lambda df: df.join(twins, "id", "left")
    else:
        marked = lambda df: df.withColumn("twin", F.lit(None).cast("long"))
    base, probes = marked(base), marked(probes)

    def distinct(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The different vectors with their least ids; every id with its vector's key."""
        each = rows.groupBy("vector", "twin").agg(F.min("id").alias("id"), F.count("*").alias("n"))
        each = stored(each.withColumn("key", F.monotonically_increasing_id()), "vectors")
        ids, one = F.array("id"), each.where("n = 1").select("id", "key")
        if each.where("n > 1").isEmpty():
            return each.withColumn("ids", ids), one
        copied = each.where("n > 1").select("key", F.col("vector").alias("v"), F.col("twin").alias("t"))
        copies = stored(rows.join(copied, (F.col("vector") == F.col("v")) & F.col("twin").eqNullSafe(F.col("t"))).select("id", "key"), "copies")
        place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
        few = copies.withColumn("place", place).where(F.col("place") <= most).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("few"))
        return each.join(few, "key", "left").withColumn("ids", F.coalesce("few", ids)), one.unionByName(copies)

    asked, owners = distinct(probes)
    met = asked if same else distinct(base)[0]
    down, across = (max(1, -(-size(x) // memory)) for x in (asked, met))
    few = met.where("twin IS NULL").orderBy(F.xxhash64("key")).limit(FIRST).select("vector").toArrow().combine_chunks()
    packed = {d: x for chunk in few.to_batches() for d, _, x in _by_length(chunk.column(0))}
    shared = spark.sparkContext.broadcast(packed)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with a bound that the k-th best score reaches at least."""
        first = {d: Best(np.arange(len(x)), x, most) for d, x in shared.value.items()}
        for batch in batches:
            least = np.full(batch.num_rows, -np.inf)
            for d, at, x in _by_length(batch.column("vector")):
                if d in first:
                    own = Best(at, x, most)
                    own.begin(first[d])
                    least[own.ids] = own.least
            yield batch.append_column("least", pa.array(least))

    asks = asked.select("key", "ids", F.col("twin").isNotNull().alias("twin"), "vector")
    asks = asks.mapInArrow(bounds, ", ".join(map(" ".join, [*asks.dtypes, ("least", "double")])))
    sent = ["key", "ids", "twin", "vector", "least"]
    stripe = lambda n: F.pmod(F.xxhash64("key"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    if same:
        while down * (down + 1) < 2 * TASKS * cores:
            down += 1
        across = down
        rows = asks.withColumn("r", stripe(down)).withColumn("c", every(down)).select((F.least("r", "c") * down + F.greatest("r", "c")).alias("cell"), (F.col("r") <= F.col("c")).alias("first"), *sent)
    else:
        while down * across < TASKS * cores:
            down, across = down + 1, across + 1
        cell = (F.col("r") * across + F.col("c")).alias("cell")
        rows = asks.withColumn("r", stripe(down)).withColumn("c", every(across)).select(cell, F.lit(True).alias("first"), *sent)
        met = met.withColumn("twin", F.col("twin").isNotNull()).withColumn("least", F.lit(float("-inf")))
        rows = rows.unionByName(met.withColumn("c", stripe(across)).withColumn("r", every(down)).select(cell, F.lit(False).alias("first"), *sent))

    def side(rows: pa.Table) -> dict[int, Best]:
        """Rows of a stripe, by their vectors' length."""
        best = {}
        for batch in rows.combine_chunks().to_batches():
            ids = batch.column("ids")
            offsets, values = ids.offsets.to_numpy() - ids.offsets[0].as_py(), ids.flatten().to_numpy()
            for d, at, x in _by_length(batch.column("vector")):
                starts, n = offsets[at], offsets[at + 1] - offsets[at]
                ends = np.cumsum(n)
                members = (np.r_[0, ends], values[np.repeat(starts - ends + n, n) + np.arange(n.sum())]) if (n > 1).any() else None
                best[d] = Best(values[starts], x, most, batch.column("twin").to_numpy(zero_copy_only=False)[at], batch.column("key").to_numpy()[at], members, batch.column("least").to_numpy()[at])
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        table = pa.Table.from_batches(table)
        for cell in table["cell"].unique().to_pylist():
            own = pc.equal(table["cell"], cell)
            left = side(table.filter(pc.and_(own, table["first"])))
            right = left if same and cell // across == cell % across else side(table.filter(pc.and_not(own, table["first"])))
            for d in left.keys() & right.keys():
                meet(left[d], right[d], same)
                yield left[d].rows()
                if same and left is not right:
                    yield right[d].rows()

    found = rows.repartitionById(down * across, F.col("cell").cast("int")).mapInArrow(run, "key long, id long, score double")
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))).where(F.col("place") <= most)
    found = owners.withColumnRenamed("id", "probe_id").join(found.select("key", "id", "score"), "key")
    return (found.where("probe_id <> id") if other else found).select("probe_id", "id", "score")
