"""Approximate nearest neighbours by additive quantisation (operator 2), largest inner product first.

Directions are coded and norms are stored beside them, so a few long vectors don't draw the codebooks away from the
rest. Directions of more than WIDTH components are coded in slices with codebooks of their own, so the bits grow with
the length. Fit (bounded sample): residual codebooks over all components of a slice by k-means, then joint least squares
of all codebooks given the codes, solved a codebook at a time, as additive quantisation has it. Encode: beam search over
the codebooks for every row; what the codes leave is kept in one signed byte a component. Search, for every query:
lookup tables of query-codeword products score all codes, scaled by the stored norms; the best ``refined`` of a block are
scored again with their bytes; a task keeps the best of a lane of many blocks and hands on as many as an even dealing of
the ``shortlist`` over the lanes can need; the best ``shortlist`` over all lanes are fetched and scored exactly in double
precision.

Rows of equal vectors are one entry with their k + 1 smallest ids, and equal queries are searched once: no query can
need more of such rows, so nothing is lost and a common vector is no hot key. Lanes of codes meet groups of queries as
a two-dimensional grid (codes and queries move there, vectors don't); per query the candidates are ranked by a window
that limits them before they move, and vectors are fetched by a merge join, whose large keys can be split. The work
grows with rows times queries: the lookup pass reads every code for every query.

Defined cases: vectors that are null, empty, zero, or with null or non-finite components, and null ids, take no part;
vectors of each length are searched among themselves; equal scores go to the smaller vec_id; rows with a repeated
vec_id are candidates each and, as queries, have results each, barred from their own row alone; with fewer than k
candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions


#: Components of a slice with codebooks of its own, bytes of a lane's codes, and components scored again at once.
WIDTH, LANE, AGAIN = 64, 64 << 20, 1 << 24


def sums_by(at: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Sums of the rows of x by their number in 0..k-1."""
    return (at == np.arange(k)[:, None]).astype(x.dtype) @ x


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=k)
        c[n > 0] = sums_by(near, x, k)[n > 0] / n[n > 0, None]
        c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """Codes (n x M) by beam search: each step keeps the beam partial sums nearest to the vector."""
    n, (m, k, d) = len(x), books.shape
    rest, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
    for b in range(m):
        cost = (rest * rest).sum(2)[:, :, None] - 2 * rest @ books[b].T + (books[b] ** 2).sum(1)
        width = cost.shape[1]
        flat = cost.reshape(n, width * k)
        keep = min(beam, width * k)
        top = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < width * k else np.tile(np.arange(width * k), (n, 1))
        row = np.arange(n)[:, None]
        codes = np.concatenate([codes[row, top // k], (top % k).astype(np.uint8)[:, :, None]], axis=2)
        rest = rest[row, top // k] - books[b][top % k]
    best = np.argmin((rest * rest).sum(2), axis=1)
    return codes[np.arange(n), best]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[b][codes[:, b]] for b in range(len(books)))


def fit(x: np.ndarray, n_books: int, n_codes: int, beam: int, seed: int = 3, sweeps: int = 6) -> np.ndarray:
    """Residual codebooks, then twice: codes by beam search, and least squares by sweeps over the codebooks."""
    rng, rest, books = np.random.default_rng(seed), x.copy(), []
    for _ in range(n_books):
        c = kmeans(rest, n_codes, 8, rng)
        rest = rest - c[np.argmin((c * c).sum(1) - 2 * rest @ c.T, axis=1)]
        books.append(c)
    books = np.stack(books).astype(np.float32)
    for _ in range(2):
        at = encode(x, books, beam).astype(np.int64)
        rest = x - decode(at, books)
        for _ in range(sweeps):
            for b in range(n_books):
                step = sums_by(at[:, b], rest, n_codes) / (np.bincount(at[:, b], minlength=n_codes) + np.float32(1e-2))[:, None].astype(np.float32)
                books[b] += step
                rest -= step[at[:, b]]
    return books


def slices(d: int) -> list[slice]:
    ends = np.linspace(0, d, -(-d // WIDTH) + 1).astype(int)
    return [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1 in single precision, and their lengths; numbers of any size neither overflow nor vanish."""
    x = x.astype(float)
    most = np.abs(x).max(axis=1)
    x = x / most[:, None]
    norm = np.sqrt((x * x).sum(1))
    return (x / norm[:, None]).astype(np.float32), norm * most


def usable(v: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda c: c != 0)


def lookup(queries: np.ndarray, codes: np.ndarray, scale: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Approximate products (rows x queries): a table of codeword products for each codebook, added up by the codes."""
    out = np.zeros((len(codes), len(queries)), np.float32)
    for b in range(len(books)):
        out += (books[b] @ queries.T)[codes[:, b]]
    return out * scale[:, None]


def again(queries: np.ndarray, rests: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Products (queries x places) of each query with the bytes of its own rows top."""
    out, n = np.empty(top.shape, np.float32), max(1, AGAIN // max(1, top.shape[1] * queries.shape[1]))
    for at in range(0, len(queries), n):
        out[at : at + n] = np.matmul(rests[top[at : at + n]].astype(np.float32), queries[at : at + n, :, None])[:, :, 0]
    return out


def quota(shortlist: int, lanes: int) -> int:
    """How many of a lane go on: the mean share of the shortlist and three deviations more."""
    mean = shortlist / lanes
    return int(np.ceil(mean + 3 * np.sqrt(mean))) + 1 if lanes > 1 else shortlist


def _fixed(a: np.ndarray, width: int) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(a), [None, pa.py_buffer(np.ascontiguousarray(a).tobytes())]).cast(pa.binary())


def _raw(t: pa.Table | pa.RecordBatch, c: str, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(t[c].to_pylist()), kind).reshape(-1, width)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, n_books: int = 32, n_codes: int = 64, beam: int = 4, most_fitted: int = 8192, block_rows: int = 16_384, query_rows: int = 8192, shortlist: int = 320, lane_blocks: int = 64, refined: int = 2048) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    narrow = "float" in vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if narrow else "array<double>"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    found = [_search(rows.where(F.size("embedding") == d), d, np.float32 if narrow else np.float64, every, k, n_books, n_codes, beam, most_fitted, block_rows, query_rows, shortlist, lane_blocks, refined) for (d,) in rows.select(F.size("embedding")).distinct().collect()]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search(rows: DataFrame, d: int, kind, every: int, k: int, n_books: int, n_codes: int, beam: int, most_fitted: int, block_rows: int, query_rows: int, shortlist: int, lane_blocks: int, refined: int) -> DataFrame:
    """nearest() over usable vectors of one length d."""
    spark, wide = rows.sparkSession, d * np.dtype(kind).itemsize

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), kind).reshape(batch.num_rows, d) + kind(0)  # no negative zeros
            keys = [xxhash.xxh3_128_digest(v.tobytes()) for v in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), _fixed(x, wide)], names=["vec_id", "key", "vector"])

    pressed = materialize(rows.mapInArrow(press, "vec_id long, key binary, vector binary"), "ann-rows")
    first = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    members = pressed.withColumn("place", first).where(F.col("place") <= k + 1)
    classes = members.groupBy("key").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = pressed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("key").alias("query_key"))
    classes = classes.join(asked.select("query_key").distinct(), F.col("key") == F.col("query_key"), "left").withColumn("wanted", F.col("query_key").isNotNull()).drop("query_key")
    classes = materialize(classes, "ann-classes")
    n, n_queries = classes.agg(F.count("*"), F.count_if("wanted")).first()
    drawn = classes.select("vector").orderBy("key").limit(most_fitted).collect()  # the key is a hash
    sample, parts = directions(np.stack([np.frombuffer(r[0], kind) for r in drawn]))[0], slices(d)
    books = spark.sparkContext.broadcast([fit(sample[:, p], n_books, n_codes, beam) for p in parts])
    n_bytes = n_books * len(parts)
    own = [slice(n_books * i, n_books * (i + 1)) for i in range(len(parts))]  # each slice's codes

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                x, norm = directions(_raw(part, "vector", kind, d))
                codes = np.hstack([encode(x[:, p], b, beam) for p, b in zip(parts, books.value, strict=True)])
                rest = x - np.hstack([decode(codes[:, o], b) for o, b in zip(own, books.value, strict=True)])
                step = np.maximum(np.abs(rest).max(axis=1), np.float32(1e-30)) / np.float32(127)
                rest = np.rint(rest / step[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([part["key"], _fixed(codes, n_bytes), _fixed(rest, d), _fixed(np.stack([norm, step.astype(float)], 1), 16)], names=["key", "codes", "rest", "scale"])

    coded = materialize(classes.select("key", "vector").mapInArrow(index, "key binary, codes binary, rest binary, scale binary"), "ann-codes")
    n_blocks, n_groups = -(-n // block_rows), max(1, -(-n_queries // query_rows))
    group = F.pmod(F.xxhash64("key", F.lit(2)), F.lit(n_groups))
    block = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(n_blocks))
    over = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))  # noqa: E731  both sides' keys are of one type

    def joined(names: list[str]):
        def run(table: pa.Table) -> pa.Table:
            return pa.table([[table["at"][0].as_py()], *([b"".join(table[c].to_pylist())] for c in names)], names=["at", *names])

        return run

    held = ["key", "codes", "rest", "scale"]
    codes = coded.select(block.alias("at"), *held).groupBy("at").applyInArrow(joined(held), "at long, key binary, codes binary, rest binary, scale binary")
    queries = classes.where("wanted").select(group.alias("at"), "key", "vector").groupBy("at").applyInArrow(joined(["key", "vector"]), "at long, key binary, vector binary")
    # A task takes a lane of blocks for one group of queries; lanes beyond those that memory asks for only fill the cluster.
    lane_blocks = max(1, min(lane_blocks, LANE // (block_rows * (n_bytes + d + 32))))
    n_lanes = max(1, min(n_blocks, max(-(-n_blocks // lane_blocks), -(-partitions(spark) // n_groups))))
    data = codes.withColumn("g", over(n_groups)).select("g", F.pmod("at", F.lit(n_lanes).cast("long")).alias("b"), *held)
    wanted = queries.withColumn("lane", over(n_lanes)).select(F.col("at").alias("group"), "lane", "key", "vector")
    r = quota(shortlist, n_lanes)

    def search(data: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query", "row", "near"]
        if not data.num_rows or not queries.num_rows:
            return pa.table([pa.array([], t) for t in (pa.binary(), pa.binary(), pa.float64())], names=names)
        blocks = [(np.frombuffer(k, "V16"), np.frombuffer(c, np.uint8).reshape(-1, n_bytes), np.frombuffer(x, np.int8).reshape(-1, d), np.frombuffer(y).reshape(-1, 2)) for k, c, x, y in zip(*(data[c].to_pylist() for c in held), strict=True)]
        ids, q, out = np.frombuffer(queries["key"][0].as_py(), "V16"), directions(np.frombuffer(queries["vector"][0].as_py(), kind).reshape(-1, d))[0], []
        for start in range(0, len(q), 128):
            part = q[start : start + 128]
            best, rows_of = np.empty((len(part), 0)), np.empty((len(part), 0), "V16")
            for keys, codes, rests, scale in blocks:  # the lane's best so far and the block's best, cut to r again
                product = sum(lookup(part[:, p], codes[:, o], np.ones(len(codes), np.float32), b) for p, o, b in zip(parts, own, books.value, strict=True)).T
                near, most = product * scale[:, 0], max(r, refined)
                top = np.argpartition(-near, most - 1, axis=1)[:, :most] if most < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(near), 1))
                near = (np.take_along_axis(product, top, 1) + again(part, rests, top) * scale[top, 1]) * scale[top, 0]
                best, rows_of = np.hstack([best, near]), np.hstack([rows_of, keys[top]])
                if best.shape[1] > r:
                    top = np.argpartition(-best, r - 1, axis=1)[:, :r]
                    best, rows_of = np.take_along_axis(best, top, 1), np.take_along_axis(rows_of, top, 1)
            out.append((np.repeat(ids[start : start + 128], best.shape[1]), rows_of.ravel(), best.ravel()))
        query, row, near = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table([_fixed(query, 16), _fixed(row, 16), pa.array(near)], names=names)

    near = data.groupBy("g", "b").cogroup(wanted.groupBy("group", "lane")).applyInArrow(search, "query binary, row binary, near double")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "row"))
    chosen = near.withColumn("place", best).where(F.col("place") <= shortlist).select("query", "row")

    # Exact scores: the chosen rows' vectors are fetched, then each group's queries come to theirs.
    chosen = materialize(chosen, "ann-chosen")
    cells = max(1, -(-n_queries // 128))
    cell = lambda c: F.pmod(F.xxhash64(c, F.lit(3)), F.lit(cells))
    fetched = chosen.hint("merge").join(classes.select("key", "vector", "ids"), F.col("row") == F.col("key")).select(cell("query").alias("cell"), "query", "row", F.col("vector").alias("row_vector"), "ids")
    theirs = classes.where("wanted").select(cell("key").alias("at"), "key", "vector")

    def rerank(queries: pa.Table, rows: pa.Table) -> pa.Table:
        vector = dict(zip(queries["key"].to_pylist(), queries["vector"].to_pylist(), strict=True))
        held: dict[bytes, tuple[list, list, list]] = {}
        for q, row, v, ids in zip(*(rows[c].to_pylist() for c in ("query", "row", "row_vector", "ids")), strict=True):
            at = held.setdefault(q, ([], [], []))
            at[0].append(row)
            at[1].append(v)
            at[2].append(ids)
        keys, ids, scores, selves = [], [], [], []
        for q, (rows_of, vectors_of, ids_of) in held.items():
            x = np.frombuffer(b"".join(vectors_of), kind).reshape(-1, d).astype(float)
            s = (x * np.frombuffer(vector[q], kind).astype(float)).sum(1)
            times = [len(v) for v in ids_of]
            flat, score = np.concatenate(ids_of), np.repeat(s, times)
            same = np.repeat([v == q for v in rows_of], times)
            order = np.lexsort((flat, -score))[: k + 1]
            keys.append(q)
            ids.append(flat[order])
            scores.append(score[order])
            selves.append(same[order])
        return pa.table([pa.array(keys, pa.binary()), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64())), pa.array(selves, pa.list_(pa.bool_()))], names=["key", "ids", "scores", "own"])

    exact = theirs.groupBy("at").cogroup(fetched.groupBy("cell")).applyInArrow(rerank, "key binary, ids array<long>, scores array<double>, own array<boolean>")
    # A query's own row is one entry of its id and its vector, if it is among the first k + 1 at all.
    every_query = asked.hint("merge").join(exact, F.col("query_key") == F.col("key"))
    place = F.array_position(F.zip_with("ids", "own", lambda i, o: o & (i == F.col("query_id"))), True)
    pairs = F.filter(F.arrays_zip("ids", "scores"), lambda _, i: i + 1 != F.col("place"))
    out = every_query.withColumn("place", place).select("query_id", F.posexplode(F.slice(pairs, 1, k)).alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))
