"""Merkle dataset manifest, broadcast upper-tree variant (operator 11).

Leaves are hashed by Spark's own functions and written without their texts. They are sorted by ranges of (group, key),
so a group with any share of the rows spreads over tasks, and numbered in their group from the counts of each range.
Blocks of 3^k neighbours are reduced in tasks; k follows from the number of rows so that the blocks of groups with more
than one block are at most ``top`` nodes. The driver builds the trees above these, and above the groups' own roots, and
broadcasts them; executors derive each block's suffix path and finish proofs and folds row by row. If there are more
than ``top`` groups, the tree above their roots is built the same way, by blocks, and each block gets its path as a row.

A node is H, lowercase hex sha256, of up to three nodes' hex digests; runs of one are hashed too.

Defined cases: null columns are hashed as -; a null key comes first in its group, rows with equal keys go by leaf; equal
rows are equal leaves side by side; a null group comes first; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, partitions

FAN = 3
#: A step of a proof, one character a level: the length of the run and the own place in it.
STEPS = {(size, place): "abcdef"[size * (size - 1) // 2 + place] for size in (1, 2, 3) for place in range(size)}
RUNS = {step: run for run, step in STEPS.items()}


def encoded(columns: dict[str, Column]) -> Column:
    """The columns' values in order, each - if null, else its length in UTF-8 bytes, a colon and itself."""
    text = lambda c: c.cast("string")
    return F.concat(*(F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns.values()))


def node(digests: list[bytes]) -> bytes:
    return sha256(b"".join(digests)).hexdigest().encode()


def levels(nodes: list[bytes], height: int | None = None) -> list[list[bytes]]:
    """The levels above and with nodes: so many, or up to the root."""
    found = [nodes]
    while len(nodes) > 1 if height is None else len(found) <= height:
        nodes = [node(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
        found.append(nodes)
    return found


def proofs(tree: list[list[bytes]], upper: tuple[bytes, str]) -> Iterator[tuple[bytes, str]]:
    """(siblings' digests, steps) of every leaf in order, continued by upper; what neighbours share is built once."""
    depth = len(tree) - 1
    held = [upper] * (depth + 1)
    for i in range(len(tree[0])):
        top = 0
        while top + 1 < depth and i % FAN ** (top + 1) == 0:
            top += 1
        for j in range(min(top, depth - 1), -1, -1):
            at = i // FAN**j
            run, own = tree[j][at - at % FAN : at - at % FAN + FAN], at % FAN
            held[j] = (b"".join(run[:own] + run[own + 1 :]) + held[j + 1][0], STEPS[len(run), own] + held[j + 1][1])
        yield held[0]


def proof_of(tree: list[list[bytes]], i: int) -> tuple[bytes, str]:
    """(siblings' digests, steps) of one leaf."""
    found, steps = [], ""
    for nodes in tree[:-1]:
        run, own = nodes[i - i % FAN : i - i % FAN + FAN], i % FAN
        found += run[:own] + run[own + 1 :]
        steps, i = steps + STEPS[len(run), own], i // FAN
    return b"".join(found), steps


def fold(leaf: bytes, siblings: bytes, steps: str) -> bytes:
    """The root that a leaf and a proof lead to."""
    at = 0
    for step in steps:
        size, place = RUNS[step]
        here = siblings[at : at + 64 * (size - 1)]
        at += len(here)
        leaf = node([here[: 64 * place], leaf, here[64 * place :]])
    return leaf


def numbered(nodes: DataFrame, tag: str) -> DataFrame:
    """nodes(grp, key, leaf, at, ...) -> with rank, its place in its group by (key, leaf, at), and n, the group's size.

    Sorted by ranges; a range's rows of a group are numbered on from the counts of the ranges before.
    """
    order = ("grp", "key", "leaf", "at")
    rows = nodes.repartitionByRange(partitions(nodes.sparkSession), *order).sortWithinPartitions(*order)
    rows = materialize(rows.withColumn("pos", F.monotonically_increasing_id()), tag)  # 2^33 a task, in order
    rows = rows.withColumn("part", F.shiftright("pos", 33))
    runs = rows.groupBy("part", "grp").agg(F.count("*").alias("rows"), F.min("pos").alias("first"))
    group = Window.partitionBy("grp")
    before = F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col("part").alias("p"), F.col("grp").alias("g"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(group).alias("n"))
    rows = rows.join(runs, (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")))
    return rows.withColumn("rank", F.col("pos") + F.col("shift")).drop("p", "g", "part", "pos", "shift", "at")


def height(n: int, top: int, least: int) -> int:
    """The least k of 3^k leaves a block with which the blocks of groups of several blocks, under 2 n / 3^k, are at most top."""
    k = least
    while 2 * n > top * FAN**k:
        k += 1
    return k


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[list]]]:
    """Rows sorted by their first two columns -> ((grp, block), the other columns' values) of each run of them."""
    key, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        if not columns[0]:
            continue
        at, rest = 0, columns[2:]
        keys = list(zip(columns[0], columns[1], strict=True))
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[at]:
                if held is None or keys[at] != key:
                    if held is not None:
                        yield key, held
                    key, held = keys[at], [[] for _ in rest]
                for to, c in zip(held, rest, strict=True):
                    to += c[at:i]
                at = i
    if held is not None:
        yield key, held


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "rank").select("grp", "block", *columns)


def block_roots(rows: DataFrame, k: int) -> DataFrame:
    """rows(grp, block, rank, n, leaf) -> grp, block, n, root: a block of a group of several is raised k levels, else to its root."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"grp": pa.string(), "block": pa.int64(), "n": pa.int64(), "root": pa.string()}
        batch = lambda found: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds.values(), strict=True)], names=list(kinds))
        found = []
        for (grp, block), (n, leaf) in _blocks(batches):
            nodes = [x.hex().encode() for x in leaf]
            found.append((grp, block, n[0], levels(nodes, k if n[0] > FAN**k else None)[-1][0].decode()))
            if len(found) == 1000:
                yield batch(found)
                found = []
        if found:
            yield batch(found)

    return _dealt(rows, "n", "leaf").mapInArrow(reduce, "grp string, block long, n long, root string")


def upper_trees(blocks: DataFrame, k: int) -> dict:
    """The driver's trees above the blocks of groups of several: grp -> levels. At most ``top`` blocks, by the choice of k."""
    found: dict = {}
    for r in blocks.where(F.col("n") > FAN**k).orderBy("grp", "block").collect():
        found.setdefault(r["grp"], []).append(r["root"].encode())
    return {g: levels(nodes) for g, nodes in found.items()}


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", group: str = "source", check: dict[str, Column] | None = None, top: int = FAN**11, least: int = 6) -> DataFrame:
    """docs -> key and group columns, leaf, subroot, root, proof (siblings' digests), steps, folded_root, verified.

    check: columns to put in the place of the table's before a row is folded, to verify other texts against the manifest.
    least: the least k of blocks of 3^k rows.
    """
    spark = docs.sparkSession
    own = {c: F.col(c) for c in columns}
    digest = lambda c: F.unhex(F.sha2(encoded(c).cast("binary"), 256))
    leaves = docs.select(F.col(group).cast("string").alias("grp"), F.col(key).cast("long").alias("key"), digest(own).alias("leaf"), digest(own | check).alias("checked") if check else F.lit(None).cast("binary").alias("checked"))
    leaves = leaves.withColumn("checked", F.nullif("checked", "leaf")).withColumn("at", F.monotonically_increasing_id())
    leaves = materialize(leaves, "merkle-leaves")
    k = height(leaves.count(), top, least)
    size = F.lit(FAN**k)
    rows = numbered(leaves, "merkle-sorted").withColumn("block", F.floor(F.col("rank") / size).cast("long"))
    blocks = materialize(block_roots(rows, k), "merkle-blocks")
    upper = upper_trees(blocks, k)

    subroots = blocks.where(F.col("n") <= size).select("grp", "root")
    subroots = subroots.unionByName(spark.createDataFrame([(g, t[-1][0].decode()) for g, t in upper.items()], subroots.schema))
    n_groups = subroots.count()
    known, paths = {}, None
    if n_groups <= top:  # the driver builds this tree whole
        found = sorted(((r["grp"], r["root"].encode()) for r in subroots.collect()), key=lambda x: (x[0] is not None, (x[0] or "").encode()))
        tree = levels([x[1] for x in found]) if found else []
        known = {g: i for i, (g, _) in enumerate(found)}
    else:
        tree, paths = [], _group_paths(materialize(subroots, "merkle-subroots"), n_groups, top, least)
    shared = spark.sparkContext.broadcast((upper, known, tree))

    dealt = rows.select("grp", "block", "rank", "n", "key", "leaf", "checked").withColumns({c: F.lit(None).cast("string") for c in ("root", "siblings", "steps")})
    if paths is not None:
        marks = blocks.join(paths, blocks["grp"].eqNullSafe(paths["g"])).select("grp", "block", F.lit(-1).cast("long").alias("rank"), F.lit(None).cast("long").alias("key"), paths["root"], "siblings", "steps", F.unhex("subroot").alias("leaf"))
        dealt = dealt.unionByName(marks, allowMissingColumns=True)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, known, tree = shared.value
        for (grp, block), (rank, n, key, leaf, checked, root, siblings, steps) in _blocks(batches):
            if rank[0] < 0:
                over, all_root, subroot = (siblings[0].encode(), steps[0]), root[0].encode(), leaf[0].hex().encode()
                n, key, leaf, checked = n[1:], key[1:], leaf[1:], checked[1:]
            else:
                i = known[grp]
                over, all_root, subroot = proof_of(tree, i), tree[-1][0], tree[0][i]
            if grp in upper and n[0] > FAN**k:
                up = proof_of(upper[grp], block)
                over = (up[0] + over[0], up[1] + over[1])
            nodes = [x.hex().encode() for x in leaf]
            found = proofs(levels(nodes, k if n[0] > FAN**k else None), over)
            for at in range(0, len(nodes), 2000):
                part = [(x, c, *next(found)) for x, c in zip(nodes[at : at + 2000], checked[at : at + 2000], strict=True)]
                folded = [fold(c.hex().encode() if c else x, p, s).decode() for x, c, p, s in part]
                m = len(part)
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(key[at : at + m], pa.int64()), "grp": pa.array([grp] * m, pa.string()), "leaf": [p[0].decode() for p in part], "subroot": [subroot.decode()] * m, "root": [all_root.decode()] * m,
                    "proof": [p[2].decode() for p in part], "steps": [p[3] for p in part], "folded_root": folded, "verified": [f.encode() == all_root for f in folded],
                })

    out = _dealt(dealt, "rank", "n", "key", "leaf", "checked", "root", "siblings", "steps").mapInArrow(finish, "key long, grp string, leaf string, subroot string, root string, proof string, steps string, folded_root string, verified boolean")
    return out.withColumnRenamed("key", key).withColumnRenamed("grp", group)


def _group_paths(subroots: DataFrame, n: int, top: int, least: int) -> DataFrame:
    """subroots(grp, root) -> g, subroot, root, siblings, steps: the proofs of more subroots than the driver takes, by blocks."""
    nodes = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.unhex("root").alias("leaf"), F.lit(0).cast("long").alias("at"))
    k = height(n, top, least)
    rows = numbered(nodes, "merkle-groups").withColumn("block", F.floor(F.col("rank") / F.lit(FAN**k)).cast("long"))
    blocks = materialize(block_roots(rows, k), "merkle-group-blocks")
    upper = upper_trees(blocks, k).get("") or levels([blocks.first()["root"].encode()])
    shared = subroots.sparkSession.sparkContext.broadcast(upper)
    discard(blocks)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = shared.value
        for (_, block), (n, key, leaf) in _blocks(batches):
            nodes = [x.hex().encode() for x in leaf]
            over = proof_of(upper, block)
            found = list(proofs(levels(nodes, k if n[0] > FAN**k else None), over))
            yield pa.RecordBatch.from_pydict({"g": pa.array(key, pa.string()), "subroot": [x.decode() for x in nodes], "root": [upper[-1][0].decode()] * len(nodes), "siblings": [p[0].decode() for p in found], "steps": [p[1] for p in found]})

    return materialize(_dealt(rows, "n", "key", "leaf").mapInArrow(finish, "g string, subroot string, root string, siblings string, steps string"), "merkle-paths")
