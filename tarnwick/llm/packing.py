"""Packing into token windows by Karmarkar-Karp multiway differencing (operator 3).

Each task tokenizes its documents and packs them as it goes, so nothing is shuffled. A document's full windows are
sequences of their own; what is left is cut into pieces of at most ``grain`` tokens. A group of pieces (bounded by
``group_tokens``) is split into m = ceil(tokens / window) parts by differencing: the two partial partitions of largest
imbalance are merged, the largest part of one on the smallest of the other. While a part exceeds the window, m rises.

Defined cases: null or empty text is the end token alone; repeated rows are packed each; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern of byte-level BPE files without one of their own.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Outside the characters on which both libraries were verified to agree, or in a special token's string.
_ODD = re.compile("[^\t\n\r -~ -ɏ‐-‧‰-⁞€]|<\\|")
_worker: dict = {}


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others for code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """A function from text to uint32 ids equal to the tokenizers library's for the byte-level BPE file at path.

    The file's own vocabulary drives the faster BPE engine; odd texts go to the tokenizers library itself.
    """
    if _worker.get("path") == path:
        return _worker["encode"]
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        stated = json.load(f)
    special = {x["content"] for x in stated.get("added_tokens", [])}
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in stated["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("from-file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if _ODD.search(text):
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    _worker.update(path=path, encode=encode)
    return encode


def difference(sizes: list[int], m: int) -> tuple[np.ndarray, int]:
    """Karmarkar-Karp: the part (0..m-1) of each item, and the largest part's size."""
    n = len(sizes)
    order = sorted(range(n), key=lambda i: (-sizes[i], i))
    heap = [(-sizes[i], k, [sizes[i]], [i]) for k, i in enumerate(order)]
    heapq.heapify(heap)
    merges: list[tuple[list[int], list[int], int]] = []
    node, tick = n, n
    while len(heap) > 1:
        _, _, a, an = heapq.heappop(heap)
        _, _, b, bn = heapq.heappop(heap)
        if len(a) + len(b) <= m:
            if a[-1] >= b[0]:
                sums, nodes = a + b, an + bn
            else:
                both = sorted([*zip(a, an, strict=True), *zip(b, bn, strict=True)], key=lambda x: -x[0])
                sums, nodes = [x[0] for x in both], [x[1] for x in both]
        else:
            left, right = np.zeros(m, np.int64), np.zeros(m, np.int64)
            left[: len(a)], right[m - len(b) :] = a, b[::-1]
            ln, rn = np.full(m, -1, np.int64), np.full(m, -1, np.int64)
            ln[: len(a)], rn[m - len(b) :] = an, bn[::-1]
            total = left + right
            merges.append((ln, rn, node))
            down = np.argsort(-total, kind="stable")
            nodes = (node + down).tolist()
            node += m
            total = total[down]
            sums = (total - total[-1]).tolist()
        tick += 1
        heapq.heappush(heap, (-(sums[0] - (sums[-1] if len(sums) == m else 0)), tick, sums, nodes))
    part = np.zeros(node, np.int64)
    nodes = heap[0][3]
    part[nodes] = np.arange(len(nodes))
    for ln, rn, base in reversed(merges):
        own = part[base : base + m]
        part[ln[ln >= 0]] = own[ln >= 0]
        part[rn[rn >= 0]] = own[rn >= 0]
    out = part[:n]
    return out, int(np.bincount(out, weights=sizes, minlength=m).max())


def partition(sizes: list[int], window: int) -> np.ndarray:
    """Parts of at most window tokens; their number starts at the least possible and rises while one is too large."""
    total = sum(sizes)
    m = max(1, math.ceil(total / window))
    while True:
        part, most = difference(sizes, m)
        if most <= window:
            return part
        over = most - total / m
        m = max(m + 1, math.ceil(total / max(window - over, window / 2)) if total / m + over > window else m + 1)


def padding(length: int, window: int) -> int:
    """Tokens of padding of a sequence: none where its length is the window or a power of two."""
    return 0 if length & (length - 1) == 0 else window - length


def pack(docs: DataFrame, path: str, window: int = 1024, grain: int = 128, group_tokens: int = 1_000_000) -> DataFrame:
    """docs(doc_id, text) -> a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        items: list[tuple] = []
        held = 0

        def flush() -> None:
            nonlocal sequence, held
            if not items:
                return
            part = partition([x[2] for x in items], window)
            offset = [0] * (int(part.max()) + 1)
            for x, p in zip(items, part.tolist(), strict=True):
                rows.append((*x, sequence + p, offset[p]))
                offset[p] += x[2]
            sequence += len(offset)
            items.clear()
            held = 0

        def out() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=list(names))
            rows.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(0)).astype("<u4")
                raw, n, at = memoryview(ids.tobytes()), len(ids), 0
                while at < n:
                    size = window if n - at >= window else min(grain, n - at)
                    piece = (doc, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), n)
                    if size == window:
                        rows.append((*piece, sequence, 0))
                        sequence += 1
                    else:
                        items.append(piece)
                        held += size
                    at += size
                if held >= group_tokens:
                    flush()
            if rows:
                yield out()
        flush()
        if rows:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ", ".join(f"{c} long" for c in names))
