"""Suffix-array dedup of long repeated byte strings (operator 1).

Every ``width``-byte window has an anchor, the least hashed k-gram in it, so equal windows share it wherever they are.
A run of windows with one anchor is a piece; equal windows lie in pieces of equal anchor, which go to one bucket. Equal
pieces are one entry with a weight. A bucket keeps anchors that occur more than once, fetches the bytes of their
distinct pieces and builds a suffix array over them in two stages: only suffixes smaller than their successors are
sorted directly, the rest is induced by scanning the character buckets in order. Adjacent common prefixes of at least
``width`` bytes mark repeated windows. Anchors of more than ``most`` pieces, by a count sketch over all documents, are
dealt window by window instead, so that they spread: no bucket's suffix array grows with one passage's share. (A
sketch's cell that several anchors share may send a rare one that way too; the result is the same.)

Documents are kept as blocks of about 12 MB in a bucketed table of the shared folder; verdicts go to the blocks, so the
text is moved once. Defined cases: null text is empty; texts shorter than ``width`` keep all; repeated rows are separate
documents, so all of each goes if it is long enough; cuts may fall inside a character; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, even_keys, materialize, partitions, placed, shared_dir
from .sketches import SLICES, press, summed

WIDTH, K = 200, 32
BLOCK_BYTES, CHUNK = 12_000_000, 1_000_000
_B = 0xD6E8FEB86659FD93
_BI = pow(_B, -1, 1 << 64)
_C1, _C2, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("b", ())) < n:
        for key, base in (("b", _B), ("i", _BI)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[key] = np.cumprod(p, dtype=np.uint64)
    return _powers["b"][:n], _powers["i"][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * _C1
    h = (h ^ (h >> _S)) * _C2
    return h ^ (h >> _S)


def _sliding(f: np.ufunc, a: np.ndarray, span: int) -> np.ndarray:
    """f (minimum or maximum) over every span neighbours, by doubling."""
    have = 1
    while 2 * have <= span:
        a = f(a[:-have], a[have:])
        have *= 2
    return f(a[: len(a) - (span - have)], a[span - have :]) if have < span else a


def pieces(t: np.ndarray, ends: np.ndarray, width: int = WIDTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, windows, anchors, again) of the pieces of documents that lie in t one after another, ending at ends.

    again: whether the anchor may stand more than once in the piece, which may then hold a window twice.
    """
    n = len(t)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    up, down = _pow(n + 1)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum((t.astype(np.uint64) + np.uint64(1)) * down[:n], out=s[1:])
    grams = _mix((s[k:] - s[:-k]) * up[: n - k + 1])
    least = _sliding(np.minimum, grams, width - k + 1)
    starts = np.append(0, ends[:-1])
    lens = ends - starts
    ok = np.zeros(len(least) + 1, np.int8)
    good = lens >= width
    np.add.at(ok, starts[good], 1)
    np.add.at(ok, ends[good] - width + 1, -1)
    ok = np.cumsum(ok[:-1]).astype(bool)
    new = ok.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~ok[:-1]
    firsts = starts[good]
    new[firsts] = True
    at = np.flatnonzero(new)
    stop = np.flatnonzero(ok & ~np.append(ok[1:], False))
    last = np.minimum(np.append(at[1:], len(least)) - 1, stop[np.searchsorted(stop, at)]) if len(at) else at
    edge = np.zeros(width - k, np.uint64)
    chosen = np.flatnonzero(grams == _sliding(np.maximum, np.concatenate([edge, least, edge]), width - k + 1))
    twice = grams[chosen[1:]][grams[chosen[1:]] == grams[chosen[:-1]]]
    again = np.isin(least[at], twice) if len(twice) else np.zeros(len(at), bool)
    return at, last - at + 1, least[at], again


def two_stage_suffix_array(t: np.ndarray, ends: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Suffixes of texts that lie in t one after another, sorted to at least depth bytes; a text's end sorts first.

    Stage one sorts the suffixes smaller than their successors directly, 8 bytes a round, ties only. Stage two scans
    the character buckets upwards; a bucket's remaining suffixes are the predecessors of those already in order.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    lens = np.diff(np.append(0, ends))
    end = np.repeat(ends, lens)
    last = np.zeros(n, bool)
    last[ends[lens > 0] - 1] = True
    first = np.zeros(n, bool)
    first[(ends - lens)[lens > 0]] = True
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1].astype(np.int16))
    step[last] = -1
    decided = np.where(step != 0, np.arange(n), n)
    rising = step[np.minimum.accumulate(decided[::-1])[::-1]] > 0

    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j : n + j]

    def key(at: np.ndarray, skip: int) -> np.ndarray:
        left = end[at] - at - skip
        w = word[np.minimum(at + skip, n - 1)]
        cut = np.clip(8 - left, 0, 8).astype(np.uint64) * np.uint64(8)
        return np.where(left <= 0, np.uint64(0), (w >> np.minimum(cut, np.uint64(63))) << np.minimum(cut, np.uint64(63)))

    direct = np.flatnonzero(rising)
    first_key = key(direct, 0)
    by = np.argsort(first_key, kind="stable")
    direct, first_key = direct[by], first_key[by]
    new = np.append(True, first_key[1:] != first_key[:-1]) if len(direct) else np.zeros(0, bool)
    for skip in range(8, depth, 8):
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        w = key(direct[tied], skip)
        apart = np.append(False, (w[1:] != w[:-1]) & ~new[tied[1:]])
        if not apart.any():
            continue
        group = np.cumsum(new[tied])
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[apart]] = True
        part = np.flatnonzero(mixed[group])
        order = part[np.lexsort((w[part], group[part]))]
        direct[tied[part]] = direct[tied[order]]
        w[part] = w[order]
        new[tied[1:]] |= (w[1:] != w[:-1]) & (group[1:] == group[:-1])

    edges = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def hand_on(done: np.ndarray, above: int) -> None:
        before = done[~first[done]] - 1
        before = before[t[before] > above]
        by = np.argsort(t[before], kind="stable")
        before = before[by]
        cuts = np.flatnonzero(np.append(True, t[before][1:] != t[before][:-1])) if len(before) else []
        for x in np.split(before, cuts[1:]) if len(before) else []:
            waiting[t[x[0]]].append(x)

    finals = ends[lens > 0] - 1
    by = np.argsort(t[finals], kind="stable")
    for c in np.unique(t[finals]):
        waiting[c].append(finals[by][t[finals][by] == c])
    out = []
    for c in range(256):
        falling = list(waiting[c])
        front = np.concatenate(falling) if falling else np.zeros(0, np.int64)
        falling = [front]
        while len(front):
            front = front[~first[front]] - 1
            front = front[t[front] == c]
            falling.append(front)
        done = np.concatenate([*falling, direct[edges[c] : edges[c + 1]]])
        out.append(done)
        hand_on(done, c)
    return np.concatenate(out)


def common_prefixes(t: np.ndarray, suffixes: np.ndarray, most: int = WIDTH) -> np.ndarray:
    """Common prefix of each suffix with the one before it, in whole 8 bytes up to most; all have most bytes left."""
    n = len(t)
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j : n + j]
    out = np.zeros(len(suffixes), np.int64)
    alive = np.arange(1, len(suffixes))
    for skip in range(0, most, 8):
        alive = alive[word[suffixes[alive] + skip] == word[suffixes[alive - 1] + skip]]
        out[alive] = skip + 8
    return out


def repeated_windows(t: np.ndarray, ends: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For every position of t whether its window lies in its text and starts at another position too."""
    sa = two_stage_suffix_array(t, ends, width)
    end = np.repeat(ends, np.diff(np.append(0, ends)))
    sa = sa[end[sa] - sa >= width]
    same = common_prefixes(t, sa, width) >= width
    out = np.zeros(len(t), bool)
    out[sa[same]] = True
    out[sa[np.flatnonzero(same) - 1]] = True
    return out


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(a.tobytes(), 1)


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1) - 1


_BLOCK = "block long, ids binary, nulls binary, ends binary, text binary, starts binary, windows binary, which binary, anchors binary, hashes binary, weights binary"


def _chunked_pieces(blob: bytes, ends: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """pieces() of the documents of a block, about a CHUNK of bytes at a time."""
    i = base = 0
    while i < len(ends):
        j = int(max(i + 1, np.searchsorted(ends, base + CHUNK, "right")))
        s, w, a, g = pieces(np.frombuffer(blob, np.uint8, int(ends[j - 1]) - base, base), ends[i:j] - base, width)
        yield s + base, w, a, g
        i, base = j, int(ends[j - 1])


def _block_row(block: int, ids: list, texts: list[bytes], width: int, heavy: np.ndarray) -> tuple:
    blob = b"".join(texts)
    ends = np.cumsum([len(x) for x in texts]).astype(np.int64)
    starts, windows, anchors, again = map(np.concatenate, zip(*_chunked_pieces(blob, ends, width), strict=True))
    view = memoryview(blob)
    digest = xxhash.xxh3_64_intdigest
    hot = heavy[(anchors & np.uint64(len(heavy) - 1)).astype(np.int64)]
    if hot.any():
        w = windows[hot]
        single = np.repeat(starts[hot], w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        own = np.fromiter((digest(view[s : s + width], seed=1) for s in single.tolist()), np.uint64, len(single))
        starts = np.concatenate([starts[~hot], single])
        windows = np.concatenate([windows[~hot], np.ones(len(single), np.int64)])
        anchors = np.concatenate([anchors[~hot], own])
        again = np.concatenate([again[~hot], np.zeros(len(single), bool)])
    hashes = np.fromiter((digest(view[s:e]) for s, e in zip(starts.tolist(), (starts + windows + width - 1).tolist(), strict=True)), np.uint64, len(starts))
    order = np.lexsort((hashes, anchors))
    fresh = np.append(True, (anchors[order][1:] != anchors[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])) if len(order) else np.zeros(0, bool)
    which = np.empty(len(order), np.int32)
    which[order] = np.cumsum(fresh) - 1
    kept = order[fresh]
    weights = (np.minimum(np.bincount(which, minlength=len(kept)), 2) + 4 * again[kept]).astype(np.uint8)
    null = np.array([v is None for v in ids], np.int8)
    ids = np.array([0 if v is None else v for v in ids], np.int64)
    z = zstandard.compress(blob, 3)
    return (block, _pack(ids), _pack(null), _pack(ends), z, _pack(starts.astype(np.int64)), _pack(windows.astype(np.int32)), _pack(which), _pack(anchors[kept]), _pack(hashes[kept]), _pack(weights))


def _rows_batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)


def _blocks(width: int, heavy):
    names, kinds = [x.split()[0] for x in _BLOCK.split(", ")], [pa.int64(), *[pa.binary()] * 10]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = x.as_py() or b""
                if texts and held + len(text) > BLOCK_BYTES:
                    yield _rows_batch([_block_row(block, ids, texts, width, heavy.value)], names, kinds)
                    block, ids, texts, held = block + 1, [], [], 0
                ids.append(doc)
                texts.append(text)
                held += len(text)
        if ids:
            yield _rows_batch([_block_row(block, ids, texts, width, heavy.value)], names, kinds)

    return run


def _deal(n_buckets: int, keys: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, a, h, w in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                anchors, hashes, weights = _unpack(a, np.uint64), _unpack(h, np.uint64), _unpack(w, np.uint8)
                bucket = (anchors % np.uint64(n_buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
                rows = [(keys[k], block, _pack(anchors[at]), _pack(hashes[at]), _pack(weights[at]), _pack(at.astype(np.int32))) for k in range(n_buckets) if len(at := by[ends[k] : ends[k + 1]])]
                yield _rows_batch(rows, ["bucket", "block", "anchors", "hashes", "weights", "local"], [pa.int64(), pa.int64(), *[pa.binary()] * 4])

    return run


_DECIDED = "kind int, at long, other long, a binary, b binary, c binary, d binary"


def _decide(table: pa.Table) -> pa.Table:
    """A bucket's repeated anchors: kind 0 at the bucket (holders of each piece), kind 1 at a block (pieces to fetch)."""
    key = table["bucket"][0].as_py()
    cat = lambda c, k: np.concatenate([_unpack(x, k) for x in table[c].to_pylist()])
    anchors, hashes, weights, local = cat("anchors", np.uint64), cat("hashes", np.uint64), cat("weights", np.uint8).astype(np.int64), cat("local", np.int32)
    sizes = [len(_unpack(x, np.int32)) for x in table["local"].to_pylist()]
    blocks = np.repeat(np.array(table["block"].to_pylist(), np.int64), sizes)
    order = np.lexsort((local, blocks, hashes, anchors))
    anchors, hashes, weights, local, blocks = (x[order] for x in (anchors, hashes, weights, local, blocks))
    new_anchor = np.append(True, anchors[1:] != anchors[:-1])
    new_piece = new_anchor | np.append(True, hashes[1:] != hashes[:-1])
    group, piece = np.cumsum(new_anchor) - 1, np.cumsum(new_piece) - 1
    weights, again = weights & 3, np.bincount(group, weights >> 2) > 0
    total, distinct = np.bincount(group, weights), np.bincount(group, new_piece)
    often = np.bincount(piece, weights) >= 2
    held = (total >= 2)[group] | again[group]
    sort_it = held & ((distinct >= 2) | again)[group]
    rows = [(0, key, 0, _pack(piece[held].astype(np.int32)), _pack(blocks[held]), _pack(local[held]), _pack((often[piece] + 2 * sort_it)[held].astype(np.uint8)))]
    fetch = np.flatnonzero(sort_it & new_piece)
    fetch = fetch[np.argsort(blocks[fetch], kind="stable")]
    cuts = np.flatnonzero(np.append(True, blocks[fetch][1:] != blocks[fetch][:-1])) if len(fetch) else []
    for part in np.split(fetch, cuts[1:]) if len(fetch) else []:
        rows.append((1, int(blocks[part[0]]), key, _pack(local[part]), _pack(piece[part].astype(np.int32)), b"", b""))
    return pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["kind", "at", "other", "a", "b", "c", "d"])


def _fetch(width: int):
    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        rows = []
        if block.num_rows and asked.num_rows:
            x = block.to_pylist()[0]
            blob, starts, windows, which = zstandard.decompress(x["text"]), _unpack(x["starts"], np.int64), _unpack(x["windows"], np.int32), _unpack(x["which"], np.int32)
            one = np.empty(which.max() + 1 if len(which) else 0, np.int64)
            one[which[::-1]] = np.arange(len(which))[::-1]
            for bucket, local, piece in zip(*(asked[c].to_pylist() for c in ("other", "a", "b")), strict=True):
                at = one[_unpack(local, np.int32)]
                lens = windows[at] + width - 1
                rows.append((bucket, piece, _pack(lens.astype(np.int32)), zstandard.compress(b"".join(blob[s : s + k] for s, k in zip(starts[at].tolist(), lens.tolist(), strict=True)), 1)))
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), *[pa.binary()] * 3), strict=True)], names=["bucket", "piece", "lens", "text"])

    return run


def _sort(width: int):
    """A bucket's suffix array: for each block its local pieces' runs of repeated windows (-1 to -1: all)."""

    def run(held: pa.Table, texts: pa.Table) -> pa.Table:
        out = []
        if held.num_rows:
            x = held.to_pylist()[0]
            piece, blocks, local, flag = _unpack(x["a"], np.int32), _unpack(x["b"], np.int64), _unpack(x["c"], np.int32), _unpack(x["d"], np.uint8)
            runs: dict[int, list] = {int(p): [(-1, -1)] for p in np.unique(piece[(flag & 1) > 0])}
            if texts.num_rows:
                ids = np.concatenate([_unpack(v, np.int32) for v in texts["piece"].to_pylist()])
                lens = np.concatenate([_unpack(v, np.int32) for v in texts["lens"].to_pylist()]).astype(np.int64)
                t = np.frombuffer(b"".join(zstandard.decompress(v) for v in texts["text"].to_pylist()), np.uint8)
                ends = np.cumsum(lens)
                first, last = _runs_within(repeated_windows(t, ends, width), ends - lens)
                owner = np.searchsorted(ends, first, "right")
                for p, a, b in zip(ids[owner].tolist(), (first - (ends - lens)[owner]).tolist(), (last - (ends - lens)[owner]).tolist(), strict=True):
                    if runs.get(p) != [(-1, -1)]:
                        runs.setdefault(p, []).append((a, b))
            counts = np.array([len(runs.get(p, ())) for p in piece.tolist()], np.int64)
            flat = np.array([r for p in piece.tolist() for r in runs.get(p, ())], np.int32).reshape(-1, 2)
            who, where = np.repeat(local, counts), np.repeat(blocks, counts)
            by = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.append(True, where[by][1:] != where[by][:-1])) if len(by) else []
            for at in np.split(by, cuts[1:]) if len(by) else []:
                out.append((int(where[at[0]]), _pack(who[at]), _pack(flat[at, 0]), _pack(flat[at, 1])))
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), *[pa.binary()] * 3), strict=True)], names=["to", "local", "first", "last"])

    return run


def _runs_within(mask: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of mask, cut at starts (a piece's last width - 1 positions are never marked, so none crosses)."""
    return _runs(mask)


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _apply(width: int, with_text: bool):
    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        x = block.to_pylist()[0]
        blob, ends = zstandard.decompress(x["text"]), _unpack(x["ends"], np.int64)
        ids, null = _unpack(x["ids"], np.int64), _unpack(x["nulls"], np.int8).astype(bool)
        change = np.zeros(len(blob) + 1, np.int32)
        if found.num_rows:
            starts, windows, which = _unpack(x["starts"], np.int64), _unpack(x["windows"], np.int32), _unpack(x["which"], np.int32)
            by = np.argsort(which, kind="stable")
            edges = np.searchsorted(which[by], np.arange((which.max() if len(which) else -1) + 2))
            local, first, last = (np.concatenate([_unpack(v, np.int32) for v in found[c].to_pylist()]).astype(np.int64) for c in ("local", "first", "last"))
            n = edges[local + 1] - edges[local]
            at = by[np.repeat(edges[local] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            a, b = np.repeat(first, n), np.repeat(last, n)
            b = np.where(a < 0, windows[at] - 1, b)
            a = np.maximum(a, 0)
            np.add.at(change, starts[at] + a, 1)
            np.add.at(change, starts[at] + b + width, -1)
        gone = np.cumsum(change[:-1]) > 0
        rows, begin = [], 0
        for doc, is_null, end in zip(ids.tolist(), null.tolist(), ends.tolist(), strict=True):
            mask = gone[begin:end]
            removed = int(mask.sum())
            kept = blob[begin:end] if not removed else np.frombuffer(blob, np.uint8, end - begin, begin)[~mask].tobytes()
            spans = len(_runs(mask)[0]) if removed else 0
            row = (None if is_null else doc, end - begin, removed, spans, hashlib.sha256(kept).hexdigest())
            rows.append((*row, kept.decode("utf-8", "ignore"), hashlib.sha256(blob[begin:end]).hexdigest()) if with_text else row)
            begin = end
        kinds = [*[pa.int64()] * 4, *[pa.string()] * (1 + 2 * with_text)]
        names = [v.split()[0] for v in _OUT.split(", ")] + ["kept_text", "text_sha256"] * with_text
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def heavy_anchors(docs: DataFrame, width: int, most: int, bits: int = 20) -> np.ndarray:
    """Which cells of the anchors' low bits hold too many pieces, counted over all documents.

    Too many is over most, and over a quarter of the median cell, more than the median: where cells are full, pieces
    that come in copies make their counts uneven, and an anchor of less is small beside the bucket that it lies in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(0)]
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                for _, _, a, _ in _chunked_pieces(b"".join(part), np.cumsum([len(x) for x in part]).astype(np.int64), width):
                    np.add.at(sketch, (a & np.uint64((1 << bits) - 1)).astype(np.int64), 1)
        if sketch.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int64()), pa.array(press(sketch), pa.binary())], names=["n", "payload"])

    counted = materialize(docs.select("text").mapInArrow(run, "n long, payload binary"), "suffix-sketch")
    counts = summed(counted, bits).astype(np.int64)
    discard(counted)
    return hot_cells(counts, most)


def hot_cells(counts: np.ndarray, most: int) -> np.ndarray:
    usual = int(np.median(counts))
    return counts - usual > max(most, usual // 4)


def sketch_bits(n_buckets: int) -> int:
    """At least four cells a bucket, so that no cell outweighs the bucket its anchors go to; 2^20 or more."""
    return max(20, (4 * n_buckets - 1).bit_length())


def _bucketed(df: DataFrame, key: str, n: int, tag: str) -> DataFrame:
    """Write df bucketed by key in the shared folder, so that later joins on key don't move it."""
    spark: SparkSession = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    df.write.option("compression", "uncompressed").option("path", path).bucketBy(n, key).saveAsTable(name)
    return placed(spark.table(name), path, name)


def dedup(docs: DataFrame, width: int = WIDTH, with_text: bool = False, most: int = 8192) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, cut at whole characters; text_sha256 names the whole text)."""
    spark = docs.sparkSession
    if width < 2 * K or width % 8:
        raise ValueError(f"width is a multiple of 8 and at least {2 * K}")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    p = partitions(spark)
    heavy = spark.sparkContext.broadcast(heavy_anchors(docs, width, most, sketch_bits(4 * p)))
    blocks = _bucketed(docs.mapInArrow(_blocks(width, heavy), _BLOCK), "block", p, "suffix_blocks")
    dealt = blocks.select("block", "anchors", "hashes", "weights").mapInArrow(_deal(4 * p, even_keys(4 * p, p)), "bucket long, block long, anchors binary, hashes binary, weights binary, local binary")
    decided = materialize(dealt.groupBy("bucket").applyInArrow(_decide, _DECIDED), "suffix-pieces")
    asked = decided.where("kind = 1").select(F.col("at").alias("to_block"), "other", "a", "b")
    own = blocks.select("block", "text", "starts", "windows", "which")
    texts = own.groupBy("block").cogroup(asked.groupBy("to_block")).applyInArrow(_fetch(width), "bucket long, piece binary, lens binary, text binary")
    holders = decided.where("kind = 0").select("at", "a", "b", "c", "d")
    found = materialize(holders.groupBy("at").cogroup(texts.groupBy("bucket")).applyInArrow(_sort(width), "to long, local binary, first binary, last binary"), "suffix-runs")
    discard(decided)
    return blocks.select("block", "ids", "nulls", "ends", "text", "starts", "windows", "which").groupBy("block").cogroup(found.groupBy("to")).applyInArrow(_apply(width, with_text), _OUT + ", kept_text string, text_sha256 string" * with_text)
