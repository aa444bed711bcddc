"""Language-model scoring by subword lattice likelihood (operator 6).

The pieces of an existing subword vocabulary, weighted by its own scores, give every segmentation of a word a weight; a
log-space forward recursion over byte positions sums them. The file's scores are ranks, taken by Zipf's law as weights
1 / (rank + 10). In addition ``rounds`` of expectation maximisation over the stems of all training documents adapt the
weights, with the given ones as their prior (``strength`` uses); with rounds=0 they are the file's alone. A word is a
stem and a tail, its closing run of ASCII punctuation (a word of nothing else is a stem). Seen stems have edges of their
own, and so may seen words, at two levels, the corpus and the document's class z:

    P_z(w)  = max(c_z(w) - discount, 0) / N_z + discount * V_z / N_z * P(w)
    P(w)    = max(c(w) - discount, 0) / N + discount * V / N * P(stem) * P(tail)
    P(stem) = mean of k in (tokens, word types) of max(k(stem) - discount, 0) / sum k + discount * S / sum k * P_lattice(stem)

with c, N, V and the S stems counted over all training documents (c_z, N_z, V_z: those of class z; without any, P_z is
P) and P(tail) a byte bigram chain over word types, so P sums to one over all words at most. A document's class is the
nearest of ``classes`` means of byte-pair shares, by k-means over all training documents (few rounds, started from the
farthest of some drawn by hash); it is a function of the text, so the class's share times P_z never exceeds the sum
over all classes. Within a document a used word has one more edge, a copy of its earlier uses, discounted alike: with h
earlier uses among i tokens of t types,

    P(w | history) = (max(h - copy_discount, 0) + (prior + copy_discount * t) * P_z(w)) / (i + prior)

A document's score is the sum of log10 of that over its words and the end token, and of its class's share: its marginal
over all paths. ``added`` names the edges that stand beside the lattice's own ("words", "stems", "classes", "copies"); a
level left out passes its whole weight on to the next, so with added=() and rounds=0 the file's weights alone speak:
P(w) = P_lattice(stem) * P(tail). Words have no edges of their own unless asked for: on fold 2 they lower the sum. The base score is add-0.5 smoothing over the same counts. The discounts, prior and strength were chosen
on fold 2 with the held-out fold put away.

Layout: a task turns its documents into blocks; each block deals its distinct words (with their counts by class and the
documents that hold them) over buckets by a hash of the stem, so a frequent word is one entry a block, no bucket is hot
and a stem's words meet. Buckets count words exactly, are written to the shared folder in rows of bounded size and are
scored there; partial sums go back by block.

Defined cases: null or empty text is the end token alone; a null doc_id is training; repeated rows count each; words
longer than any piece go through single bytes; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import even_keys, fold, materialize, partitions

_P = np.uint64(0x9E3779B97F4A7C15)
_MARKS = string.punctuation.encode()
_STATE = {c: i + 1 for i, c in enumerate(_MARKS)}
STATES = len(_MARKS) + 1
#: Edges that may be added to the lattice's own, and those that are unless others are named.
EDGES = ("words", "stems", "classes", "copies")
ADDED = ("stems", "classes", "copies")


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _press(*arrays: np.ndarray) -> list[bytes]:
    z = zstandard.ZstdCompressor(level=1)
    return [z.compress(a.tobytes()) for a in arrays]


def _open(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def stem_of(word: bytes) -> bytes:
    return word.rstrip(_MARKS) or word


def tail_steps(tail: bytes) -> list[int]:
    """Cells of the tail chain's matrix (row: state before, column: state after; 0 is start and end)."""
    states = [0, *map(_STATE.__getitem__, tail), 0]
    return [a * STATES + b for a, b in zip(states, states[1:], strict=False)]


class Stems:
    """The stems of a bucket's words: their list, each word's stem, and counts of tokens, types and tail steps in training."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        index = _Ids()
        own = [stem_of(w) for w in words]
        self.of = np.fromiter(map(index.__getitem__, own), np.int64, len(own))
        self.stems = list(index)
        self.tails = [w[len(x) :] for w, x in zip(words, own, strict=True)]
        self.tokens = np.bincount(self.of, counts, minlength=len(index))
        self.types = np.bincount(self.of, counts > 0, minlength=len(index))
        self.trained = counts > 0

    def steps(self) -> np.ndarray:
        total = np.zeros(STATES * STATES, np.int64)
        for tail, n in Counter(t for t, k in zip(self.tails, self.trained, strict=True) if k).items():
            for at in tail_steps(tail):
                total[at] += n
        return total

    def tail_logs(self, chain: np.ndarray) -> np.ndarray:
        known: dict[bytes, float] = {}
        for t in set(self.tails):
            known[t] = float(sum(chain[at] for at in tail_steps(t)))
        return np.array([known[t] for t in self.tails])


class Lattice:
    """Pieces and their log weights; words start with a space byte, which stands for the vocabulary's word mark."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.pieces, self.logp, self.longest = pieces, logp, max(map(len, pieces))
        codes = np.array([self._code(p) for p in pieces], np.uint64)
        self.order = np.argsort(codes)
        self.codes = codes[self.order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.codes >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _code(piece: bytes) -> int:
        h = 0
        for c in piece:
            h = (h * int(_P) + c + 1) & (2**64 - 1)
        return h

    def edges(self, a: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of every edge over the padded byte matrix a, by start, then end."""
        width = a.shape[1]
        b = a.astype(np.uint64) + np.uint64(1)
        alive_all = a != 255
        for i in range(width):
            h = np.zeros(len(a), np.uint64)
            for j in range(i, min(width, i + self.longest)):
                if not alive_all[:, j].any():
                    break
                h = h * _P + b[:, j]
                rows = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)] & alive_all[:, j])
                if len(rows):
                    at = np.minimum(np.searchsorted(self.codes, h[rows]), len(self.codes) - 1)
                    hit = self.codes[at] == h[rows]
                    if hit.any():
                        yield i, j + 1, rows[hit], self.order[at[hit]]

    @staticmethod
    def padded(words: list[bytes], most: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(indices, matrix, lengths) of words of about equal length; 255, which no UTF-8 text has, pads."""
        lens = np.array([len(w) + 1 for w in words], np.int64)
        order = np.argsort(lens, kind="stable")
        at = 0
        while at < len(order):
            least = int(lens[order[at]])
            end = min(at + max(1, min(most, 4_000_000 // least)), int(np.searchsorted(lens[order], max(least + 2, least * 9 // 8), "right")))
            part = order[at:end]
            width = int(lens[part[-1]])
            raw = b"".join((b" " + words[k]).ljust(width, b"\xff") for k in part)
            yield part, np.frombuffer(raw, np.uint8).reshape(len(part), width), lens[part]
            at = end

    def forward(self, words: list[bytes]) -> np.ndarray:
        """log of the summed weight of all segmentations of each word."""
        out = np.zeros(len(words))
        for part, a, lens in self.padded(words):
            alpha = np.full((a.shape[1] + 1, len(part)), -np.inf)
            alpha[0] = 0
            for i, j, rows, p in self.edges(a):
                alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + self.logp[p])
            out[part] = alpha[lens, np.arange(len(part))]
        return out

    def expected(self, words: list[bytes]) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words (forward-backward)."""
        total = np.zeros(len(self.pieces))
        for part, a, lens in self.padded(words):
            n, col = len(part), np.arange(len(part))
            alpha, beta = np.full((a.shape[1] + 1, n), -np.inf), np.full((a.shape[1] + 1, n), -np.inf)
            alpha[0], beta[lens, col] = 0, 0
            edges = list(self.edges(a))
            for i, j, rows, p in edges:
                alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + self.logp[p])
            whole = alpha[lens, col]
            for i, j, rows, p in reversed(edges):
                on = beta[j, rows] + self.logp[p]
                beta[i, rows] = np.logaddexp(beta[i, rows], on)
                total += np.bincount(p, np.exp(alpha[i, rows] + on - whole[rows]), minlength=len(total))
        return total


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Lower-case pieces of a sentencepiece model and log weights from its scores; every byte is a piece.

    A BPE model's score is minus its rank: weight 1 / (rank + 10). Pieces of every length are edges.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    weight = {bytes([c]): 1e-7 for c in range(255)}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        piece = sp.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in piece[1:] and piece == piece.lower():
            weight[piece] = max(weight.get(piece, 0.0), 1 / (10 - sp.get_score(i)))
    pieces = sorted(weight)
    w = np.array([weight[p] for p in pieces])
    return pieces, np.log(w / w.sum())


def history(ids: np.ndarray, copy_discount: float, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Of a document's tokens: distinct ids, their counts, and for every later use, by id, the types seen before it.

    Last: the part of the score that needs no word probability (all denominators, and the first uses' numerators).
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    first = np.ones(n, bool)
    first[1:] = ids[order][1:] != ids[order][:-1]
    new = np.zeros(n, np.int32)
    new[order[first]] = 1
    types = np.cumsum(new, dtype=np.int32) - new
    counts = np.diff(np.append(np.flatnonzero(first), n)).astype(np.int32)
    fixed = np.log10(prior + copy_discount * np.arange(len(counts))).sum() - np.log10(np.arange(n) + prior).sum()
    return ids[order[first]], counts, types[order][~first], float(fixed)


def _cut(batches: Iterator[pa.RecordBatch], most: int = 12_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of at most that many bytes of text, or one row: they bound a worker's memory."""
    for batch in batches:
        start = size = 0
        for i, x in enumerate(batch.column(2)):
            n = len(x.as_buffer()) if x.is_valid else 0
            if size and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows:
            yield batch.slice(start)


PAIRS = 1024


def byte_pairs(text: bytes | None) -> np.ndarray:
    """Square roots of the shares of hashed pairs of neighbouring bytes; no text, or one byte: zeros."""
    b = np.frombuffer((text or b"").lower(), np.uint8).astype(np.int32)
    n = np.bincount((b[:-1] * 31 + b[1:] * 7) & (PAIRS - 1), minlength=PAIRS) if len(b) > 1 else np.zeros(PAIRS)
    return np.sqrt(n / max(1, n.sum())).astype(np.float32)


def nearest_class(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    return np.argmax(x @ means.T - (means * means).sum(1) / 2, axis=1)


def document_classes(d: DataFrame, classes: int, rounds: int = 3, drawn: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Means of the classes and their shares of the training documents; every round reads all of them."""
    training = d.where("NOT held_out").select("doc_id", "text")
    ids = F.broadcast(training.select(F.col("doc_id").alias("chosen")).where("chosen IS NOT NULL").distinct().orderBy(F.xxhash64("chosen"), "chosen").limit(drawn))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([byte_pairs(x.as_py()).tobytes() for x in batch.column(1)], pa.binary())], names=["doc_id", "pairs"])

    start = training.join(ids, F.col("doc_id") == F.col("chosen"), "left_semi").mapInArrow(pairs, "doc_id long, pairs binary").orderBy("doc_id", "pairs").limit(drawn).collect()
    x = np.array([np.frombuffer(r[1], np.float32) for r in start] or [np.zeros(PAIRS, np.float32)])
    means = x[:1]
    while len(means) < classes:
        means = np.vstack([means, x[np.argmax(((x[:, None, :] - means) ** 2).sum(2).min(1))]])
    shares = np.ones(classes)
    for _ in range(rounds):
        sent = d.sparkSession.sparkContext.broadcast(means)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((classes, PAIRS)), np.zeros(classes, np.int64)
            for batch in batches:
                for x in batch.column(0):
                    v = byte_pairs(x.as_py())
                    z = nearest_class(v[None], sent.value)[0]  # noqa: B023
                    total[z] += v
                    n[z] += 1
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(classes), PAIRS)), pa.array(np.tile(np.arange(PAIRS), classes)), pa.array(total.ravel()), pa.array(np.repeat(n, PAIRS))], names=["z", "at", "sum", "n"])

        total, n = np.zeros((classes, PAIRS)), np.zeros(classes)
        for z, at, s, k in training.select("text").mapInArrow(sums, "z long, at long, sum double, n long").groupBy("z", "at").agg(F.sum("sum"), F.sum("n")).collect():
            total[z, at], n[z] = s, k
        means = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], means).astype(np.float32)
        shares = n + 0.5
    return means, shares / shares.sum()


def _blocks(n_buckets: int, keys: list[int], copy_discount: float, prior: float, means: np.ndarray, shares: np.ndarray, copies: bool = True):
    """Documents -> rows (bucket, block, kind, words, a, b, c, d, e, f); kind 1 holds a block's documents.

    a: training counts of the bucket's pairs of a word and a class, f: the pairs (word * classes + class); b, c, d, e:
    the uses' pair, document, times, and types before each later use.
    """
    classes, log_shares = len(means), np.log10(shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        block = TaskContext.get().partitionId() << 32
        for batch in _cut(batches):
            held = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            index, uses, n_tokens, fixed, z = _Ids(), [], [], [], []
            index[b""]  # the end token
            for x in batch.column(2):
                words = (x.as_py() or b"").lower().split()
                words.append(b"")
                uses.append(history(np.fromiter(map(index.__getitem__, words), np.int32, len(words)), copy_discount, prior))
                n_tokens.append(len(words))
                z.append(int(nearest_class(byte_pairs(x.as_py())[None], means)[0]) if classes > 1 else 0)
                fixed.append((uses[-1][3] if copies else 0.0) + log_shares[z[-1]])
            which = np.concatenate([u[0] for u in uses])
            times = np.concatenate([u[1] for u in uses])
            later = np.concatenate([u[2] for u in uses])
            later_ends = np.append(0, np.cumsum(times - 1, dtype=np.int64))
            doc = np.repeat(np.arange(len(uses), dtype=np.int32), [len(u[0]) for u in uses])
            uses.clear()
            pairs, which = np.unique(which.astype(np.int64) * classes + np.array(z)[doc], return_inverse=True)
            trained = np.bincount(which, times * ~held[doc], minlength=len(pairs)).astype(np.int64)
            words = list(index)
            bucket = np.fromiter((xxhash.xxh3_64_intdigest(stem_of(w)) % n_buckets for w in words), np.int64, len(words))
            by = np.argsort(bucket, kind="stable")
            place = np.empty(len(by), np.int64)
            ends = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
            place[by] = np.arange(len(by)) - ends[bucket[by]]
            pair_bucket = bucket[pairs // classes]
            pair_by = np.argsort(pair_bucket, kind="stable")
            pair_place = np.empty(len(pairs), np.int64)
            pair_ends = np.searchsorted(pair_bucket[pair_by], np.arange(n_buckets + 1))
            pair_place[pair_by] = np.arange(len(pairs)) - pair_ends[pair_bucket[pair_by]]
            code = place[pairs // classes] * classes + pairs % classes
            use_bucket = pair_bucket.astype(np.int32)[which]
            use_order = np.argsort(use_bucket, kind="stable").astype(np.int32)
            use_ends = np.append(0, np.cumsum(np.bincount(use_bucket, minlength=n_buckets)))
            out = []
            for k in range(n_buckets):
                own, p, u = by[ends[k] : ends[k + 1]], pair_by[pair_ends[k] : pair_ends[k + 1]], use_order[use_ends[k] : use_ends[k + 1]]
                if len(own):
                    at = later[np.repeat(later_ends[u] - np.append(0, np.cumsum(times[u] - 1))[:-1], times[u] - 1) + np.arange((times[u] - 1).sum())]
                    out.append((keys[k], block, 0, zstandard.compress(b"\n".join(words[i] for i in own), 1), *_press(trained[p], pair_place[which[u]].astype(np.int32), doc[u], times[u], at, code[p].astype(np.int32))))
            ids = np.array([-1 if v is None else v for v in batch.column(0).to_pylist()], np.int64)
            null = np.array([v is None for v in batch.column(0).to_pylist()], np.int8)
            out.append((keys[block % n_buckets], block, 1, b"", *_press(ids, held.astype(np.int8), np.array(n_tokens, np.int64), null, np.array(fixed)), b""))
            block += 1
            for i in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out[i : i + 256], strict=True), (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 7), strict=True)], names=["bucket", "block", "kind", "words", *"abcdef"])

    return run


def _count(classes: int, most: int = 16_000_000):
    """One bucket -> rows of at most ``most`` packed bytes (or one block) of uses, each with the bucket's distinct words,
    pairs and training counts; the first alone bears the sums."""

    def run(table: pa.Table) -> pa.Table:
        index, codes, counts, rows = _Ids(), [], [], table.num_rows
        column = {c: table[c] for c in ("block", "kind", "words", *"abcdef")}
        cell = lambda c, i: column[c][i].as_py()
        for i in range(rows):
            if cell("kind", i):
                codes.append(None)
                continue
            words = zstandard.decompress(cell("words", i)).split(b"\n")
            ids, own = np.fromiter(map(index.__getitem__, words), np.int64, len(words)), _open(cell("f", i), "<i4")
            codes.append(ids[own // classes] * classes + own % classes)
            counts.append(_open(cell("a", i), "<i8"))
        flat = np.concatenate([np.zeros(0, np.int64), *(x for x in codes if x is not None)])
        pairs, at = np.unique(flat, return_inverse=True)
        n = np.bincount(at, np.concatenate([np.zeros(0), *counts]), minlength=len(pairs)).astype(np.int64)
        c = np.bincount(pairs // classes, n, minlength=len(index)).astype(np.int64)
        by_class = np.bincount(pairs % classes, n, minlength=classes).astype(np.int64), np.bincount(pairs % classes, n > 0, minlength=classes).astype(np.int64)
        stems = Stems(list(index), c)
        head = [zstandard.compress(b"\n".join(index), 1), *_press(c, pairs, n)]
        sums = [int(c.sum()), int((c > 0).sum()), int((stems.types > 0).sum()), stems.steps().tolist(), by_class[0].tolist(), by_class[1].tolist()]
        none = [0, 0, 0, [], [], []]
        out: list[list] = []
        held: list[list] = [[] for _ in range(7)]
        size = 0

        def flush() -> None:
            out.append([*head, not out, *(sums if not out else none), *(list(x) for x in held)])
            for x in held:
                x.clear()

        for i in range(rows):
            kind = cell("kind", i)
            if kind:
                row = [cell(k, i) for k in "abcde"]
            else:
                places = np.searchsorted(pairs, codes[i])
                row = [b"", _press(places[_open(cell("b", i), "<i4")].astype(np.int32))[0], *(cell(k, i) for k in "cde")]
            more = sum(map(len, row))
            if size and size + more > most:
                flush()
                size = 0
            size += more
            for x, v in zip(held, (cell("block", i), kind, *row), strict=True):
                x.append(v)
        flush()
        kinds = [*[pa.binary()] * 4, pa.bool_(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 3, pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.list_(pa.binary())] * 5]
        return pa.table([pa.array(list(v), k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _COUNTED.split(", ")])

    return run


_COUNTED = "words binary, counts binary, pairs binary, pair_counts binary, first boolean, n long, v long, s long, steps array<long>, class_n array<long>, class_v array<long>, blocks array<long>, kinds array<int>, " + ", ".join(f"{c} array<binary>" for c in "abcde")


def _words(words: bytes, counts: bytes) -> tuple[list[bytes], np.ndarray]:
    c = _open(counts, "<i8")
    return (zstandard.decompress(words).split(b"\n") if len(c) else []), c


def lattice_scores(docs: DataFrame, path: str, rounds: int = 4, strength: float = 100.0, discount: float = 0.7, copy_discount: float = 0.95, prior: float = 100.0, classes: int = 8, held_fold: int = 1, added: tuple[str, ...] = ADDED) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    if set(added) - set(EDGES):
        raise ValueError(f"added is made of {EDGES}")
    classes = classes if "classes" in added else 1
    copies = "copies" in added
    n_buckets = partitions(spark)
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold() == held_fold, F.lit(False)).alias("held_out"), F.col("text").cast("binary"))
    means, shares = document_classes(d, classes) if classes > 1 else (np.zeros((1, PAIRS), np.float32), np.ones(1))
    dealt = d.mapInArrow(_blocks(n_buckets, even_keys(n_buckets, n_buckets), copy_discount, prior, means, shares, copies), "bucket long, block long, kind int, words binary, " + ", ".join(f"{c} binary" for c in "abcdef"))
    counted = materialize(dealt.groupBy("bucket").applyInArrow(_count(classes), _COUNTED), "lattice-counts")
    once = counted.where("first")
    total, types, n_stems = (int(x or 0) for x in once.agg(F.sum("n"), F.sum("v"), F.sum("s")).first())
    steps, class_n, class_v = np.zeros((STATES, STATES)), np.zeros(classes), np.zeros(classes)
    for at, n in once.select(F.posexplode("steps")).groupBy("pos").agg(F.sum("col")).collect():
        steps[at // STATES, at % STATES] = n
    for at, n, v in once.select(F.posexplode(F.arrays_zip("class_n", "class_v"))).groupBy("pos").agg(F.sum("col.class_n"), F.sum("col.class_v")).collect():
        class_n[at], class_v[at] = n, v
    chain = np.log((steps + 0.1) / (steps + 0.1).sum(1, keepdims=True)).reshape(-1)

    pieces, logp = vocabulary(path)
    given = strength * np.exp(logp)
    for _ in range(rounds if types else 0):
        sent = spark.sparkContext.broadcast((pieces, logp))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*sent.value)  # noqa: B023
            sums = np.zeros(len(lattice.pieces))
            for batch in batches:
                for w, n in zip(batch.column(0), batch.column(1), strict=True):
                    words, c = _words(w.as_py(), n.as_py())
                    found = Stems(words, c)
                    sums += lattice.expected([x for x, k in zip(found.stems, found.types, strict=True) if k and x])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["piece", "uses"])

        uses = np.zeros(len(pieces))
        for r in once.select("words", "counts").mapInArrow(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses")).collect():
            uses[r[0]] = r[1]
        logp = np.log((uses + given) / (uses + given).sum())
    sent = spark.sparkContext.broadcast((pieces, logp))
    sums_of = (max(1, total), max(1, types))

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*sent.value)
        for batch in batches:
            for row in batch.to_pylist():
                words, c = _words(row["words"], row["counts"])
                found = Stems(words, c)
                known_stems = sum(np.maximum(k - discount, 0) / n / 2 for k, n in zip((found.tokens, found.types), sums_of, strict=True))
                with np.errstate(divide="ignore"):
                    stems = lattice.forward(found.stems)
                    if "stems" in added:
                        stems = np.logaddexp(np.log(known_stems), np.log(sum(discount * max(1, n_stems) / n / 2 for n in sums_of)) + stems)
                    log_p = stems[found.of] + found.tail_logs(chain)
                    if "words" in added:
                        log_p = np.logaddexp(np.log(np.maximum(c - discount, 0) / max(1, total)), np.log(discount * max(1, types) / max(1, total)) + log_p)
                    pairs, n = _open(row["pairs"], "<i8"), _open(row["pair_counts"], "<i8")
                    word, own = pairs // classes, pairs % classes
                    in_class = np.logaddexp(np.log(np.maximum(n - discount, 0)), np.log(discount * class_v[own]) + log_p[word]) - np.log(np.maximum(class_n[own], 1))
                lp = np.where((class_n[own] > 0) & (classes > 1), in_class, log_p[word]) / np.log(10)
                base, known, p = np.log10(c + 0.5)[word], (c > 0)[word].astype(float), 10.0**lp
                out = []
                for block, kind, x, y, z, t, e in zip(row["blocks"], row["kinds"], *(row[k] for k in "abcde"), strict=True):
                    if kind:
                        out.append((block, 1, x, y, z, t, e))
                        continue
                    which, doc, times, types_before = _open(y, "<i4"), _open(z, "<i4"), _open(t, "<i4"), _open(e, "<i4")
                    own, at = np.unique(doc, return_inverse=True)
                    sums = [np.bincount(at, v[which] * k, minlength=len(own)) for v, k in ((base, times), (known, times), (lp, 1))]
                    pair = np.repeat(np.arange(len(which)), times - 1)
                    h = np.arange(len(pair)) - np.repeat(np.cumsum(times - 1) - (times - 1), times - 1) + 1
                    later = np.log10(h - copy_discount + (prior + copy_discount * types_before) * p[which[pair]]) if copies else lp[which[pair]]
                    sums[2] += np.bincount(at[pair], later, minlength=len(own))
                    out.append((block, 0, *_press(own.astype(np.int32), sums[0], sums[1].astype(np.int32), sums[2]), b""))
                for i in range(0, len(out), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*out[i : i + 256], strict=True), (pa.int64(), pa.int32(), *[pa.binary()] * 5), strict=True)], names=["block", "kind", *"abcde"])

    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

    def gather(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["kind"])
        ids, held, n_tokens, null = _open(head["a"], "<i8"), _open(head["b"], "<i1"), _open(head["c"], "<i8"), _open(head["d"], "<i1")
        base, known, score = np.zeros(len(ids)), np.zeros(len(ids), np.int64), _open(head["e"], "<f8").copy()
        for r in sorted((r for r in rows if not r["kind"]), key=lambda r: r["a"]):
            own = _open(r["a"], "<i4")
            base[own] += _open(r["b"], "<f8")
            known[own] += _open(r["c"], "<i4")
            score[own] += _open(r["d"], "<f8")
        base -= n_tokens * np.log10(total + 0.5 * (types + 1))
        return pa.table([pa.array(ids, mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(n_tokens), pa.array(known), pa.array(np.full(len(ids), total, np.int64)), pa.array(base), pa.array(score)], names=list(names))

    sums = counted.mapInArrow(sum_up, "block long, kind int, " + ", ".join(f"{c} binary" for c in "abcde"))
    return sums.groupBy("block").applyInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
