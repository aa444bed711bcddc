"""The ten operators against brute-force versions, and the defined result of every odd input."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.llm import additive_ann, lattice_lm, mixing, ngram_join, packing, quality_knn, quality_rules, suffix_dedup, token_counts, toxicity
from tarnwick.llm.queries import _tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, n_words string, copies int, bin int, token string"
BPE, WORDS, PIECES = (_tokenizer_file(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["lo", "mi", "ter", "än", "qu", "sed"]) + r.choice(["na", "ru", "is.", "ó"]) + r.choice(["", "ve", "x"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    base = prose(1, 120)
    texts = [
        (1, base), (2, base), (2, base), (3, base + " extra words here"), (4, None), (5, ""), (6, " \n\t "), (7, "one two"),
        (8, "x" * 60_000), (9, prose(2, 20_000)), (None, prose(3, 80)), (10, "Idiot <|endoftext|> İßΣ é \x00 日本 !!'s"), (11, ("again and again " * 200)), (12, prose(4, 300)),
    ]
    rows = [(i, t, "en", None if i in (5, 7) else f"s{(i or 0) % 3}", 0, "a", "b", 1, 2, "c") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(t):
    return (t or "").encode().split()


def test_suffix_array_and_windows():
    r = random.Random(5)
    for k in range(40):
        texts = [bytes(r.choice(b"abcd") for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 6))]
        t, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(x) for x in texts])
        sa = suffix_dedup.two_stage_suffix_array(t, ends)
        end = np.repeat(ends, np.diff(np.append(0, ends)))
        found = [t[i : end[i]].tobytes() for i in sa]
        assert found == sorted(found) and sorted(sa.tolist()) == list(range(len(t))), k


def removed(texts, width):
    seen = collections.Counter(x[i : i + width] for x in texts for i in range(len(x) - width + 1))
    for x in texts:
        m = np.zeros(len(x), bool)
        for i in range(len(x) - width + 1):
            if seen[x[i : i + width]] > 1:
                m[i : i + width] = True
        kept = np.frombuffer(x, np.uint8)[~m].tobytes()
        yield len(x), int(m.sum()), len(suffix_dedup._runs(m)[0]), hashlib.sha256(kept).hexdigest()


def test_op1(odd, none):
    rows = odd.select("doc_id", "text").collect()
    want = sorted((-1 if r[0] is None else r[0], *x) for r, x in zip(rows, removed([(r[1] or "").encode() for r in rows], 200), strict=True))
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in suffix_dedup.dedup(odd).collect()) == want
    assert suffix_dedup.dedup(none).count() == 0
    hot = suffix_dedup.dedup(odd, most=1).collect()  # frequent anchors go window by window
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in hot) == want


def neighbours(rows, every=20, k=20):
    """Brute force: (query_id, rank, vec_id, score) of every query row, each barred from its own row alone."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = []
    for at, (q, x) in enumerate(ok):
        if q % every == 0:
            scored = sorted((-float((x * y).sum()), i) for j, (i, y) in enumerate(ok) if j != at and len(y) == len(x))
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


ANN = "vec_id long, embedding array<float>, key string, query_id int, ids array<int>"


def test_op1_cells_are_hot_beside_their_neighbours():
    """Cells of a million pieces that come in copies are not hot by their noise, one with a frequent anchor is."""
    r = np.random.default_rng(5)
    counts = (r.poisson(1_000_000 / 300, 1 << 14) * 300).astype(np.int64)  # copies of 300
    assert (counts - int(np.median(counts)) > 8192).any() and not suffix_dedup.hot_cells(counts, 8192).any()
    counts[77] += 400_000
    assert np.flatnonzero(suffix_dedup.hot_cells(counts, 8192)).tolist() == [77]
    few = np.zeros(1 << 14, np.int64)
    few[5], few[6] = 8193, 8192
    assert np.flatnonzero(suffix_dedup.hot_cells(few, 8192)).tolist() == [5]
    for buckets in (1, 844, 1 << 18, 800_000, 5_000_000):
        assert (1 << suffix_dedup.sketch_bits(buckets)) >= max(1 << 20, 4 * buckets)


def test_op2(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((900, 16)).astype(np.float32)
    x[100:160] = x[7]  # equal vectors, more than k + 1
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (2080, []), (2100, [float("inf")] * 16)]
    rows += [(0, x[5].tolist()), (0, x[0].tolist()), (20, x[20].tolist()), (None, x[3].tolist())]  # repeated and null ids
    rows += [(3000 + 10 * i, r.standard_normal(5).astype(np.float32).tolist()) for i in range(9)] + [(4000, [1.0] * 7)]  # other lengths
    docs = spark.createDataFrame([(*v, "a", 1, [2]) for v in rows], ANN).repartition(3)
    got = sorted(tuple(v) for v in additive_ann.nearest(docs, block_rows=200, query_rows=16).collect())
    want = neighbours(rows)
    size = lambda found: collections.Counter((q, rank) for q, rank, _, _ in found)
    assert size(got) == size(want) and 4000 not in {q for q, *_ in got}
    product = {i: v for i, v in rows[:900]}
    assert all(s == pytest.approx(max(np.dot(np.array(product[q], float), np.array(product[i], float)), s)) for q, _, i, s in got if 0 < q < 900 and q != 20 and i > 20)
    mine, true = collections.Counter((q, i) for q, _, i, _ in got), collections.Counter((q, i) for q, _, i, _ in want)
    assert sum((mine & true).values()) / len(want) >= 0.95
    small = [v for v in rows if v[1] and len(v[1]) < 16] + rows[:120:10] + rows[906:909]  # fewer rows than the shortlist: exact
    docs = spark.createDataFrame([(*v, "a", 1, [2]) for v in small], ANN)
    assert [(q, k, i, pytest.approx(s, abs=1e-9)) for q, k, i, s in neighbours(small)] == sorted(tuple(v) for v in additive_ann.nearest(docs).collect())
    assert additive_ann.nearest(spark.createDataFrame([], ANN)).count() == 0
    few = additive_ann.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.5])], "vec_id long, embedding array<double>")).collect()
    assert [(v.query_id, v.vec_id, v.score) for v in few] == [(0, 1, 2.0)]


@pytest.mark.parametrize("scale", ["0.01", "0.1"])
def test_op2_recall(spark, sf, scale):
    """Recall against brute force on whole tables of two sizes (the README has a third)."""
    table = spark.read.parquet(f"{sf.replace('0.01', scale)}/embeddings.parquet")
    want = neighbours([(v.vec_id, v.embedding) for v in table.collect()])
    got = {(v.query_id, v.vec_id) for v in additive_ann.nearest(table).collect()}
    assert len(got) == len(want) and sum((q, i) in got for q, _, i, _ in want) / len(want) >= 0.9


def test_op3(odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    want = collections.Counter(tuple([*t.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in odd.collect())
    got = packing.pack(odd, BPE).collect()
    # Every document's pieces, told by its tokens alone (ids may be null or repeated), cover each of its ids once.
    pieces = collections.Counter((g.doc_id, g.start, g.length, g.ids_crc32, g.doc_tokens) for g in got)
    full = collections.Counter()
    for r in odd.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        cut = [1024] * (len(ids) // 1024) + [128] * (len(ids) % 1024 // 128) + [len(ids) % 128] * (len(ids) % 128 > 0)
        for start, n in zip(np.cumsum([0, *cut]).tolist(), cut):
            full[r.doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids)] += 1
    assert pieces == full and sum(want.values()) == odd.count()
    at = collections.defaultdict(list)
    for g in got:
        at[g.sequence_id].append((g.offset, g.length))
    for parts in at.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(k for _, k in parts[:i]) for i in range(len(parts))] and sum(k for _, k in parts) <= 1024
    assert packing.pack(none, BPE).count() == 0


def test_op3_differencing_is_near_equal():
    r = random.Random(1)
    sizes = [r.randint(1, 128) for _ in range(3000)]
    part = packing.partition(sizes, 1024)
    sums = np.bincount(part, weights=sizes)
    assert sums.max() <= 1024 and sums.max() - sums.min() <= 16 and len(sums) <= math.ceil(sum(sizes) / 1024) * 1.02


def test_op4(odd, none, spark):
    got = mixing.mix(odd).collect()
    size = collections.Counter()
    for r in odd.collect():
        size[r.source] += len(words_of(r.text))
    assert {g.source: g.source_size for g in got} == dict(size) and len(got) == odd.count()
    targets = {g.source: g.target for g in got}
    assert abs(sum(targets.values()) - sum(size.values())) < 1e-6 and all(t <= 3 * size[s] + 1e-6 for s, t in targets.items())
    assert all(g.taken == g.size * g.copies and g.copies <= 3 for g in got)
    assert sorted(map(str, mixing.mix(odd).collect())) == sorted(map(str, got))
    assert mixing.mix(none).count() == 0
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"), F.lit("four words are here").alias("text"))
    sums = mixing.mix(many).groupBy("source").agg(F.sum("taken"), F.first("target")).collect()
    assert all(abs(r[1] - r[2]) <= 4 for r in sums)


def components(rows, k, percent):
    sets, parent = [], list(range(len(rows)))
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((-1 if d is None else d, len(sets[i]), least.get(root(i), -1)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_op5(spark, odd, none, k, percent):
    r = random.Random(k)
    rows = [(x.doc_id, x.text) for x in odd.select("doc_id", "text").collect()]
    for i in range(160):  # a large group of near copies: long posting lists
        w = prose(7, 90).split()
        for _ in range(r.randint(0, 5)):
            w[r.randrange(90)] = f"edit{i}x{r.randrange(3)}"
        rows.append((100 + i, " ".join(w[: 90 - r.randint(0, 4)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(-1 if v is None else v for v in x) for x in ngram_join.join(docs, k, percent).collect())
    assert got == components(rows, k, percent)
    assert ngram_join.join(none).count() == 0


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_op5_long_lists_beyond_the_first_prefix(spark, k, percent):
    """A's only partner is B0: they share one rare shingle, and then shingles of long lists that stand late in A's prefix."""
    body = " ".join(f"t{i}" for i in range(percent + k - 2))
    added = " ".join(f"p{i}" for i in range(100 - percent))
    rows = [(1000, f"{body} end0 {added}")] + [(10 + i, f"{body} end{i}") for i in range(12)]
    rows += [(500 + i, f"{' '.join(f'o{i}x{j}' for j in range(100))} {added}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = components(rows, k, percent)
    assert (1000, 100, 10) in want
    assert sorted(tuple(x) for x in ngram_join.join(docs, k, percent).collect()) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_op5_lists_on_both_sides_of_short_and_heavy(spark, seed):
    """Random families of near copies over shared passages: lists below and above short and heavy, unequal sizes, every prefix length."""
    r = random.Random(seed)
    passages = [[f"g{p}x{i}" for i in range(r.randint(4, 12))] for p in range(12)]
    rows = []
    for family in range(14):
        body = [w for p in r.sample(passages, 5) for w in p] + [f"f{family}x{i}" for i in range(r.randint(2, 30))]
        for _ in range(r.choice([1, 3, 8, 20])):
            w = list(body)
            for _ in range(r.randint(0, 4)):
                at = r.randrange(len(w))
                w[at : at + r.randint(0, 1)] = r.choice([[f"e{r.randrange(40)}"], [], r.choice(passages)[:3]])
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(x) for x in ngram_join.join(docs, 3, 80, short=3, heavy=16).collect())
    want = components(rows, 3, 80)
    assert got == want and 14 < len({x[2] for x in want}) < len(rows)


def test_op5_null_and_repeated_ids(spark):
    base = [prose(600 + i, 60) for i in range(6)]
    rows = [(None if i % 2 else 3, t + tail) for i, t in enumerate(base) for tail in ("", " tail", "")] + [(9, "a b"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.join(docs, 3, 90, with_first=True).collect()
    assert sorted(tuple(-1 if v is None else v for v in x[:3]) for x in got) == components(rows, 3, 90)
    assert len({x.text_hash for x in got if x.is_first}) == 6 + 2


def test_op6(odd, none):
    got = lattice_lm.lattice_scores(odd, PIECES).collect()
    rows = [(r.doc_id, [*(r.text or "").encode().lower().split(), b""]) for r in odd.collect()]
    counts = collections.Counter()
    for i, w in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if i is None else i, len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)) for i, w in rows)
    assert sorted((-1 if g.doc_id is None else g.doc_id, g.n_tokens, g.n_known, round(g.base_score, 4)) for g in got) == want
    assert all(g.train_tokens == n and g.score < 0 for g in got)
    assert lattice_lm.lattice_scores(none, PIECES).count() == 0


def test_op6_lattice_sums_all_segmentations():
    pieces, logp = lattice_lm.vocabulary(PIECES)
    weight = dict(zip(pieces, logp, strict=True))
    lattice = lattice_lm.Lattice(pieces, logp)

    def paths(w):
        return 1.0 if not w else sum(math.exp(weight[w[:k]]) * paths(w[k:]) for k in range(1, len(w) + 1) if w[:k] in weight)

    for w in ("the", "nation", "añ", "xq"):
        assert lattice.forward([w.encode()])[0] == pytest.approx(math.log(paths(b" " + w.encode())))
    uses = lattice.expected([b"nation"])
    assert sum(u * len(p) for u, p in zip(uses, pieces, strict=True)) == pytest.approx(7)


def test_op6_long_pieces_of_the_file_are_edges():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    usable = {sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    long = [p for p in usable if len(p) > 16 and b" " not in p[1:] and p == p.lower()]
    pieces, logp = lattice_lm.vocabulary(PIECES)
    weight, lattice = dict(zip(pieces, logp, strict=True)), lattice_lm.Lattice(pieces, logp)
    assert long and set(long) <= set(pieces)
    for p in long:
        if p[:1] == b" ":
            sums = [1.0]
            for j in range(1, len(p) + 1):
                sums.append(sum(sums[i] * math.exp(weight[p[i:j]]) for i in range(j) if p[i:j] in weight))
            assert lattice.forward([p[1:]])[0] == pytest.approx(math.log(sums[-1]))


@pytest.mark.parametrize("rounds, added", [(0, lattice_lm.EDGES), (4, lattice_lm.EDGES), (4, lattice_lm.ADDED), (0, ()), (1, ("words", "classes")), (1, ("stems", "copies"))])
def test_op6_score_is_the_stated_formula(spark, rounds, added):
    """Every document's score by the docstring's formula, word by word: with the file's own weights, and at production
    settings with plain Python's expectation maximisation; with all added edges, some and none."""
    texts = {i: t for i, t in enumerate(["nation and, and! nation", "And nation, ... land's", "", "sea, land sea!!! nation, nation", "unseen, unseen. and... sea?", "der wald und der see, und der weg", "der weg. und wald, wald"] * 2)}
    docs = spark.createDataFrame([(i, t, 1, b"", 0.5, True) for i, t in texts.items()], "doc_id long, text string, words int, counts binary, score double, held_out boolean").repartition(2)
    got = {r.doc_id: r.score for r in lattice_lm.lattice_scores(docs, PIECES, rounds=rounds, added=added).collect()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    words = {i: [*t.encode().lower().split(), b""] for i, t in texts.items()}
    d = docs.select("doc_id", F.col("doc_id").isin(list(held)).alias("held_out"), F.col("text").cast("binary").alias("text"))
    means, shares = lattice_lm.document_classes(d, 8)
    assert shares.sum() == pytest.approx(1)
    z = {i: min(range(8), key=lambda k: (round(float(((lattice_lm.byte_pairs(t.encode()) - means[k]) ** 2).sum()), 5), k)) for i, t in texts.items()}
    c = collections.Counter(w for i, ws in words.items() if i not in held for w in ws)
    in_class = [collections.Counter(w for i, ws in words.items() if i not in held and z[i] == k for w in ws) for k in range(8)]
    assert len({z[i] for i in texts}) > 2
    n, v = sum(c.values()), len(c)
    stem = lambda w: w.rstrip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") or w
    tokens, kinds, steps = collections.Counter(), collections.Counter(), collections.Counter()
    for w, k in c.items():
        tokens[stem(w)] += k
        kinds[stem(w)] += 1
        tail = [0, *w[len(stem(w)) :], 0]
        steps.update(zip(tail, tail[1:]))
    rows = collections.Counter()
    for (x, _), k in steps.items():
        rows[x] += k
    pieces, logp = lattice_lm.vocabulary(PIECES)
    weight = given = dict(zip(pieces, np.exp(logp).tolist(), strict=True))

    def sums(x, weight):
        """Summed weights of the paths to each byte, and from each byte to the end."""
        to, fro = [1.0] + [0.0] * len(x), [0.0] * len(x) + [1.0]
        for j in range(1, len(x) + 1):
            to[j] = sum(to[i] * weight[x[i:j]] for i in range(j) if x[i:j] in weight)
        for i in range(len(x) - 1, -1, -1):
            fro[i] = sum(weight[x[i:j]] * fro[j] for j in range(i + 1, len(x) + 1) if x[i:j] in weight)
        return to, fro

    for _ in range(rounds):
        uses = {p: 100 * w for p, w in given.items()}
        for x in (b" " + x for x in kinds if x):
            to, fro = sums(x, weight)
            for i in range(len(x)):
                for j in range(i + 1, len(x) + 1):
                    if x[i:j] in weight:
                        uses[x[i:j]] += to[i] * weight[x[i:j]] * fro[j] / to[-1]
        whole = sum(uses.values())
        weight = {p: u / whole for p, u in uses.items()}

    def p_of(w, k):
        tail = [0, *w[len(stem(w)) :], 0]
        p_tail = math.prod((steps[x, y] + 0.1) / (rows[x] + 3.3) for x, y in zip(tail, tail[1:]))
        spelled = sums(b" " + stem(w), weight)[0][-1]
        p_stem = sum(max(k[stem(w)] - 0.7, 0) / m + 0.7 * len(kinds) / m * spelled for k, m in ((tokens, n), (kinds, v))) / 2 if "stems" in added else spelled
        p = max(c[w] - 0.7, 0) / n + 0.7 * v / n * p_stem * p_tail if "words" in added else p_stem * p_tail
        own = sum(in_class[k].values()) if "classes" in added else 0
        return (max(in_class[k][w] - 0.7, 0) + 0.7 * len(in_class[k]) * p) / own if own else p

    for i, ws in words.items():
        want, seen = math.log10(shares[z[i]]) if "classes" in added else 0.0, collections.Counter()
        for at, w in enumerate(ws):
            want += math.log10((max(seen[w] - 0.95, 0) + (100 + 0.95 * len(seen)) * p_of(w, z[i])) / (at + 100) if "copies" in added else p_of(w, z[i]))
            seen[w] += 1
        assert got[i] == pytest.approx(want, abs=1e-5), i


def test_op6_is_above_the_base_on_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.01', '0.1')}/documents.parquet").repartition(8)
    score, base = lattice_lm.lattice_scores(docs, PIECES).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert score > 0.97 * base


def test_op6_rows_are_bounded_and_the_words_of_a_bucket_whole():
    """A bucket's uses in many rows give what one row gives: same words and counts, sums in the first alone."""
    means, shares = np.zeros((2, lattice_lm.PAIRS), np.float32), np.array([0.5, 0.5])
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(60)), pa.array([i % 5 == 0 for i in range(60)]), pa.array([prose(7000 + i, 50).encode() for i in range(60)])], names=["doc_id", "held_out", "text"])
    from pyspark import TaskContext

    was, TaskContext.get = TaskContext.get, staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})())
    try:
        blocks = [b for i in range(0, 60, 6) for b in lattice_lm._blocks(2, [0, 1], 0.95, 100.0, means, shares)(iter([batch.slice(i, 6)]))]
    finally:
        TaskContext.get = was
    table = pa.Table.from_batches(blocks)
    table = table.filter(pa.compute.equal(table["bucket"], 0))
    whole, parts = lattice_lm._count(2)(table).to_pylist(), lattice_lm._count(2, most=500)(table).to_pylist()
    assert len(whole) == 1 and len(parts) > 3 and [r["first"] for r in parts] == [True] + [False] * (len(parts) - 1)
    assert sum(r["n"] for r in parts) == whole[0]["n"] and all(r["words"] == whole[0]["words"] and r["pair_counts"] == whole[0]["pair_counts"] for r in parts)
    assert [b for r in parts for b in r["b"]] == whole[0]["b"] and [b for r in parts for b in r["blocks"]] == whole[0]["blocks"]


def test_op7(spark, sf, odd, none):
    docs, labels = spark.read.parquet(f"{sf.replace('0.01', '0.1')}/documents.parquet"), spark.read.parquet(f"{sf.replace('0.01', '0.1')}/labels.parquet")
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out")
    hit = {(r.toxic, r.predicted): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert hit[1, 1] / (hit[1, 1] + hit.get((1, 0), 0)) > 0.7 and hit.get((0, 1), 0) / (hit[0, 0] + hit.get((0, 1), 0)) < 0.02
    bad = labels.limit(3).unionByName(labels.limit(1).select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic")))
    assert toxicity.toxicity(odd, bad).count() == odd.count() and toxicity.toxicity(none, labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0}


def test_op7_risk_and_slope_equal_finite_differences():
    r = np.random.default_rng(3)
    z, positive, unlabelled = r.normal(0, 2, 30), r.random(30) < 0.4, r.random(30) < 0.7
    for prior in (0.05, 0.3, 0.9):
        p, n = toxicity.risk(z, positive, unlabelled, prior)
        by_hand = [math.log1p(math.exp(v)) for v in z]
        up = sum(by_hand[i] for i in range(30) if positive[i]) / positive.sum()
        assert p == pytest.approx(prior * sum(math.log1p(math.exp(-z[i])) for i in range(30) if positive[i]) / positive.sum())
        assert n == pytest.approx(sum(by_hand[i] for i in range(30) if unlabelled[i]) / unlabelled.sum() - prior * up)
        for sign in (1, -1):  # with the negatives' part above and below 0
            at = z if sign > 0 else np.where(positive, 9.0, -9.0)
            value = lambda v: sum(toxicity.risk(v, positive, unlabelled, prior)) if toxicity.risk(at, positive, unlabelled, prior)[1] >= 0 else -toxicity.risk(v, positive, unlabelled, prior)[1]  # noqa: B023, E731
            found = toxicity.slope(at, positive, unlabelled, prior)
            for i in range(30):
                step = np.zeros(30)
                step[i] = 1e-5
                assert found[i] == pytest.approx((value(at + step) - value(at - step)) / 2e-5, abs=1e-6)


def test_op7_learns_marked_words_and_scores_rows_alike(spark):
    """Row by row against the model's own weights, with null, long, empty and repeated rows and clashing columns."""
    r = random.Random(4)
    texts = [(i, prose(3000 + i, 40) + (f" grawlix {r.choice(['blast', 'rotten'])}" if i % 7 == 0 else "")) for i in range(400)]
    texts += [(None, "grawlix blast"), (500, None), (501, ""), (502, "grawlix " * 40_000), (503, texts[0][1]), (503, texts[0][1])]
    docs = spark.createDataFrame([(*t, "x", 0.5, 1, 1, True) for t in texts], "doc_id long, text string, words string, score double, toxic int, predicted int, positive boolean").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 7 == 0), 1, "x") for i in range(200)] + [(7, 0, 1, "x"), (None, 1, 1, "x"), (600, 1, 1, "x"), (8, None, 1, "x")], "doc_id long, toxic int, quality int, text string")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(texts) and all(g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got)
    sample, prior = toxicity.training_sample(docs, labels, 3000, 6000)
    weights, bias = toxicity.fit(sample, prior, 10_000)
    z = lambda t: bias + sum(weights.get(w, 0.0) for w in toxicity.words_of((t or "").encode()))
    logit = {(g.doc_id, round(math.log(g.score / (1 - g.score)), 6)) for g in got}
    shifts = {min((round(s - z(t), 4) for d, s in logit if d == i), key=abs) for i, t in texts[:50]}
    assert len(shifts) == 1  # one threshold for all
    assert {(i, round(z(t) + next(iter(shifts)), 3)) for i, t in texts} == {(d, round(s, 3)) for d, s in logit}
    caught = {g.doc_id for g in got if g.predicted}
    assert {i for i in range(400) if i % 7 == 0} | {None, 502, 503} == caught
    assert len(toxicity.training_sample(docs, labels, 5, 20)[0]) <= 25


def test_op8(odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    want = sorted((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False)), n > 2048) for r in odd.collect())
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in token_counts.token_counts(odd, WORDS).collect()) == want
    assert token_counts.token_counts(none, WORDS).count() == 0


def test_op9(spark, sf, odd, none):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_knn.quality(docs, labels).join(labels, "doc_id").where("held_out")
    assert out.where("predicted = quality").count() / out.count() > 0.9
    assert quality_knn.quality(odd, labels.limit(0)).count() == odd.count() and quality_knn.quality(none, labels).count() == 0
    assert all(0 <= r.score <= 1 for r in quality_knn.quality(odd, spark.createDataFrame([(1, 1), (9, 0), (3, None)], "doc_id long, quality int")).collect())


def test_op9_votes_equal_exact_neighbours_with_ties():
    r = np.random.default_rng(2)
    for _ in range(20):
        s = r.integers(0, 4, (30, 25)) / 4
        for k in (1, 7, 25):
            want = [sorted(sorted(range(25), key=lambda j: (-row[j], j))[:k]) for row in s]
            assert quality_knn.nearest(s, k).tolist() == want
    vectors = quality_knn.unit(r.standard_normal((60, 8)).astype(np.float32))
    vectors[20:40] = vectors[3]
    y, z = r.integers(0, 2, 60).astype(float), quality_knn.unit(np.vstack([r.standard_normal((40, 8)), vectors[3], np.zeros(8)]).astype(np.float32))
    got = quality_knn.vote(z, *quality_knn.distinct(vectors), y, 15)
    for row, score in zip(z, got, strict=True):
        s = [float(np.float32((row * v).sum())) for v in vectors]
        near = sorted(range(60), key=lambda j: (-round(s[j], 6), j))[:15]
        w = [max(0.0, min(1.0, s[j])) ** 8 for j in near]
        assert score == pytest.approx(sum(a * y[j] for a, j in zip(w, near)) / sum(w) if sum(w) > 1e-12 else y.mean(), abs=1e-4)


def test_op9_scores_rows_alike(spark):
    """Equal texts score alike whatever their row; null, empty, long and repeated rows, repeated ids, clashing columns."""
    texts = [(i, prose(5000 + i, 60) if i % 3 else "BUY NOW!!! 100% $$$ " * (5 + i % 4)) for i in range(150)]
    texts += [(None, texts[1][1]), (500, None), (501, ""), (502, "$$$ " * 40_000), (503, texts[3][1]), (503, texts[3][1]), (3, texts[1][1])]
    docs = spark.createDataFrame([(*t, "x", 0.5, 1, b"") for t in texts], "doc_id long, text string, lang string, score double, quality int, counts binary").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0, "x") for i in range(150)] + [(5, 0, 0, "x"), (None, 0, 0, "x"), (700, 1, 0, "x"), (6, None, 0, "x")], "doc_id long, quality int, toxic int, text string")
    got = quality_knn.quality(docs, labels).collect()
    score = collections.defaultdict(set)
    by_text = collections.defaultdict(set)
    for g in got:
        score[g.doc_id].add(round(g.score, 5))
    for i, t in texts:
        by_text[t or ""] |= {min(score[i])} if i != 3 else set()
    assert len(got) == len(texts) and all(len(v) <= 1 for v in by_text.values()) and all(g.predicted == (g.score >= 0.3) for g in got)
    assert all((max(score[i]) >= 0.3) == (i % 3 > 0) for i, _ in texts[:150] if i != 3)
    bounded = quality_knn.quality(docs, labels, most_labelled=20)
    assert bounded.count() == len(texts)


def rules(t):
    w = words_of(t)
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def test_op10(odd, none):
    got = quality_rules.quality_rules(odd).collect()
    want = sorted((-1 if r.doc_id is None else r.doc_id, *rules(r.text)) for r in odd.collect())
    assert sorted((-1 if g[0] is None else g[0], *g[1:6]) for g in got) == want
    assert all(g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words) and not (g.base_failed and g.kept) for g in got)
    assert quality_rules.quality_rules(none).count() == 0


def host_documents():
    """(doc_id, source, text): a host that fails mostly, one that fails never, and ordinary ones with the same borderline document."""
    clean = [prose(900 + i, 60) for i in range(60)]
    borderline, symbols = prose(990, 60) + " # # # # # # #", prose(991, 60) + " #" * 20
    rows = [(i, "bad", symbols if i % 10 else clean[0]) for i in range(40)] + [(100 + i, "good", clean[i % 60]) for i in range(200)]
    for k in range(6):
        rows += [(1000 + 100 * k + i, f"plain{k}", symbols if i % 8 == k else clean[i]) for i in range(60)]
    return [*rows, (5000, "good", borderline), (5001, "plain1", borderline), (5002, "bad", borderline), (5003, None, borderline), (None, "plain1", symbols)]


def test_op10_host_verdicts_change_documents(spark):
    docs = spark.createDataFrame(host_documents(), "doc_id long, source string, text string").repartition(3)
    got = quality_rules.quality_rules(docs).collect()
    rate = {g.source: g.host_rate for g in got}
    n, failed = collections.Counter(g.source for g in got), collections.Counter(g.source for g in got if g.base_failed or g.soft_failed)
    total, mean = sum(n.values()), (sum(failed.values()) + 0.5) / (sum(n.values()) + 1)
    variance = sum(n[s] * (failed[s] / n[s]) ** 2 for s in n) / total - (sum(failed.values()) / total) ** 2
    chance = (len(n) - 1) / total
    strength = max(mean * (1 - mean) * (1 - sum((k / total) ** 2 for k in n.values()) - chance) / (variance - chance * mean * (1 - mean)) - 1, 0)
    assert all(rate[s] == pytest.approx((failed[s] + mean * strength) / (n[s] + strength)) for s in n)
    assert {g.source for g in got if g.host_bad} == {"bad"} and not any(g.kept for g in got if g.source == "bad")
    assert sum(not g.base_failed and not g.soft_failed for g in got if g.source == "bad") == 4  # rejected with their host alone
    kept = {g.doc_id: g.kept for g in got}
    assert kept[5000] and not kept[5001] and not kept[5002] and not kept[None]  # the same text: spared on the good host alone
    assert all(g.kept for g in got if not g.soft_failed and g.source != "bad")


def test_op10_prior_is_the_one_that_drew_the_hosts(spark):
    """Over many small hosts the fitted strength is near the true one, where the raw variance halves it and more; hosts
    that differ by chance alone are all at the corpus rate."""
    r = np.random.default_rng(3)
    n = r.integers(5, 40, 4000)
    for strength in (10.0, math.inf):
        rate = r.beta(0.2 * strength, 0.8 * strength, len(n)) if strength < math.inf else np.full(len(n), 0.2)
        failed = r.binomial(n, rate)
        hosts = spark.createDataFrame(list(zip(n.tolist(), failed.tolist(), strict=True)), "n long, failed long")
        mean, fitted = quality_rules.beta_prior(hosts)
        assert mean == pytest.approx(0.2, abs=0.01)
        assert 8 < fitted < 12.5 if strength < math.inf else fitted > 150
        raw = np.average((failed / n - failed.sum() / n.sum()) ** 2, weights=n)
        assert mean * (1 - mean) / raw - 1 < 0.75 * min(fitted, 12.5) or strength == math.inf
    one = spark.createDataFrame([(i, "s", prose(i, 60) + " #" * (20 * (i % 4 == 0))) for i in range(20)], "doc_id long, source string, text string")
    assert {(g.host_scale, g.host_bad, g.kept == (not g.soft_failed)) for g in quality_rules.quality_rules(one).collect()} == {(1.0, False, True)}
