"""The pipeline's stages on a fixture with planted cases."""

import collections
import zlib

import corpus_pipeline
import duckdb
import numpy as np
from test_operators import BPE, components, prose
from tokenizers import Tokenizer

from tarnwick.llm import oracles


def test_stages(spark):
    shared = prose(50, 70)
    rows = [(i, prose(100 + i, 150), "en", f"s{i % 2}", 0) for i in range(20)]
    rows += [(30, rows[0][1], "en", "s0", 0), (31, rows[1][1] + " more", "en", "s1", 0), (32, "too short", "en", "s0", 0), (33, None, None, None, None)]
    rows += [(40 + i, prose(200 + i, 200) + " " + shared + " " + prose(300 + i, 200), "en", "s0", 0) for i in range(3)]
    rows += [(None, prose(400 + i, 100), "en", "s0", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], ""))
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert ids[1] == ids[0] - {32, 33}
    assert ids[2] == ids[1] - {30, 31}
    assert ids[3] == ids[2] and not any(shared in r.text for r in seen[3].collect())
    assert ids[4] <= ids[3] and all(d.columns == docs.columns for d in seen[1:5])
    assert ids[5] == ids[4]
    assert [d.where("doc_id IS NULL").count() for d in seen[2:4]] == [3, 3]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0


def test_null_and_repeated_ids_are_told_apart(spark):
    """Rejected, copied and kept rows that share a null id, and two texts of one id."""
    rows = [(None, prose(500, 120), "en", "s0", 0), (None, prose(500, 120) + " more", "en", "s0", 0), (None, "too short", "en", "s0", 0), (7, prose(501, 120), "en", "s0", 0), (7, "short too", "en", "s0", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.rules(spark, docs, "")
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in kept.collect()) == sorted([(-1, rows[0][1]), (-1, rows[1][1]), (7, rows[3][1])] * 2)
    near = corpus_pipeline.near_copies(spark, kept, "").collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in near) == [-1, 7]
    mixed = corpus_pipeline.source_mix(spark, kept, "").collect()
    assert 0 < len(mixed) <= 3 * kept.count()


def test_texts_of_one_id_are_kept_and_cut_apart(spark):
    shared = prose(60, 80)
    a, b, c = (prose(600 + i, 150) for i in range(3))
    rows = [(7, f"{a} {shared}"), (7, f"{b} {shared}"), (7, f"{c} more"), (3, c), (7, f"{a} {shared}")]
    docs = spark.createDataFrame([(i, t, "en", "s0", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    near = corpus_pipeline.near_copies(spark, docs, "")
    assert sorted((r.doc_id, r.text) for r in near.collect()) == sorted([rows[0], rows[1], rows[3]])
    cut = sorted((r.doc_id, r.text) for r in corpus_pipeline.repeated_passages(spark, near, "").collect())
    assert len(cut) == 3 and (3, c) in cut and not any(shared in t for _, t in cut)


def test_run_equals_brute_force(spark, sf):
    """run()'s whole rows but for the windows' numbers: rules and mix by their SQL, near copies, cuts and pieces by plain Python."""
    sf = sf.replace("0.01", "0.001")
    db = duckdb.connect()
    docs = db.execute(f"SELECT doc_id, text, source FROM '{sf}/documents.parquet'").fetchall()

    def ask(sql, columns):
        db.execute("CREATE OR REPLACE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
        return db.execute(f"SELECT {columns} FROM ({sql})").fetchall()

    sizes = [len(docs)]
    good = {d for d, kept in ask(oracles.QUALITY_RULES, "doc_id, kept") if kept}
    docs = [d for d in docs if d[0] in good]
    sizes.append(len(docs))
    first = {d for d, _, least in components([d[:2] for d in docs], 5, 80) if d == least}
    docs = [d for d in docs if d[0] in first]
    sizes.append(len(docs))
    texts = [d[1].encode() for d in docs]
    seen = collections.Counter(x[i : i + 200] for x in texts for i in range(len(x) - 199))
    n_cut, cut = 0, []
    for (doc, _, source), x in zip(docs, texts, strict=True):
        gone = {i + k for i in range(len(x) - 199) if seen[x[i : i + 200]] > 1 for k in range(200)}
        n_cut += len(gone)
        cut.append((doc, bytes(c for i, c in enumerate(x) if i not in gone).decode("utf-8", "ignore"), source))
    docs = [d for d in cut if d[1].encode().split()]
    copies = {d: taken // size for d, size, taken in ask(oracles.SOURCE_MIXING, "doc_id, size, taken")}
    assert sizes[0] > sizes[1] > sizes[2] and n_cut and {0, 1} < set(copies.values())
    tokenizer, want = Tokenizer.from_file(BPE), collections.Counter()
    for doc, text, _ in docs:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        while at < len(ids):
            size = 1024 if len(ids) - at >= 1024 else min(128, len(ids) - at)
            want[doc, at, size, zlib.crc32(ids[at : at + size].tobytes()), len(ids)] += copies[doc]
            at += size
    got = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter((g.doc_id, g.start, g.length, g.ids_crc32, g.doc_tokens) for g in got) == +want
    held = collections.defaultdict(list)
    for g in got:
        held[g.sequence_id].append((g.offset, g.length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(k for _, k in parts[:i]) for i in range(len(parts))] and sum(k for _, k in parts) <= 1024
