"""Merkle manifest, fill-in-middle and chat formatting against brute force, and their defined cases."""

import hashlib
import re
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tarnwick.llm import chat_format, fill_in_middle, merkle, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    cell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    doc_id, text, lang, source, n_chars = row
    return h(*map(cell, (doc_id, source, lang, n_chars, text)))


def tree_proofs(nodes):
    """(root, [[(own place, run)] of every leaf])."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i - i % 3 : i - i % 3 + 3]
            paths[k].append((i % 3, run))
        nodes, at = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], paths


def brute_merkle(rows):
    rows = sorted(rows, key=lambda r: (r[3] is not None, (r[3] or "").encode(), r[0] is not None, r[0] or 0, leaf(r)))
    groups = [list(g) for _, g in groupby(rows, key=lambda r: r[3])]
    trees = [tree_proofs([leaf(r) for r in g]) for g in groups]
    root, tops = tree_proofs([t[0] for t in trees])
    out = []
    for g, (sub, paths), top in zip(groups, trees, tops, strict=True):
        for r, path in zip(g, paths, strict=True):
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            at, siblings = leaf((r[0], text, *r[2:])), []
            for own, run in path + top:
                siblings += run[:own] + run[own + 1 :]
                at = h(*run[:own], at, *run[own + 1 :])
            out.append((r[0], leaf(r), sub, root, h(*siblings), at, at == root))
    return sorted(out, key=str)


def check_of():
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return {"text": F.when(half, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


def merkle_rows(spark, rows, **options):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for c in ("grp", "key", "leaf", "at", "pos", "part", "rank", "block", "n", "root", "steps", "siblings", "checked", "proof", "subroot", "g", "p", "rows", "first", "shift"):
        docs = docs.withColumn(c, F.lit("x"))
    m = merkle.manifest(docs, check=check_of(), **options).select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256), "folded_root", "verified")
    return sorted(map(tuple, m.collect()), key=str)


def odd_documents():
    rows = [(i, f"line {i}\nmore {i % 5}\n", "en" if i % 3 else None, "hot" if i % 2 else f"s{i % 7}", i) for i in range(120)]
    rows += [(None, "no id", "en", "hot", 1), (None, "no id", "en", "hot", 1), (7, None, None, None, None), (8, "", "", "", 0), (9, "é\n中", "fr", "Z", 3), (9, "é\n中", "fr", "Z", 3), (9, "other", "fr", "Z", 3), (3, "long " * 200_000, "en", "lone", 1)]
    return rows


def test_manifest_equals_brute_force(spark):
    """By blocks of 729, of 3 and of 9 leaves, with the upper tree on the driver and, of few nodes at most, with blocks of groups."""
    rows = odd_documents()
    want = brute_merkle(rows)
    assert not all(r[-1] for r in want) and any(r[-1] for r in want)
    for options in ({}, {"least": 1}, {"least": 1, "top": 40}, {"least": 1, "top": 5}):
        assert merkle_rows(spark, rows, **options) == want, options


def test_manifest_of_few_rows(spark):
    assert merkle_rows(spark, []) == []
    one = merkle_rows(spark, [(2, "a\nb", "en", None, 3)])
    assert one == brute_merkle([(2, "a\nb", "en", None, 3)]) and one[0][1] == one[0][2] == one[0][3]
    for n in (2, 3, 4, 9, 10):
        rows = [(i, "a\nb", "en", "x", 1) for i in range(n)]
        assert merkle_rows(spark, rows, least=1) == brute_merkle(rows)


def test_proofs_are_whole(spark):
    m = merkle.manifest(spark.createDataFrame(odd_documents(), DOCS), least=1).collect()
    assert all(merkle.fold(r.leaf.encode(), r.proof.encode(), r.steps).decode() == r.root == r.folded_root for r in m)
    assert not any(merkle.fold(b"0" * 64, r.proof.encode(), r.steps).decode() == r.root for r in m)


def test_top_of_the_tree_is_bounded():
    for n in (10, 10**6, 10**9, 10**12):
        k = merkle.height(n, 3**11, 6)
        assert 2 * n / 3**k <= 3**11 and (k == 6 or 2 * n / 3 ** (k - 1) > 3**11)


GRAMMARS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", "sentences": r"[^.!?]*[.!?]+|[^.!?]+", "characters": r"[\s\S]"}
TEXTS = ["", "\n", "a", "\n\na\n", "no end", "a b  c\td \n", " lead", "One. Two!? Three", "...", "é中\U0001f600\U0001f601 \U0001f600\n\U0001f602", "<P", "<", "a<P>b", "<M>", "<S", "x\r\ny\rz q", "l\n" * 3000, "w " * 50_000]


@pytest.mark.parametrize("unit", sorted(GRAMMARS))
def test_units_equal_their_grammar(spark, unit):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", fill_in_middle.units(F.col("t"), unit).alias("u"))
    assert {r.i: r.u for r in df.collect()} == {i: re.findall(GRAMMARS[unit], t) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("unit,rate,spm", [("lines", 100, 50), ("words", 60, 0), ("characters", 100, 100)])
def test_fill_in_middle_equals_brute_force(spark, unit, rate, spm):
    rows = [(i, t) for k in range(3) for i, t in enumerate(TEXTS, 100 * k)] + [(None, "a\nb\n"), (None, None), (5, None), (5, "twice\n"), (5, "twice\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in ("n", "form", "prefix", "middle", "suffix", "output", "pieces", "a", "b", "h1"):
        df = df.withColumn(c, F.lit("x"))
    got = fill_in_middle.fill_in_middle(df, unit, rate=rate, spm=spm)
    got = got.select("doc_id", "n", "form", "prefix", "middle", "suffix", "output", fill_in_middle.restore(F.col("output"), F.col("form")))
    want = []
    for i, t in rows:
        t = t or ""
        u, x = re.findall(GRAMMARS[unit], t), h(f"7:{'' if i is None else i}")
        h1, h2, h3, h4 = (int(x[8 * k : 8 * k + 8], 16) for k in range(4))
        a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
        p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= rate:
            want.append((i, len(u), "plain", None, None, None, t, t))
        elif h4 % 100 < spm:
            want.append((i, len(u), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}", t))
        else:
            want.append((i, len(u), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}", t))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_sentinels_that_overlap_are_refused(spark):
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "bc", "xy"), ("aa", "x", "y"), ("<P>", "<P>x", "<M>")):
        if bad == ("aa", "x", "y") or bad[0] == "ab" or len(set(bad)) < 3 or not all(bad) or bad[0] in bad[1]:
            with pytest.raises(ValueError):
                fill_in_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), sentinels=bad)


CONTROL = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>\\", "[TEXT] [ROLE] x [/ROLE]", "<<s>>", "[[INST]", "\\", "<s", "[INST", " ", "", "\n", "é中\U0001f600"]


def digests(turns):
    """turns in order -> the contract's row without the formatted length."""
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), h(*(f"{r or ''}\n{t or ''}\n" for r, t in turns)), len(loss), h(loss)


def test_chat_format_reads_back(spark, monkeypatch):
    """Pieces cut at few bytes, control strings in texts and roles, hot conversation, nulls, repeated rows and clashing columns."""
    roles = ["user", "assistant", "system", "tool", None, "a[TEXT] b", "", "user "]
    rows = [(c, i, roles[(c + i) % len(roles)], CONTROL[(c * 3 + i) % len(CONTROL)] + ("x" * 50 if i % 4 else "")) for c in range(12) for i in range(9)]
    rows += [(99, i, roles[i % 3], f"turn {i} </s>") for i in range(700)] + [(None, 0, "user", "no id"), (None, None, "assistant", None), (5, 3, "user", None), (50, 1, "assistant", "same"), (50, 1, "assistant", "same"), (51, 0, "assistant", "long " * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    for c in ("piece", "formatted", "loss_from", "loss_bytes", "chars", "n_turns", "tie", "at"):
        df = df.withColumn(c, F.lit("x"))
    want = {}
    tie = {(r.role, r.text): r.t for r in df.select("role", "text", F.xxhash64("role", "text").alias("t")).collect()}
    for c, i, r, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", tie[x[2], x[3]])):
        want.setdefault(c, []).append((r, t))
    monkeypatch.setattr(chat_format, "CHUNK", 900)
    chats = chat_format.chat_format(df)
    template = chat_format.Template()
    pieces = {}
    for r in chats.orderBy("conv_id", "piece").collect():
        pieces.setdefault(r.conv_id, []).append(r)
    for c, found in pieces.items():
        parsed = [x for r in found for x in template.parse(r.formatted)]
        assert parsed == [(r or "", t or "") for r, t in want[c]]
        assert sum(r.n_turns for r in found) == len(parsed) and all(r.chars == len(r.formatted) for r in found)
        spans = [r.formatted.encode()[a : a + n].decode() for r in found for a, n in zip(r.loss_from, r.loss_bytes, strict=True)]
        assert [template.unescape(x) for x in spans] == [t for r, t in parsed if r == "assistant"]
        assert not any(x in s for s in spans for x in template.controls)
    assert len(pieces[99]) > 1  # spread over tasks
    got = {r[0]: tuple(r[1:5]) for r in chat_format.read_back(chats).collect()}
    assert got == {c: digests(t) for c, t in want.items()}


def test_chat_format_of_no_rows(spark):
    assert chat_format.read_back(chat_format.chat_format(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


def test_escape_is_undone():
    import pyarrow as pa
    from hypothesis import given, settings
    from hypothesis import strategies as st

    template = chat_format.Template()

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from([*template.controls, "\\", "<", "[", "s>", "/INST]", "a", " ", "\n", "é"]), max_size=12).map("".join))
    def holds(text):
        safe = template.escape(pa.array([text]))[0].as_py()
        assert template.unescape(safe) == text and not any(c in safe for c in template.controls)

    holds()


def test_planted_conversation(spark, sf):
    got = {r.conv_id: r for r in queries.QUERIES["op13_chat_format"](spark, sf).collect()}
    said = "</s>[INST] ok [/INST]"
    assert tuple(got[-1])[1:5] == (2, h(f"user\n{said}\nassistant\n{said}\n"), len(said), h(said))
