r"""Chat formatting by columnar byte assembly (operator 13).

Turns are dealt by ranges of (conversation, turn) and sorted, so a conversation with any share of the rows spreads over
tasks. Each task takes the sorted turns a chunk at a time: lengths of headers, contents and footers give offsets by a
cumulative sum, offsets give scatter indices, and all bytes of the chunk are copied once into one Arrow buffer whose
string offsets are the conversations' ends. A conversation that ends in another chunk or task continues there: it is a
row of several pieces, numbered in order, which joined are its text (most have one).

Template: each turn is marked by its role's header and footer; a role outside the table is named in its header. Control
strings inside texts and role names get a backslash behind their first character, and those that have some already get
one more, so no content holds a control string and the escape can be undone. The loss mask is the spans of the
assistant's contents, in bytes of the piece.

Defined cases: null text and null role are empty; a null conversation is one of its own; turns go null first, then by
role and text where numbers tie; repeated rows are each a turn; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Bytes of content that are assembled at once.
CHUNK = 4 << 20


@dataclass(frozen=True)
class Template:
    """turns: role -> (header, footer); other: header, mark before the text and footer of roles not named there.

    Every control string starts with < or [, and holds neither of them elsewhere.
    """

    turns: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("[SYS] ", " [/SYS]"), "user": ("<s>[INST] ", " [/INST]"), "assistant": ("[OUT] ", "</s>")})
    other: tuple[str, str, str] = ("[ROLE] ", "[TEXT] ", " [/ROLE]")
    learned: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]", "[ROLE]", "[/ROLE]", "[TEXT]")

    def rests(self) -> list[tuple[str, str]]:
        """First characters with a pattern of what follows them in the control strings."""
        return [(c, "|".join(re.escape(x[1:]) for x in self.controls if x[0] == c)) for c in "<["]

    def escape(self, texts: pa.Array) -> pa.Array:
        for c, rest in self.rests():
            texts = pc.replace_substring_regex(texts, rf"\{c}(\\*(?:{rest}))", rf"{c}\\\1")
        return texts

    def unescape(self, text: str) -> str:
        for c, rest in self.rests():
            if c + "\\" in text:
                text = re.sub(rf"\{c}\\(\\*(?:{rest}))", rf"{c}\1", text)
        return text

    def grammar(self) -> re.Pattern:
        """One turn of a formatted text; a named role's group is r and its place, other roles give role and text."""
        known = [f"{re.escape(h)}(?P<r{i}>.*?){re.escape(f)}" for i, (h, f) in enumerate(self.turns.values())]
        h, mark, f = map(re.escape, self.other)
        return re.compile("|".join([*known, f"{h}(?P<role>.*?){mark}(?P<text>.*?){f}"]), re.DOTALL)

    def parse(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of every turn of a piece; anything between turns is an error."""
        roles, at = list(self.turns), 0
        for m in self.grammar().finditer(formatted):
            if m.start() != at:
                break
            at = m.end()
            yield (self.unescape(m["role"]), self.unescape(m["text"])) if m.lastgroup == "text" else (roles[int(m.lastgroup[1:])], self.unescape(m[m.lastgroup]))
        if at != len(formatted):
            raise ValueError(f"no turn at {at}")


def _scatter(out: np.ndarray, to: np.ndarray, source: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> None:
    """Copies source[at : at + length] to out[to : to + length] for every segment, by indices of all bytes."""
    before = np.cumsum(lengths) - lengths
    byte = np.arange(int(lengths.sum()))
    out[byte + np.repeat(to - before, lengths)] = source[byte + np.repeat(at - before, lengths)]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array's bytes and its offsets in them."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), offsets


def assemble(template: Template, conv: pa.Array, role: pa.Array, text: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array, pa.Array, np.ndarray]:
    """Sorted turns -> rows where a piece begins, its formatted text, loss_from, loss_bytes, code points, turns."""
    content, at = _bytes_of(template.escape(text.fill_null("")))
    kinds = role.fill_null("").dictionary_encode()
    code, names = kinds.indices.to_numpy(), kinds.dictionary
    plain, safe = names.to_pylist(), template.escape(names).to_pylist()
    ends = [template.turns.get(r, (template.other[0] + s + template.other[1], template.other[2])) for r, s in zip(plain, safe, strict=True)]
    pool = [x.encode() for pair in ends for x in pair]
    n_bytes = np.array([len(x) for x in pool], np.int64)
    starts = np.cumsum(n_bytes) - n_bytes
    pool = np.frombuffer(b"".join(pool), np.uint8)

    lengths = np.stack([n_bytes[2 * code], np.diff(at), n_bytes[2 * code + 1]], axis=1)  # header, content, footer
    upto = np.cumsum(lengths.reshape(-1)).reshape(-1, 3)
    to = upto - lengths
    buffer = pa.allocate_buffer(int(upto[-1, -1]))
    out = np.frombuffer(buffer, np.uint8)
    _scatter(out, to[:, 0], pool, starts[2 * code], lengths[:, 0])
    _scatter(out, to[:, 1], content, at[:-1], lengths[:, 1])
    _scatter(out, to[:, 2], pool, starts[2 * code + 1], lengths[:, 2])

    ids, known = conv.fill_null(0).to_numpy(), conv.is_valid().to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])])
    turns = np.diff(np.r_[first, len(ids)])
    offsets = np.r_[to[first, 0], len(out)].astype(np.int32)
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), buffer)
    learned = np.isin(code, [i for i, r in enumerate(plain) if r in template.learned])
    piece = np.repeat(np.arange(len(first)), turns)
    lists = pa.array(np.r_[0, np.cumsum(np.bincount(piece[learned], minlength=len(first)))].astype(np.int32))
    loss_from = pa.ListArray.from_arrays(lists, pa.array(to[learned, 1] - offsets[piece[learned]]))
    loss_bytes = pa.ListArray.from_arrays(lists, pa.array(lengths[learned, 1]))
    chars = np.add.reduceat(((out & 0xC0) != 0x80).astype(np.int64), offsets[:-1]) if len(out) else np.zeros(len(first), np.int64)
    return first, formatted, loss_from, loss_bytes, pa.array(chars), turns


def _chunks(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of at most CHUNK bytes of text, one row at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy())
    at = 0
    while at < len(upto):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
        yield at, end
        at = end


def chat_format(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, piece, n_turns, formatted, loss_from, loss_bytes, chars (code points)."""
    template = template or Template()
    t = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    t = t.withColumn("tie", F.xxhash64("role", "text")).withColumn("at", F.monotonically_increasing_id())  # rows alike in all else spread too
    order = ("conv_id", "turn", "role", "tie", "at")
    t = t.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, end in _chunks(batch.column(2)):
                conv, role, text = (c.slice(at, end - at) for c in batch.columns)
                first, formatted, loss_from, loss_bytes, chars, n = assemble(template, conv, role, text)
                pieces = pa.array(np.arange(number, number + len(first)))
                number += len(first)
                yield pa.RecordBatch.from_arrays([conv.take(pa.array(first)), pieces, pa.array(n, pa.int64()), formatted, loss_from, loss_bytes, chars], names=["conv_id", "piece", "n_turns", "formatted", "loss_from", "loss_bytes", "chars"])

    return t.select("conv_id", "role", "text").mapInArrow(pieces, "conv_id long, piece long, n_turns long, formatted string, loss_from array<long>, loss_bytes array<long>, chars long")


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """chat_format()'s rows -> conv_id, n_turns, turns_sha256 (role, newline, text, newline of every turn), loss_chars,
    loss_sha256 (contents under the loss mask), formatted_chars; all parsed and unescaped from the formatted texts.

    A digest of a whole conversation is one running hash, so its pieces meet in one task, in order and a piece at a time.
    """
    template = template or Template()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def rows() -> pa.RecordBatch:
            cells = zip(*((c, n, h.hexdigest(), k, loss.hexdigest(), chars) for c, n, h, k, loss, chars in done), strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i in (2, 4) else pa.int64()) for i, x in enumerate(cells)], names=names)
            done.clear()
            return batch

        for batch in batches:
            for conv, text, spans, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    done.append(now)
                for role, said in template.parse(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                raw = text.encode()
                for at, n in zip(spans, lengths, strict=True):
                    said = template.unescape(raw[at : at + n].decode())
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(text)
            if len(done) > 1000:
                last = done.pop()
                yield rows()
                done.append(last)
        if done:
            yield rows()

    p = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "formatted", "loss_from", "loss_bytes")
    return p.mapInArrow(digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
