"""Fill-in-middle transformation by lookaround splitting (operator 12), DataFrame functions only.

A grammar of units is translated to a zero-width boundary: a unit ends after a character of one class where a character
of another follows, so ``split`` at that boundary keeps every character and no piece is empty. Three cuts by hashes of
the document's id make prefix, middle and suffix; sentinels mark them, and restore() reads the text back from the output.
No row meets another: one map over the table, no shuffle.

Defined cases: null text is empty; an empty text has no unit (split alone would give one empty piece) and stays plain;
a text that holds a sentinel stays plain; a null id draws as the empty string; repeated rows are each transformed, equal
ids alike; other columns are ignored. Text is taken as valid UTF-8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINELS = ("<P>", "<S>", "<M>")
#: Classes of a unit's last character and of the next unit's first one. Lines: [^\n]*\n|[^\n]+; words: a word with the
#: white space behind it; sentences: up to the marks at their end; characters: code points.
UNITS = {
    "lines": (r"\n", r"[^\n]|\n"),
    "words": (r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"),
    "sentences": (r"[.!?]", r"[^.!?]"),
    "characters": (r"[^\n]|\n", r"[^\n]|\n"),
}


def boundary(unit: str) -> str:
    end, start = UNITS[unit]
    return f"(?<={end})(?={start})"


def units(text: Column, unit: str) -> Column:
    """The text's units; joined they are the text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(unit), -1))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the seed and the id."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(named, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels of which none holds another, nor begins where another ends: no text without one can form one with its neighbours."""
    if len(set(sentinels)) < 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")
    for a in sentinels:
        for b in sentinels:
            if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels overlap: {a!r}, {b!r}")
    return sentinels


def fill_in_middle(docs: DataFrame, unit: str = "lines", seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n (units), form, prefix, middle, suffix (null if plain), output.

    rate: percentage of documents to transform; spm: percentage of those with the suffix first.
    """
    p, s, m = _checked(sentinels)
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    drawn = dict(zip(("h1", "h2", "h3", "h4"), draws(F.col("doc_id"), seed), strict=True))
    d = d.withColumns({"pieces": units(F.col("text"), unit), **drawn}).withColumn("n", F.size("pieces").cast("long"))
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    marked = F.contains("text", F.lit(p)) | F.contains("text", F.lit(s)) | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    d = d.withColumns({"a": F.least(one, two).cast("int"), "b": F.greatest(one, two).cast("int"), "form": form})
    part = lambda at, upto: F.when(F.col("form") != "plain", F.array_join(F.slice("pieces", at + 1, upto - at), ""))
    d = d.withColumns({"prefix": part(F.lit(0), F.col("a")), "middle": part(F.col("a"), F.col("b")), "suffix": part(F.col("b"), F.col("n").cast("int"))})
    psm, spm_ = F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle"), F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm_)
    return d.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text, from an output and its form alone: the parts between the first places of the sentinels, in order."""
    p, s, m = _checked(sentinels)

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        at, end = F.instr(output, second), F.instr(output, m)
        cut = lambda start, stop: F.substring(output, start, stop - start)
        return cut(F.lit(len(first) + 1), at), cut(at + len(second), end), F.substring(output, end + len(m), F.length(output))

    (prefix, suffix, middle), (suffix_, prefix_, middle_) = parts(p, s), parts(s, p)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix_, middle_, suffix_))
