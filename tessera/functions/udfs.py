"""Arrow-batched functions where columns cannot say it: recursive splits, fuzzy ratios, phrase automata."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most size: split at the first separator that occurs, merged up to size with overlap, too long ones split further."""
    sep = next((s for s in separators if s in text), "")
    parts = text.split(sep) if sep else list(text)
    rest = separators[separators.index(sep) + 1 :] if sep else ()
    out: list[str] = []
    held: list[str] = []

    def flush():
        if joined := sep.join(held).strip():
            out.append(joined)

    for part in parts:
        if len(part) > size and rest:
            flush()
            held = []
            out += split_text(part, size, overlap, rest)
            continue
        if held and len(sep.join([*held, part])) > size:
            flush()
            while held and (len(sep.join(held)) > overlap or len(sep.join([*held, part])) > size):
                held.pop(0)
        held.append(part)
    flush()
    return out


def hard_split(text: str, most: int) -> list[str]:
    """Cuts at the last newline within most, if it is in its second half, else at most."""
    out = []
    while len(text) > most:
        at = text.rfind("\n", 0, most)
        at = at if at >= most // 2 else most
        out.append(text[:at].strip())
        text = text[at:].strip()
    return [x for x in [*out, text.strip()] if x]


def chunks(size: int = 512, overlap: int = 64):
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t or "", size, overlap))

    return run


def sections(most: int = 1500):
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hard_split(t or "", most))

    return run


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two strings."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def phrase_blocks(phrases: DataFrame, column: str, most_bytes: int = 8 << 20):
    """Non-empty phrases in blocks of bounded size, one on the driver at a time."""
    block, size = [], 0
    for (phrase,) in phrases.select(column).filter(F.length(column) > 0).toLocalIterator():
        if block and size + len(phrase) > most_bytes:
            yield block
            block, size = [], 0
        block.append(phrase)
        size += len(phrase)
    if block:
        yield block


def _contains(held):
    @F.pandas_udf("boolean")
    def hit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        machine = ahocorasick.Automaton()  # once a task
        for p in held.value:
            machine.add_word(p, 1)
        machine.make_automaton()
        for texts in batches:
            yield texts.map(lambda t: next(machine.iter(t or ""), None) is not None).astype(bool)

    return hit


def with_phrases(rows: DataFrame, column: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """rows with blocked: whether the text contains any phrase; a block of phrases is one automaton and one narrow pass."""
    out = rows.withColumn("blocked", F.lit(False))
    for block in phrase_blocks(phrases, phrase):
        out = out.withColumn("blocked", F.col("blocked") | _contains(rows.sparkSession.sparkContext.broadcast(block))(F.col(column)))
    return out


def _matches(patterns: list[str]):
    @F.pandas_udf("boolean")
    def hit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = [re.compile(p, re.IGNORECASE) for p in patterns]  # once a task
        for texts in batches:
            yield texts.map(lambda t: any(p.search(t or "") for p in compiled)).astype(bool)

    return hit


def with_patterns(rows: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """rows with blocked: whether any pattern is found in the text in any case; patterns that do not compile are skipped.

    Patterns are a hand-written list, which goes to the tasks with the function; long lists of phrases are with_phrases.
    """
    good = []
    for p in patterns:
        try:
            re.compile(p, re.IGNORECASE)
            good.append(p)
        except re.error:
            pass
    return rows.withColumn("blocked", _matches(good)(F.col(column)) if good else F.lit(False))
