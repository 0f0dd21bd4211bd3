"""Nested templates {{name|...}}: spans, removal, and the blocks of a dialogue page; all linear in the text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_BRACES = re.compile(r"\{\{|\}\}")
_SPLIT = re.compile(r"\{\{|\}\}|\|")
_EVENTS = re.compile(r"^={2,}[ \t]*([^=\n]+?)[ \t]*={2,}[ \t]*$|\{\{Dialog", re.M)
_TAGS = re.compile(r"<[^>]+>|'''")
BLOCKS = ArrayType(StructType([StructField(name, StringType()) for name in ("type", "role", "text")]))


def spans(text: str) -> dict[int, int]:
    """Start of each closed template to its end; an opening without a partner has none."""
    opened, closed = [], {}
    for m in _BRACES.finditer(text):
        if m[0] == "{{":
            opened.append(m.start())
        elif opened:
            closed[opened.pop()] = m.end()
    return closed


def without_templates(text: str) -> str:
    """Text outside of all templates; what follows an opening without a partner is inside, a closing without one goes. A text without openings stays as it is."""
    if "{{" not in text:
        return text
    kept, depth, at = [], 0, 0
    for m in _BRACES.finditer(text):
        if depth == 0:
            kept.append(text[at : m.start()])
        depth = depth + 1 if m[0] == "{{" else max(depth - 1, 0)
        at = m.end()
    return "".join(kept) + ("" if depth else text[at:])


def parameters(body: str) -> list[str]:
    """The parts of a template between bars that are not inside another template, without its name."""
    parts, depth, at = [], 0, 0
    for m in _SPLIT.finditer(body):
        if m[0] == "|":
            if depth == 0:
                parts.append(body[at : m.start()])
                at = m.end()
        else:
            depth += 1 if m[0] == "{{" else -1
    return [p.strip() for p in [*parts, body[at:]][1:]]


def spoken(body: str) -> tuple[str, str]:
    """(role, text) of a template: by the names role=, text= and 4=, else the third and fourth part without a name."""
    role = text = ""
    unnamed = []
    for part in parameters(body):
        name, sign, value = part.partition("=")
        name = name.strip() if sign else ""
        if name == "role":
            role = value.strip()
        elif name == "text" or (name == "4" and not text):
            text = value.strip()
        elif name != "voice" and part:
            unnamed.append(part)
    unnamed = unnamed[:4] + [""] * (4 - len(unnamed))
    return role or unnamed[2], text or unnamed[3]


def blocks(page: str | None) -> list[dict]:
    """Sections (== name ==), lines of a role and narration in the order of the page; empty lines are none.

    Templates may nest and go over lines; one that is not closed is passed over. Trailing digits of a role go.
    """
    found, end, closed = [], 0, spans(page or "")
    for m in _EVENTS.finditer(page or ""):
        if m.start() < end:
            continue
        if m[1] is not None:
            found.append({"type": "section", "role": "", "text": m[1].strip()})
        elif m.start() in closed:
            end = closed[m.start()]
            role, text = spoken(page[m.start() + 2 : end - 2])
            if text := _TAGS.sub("", text):
                role = re.sub(r"\d+$", "", role).strip()
                found.append({"type": "dialogue" if role else "narration", "role": role, "text": text})
    return found


@F.pandas_udf(BLOCKS)
def dialogue_blocks(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(blocks)


@F.pandas_udf(StringType())
def strip_templates(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: None if t is None else without_templates(t))
