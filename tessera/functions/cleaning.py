"""Ordered rewrites of raw page text and of wiki markup, and the lines that are worth keeping.

Repeated groups are possessive, as Java's matcher would otherwise use its stack for each repetition.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of leftovers in page text, in their order, and what each becomes.
CLEAN_PATTERNS = (
    (r"\|\s*\d+px\s*\|[^|\n]*+(?:\|[^|\n]*+)*+", ""),
    (r"(?i)\|\s*(?:center|居中|left|right|link\s*=\s*\S*|class\s*=\s*\S*)\b", ""),
    (r"\d+px", ""),
    (r"[Ff]ile:[A-Za-z0-9_./\-]+(?:\.\w+)?(?:\s*+\|\s*+[^|\n]*+)*+", ""),
    (r"语音：[A-Za-z0-9_./\-]+\.(?:ogg|mp3|wav|flac)(?:\s*+\|\s*+[^|\n]*+)*+", ""),
    (r"(?:图片|立绘|图标|头像|背景)[：:]\s*[A-Za-z0-9_./\-]+\.(?:png|jpg|jpeg|gif|webp|svg)", ""),
    (r"[\x{4e00}-\x{9fff}A-Za-z0-9_\-]+-(?:face|default|portrait|battle|story|sprite)[\x{4e00}-\x{9fff}A-Za-z0-9_\-]*\.(?:png|jpg|jpeg|gif|webp|svg)[：:][^\n，,。.；;]{0,20}", ""),
    (r"(?i)\b(?:organize|name|picture|page|image)\s*[：:]\s*\S+", ""),
    (r"\b(?:bg-\w+|mw-\w+|title-class|body-style|text-align|display)\b[\s=]*[^;\n]*;?", ""),
    (r"""(?i)style\s*=\s*["'][^"']*["']""", ""),
    (r"\|\s*\|", " "),
    (r"(?m)^\s*\|\s*$", ""),
    (r"(?m)^\|[^\n]*$", ""),
    (r"""[！!]\s*["'}）]\s*\}""", ""),
    (r"""(?m)^[\s!！"'，,。.\[\]{}（）():：;；\-–—]+$""", ""),
    (r" {3,}", " "),
    (r"<[^>]+>", ""),
    (r"(?s)\{\|.*?\|\}", ""),
    (r"\{\{\{[0-9]+\}\}\}", ""),
    (r"\{\{[^}{]*?\}\}", ""),
    (r"\n{4,}", "\n\n"),
    (r"(?m)^\d+[、.]\s*$", ""),
    (r"(?mi)^\s*(?:justify-content|align-items|flex-direction|flex-wrap|grid-template|position|display|overflow|z-index)\s*:[^;]*;?\s*$", ""),
)

#: Rewrites of wiki markup in their order; groups are written as in Spark.
WIKI_PATTERNS = (
    (r"=====?\s*(.+?)\s*=====?", "### $1"),
    (r"====\s*(.+?)\s*====", "### $1"),
    (r"===\s*(.+?)\s*===", "## $1"),
    (r"==\s*(.+?)\s*==", "# $1"),
    (r"'''''(.+?)'''''", "***$1***"),
    (r"'''(.+?)'''", "**$1**"),
    (r"''(.+?)''", "*$1*"),
    (r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2"),
    (r"\[\[([^\]]+)\]\]", "$1"),
    (r"\[(https?://[^\s\]]+)\s+([^\]]+)\]", "$2 ($1)"),
    (r"(?m)^\*\s+", "- "),
    (r"(?m)^#\s+", "1. "),
    (r"\{\{[^}]+\}\}", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?s)<ref[^>]*>.*?</ref>", ""),
    (r"<ref[^>]*/>", ""),
    (r"\n{3,}", "\n\n"),
)

#: Lines that are dropped, and a beginning that is kept however short the line.
NOISE_LINES = (
    r"""^[\d,.\-–—|/\\\[\]{}()（）:：;；!！?"'＂\s]+$""",
    r"^[A-Za-z0-9_./\-]+\.[a-z]{2,4}$",
    r"(?i)^[\x{4e00}-\x{9fff}A-Za-z0-9_\-]+-(?:face|default|portrait|battle|story)[A-Za-z0-9_\-]*\.[a-z]{3,4}[：:]\s*\S",
    r"(?i)^[a-z\-]+\s*:\s*[^;]*;?\s*$",
    r"(?i)^(?:organize|name|picture|page|image)\s*[：:]\s*\S+$",
)
KEPT_LINE = r"^[A-Za-z\x{4e00}-\x{9fff}]{2,}"
EDGES = r"^\s+|\s+$"


def java(pattern: str) -> str:
    """Classes by Unicode, and lines that end at newlines alone."""
    return "(?Ud)" + pattern


def sql(expression: str, rules) -> str:
    """The rewrites for engines of the RE2 kind, which need no possessive groups."""
    for pattern, to in rules:
        plain, group = pattern.replace("*+", "*").replace("'", "''"), re.sub(r"\$(\d)", r"\\\1", to).replace("\n", "' || chr(10) || '")
        expression = f"regexp_replace({expression}, '{plain}', '{group}', 'g')"
    return expression


def rewrite(c: Column, rules) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, java(pattern), to)
    return c


def strip(c: Column) -> Column:
    return F.regexp_replace(c, java(EDGES), "")


def worth(line: Column) -> Column:
    """A stripped line with three Chinese characters, five letters with them, or two letters at its beginning, that is no noise."""
    number = lambda p: F.regexp_count(line, F.lit(p))
    wide, letters = number(r"[\x{4e00}-\x{9fff}]"), number("[A-Za-z]")
    ok = (wide >= 3) | (wide + letters >= 5) | line.rlike(KEPT_LINE)
    for p in NOISE_LINES:
        ok = ok & ~line.rlike(java(p))
    return ok


def clean_page(c: Column) -> Column:
    """All rewrites in order, then the lines that are worth keeping, stripped; null stays null."""
    lines = F.split(rewrite(c, CLEAN_PATTERNS), "\n")
    return F.array_join(F.filter(F.transform(lines, strip), worth), "\n")


def wiki_to_markdown(c: Column) -> Column:
    """Headings, emphasis, links and lists as Markdown; templates, comments and references go."""
    return strip(rewrite(c, WIKI_PATTERNS))
