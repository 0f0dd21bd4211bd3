"""Wiki markup as one tree: links, templates with named parts, headings, tags and styles, read in one pass over the text.

Every node has its interval in preorder and the text that it stands for; what is opened and never closed is plain text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIGNS = r"\{{2,}|\}{2,}|\[\[|\]\]|<!--.*?(?:-->|\Z)|</[A-Za-z][^<>]*>|<[A-Za-z][^<>]*>|\[(?=https?://)|\]|'''''|'''|''"
_TOKEN = re.compile(rf"(?=[<{{}}\[\]|='\n*#:;\-])(?:^\{{\||^\|\}}(?!\}})|\||=|\n|{_SIGNS}|^[*#:;]+|^-{{4,}})", re.S | re.M)
#: Tokens where a template is innermost: lines and their marks are text there; a part's sign comes with its plain label.
_INSIDE = re.compile(rf"(?=[<{{}}\[\]|='])(?:^\{{\||^\|\}}(?!\}})|\|(?:[^<{{}}\[\]|='\n]*=)?|=|{_SIGNS})", re.S | re.M)
#: A link without any sign in it.
_LINK = re.compile(r"\[\[([^<{}\[\]|='\n]*+)(?:\|([^<{}\[\]='\n]*+))?\]\]")
_OPENS = {"[[": "link", "[": "external", "{|": "table"}
_CLOSES = {"]]": "link", "]": "external", "|}": "table"}
#: Tags without content; of them br is a line break.
_SINGLE = {"br", "hr", "wbr", "img"}
#: What does not go over lines.
_LINE = ("heading", "style", "external")
NODES = T.ArrayType(T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("pre", "last", "parent")), *(T.StructField(c, T.StringType()) for c in ("kind", "name", "text"))]))


class _Frame:
    """What is open: its texts so far (out), complete parts (name or None, value), the open part's node and name, where it ends or shows from (at)."""

    __slots__ = ("kind", "name", "raw", "pre", "parent", "out", "parts", "part", "label", "at", "unnamed")

    def __init__(self, kind, name, raw, pre, parent, at):
        self.kind, self.name, self.raw, self.pre, self.parent, self.at = kind, name, raw, pre, parent, at
        self.out, self.parts, self.part, self.label, self.unnamed = [], [], None, None, 0

    def key(self):
        return self.kind, self.name if self.kind in ("tag", "style") else ""

    def inside(self) -> int:
        return self.pre if self.part is None else self.part

    def rest(self) -> str:
        """What was read since the opening, as it would stand as text."""
        own = "".join(self.out) if self.label is None else f"{self.label}={''.join(self.out)}"
        return "|".join([*(v if n is None else f"{n}={v}" for n, v in self.parts), own])


class Markup:
    """One text, read: nodes, and plain (the text that it stands for). Without whole, templates that lie in no other have no text."""

    def __init__(self, text: str, colon: str = "：", whole: bool = True):
        self.text, self.colon, self.whole, self.nodes, self.count = text, colon, whole, [], {}
        self.stack = [_Frame("root", "", "", -1, -1, 0)]
        at, behind, headings = 0, 0, self._headings()  # text from at on is not taken yet, tokens go on behind
        while True:
            top = self.stack[-1]
            template = top.kind == "template"
            if not (m := (_INSIDE if template else _TOKEN).search(text, behind)):
                break
            t, start, behind = m[0], m.start(), m.end()
            if template and t == "=" and start not in headings:
                if top.part is None or top.label is not None:
                    continue  # text
                top.label, top.out = "".join([*top.out, text[at:start]]), []
            else:
                if start > at:
                    top.out.append(text[at:start])
                if template and t[0] == "|" and t != "|}":
                    self._next_part(top, t[1:-1] if len(t) > 1 else None)
                else:
                    behind = self._token(t, start, behind, headings) or behind
            at = behind
        self._text(text[at:])
        while len(self.stack) > 1:
            self._give_up()
        self.plain = "".join(self.stack[0].out)

    def _headings(self) -> dict[int, int]:
        """Starts of the lines that are headings: how many signs stand on each side, and where those behind begin."""
        found = {}
        for m in re.finditer(r"^=[^\n]*", self.text, re.M):
            line = m[0].rstrip(" \t")
            n = len(line) - len(line.lstrip("="))
            if n <= 6 and len(line) - len(line.rstrip("=")) == n and line[n:-n].strip():
                found[m.start()] = (n, m.start() + len(line) - n)
        return found

    def _text(self, piece: str):
        if piece:
            self.stack[-1].out.append(piece)

    def _open(self, kind, name, raw, at):
        f = _Frame(kind, name, raw, len(self.nodes), self.stack[-1].inside(), at)
        self.stack.append(f)
        self.count[f.key()] = self.count.get(f.key(), 0) + 1
        self.nodes.append({"kind": "text", "name": "", "text": raw, "parent": f.parent, "last": f.pre})

    def _pop(self) -> _Frame:
        f = self.stack.pop()
        self.count[f.key()] -= 1
        return f

    def _give_up(self):
        """The innermost frame was not closed: its opening is text, what it holds goes to the one around it."""
        f = self._pop()
        self.stack[-1].out += [f.raw, f.rest()]

    def _unwind(self, kind: str, name: str = "") -> bool:
        """Gives up what stands open inside the innermost frame of this kind; False if there is none."""
        if not self.count.get((kind, name)):
            return False
        while not (self.stack[-1].kind == kind and (not name or self.stack[-1].name == name)):
            self._give_up()
        return True

    def _close(self, text: str, name: str | None = None):
        """The innermost frame is complete and stands for text."""
        f = self._pop()
        self.nodes[f.pre] |= {"kind": f.kind, "name": f.name if name is None else name, "text": text, "last": len(self.nodes) - 1}
        self.stack[-1].out.append(text)

    def _end_part(self):
        """A template's name, or one of its parts, is complete; parts without a name count from 1."""
        f = self.stack[-1]
        value = f.out[0] if len(f.out) == 1 else "".join(f.out)
        if f.part is None:
            f.name = value.strip()
        else:
            node = self.nodes[f.part]
            f.unnamed += f.label is None
            node["text"], node["name"], node["last"] = value.strip(), str(f.unnamed) if f.label is None else f.label.strip(), len(self.nodes) - 1
        f.parts.append((f.label, value))
        f.out, f.label = [], None

    def _next_part(self, f: _Frame, label: str | None):
        """The open template goes on with another part; its label may be known."""
        self._end_part()
        f.part, f.label = len(self.nodes), label
        self.nodes.append({"kind": "part", "name": "", "text": "", "parent": f.pre, "last": f.part})

    def _token(self, t: str, start: int, end: int, headings) -> int | None:
        """Takes one token; returns where to go on if that is not behind it."""
        top = self.stack[-1]
        if t[:2] == "{{":
            for n in [2] * ((len(t) - 3 * (len(t) % 2)) // 2) + [3] * (len(t) % 2):  # outer ones first; an odd one is an argument inside
                self._open("argument" if n == 3 else "template", "", "{" * n, end)
        elif t[:2] == "}}":
            self._braces(len(t), start)
        elif t == "[[" and (link := _LINK.match(self.text, start)):
            shown, at = link[2] or link[1], len(self.nodes)
            self.nodes.append({"kind": "link", "name": link[1].strip(), "text": shown, "parent": top.inside(), "last": at})
            top.out.append(shown)
            return link.end()
        elif t == "\n":
            while self.stack[-1].kind in _LINE:
                self._give_up()
            self._text(t)
        elif t.startswith("<!--"):
            return None
        elif t[0] == "<":
            self._tag(t)
        elif t == "=" and start in headings:
            n, stop = headings[start]
            self._open("heading", str(n), "=" * n, stop)
            return start + n
        elif t == "=" and top.kind == "heading" and start == top.at:
            self._close("\n" + "".join(top.out).strip() + "\n")
            return start + int(top.name)
        elif t[0] == "'":
            if top.key() == ("style", t):
                self._close("")
            else:
                self._open("style", t, t, start)
        elif t[0] in "*#:;-" and len(self.stack) == 1:
            pass  # marks of lists and rules stand for nothing
        elif t in _OPENS:
            self._open(_OPENS[t], "", t, end)
        elif t == "|" and top.kind == "link" and not top.parts:
            top.parts, top.out, top.at = [(None, "".join(top.out))], [], end
        elif t in _CLOSES and self._unwind(_CLOSES[t]):
            self._complete(self.stack[-1], start)
        else:
            self._text(t)
        return None

    def _braces(self, n: int, start: int):
        """Closes what stands open from the inside, two or three at a time; braces that close nothing are text."""
        while n >= 2 and (self.count.get(("template", "")) or self.count.get(("argument", ""))):
            while self.stack[-1].kind not in ("template", "argument"):
                self._give_up()
            f = self.stack[-1]
            if f.kind == "argument" and n < 3:
                self._give_up()
                continue
            self._complete(f, start)
            n -= 3 if f.kind == "argument" else 2
        self._text("}" * n)

    def _complete(self, f: _Frame, end: int):
        if f.kind == "template":
            self._end_part()
            if not self.whole and self.count["template", ""] == 1 and not self.count.get(("argument", "")):
                return self._close("")
            shown, unnamed = [], 0
            for label, value in f.parts[1:]:
                unnamed += label is None
                name, value = str(unnamed) if label is None else label.strip(), value.strip()
                shown += [f"{name}{self.colon}{value}" if name else value] if value else []
            self._close("\n".join(shown))
        elif f.kind == "link":
            name = f.parts[0][1] if f.parts else "".join(f.out)
            self._close((self.text[f.at : end] if f.parts else "") or name, name.strip())
        elif f.kind == "external":
            url, _, label = "".join(f.out).partition(" ")
            self._close(label or url, url)
        else:  # arguments and tables stand for nothing
            self._close("")

    def _tag(self, t: str):
        name = re.match(r"</?([A-Za-z][A-Za-z0-9]*)", t)[1].lower()
        if name in _SINGLE or t.endswith("/>"):
            shown = "\n" if name == "br" else ""
            self.nodes.append({"kind": "tag", "name": name, "text": shown, "parent": self.stack[-1].inside(), "last": len(self.nodes)})
            self._text(shown)
        elif t[1] != "/":
            self._open("tag", name, t, 0)
        elif self._unwind("tag", name):
            self._close("")  # what a tag holds is not shown
        else:
            self._text(t)


def plain(text: str | None) -> str | None:
    """The text that a markup stands for."""
    return None if text is None else Markup(text).plain


def nodes(text: str | None) -> list[dict]:
    return [{"pre": i, **{k: n[k] for k in ("last", "parent", "kind", "name", "text")}} for i, n in enumerate(Markup(text or "").nodes)]


@F.pandas_udf(T.StringType())
def plain_text(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(plain)


@F.pandas_udf(NODES)
def markup_nodes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(nodes)


def templates(text: str | None) -> list[tuple[int, str, dict[str, str]]]:
    """(place in preorder, name, parts) of every template; of parts with equal names the last counts."""
    made = Markup(text or "", whole=False).nodes
    found = {i: (i, n["name"], {}) for i, n in enumerate(made) if n["kind"] == "template"}
    for n in made:
        if n["kind"] == "part" and n["parent"] in found:
            found[n["parent"]][2][n["name"]] = n["text"]
    return list(found.values())


#: Texts that are read at once, and characters of parts in a batch that goes back.
_TEXTS, _CHARS = 64, 1 << 21


def template_parts(rows: DataFrame, keys: list[str], text: str, name: Column) -> DataFrame:
    """(keys, template, name, nth, parts): templates whose name fits, in order, with a map of their parts; of equal names the last counts.

    nth counts the templates of one name in their text, from 1. A template without parts has no map. Every text is read
    once, in its own row.
    """
    kept = rows.select(*keys, text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            of = part.select(keys).take(pa.array(at, pa.int64()))
            ends = pa.array(np.cumsum([0, *(len(p) for p in parts)]), pa.int32(), mask=np.array([*(not p for p in parts), False]))
            maps = pa.MapArray.from_arrays(ends, pa.array([k for p in parts for k in p], pa.string()), pa.array([v for p in parts for v in p.values()], pa.string()))
            return pa.RecordBatch.from_arrays([*of.columns, pa.array(places, pa.int32()), pa.array(names, pa.string()), pa.array(numbers, pa.int32()), maps], [*keys, "template", "name", "nth", "parts"])

        for batch in batches:
            for a in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(a, _TEXTS)
                (at, places, names, numbers, parts), size = ([] for _ in range(5)), 0
                for i, one in enumerate(part.column(text).to_pylist()):
                    count: dict[str, int] = {}
                    for place, named, its in templates(one):
                        count[named] = count.get(named, 0) + 1
                        for column, v in ((at, i), (places, place), (names, named), (numbers, count[named]), (parts, its)):
                            column.append(v)
                        size += len(named) + sum(map(len, its.values()))
                    if size >= _CHARS:
                        yield made()
                        (at, places, names, numbers, parts), size = ([] for _ in range(5)), 0
                if at:
                    yield made()

    schema = T.StructType([*(kept.schema[k] for k in keys), T.StructField("template", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("nth", T.IntegerType()), T.StructField("parts", T.MapType(T.StringType(), T.StringType()))])
    return kept.mapInArrow(read, schema).filter(name)
