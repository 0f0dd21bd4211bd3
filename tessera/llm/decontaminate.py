"""Benchmark decontamination with suffix arrays over shards of the training text.

Every shard of documents gets a word-level suffix array. Every suffix of every test item is looked up by binary
search; ranges of suffixes that share a whole window give the places of verbatim matches, and windows that follow one
another in the same items join into the longest match. Windows of equal words are one class, looked up once, and a match
names a group of items, each group once a document: items that share their beginnings, met in many places, cost no pairs.
The benchmark goes to the tasks as hashes of its words, in blocks of bounded size that are all looked up in the array of a
shard, which is built once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import ALNUM, LOWER, materialize, runs, text_bytes, word_hashes, words

#: A suffix is sorted by this many words at a time, 16 bits each.
STEP = 4
LEVELS = 3
MATCH = "array<struct<doc_pos:int,length:int,group:int>>"
GROUP = "array<array<struct<item_id:string,item_pos:int>>>"


def _codes(hashes: np.ndarray) -> np.ndarray:
    return np.maximum(hashes >> np.uint64(48), np.uint64(1))


def _pack(codes: np.ndarray) -> np.ndarray:
    """For each position, its word code and the next three in one number that sorts as they do."""
    n = len(codes) - STEP + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(STEP):
        out = (out << np.uint64(16)) | codes[k : k + n]
    return out


class Block:
    """Some items as the hashes of their words; a window is so many words, or all of an item that has fewer.

    Windows of equal words are a class: at and size tell its words; keys (item << 32 | position) from starts[c] on its
    members; follows[c] is the class whose members all stand one word behind those of c, or -1.
    """

    def __init__(self, item_ids: list, texts: list[str | None], width: int):
        found = []
        for text in texts:
            data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            s, e, _ = words(data, np.array([0, len(data)]), ALNUM)
            found.append(word_hashes(data, s, e))
        self.names, n, self.width = [str(i) for i in item_ids], np.array([len(h) for h in found]), width
        self.hashes = np.concatenate([*found, np.zeros(0, np.uint64)])
        many = np.where(n > 0, np.maximum(1, n - width + 1), 0)
        item = np.repeat(np.arange(len(n)), many)
        pos = np.arange(len(item)) - (np.cumsum(many) - many)[item]
        at, size = (np.cumsum(n) - n)[item] + pos, np.minimum(n, width)[item]
        padded, k = np.append(self.hashes, np.uint64(0)), np.arange(width)
        told = np.column_stack([np.where(k < size[:, None], padded[np.minimum(at[:, None] + k, len(self.hashes))], np.uint64(0)), size.astype(np.uint64)]).reshape(-1, width + 1)
        _, first, class_of = np.unique(told, axis=0, return_index=True, return_inverse=True)
        class_of = class_of.reshape(-1)
        self.at, self.size = at[first], size[first]
        order = np.argsort(class_of, kind="stable")
        self.keys = (item[order].astype(np.int64) << 32) | pos[order]
        self.starts = np.append(0, np.cumsum(np.bincount(class_of, minlength=len(first))))
        # the class one word behind that of the first member, if it has the same members
        behind = np.minimum(first + 1, max(0, len(item) - 1))
        self.follows = np.where((item[behind] == item[first]) & (behind > first), class_of[behind], -1) if len(first) else np.zeros(0, np.int64)
        count = np.diff(self.starts)
        self.follows[(self.follows >= 0) & (count != count[self.follows])] = -1
        for c in np.flatnonzero((self.follows >= 0) & (count > 1)).tolist():
            if not np.array_equal(self.members(c) + 1, self.members(self.follows[c])):
                self.follows[c] = -1

    def members(self, c: int) -> np.ndarray:
        return self.keys[self.starts[c] : self.starts[c + 1]]

    def packed(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest packed key that the words of a level of each window allow."""
        low, high = np.zeros(len(self.at), np.uint64), np.zeros(len(self.at), np.uint64)
        codes = np.append(_codes(self.hashes), 0).astype(np.uint64)
        for k in range(STEP * level, STEP * (level + 1)):
            inside = k < self.size
            code = codes[np.where(inside, self.at + k, len(codes) - 1)]
            low = (low << np.uint64(16)) | code
            high = (high << np.uint64(16)) | np.where(inside, code, np.uint64(0xFFFF))
        return low, high


class SuffixArray:
    """The suffixes of a shard in the order of their words, by 12 words at most; documents end with a code of 0."""

    def __init__(self, hashes: np.ndarray, doc: np.ndarray, docs: int):
        self.hashes = np.zeros(len(hashes) + docs + STEP * LEVELS + 1, np.uint64)
        self.place = np.arange(len(hashes)) + doc
        self.hashes[self.place] = hashes
        self.doc_of = np.zeros(len(self.hashes), np.int32)
        self.doc_of[self.place] = doc
        codes = np.zeros(len(self.hashes), np.uint64)
        codes[self.place] = _codes(hashes)
        self.keys = _pack(codes)
        first = self.keys[self.place]
        order = np.argsort(first)
        top, self.order = first[order], self.place[order]
        same = np.zeros(len(top), bool)
        same[1:] = top[1:] == top[:-1]
        tied = same.copy()
        tied[:-1] |= same[1:]
        if tied.any():
            at, group = self.order[tied], np.cumsum(~same)[tied]
            later = [self._key(at, k) for k in range(LEVELS - 1, 0, -1)]
            self.order[tied] = at[np.lexsort((*later, group))]
        self.top = top

    def _key(self, at: np.ndarray, level: int) -> np.ndarray:
        return self.keys[np.minimum(at + STEP * level, len(self.keys) - 1)]

    def find(self, block: Block) -> Iterator[tuple[int, np.ndarray]]:
        """(class, places where its window begins), of the classes of a block that occur."""
        low, high = block.packed(0)
        lo, hi = np.searchsorted(self.top, low, "left"), np.searchsorted(self.top, high, "right")
        some = np.flatnonzero(hi > lo)
        if not len(some):
            return
        levels = [None, *(block.packed(level) for level in range(1, LEVELS))]
        for k in some.tolist():
            i, j, size = lo[k], hi[k], int(block.size[k])
            for level in range(1, LEVELS):
                if size <= STEP * level or i == j:
                    break
                keys = self._key(self.order[i:j], level)
                i, j = i + np.searchsorted(keys, levels[level][0][k], "left"), i + np.searchsorted(keys, levels[level][1][k], "right")
            at = self.order[i:j]
            for d in range(size):  # the codes are short: the whole words decide
                at = at[self.hashes[at + d] == block.hashes[block.at[k] + d]]
            if len(at):
                yield k, at


class _Found:
    """The matches of one document, and the groups of items that they name, each once."""

    def __init__(self):
        self.matches, self.groups, self.number = [], [], {}

    def add(self, block: Block, name, start: int, length: int, keys: np.ndarray):
        k = self.number.setdefault((id(block), name), len(self.groups))
        if k == len(self.groups):
            self.groups.append([{"item_id": block.names[x >> 32], "item_pos": x & 0xFFFFFFFF} for x in keys.tolist()])
        self.matches.append({"doc_pos": start, "length": length, "group": k})

    def runs(self, block: Block, start: np.ndarray, length: np.ndarray, cls: np.ndarray):
        """Joins runs of places whose classes follow one another: (start, keys at the start, name) are open as long as items go on."""
        opened, end = [], -1

        def shut(group, keys, name):
            self.add(block, name if len(keys) == len(group[1]) else keys.tobytes(), group[0], end - group[0] + block.width, keys)

        for p, n, c in zip(start.tolist(), length.tolist(), cls.tolist(), strict=True):
            here = block.members(c)
            kept, fresh = [], here
            for group in opened:
                shift = p - group[0]
                on = np.isin(group[1] + shift, here, assume_unique=True) if p == end + 1 else np.zeros(len(group[1]), bool)
                if not on.all():
                    shut(group, group[1][~on], group[2])
                if on.any():
                    rest = group[1][on]
                    kept.append((group[0], rest, group[2] if on.all() else rest.tobytes()))
                    fresh = np.setdiff1d(fresh, rest + shift, assume_unique=True)
            opened = [*kept, (p, fresh, c if len(fresh) == len(here) else fresh.tobytes())] if len(fresh) else kept
            end = p + n - 1
        for group in opened:
            shut(group, group[1], group[2])


def _scan(column, blocks: list, shard_bytes: int):
    """Per row: words, hit words, matches and groups."""
    data, offsets = text_bytes(column)
    for i, j in runs(offsets, shard_bytes):
        part, bounds = LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        s, e, doc = words(part, bounds, ALNUM)
        n_words = np.bincount(doc, minlength=j - i)
        hits, found = np.zeros(j - i, np.int64), [_Found() for _ in range(j - i)]
        if len(s):
            array = SuffixArray(word_hashes(part, s, e), doc, j - i)
            cover = np.zeros(len(array.hashes) + 1, np.int64)
            first = np.concatenate([[0], np.cumsum(n_words)])[:-1] + np.arange(j - i)
            for broadcast in blocks:
                block = broadcast.value
                met = [(c, at) for c, at in array.find(block)]
                for c, at in met:
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + int(block.size[c]), -1)
                if met:
                    _join(block, np.repeat([c for c, _ in met], [len(at) for _, at in met]), np.concatenate([at for _, at in met]), array.doc_of, first, found)
            hit = np.cumsum(cover[:-1])[array.place] > 0
            hits = np.bincount(doc[hit], minlength=j - i)
        for r in range(j - i):
            yield int(n_words[r]), int(hits[r]), found[r].matches, found[r].groups


def _join(block: Block, cls: np.ndarray, at: np.ndarray, doc_of: np.ndarray, first: np.ndarray, found: list[_Found]):
    """The classes of a block that begin at these places, as matches of their documents."""
    full = block.size[cls] == block.width
    for c, p in zip(cls[~full].tolist(), at[~full].tolist(), strict=True):
        d = doc_of[p]
        found[d].add(block, c, int(p - first[d]), int(block.size[c]), block.members(c))
    order = np.argsort(at[full], kind="stable")
    cls, at = cls[full][order], at[full][order]
    if not len(at):
        return
    heads = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (block.follows[cls[:-1]] != cls[1:])])
    size, doc = np.diff(np.append(heads, len(at))), doc_of[at[heads]]
    edges = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        found[doc[a]].runs(block, at[heads[a:b]] - first[doc[a]], size[a:b], cls[heads[a:b]])


def benchmark_blocks(benchmark: DataFrame, most_bytes: int) -> Iterator[tuple[list, list]]:
    """The items in blocks of at most so many bytes (an item of more stands alone), one block on the driver at a time."""
    ids, texts, size = [], [], 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        n = len(text or "")
        if ids and size + n > most_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(item)
        texts.append(text)
        size += n
    if ids:
        yield ids, texts


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 1 << 20, shard_bytes: int = 2 << 20, pass_blocks: int = 64) -> DataFrame:
    """docs with n_words, n_hit, matches (doc_pos, length in words, group) and groups (of item_id, item_pos).

    A match is the longest verbatim one of all items of its group, which stand at item_pos in them; a group stands once
    in a document, however many matches name it. Words are as in common.ALNUM with A-Z lower-cased. A null text has no
    words and no match; an item without words matches nothing; an item of fewer words than width matches as a whole;
    equal rows get equal results; an empty benchmark marks nothing; no rows give no rows. Input columns named like an
    added one are replaced. The benchmark is broadcast as hashes in blocks (of block_bytes of text at most, unless one
    item alone is longer); a pass looks up pass_blocks of them and is written before the next one, whose blocks take the
    place of the last, so a task holds hashes of 64 MB of benchmark at most.
    """
    added = ["n_words", "n_hit", "matches", "groups"]
    out = docs.drop(*added).select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast(MATCH).alias("matches"), F.array().cast(GROUP).alias("groups"))
    spark, held, again = docs.sparkSession, [], False
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    for ids, texts in benchmark_blocks(benchmark, block_bytes):
        if len(held) == pass_blocks:
            out = materialize(out.mapInArrow(_pass(held, shard_bytes, again), schema))
            for block in held:
                block.unpersist()
            held, again = [], True
        held.append(spark.sparkContext.broadcast(Block(ids, texts, width)))
    return out.mapInArrow(_pass(held, shard_bytes, again), schema)


def _pass(blocks: list, shard_bytes: int, again: bool):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = list(_scan(batch.column("text"), blocks, shard_bytes))
            hits, matches, groups = ([g[k] for g in got] for k in (1, 2, 3))
            if again:  # earlier blocks found some: their words count once
                was, named = batch.column("matches").to_pylist(), batch.column("groups").to_pylist()
                matches = [a + [m | {"group": m["group"] + len(g)} for m in b] for a, g, b in zip(was, named, matches, strict=True)]
                groups, hits = [a + b for a, b in zip(named, groups, strict=True)], [_covered(ms) for ms in matches]
            new = {"n_words": [n for n, *_ in got], "n_hit": hits, "matches": matches, "groups": groups}
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name) for f in batch.schema], schema=batch.schema)

    return run


def _covered(matches: list[dict]) -> int:
    """Words under any match."""
    total, end = 0, 0
    for start, stop in sorted((m["doc_pos"], m["doc_pos"] + m["length"]) for m in matches):
        total += max(0, stop - max(start, end))
        end = max(end, stop)
    return total


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of docs without any word in a benchmark window, with their own columns."""
    return scan_benchmark(docs, benchmark, width).filter("n_hit = 0").select(*docs.columns)

