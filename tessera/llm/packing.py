"""Packing of token sequences by multiway differencing.

Documents are cut into whole windows and a rest. Groups of rests go into as few windows as their tokens need: every
rest is a partial partition of one filled and many empty windows; the two partitions with the largest imbalance merge,
the fullest windows of one on the emptiest of the other, until one is left. If a window is then over capacity, there
is one window more. Where that leaves more padding than a hundredth of the windows, rests are cut in smaller pieces; where
that does not help either, at the edges of as many windows as the tokens need.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix

#: The split of texts into words that the byte-level vocabularies were made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 1
FIELDS = "doc_id long, start long, length long, ids binary, doc_tokens long"
#: Parts of a window that rests are cut down to, one after the other, while windows stay emptier than they should.
PARTS = (1, 2, 4, 8)
#: Bytes of ids that a batch of pieces holds before it is handed on.
BATCH_BYTES = 8 << 20


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids of a byte-level BPE file of the tokenizers library, computed by a faster library with the same ids.

    Where that one gives up (its pattern runs out of stack on hundreds of thousands of white spaces in a row), the
    tokenizers library itself encodes the text.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    coder, slow = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        try:
            return coder.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def differencing(sizes: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each item, by the largest differencing method: sums come out near equal."""
    n = len(sizes)
    sums = np.zeros((n, bins), np.int64)
    sums[:, 0] = sizes
    nodes = np.full((n, bins), -1, np.int64)
    nodes[:, 0] = np.arange(n)
    heap = [(-int(s), i, sums[i], nodes[i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merges, count, serial = [], n, n
    while len(heap) > 1:
        _, _, s1, n1 = heapq.heappop(heap)
        _, _, s2, n2 = heapq.heappop(heap)
        s, other = s1 + s2[::-1], n2[::-1]
        node = np.maximum(n1, other)
        both = np.flatnonzero((n1 >= 0) & (other >= 0))
        if len(both):
            made = np.arange(count, count + len(both))
            merges.append((made, n1[both], other[both]))
            node[both] = made
            count += len(both)
        order = np.argsort(-s, kind="stable")
        s = s[order]
        s = s - s[-1]
        heapq.heappush(heap, (-int(s[0]), serial, s, node[order]))
        serial += 1
    label = np.full(count, -1, np.int64)
    final = heap[0][3]
    label[final[final >= 0]] = np.flatnonzero(final >= 0)
    for made, left, right in reversed(merges):
        label[left] = label[right] = label[made]
    return label[:n]


def into_windows(sizes: np.ndarray, capacity: int, most: int | None = None) -> tuple[np.ndarray, int] | None:
    """The window of each piece and how many there are; none is over capacity. None if that takes more than most."""
    bins = max(1, -(-int(sizes.sum()) // capacity))
    while most is None or bins <= most:
        at = differencing(sizes, bins)
        if np.bincount(at, sizes, bins).max() <= capacity:
            return at, bins
        bins += 1
    return None


def cut_sizes(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of at most so many ids of items of these sizes: the item of each and where it starts there."""
    many = -(-sizes // most)
    item = np.repeat(np.arange(len(sizes)), many)
    return item, (np.arange(len(item)) - (np.cumsum(many) - many)[item]) * most


def fill(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, start and window of each piece. Items stay whole unless that takes over a hundredth more windows than needed."""
    need = -(-int(sizes.sum()) // capacity)
    for parts in PARTS:
        item, start = cut_sizes(sizes, max(1, capacity // parts))
        length = np.minimum(sizes[item] - start, max(1, capacity // parts))
        if found := into_windows(length, capacity, need + max(1, need // 100)):
            return item, start, found[0]
    return cut_at_edges(sizes, capacity, need)


def cut_at_edges(sizes: np.ndarray, capacity: int, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, start and window of each piece: near-equal windows of whole items, and what is over their edges in those with room."""
    at = differencing(sizes, bins)
    room = capacity - np.bincount(at, sizes, bins)
    pieces = [(i, 0, int(n), int(w)) for i, (n, w) in enumerate(zip(sizes, at, strict=True))]
    over = {int(w): int(-room[w]) for w in np.flatnonzero(room < 0)}
    loose = []
    for k in range(len(pieces) - 1, -1, -1):  # the ends of the last items of a window that is too full
        i, start, n, w = pieces[k]
        if gone := min(over.get(w, 0), n):
            over[w] -= gone
            pieces[k] = (i, start, n - gone, w)
            loose.append((i, start + n - gone, gone))
    free = [(int(w), int(room[w])) for w in np.flatnonzero(room > 0)]
    for i, start, n in loose:
        while n:
            w, left = free[-1]
            took = min(n, left)
            pieces.append((i, start, took, w))
            start, n = start + took, n - took
            free.pop()
            if left > took:
                free.append((w, left - took))
    item, start, length, at = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
    order = np.lexsort((start, item))
    order = order[length[order] > 0]
    return item[order], start[order], at[order]


def _rests(path: str, capacity: int, groups: int):
    """Whole windows and rests of each document, with a group that their content and its occurrence in the task decide."""

    def run(batches):
        import pyarrow as pa

        kinds = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(), "doc_tokens": pa.int64(), "group": pa.int64()}

        def made(out):
            cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], list(kinds))

        encode, seen = encoder(path), Counter()
        for batch in batches:
            out, size = [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), END).astype("<u4")
                cuts = [*range(0, len(ids), capacity), len(ids)]
                # rows that are alike are told apart by their number, whatever order they come in
                alike = hash((doc, zlib.crc32(ids)))
                group = int(mix(np.array([(alike + seen[alike] * 0x9E3779B1) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0] % np.uint64(groups))
                seen[alike] += 1
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    out.append((doc, a, b - a, ids[a:b].tobytes(), len(ids), group))
                    size += 4 * (b - a)
                    if size >= BATCH_BYTES:
                        yield made(out)
                        out, size = [], 0
            yield made(out)

    return run


def _packed(capacity: int, most: int):
    """Rows in order of their group: whole windows pass, rests are held until the group ends or so many are held."""
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def flush(rests, first):
        import pyarrow as pa

        doc, start, ids, tokens = ([x for b in rests for x in b.column(c).to_pylist()] for c in ("doc_id", "start", "ids", "doc_tokens"))
        sizes = np.concatenate([b.column("length").to_numpy() for b in rests])
        item, cut, at = fill(sizes, capacity)
        ends = np.append(cut[1:], 0)
        ends[np.append(item[1:] != item[:-1], True)] = sizes
        order = np.argsort(at, kind="stable")
        length = (ends - cut)[order]
        before = np.cumsum(length) - length
        head = np.ones(len(order), bool)
        head[1:] = at[order][1:] != at[order][:-1]
        offset = np.zeros(len(order), np.int64)
        offset[order] = before - before[head][np.cumsum(head) - 1]
        for a in range(0, len(item), 512):
            part = [(doc[i], start[i] + s, e - s, ids[i][4 * s : 4 * e], tokens[i], first + w, o) for i, s, e, w, o in zip(*(x[a : a + 512].tolist() for x in (item, cut, ends, at, offset)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*part, strict=True), strict=True)], names)
        return int(at.max()) + 1

    def run(batches):
        import pyarrow as pa

        held, rows, last, used = [], 0, None, 0
        for batch in batches:
            group = batch.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if last is not None and (group[a] != last or rows >= most):
                    if held:
                        used += yield from flush(held, (int(last) << 32) + used)
                    held, rows = [], 0
                    if group[a] != last:
                        used = 0
                last = group[a]
                part = batch.slice(a, b - a)
                full = pa.array(part.column("length").to_numpy() == capacity)
                whole, rest = part.filter(full), part.filter(pc.invert(full))
                if whole.num_rows:
                    number = (int(last) << 32) + used + np.arange(whole.num_rows)
                    used += whole.num_rows
                    yield pa.RecordBatch.from_arrays([*(whole.column(c) for c in names[:5]), pa.array(number), pa.array(np.zeros(whole.num_rows, np.int64))], names)
                if rest.num_rows:
                    held.append(rest)
                    rows += rest.num_rows
        if held:
            yield from flush(held, (int(last) << 32) + used)

    return run


def pack(docs: DataFrame, path: str, capacity: int = 2048, group_docs: int = 512) -> DataFrame:
    """doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset of every piece of docs.

    ids are the piece's token ids as little-endian 32-bit numbers, ids_crc32 is their checksum; the pieces of a sequence
    in the order of their offsets, which count ids, are the whole sequence.
    A null or empty text is its end id alone. Rows that are alike are packed each for itself; a null doc_id stays null.
    An empty table gives no rows; other columns are ignored. Whole windows stand alone; rests are packed in groups of
    about group_docs documents, which the hash of their content gives, and are cut only where windows stay too empty.
    ids are shuffled once, texts never, and a task holds four times group_docs rests at most.
    """
    groups = max(1, -(-docs.count() // group_docs))
    rests = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rests(path, capacity, groups), f"{FIELDS}, group long")
    packed = rests.repartition("group").sortWithinPartitions("group").mapInArrow(_packed(capacity, 4 * group_docs), f"{FIELDS}, sequence_id long, offset long")
    return packed.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
