"""The prefix trie of rebuilt conversations, as preorder intervals.

A turn is 16 bytes of a digest of its role and text, a node the xor of its turns' hashes by depth (128 bits), which a
distributed scan of each conversation gives. Distinct nodes come from one aggregation. Their lexicographic ranks come from
sort keys: the digests at those depths of the path where its parent branches, then the depth, which orders nodes as whole
paths would, but stays short for long conversations. Every node gives a mark at its key and one behind all keys that begin
with it; one scan over the marks numbers the nodes in preorder, and what lies between the two marks of a node (nodes,
leaves, saved tokens) is the difference of two prefix sums.
"""

from __future__ import annotations

import hashlib

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.scans import scan

#: Characters of ids that travel together to a node's digest.
CHUNK = 1 << 16
NODE = ["p1", "p2", "depth"]
#: Sorts behind every digest of 16 bytes and what may follow it.
_BEHIND = b"\xff" * 17


def _turns(conversations: DataFrame) -> DataFrame:
    """(c, turn, t, words, u): a turn's digest and words; u tells repeated rows apart."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("c"), "turn", F.unhex(F.substring(digest, 1, 32)).alias("t"), words.alias("words"))
    return materialize(rows.withColumn("u", F.monotonically_increasing_id()))


def rebuild(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (c, depth, t, words, n_turns) and conversations (c, n_turns), from (c, turn, t, words, u).

    Conversation c gets the first h turns of c - c % group, then its own after its first h; h is crc32 of c modulo most.
    Turns are ordered by turn (null first), equal ones by their digest.
    """
    placed = scan(turns, "c", [F.col("turn").asc_nulls_first(), "t", "u"]).select("c", F.col("run_n").alias("i"), "t", "words")
    head = (F.crc32(F.col("c").cast("string").cast("binary")) % most).cast("long")
    sizes = placed.groupBy("c").agg(F.max("i").alias("own")).withColumns({"base": F.col("c") - F.col("c") % group, "h": head})
    got = F.least(F.col("h"), F.coalesce("base_own", F.lit(0)))
    convs = sizes.join(sizes.select(F.col("c").alias("base"), F.col("own").alias("base_own")), "base", "left")
    convs = materialize(convs.select("c", "base", "h", got.alias("got"), (got + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns")))
    first = placed.filter(F.col("i") < most).select(F.col("c").alias("base"), "i", "t", "words")  # at most - 1 rows a conversation
    taken = convs.join(first, "base").filter("i <= h").select("c", F.col("i").alias("depth"), "t", "words", "n_turns")
    kept = placed.join(convs, "c").filter("i > h").select("c", (F.col("i") - F.col("h") + F.col("got")).alias("depth"), "t", "words", "n_turns")
    return taken.unionByName(kept), convs.select("c", "n_turns")


def _paths(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Rebuilt turns with their node (p1, p2, depth), and a row at the root for each conversation."""
    lanes = {f"x{k}": F.xxhash64(F.lit(k), "t", "depth") for k in (1, 2)}
    run = scan(materialize(rows.withColumns(lanes)), "c", ["depth"], xor=("x1", "x2"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("binary")
    root = convs.select("c", zero.alias("depth"), none.alias("t"), zero.alias("words"), "n_turns", zero.alias("x1"), zero.alias("x2"), zero.alias("p1"), zero.alias("p2"))
    return run.select("c", "depth", "t", "words", "n_turns", "x1", "x2", F.col("run_x1").alias("p1"), F.col("run_x2").alias("p2")).unionByName(root)


def _nodes(paths: DataFrame) -> DataFrame:
    """One row a node: members, children, its parent's smallest member and whether the parent branches."""
    q = [F.max(f"p{k}").bitwiseXOR(F.max(f"x{k}")).alias(f"q{k}") for k in (1, 2)]
    nodes = materialize(paths.groupBy(*NODE).agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), *q))
    below = nodes.filter("depth > 0").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(below, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    above = nodes.filter("n_children > 0").select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") > 1).alias("choice"))
    top = nodes.filter("depth = 0").withColumns({"parent_conv_id": F.lit(None).cast("long"), "choice": F.lit(False)})
    return materialize(nodes.filter("depth > 0").join(above, ["q1", "q2", "depth"]).unionByName(top).drop("q1", "q2"))


def _keys(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with their sort key, found on the path of their smallest member."""
    owners = nodes.select(F.col("conv_id").alias("c")).distinct()
    of = nodes.select(*NODE, "conv_id", "choice", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    steps = paths.join(owners, "c", "leftsemi").join(of, NODE).filter("choice or conv_id = c")
    steps = materialize(steps.select("c", *NODE, (F.col("conv_id") == F.col("c")).alias("owned"), F.when(F.col("choice"), F.col("t")).alias("piece"), "leaf", "saved"))
    return scan(steps, "c", ["depth"], concat=("piece",)).filter("owned").select(*NODE, F.col("run_piece").alias("key"), "leaf", "saved")


def _intervals(keyed: DataFrame) -> DataFrame:
    """(p1, p2, depth, position, subtree_end, n_leaves, saved_tokens): places in preorder, and the sums of the subtree."""
    mark = lambda key, node, leaf, saved: F.struct(key.alias("key"), F.lit(node).cast("long").alias("node"), leaf.cast("long").alias("leaf"), saved.cast("long").alias("saved"))
    both = F.array(mark(F.col("key"), 1, F.col("leaf"), F.col("saved")), mark(F.concat("key", F.lit(_BEHIND)), 0, F.lit(0), F.lit(0)))
    marks = materialize(keyed.select(*NODE, F.explode(both).alias("m")).select(*NODE, "m.*", F.lit(0).cast("long").alias("all")))
    run = scan(marks, "all", ["key", "depth"], add=("node", "leaf", "saved"))
    opens = F.col("node") == 1
    between = lambda c: F.sum(F.when(opens, F.col(c) - F.col(f"run_{c}")).otherwise(F.col(f"run_{c}")))
    place = lambda at: F.max(F.when(at, F.col("run_node")))
    return run.groupBy(*NODE).agg((place(opens) - 1).alias("position"), place(~opens).alias("subtree_end"), between("leaf").alias("n_leaves"), between("saved").alias("saved_tokens"))


def _chunks(batches):
    """Sorted ids of each node, joined by commas, in chunks of bounded length."""
    import pyarrow as pa

    block, node, ids, size, seq, out = TaskContext.get().partitionId(), None, [], 0, 0, []

    def flush():
        nonlocal ids, size, seq
        if ids:
            out.append((*node, block, seq, ",".join(ids)))
            ids, size, seq = [], 0, seq + 1

    def batch():
        rows, out[:] = list(zip(*out, strict=True)), []
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names=[*NODE, "block", "seq", "ids"])

    for b in batches:
        for *at, c in zip(*(b.column(x).to_pylist() for x in (*NODE, "c")), strict=True):
            if at != node:
                flush()
                node = at
            ids.append(str(c))
            size += len(ids[-1]) + 1
            if size >= CHUNK:
                flush()
        if len(out) >= 64:
            yield batch()
    flush()
    if out:
        yield batch()


def _digests(batches):
    """One digest for the chunks of a node, which come in order and are never held together."""
    import pyarrow as pa

    node, digest, out = None, None, []
    schema = pa.schema([*((c, pa.int64()) for c in NODE), ("ends_sha256", pa.string())])
    rows = lambda: pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
    for b in batches:
        for *at, ids in zip(*(b.column(x).to_pylist() for x in (*NODE, "ids")), strict=True):
            if at == node:
                digest.update(b",")
            else:
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = at, hashlib.sha256()
            digest.update(ids.encode())
        if len(out) >= 4096:
            yield rows()
            out = []
    if node:
        out.append((*node, digest.hexdigest()))
    yield rows()


def _ends(paths: DataFrame) -> DataFrame:
    """(p1, p2, depth, ends_sha256) of the nodes at which a conversation ends: ids are range-sorted, joined in chunks where they lie, and only chunks meet."""
    last = materialize(paths.filter("depth = n_turns").select(*NODE, "c"))
    by = [*NODE, "c"]
    chunks = last.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_chunks, "p1 long, p2 long, depth long, block int, seq long, ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "block", "seq").mapInArrow(_digests, "p1 long, p2 long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations (conv_id, turn, role, text); other columns are not read.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, position
    (place in preorder, from 0) and subtree_end (place behind the last node below). Null roles and texts are empty; a
    null turn comes first; rows of one turn are ordered by a digest of role and text, and repeated rows all count; rows
    without a conv_id belong to no conversation and take no part. A conversation may come out without turns and is then
    a member of the root alone. An empty table has no members, so no nodes. Texts do not leave the task that reads them.
    """
    rows, convs = rebuild(_turns(conversations), group, most)
    paths = materialize(_paths(rows, convs))
    nodes = _nodes(paths)
    empty = hashlib.sha256().hexdigest()
    out = nodes.join(_intervals(_keys(paths, nodes)), NODE).join(_ends(paths), NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"), "position", "subtree_end")
