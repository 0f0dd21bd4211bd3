"""Queries that need Arrow-batched functions: chunks, sections, fuzzy names, blocked phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.catalog import query


@query()
def recursive_text_split(read):
    from tessera.functions import udfs

    c = read("documents").select("doc_id", F.posexplode(udfs.chunks()(F.col("text"))).alias("position", "chunk"))
    return c.select("doc_id", "position", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@query()
def forward_sections(read):
    from tessera.functions import udfs

    c = read("documents").select("doc_id", F.posexplode(udfs.sections()(F.col("text"))).alias("position", "section"))
    return c.select("doc_id", "position", F.length("section").alias("n_chars"))


@query()
def name_sequence_ratio(read, text: str = "red wigdet"):
    from tessera.functions import udfs

    n = read("part").select(F.col("p_name").alias("name")).distinct()
    return n.select("name", udfs.sequence_ratio(F.col("name"), F.lit(text)).alias("ratio")).orderBy(F.desc("ratio"), "name").limit(5)


@query("SELECT doc_id, EXISTS (SELECT 1 FROM benchmark b WHERE length(b.text) > 0 AND position(b.text IN documents.text) > 0) AS blocked FROM documents")
def blocked_phrase_filter(read):
    from tessera.functions import udfs

    return udfs.with_phrases(read("documents").select("doc_id", "text"), "text", read("benchmark"), "text").select("doc_id", "blocked")


#: Patterns as in a word list: one does not compile. A parameter.
PATTERNS = ("th(at|e) (of|and)", "[unclosed", r"\bLES\b")


@query(r"SELECT conv_id, turn, regexp_matches(lower(text), 'th(at|e) (of|and)|(^|[^\p{L}\d_])les([^\p{L}\d_]|$)') AS blocked FROM conversations")
def blocked_pattern_filter(read, patterns=PATTERNS):
    from tessera.functions import udfs

    return udfs.with_patterns(read("conversations").select("conv_id", "turn", "text"), "text", list(patterns)).select("conv_id", "turn", "blocked")
