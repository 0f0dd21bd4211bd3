"""Matches with their places, and texts rewritten by dictionaries that are tables of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once: what functions of arrays name several times Spark works out as often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def between(text: str | Column, pattern: str, groups: int = 0) -> Column:
    """The matches of a pattern as an array of structs: start, stop, match, g1, ..., and slice (what stands between it and the next).

    Matches must not be empty. A null text gives null. Places are counted from 0, in characters.
    """
    c = F.col(text) if isinstance(text, str) else text

    def of_pieces(c, pieces):
        found = [F.regexp_extract_all(c, F.lit(pattern), F.lit(g)) for g in range(groups + 1)]
        return F.arrays_zip(*(f.alias(f"g{i}") for i, f in enumerate(found)), F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("slice"))

    def placed(pieces, rows):
        # a running place: after each match and its slice
        first = F.length(pieces[0])
        places = F.aggregate(
            F.transform(rows, lambda r: F.length(r["g0"]) + F.length(r["slice"])), F.struct(F.array(first).alias("at"), first.alias("end")), lambda s, n: F.struct(F.array_append(s["at"], s["end"] + n).alias("at"), (s["end"] + n).alias("end")), lambda s: s["at"]
        )
        return F.zip_with(rows, F.slice(places, 1, F.size(rows)), lambda r, at: F.struct(at.alias("start"), (at + F.length(r["g0"])).alias("stop"), r["g0"].alias("match"), *(r[f"g{i}"].alias(f"g{i}") for i in range(1, groups + 1)), r["slice"].alias("slice")))

    return let(c, lambda c: let(F.split(c, pattern, -1), lambda pieces: let(of_pieces(c, pieces), lambda rows: placed(pieces, rows))))


def section(text: str | Column, name: str) -> Column:
    """What stands below the first heading (== name ==, any level) of that name up to the next heading; null without one."""
    found = between(text, r"(?m)^={2,}[ \t]*([^=\n]+?)[ \t]*={2,}[ \t]*$", 1)
    return F.try_element_at(F.filter(found, lambda h: h["g1"] == name), F.lit(1))["slice"]


def first_of(layers: list[DataFrame], key: list[str]) -> DataFrame:
    """One name for each key of several tables (key, name): that of the first table that has it; empty names do not count."""
    every = layers[0].select(*key, "name", F.lit(0).alias("layer"))
    for i, layer in enumerate(layers[1:], 1):
        every = every.unionByName(layer.select(*key, "name", F.lit(i).alias("layer")))
    return every.filter(F.trim("name") != "").groupBy(*key).agg(F.min(F.struct("layer", "name")).alias("n")).select(*key, F.col("n.name").alias("name"))


def replace_matches(rows: DataFrame, key: str, text: str, pattern: str, layers: list[DataFrame], fallback, own: DataFrame | None = None) -> DataFrame:
    """(key, text): every match of pattern becomes the name of its code (group 1, trimmed); fallback(match, code) says what one without becomes.

    own (key, code, name) holds names for one row alone and goes before the layers (code, name). key must be unique.
    """
    found = rows.select(key, F.posexplode(between(text, pattern, 1)).alias("i", "m")).select(key, "i", "m.match", "m.slice", F.trim("m.g1").alias("code"))
    named = found.join(first_of(layers, ["code"]), "code", "left")
    if own is not None:
        named = named.join(own.select(key, "code", F.col("name").alias("own_name")), [key, "code"], "left").withColumn("name", F.coalesce(F.nullif("own_name", F.lit("")), "name"))
    shown = F.coalesce("name", fallback(F.col("match"), F.col("code")))
    parts = named.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", shown.alias("name"), "slice"))).alias("parts"))
    rest = F.array_join(F.transform("parts", lambda p: F.concat(p["name"], p["slice"])), "")
    return rows.join(parts, key, "left").select(key, F.when(F.col("parts").isNull(), F.col(text)).otherwise(F.concat(F.split(text, pattern, -1)[0], rest)).alias(text))


#: Texts whose hits are Python objects at once.
_TEXTS = 64


def _put(key: str, text: str):
    """(key, text) of rows (key, text, hits): the sorted hits (start, -length, name) put in, from the left; one that begins inside an earlier one goes.

    Hits stay in Arrow's columns; those of a few texts at a time become Python objects.
    """

    def one(text, hits):
        at, out = 0, []
        for start, less, name in hits:
            if start >= at:
                out += [text[at:start], name]
                at = start - less
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(a, _TEXTS)
                flat, counts = part.column("hits").flatten(), pc.fill_null(pc.list_value_length(part.column("hits")), 0).to_pylist()
                hits = zip(*(c.to_pylist() for c in flat.flatten()), strict=True)
                texts = [t if t is None else one(t, islice(hits, n)) for t, n in zip(part.column(text).to_pylist(), counts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(texts, pa.string())], [key, text])

    return run


def replace_keys(rows: DataFrame, key: str, text: str, layers: list[DataFrame], letters: str = "A-Za-z") -> DataFrame:
    """(key, text): every code of the layers (code, name) that stands in the text between borders becomes its name.

    A border is where no letter stands. Of codes that begin at one place the longest counts, of those that overlap the
    left one. The dictionary is joined, not broadcast: codes meet texts by their first word (or sign); a text's hits come
    together only in its own row. key must be unique.
    """
    word = f"[{letters}]+|[^{letters}\\s]"
    names = first_of(layers, ["code"]).filter("code <> ''").withColumn("head", F.regexp_extract("code", word, 0))
    longest = names.agg(F.max(F.length("code"))).first()[0] or 0  # one number
    places = rows.select(key, text, F.explode(between(text, word)).alias("w"))
    ahead = F.substring(text, F.col("w.start") + 1, F.lit(longest + 1))
    places = places.select(key, F.col("w.match").alias("head"), F.col("w.start").alias("start"), F.when(F.col("w.start") > 0, F.substring(text, F.col("w.start"), F.lit(1))).otherwise("").alias("back"), ahead.alias("ahead"))
    letter = f"^[{letters}]"
    fits = F.startswith("ahead", "code") & ~F.col("back").rlike(letter) & ~F.substring("ahead", F.length("code") + 1, F.lit(1)).rlike(letter)
    hits = places.join(names, "head").filter(fits).select(key, "start", (-F.length("code")).alias("less"), "name")
    hits = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "less", "name"))).alias("hits"))
    kept = rows.select(key, text)
    return kept.join(hits, key, "left").mapInArrow(_put(key, text), kept.schema)
