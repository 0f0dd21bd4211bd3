"""Toxicity by a classifier chain of linear models.

Categories, the columns of the labels, are predicted one after the other, toxic itself last. Each model sees the words
of the text and the probabilities that the models before it give; in training those are out-of-fold, so later models see
earlier ones as they err on new texts. Which words matter is learned from the labels alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ALNUM, LOWER, materialize, mix, runs, text_bytes, word_hashes, words

#: Words themselves, and their first so many bytes, are features.
PREFIXES = (4, 5, 6, 7, 8)
FOLDS = 5


@dataclass
class Chain:
    """names: categories in order; features: sorted hashes; weights: for each category those of the features, of the earlier probabilities and the bias."""

    names: list[str]
    features: np.ndarray
    weights: list[np.ndarray]
    threshold: float

    def scores(self, row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
        """Probabilities (n, categories) of n texts that have the features (row, col)."""
        out = np.zeros((n, 0))
        for w in self.weights:
            out = np.column_stack([out, _apply(w, row, col, out, len(self.features))])
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _apply(w: np.ndarray, row: np.ndarray, col: np.ndarray, earlier: np.ndarray, d: int) -> np.ndarray:
    return _sigmoid(np.bincount(row, w[col], len(earlier)) + earlier @ w[d:-1] + w[-1])


def _fit(row: np.ndarray, col: np.ndarray, earlier: np.ndarray, y: np.ndarray, d: int, l2: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Logistic regression with ridge penalty by Adam on the whole sample."""
    w = np.zeros(d + earlier.shape[1] + 1)
    w[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        e = (_apply(w, row, col, earlier, d) - y) / max(1, len(y))
        g = np.concatenate([np.bincount(col, e[row], d), earlier.T @ e, [e.sum()]]) + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def text_features(column, most_bytes: int = 2 << 20):
    """For runs of rows: (first row, rows, row, feature hash), each feature of a text once."""
    data, offsets = text_bytes(column)
    for i, j in runs(offsets, most_bytes):
        part, bounds = LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        s, e, row = words(part, bounds, ALNUM)
        if not len(s):
            yield i, j - i, np.zeros(0, np.int64), np.zeros(0, np.uint64)
            continue
        kinds = [word_hashes(part, s, e), *(mix(word_hashes(part, s, np.minimum(e, s + p)) ^ np.uint64(p)) for p in PREFIXES)]
        yield i, j - i, np.tile(row, len(kinds)), np.concatenate(kinds)


def _sample_features(batches):
    import pyarrow as pa

    for batch in batches:
        lists = []
        for _, n, row, h in text_features(batch.column("text")):
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            row, h = row[new], h[new].view(np.int64)
            lists += np.split(h, np.searchsorted(row, np.arange(1, n)))
        own = [batch.column(c) for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*own, pa.array(lists, pa.list_(pa.int64()))], [*(c for c in batch.schema.names if c != "text"), "features"])


def _numbered(features):
    """Lists of feature hashes as lists of the numbers of those that are among the features."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column("features")
            h, row = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
            at = np.searchsorted(features.value, h)
            hit = np.zeros(len(h), bool)
            inside = at < len(features.value)
            hit[inside] = features.value[at[inside]] == h[inside]
            ends = np.append(0, np.cumsum(np.bincount(row[hit], minlength=len(column))))
            numbers = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[hit], pa.int32()))
            yield pa.RecordBatch.from_arrays([numbers if c == "features" else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return run


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 8000, most_features: int = 4096, target: str = "toxic") -> Chain:
    """Fits the chain on at most most_labelled labelled rows, those with the least hash of their id.

    Its categories are the columns of labels besides doc_id, in their order, and target last: 0 or 1 each (a null in
    another category than target counts as 0, of several rows of a doc_id the largest counts; of its texts the one with the
    least hash). Only the numbers of the
    selected features, most_features at most, reach the driver; a feature is in three texts at least. Labels without a
    text or with a null target are skipped; without any toxic label nothing is toxic.
    """
    names = [*(c for c in labels.columns if c not in ("doc_id", target)), target]
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("int").alias(f"l{i}") for i, c in enumerate(names)))
    chosen = chosen.dropna(subset=["doc_id", f"l{len(names) - 1}"]).groupBy("doc_id").agg(*(F.max(F.coalesce(f"l{i}", F.lit(0))).alias(f"l{i}") for i in range(len(names))))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    columns = [f"l{i}" for i in range(len(names))]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").dropna()
    texts = texts.groupBy("doc_id", *columns).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", *columns, "t.text")
    last = columns[-1]
    fields = f"doc_id long, {', '.join(f'{k} int' for k in columns)}, features array"
    sample = materialize(texts.select("doc_id", *columns, "text").mapInArrow(_sample_features, f"{fields}<long>"))
    n, p = sample.agg(F.count("*"), F.coalesce(F.avg(last), F.lit(0.0))).first()
    # signed root of the chi-square statistic of a feature and the last category
    counted = sample.select(last, F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("many"), F.sum(last).alias("bad")).filter("many >= 3")
    z = F.abs(F.col("bad") - F.col("many") * p) / F.sqrt(F.col("many") * max(p * (1 - p), 1e-9) + 1e-9)
    best = counted.orderBy(z.desc(), "feature").limit(most_features).select("feature").toArrow()
    features = np.sort(best["feature"].to_numpy().view(np.uint64))
    chosen_features = docs.sparkSession.sparkContext.broadcast(features)
    rows = sample.mapInArrow(_numbered(chosen_features), f"{fields}<int>").toArrow().sort_by("doc_id").combine_chunks()
    y = np.array([rows[k].to_numpy() for k in columns], float).reshape(len(names), -1)
    lists = rows["features"].combine_chunks()
    row, col = np.repeat(np.arange(n), lists.value_lengths().to_numpy()), lists.flatten().to_numpy().astype(np.int64)
    toxic = y[-1] > 0
    d, fold = len(features), (mix(np.arange(n, dtype=np.uint64)) % np.uint64(FOLDS)).astype(int)
    weights, earlier = [], np.zeros((n, 0))
    for target in y:
        weights.append(_fit(row, col, earlier, target, d) if n else np.array([*np.zeros(d + len(weights)), -30.0]))
        held = np.zeros(n)
        for f in range(FOLDS):
            inside = fold != f
            seen = inside[row]
            renumber = np.cumsum(inside) - 1
            w = _fit(renumber[row[seen]], col[seen], earlier[inside], target[inside], d) if inside.any() else weights[-1]
            held[~inside] = _apply(w, row, col, earlier, d)[~inside]
        earlier = np.column_stack([earlier, held])
    return Chain(names, features, weights, _threshold(earlier[:, -1], toxic))


def _threshold(score: np.ndarray, truth: np.ndarray) -> float:
    """The midpoint of the best F1 on out-of-fold scores; 0.5 without examples of both kinds."""
    if not truth.any() or truth.all():
        return 0.5
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(truth[order])
    f1 = 2 * hit / (np.arange(1, len(hit) + 1) + truth.sum())
    k = int(f1.argmax())
    low = score[order[k + 1]] if k + 1 < len(order) else 0.0
    return float(np.clip((score[order[k]] + low) / 2, 0.05, 0.95))


def _score(model):
    def run(batches):
        import pyarrow as pa

        chain: Chain = model.value
        d = len(chain.features)
        for batch in batches:
            out = []
            for _, n, row, h in text_features(batch.column("text")):
                at = np.minimum(np.searchsorted(chain.features, h), max(0, d - 1))
                hit = chain.features[at] == h if d else np.zeros(len(h), bool)
                pair = np.unique(row[hit] * (d + 1) + at[hit])
                worded = np.bincount(row, minlength=n) > 0
                out.append(chain.scores(pair // (d + 1), pair % (d + 1), n) * worded[:, None])
            p = np.concatenate(out) if out else np.zeros((0, len(chain.names)))
            new = {f"p_{k}": pa.array(p[:, i]) for i, k in enumerate(chain.names)} | {"toxic": pa.array(p[:, -1] >= chain.threshold)}
            own = [c for c in batch.schema.names if c not in new]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *new.values()], [*own, *new])

    return run


def judge(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs with the probability p_<category> of each category and toxic (boolean).

    Whole texts are read; a null, empty or wordless one gets 0 everywhere. Equal rows get equal
    results; no rows give no rows. Input columns named like an added one are replaced. One narrow pass; the model that
    is broadcast has most_features features at most.
    """
    from pyspark.sql import types as T

    added = [*(f"p_{k}" for k in chain.names), "toxic"]
    own = [f for f in docs.schema if f.name not in added]
    schema = T.StructType([*own, *(T.StructField(k, T.DoubleType()) for k in added[:-1]), T.StructField("toxic", T.BooleanType())])
    return docs.drop(*added).mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(chain)), schema)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the chain, trained on labels of its rows, does not reject, with their own columns.

    Null, empty and wordless texts stay, repeated rows fare alike; no rows give no rows.
    """
    chain = train(docs, labels)
    clash = {c: f"_own_{c}" for c in docs.columns if c == "toxic" or c in {f"p_{k}" for k in chain.names}}
    kept = judge(docs.withColumnsRenamed(clash), chain).filter(~F.col("toxic"))
    return kept.select(*(F.col(clash.get(c, c)).alias(c) for c in docs.columns))
