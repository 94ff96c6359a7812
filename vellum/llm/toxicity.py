"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, its UTF-8 bytes get a blank at both ends, and every run of 3, 4 and 5 bytes is
hashed to one of 2^18 features, counted as present or absent. Over all labelled training rows Spark
counts the documents of each class that hold a feature; the log ratio of the two (smoothed) shares is
the feature's scale. The ``n_features`` features that part the classes best (by the likelihood gain of
their counts) form the model; logistic weights on the scaled features are fitted by gradient steps on a
sample, taken by a hash of the id from each class alone, at most about half of ``sample_limit`` rows of
it, so that a rare class is in it as far as it can be; weights give the classes their true shares
again. Every whole text is then scored in one pass over the documents.

Labels are learnt only from rows whose crc32 of the id (as text) is not divisible by 5; label, language,
source and id are no inputs of a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.shared import free_names, materialise, prepare, slices

BITS = 18
GRAMS = (3, 4, 5)
FIELD = "__toxic_score"
PLACES = 1 << 20  # features of texts that a gradient step works on at a time


def features(text: str | None) -> np.ndarray:
    """Feature of every n-gram of a text (repeats included)."""
    raw = np.frombuffer(b" " + (text or "").lower().encode() + b" ", np.uint8).astype(np.uint32)
    out = []
    code = np.zeros(len(raw), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(raw) < n:
            break
        code = code[:len(raw) - n + 1] * np.uint32(0x01000193) ^ raw[n - 1:]
        if n in GRAMS:
            mixed = (code ^ (code >> np.uint32(15)) ^ np.uint32(n)) * np.uint32(0x9E3779B1)
            out.append(mixed >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


class Model:
    """Chosen features (sorted), their weights and the intercept."""

    def __init__(self, chosen, weights, bias: float):
        self.chosen, self.weights, self.bias = np.asarray(chosen, np.int64), np.asarray(weights, float), float(bias)
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[self.chosen] = np.arange(len(self.chosen))

    def present(self, text: str | None) -> np.ndarray:
        """Places in ``chosen`` of the features a text holds."""
        at = self.place[features(text)]
        return np.unique(at[at >= 0])

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[self.present(text)].sum())
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text, toxic)`` of the labelled rows to learn from. Null labels are no labels; an id
    with several labels counts as toxic if one says so."""
    known = (labels.where("doc_id is not null and toxic is not null")
             .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
             .groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Labels grow with the corpus, so they are not broadcast at any size.
    return rows.join(known.hint("merge"), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          sample_limit: int = 10_000, n_features: int = 1 << 13, steps: int = 150, penalty: float = 1e-3) -> Model:
    """Fit the classifier. Without labelled rows of both classes the model is the (smoothed) share of
    toxic rows alone."""
    prepare(docs.sparkSession)
    rows = training_rows(docs, labels, id_col, text_col)
    is_toxic = (F.col("toxic") != 0).cast("int")
    per_class = dict(map(tuple, rows.groupBy(is_toxic).count().collect()))  # two rows
    below = [int(min(1.0, sample_limit / 2 / per_class.get(c, 1)) * (1 << 40)) for c in (0, 1)]
    sampled = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.when(is_toxic == 1, F.lit(below[1])).otherwise(F.lit(below[0]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents by feature and class, summed in the task; the sampled texts pass on."""
        held, docs_of = np.zeros((2, 1 << BITS), np.int64), [0, 0]
        names = ["feature", "clean", "toxic", "label", "text"]
        for batch in batches:
            for part in slices(batch, "text"):
                kept: list[tuple[int, str | None]] = []
                for text, label, take in zip(*[c.to_pylist() for c in part.columns]):
                    label = int(label != 0)
                    seen = np.zeros(1 << BITS, bool)
                    seen[features(text)] = True
                    held[label] += seen
                    docs_of[label] += 1
                    if take:
                        kept.append((label, text or ""))
                if kept:
                    none = pa.nulls(len(kept), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [none, none, none, pa.array([k for k, _ in kept], pa.int32()), pa.array([t for _, t in kept])], names)
        on = np.flatnonzero(held.any(axis=0))
        ids = np.append(on, -1)  # feature -1: the documents themselves
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(np.append(held[0][on], docs_of[0])),
             pa.array(np.append(held[1][on], docs_of[1])), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.string())],
            names)

    seen = materialise(rows.select("text", "toxic", sampled.alias("take")).mapInArrow(
        count, "feature long, clean long, toxic long, label int, text string"), "toxicity-counts")
    counts = seen.where("feature is not null").groupBy("feature").agg(F.sum("clean").alias("n0"), F.sum("toxic").alias("n1"))
    counts = materialise(counts, "toxicity-features")  # 2^18 + 1 rows at most
    total = counts.where("feature = -1").first()
    n0, n1 = (total.n0, total.n1) if total else (0, 0)
    if not n0 or not n1:
        return Model([], [], math.log((n1 + 1) / (n0 + 1)))
    ratio = F.log((F.col("n1") + 1) / F.lit(n1 + 2.0)) - F.log((F.col("n0") + 1) / F.lit(n0 + 2.0))

    def gain(k, n):  # k of n documents hold the feature
        p = k / F.lit(float(n))
        return F.when((k > 0) & (k < n), k * F.log(p) + (n - k) * F.log(1 - p)).otherwise(0.0)

    part = gain(F.col("n1"), n1) + gain(F.col("n0"), n0) - gain(F.col("n0") + F.col("n1"), n0 + n1)
    best = (counts.where("feature >= 0").select("feature", ratio.alias("ratio"), part.alias("gain"))
            .orderBy(F.desc("gain"), "feature").limit(n_features).toPandas().sort_values("feature"))
    empty = Model(best.feature.to_numpy(), np.zeros(len(best)), 0.0)
    scale = best.ratio.to_numpy()

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [empty.present(t).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.list_(pa.int32()))], ["label", "places"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One task over the bounded sample: full-gradient steps with running moments."""
        y, flat, sizes = [], [], []
        for batch in batches:
            y.append(batch.column(0).to_numpy(zero_copy_only=False))
            column = batch.column(1)
            flat.append(column.flatten().to_numpy(zero_copy_only=False))
            sizes.append(np.diff(column.offsets.to_numpy()))
        if not y:
            return
        y, flat, sizes = np.concatenate(y).astype(float), np.concatenate(flat), np.concatenate(sizes)
        ends = np.cumsum(sizes)
        cuts = [0, *(np.flatnonzero(np.diff(ends // PLACES)) + 1).tolist(), len(y)]
        parts = [(slice(a, b), flat[ends[a] - sizes[a]:ends[b - 1]], np.repeat(np.arange(b - a, dtype=np.int32), sizes[a:b]))
                 for a, b in zip(cuts, cuts[1:])]
        pos = max(1.0, y.sum())
        weight = np.where(y > 0, n1 / pos, n0 / max(1.0, len(y) - pos))
        weight /= weight.sum()
        # the intercept starts at the log odds of the classes
        theta = np.append(np.zeros(len(scale)), math.log(n1 / n0))
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, steps + 1):
            own, g, total = theta[:-1] * scale, np.zeros(len(scale)), 0.0
            for rows, places, row in parts:
                z = np.bincount(row, own[places], rows.stop - rows.start) + theta[-1]
                slope = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[rows]) * weight[rows]
                g += np.bincount(places, slope[row], len(scale))
                total += slope.sum()
            g = np.append(g * scale + penalty * theta[:-1], total)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        yield pa.RecordBatch.from_arrays([pa.array([(theta[:-1] * scale).tolist()]), pa.array([theta[-1]])], ["w", "b"])

    sample = materialise(seen.where("label is not null").select("label", "text").mapInArrow(
        hold, "label int, places array<int>"), "toxicity-sample")
    fitted = sample.coalesce(1).mapInArrow(fit, "w array<double>, b double").first()
    if fitted is None:
        return Model([], [], math.log((n1 + 1) / (n0 + 1)))
    return Model(best.feature.to_numpy(), fitted.w, fitted.b)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", field: str = FIELD) -> DataFrame:
    """``docs`` with all its columns and the score of ``text_col`` as ``field``, in one pass."""
    chosen, weights, bias = model.chosen, model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(chosen, weights, bias)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            scores = pa.array([m.score(t.as_py()) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, field])

    prepare(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(field, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row.

    Null and empty texts get the score of no known feature; a null id is held out (nothing can be learnt
    from it); repeated rows are scored each and learnt from each; no other column is read; an
    empty table gives no rows."""
    model = train(docs, labels, id_col, text_col, **params)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    return with_score(rows, model).select("doc_id", held_out.alias("held_out"), F.col(FIELD).alias("score"),
                                          (F.col(FIELD) >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` that the classifier does not call toxic (score under 0.5), with all their columns,
    of any name. Null and empty texts stay, unless the classes' shares alone say toxic; repeated rows stay or
    go alike; an empty table gives no rows."""
    field, = free_names(docs, FIELD)
    model = train(docs, labels, id_col, text_col, **params)
    return with_score(docs, model, text_col, field).where(F.col(field) < 0.5).drop(field)
