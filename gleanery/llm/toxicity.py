"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

The classifier is fitted on a bounded, hash-chosen sample of labelled training rows. Spark counts in how many of its
documents of each class each hashed n-gram occurs. The n-grams that tell the classes apart best (chi-square) become
features; a feature's value is its log-count ratio where the n-gram occurs, and a logistic regression is fitted to
those. Texts are the only input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, materialize, mix, small_batches


@dataclass(frozen=True)
class NgramOptions:
    """``sizes`` of character n-grams, ``bits`` of the hash space, ``features`` kept, ``least`` documents a feature
    needs, ``sample_rows`` of each class that are fitted on at most, ``smooth``ing, ``ridge`` penalty, ``steps``."""

    sizes: tuple[int, ...] = (3, 4, 5)
    bits: int = 19
    features: int = 4_000
    least: int = 3
    sample_rows: int = 10_000
    smooth: float = 1.0
    ridge: float = 3e-3
    steps: int = 600


@dataclass(frozen=True)
class NgramModel:
    """``weights`` of each hash bucket (zero where it is no feature) and the ``bias``."""

    options: NgramOptions
    weights: np.ndarray
    bias: float


def ngram_buckets(text: str | None, options: NgramOptions) -> np.ndarray:
    """Distinct hash buckets of a text's character n-grams; letters are lower-cased, a space is put at either end."""
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    found = []
    for size in options.sizes:
        n = len(points) - size + 1
        if n <= 0:
            continue
        h = np.full(n, size, U64)
        for j in range(size):
            h = h * U64(0x100000001B3) + points[j : j + n]
        found.append((mix(h) >> U64(64 - options.bits)).astype(np.int64))
    if not found:
        return np.empty(0, np.int64)
    every = np.concatenate(found)
    if len(every) > 1 << (options.bits - 4):
        marks = np.zeros(1 << options.bits, bool)
        marks[every] = True
        return np.flatnonzero(marks)
    return np.unique(every)


def crc32_text(column: Column | str) -> Column:
    """crc32 of a number written in decimal."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"))


def _count(options: NgramOptions):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, 1 << options.bits), np.int64)
        rows_of = [0, 0]
        for rows in batches:
            for text, label in zip(rows["tx_text"], rows["tx_label"], strict=True):
                seen[int(label)][ngram_buckets(text, options)] += 1
                rows_of[int(label)] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pd.DataFrame({"bucket": np.append(at, -1), "neg": np.append(seen[0][at], rows_of[0]), "pos": np.append(seen[1][at], rows_of[1])})

    return run


def _project(options: NgramOptions, chosen: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = np.full(1 << options.bits, -1, np.int64)
        place[chosen] = np.arange(len(chosen))
        for rows in batches:
            got = [place[ngram_buckets(t, options)] for t in rows["tx_text"]]
            yield pd.DataFrame({"tx_label": rows["tx_label"], "at": [g[g >= 0].astype(np.int32).tobytes() for g in got]})

    return run


def _logistic(lists: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, weight: np.ndarray, options: NgramOptions) -> tuple[np.ndarray, float]:
    """Adam on the ridge-penalised, row-weighted log loss; deterministic."""
    lens = np.array([len(x) for x in lists])
    at, row = np.concatenate(lists) if len(lists) else np.empty(0, np.int32), np.repeat(np.arange(len(lists)), lens)
    value = ratio[at]
    w, b = np.zeros(len(ratio) + 1), 0.0
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, options.steps + 1):
        z = np.bincount(row, value * w[at], len(lists)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = (p - labels) * weight / weight.sum()
        grad = np.append(np.bincount(at, value * g[row], len(ratio)) + options.ridge * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    b = float(w[-1])
    return w[:-1] * ratio, b


def fit(labelled: DataFrame, text_col: str, label_col: str, options: NgramOptions = NgramOptions()) -> NgramModel:
    """A model from a bounded number of rows with 0/1 labels. One class or no rows at all: its share as every score."""
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(F.col(text_col).alias("tx_text"), F.col(label_col).cast("int").alias("tx_label"))
    counted = materialize(rows.mapInPandas(_count(options), "bucket long, neg long, pos long").groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")), "ngram-counts")
    total = counted.where("bucket = -1").head()
    neg, pos = (total["neg"], total["pos"]) if total else (0, 0)
    if not neg or not pos:
        share = (pos + 0.5) / (neg + pos + 1)
        return NgramModel(options, np.zeros(1 << options.bits, np.float32), float(np.log(share / (1 - share))))
    apart = F.col("pos") * neg - F.col("neg") * pos
    odds = apart * apart / ((F.col("pos") + F.col("neg")) * (neg + pos - F.col("pos") - F.col("neg") + 1))
    best = counted.where(f"bucket >= 0 and neg + pos >= {options.least}").withColumn("odds", odds.cast("double")).orderBy(F.desc("odds"), "bucket").limit(options.features).toArrow().to_pandas()
    chosen = best["bucket"].to_numpy(np.int64)
    p, q = best["pos"].to_numpy(float) + options.smooth, best["neg"].to_numpy(float) + options.smooth
    ratio = np.log(p / (pos + 2 * options.smooth)) - np.log(q / (neg + 2 * options.smooth))
    got = rows.mapInPandas(_project(options, chosen), "tx_label int, at binary").toArrow().to_pandas()  # a bounded sample's features
    lists, labels = [np.frombuffer(x, np.int32) for x in got["at"]], got["tx_label"].to_numpy(float)
    order = sorted(range(len(lists)), key=lambda i: (labels[i], got["at"][i]))
    scaled, bias = _logistic([lists[i] for i in order], labels[order], ratio, np.ones(len(order)), options)
    weights = np.zeros(1 << options.bits, np.float32)
    weights[chosen] = scaled
    return NgramModel(options, weights, bias)


def score(docs: DataFrame, model: NgramModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``: the probability of label 1 for every whole text; null and empty texts get the bias alone."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** bits floats, whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for rows in batches:
            z = np.array([m.bias + float(m.weights[ngram_buckets(t, m.options)].sum()) for t in rows["tx_text"]], float)
            yield pd.DataFrame({"doc_id": rows["tx_id"].astype("Int64"), "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    return docs.select(F.col(id_col).cast("long").alias("tx_id"), F.col(text_col).alias("tx_text")).mapInPandas(run, "doc_id long, score double")


def without_label(docs: DataFrame, model: NgramModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score under ``threshold``: each row by its own text, in place."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** bits floats, whatever the input
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rows in batches:
            z = np.array([m.bias + float(m.weights[ngram_buckets(t, m.options)].sum()) for t in rows.column(at).to_pylist()], float)
            yield rows.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, sample_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``tr_id, tr_text, tr_label`` of at most ``sample_rows`` labelled ids of each class, written.

    Ids of the held-out fold, crc32(id as text) mod modulus = held, are never among them. The sample is the ids whose
    hashes are smallest, so its size is bounded whatever the input, and only its ids are broadcast. Null ids and null
    labels take no part; an id with several labels counts once, with the highest.
    """
    marks = labels.where(f"doc_id is not null and {label} in (0, 1)").where(F.pmod(crc32_text("doc_id"), F.lit(modulus)) != held).groupBy(F.col("doc_id").alias("tr_id")).agg(F.max(label).alias("tr_label"))
    sample = lambda k: marks.where(F.col("tr_label") == k).orderBy(F.xxhash64("tr_id"), "tr_id").limit(sample_rows)
    chosen = materialize(sample(0).union(sample(1)), "training-ids")
    rows = docs.select(F.col(id_col).cast("long").alias("tr_id"), F.col(text_col).alias("tr_text"))
    return materialize(rows.join(F.broadcast(chosen), "tr_id"), "training-rows")  # at most 2 * sample_rows ids are broadcast


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, options: NgramOptions = NgramOptions(), text_source: DataFrame | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; trained on ``labels.toxic`` outside fold 2 of 4.

    Nulls: a null text is an empty one, a null id stays null and is not held out. Repeated rows are each scored. No
    labels or one class only: every score is that class's smoothed share. Empty tables give no rows. Other columns of
    either table, whatever their names, are not read. ``text_source`` gives the texts of the labelled ids, if not docs.
    """
    model = fitted(text_source or docs, labels, options)
    held = F.coalesce(F.pmod(crc32_text("doc_id"), F.lit(4)) == 2, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def fitted(docs: DataFrame, labels: DataFrame, options: NgramOptions = NgramOptions()) -> NgramModel:
    """The model of ``labels.toxic`` outside fold 2 of 4."""
    return fit(training_rows(docs, labels, "toxic", 4, 2, options.sample_rows), "tr_text", "tr_label", options)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, options: NgramOptions = NgramOptions()) -> DataFrame:
    """The rows of ``docs`` that ``toxicity`` predicts 0 for, each judged by its own text, whatever its id."""
    return without_label(docs, fitted(docs, labels, options), threshold)
