"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed where the texts are read. The trees are fitted on a bounded, hash-chosen sample of labelled
rows (64 bins a statistic, level-wise growth), then flattened into arrays of split statistics, thresholds and leaf
values, which numpy walks for a whole batch of documents at once, level by level.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, small_batches, window_hashes, word_hashes, words_of
from .toxicity import crc32_text, training_rows

STATISTICS = (
    "log_words", "log_chars", "word_length", "word_length_spread", "upper_share", "digit_share", "symbol_share", "exclaim_share", "punct_share",
    "other_share", "end_mark_share", "distinct_share", "top_share", "repeat_next", "dup_lines", "dup_windows2", "dup_windows4", "lines_per_word", "short_share", "bar_words", "upper_words", "mark_words",
)
_seen = WordHashes()


@dataclass(frozen=True)
class TreeOptions:
    """``sample_rows`` of each class that the trees are fitted on at most, their ``trees`` and ``depth``, ``bins`` of a statistic, ``rate``."""

    sample_rows: int = 10_000
    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    ridge: float = 1.0
    least_weight: float = 2.0


@dataclass(frozen=True)
class Forest:
    """Complete binary trees: ``feature`` and ``threshold`` of each inner node, ``leaf`` values, the ``start`` score."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float


def statistics(text: str | None) -> list[float]:
    """The document statistics, in the order of STATISTICS; all zero without words."""
    words = words_of(text)
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    chars = len(text)
    lens = np.fromiter(map(len, words), np.int64, n)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    few = np.bincount(np.minimum(points, 128), minlength=129)
    upper, digits = few[65:91].sum(), few[48:58].sum()
    symbols, ends = few[[35, 42, 36, 37, 38, 124, 60, 62]].sum(), few[[46, 44, 59, 58, 63]].sum()
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x]
    h = word_hashes(words, _seen)
    _, counts = np.unique(h, return_counts=True)
    dup = lambda k: 1 - len(np.unique(w := window_hashes(h, k))) / len(w)
    last = Counter(w[-1] for w in words)
    return [
        np.log1p(n), np.log1p(chars), lens.mean(), lens.std(), upper / chars, digits / chars, symbols / chars, few[33] / chars, ends / chars, few[128] / chars,
        sum(last[c] for c in b".,;:?") / n, len(counts) / n, counts.max() / n, float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0, 1 - len(set(lines)) / len(lines), dup(2), dup(4),
        len(lines) / n, float((lens <= 3).mean()), sum(w == b"|" for w in words) / n, sum(w.isupper() for w in words) / n, sum(last[c] for c in b"#*$%&!|<>") / n,
    ]


def _stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        table = pd.DataFrame([statistics(t) for t in rows["tr_text"]], columns=STATISTICS, dtype=float)
        yield pd.concat([rows[["tr_id", "tr_label"]].reset_index(drop=True), table], axis=1)


def fit_forest(x: np.ndarray, y: np.ndarray, options: TreeOptions = TreeOptions()) -> Forest:
    """Second-order boosting of the log loss on binned columns; ties go to the first statistic and lowest bin."""
    n, d = x.shape
    inner = 2**options.depth - 1
    share = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, options.bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], axis=1)
    width = options.bins
    flat = binned + np.arange(d) * width
    z, feats, thresholds, leaves = np.full(n, start), [], [], []
    for _ in range(options.trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        feat, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(options.depth):
            first, count = 2**level - 1, 2**level
            key = (((node - first) * (d * width))[:, None] + flat).ravel()
            G = np.bincount(key, np.repeat(g, d), count * d * width).reshape(count, d, width).cumsum(axis=2)
            H = np.bincount(key, np.repeat(h, d), count * d * width).reshape(count, d, width).cumsum(axis=2)
            gt, ht = G[:, :, -1:], H[:, :, -1:]
            gain = G**2 / (H + options.ridge) + (gt - G) ** 2 / (ht - H + options.ridge) - gt**2 / (ht + options.ridge)
            gain[(H < options.least_weight) | (ht - H < options.least_weight)] = 0
            at = gain.reshape(count, -1).argmax(axis=1)
            good = gain.reshape(count, -1)[np.arange(count), at] > 1e-6
            for k in np.flatnonzero(good):
                j, b = divmod(int(at[k]), width)
                feat[first + k], cut[first + k] = j, cuts[j][b] if b < len(cuts[j]) else np.inf
            right = x[np.arange(n), feat[node]] > cut[node]
            node = 2 * node + 1 + right
        at = node - inner
        G, H = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
        leaf = options.rate * G / (H + options.ridge)
        z += leaf[at]
        feats.append(feat), thresholds.append(cut), leaves.append(leaf)
    return Forest(np.array(feats), np.array(thresholds), np.array(leaves), start)


def forest_scores(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Probabilities of label 1: every tree is walked for all rows at once."""
    z, rows = np.full(len(x), forest.start), np.arange(len(x))
    depth = (forest.leaf.shape[1] - 1).bit_length()
    for feat, cut, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, feat[node]] > cut[node])
        z += leaf[node - len(feat)]
    return 1 / (1 + np.exp(-z))


def fit(rows: DataFrame, options: TreeOptions = TreeOptions()) -> Forest:
    """Trees from a bounded number of rows ``tr_id, tr_text, tr_label``, which are sorted, so that fits repeat."""
    small_batches(rows.sparkSession)
    schema = "tr_id long, tr_label int, " + ", ".join(f"{s} double" for s in STATISTICS)
    got = rows.select("tr_id", "tr_text", F.col("tr_label").cast("int")).mapInPandas(_stats, schema).toArrow().to_pandas().sort_values(["tr_id", *STATISTICS])
    return fit_forest(got[list(STATISTICS)].to_numpy(float).reshape(-1, len(STATISTICS)), got["tr_label"].to_numpy(float), options)


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # trees * 2 ** depth numbers, whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = np.array([statistics(t) for t in rows["q_text"]], float).reshape(-1, len(STATISTICS))
            yield pd.DataFrame({"doc_id": rows["q_id"].astype("Int64"), "score": forest_scores(shared.value, x)})

    return docs.select(F.col(id_col).cast("long").alias("q_id"), F.col(text_col).alias("q_text")).mapInPandas(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, options: TreeOptions = TreeOptions()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; trained on ``labels.quality`` outside fold 0 of 5.

    Nulls: a null text is an empty one, a null id stays null and is not held out. Repeated rows are each scored. No
    labels or one class only: every score is that class's smoothed share. Empty tables give no rows. Other columns of
    either table, whatever their names, are not read.
    """
    forest = fit(training_rows(docs, labels, "quality", 5, 0, options.sample_rows), options)
    held = F.coalesce(F.pmod(crc32_text("doc_id"), F.lit(5)) == 0, F.lit(False))
    return score(docs, forest).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
