"""Ranked lexical search with Fagin's threshold algorithm over segments of a document-partitioned index.

Every document is read once: its query terms and their occurrences are its row of the forward index, written to the
shared folder. Corpus statistics are sums over that index, which also counts documents that hold no query term. The index
is dealt into segments of bounded size, a task each. A segment lays out one list of documents for each term, highest impact
first. For an item, the lists of its terms are read in turn, some rounds at a time; each new document's score is looked up
whole in the segment's forward index; reading stops when the threshold, the sum of the last impacts read, is strictly below
the k-th score so far (at equality an unread document with a smaller id could still win). Segments' bests are merged in two
steps, so that no task gathers those of all segments.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: Terms of items that are searched together: the tasks get their dictionary and statistics.
QUERY_TERMS = 200_000
#: Postings of a segment.
SEGMENT_POSTINGS = 1 << 21
#: Rounds between two looks at the threshold, at first; they double.
ROUNDS = 16
#: Share of length normalisation in percent, and how slowly a term's occurrences saturate.
LENGTH_PERCENT, SATURATION = 50, 20

#: ASCII letters and digits, A-Z folded, and every byte above ASCII are parts of terms; other bytes part them.
FOLD = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and non-ASCII characters, only A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def term_weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, length: np.ndarray, docs: int, total: int, length_percent: int = LENGTH_PERCENT, saturation: int = SATURATION) -> np.ndarray:
    """Whole-number impacts of terms of ``weights`` that occur ``tf`` times in documents of ``length`` terms."""
    if len(length) and length_percent * int(length.max()) * docs >= 1 << 63:  # beyond 64 bits, in numbers of any size
        m = np.array([length_percent * int(n) * docs // total for n in length], np.int64)
    else:
        m = length_percent * length * docs // total
    return weights * (1_000_000_000 * tf // (1000 * tf + saturation * (100 - length_percent + m)))


def _item_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        found = [(row, term) for row, text in zip(rows["row"], rows["text"], strict=True) for term in dict.fromkeys(terms_of(text))]
        yield pd.DataFrame(found, columns=["row", "term"])


_FORWARD = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])


def _forward(vocabulary):
    """Rows of the forward index of a task's documents that hold a term, of the query or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for rows in batches:
            lengths, terms, counts = [], [], []
            for text in rows.column("text").to_pylist():
                words = terms_of(text)
                found = np.fromiter(map(number, words, repeat(-1)), np.int32, len(words))
                own, tf = np.unique(found[found >= 0], return_counts=True)
                lengths.append(len(words))
                terms.append(own)
                counts.append(tf)
            kept = pa.array([n > 0 for n in lengths], pa.bool_())
            columns = [rows.column("row"), rows.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=_FORWARD).filter(kept)

    return run


class Segment:
    """Documents of a part of the forward index, by ascending id: lists of impacts by term, and impacts by document."""

    def __init__(self, rows: pd.DataFrame, weights: np.ndarray, docs: int, total: int):
        rows = rows.sort_values(["doc_id", "row"], na_position="last", kind="stable")
        self.ids, self.rows, self.width = rows["doc_id"].to_numpy(), rows["row"].to_numpy(), max(1, len(weights))
        sizes = rows["terms"].map(len).to_numpy(np.int64)
        doc = np.repeat(np.arange(len(rows)), sizes)
        term = np.concatenate([*rows["terms"], np.zeros(0, np.int64)]).astype(np.int64)
        impact = impacts(weights[term], np.concatenate([*rows["tf"], np.zeros(0, np.int64)]).astype(np.int64), rows["n"].to_numpy(np.int64)[doc], docs, total)
        self.keys, self.impacts = doc * self.width + term, impact  # a document's terms ascend
        place = np.lexsort((doc, -impact, term))
        self.starts = np.searchsorted(term[place], np.arange(self.width + 1))
        self.list_docs, self.list_impacts = doc[place], impact[place]

    def scores(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Looks up each document's impacts of the terms, and adds them up."""
        wanted = docs[:, None] * self.width + terms
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.impacts[at], 0).sum(axis=1)

    def search(self, terms: np.ndarray, k: int, least: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """The documents of the k highest scores above 0 and at least ``least``, their scores, and the entries read.

        ``least`` is a score that k documents elsewhere reach. Equal scores are ordered by place.
        """
        terms = terms[self.starts[terms + 1] > self.starts[terms]]
        starts, ends = self.starts[terms], self.starts[terms + 1]
        seen = np.zeros(len(self.ids), bool)
        best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step, read = 0, ROUNDS, 0
        while (open_ := starts + depth < ends).any():
            upto = np.minimum(starts + depth + step, ends)
            entries = np.concatenate([self.list_docs[a:b] for a, b in zip(starts[open_] + depth, upto[open_], strict=True)])
            read += len(entries)
            new = np.unique(entries[~seen[entries]])
            seen[new] = True
            if len(new):
                own = self.scores(new, terms)
                high = (own > 0) & (own >= least)
                best, scores = np.concatenate([best, new[high]]), np.concatenate([scores, own[high]])
                order = np.lexsort((best, -scores))[:k]
                best, scores = best[order], scores[order]
            depth, step = depth + step, 2 * step
            threshold = self.list_impacts[upto - 1][starts + depth < ends].sum()  # nothing unread in lists read to their end
            if threshold < max(least, scores[-1] if len(scores) == k else 0):
                break
        return best, scores, read


def _search(statistics, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, weights, docs, total = statistics.value
        held: dict[int, pd.DataFrame] = {}

        def look(parts: list[pd.DataFrame]) -> None:
            segment = Segment(pd.concat(parts, ignore_index=True), weights, docs, total)
            for item, terms in items.items():
                was = held.get(item)
                found, scores, _ = segment.search(terms, k, int(was["score"].iloc[-1]) if was is not None and len(was) == k else 0)
                if len(found):
                    own = pd.DataFrame({"item": item, "doc_id": segment.ids[found], "row": segment.rows[found], "score": scores})
                    held[item] = own if was is None else pd.concat([was, own]).sort_values(["score", "doc_id", "row"], ascending=[False, True, True], na_position="last", kind="stable").head(k)

        parts, size = [], 0
        for rows in batches:
            rows["doc_id"] = rows["doc_id"].astype("Int64")
            parts.append(rows)
            size += int(rows["terms"].map(len).sum())
            if size >= SEGMENT_POSTINGS:
                look(parts)
                parts, size = [], 0
        if size:
            look(parts)
        yield from held.values()

    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: for each row of ``items``, the k highest-scoring rows of ``docs`` (all above 0, if
    fewer), equal scores by ascending doc_id.

    An item's terms count once each, of whatever length its text is; null and empty texts have none. Items of one id are
    ranked each by itself. Rows with null ids take part and come last among equals; repeated rows are ranked each. Other
    columns are ignored; empty tables give none. The index is built anew for each QUERY_TERMS terms of the items.
    """
    spark = docs.sparkSession
    small_batches(spark)
    asked = materialize(items.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), "search-items")
    wanted = materialize(asked.mapInPandas(_item_terms, "row long, term binary"), "search-item-terms")
    turns = max(1, -(-wanted.count() // QUERY_TERMS))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for turn in range(turns):
        terms = wanted.where(F.pmod(F.xxhash64("row"), F.lit(turns)) == turn).toPandas()  # about QUERY_TERMS rows
        own = _turn(rows, terms, k)
        found = own if found is None else found.unionByName(own)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(asked.select(F.col("row").alias("item"), "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _turn(rows: DataFrame, terms: pd.DataFrame, k: int) -> DataFrame:
    """``item, doc_id, row, score``: about k rows of each item for each of a number of parts of the segments."""
    context = rows.sparkSession.sparkContext
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(map(bytes, terms["term"])))}
    index = materialize(rows.mapInArrow(_forward(context.broadcast(vocabulary)), "row long, doc_id long, n long, terms array<int>, tf array<long>"), "search-index")
    docs, total, postings = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    df = dict(index.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # a row for each term of the turn
    weights = np.array([term_weight(docs, df.get(i, 0)) for i in range(len(vocabulary))], np.int64)
    own = terms.assign(term=[vocabulary[bytes(t)] for t in terms["term"]]).groupby("row")["term"]
    statistics = context.broadcast(({int(item): np.sort(t.to_numpy(np.int64)) for item, t in own}, weights, docs, max(1, total)))
    parts = max(context.defaultParallelism, -(-postings // SEGMENT_POSTINGS))
    best = index.where(F.size("terms") > 0).repartition(parts, "row").mapInPandas(_search(statistics, k), "item long, doc_id long, row long, score long")
    some = F.pmod(F.xxhash64("row"), F.lit(math.isqrt(parts))).alias("part")
    rank = F.row_number().over(Window.partitionBy("item", "part").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row"))
    return best.withColumn("part", some).withColumn("place", rank).where(F.col("place") <= k).drop("part", "place")
