"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

A dimension is a term. Candidates are dealt into blocks of bounded size, queries likewise, and each pair of a query
block and a candidate block is one task: the candidates' non-zero weights are laid out as one posting list a term, every
query's weights scatter theirs into a dense array of scores, and the k best of the block are selected by partition.
Spark merges the blocks' bests. The work is queries times rows by definition; memory is a block's.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def best_of_block(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids; ``ids`` ascend. Partition selection, then a small sort."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        at = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))]


def _search(k: int):
    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        ids = rows["vec_id"].to_numpy()
        width = max([0, *map(len, rows["terms"]), *map(len, queries["terms"])])
        table = np.zeros((len(rows), width), np.int64)
        for i, t in enumerate(rows["terms"]):
            table[i, : len(t)] = t
        postings = [(at := np.flatnonzero(table[:, d]), table[at, d]) for d in range(width)]
        out: list[tuple[int, int, int]] = []
        for q, terms in zip(queries["vec_id"], queries["terms"], strict=True):
            scores = np.zeros(len(ids), np.int64)
            for d in np.flatnonzero(terms).tolist():
                at, weights = postings[d]
                if len(at) == len(ids):
                    scores += terms[d] * weights
                else:
                    scores[at] += terms[d] * weights
            others = ids != q
            own = scores if others.all() else scores[others]
            named = ids if own is scores else ids[others]
            out += [(q, int(named[i]), int(own[i])) for i in best_of_block(own, named, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def integer_terms(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def exact_top_k(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block_rows: int = 4096, block_queries: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest integer inner products over every row but its own.

    ``is_query`` tells from the id which rows are queries. Ties go to the smaller id; fewer than k candidates are all
    returned. Rows with a null id, a null vector, or a null, NaN or infinite component take no part. Vectors of unequal
    length are compared on the terms that both have. A repeated id counts as one's own row; repeated rows of other ids
    are candidates each, and repeated query rows are one query. Other columns are ignored; an empty table gives none.
    """
    bad = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(~bad)
    rows = materialize(rows.select(F.col(id_col).cast("long").alias("vec_id"), integer_terms(F.col(vector_col), scale).alias("terms")), "vectors")
    queries = rows.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id"])
    n, m = rows.count(), queries.count()
    blocks, parts = max(1, -(-n // block_rows)), max(1, -(-m // block_queries))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = queries.select("vec_id", "terms", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), every(blocks).alias("block"))
    right = rows.select("vec_id", "terms", F.pmod(F.xxhash64("vec_id", "terms"), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"))
    best = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
