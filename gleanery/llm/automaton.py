"""Language-model scores by a weighted backoff automaton over word n-grams that Spark counts.

States are the n-grams (of up to ``order - 1`` words) that training texts hold, and the empty one. A state has an arc for
each word that was seen after it, weighted with the word's smoothed log probability, and a failure arc to the state that
lacks its first word, weighted with the probability mass left for words not seen there. A text is read once from left to
right: where a state has no arc for the next word, failure arcs are followed, and all weights are added up.

The model grows with the corpus, so no task holds it. Texts are dealt into blocks of bounded size, written once as numbers
of words. Every block sends the hashes of its distinct n-grams, with its own counts, to the part of the key range they
belong to; parts add up all blocks' counts and send back what other blocks add to a block's own, in the order in which the
block sorts its n-grams; a block then has whole corpus counts for every n-gram it holds, which is the part of the automaton
that its texts can reach. An n-gram has at most one entry a block, so a common one is no hot key, and parts are ranges of
hashes of about equal size.

Probabilities are hierarchical Dirichlet estimates (MacKay and Peto): p(w | h) = (c(hw) + m p(w | h')) / (c(h) + m), where h'
is h without its first word; words alone are discounted by n1 / (n1 + 2 n2), and what that leaves belongs to one unknown
word. They need plain counts only, and add up to one in every state. Words and n-grams are told by 64-bit hashes: among 10^9
words, a collision is expected once in 37 corpora.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, materialize, mix, small_batches, word_hashes, words_of

#: Tokens at which a block is full; a longer text is a block of its own.
BLOCK_TOKENS = 1 << 21
#: Entries of a part of the key range, at most about so many.
PART_ENTRIES = 1 << 20
#: Hashes of what stands before the first word and after the last.
BEGIN, END = U64(1), U64(2)
#: Dirichlet masses of states of one word, and of two words and more.
MASSES = (256.0, 32.0)
_seen = WordHashes()
_zstd = pa.Codec("zstd")


def packed(values: np.ndarray) -> bytes:
    """Compressed planes of bytes: sorted or small numbers take few."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + _zstd.compress(planes, asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(_zstd.decompress(data[8:], n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(n)


class Block:
    """Texts as numbers of words: each is BEGIN, its words, END. ``words`` are hashes, BEGIN first, the frequent before the rare."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, trains: np.ndarray):
        self.words, self.tokens, self.sizes, self.trains = words, tokens, sizes, trains
        self.starts = np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, hashes: list[np.ndarray], trains: np.ndarray) -> Block:
        edge = np.array([END, BEGIN], U64)
        flat = np.concatenate([edge[1:], *(x for h in hashes for x in (h, edge))])[:-1] if hashes else np.zeros(0, U64)
        words, tokens, counts = np.unique(flat, return_inverse=True, return_counts=True)
        counts[words == BEGIN] = len(flat) + 1
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        return cls(words[order], place[tokens.reshape(-1)], np.array([len(h) + 2 for h in hashes], np.int64), trains)

    def ngrams(self, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For n from 1 to ``order``: hashes of the distinct n-grams, their counts in texts that train, for each the number
        of the (n-1)-gram that it begins and ends with, and its last word."""
        at = np.arange(len(self.tokens), dtype=np.int32) - np.repeat(self.starts.astype(np.int32), self.sizes)
        learns = np.repeat(self.trains, self.sizes)
        count = np.bincount(self.tokens, learns, len(self.words)).astype(np.int64)
        zero, all_words = np.zeros(len(self.words), np.int32), np.arange(len(self.words), dtype=np.int32)
        out = [(mix(self.words + U64(order)), count, zero, zero, all_words)]
        number, base = self.tokens, np.int64(len(self.words))
        for n in range(2, order + 1):
            ends = np.flatnonzero(at >= n - 1).astype(np.int32)
            pair = number[ends - 1] * base
            pair += self.tokens[ends]
            distinct, own = np.unique(pair, return_inverse=True)
            own = own.reshape(-1).astype(np.int32)
            del pair
            parent, last = (distinct // base).astype(np.int32), (distinct % base).astype(np.int32)
            suffix = np.empty(len(distinct), np.int32)
            suffix[own] = number[ends]  # the same for all of an n-gram
            count = np.bincount(own, learns[ends], len(distinct)).astype(np.int64)
            out.append((mix(out[-1][0][parent] * U64(0x9E3779B97F4A7C15) + self.words[last]), count, parent, suffix, last))
            if n < order:
                number = np.full(len(self.tokens), -1, np.int32)
                number[ends] = own
        return out


_ROWS = "block long, tokens long, ids binary, known binary, held binary, sizes binary, words binary, texts binary"


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block of a task's texts; ``held`` tells the texts that do not train."""
    task, made = TaskContext.get().partitionId() << 32, 0
    hashes, ids, trains, size = [], [], [], 0

    def row() -> pa.RecordBatch:
        block = Block.of(hashes, ~np.array(trains, bool))
        cells = [[task + made], [size], [packed(np.array([i or 0 for i in ids], np.int64))], [packed(np.array([i is not None for i in ids], np.int8))], [packed(np.array(trains, np.int8))], [packed(block.sizes)], [packed(block.words)], [packed(block.tokens)]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.binary()) for i, c in enumerate(cells)], names=[x.split()[0] for x in _ROWS.split(", ")])

    for rows in batches:
        for text, i, held in zip(*(rows.column(c).to_pylist() for c in ("text", "doc_id", "held_out")), strict=True):
            hashes.append(word_hashes(words_of(text, lower=True), _seen))
            ids.append(i)
            trains.append(held)
            size += len(hashes[-1]) + 1
            if size >= BLOCK_TOKENS:
                yield row()
                made += 1
                hashes, ids, trains, size = [], [], [], 0
    if hashes:
        yield row()


def _block(row) -> Block:
    return Block(unpacked(row.words, np.uint64), unpacked(row.texts, np.int32), unpacked(row.sizes, np.int64), unpacked(row.held, np.int8) == 0)


def _sorted(ngrams: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a block's n-grams of all lengths, ascending, and their places: the same whenever it is asked."""
    keys = np.concatenate([n[0] for n in ngrams])
    place = np.argsort(keys, kind="stable")
    return keys[place], place


def _pieces(order: int, parts: int, tokens_only: bool = False):
    """Sorted hashes of a block's n-grams and its own counts, a row for each part of the key range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = (np.arange(parts + 1, dtype=object) * (1 << 64) // parts)[1:-1].astype(U64)
        for rows in batches:
            for row in rows.itertuples():
                found = _block(row).ngrams(order)
                if tokens_only:
                    found = [tuple(x[1:] for x in found[0])]  # BEGIN is no token
                keys, place = _sorted(found)
                counts = np.concatenate([f[1] for f in found])[place]
                cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                yield pd.DataFrame([(p, row.block, packed(keys[a:b]), packed(counts[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b], columns=["part", "block", "keys", "counts"])

    return run


def _gathered(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All entries of a part by key: keys, counts, the place of each entry's block in ``rows``, and each key's total."""
    parts = [unpacked(k, np.uint64) for k in rows["keys"]]
    keys, counts = np.concatenate(parts), np.concatenate([unpacked(c, np.int64) for c in rows["counts"]])
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    place = np.argsort(keys, kind="stable")
    keys, counts, owner = keys[place], counts[place], owner[place]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys, counts, owner, np.repeat(np.add.reduceat(counts, first), np.diff(np.append(first, len(keys))))


def _others(rows: pd.DataFrame) -> pd.DataFrame:
    """What other blocks add to each of a block's own counts, in the order of its piece: the hashes need not go back."""
    _, counts, owner, totals = _gathered(rows)
    others = (totals - counts)[np.argsort(owner, kind="stable")]
    cuts = [0, *np.cumsum(np.bincount(owner, minlength=len(rows))).tolist()]
    return pd.DataFrame({"block": rows["block"], "part": rows["part"], "others": [packed(others[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]})


def _word_totals(rows: pd.DataFrame) -> pd.DataFrame:
    keys, _, _, totals = _gathered(rows)
    totals = totals[np.append(True, keys[1:] != keys[:-1])]
    return pd.DataFrame({"n": [totals.sum()], "v": [(totals > 0).sum()], "n1": [(totals == 1).sum()], "n2": [(totals == 2).sum()]}).astype("int64")


class Automaton:
    """The states and arcs that a block's texts can reach.

    ``counts`` are whole-corpus counts of the n-grams of ``Block.ngrams``; ``statistics`` are the tokens of all training
    texts, their distinct ones, and how many of those were seen once and twice.
    """

    def __init__(self, ngrams: list[tuple], counts: list[np.ndarray], statistics: tuple[int, int, int, int], masses: tuple[float, ...] = MASSES):
        tokens, distinct, once, twice = statistics
        discount = min(0.95, max(0.05, once / (once + 2 * twice) if once + twice else 0.5))
        self.width, order = len(counts[0]), len(counts)
        self.unknown = np.log10(discount * distinct / tokens) if tokens else 0.0
        offsets = np.cumsum([1, *[len(c) for c in counts[:-1]]])  # of the states of one word, of two, ...
        self.fail, self.fail_weight = np.zeros(offsets[-1], np.int64), np.zeros(offsets[-1])
        arcs, weights, targets, p = [], [], [], None
        for n in range(order):
            _, _, parent, suffix, last = ngrams[n]
            c = counts[n].astype(float)
            seen = c > 0
            if n == 0:
                seen[0] = False  # BEGIN is no token
                p = np.where(seen, c - discount, 0.0) / max(tokens, 1)
            else:
                mass = masses[min(n, len(masses)) - 1]
                p = np.where(seen, (c + mass * p[suffix]) / (counts[n - 1][parent] + mass), 0.0)
            at = np.flatnonzero(seen)
            arcs.append((parent[at].astype(np.int64) + (offsets[n - 1] if n else 0)) * self.width + last[at])
            weights.append(np.log10(p[at]))
            if n < order - 1:
                mass = masses[min(n + 1, len(masses)) - 1]
                own = slice(offsets[n], offsets[n + 1])
                self.fail[own] = offsets[n - 1] + suffix if n else 0
                self.fail_weight[own] = np.log10(mass / (c + mass))
                targets.append(offsets[n] + at)
            else:  # the state of the longest n-grams lacks their first word
                targets.append(offsets[n - 1] + suffix[at] if n else np.zeros(len(at), np.int64))
        arcs = np.concatenate(arcs)
        place = np.argsort(arcs)
        self.arcs, self.weights, self.targets = arcs[place], np.concatenate(weights)[place], np.concatenate(targets)[place]
        self.start = offsets[0] if order > 1 and counts[0][0] else 0

    def scores(self, tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log10 probabilities of texts of numbers of words, read from left to right, all texts a step at a time."""
        order = np.argsort(-sizes, kind="stable")
        starts, lengths = starts[order], sizes[order]
        state, total = np.full(len(order), self.start, np.int64), np.zeros(len(order))
        left = len(order)
        for step in range(int(lengths[0]) if len(order) else 0):
            while lengths[left - 1] <= step:
                left -= 1
            word = tokens[starts[:left] + step]
            todo = np.arange(left)
            while len(todo):
                now = state[todo]
                wanted = now * self.width + word[todo]
                at = np.searchsorted(self.arcs, wanted)
                hit = np.append(self.arcs, -1)[at] == wanted if len(self.arcs) < 64 else self.arcs[np.minimum(at, len(self.arcs) - 1)] == wanted
                ends, at = todo[hit], at[hit]
                total[ends] += self.weights[at]
                state[ends] = self.targets[at]
                todo, now = todo[~hit], now[~hit]
                if len(todo):
                    total[todo] += np.where(now == 0, self.unknown, self.fail_weight[now])
                    state[todo] = self.fail[now]
                    todo = todo[now != 0]
        out = np.empty(len(order))
        out[order] = total
        return out


def _score(order: int, masses: tuple[float, ...], statistics: tuple[int, int, int, int]):
    def run(blocks: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in blocks.itertuples():  # one
            block = _block(row)
            ngrams = block.ngrams(order)
            _, place = _sorted(ngrams)
            counts = np.concatenate([n[1] for n in ngrams])
            counts[place] += np.concatenate([unpacked(x, np.int64) for x in others.sort_values("part")["others"]])
            counts = np.split(counts, np.cumsum([len(n[1]) for n in ngrams])[:-1])
            ngrams = [(None, None, *n[2:]) for n in ngrams]
            model = Automaton(ngrams, counts, statistics, masses)
            scores = model.scores(block.tokens, block.starts + 1, block.sizes - 1)
            tokens, distinct = statistics[:2]
            text, word = np.repeat(np.arange(len(block.sizes)), block.sizes), block.tokens
            inside = word != 0
            base = np.log10((counts[0] + 1.0) / (tokens + 1.0 * (distinct + 1)))
            ids, known = unpacked(row.ids, np.int64), unpacked(row.known, np.int8)
            part = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": ~block.trains, "n_tokens": block.sizes - 1})
            part.loc[known == 0, "doc_id"] = pd.NA
            part["n_known"] = np.bincount(text[inside], counts[0][word[inside]] > 0, len(part)).astype(np.int64)
            part["train_tokens"] = np.int64(tokens)
            part["base_score"] = np.bincount(text[inside], base[word[inside]], len(part))
            part["score"] = scores
            out.append(part)
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def score_texts(docs: DataFrame, held_out: Column, order: int = 2, masses: tuple[float, ...] = MASSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: one row for each row of ``docs``.

    Tokens are the words of the text, A-Z lower-cased, and one end. The model learns from all rows that are not
    ``held_out`` (null: false). ``score`` is the automaton's log10 probability of the text, ``base_score`` that of single
    words with one added to every count; ``n_known`` tokens are in training texts, which have ``train_tokens``.

    A null text is empty: one token, its end. Null ids stay null; repeated rows are each learnt from and returned. Without
    training texts every score is 0. Other columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    blocks = materialize(rows.mapInArrow(_to_blocks, _ROWS), "lm-blocks")
    tokens = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    pieces = lambda n, only=False: blocks.select("block", "held", "sizes", "words", "texts").mapInPandas(_pieces(n, max(1, -(-tokens * n // PART_ENTRIES)), only), "part int, block long, keys binary, counts binary").groupBy("part")
    totals = pieces(1, only=True).applyInPandas(_word_totals, "n long, v long, n1 long, n2 long").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "n1", "n2")])
    statistics = tuple(totals.first())
    others = pieces(order).applyInPandas(_others, "block long, part int, others binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.drop("tokens").groupBy("block").cogroup(others.groupBy("block")).applyInPandas(_score(order, masses, statistics), schema)
