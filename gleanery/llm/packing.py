"""Best-fit packing of tokenised documents into fixed-length sequences, improved by swap-based local search.

Texts are tokenised and cut where Spark reads them; only (id, length) rows travel on. Pieces are dealt at random into
groups of a bounded number of pieces, each group is packed alone, and a group wastes about one bin among thousands, so
the work is linear in the input and no task sees more than its group.

Within a group: best-fit decreasing, then local search over the bins that are not full. A move or an exchange of up to
two pieces for up to two is made when it raises the sum of squared fills (fuller bins get fuller, emptier ones emptier)
and fits, until none does; bins that run empty are dropped.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: Pre-token pattern of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name_or_path: str) -> str:
    """A path as it is; a bare file name means a file of the installed public tokenizers."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


class PackedTokenizer:
    """Token ids, as packed little-endian 32-bit numbers, of texts under a byte-level BPE tokenizer file.

    The ids are those of ``tokenizers`` with ``add_special_tokens=False`` (a test holds them together); the encoder is
    built from the same file's vocabulary, as it is five times faster.
    """

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def packed(self, text: str) -> bytes:
        special = any(s in text for s in self.special)
        ids = self.encoding.encode(text, allowed_special="all") if special else self.encoding.encode_ordinary(text)
        return array("I", ids).tobytes()


@lru_cache(maxsize=4)
def _loaded(path: str) -> PackedTokenizer:
    return PackedTokenizer(path)


def tokenizer(path: str) -> PackedTokenizer:
    """A worker's tokenizer of a file, loaded once."""
    return _loaded(path)


def cut(length: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else full pieces after a first that may be shorter."""
    first = length if length <= limit else length % limit or limit
    return [(0, first), *((s, limit) for s in range(first, length, limit))]


def _pieces(tokenizer_file: str, limit: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, end = tokenizer(tokenizer_path(tokenizer_file)), int(end_id).to_bytes(4, "little")
        task, row = TaskContext.get().partitionId(), 0
        for rows in batches:
            out = []
            for doc_id, text in zip(rows["pk_id"], rows["pk_text"], strict=True):
                data = tok.packed(text or "") + end
                row += 1
                for k, (start, length) in enumerate(cut(len(data) // 4, limit)):
                    ids = data[4 * start : 4 * (start + length)]
                    out.append((doc_id, k, start, length, zlib.crc32(ids), zlib.crc32(f"{task} {row} {k}".encode()), *([np.frombuffer(ids, "<u4").astype(np.int32)] if with_ids else [])))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "deal", *(["ids"] if with_ids else [])]
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return run


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str = "byte_bpe_50k.json", limit: int = 1024, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """Every document's token pieces of at most ``limit``: ``doc_id, piece, start, length, ids_crc32, deal[, ids]``.

    ``ids`` is the piece's token ids (array<int>); ``deal`` is a random number that depends on the row's place in the
    input only. A null text counts as empty: one piece, the end id. Null ids stay null; repeated rows each have pieces.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("pk_id"), F.col(text_col).alias("pk_text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long" + (", ids array<int>" if with_ids else "")
    return rows.mapInPandas(_pieces(tokenizer_file, limit, end_id, with_ids), schema)


def best_fit_decreasing(lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(limit + 1)]  # bins by free room
    open_rooms: list[int] = []  # sorted rooms that have bins
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        at = bisect_left(open_rooms, need)
        if at == len(open_rooms):
            bins.append([i])
            b, left = len(bins) - 1, limit - need
        else:
            had = open_rooms[at]
            b, left = room[had].pop(), had - need
            if not room[had]:
                open_rooms.pop(at)
            bins[b].append(i)
        if left:
            if not room[left]:
                insort(open_rooms, left)
            room[left].append(b)
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Moves and exchanges of up to two pieces for up to two, any underfull bin with any other, until none raises squared fill.

    Underfull bins are indexed by the sums of up to two of their pieces and by room. Each bin, emptiest first, gives what
    raises squared fill most, as long as anything does; passes end when one makes no change. Each change raises squared
    fill, so the search ends. Bins that run empty are dropped.
    """
    size = lengths.tolist()
    bins = [list(b) for b in bins]
    fill = [sum(size[i] for i in b) for b in bins]
    sums: list[dict[int, tuple[int, ...]]] = [{} for _ in bins]  # of none, one or two pieces: which
    holders: list[list[tuple[int, int]]] = [[] for _ in range(limit)]  # of a sum: (room, bin), ascending
    reach = np.full(limit, -1)  # a sum and the most room beside it: the largest sum that can replace it

    def enter(b: int) -> None:
        if not 0 < fill[b] < limit:
            return
        alike = defaultdict(list)
        for i in bins[b]:
            alike[size[i]].append(i)
        few = [i for same in alike.values() for i in same[:2]]
        sums[b] = {0: ()}
        for x in few:
            sums[b][size[x]] = (x,)
        for p, x in enumerate(few):
            for z in few[p + 1 :]:
                sums[b].setdefault(size[x] + size[z], (x, z))
        for y in sums[b]:
            insort(holders[y], (limit - fill[b], b))
            reach[y] = y + holders[y][-1][0]

    def leave(b: int) -> None:
        for y in sums[b]:
            del holders[y][bisect_left(holders[y], (limit - fill[b], b))]
            reach[y] = y + holders[y][-1][0] if holders[y] else -1
        sums[b] = {}

    def best_change(small: int) -> tuple[int, int, int] | None:
        """What ``small`` gives, the bin that takes it, and what that one gives back, as sums."""
        most, change, room = 0, None, limit - fill[small]
        for x in sums[small]:
            for y in np.flatnonzero(reach[:x] >= x).tolist():
                more = x - y
                if more * room <= most:  # not even into a bin that it fills
                    break
                at = bisect_left(holders[y], (more, -1))  # the fullest that takes it
                at += at < len(holders[y]) and holders[y][at][1] == small
                if at < len(holders[y]) and more * (room - holders[y][at][0] + more) > most:
                    most, change = more * (room - holders[y][at][0] + more), (x, holders[y][at][1], y)
        return change

    for b in range(len(bins)):
        enter(b)
    changed = True
    while changed:
        changed = False
        for small in sorted((b for b in range(len(bins)) if 0 < fill[b] < limit), key=lambda b: fill[b]):
            while change := best_change(small):
                x, big, y = change
                give, take = sums[small][x], sums[big][y]
                leave(small)
                leave(big)
                bins[small] = [i for i in bins[small] if i not in give] + [*take]
                bins[big] = [i for i in bins[big] if i not in take] + [*give]
                fill[small] -= x - y
                fill[big] += x - y
                enter(small)
                enter(big)
                changed = True
    return [b for b in bins if b]


def _pack_group(limit: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["deal", "doc_id", "piece", "start"], kind="stable", ignore_index=True)
        lengths = rows["length"].to_numpy()
        whole = np.flatnonzero(lengths >= limit)
        rest = np.flatnonzero(lengths < limit)
        bins = [[int(i)] for i in whole] + [[int(rest[i]) for i in b] for b in local_search(best_fit_decreasing(lengths[rest], limit), lengths[rest], limit)]
        number, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                number[i], offset[i] = k, at
                at += int(lengths[i])
        rows["sequence_id"] = rows["group"].to_numpy() * (1 << 32) + number
        rows["offset"] = offset
        return rows.drop(columns=["group", "deal"])

    return run


def pack_pieces(pieces: DataFrame, limit: int = 1024, group_pieces: int = 20_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows of ``doc_id, piece, start, length, ids_crc32, deal``.

    Pieces are dealt into groups of about ``group_pieces`` by ``deal``; each group is packed in one task.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "deal", F.pmod(F.xxhash64("deal"), F.lit(groups)).alias("group"))
    return dealt.groupBy("group").applyInPandas(_pack_group(limit), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str = "byte_bpe_50k.json", limit: int = 1024, end_id: int = 2, group_pieces: int = 20_000) -> DataFrame:
    """Packs all documents: one row per piece with ``sequence_id`` and gapless ``offset`` (see token_pieces, pack_pieces).

    An empty table gives no rows. Other columns of ``docs`` are ignored, whatever their names. Equal lengths are placed
    in a fixed order, so a retried task packs alike. Join token_pieces(..., with_ids=True) on (doc_id, piece) or encode
    again by ``start`` and ``length`` for the ids themselves.
    """
    pieces = materialize(token_pieces(docs, id_col, text_col, tokenizer_file, limit, end_id, with_ids=False), "pieces")
    return pack_pieces(pieces, limit, group_pieces)
