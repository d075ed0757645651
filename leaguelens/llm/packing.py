"""Token ids packed into fixed-length rows by best-fit-decreasing.

A document's ids, end id included, are cut losslessly into pieces of at most the row
length.  Pieces go, longest first, into the row with the least room that still fits; a
segment tree over room sizes finds it in a few steps.  Every packed row carries its ids
(little-endian, padded), cumulative segment lengths and positions that restart with each
segment.  Packing happens within bounded windows of each input partition, so nothing is
shuffled and a lost task is simply run again.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens that are packed together in one task.
WINDOW_TOKENS = 4_000_000


class RoomTree:
    """Rooms 1..n; finds the smallest room of at least a size that some row has."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def first(self, least: int) -> int:
        """The smallest such room, or 0."""
        at = least + self.size
        if self.count[at]:
            return least
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at + (not self.count[2 * at])
                return at - self.size
            at >>= 1
        return 0


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of piece numbers; lengths are 1 to ``capacity``; ties go to the earlier piece and the row filled to that room last."""
    tree, open_rows, rows = RoomTree(capacity), [[] for _ in range(capacity + 1)], []
    for piece in np.lexsort((np.arange(len(lengths)), -lengths)).tolist():
        n = int(lengths[piece])
        room = tree.first(n)
        if room:
            row = open_rows[room].pop()
            tree.add(room, -1)
        else:
            row, room = len(rows), capacity
            rows.append([])
        rows[row].append(piece)
        if room > n:
            open_rows[room - n].append(row)
            tree.add(room - n, 1)
    return rows


def tokenizer(path: str | None = None) -> Callable[[str], list[int]]:
    """The public byte-level vocabulary; special strings are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


SCHEMA = (
    "shard int, window int, row int, n_tokens int, doc_ids array<long>, offsets array<int>, cu_seqlens array<int>, ids binary, positions binary"
)


def pack_documents(
    docs: DataFrame,
    length: int = 2048,
    end_id: int = 50256,
    pad_id: int = 50256,
    vocabulary_path: str | None = None,
    window_tokens: int = WINDOW_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Packed rows of all documents.

    ``doc_ids`` and ``offsets`` say where each segment comes from; ``cu_seqlens`` starts
    with 0 and ends with ``n_tokens``; ``ids`` and ``positions`` hold ``length`` numbers
    of two bytes (four if ids or positions need it).  A null or empty text is its end id
    alone; a null id stays null in ``doc_ids``; repeated rows are packed as often as they
    occur; an empty table gives no row; other columns are ignored.
    """
    kind = "<u2" if max(end_id, pad_id, length, 50256) < 1 << 16 else "<u4"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, shard = tokenizer(vocabulary_path), TaskContext.get().partitionId()
        pieces, held, window = [], 0, 0
        for pdf in batches:
            for doc, text in zip(pdf["k"], pdf["t"]):
                ids = np.array(encode(text or "") + [end_id], kind)
                pieces += [(doc, at, ids[at : at + length]) for at in range(0, len(ids), length)]
                held += len(ids)
                if held >= window_tokens:
                    yield from packed(pieces, shard, window)
                    pieces, held, window = [], 0, window + 1
        if pieces:
            yield from packed(pieces, shard, window)

    def packed(pieces: list, shard: int, window: int) -> Iterator[pd.DataFrame]:
        out = []
        for number, row in enumerate(best_fit_decreasing(np.array([len(p[2]) for p in pieces]), length)):
            parts = [pieces[i] for i in row]
            lengths = [len(p[2]) for p in parts]
            total = sum(lengths)
            ids = np.concatenate([p[2] for p in parts] + [np.full(length - total, pad_id, kind)])
            at = np.concatenate([np.arange(n) for n in [*lengths, length - total]]).astype(kind)
            names = [None if p[0] is None else int(p[0]) for p in parts]
            out.append((shard, window, number, total, names, [p[1] for p in parts], [0, *np.cumsum(lengths).tolist()], ids.tobytes(), at.tobytes()))
            if len(out) == 1000:
                yield pd.DataFrame(out, columns=names_out)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names_out)

    names_out = [x.split()[0] for x in SCHEMA.split(", ")]
    return docs.select(F.col(id_col).cast("long").cast("string").alias("k"), F.col(text_col).alias("t")).mapInPandas(run, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows; rows of a shard and window form one id matrix in the order of ``row``."""
    packed.write.mode("overwrite").parquet(path)
