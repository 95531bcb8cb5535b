"""Best-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.memory import trim, trimmed
from causeway.llm.tables import rows_of
from causeway.llm.tokens import MOST_KEPT, default_path, encoder, grouped
from causeway.session import checkpointed

CAPACITY, END_ID = 2048, 0
#: Pieces packed together. Each group leaves about one sequence unfilled.
GROUP = 32768


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length (1 to ``capacity``).

    A bin is filled greedily with the longest piece that fits its gap. If a gap is left,
    its smallest piece gives way to the two unpacked pieces that fit the expanded gap
    most tightly, if they fit it more tightly.
    """
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.argsort(lengths, kind="stable")[::-1]:
        stock[lengths[i]].append(int(i))
    there = sum(1 << n for n in range(1, capacity + 1) if stock[n])
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0

    def longest(room: int) -> int:
        return (there & ((1 << (room + 1)) - 1)).bit_length() - 1

    def take(n: int) -> int:
        nonlocal there
        piece = stock[n].pop()
        if not stock[n]:
            there ^= 1 << n
        return piece

    while there:
        inside, gap = [], capacity
        while (n := longest(gap)) > 0:
            inside.append((take(n), n))
            gap -= n
        if gap and there:
            piece, small = inside[-1]
            room, best, pair = gap + small, small, None
            a = longest(room - 1)
            while a > 0 and 2 * a > best and best < room:
                b = longest(min(room - a, a if len(stock[a]) > 1 else a - 1))
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                a = longest(a - 1)
            if pair:
                inside.pop()
                inside += [(take(n), n) for n in pair]
                stock[small].append(piece)
                there |= 1 << small
        at = 0
        for piece, n in inside:
            bins[piece], offsets[piece] = number, at
            at += n
        number += 1
    return bins, offsets


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool, most_kept: int, release: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, most_kept)
        for batch in trimmed(batches):
            doc_ids = batch.column("doc_id").to_pylist()
            for first, texts in grouped([t or "" for t in batch.column("text").to_pylist()]):
                rows = []
                for doc_id, ids in zip(doc_ids[first:], encode(texts)):
                    ids += end
                    n, at, piece = len(ids) // 4, 0, 0
                    to = n % capacity or capacity  # the first piece takes what is over
                    while at < n:
                        part = ids[4 * at : 4 * to]
                        rows.append((doc_id, piece, at, to - at, zlib.crc32(part), part if with_ids else None))
                        at, to, piece = to, to + capacity, piece + 1
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns[: 6 if with_ids else 5], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5])
            del batch
        if release:
            encode.rest()
            encoder.cache_clear()
            trim()

    return run


def token_pieces(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, most_kept: int = MOST_KEPT, release: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32-bit) of every document.

    A document is the ids of its whole text (a null one is empty) and then ``end_id``;
    one longer than ``capacity`` is cut into pieces of that length, the first may be shorter.
    A worker keeps the ids of ``most_kept`` words at most in each of two generations, to
    the end of a task if ``release``, else for the next ones too.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return rows_of(docs).mapInArrow(_pieces(path or default_path(), capacity, end_id, with_ids, most_kept, release), schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` (column ``length``) with ``sequence_id`` and ``offset``, gapless from 0 in each sequence.

    Pieces are dealt at random into groups of about ``group`` and each group is packed by
    :func:`best_two_fit`, so the work is spread and what it wastes is about one sequence a
    group. Rows that repeat are pieces of their own; columns named like the two added
    ones are replaced. An empty table gives an empty result.
    """
    kept = checkpointed(pieces.select(*[c for c in pieces.columns if c not in ("sequence_id", "offset")]))
    groups = max(1, math.ceil(kept.count() / group))
    dealt = kept.withColumn("sequence_id", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(rows: pa.Table) -> pa.Table:
        bins, offsets = best_two_fit(rows.column("length").to_numpy(), capacity)
        numbers = rows.column("sequence_id").to_numpy() * (1 << 32) + bins
        return rows.set_column(rows.schema.get_field_index("sequence_id"), "sequence_id", pa.array(numbers)).append_column("offset", pa.array(offsets))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("sequence_id").applyInArrow(run, schema)
