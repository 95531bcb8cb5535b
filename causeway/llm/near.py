"""Near-duplicate engine: MinHash banding, then exact Jaccard on full five-word shingle sets.

Used by the n-gram Jaccard join (documents) and by substring dedup (paragraphs).

Units that share a band form candidate components (one star per bucket, so a bucket of m
units gives m - 1 edges). Each component is cut into blocks of bounded size and every
pair of blocks is one tile; a tile compares all its pairs exactly, as set sizes from a
matrix product, and hands on one row a unit: how many copies it is linked to, and the
least unit of its cluster in the tile. So a group of thousands of near copies is compared
in full, over many tasks, and no pair of units is a row; a text moves once for each block
of its component, so a component of n units moves n times n / MOST_BLOCK texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.memory import trimmed
from causeway.llm.tables import split_by_keys
from causeway.llm.words import constants, mix, shingles
from causeway.operators.graph import contract_components
from causeway.session import checkpointed, written

#: Units in a block: at least, and at most (a tile holds two blocks).
LEAST_BLOCK, MOST_BLOCK = 256, 1024


@dataclass(frozen=True)
class Banding:
    """MinHash bands; ``recall(s)`` is the chance that a pair of Jaccard ``s`` meets in a band."""

    bands: int = 32
    rows: int = 5
    threshold: str = "0.8"

    def recall(self, s: float) -> float:
        return 1 - (1 - s**self.rows) ** self.bands


def signatures(hashes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """MinHash values, a row a text; ``counts`` must be positive."""
    out = np.empty((len(counts), k), np.uint64)
    ends = np.cumsum(counts)
    xors, factors = constants(k, 101), constants(k, 202)
    at = 0
    while at < len(counts):
        first = ends[at] - counts[at]
        to = max(at + 1, int(np.searchsorted(ends, first + 32768)))
        part = hashes[first : ends[to - 1]]
        starts = ends[at:to] - counts[at:to] - first
        with np.errstate(over="ignore"):
            for j in range(k):
                out[at:to, j] = np.minimum.reduceat((part ^ xors[j]) * factors[j], starts)
        at = to
    return out


def band_hashes(hashes: np.ndarray, counts: np.ndarray, banding: Banding) -> np.ndarray:
    sig = signatures(hashes, counts, banding.bands * banding.rows).reshape(len(counts), banding.bands, banding.rows)
    with np.errstate(over="ignore"):
        return mix((sig * constants(banding.rows, 303)).sum(axis=2, dtype=np.uint64) + constants(banding.bands, 404))


def band_rows(banding: Banding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                hashes, counts = shingles([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])
                some = counts > 0
                if some.any():
                    bands = band_hashes(hashes, counts[some], banding)
                    cid = part.column("cid").to_numpy(zero_copy_only=False)[some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bands.view(np.int64).ravel()), pa.array(np.repeat(cid, banding.bands))], ["bucket", "cid"]
                    )

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, exactly."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    n = int(shared.sum())
    exact = np.float32 if int(times.sum()) < 1 << 24 else np.float64  # counts that the type holds exactly
    got = np.zeros((m, m), exact)
    if not n:
        return got
    sizes = times[shared].astype(np.float64)
    if (sizes**2).sum() * 5e-9 < m * m * n / 2e10:  # few meet in a shingle: go through its holders
        order = np.argsort(column, kind="stable")
        holders, first = owner[order], np.concatenate([[0], np.cumsum(times[shared])])
        bounds = np.searchsorted(owner, np.arange(m + 1))
        for i in range(m):
            c = column[bounds[i] : bounds[i + 1]]
            sizes_c = first[c + 1] - first[c]
            at = np.repeat(first[c] - (np.cumsum(sizes_c) - sizes_c), sizes_c) + np.arange(int(sizes_c.sum()))
            got[i] = np.bincount(holders[at], minlength=m)
        return got
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = max(64, min(8192, (1 << 22) // m))
    for at in range(0, n, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        dense = np.zeros((m, width), np.float32)
        dense[owner[lo:hi], column[lo:hi] - at] = 1
        got += dense @ dense.T
    return got


def tile_links(texts: list[bytes], copies: np.ndarray, side: np.ndarray, threshold: str) -> tuple[np.ndarray, np.ndarray]:
    """(copies linked to, cluster's least position) of each text of a tile; position -1: no link.

    ``side`` is 0 or 1; where both occur only pairs across the sides count.
    """
    limit = Fraction(threshold)
    hashes, counts = shingles(texts)
    ends = np.cumsum(counts)
    sets = [np.unique(hashes[e - c : e]) for e, c in zip(ends, counts)]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    both = _overlaps(sets)
    linked = np.zeros(both.shape, bool)
    for at in range(0, len(sets), 256):  # whole numbers in strips: an exact comparison in little memory
        strip = both[at : at + 256].astype(np.int64)
        union = sizes[at : at + 256, None] + sizes[None, :] - strip
        linked[at : at + 256] = (strip * limit.denominator >= union * limit.numerator) & (strip > 0)
    del both
    np.fill_diagonal(linked, False)
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    root = np.where(linked.any(axis=1), np.arange(len(texts)), -1)
    while True:  # the least position spreads over the links
        low = np.concatenate([np.where(linked[at : at + 256], root[None, :], len(texts)).min(axis=1) for at in range(0, len(texts), 256)])
        new = np.where(root >= 0, np.minimum(root, low), -1)
        new = np.where(new >= 0, new[new], -1)
        if (new == root).all():
            return linked @ copies, root
        root = new


def _tiles(threshold: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("uid", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

        def close(rows: pa.Table) -> pa.RecordBatch:
            uid = np.array(rows.column("uid").to_pylist(), dtype=object)
            side = (rows.column("block").to_numpy() != rows.column("a").to_numpy()).astype(int)
            texts = rows.column("text").cast(pa.binary()).to_pylist()
            order = sorted(range(len(uid)), key=uid.__getitem__)  # positions in the order of uid
            links, root = tile_links([texts[i] for i in order], rows.column("copies").to_numpy()[order], side[order], threshold)
            uid, some = uid[order], np.flatnonzero(root >= 0)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(uid[some]), pa.binary()), pa.array(links[some].astype(np.int64)), pa.array(list(uid[root[some]]), pa.binary())], schema=schema
            )

        kept, key = [], None
        for batch in trimmed(batches):
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("component", "a", "b"))))
            at = 0
            for i, k in enumerate(keys):
                if k != key:
                    if i > at:
                        kept.append(batch.slice(at, i - at))
                    if kept:
                        yield close(pa.Table.from_batches(kept))
                    kept, key, at = [], k, i
            if len(batch) > at:
                kept.append(batch.slice(at))
        if kept:
            yield close(pa.Table.from_batches(kept))

    return run


BANDS = "bucket long, cid long"


def candidate_components(units: DataFrame, banding: Banding, bands: DataFrame | None = None) -> DataFrame:
    """(node, component) over the 64-bit ids of units that share a band with another one."""
    rows = units.select("cid", "text").mapInArrow(band_rows(banding), BANDS) if bands is None else bands
    hubs = rows.groupBy("bucket").agg(F.min("cid").alias("hub"), F.max("cid").alias("last")).where("hub < last")
    edges = rows.join(hubs, "bucket").where("cid <> hub").select(F.col("cid").alias("src"), F.col("hub").alias("dst")).distinct()
    return contract_components(edges)


def near_links(rows: DataFrame, uid: Column, banding: Banding = Banding(), bands: DataFrame | None = None) -> DataFrame:
    """(uid, links, root) of each distinct text that has a partner of the threshold's Jaccard or more.

    ``rows`` has a column ``text``; ``uid`` is sixteen bytes that stand for it. ``links``
    counts the rows of other texts that it is linked to, ``root`` is the least uid of
    its connected component of links. ``bands`` are the rows of :func:`band_rows` over
    (xxhash64 of uid, text), given where a Python worker makes the texts and can band
    them at once; else a task would hold two workers.
    """
    units = rows.select(uid.alias("uid"), "text").where("text is not null").withColumn("cid", F.xxhash64("uid"))
    groups = checkpointed(candidate_components(units, banding, bands))
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    size = F.col("size")
    block = F.least(F.greatest(F.lit(LEAST_BLOCK), F.ceil(size / 16)), F.lit(MOST_BLOCK))
    placed = checkpointed(
        groups.join(sizes, "component")
        .withColumn("blocks", F.ceil(size / block))
        .select(F.col("node").alias("cid"), "component", "blocks", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("blocks")).alias("block"))
    )
    wanted, _ = split_by_keys(units, F.col("cid"), placed.select("cid"))
    texts = wanted.groupBy("cid", "uid").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    tiles = (
        texts.join(placed, "cid")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("component", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "uid", "copies", "text")
    )
    found = checkpointed(
        tiles.repartition("component", "a", "b")
        .sortWithinPartitions("component", "a", "b")
        .mapInArrow(_tiles(banding.threshold), "uid binary, links long, root binary")
    )
    roots = contract_components(found.select(F.col("uid").alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    return written(links.join(roots.select(F.col("node").alias("uid"), F.col("component").alias("root")), "uid", "left"))
