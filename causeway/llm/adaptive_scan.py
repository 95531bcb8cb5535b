"""Approximate nearest neighbours by inner product: inverted lists and an adaptive dimension scan."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.session import checkpointed

#: Lists and probes are fitted on about so many vectors, chosen by a hash; a list has about so many rows, and there are at most so many lists.
SAMPLE, ASKED, ROWS_OF_LIST, MOST_LISTS = 32_768, 256, 1024, 4096
#: Share of the sample's true neighbours that the probed lists must hold, and the share of near vectors that the tests may lose in all.
IN_LISTS, LOST = 0.97, 0.005
#: Dimensions of a column block; vectors of a shard of a list, and queries that meet one in a task.
WIDTH, SHARD, QUERY_BLOCK = 16, 4096, 512
#: Each round of probes sees about so many times the lists that the rounds before saw, with the bar that they reached.
GROWTH = 4
_SCHEMA_ASSIGNED = "row long, list int, vec array<double>, rotated array<double>, ids array<struct<vec_id: long, copies: long>>"
_SCHEMA_PACKED = "list int, shard int, blocks array<binary>, norms binary, original binary, firsts binary, rows array<long>, ids array<array<struct<vec_id: long, copies: long>>>"
_SCHEMA_PROBES = "row long, list int, round int, vec array<double>, rotated array<double>"
_SCHEMA_FOUND = "query long, row long, first long, score double, ids array<struct<vec_id: long, copies: long>>"
_IDS = pa.list_(pa.struct([("vec_id", pa.int64()), ("copies", pa.int64())]))


@dataclass
class Lists:
    """What is fitted: centroids of the lists, how many to probe, and the rotation."""

    centroids: np.ndarray
    probes: int
    rotation: np.ndarray


def usable(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vec, is_query) of the rows that take part: an id, and a vector that is not zero, of finite components, and of the most frequent length (of two, the longer)."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vec"), is_query.alias("is_query"))
    finite = F.forall("vec", lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("vec", lambda c: c != 0))
    length = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("vec") == (length["d"] if length else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _arrays(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), m.ravel())


def _nearest_list(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1)[None] - 2 * x @ centroids.T, axis=1)


def fit(base: DataFrame, n: int, k: int) -> Lists:
    """Centroids by k-means on the sample, and the least number of probes at which the lists hold ``IN_LISTS`` of the
    true neighbours that some of the sample's vectors have in the sample. In all rows neighbours are nearer than in the sample, so that number is a careful one."""
    sample = np.array([r["vec"] for r in base.where(F.pmod(F.xxhash64("vec"), F.lit(n)) < SAMPLE).orderBy("vec").select("vec").collect()] or [base.first()["vec"]])
    rng = np.random.default_rng(13)
    d = sample.shape[1]
    lists = max(1, min(MOST_LISTS, math.ceil(n / ROWS_OF_LIST), len(sample)))
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(10):
        home = _nearest_list(sample, centroids)
        size = np.bincount(home, minlength=lists)
        sums = np.zeros((lists, d))
        np.add.at(sums, home, sample)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centroids)
    home = _nearest_list(sample, centroids)
    asked = rng.choice(len(sample), min(ASKED, len(sample)), replace=False)
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = min(k, len(sample) - 1)
    top = np.argsort(-scores, axis=1, kind="stable")[:, :near]
    place = np.argsort(np.argsort(-(sample[asked] @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.sort(np.take_along_axis(place, home[top], axis=1).ravel()) + 1
    probes = int(needed[min(len(needed) - 1, math.ceil(IN_LISTS * len(needed)) - 1)]) if len(needed) else 1
    rotation, _ = np.linalg.qr(rng.normal(size=(d, d)))
    return Lists(centroids, probes, rotation)


def beta_quantile(p: float, a: float, b: float, steps: int = 20_000) -> float:
    """Where a beta distribution has reached ``p``, rounded up to the next of ``steps``."""
    t = (np.arange(steps) + 0.5) / steps
    density = np.exp((a - 1) * np.log(t) + (b - 1) * np.log1p(-t) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))
    return float(min(1.0, (np.searchsorted(np.cumsum(density) / density.sum(), p) + 1) / steps))


def tests_of_blocks(d: int) -> list[float]:
    """After each column block, the largest part of its whole squared distance that a vector may have shown.

    Rotated at random, the share of the first t of d coordinates in a squared distance
    is beta(t/2, (d-t)/2). A vector whose partial distance is beyond this quantile of the farthest
    useful distance is abandoned; all tests together lose ``LOST`` of the near vectors at most.
    """
    ends = list(range(WIDTH, d, WIDTH))
    return [beta_quantile(1 - LOST / len(ends), t / 2, (d - t) / 2) * (1 + 1e-9) for t in ends] + [1 + 1e-9]


def _assign(lists: Lists):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_nearest_list(x, lists.centroids), pa.int32()), batch.column(1), _arrays(x @ lists.rotation), batch.column(2)], ["row", "list", "vec", "rotated", "ids"])

    return run


def _pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """One row for a shard: column blocks (dimension by dimension), squared norms, the vectors as they were, ids."""
    rows = rows.combine_chunks().sort_by("row")
    turned, ids = _matrix(rows["rotated"].combine_chunks()), rows["ids"].combine_chunks()
    firsts = np.array([i[0]["vec_id"].as_py() for i in ids], np.int64)
    return pa.table({
        "list": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()),
        "blocks": [[np.ascontiguousarray(turned[:, at : at + WIDTH].T).tobytes() for at in range(0, turned.shape[1], WIDTH)]],
        "norms": [(turned**2).sum(axis=1).tobytes()], "original": [_matrix(rows["vec"].combine_chunks()).tobytes()], "firsts": [firsts.tobytes()],
        "rows": pa.array([rows["row"].to_pylist()], pa.list_(pa.int64())), "ids": pa.array([ids.to_pylist()], pa.list_(_IDS)),
    })


def _round(place: np.ndarray, near: np.ndarray) -> np.ndarray:
    """0 for the first ``near`` lists, then 1 up to ``GROWTH`` times as many, and so on."""
    number = np.zeros(len(place), np.int64)
    reach = near.astype(np.int64)
    while (left := place >= reach).any():
        number += left
        reach = np.where(left, reach * GROWTH, reach)
    return number


def _probes(lists: Lists, sizes: np.ndarray, least: int):
    """The lists of each query in the order of their centroids' products: as many as fitted, and on until ``least`` vectors are there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            order = np.argsort(-(x @ lists.centroids.T), axis=1, kind="stable")
            enough = (np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1
            many = np.minimum(np.maximum(lists.probes, enough), order.shape[1])
            near = np.minimum(enough, many)
            for at in range(0, len(x), 64):
                rows = np.arange(at, min(at + 64, len(x)))
                of = np.repeat(rows, many[rows])
                place = np.concatenate([np.arange(m) for m in many[rows]])
                take = pa.array(of)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(order[of, place], pa.int32()), pa.array(_round(place, near[of]), pa.int32()), batch.column(1).take(take), batch.column(2).take(take)], ["row", "list", "round", "vec", "rotated"])

    return run


class _Shard:
    def __init__(self, packed: dict) -> None:
        n = len(packed["rows"])
        self.blocks = [np.frombuffer(b).reshape(-1, n) for b in packed["blocks"]]
        self.norms, self.firsts = np.frombuffer(packed["norms"]), np.frombuffer(packed["firsts"], np.int64)
        self.original = np.frombuffer(packed["original"]).reshape(n, -1)

    def scan(self, query: np.ndarray, turned: np.ndarray, tests: list[float], floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` best vectors above ``floor``, by (score, id).

        <q, x> < floor is the same as |q - x|^2 > |q|^2 + |x|^2 - 2 floor, which the
        partial distances are tested against.
        """
        norm = float((turned**2).sum())
        places, scores = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 4 * k
        while at < len(self.norms):
            alive = np.arange(at, min(at + step, len(self.norms)))
            at, step = at + step, 1024
            if floor > -np.inf:
                reach = norm + self.norms[alive] - 2 * floor
                reach += 1e-9 * (norm + self.norms[alive])
                partial = np.zeros(len(alive))
                for number, (block, most) in enumerate(zip(self.blocks, tests)):
                    gap = block[:, alive] - turned[number * WIDTH : number * WIDTH + len(block), None]
                    partial += (gap * gap).sum(axis=0)
                    stays = partial <= most * reach
                    if not stays.all():
                        alive, partial, reach = alive[stays], partial[stays], reach[stays]
                    if not len(alive):
                        break
            if len(alive):
                places = np.concatenate([places, alive])
                scores = np.concatenate([scores, np.cumsum(self.original[alive] * query, axis=1)[:, -1]])
                order = np.lexsort((self.firsts[places], -scores))[:k]
                places, scores = places[order], scores[order]
                if len(scores) == k:
                    floor = max(floor, float(scores[-1]))
        return places, scores


def _scan(tests: list[float], k: int) -> Callable:
    def run(queries: pa.Table, packed: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        if queries.num_rows:
            asked, turned = _matrix(queries["vec"].combine_chunks()), _matrix(queries["rotated"].combine_chunks())
            floors, names = queries["floor"].to_numpy(), queries["row"].to_numpy()
            for shard in packed.to_batches(max_chunksize=1):
                held = _Shard({c: shard.column(c)[0].as_py() for c in ("rows", "blocks", "norms", "original", "firsts")})
                rows, ids = shard.column("rows").flatten(), shard.column("ids").flatten()
                for name, q, t, floor in zip(names, asked, turned, floors):
                    places, scores = held.scan(q, t, tests, floor, k)
                    if len(places):
                        take = pa.array(places)
                        out.append(pa.table([pa.array(np.full(len(places), name)), rows.take(take), pa.array(held.firsts[places]), pa.array(scores), ids.take(take)], ["query", "row", "first", "score", "ids"]))
        empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], _IDS)], ["query", "row", "first", "score", "ids"])
        return pa.concat_tables([empty, *out], promote_options="permissive").combine_chunks().cast(empty.schema)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("first")))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _scanned(probes: DataFrame, packed: DataFrame, shards: np.ndarray, d: int, k: int) -> DataFrame:
    """Queries meet the shards of their lists in blocks of bounded size on both sides."""
    counts = {r["list"]: r["count"] for r in probes.groupBy("list").count().collect()}  # a row for each list
    blocks = np.array([math.ceil(counts.get(i, 0) / QUERY_BLOCK) for i in range(len(shards))])
    of_list = lambda numbers: F.get(F.array(*[F.lit(max(1, int(m))) for m in numbers]), F.col("list"))
    up_to = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    asked = probes.withColumn("block", F.pmod(F.xxhash64("row"), of_list(blocks)).cast("int")).withColumn("shard", up_to(of_list(shards)))
    held = packed.where(F.get(F.array(*[F.lit(bool(b)) for b in blocks]), F.col("list"))).withColumn("block", up_to(of_list(blocks)))
    key = ["list", "shard", "block"]
    return asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(_scan(tests_of_blocks(d), k), _SCHEMA_FOUND)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query row its ``k`` nearest rows found: query_id, rank, vec_id, score.

    Nearness is the inner product in double precision, added up from the first dimension
    on; ties go to the smaller id. Every row but the query's own is a candidate, also one that
    repeats its id or vector, and fewer than ``k`` come only where there are fewer.
    ``is_query`` is a condition on a row of ``vectors``. Which rows take part: see :func:`usable`.
    Other columns are ignored; an empty table gives an empty result.

    Equal vectors are one entry of the index with its ``k + 1`` least ids, which is all that
    a result can hold of them. Entries go to the list of their nearest centroid,
    lists to shards of bounded size in column blocks. A query meets its nearest
    lists first, then in rounds ``GROWTH`` times as many; the ``k + 1``-th score so far is the bar that a round's scans start from, so that few rows leave them.
    """
    rows = usable(vectors, is_query, id_col, vector_col).groupBy("vec", "vec_id").agg(F.count("*").alias("copies"), F.count_if("is_query").alias("asked"))
    rows = checkpointed(rows)
    of_vector = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    entries = rows.withColumn("place", of_vector).where(F.col("place") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list(F.struct("vec_id", "copies"))).alias("ids"))
    base = checkpointed(entries.select(F.monotonically_increasing_id().alias("row"), "vec", "ids"))
    n = base.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = fit(base, n, k)
    placed = checkpointed(base.mapInArrow(_assign(lists), _SCHEMA_ASSIGNED))
    sizes = np.zeros(len(lists.centroids), np.int64)
    for r in placed.groupBy("list").count().collect():  # a row for each list
        sizes[r["list"]] = r["count"]
    shards = np.maximum(1, -(-sizes // SHARD))
    of_list = F.get(F.array(*[F.lit(int(m)) for m in shards]), F.col("list"))
    sharded = placed.withColumn("shard", F.pmod(F.xxhash64("row"), of_list).cast("int"))
    packed = checkpointed(sharded.groupBy("list", "shard").applyInArrow(_pack, _SCHEMA_PACKED))

    asked = rows.where("asked > 0").select("vec", F.col("vec_id").alias("query_id"), "asked")
    asked = checkpointed(asked.join(placed.select("vec", F.col("row").alias("query")), "vec").drop("vec"))
    turned = placed.join(asked.select(F.col("query").alias("row")).distinct(), "row", "left_semi").select("row", "vec", "rotated")
    probes = checkpointed(turned.mapInArrow(_probes(lists, sizes, k + 1), _SCHEMA_PROBES))
    d = lists.centroids.shape[1]
    none = F.lit(float("-inf"))
    found = checkpointed(_best(_scanned(probes.where("round = 0").withColumn("floor", none), packed, shards, d, k + 1), k + 1).drop("place"))
    for number in range(1, probes.agg(F.max("round")).first()[0] + 1 if not probes.isEmpty() else 1):
        bars = found.groupBy(F.col("query").alias("row")).agg(F.when(F.count("*") > k, F.min("score")).alias("floor"))
        others = probes.where(F.col("round") == number).join(bars, "row", "left").withColumn("floor", F.coalesce("floor", none))
        found = checkpointed(_best(found.unionByName(_scanned(others, packed, shards, d, k + 1)), k + 1).drop("place"))

    each = asked.join(found.select("query", "row", "score", F.inline("ids")), "query")
    own = (F.col("row") == F.col("query")) & (F.col("vec_id") == F.col("query_id"))
    left = F.least(F.col("copies") - own.cast("long"), F.lit(k))
    each = each.withColumn("left", left).where("left > 0").select("query", "query_id", "asked", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("left"))))
    rank = F.row_number().over(Window.partitionBy("query", "query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    ranked = each.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("asked"))).alias("copy")).drop("copy")

