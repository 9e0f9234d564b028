"""Nearest vectors by cosine, through collision-counting hashing with query-centred windows.

Each of PROJECTIONS random lines gets one projection of every vector, at unit length, and keeps them as a sorted array. A
query's window on a line is centred on its own projection; virtual rehashing widens all windows together. A vector that lies
in the windows of at least NEEDED lines is a candidate and is verified by its exact cosine. On a line, two unit vectors at
distance d differ by d times a normal number, so a window of half-width RATIO * d holds a vector at distance d on a known
share of the lines; NEEDED is SLACK standard deviations below that. A query is done when its windows are that wide for the
distance of its last wanted neighbour found so far; if windows come to cover all lines, all vectors have been verified, so no
case is left out.

Vectors are dealt to blocks of bounded size, each with its own sorted arrays; queries, a stated set, are packed into blocks
too, and every block of queries meets every block of vectors once. So that no block starts from nothing, each query first
meets a bounded sample of the vectors (PILOT_NUMBERS numbers); the distance of its last wanted neighbour there is a bound for
all blocks, at which the windows open at once. Only the best few per query and block are shuffled.

Defined results: null vectors, empty or zero ones, and such with null or non-finite components take no part, as query or
candidate; nor do null ids. A vector of another length than the query is no candidate. Every row is a candidate of every other
row, also of one with the same id or the same vector; a query id that stands in two rows is two queries, each with its own
ranks. Ties go to the smaller id; other columns are ignored. An empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recohort.llm.text import small_batches
from recohort.session import pin

#: Collisions are counted in bytes, so there are at most 255 lines.
PROJECTIONS = 240
RATIO, SLACK = 1.2, 1.7
_SHARE = 2 * NormalDist().cdf(RATIO) - 1
NEEDED = math.ceil(PROJECTIONS * _SHARE - SLACK * math.sqrt(PROJECTIONS * _SHARE * (1 - _SHARE)))
#: First half-width of a window where no bound is known, and the growth of each step.
WIDTH, GROWTH = 0.25, 1.35
#: A block holds at most so many vectors (their ranks fit in 16 bits) and numbers.
BLOCK_VECTORS, BLOCK_QUERIES, BLOCK_NUMBERS = 16384, 512, 1 << 20
#: Numbers in the sample from which the first bounds are taken: 4 MB.
PILOT_NUMBERS = 1 << 19
#: Queries whose vectors hold at most this many numbers (10 MB) are broadcast.
BROADCAST_NUMBERS = 1_280_000
_SEED = 5


def _lines(dims: int, count: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(_SEED)).normal(size=(dims, count))


def _in_range(vectors: np.ndarray) -> np.ndarray:
    """Rows whose squares would vanish or overflow, scaled by a power of two, which changes no digit of a cosine."""
    exponents = np.frexp(np.abs(vectors).max(axis=1, initial=0.0))[1]
    far = np.abs(exponents) > 400
    return np.ldexp(vectors, -np.where(far, exponents, 0)[:, None]) if far.any() else vectors


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each row on its own, so equal vectors have equal cosines."""
    query, vectors = _in_range(query[None, :])[0], _in_range(vectors)
    return (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither vanish nor overflow.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


class Block:
    """Some vectors, their sorted projections on each line, and each vector's rank on each line."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.lines = _lines(vectors.shape[1], PROJECTIONS)
        heights = (_unit(vectors) @ self.lines).T
        self.sorted = np.sort(heights, axis=1)
        self.ranks = np.empty(heights.shape, np.uint16)
        places = np.arange(len(ids), dtype=np.uint16)
        for line, rank in zip(heights, self.ranks, strict=True):
            rank[np.argsort(line, kind="stable")] = places

    def windows(self, centres: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For queries x lines, the first rank inside the window and the number of ranks in it."""
        low = np.empty(centres.shape, np.int64)
        high = np.empty(centres.shape, np.int64)
        for k, line in enumerate(self.sorted):
            low[:, k] = np.searchsorted(line, centres[:, k] - widths)
            high[:, k] = np.searchsorted(line, centres[:, k] + widths, "right")
        return low, high - low

    def collisions(self, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        """In how many windows of one query each vector is. Ranks below the first wrap around to large numbers."""
        hits = np.zeros(len(self.ids), np.uint8)
        away, inside = np.empty(len(self.ids), np.uint16), np.empty(len(self.ids), bool)
        for rank, first, count in zip(self.ranks, low.astype(np.uint16), size.tolist(), strict=True):
            np.subtract(rank, first, out=away)
            np.less(away, count, out=inside)
            np.add(hits, inside.view(np.uint8), out=hits)
        return hits

    def search(self, queries: np.ndarray, own: np.ndarray, count: int, bounds: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For each query the places in the block and the cosines of the nearest vectors found, and how many were verified.

        own: the place of the query's own row in this block, or -1. bounds: a distance within which each has `count`
        neighbours, in this block or another; infinite where none is known.
        """
        n, size = len(queries), len(self.ids)
        centres = _unit(queries) @ self.lines
        bounds = np.full(n, np.inf) if bounds is None else bounds
        widths = np.where(np.isfinite(bounds), RATIO * bounds, WIDTH)
        wanted = np.array([min(count, size - (o >= 0)) for o in own])
        places, scores = [np.zeros(0, np.int64)] * n, [np.zeros(0)] * n
        verified = np.zeros((n, size), bool)
        verified[np.flatnonzero(own >= 0), own[own >= 0]] = True
        open_ = np.arange(n)
        while len(open_):
            low, inside = self.windows(centres[open_], widths[open_])
            still = []
            for at, j in enumerate(open_):
                fresh = np.flatnonzero((self.collisions(low[at], inside[at]) >= NEEDED) & ~verified[j])
                if len(fresh):
                    verified[j, fresh] = True
                    found = np.concatenate([places[j], fresh])
                    near = np.concatenate([scores[j], cosines(queries[j], self.vectors[fresh])])
                    best = np.lexsort((self.ids[found], -near))[:count]
                    places[j], scores[j] = found[best], near[best]
                # What is known to be enough: the bound from elsewhere, or the last wanted neighbour found here.
                here = math.sqrt(max(0.0, 2 - 2 * scores[j][-1])) if wanted[j] and len(scores[j]) >= wanted[j] else np.inf
                if wanted[j] and widths[j] < RATIO * min(bounds[j], here) and (inside[at] < size).any():
                    still.append(j)
            open_ = np.array(still, np.int64)
            widths[open_] *= GROWTH
        return places, scores, verified.sum(axis=1) - (own >= 0)


def _clean(rows: DataFrame, id_name: str, vector_name: str, asked: Column) -> DataFrame:
    vector = F.col(vector_name).cast("array<double>")
    rows = rows.select(F.col(id_name).cast("long").alias("id"), vector.alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & sound & F.exists("v", lambda x: x != 0))


def _pack(rows: DataFrame) -> DataFrame:
    """Blocks of bounded size with vectors of one length: (dims, block, ids, vectors, asked), the numbers as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        made = TaskContext.get().partitionId() << 32

        def block(dims):
            nonlocal made
            ids, vectors, asked = zip(*held.pop(dims), strict=True)
            made += 1
            return pa.RecordBatch.from_arrays([
                pa.array([dims], pa.int32()), pa.array([made], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                pa.array([np.concatenate(vectors).astype("<f8").tobytes()], pa.binary()), pa.array([np.array(asked, bool).tobytes()], pa.binary())],
                names=["dims", "block", "ids", "vectors", "asked"])

        for batch in batches:
            ids, vectors, asked = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            offsets, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
            for k, i in enumerate(ids):
                v = flat[offsets[k]:offsets[k + 1]]
                own = held.setdefault(len(v), [])
                own.append((i, v, asked[k]))
                if len(own) >= min(BLOCK_VECTORS, max(256, BLOCK_NUMBERS // len(v))):
                    yield block(len(v))
        for dims in list(held):
            yield block(dims)

    return rows.mapInArrow(run, "dims int, block long, ids binary, vectors binary, asked binary")


def _pilot(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{dims: (ids, vectors)} of a bounded sample, the same for the same rows."""
    longest = rows.agg(F.max(F.array_size("v"))).first()[0]
    if not longest:
        return {}
    found: dict[int, list] = {}
    for row in rows.orderBy(F.xxhash64("id", "v"), "id").limit(max(64, PILOT_NUMBERS // longest)).select("id", "v").collect():
        found.setdefault(len(row["v"]), []).append((row["id"], row["v"]))
    return {dims: (np.array([i for i, _ in some]), np.array([v for _, v in some])) for dims, some in found.items()}


def bounds(ids: np.ndarray, queries: np.ndarray, pilot: tuple[np.ndarray, np.ndarray] | None, count: int) -> np.ndarray:
    """A distance within which each query has `count` neighbours in the sample; infinite if the sample has too few."""
    if pilot is None or len(pilot[0]) <= count:
        return np.full(len(ids), np.inf)
    near = _unit(queries) @ _unit(pilot[1]).T
    for k, i in enumerate(ids):
        # The query's own row, if the sample holds it. Of two equal rows with its id, one is a neighbour.
        same = np.flatnonzero(pilot[0] == i)
        same = same[(pilot[1][same] == queries[k]).all(axis=1)]
        near[k, same[:1]] = -np.inf
    last = np.partition(near, near.shape[1] - count, axis=1)[:, -count]
    return np.sqrt(np.maximum(0.0, 2 - 2 * last)) * (1 + 1e-9)


def _queries(blocks: DataFrame, pilot: dict[int, tuple[np.ndarray, np.ndarray]], count: int) -> DataFrame:
    """Blocks of the rows that are asked for, with where each stands and its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def packed(dims):
            parts = [np.concatenate(x) for x in zip(*held.pop(dims), strict=True)]
            for at in range(0, len(parts[0]), BLOCK_QUERIES):
                ids, vectors, home, place = (x[at:at + BLOCK_QUERIES] for x in parts)
                yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (
                    ids, vectors, home, place, bounds(ids, vectors, pilot.get(dims), count)))],
                    names=["dims", "query_ids", "query_vectors", "home", "place", "bounds"])

        for batch in batches:
            for dims, block, ids, vectors, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = np.flatnonzero(np.frombuffer(asked, bool))
                if not len(place):
                    continue
                own = held.setdefault(dims, [])
                own.append((np.frombuffer(ids, "<i8")[place], np.frombuffer(vectors, "<f8").reshape(-1, dims)[place], np.full(len(place), block), place))
                if sum(len(x[0]) for x in own) >= BLOCK_QUERIES:
                    yield from packed(dims)
        for dims in list(held):
            yield from packed(dims)

    return blocks.mapInArrow(run, "dims int, query_ids binary, query_vectors binary, home binary, place binary, bounds binary")


_FOUND = "home long, place long, query_id long, vec_id long, score double, verified long"


def _meet(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for dims, block, ids, vectors, query_ids, query_vectors, home, place, limits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != last:
                    last, held = block, Block(np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(-1, dims))
                home, place = np.frombuffer(home, "<i8"), np.frombuffer(place, "<i8")
                own = np.where(home == block, place, -1)
                found, scores, verified = held.search(np.frombuffer(query_vectors, "<f8").reshape(-1, dims), own, count, np.frombuffer(limits, "<f8"))
                sizes = [len(f) for f in found]
                yield pa.RecordBatch.from_arrays([
                    *(pa.array(np.repeat(x, sizes)) for x in (home, place, np.frombuffer(query_ids, "<i8"))),
                    pa.array(held.ids[np.concatenate(found)]), pa.array(np.concatenate(scores)), pa.array(np.repeat(verified, sizes))],
                    names=["home", "place", "query_id", "vec_id", "score", "verified"])

    return run


def nearest(vectors: DataFrame, asked: Column, count: int = 5, id_name: str = "vec_id", vector_name: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest other rows found of vectors for each of its rows that is asked for."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = _clean(vectors, id_name, vector_name, asked)
    # Written once: a row is known by its block and place there.
    blocks = pin(_pack(rows), "blocks")
    questions = _queries(blocks.where(F.length("asked") > 0), _pilot(rows), count)
    data = blocks.drop("asked")
    # Few large rows on either side: each block of queries is set beside each block of vectors of its length. Too many queries
    # for a broadcast go, as blocks, to each of the places to which the blocks of vectors are dealt.
    if (rows.where("asked").agg(F.sum(F.array_size("v"))).first()[0] or 0) <= BROADCAST_NUMBERS:
        pairs = data.repartition("block").join(F.broadcast(questions), "dims")
    else:
        places = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = data.withColumn("at", F.pmod(F.xxhash64("block"), F.lit(places)).cast("int"))
        spread = questions.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
        pairs = dealt.join(spread.hint("merge"), ["dims", "at"])
    met = pairs.select("dims", "block", "ids", "vectors", "query_ids", "query_vectors", "home", "place", "bounds").mapInArrow(_meet(count), _FOUND)
    order = Window.partitionBy("home", "place").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, F.col("vec_id") % 50 == 0)
